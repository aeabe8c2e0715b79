"""robots.txt: groups and values of files, and the longest rule against a plain walk over patterns."""

import random

from sitelens.sources.robots import allowed_urls, encoded, read_robots


def walk(pattern, path):
    """Whether a pattern matches a start of path, by the sets of places it can have come to."""
    ends, at = pattern.endswith("$"), {0}
    for c in pattern.removesuffix("$"):
        at = set(range(min(at), len(path) + 1)) if c == "*" and at else {i + 1 for i in at if path[i : i + 1] == c}
    return len(path) in at if ends else bool(at)


def test_groups():
    text = "Disallow: /lost\nUser-Agent: A/2.0\nuser-agent: b # two\nDisallow: /x\nDisallow:\nCrawl-Delay: 1.5\n\nUSER-AGENT: a\rAllow: /x/y\r\nUser-agent: *\nDisallow: /\nCrawl-delay: soon\nSitemap: https://a.com/s.xml?a=1 # all\nnonsense"
    paths = lambda agent: [(r["allow"], r["path"]) for r in read_robots(text, agent)["rules"]]
    assert paths("A") == [(False, "/x"), (True, "/x/y")] and paths("B/7 (x)") == [(False, "/x")] and paths("other") == [(False, "/")]
    assert read_robots(text, "b")["crawl_delay"] == 1.5 and read_robots(text, "c")["crawl_delay"] is None and read_robots("", "c") == {"rules": [], "crawl_delay": None, "sitemaps": []}
    assert read_robots(text, "a")["sitemaps"] == ["https://a.com/s.xml?a=1"]
    assert encoded("/ñ%c3 %") == "/%C3%B1%C3%20%"


def test_longest_rule(spark):
    rng = random.Random(3)
    word = lambda letters, most: "".join(rng.choice(letters) for _ in range(rng.randint(0, most)))
    files = {f"https://s{k}.com": [(rng.random() < 0.5, "/" + word("ab/*%_\\.", 6) + rng.choice(["", "", "$", "*"])) for _ in range(rng.randint(0, 8))] for k in range(60)}
    text = lambda rules: "User-agent: *\n" + "".join(f"{'Allow' if a else 'Disallow'}: {p}\n" for a, p in rules)
    robots = spark.createDataFrame([(o, text(r)) for o, r in files.items()] + [("https://none.com", None)], "origin string, text string")
    urls = sorted({rng.choice(list(files)) + "/" + word("ab/%_.?ñ", 7) for _ in range(600)})
    special = ["https://none.com/x", "https://unknown.com/x", "HTTPS://S1.com", "https://s1.com?q#f", None, ""]
    rows = spark.createDataFrame([(u, "c", "k") for u in [*urls, *special, urls[0]]], "url string, text string, rules string")
    got = [(r["url"], r["allowed"], r["crawl_delay"], r["text"], r["rules"]) for r in allowed_urls(rows, robots, "bot").collect()]
    assert len(got) == len(urls) + len(special) + 1 and {r[2:] for r in got} == {(None, "c", "k")}
    for url, allowed, *_ in got:
        if url in special:
            continue
        origin, path = url[: url.index("/", 8)], encoded(url[url.index("/", 8) :])
        met = [(len(encoded(p)), a) for a, p in files[origin] if walk(encoded(p), path)]
        assert allowed == (max(met)[1] if met else True), (url, files[origin])
    assert {a for u, a, *_ in got if u in ("https://none.com/x", "https://unknown.com/x", None, "")} == {True}
    assert allowed_urls(rows.limit(0), robots, "bot").count() == 0
