"""Scalar functions and sources on hand-made cases."""

import hashlib
import json
import re
from datetime import date

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sitelens.functions import netguard, resources, seo, text, urls
from sitelens.sources import html, keyword_csv, site_files
from sitelens.sources import robots as robots_txt


def column(spark, values, make, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["o"] for r in rows.select("i", make(F.col("v")).alias("o")).orderBy("i").collect()]


URLS = {
    "HTTP://Example.COM:80/a//b/../c?b=2&a=1&utm_source=x#frag": "http://example.com/a/c?a=1&b=2",
    "https://example.com": "https://example.com/",
    "https://example.com./x": "https://example.com/x",
    "https://example.com:8443/x?": "https://example.com:8443/x",
    "https://example.com/é ñ?q=a b&x": "https://example.com/%C3%A9%20%C3%B1?q=a+b&x=",
    "https://example.com/a?gclid=1": "https://example.com/a",
    "mailto:a@b.c": None, "javascript:void(0)": None, "#top": None, "ftp://x/y": None, "": None, "  ": None,
    "https://example.com/cdn-cgi/trace": None, "https:///nohost": "https://nohost/", "nothing": None,
    "https://bücher.example/x": "https://xn--bcher-kva.example/x",
}


def test_normalize(spark):
    assert {u: urls.normalize(u) for u in URLS} == URLS
    assert column(spark, list(URLS), urls.normalize_url) == list(URLS.values())
    base = "https://example.com/dir/page.html?x=1"
    assert urls.normalize("../up?b=1", base) == "https://example.com/up?b=1" and urls.normalize("//other.org/a", base) == "https://other.org/a" and urls.normalize("sub", base) == "https://example.com/dir/sub"


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abcAB/.?&=#%é ~+:@-_", max_size=30))
def test_normalize_is_idempotent(tail):
    once = urls.normalize("https://Example.com/" + tail)
    assert once is None or urls.normalize(once) == once


def test_url_parts(spark):
    u = ["https://www.a.com/", "https://a.com/file.html", "https://a.com/dir/x", "https://a.com/dir"]
    assert column(spark, u, urls.directory_of) == ["/", "/", "/dir", "/dir"]
    assert column(spark, u, lambda c: urls.root_host(urls.host_of(c))) == ["a.com"] * 4
    assert column(spark, u, urls.silo_key) == ["/", "/", "/dir", "/"]
    assert column(spark, ["https://a.com/la-mejor-casa", "https://a.com/"], urls.slug_key) == ["mejor", "/"]
    assert column(spark, ["https://a.com/wp-json/x", "https://a.com/blog/feed/", "https://a.com/feeding"], urls.is_system_path) == [True, True, False]
    same = spark.createDataFrame([("https://www.a.com/x", "http://a.com"), ("https://b.a.com", "https://a.com"), ("https://c.com", "https://a.com")], "a string, b string")
    got = same.select(urls.is_same_site(F.col("a"), F.col("b")).alias("n"), urls.is_same_site(F.col("a"), F.col("b"), True).alias("s")).collect()
    assert [(r["n"], r["s"]) for r in got] == [(True, True), (False, True), (False, False)]


def test_resources(spark):
    assert column(spark, ["text/html; charset=UTF-8", "  TEXT/HTML ", "nonsense", "", None, "module", "*/*"], resources.normalize_content_type) == ["text/html", "text/html", None, None, None, "module", "*/*"]
    assert column(spark, ["https://a.com/x.JPG?v=1", "https://a.com/.htaccess", "https://a.com/a.", "/rel/y.css#z", "https://a.com/"], resources.extension_of) == ["jpg", None, None, "css", None]
    cases = [
        ("https://a.com/p", None, 200, "text/html", None, ("HTML_PAGE", "HTML_PAGE", "header", False)),
        ("https://a.com/i.jpg", None, 200, "image/webp", None, ("IMAGE", "IMAGE", "header", True)),
        ("https://a.com/i.webp", None, 404, "text/html", None, ("ERROR", "IMAGE", "extension", True)),
        ("https://a.com/d.pdf", None, 200, "application/octet-stream", None, ("PDF", "PDF", "extension", False)),
        ("https://a.com/d", None, 200, "application/octet-stream", None, ("UNKNOWN", "UNKNOWN", "none", False)),
        ("https://a.com/o", "https://a.com/n.png", 301, "image/png", None, ("REDIRECT", "IMAGE", "header", False)),
        ("https://a.com/t.txt", None, 200, "text/plain", None, ("OTHER_ASSET", "OTHER_ASSET", "extension", False)),
        ("https://a.com/x", None, None, None, "TIMEOUT", ("ERROR", "UNKNOWN", "none", False)),
        ("https://a.com/f", None, 200, "application/zip", "UNSUPPORTED_CONTENT", ("OTHER_ASSET", "OTHER_ASSET", "header", False)),
    ]
    rows = spark.createDataFrame([(i, *c[:5]) for i, c in enumerate(cases)], "i int, u string, f string, s int, c string, e string")
    x = resources.classify(F.col("u"), F.col("f"), F.col("s"), F.col("c"), F.col("e"), F.lit(None).cast("array<string>"))
    got = rows.select("i", x.alias("x")).orderBy("i").collect()
    assert [(r["x"]["resource_type"], r["x"]["media_type"], r["x"]["mime_source"], r["x"]["extension_mismatch"]) for r in got] == [c[5] for c in cases]


def test_guard(spark):
    ips = ["127.0.0.1", "10.1.2.3", "172.16.0.1", "172.32.0.1", "8.8.8.8", "100.64.1.1", "::1", "fe80::1", "::ffff:10.0.0.1", "2001:db8::1", "x"]
    assert column(spark, ips, netguard.is_private_ip) == [True, True, True, False, False, True, True, True, True, False, True]
    assert column(spark, ["http://localhost/", "ftp://a.com", "https://a.com", "http://192.168.1.1/x", "http://[::1]/"], netguard.url_verdict) == ["BLOCKED_HOST", "PROTOCOL", None, "PRIVATE_IP", "PRIVATE_IP"]


def test_seo(spark):
    assert column(spark, ["es", "es-ES", "zh-Hant-TW", "x-default", "es_ES", "ES", "es-es", "", "en-Latn"], seo.is_valid_hreflang) == [True, True, True, True, False, False, False, False, True]
    assert column(spark, [-2.5, 2.5, 1.4], seo.half_up, "double") == [-2, 3, 1]
    assert column(spark, ["12px", " 7", "x", None], seo.int_attribute) == [12, 7, None, None]


def test_text(spark):
    assert column(spark, ["12,5%", "0.125", "12.5", "x", ""], text.parse_ctr) == [0.125, 0.125, 0.125, None, None]
    assert column(spark, ["1.234,5", "1 000", "3.14", "x"], text.parse_number) == [1234.5, 1000.0, 3.14, None]
    assert column(spark, ["31/12/2025", "1-2-2024", "2024-03-04", "x", "31/31/2024"], text.parse_date) == [date(2025, 12, 31), date(2024, 2, 1), date(2024, 3, 4), None, None]
    assert column(spark, ["Zapatillas  Running ", "ＡＢ  ñ"], text.normalize_keyword) == ["zapatillas running", "ab ñ"]
    assert column(spark, ["es", "MEX", "xx", None, "long"], text.normalize_country) == ["esp", "mex", "esp", "esp", "esp"]
    assert column(spark, ["móvil", "Tablet", "tv"], text.normalize_device) == ["MOBILE", "TABLET", "ALL"]
    assert column(spark, ["https://www.A.com/x/y", "a.com"], text.normalize_target) == ["a.com", "a.com"]
    assert column(spark, ["a\nb, ,c", None], text.split_patterns) == [["a", "b", "c"], []]


def simhash_loop(value):
    """The fingerprint bit by bit."""
    words = [w for w in re.sub(r"[^\w\s]|_", " ", (value or "").lower()).split() if len(w) > 1]
    heads = [int.from_bytes(hashlib.md5(" ".join(words[i : i + 4]).encode()).digest()[:8], "big") for i in range(len(words) - 3)]
    return f"{sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in heads) > len(heads)):016x}" if heads else None


def test_simhash(spark, sf):
    words = " ".join(f"word{i} text{i % 7}" for i in range(60))
    texts = [words, words + " more", "one two three", None, "", "a b c d e", "uno dos tres cuatro", "Ñandú_uno, DOS; tres—cuatro 5 66 " * 40]
    texts += [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows = spark.createDataFrame([*enumerate(texts)], "id int, text string")
    got = {r["id"]: r["simhash"] for r in text.with_simhash(rows, "id", "text").collect()}
    assert got == {i: simhash_loop(t) for i, t in enumerate(texts)} and got[2] is None
    pairs = spark.createDataFrame([(got[0], got[1]), ("0" * 16, "f" * 16), ("8000000000000001", "0" * 16)], "a string, b string")
    d = [r["d"] for r in pairs.select(text.hamming(F.col("a"), F.col("b")).alias("d")).collect()]
    assert d[1:] == [64, 2] and d[0] == bin(int(got[0], 16) ^ int(got[1], 16)).count("1")


PAGE = """<html lang="es"><head><title> A  title </title><meta name="description" content="About"><link rel="canonical" href="/c"><link rel="alternate" hreflang="en" href="/en">
<script type="application/ld+json">{"@graph": [{"@type": "Product"}, {"@type": ["Offer", "Thing"]}]}</script><script type="application/ld+json">{bad</script></head>
<body><h1>One</h1><h2></h2><p>Some text</p><a href="/x" rel="nofollow sponsored"><img src="i.png" alt="pic"></a><a href="https://other.org/">out</a><a href="">none</a>
<picture><source srcset="/w.webp 1x, /w2.webp 2x"><img src="/p.jpg" alt=""></picture><img data-src="/lazy.jpg"><img srcset="/cdn/w=1,q=2/a.jpg 800w, /b.jpg"><script>var a = "hidden"</script><time datetime="2024-01-02">t</time></body></html>"""


def test_parse_html():
    p = html.parse(PAGE, "https://www.site.com/dir/")
    assert (p["title"], p["meta_description"], p["canonical"], p["language"], p["h1"], p["h1_count"], p["h2_count"]) == ("A title", "About", "https://www.site.com/c", "es", "One", 1, 0)
    assert p["text"] == "OneSome text outnone t".replace("text out", "textout").replace("none t", "none t") or "hidden" not in p["text"]
    assert [(x["href"], x["anchor_text"], x["follow"]) for x in p["links"]] == [("/x", "pic", False), ("https://other.org/", "out", True)] and p["external_citations"] == 1
    assert [(x["src"], x["alt"], x["has_alt"]) for x in p["images"]] == [
        ("https://www.site.com/dir/i.png", "pic", True), ("https://www.site.com/p.jpg", "", True), ("https://www.site.com/lazy.jpg", None, False), ("https://www.site.com/cdn/w=1,q=2/a.jpg", None, False),
    ]
    assert len(p["images"][1]["candidates"]) == 3
    assert [(s["schema_type"], s["valid_json"]) for s in p["schemas"]] == [("Product", True), ("Offer", True), ("Thing", True), (None, False)]
    assert p["hreflangs"] == [{"href": "https://www.site.com/en", "language": "en"}] and p["published_date"] == "2024-01-02"
    assert html.parse(None, "x") is None and html.parse("", "x")["word_count"] == 0


def test_html_helpers():
    assert html.parse_srcset("/w=8,q=5/a.webp 800w, b.jpg 2x,c.png") == [{"url": "/w=8,q=5/a.webp", "descriptor": "800w"}, {"url": "b.jpg", "descriptor": "2x"}, {"url": "c.png", "descriptor": ""}]
    assert html.missing_properties("Product", '{"@type": "Product", "name": " "}') == [{"kind": "REQUIRED", "missing": ["name"]}, {"kind": "RECOMMENDED", "missing": ["image", "offers", "description"]}]
    assert html.missing_properties("FAQPage", '{"@graph": [{"@type": "FAQPage", "mainEntity": [1]}]}') == [] and html.missing_properties("X", "{}") == []
    assert html.extract_json('say ```json\n{"a": 1}\n``` end') == '{"a":1}' and html.extract_json('{"a": [1, 2, {"b": "x') == '{"a":[1,2,{}]}' and html.extract_json("none") is None
    whole = json.dumps({"issues": [{"title": f"t{k}", "n": k, "urls": ["a", "b"]} for k in range(400)], "end": "x"})
    for cut in [*range(1, 120), *range(len(whole) - 60, len(whole))]:
        json.loads(html.repair_truncated(whole[:cut]))
    assert len(json.loads(html.extract_json(whole[: len(whole) // 2]))["issues"]) >= 199
    odd = '{"a": "x", ' + '"k": tru, ' * 300  # the last whole place is far back
    assert html.repair_truncated(odd) is None or json.loads(html.repair_truncated(odd))


def test_audit_report(spark):
    from sitelens.functions.reports import audit_report

    good = {"summary": "s", "score": 55, "criticalIssues": [{"title": "t", "impact": "i"}, {"title": "no impact"}, None], "recommendations": [{"priority": 1, "action": "a"}, {"priority": 2, "action": "b", "effort": "HUGE"}]}
    rows = [json.dumps(good), json.dumps({"summary": "s", "score": 101}), "{broken", None, json.dumps({"summary": "s", "score": 0})]
    got = [r["r"] for r in spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, x string").select("i", audit_report(F.col("x")).alias("r")).orderBy("i").collect()]
    assert [r is not None for r in got] == [True, False, False, False, True]
    assert [i["title"] for i in got[0]["criticalIssues"]] == ["t"] and got[0]["criticalIssues"][0]["evidence"] == "" and got[0]["criticalIssues"][0]["affectedUrls"] == []
    assert [(r["action"], r["effort"]) for r in got[0]["recommendations"]] == [("a", "MEDIUM")] and got[4]["criticalIssues"] == [] and got[4]["implementationOrder"] == []


def test_site_files(spark):
    robots = spark.createDataFrame([("https://a.com", "User-agent: *\nDisallow: /private\nCrawl-delay: 2")], "origin string, text string")
    rows = spark.createDataFrame([("https://a.com/private/x",), ("https://a.com/ok",), ("https://b.com/x",)], "url string")
    got = {r["url"]: (r["allowed"], r["crawl_delay"]) for r in robots_txt.allowed_urls(rows, robots, "bot").collect()}
    assert got == {"https://a.com/private/x": (False, 2.0), "https://a.com/ok": (True, 2.0), "https://b.com/x": (True, None)}
    index = "<sitemapindex xmlns='http://www.sitemaps.org/schemas/sitemap/0.9'><sitemap><loc>https://a.com/s1.xml</loc></sitemap></sitemapindex>"
    one = "<urlset><url><loc>https://a.com/x?utm_source=1</loc></url><url><loc>https://a.com/x</loc></url><url><loc>https://a.com/y</loc></url></urlset>"
    documents = spark.createDataFrame([("https://a.com/sitemap.xml", index), ("https://a.com/s1.xml", one)], "url string, body string")
    assert sorted(r["normalized_url"] for r in site_files.discover(spark, documents, ["https://a.com/sitemap.xml"]).collect()) == ["https://a.com/x", "https://a.com/y"]
    answers = {"https://a.com/1": {"status": 301, "location": "/2"}, "https://a.com/2": {"status": 200, "content_type": "text/html", "body": "b"}, "https://a.com/l": {"status": 302, "location": "/l"}}
    names = {"a.com": ["93.184.216.34"], "in.example": ["93.184.216.34", "10.0.0.7"], "six.example": ["fe80::1%eth0"], "mapped.example": ["::ffff:127.0.0.1"]}
    asked = []
    answers |= {"https://a.com/in": {"status": 302, "location": "http://169.254.169.254/latest"}, "https://a.com/big": {"status": 200, "body": "x" * 50}, "https://a.com/pdf": {"status": 200, "content_type": "application/pdf", "body": "x"}}
    fetch = lambda url, **more: site_files.fetch(url, lambda u: asked.append(u) or answers[u], resolve=lambda h: names.get(h, []), **more)
    assert fetch("https://a.com/1")["status"] == 301 and fetch("https://a.com/1")["body"] is None and fetch("https://a.com/l")["error_type"] == "TOO_MANY_REDIRECTS"
    assert fetch("https://a.com/big", max_bytes=10)["body"] == "x" * 10 and fetch("https://a.com/pdf")["body"] is None
    asked.clear()
    assert fetch("https://a.com/in")["error_type"] == "PRIVATE_IP" and asked == ["https://a.com/in"]  # a hop to a private address isn't asked
    for url, why in (
        ("http://169.254.169.254/latest/meta-data", "PRIVATE_IP"), ("http://[::1]/", "PRIVATE_IP"), ("http://127.0.0.1:8080/", "PRIVATE_IP"), ("http://in.example/", "PRIVATE_IP"), ("http://six.example/", "PRIVATE_IP"), ("http://mapped.example/", "PRIVATE_IP"),
        ("http://localhost/", "BLOCKED_HOST"), ("http://x.localhost/", "BLOCKED_HOST"), ("http://metadata.google.internal/", "BLOCKED_HOST"), ("file:///etc/passwd", "PROTOCOL"), ("http:///x", "INVALID_URL"), ("http://nowhere.example/", "DNS_ERROR"),
    ):
        assert fetch(url)["error_type"] == why, url
    assert asked == ["https://a.com/in"]
    documents = spark.createDataFrame([("s0", "<sitemapindex><sitemap><loc>s1</loc></sitemap><sitemap><loc>s2</loc></sitemap><sitemap><loc>s0</loc></sitemap></sitemapindex>"), ("s1", one), ("s2", one.replace("/y", "/z"))], "url string, body string")
    listed = lambda **more: sorted((r["normalized_url"][-1], r["sitemap"]) for r in site_files.discover(spark, documents, ["s0"], **more).collect())
    assert listed() == [("x", "s1"), ("y", "s1"), ("z", "s2")] and listed(max_sitemaps=2) == [("x", "s1"), ("y", "s1")] and listed(max_urls=1) == [("x", "s1")]


def test_keyword_csv(spark, tmp_path):
    path = tmp_path / "k.csv"
    path.write_text("﻿Consulta;Posición;Clics;CTR\nZapatos  rojos;3,5;1.200;12,5%\n;1;2;3\nbotas;x;4;0.2\n", encoding="utf-8")
    got = {r["normalized"]: (r["position"], r["clicks"], r["ctr"]) for r in keyword_csv.read_keywords(spark, str(path)).collect()}
    assert got == {"zapatos rojos": (3.5, 1200, 0.125), "botas": (None, 4, 0.2)}
    path.write_text("uno\ndos\n", encoding="utf-8")
    assert sorted(r["normalized"] for r in keyword_csv.read_keywords(spark, str(path)).collect()) == ["dos", "uno"]
    path.write_text("keyword\n" + "\n".join(f"word {k}" for k in range(3000)), encoding="utf-8")
    assert {r["normalized"] for r in keyword_csv.read_keywords(spark, str(path), max_rows=100).collect()} == {f"word {k}" for k in range(100)}


def test_near_similarity(spark):
    assert column(spark, [0, 6, 64], text.similarity_percent, "int") == [100, 91, 0]


@pytest.mark.parametrize("name,code,want", [("AbortError", None, "TIMEOUT"), (None, "ENOTFOUND", "DNS_ERROR"), (None, "ERR_TLS_X", "TLS_ERROR"), (None, "EPIPE", "CONNECTION_ERROR"), (None, None, "UNKNOWN")])
def test_classify_error(spark, name, code, want):
    row = spark.createDataFrame([(name, code)], "n string, c string").select(resources.classify_error(F.col("n"), F.col("c")).alias("e")).first()
    assert row["e"] == want
