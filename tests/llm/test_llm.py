"""Training-data operators against brute force, round trips and edge cases (nulls, empty and long texts, ties, repeats, clashing names)."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

WORDS = [a + b for a in ("th", "an", "er", "on", "re", "in") for b in ("ea", "ou", "st", "nd", "ly", "ing")]
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "s", "."]) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    """Texts with copies, near copies, nulls, empty and very long ones, repeated rows."""
    rng = random.Random(3)
    base = [prose(rng, rng.choice([1, 3, 8, 60, 200])) for _ in range(60)]
    texts = base + [base[k] for k in range(10)] + [t + " extra" for t in base[:20]] + [t.upper() for t in base[5:9]]
    texts += [None, "", " \n\t ", "word", "x" * 3000, prose(rng, 20_000), "naïve ñandú 你好 😀\n▁mark"]
    return [(i, t, "en", f"src{0 if i % 3 == 0 else i % 7}", None if t is None else len(t)) for i, t in enumerate(texts)]


def frame(spark, rows, schema=DOCS):
    return spark.createDataFrame(rows, schema)


def empty(spark, schema=DOCS):
    return spark.createDataFrame([], schema)


def words_of(text):
    return (text or "").encode().lower().split()


# 1


def test_lattice_sums_over_all_segmentations():
    import public_tokenizers

    from sitelens.llm.lattice_lm import Lattice

    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        lattice = Lattice(f.read(), {300: 5, 264: 2})

    def brute(s):
        if not s:
            return 1.0
        total = 0.0
        for k in range(1, len(s) + 1):
            p = lattice.scores.get(s[:k])
            if p is not None:
                total += math.exp(p) * brute(s[k:])
        if lattice.scores.get(s[0]) is None:
            total += math.exp(sum(lattice.bytes[b] for b in s[0].encode())) * brute(s[1:])
        return total

    for word in ("the", "another", "thx,", "\n", "a😀b", "ñandú"):
        assert lattice.log_probability(word) == pytest.approx(math.log(brute("▁" + word)), rel=1e-9)
    assert lattice.log_probability("x" * 5000) < -1000


def test_language_model(spark, corpus):
    import public_tokenizers

    from sitelens.llm import lattice_lm as lm

    path = public_tokenizers.path("piece_bpe_32k.model")
    rows = {r["doc_id"]: r for r in lm.score_documents(frame(spark, [*corpus, corpus[0]]), path).collect()}
    counts = Counter()
    every = [*corpus, corpus[0]]
    for i, t, *_ in every:
        if zlib.crc32(str(i).encode()) % 7 != 2:
            counts.update([*words_of(t), " "])
    n, v = sum(counts.values()), len(counts)
    for i, t, *_ in corpus:
        tokens = [*words_of(t), " "]
        assert rows[i]["n_tokens"] == len(tokens) and rows[i]["train_tokens"] == n
        assert rows[i]["n_known"] == sum(w in counts for w in tokens)
        assert rows[i]["held_out"] == (zlib.crc32(str(i).encode()) % 7 == 2)
        assert rows[i]["base_score"] == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens), rel=1e-9)
        assert math.isfinite(rows[i]["score"]) and rows[i]["score"] < 0 and math.isfinite(rows[i]["lattice_score"])
    # The head's size doesn't change the scores.
    docs = frame(spark, corpus).select("doc_id", "text").withColumn("held", F.col("doc_id") % 7 == 2)
    model = open(path, "rb").read()
    a, b = (sorted(lm.Model(docs, "text", "held", model, head=h).score(docs, "doc_id", "text", "held").collect()) for h in (5, 100_000))
    for c in ("score", "lattice_score", "rest_score"):
        assert [r[c] for r in a] == pytest.approx([r[c] for r in b], rel=1e-9)
    assert lm.score_documents(empty(spark), path).count() == 0
    clash = frame(spark, corpus).withColumns({c: F.lit("clash") for c in ("id", "held", "__held", "score", "word", "own")})
    assert lm.score_documents(clash, path).columns == lm.score_documents(frame(spark, corpus), path).columns


@pytest.mark.parametrize("head", [1, 1000])
def test_language_model_sums_over_all_paths(spark, head):
    """score, lattice_score and rest_score are sums over every path of a document's lattice: cuts into pieces, the word's arc, arcs of earlier occurrences."""
    import itertools

    import public_tokenizers

    from sitelens.llm import lattice_lm as lm

    model = open(public_tokenizers.path("piece_bpe_32k.model"), "rb").read()
    texts = ["ab to ab", "to be to", "the ab the ab the", "be bé", "", None, "ab to ab"]
    rows = [(i, t, i == 3) for i, t in enumerate(texts)]
    docs = frame(spark, rows, "doc_id long, text string, held boolean")
    m = lm.Model(docs, "text", "held", model, head=head)
    got = {r["doc_id"]: r for r in m.score(docs, "doc_id", "text", "held").collect()}
    counts = Counter(w.decode() for _, t, held in rows if not held for w in words_of(t))
    lattice = lm.Lattice(model, lm.piece_counts(m.counts, model))
    words = sum(counts.values())

    def cuts(s):
        if not s:
            yield 1.0
        for k in range(1, len(s) + 1):
            p = lattice.scores.get(s[:k])
            if p is not None:
                yield from (math.exp(p) * q for q in cuts(s[k:]))
        if s and lattice.scores.get(s[0]) is None:
            yield from (math.exp(sum(lattice.bytes[b] for b in s[0].encode())) * q for q in cuts(s[1:]))

    for i, t, held in rows:
        tokens = [w.decode() for w in words_of(t)]
        own = Counter() if held else Counter(tokens)
        end = m.end * (1 - m.end) ** len(tokens)
        a = m.concentration
        arcs, plain, others = [], [], []
        for k, w in enumerate(tokens):
            paths = [m.rest * p for p in cuts("▁" + w)]
            whole = [max(counts[w] - m.discount, 0) / words] if counts[w] else []
            arcs.append([*(a * p / (a + k) for p in whole + paths), *[1 / (a + k)] * tokens[:k].count(w)])
            plain.append([*cuts("▁" + w)])
            others.append([max(counts[w] - own[w] - m.discount, 0) / max(words - sum(own.values()), 1), *paths])
        for name, per_word in (("score", arcs), ("lattice_score", plain), ("rest_score", others)):
            total = sum(math.prod(path) for path in itertools.product(*per_word))
            assert got[i][name] == pytest.approx(math.log10(end * total), rel=1e-9), (name, t)


# 2


def test_piece_codec(spark, corpus):
    import public_tokenizers
    import sentencepiece

    from sitelens.llm import piece_codec

    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    docs = frame(spark, corpus).withColumn("ids", F.lit("clash")).withColumn("n_tokens", F.lit(1))
    for r in piece_codec.decode(piece_codec.encode(docs, path, keep=["doc_id"], digests=True), path, into="decoded").collect():
        want = library.encode(corpus[r["doc_id"]][1] or "")
        assert list(r["ids"]) == want and r["n_tokens"] == len(want)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
        assert r["decoded"] == library.decode(want) and r["decoded_sha256"] == hashlib.sha256(library.decode(want).encode()).hexdigest()
    assert "ids" in piece_codec.encode(docs, path).columns
    assert piece_codec.encode(empty(spark), path).count() == 0
    model = piece_codec.PieceModel(open(path, "rb").read())
    rng = random.Random(5)
    texts = ["".join(rng.choice("abcdethe  \n\t.▁é😀ñ你<0x>s/") for _ in range(rng.choice([0, 1, 2, 5, 30, 200]))) for _ in range(300)] + ["the" * 600, " " * 700, "<s> </s>"]
    for t, ids in zip(texts, model.encode_texts(texts)[0], strict=True):
        assert [int(i) for i in ids.split(",") if i] == library.encode(t)


@pytest.mark.parametrize("long", [512, 24, 1])
def test_piece_codec_long_words(monkeypatch, long):
    """Words that merge by stretches: blobs, runs of one character, scripts without spaces."""
    import public_tokenizers
    import sentencepiece

    from sitelens.llm import piece_codec

    monkeypatch.setattr(piece_codec, "LONG", long)
    path = public_tokenizers.path("piece_bpe_32k.model")
    library, model = sentencepiece.SentencePieceProcessor(model_file=path), piece_codec.PieceModel(open(path, "rb").read())
    rng = random.Random(long)
    parts = ["a", "aa", "ab", "b", "=", "==", "the", "ing", "tion", "er", "e", "你", "é", "0", "12", *WORDS]
    texts = ["".join(rng.choice(parts) * rng.choice([1, 1, 1, 2, 9]) for _ in range(rng.choice([10, 300, 900]))) for _ in range(60)]
    texts += ["x" * 100_001, "=-" * 3000, "".join(rng.choice("abcdefgh") for _ in range(60_000)), texts[1] + " " + texts[2]]
    texts += [" " * n for n in (*range(1, 700, 1 if long > 8 else 3), 4097, 30_000)] + ["a" + " " * 600 + "b", "x\n" + " " * 700 + "y", "\n" * 4000, " \t" * 900, "=" * 5000 + " " * 5000 + "-" * 777]
    texts += ["".join(rng.choice([" ", "  ", "    ", "▁", "=", "a"]) * rng.choice([1, 1, 9]) for _ in range(600)) for _ in range(20)]
    for t, ids in zip(texts, model.encode_texts(texts)[0], strict=True):
        assert [int(i) for i in ids.split(",") if i] == library.encode(t)


# 3


def test_html(spark):
    from sitelens.llm.html_text import extract, main_text

    page = "<html><head><title>t</title><style>p{{}}</style></head><body><nav><a href=x>Menu</a></nav>{}<footer>&copy; us</footer>"
    assert main_text(page.format("<div class='ad'>Buy now " + "x " * 60 + "</div><article><h1>Head &amp; line</h1><p>" + "text  " * 50 + "<br>more<p>Ok.</article>")) == "Head & line " + "text " * 50 + "more Ok."
    body = "<div id='main'><h1>A</h1><p>" + "b c " * 60 + "</p><p>D.</p></div><div class='sidebar'>" + "side " * 80 + "</div><section id=comments><p>" + "bad " * 80 + "</p></section>"
    assert main_text(page.format(body)) == "A " + "b c " * 60 + "D."
    assert main_text("<script>var t='</p>';x<1</script>") == "" and main_text("plain") == "plain" and main_text(None) == "" and main_text("<p>cut <b") .startswith("cut")
    rows = [(1, "u", page.format("<article><p>é 你</p></article>"), "x"), (2, None, None, "x"), (2, None, None, "x"), (3, "v", "", None)]
    out = extract(frame(spark, rows, "page_id long, url string, html string, n_chars string")).collect()
    assert sorted((r["page_id"], r["text"], r["n_chars"]) for r in out) == [(1, "é 你", 3), (2, "", 0), (2, "", 0), (3, "", 0)]
    assert extract(empty(spark, "page_id long, url string, html string")).count() == 0


def test_html_ratios_decide(monkeypatch):
    """Content follows from ratio, smoothing and clustering: a plain loop finds the same lines; no name picks the region, and where
    no name vetoes, pages give another text without the ratios."""
    from sitelens.llm import html_text as h

    rng = random.Random(4)
    changed = same = 0
    for k in range(90):
        paragraphs = [f"<p>{prose(rng, rng.choice([15, 60, 120]))}</p>" for _ in range(rng.randint(3, 9))]
        share = "<div><ul>" + "".join(f"<li><a href=x>{prose(rng, 2)}</a></li>" for _ in range(rng.randint(6, 12))) + "</ul></div>"
        paragraphs.insert(rng.randrange(len(paragraphs) + 1), share)
        menu = "".join(f"<div><i>Item</i><b>{j}</b></div>" for j in range(9)) if k % 3 else "<nav>" + "<a href=x>Menu</a><br>" * 4 + "</nav>"
        body = menu + "<section>{}</section>".format("".join(paragraphs)) + ("" if k % 3 else "<footer>Us</footer>")
        page = f"<body>{body}"
        parser = h.LineParser()
        parser.feed(page)
        parser.close()
        lines = parser.lines
        ratio = [plain / tags for _, tags, _, _, plain in lines]
        smooth = []
        for i in range(len(ratio)):
            near = [(math.exp(-0.5 * ((i - j) / h.SIGMA) ** 2), ratio[j]) for j in range(len(ratio)) if abs(i - j) <= math.ceil(3 * h.SIGMA)]
            smooth.append(sum(k * r for k, r in near) / sum(k for k, _ in near))
        x = [math.log1p(r) for r in smooth]
        low, high = min(x), max(x)
        for _ in range(30):
            below, above = [v for v in x if v <= (low + high) / 2], [v for v in x if v > (low + high) / 2]
            low, high = sum(below) / len(below), sum(above) / len(above)
        want = [v >= (low + high) / 2 and r > 0 for v, r in zip(x, ratio, strict=True)]
        assert h.is_content(np.array([float(n) for *_, n in lines]), np.array([float(t) for _, t, *_ in lines])).tolist() == want
        text = h.main_text(page)
        with monkeypatch.context() as m:
            m.setattr(h, "is_content", lambda plain, tags: np.ones(len(plain), dtype=bool))
            changed += h.main_text(page) != text
        words = set(text.split())
        links = {w for t, *_, n in lines if n == 0 for w in t.split()}
        assert "Menu" not in words and "Us" not in words and "0" not in words and "1" not in words
        assert words >= {w for t, *_, out, n in lines if n > 40 and not out for w in t.split()} - links
        same += h.main_text(page.replace("section", "article")) == text == h.main_text(page.replace("section", "main"))
    assert changed >= 60 and same == 90


def test_html_edges(spark):
    from sitelens.llm.html_text import extract, main_text

    halves = "<main>" + "".join(f"<section><p>{'word ' * n}</p></section>" for n in (75, 25)) + "</main>"
    assert len(main_text(halves).split()) == 100
    two = "<body><div><a href=x>Menu</a></div><article><p>" + "one " * 50 + "</p></article><article><p>" + "two " * 50 + "</p><p>End.</p></article>"
    assert main_text(two) == ("one " * 50 + "two " * 50 + "End.")
    kept = "<article><h2><a href=x>Title</a></h2><p>" + "text " * 90 + "</p><ul><li>salt</li><li>oil</li></ul><div><p><a href=x>More</a></p><p><a href=x>Tags</a></p><p><a href=x>Share</a></p><p><a href=x>Next</a></p><p><a href=x>Print</a></p></div></article>"
    assert main_text(kept) in {"Title " + "text " * 90 + "salt oil" + tail for tail in ("", " More Tags Share Next Print")}
    long = "<article>" + "<p>" + "lang " * 40_000 + "</p>" * 1 + "<p>tail.</p>" * 3000 + "</article>"
    assert len(main_text(long).split()) == 43_000
    rows = [(1, "u", long, 7)] * 2
    out = extract(frame(spark, rows, "page_id long, url string, html string, text int")).collect()
    assert [r["n_chars"] for r in out] == [len(main_text(long))] * 2


# 4


def test_quality(spark, corpus):
    from sitelens.llm import quality

    rng = random.Random(9)
    rows, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        text = prose(rng, 80)
        if bad:
            text = [text.upper().replace(" ", "!! "), text.replace(" ", "$$$ "), text.replace(" ", " | "), " ".join([WORDS[i % 30]] * 80)][i // 4 % 4]
        rows.append((i, text, "en", "s", len(text)))
        labels.append((i, int(not bad), 0))
    docs, marks = frame(spark, rows), frame(spark, [*labels, (1, None, 0), (None, 1, 0), (2, 7, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, marks)
    got = quality.scored(docs.withColumn("score", F.lit("clash")), model).collect()
    right = [(r["__score"] >= quality.THRESHOLD) == (r["doc_id"] % 4 != 0) for r in got if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert len(right) > 50 and sum(right) / len(right) > 0.97
    x = np.array([quality.statistics_of(np.array([0, len(t.encode())]), np.frombuffer(t.encode(), np.uint8))[0] for _, t, *_ in rows])
    assert sorted(r["__score"] for r in got) == pytest.approx(sorted(model.predict(x)), abs=1e-9)
    odd = quality.scored(frame(spark, corpus), model).collect()
    assert len(odd) == len(corpus) and all(0 <= r["__score"] <= 1 for r in odd)
    names = ("words", "__words", "upper", "label")
    clash = quality.scored(frame(spark, corpus).withColumns({c: F.lit(c) for c in (*names, "__score")}), model).collect()
    assert all(r[c] == c for r in clash for c in names) and sorted(r["__score"] for r in clash) == sorted(r["__score"] for r in odd)
    # Repeated ids don't push labelled rows out of the sample.
    many = docs.union(docs).union(docs).union(docs).union(docs.withColumn("text", F.lit("other")))
    assert quality.fit(many, marks, sample_rows=100).rules == quality.fit(docs.union(docs.withColumn("text", F.lit("other"))), marks, sample_rows=100).rules
    assert quality.scored(empty(spark), quality.fit(empty(spark), empty(spark, "doc_id long, quality int, toxic int"))).count() == 0


# 5


def brute_components(pairs, ids):
    above = {i: i for i in ids}

    def root(v):
        while above[v] != v:
            v = above[v]
        return v

    for a, b in pairs:
        a, b = root(a), root(b)
        if a != b:
            above[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def shingle_set(text, k):
    w = words_of(text)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())


@pytest.mark.parametrize("k", [4, 5])
def test_minhash(spark, corpus, k, monkeypatch):
    from sitelens.llm import minhash_dedup

    rng = random.Random(8)
    rows = [*corpus]
    base = prose(rng, 120).split()
    for _ in range(60):  # a large group of near copies, of many similarities
        w = [*base]
        for _ in range(rng.randint(0, 12)):
            w[rng.randrange(len(w))] = rng.choice(WORDS) + "x"
        rows.append((len(rows), " ".join(w), "en", "s", 0))
    sets = {i: shingle_set(t, k) for i, t, *_ in rows}
    pairs = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = brute_components(pairs, sets)
    docs = frame(spark, rows).withColumn("rep", F.lit(1)).withColumn("path", F.lit("clash"))
    for leaf, block in ((4096, 1024), (8, 16)):  # small limits: branching and pairs of blocks
        monkeypatch.setattr(minhash_dedup, "LEAF", leaf)
        monkeypatch.setattr(minhash_dedup, "BLOCK", block)
        got = {r["doc_id"]: r for r in minhash_dedup.near_duplicates(docs, shingle=k).collect()}
        assert {i: r["component_id"] for i, r in got.items()} == want
        assert all(r["n_shingles"] == len(sets[i]) and r["kept"] == (want[i] == i) for i, r in got.items())
    assert minhash_dedup.near_duplicates(empty(spark)).count() == 0
    alone = minhash_dedup.near_duplicates(frame(spark, [(None, "a b c d e", None, None, None), (None, "a b c d e", None, None, None), (4, "z", None, None, None)])).collect()
    assert sorted((r["doc_id"] or -1, r["kept"]) for r in alone) == [(-1, True), (-1, True), (4, True)]


def test_minhash_pairs_in_branched_nodes():
    import pyarrow as pa

    from sitelens.llm import minhash_dedup as m

    rng, n = np.random.default_rng(1), 5000
    a = rng.integers(0, 2**31, (n, m.PLACES), dtype=np.uint32)
    b = np.where(rng.random(a.shape) < m.THRESHOLD / 100, a, a + np.uint32(1))

    def grown(step, *columns):
        out = [*step(iter([pa.RecordBatch.from_arrays([*map(pa.array, columns)], names=[*"abc"[: len(columns)]])]))]
        return (np.concatenate([x.column(c).to_numpy() for x in out]) for c in ("path", "rep"))

    def sigs(x):
        return [r.tobytes() for r in x]

    (path, rep), (other, _) = (grown(m._roots, np.arange(n), sigs(x)) for x in (a, b))
    for _ in range(m.DEPTH):  # a pair stays a candidate while it has a path in common
        path, rep = path[path == other], rep[path == other]
        (path, rep), (other, _) = (grown(m._children, path, rep, sigs(x[rep])) for x in (a, b))
    assert n - len(np.unique(rep[path == other])) <= 3


# 6 and 7

VECTORS = "vec_id long, embedding array<float>, label int"


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(4)
    x = rng.standard_normal((300, 16))
    x[100:160] = x[:1] + 0.2 * rng.standard_normal((60, 16))
    x[160:170] = x[5]
    rows = [(i, [float(v) for v in r], 0) for i, r in enumerate(x.astype(np.float32))]
    return rows + [(300, None, 0), (301, [], 0), (302, [0.0] * 16, 0), (303, [float("nan")] * 16, 0), (304, [1.0, None] * 8, 0), (305, [float("inf")] * 16, 0), (306, [1.0, 2.0], 0)]


def test_embeddings(spark, vectors, monkeypatch):
    from sitelens.llm import embedding_dedup

    good = {i: np.array(v, dtype=np.float64) for i, v, _ in vectors[:300]}
    x = np.stack([v / np.linalg.norm(v) for v in good.values()])
    close = x @ x.T >= 0.9
    want = brute_components([(a, b) for a, b in zip(*np.nonzero(close), strict=True) if a < b], [i for i, *_ in vectors])
    monkeypatch.setattr(embedding_dedup, "RECALL", 0.9999)
    for block in (256, 16):
        monkeypatch.setattr(embedding_dedup, "BLOCK", block)
        found = {r["vec_id"]: r for r in embedding_dedup.dedup(frame(spark, vectors, VECTORS).withColumn("rep", F.lit(0))).collect()}
        assert len(found) == len(vectors)
        for i, *_ in vectors:
            assert found[i]["n_links"] == (close[i].sum() - 1 if i < 300 else 0), i
            assert found[i]["component_id"] == want[i] and found[i]["kept"] == (want[i] == i)
    assert embedding_dedup.dedup(empty(spark, VECTORS)).count() == 0


def test_embeddings_of_any_magnitude(spark):
    """Components near the ends of the range of doubles: squares over- and underflow, cosines mustn't."""
    from sitelens.llm import embedding_dedup

    a, b, c = np.array([1.0, 0, 0, 0]), np.array([0.8, 0.6, 0, 0]), np.array([1.0, 0.05, 0, 0])
    rows = [(10 * k + j, (v * size).tolist(), 0) for k, size in enumerate((1e-200, 1e200, 1.0, 1e-310, 1e308)) for j, v in enumerate((a, b, c))]
    found = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup.dedup(frame(spark, rows, VECTORS.replace("float", "double"))).collect()}
    alike = [i for i, *_ in rows if i % 10 != 1]  # cosine over 0.9 at every magnitude; the others are 0.8 from a, 0.83 from c
    assert found == {i: (9, 0) if i in alike else (4, 1) for i, *_ in rows}


def brute_nearest(data, q, k=10):
    return sorted((float(np.sqrt(((data[q] - v) ** 2).sum())), i) for i, v in data.items() if i != q and len(v) == len(data[q]))[:k]


def test_neighbours(spark, vectors):
    from sitelens.llm import permutation_index as index

    rows = frame(spark, [*vectors, (400, [2.0, 2.0], 0)], VECTORS)
    out = index.nearest(rows, rows.where("vec_id % 100 = 0"), share=1.0).collect()
    data = {i: np.array(v, dtype=np.float64) for i, v, _ in vectors[:300]} | {306: np.array([1.0, 2.0]), 400: np.array([2.0, 2.0])}
    for q in (0, 100, 200, 400):  # vectors of another length are an index of their own
        best, mine = brute_nearest(data, q), sorted((r["rank"], r["vec_id"], r["score"]) for r in out if r["query_id"] == q)
        assert [m[1] for m in mine] == [i for _, i in best] and [m[2] for m in mine] == pytest.approx([d for d, _ in best])
    assert {r["query_id"] for r in out} == {0, 100, 200, 400}
    assert index.nearest(empty(spark, VECTORS), empty(spark, VECTORS)).count() == 0
    assert index.nearest(rows, empty(spark, VECTORS)).count() == 0
    # Ties go to the smaller id; a repeated query is one query; two vectors of one id are two; clashing names don't matter.
    ties = [(i, [float(i % 3), 1.0], 0) for i in range(20)] + [(0, [0.0, 1.0], 0), (100, [9.0, 9.0], 0), (100, [0.0, 1.0], 0)]
    rows = frame(spark, ties, VECTORS).withColumn("h", F.lit("clash")).withColumn("chunk", F.lit(1))
    out = index.nearest(rows, rows.where("vec_id % 100 = 0"), k=4, share=1.0).collect()
    assert sorted((r["rank"], r["vec_id"]) for r in out if r["query_id"] == 0) == [(1, 3), (2, 6), (3, 9), (4, 12)]
    assert sorted((r["rank"], r["vec_id"]) for r in out if r["query_id"] == 100) == [(1, 0), (1, 2), (2, 0), (2, 5), (3, 3), (3, 8), (4, 6), (4, 11)]


def test_neighbours_recall(spark):
    """Random directions, the hardest case: twelve per cent of each chunk is reranked, in five chunks and in one."""
    from sitelens.llm import permutation_index as index

    x = np.random.default_rng(6).standard_normal((20_000, 64))
    x = (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32)
    for n in (20_000, 2000):
        rows = spark.createDataFrame([(i, v, 0) for i, v in enumerate(x[:n].tolist())], VECTORS)
        got = defaultdict(set)
        for r in index.nearest(rows, rows.where("vec_id % 400 = 0")).collect():
            got[r["query_id"]].add(r["vec_id"])
        y, hits = x[:n].astype(np.float64), 0
        for q in range(0, n, 400):
            d = ((y - y[q]) ** 2).sum(axis=1)
            d[q] = np.inf
            hits += len(got[q] & set(np.argsort(d)[:10].tolist()))
        assert hits / (10 * len(got)) >= 0.9 and index.SHARE < 0.5


# 8


def test_mixing(spark):
    from sitelens.llm import mixing

    sizes = {"a": 700, "b": 300, "c": 90, None: 20}
    rows, units = [(i, s) for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))], {"a": 5, "b": 3, "c": 1, "": 1}
    docs = frame(spark, rows, "doc_id long, source string").withColumn("slot", F.lit("clash")).withColumn("units", F.lit(0))
    out = mixing.schedule(docs, units, block_rows=4).collect()
    assert sorted(r["doc_id"] for r in out) == [i for i, _ in rows]
    slots, total = defaultdict(set), sum(units.values())
    for r in out:
        slots[r["source"] or ""].add(r["__slot"])
    assert len({r["__position"] for r in out}) == len(out) and len({t for s in slots.values() for t in s}) == sum(map(len, slots.values()))
    for s, a in units.items():
        last = max(slots[s])
        for t in range(last):
            assert abs(sum(x <= t for x in slots[s]) - (t + 1) * a / total) < 1
    assert mixing.schedule(docs).count() == len(rows) and mixing.schedule(empty(spark, "doc_id long, source string")).count() == 0
    twice = mixing.schedule(frame(spark, [(1, "a"), (1, "a"), (None, "a")], "doc_id long, source string")).collect()
    assert sorted(r["__position"] for r in twice) == [0, 1, 2]
    clash = docs.withColumns({c: F.lit(c) for c in ("__source", "__hash", "__bucket", "__slot", "hash", "row", "of", "turn", "key")})
    out = mixing.schedule(clash, {"a": 10, "b": 0}).collect()
    assert all(r["__source"] == "__source" and r["hash"] == "hash" and r["key"] == "key" and r["units"] == 0 for r in out)
    assert all((r["__position"] is None) == (r["__slot"] is None) == (r["__block"] is None) == (r["source"] == "b") for r in out) and len(out) == len(rows)
    with pytest.raises(ValueError, match="negative"):
        mixing.schedule(docs, {"a": -1})


def brute_schedule(units):
    """Slot of each (source, turn): earliest deadline first, slot by slot."""
    order = sorted(units, key=lambda s: (-units[s], hashlib.md5(s.encode()).hexdigest(), s))
    total, turn, out = sum(units.values()), dict.fromkeys(units, 0), {}
    for t in range(total):
        i = min((-(-(turn[s] + 1) * total // units[s]), k) for k, s in enumerate(order) if turn[s] < units[s] and turn[s] * total // units[s] <= t)[1]
        out[order[i], turn[order[i]]] = t
        turn[order[i]] += 1
    return out


def test_mixing_schedule(spark):
    from sitelens.llm import mixing

    rng = random.Random(1)
    for n in (1, 3, 40):
        units = {f"s{i}": rng.choice([1, 1, 1, 2, 3, 3, 7, 20, 50]) for i in range(n)}
        got = mixing.period(frame(spark, [*units.items()], "source string, units long")).collect()
        assert {(r["source"], r["turn"]): r["in_period"] for r in got} == brute_schedule(units)


def test_mixing_many_sources(spark):
    from sitelens.llm import mixing

    docs = spark.range(100_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("site "), F.col("id").cast("string")).alias("source"))
    out = mixing.schedule(docs).agg(F.count("*").alias("n"), F.count_distinct("__slot").alias("slots"), F.max("__slot").alias("last")).first()
    assert (out["n"], out["slots"], out["last"]) == (100_000, 100_000, 99_999)


def test_mixing_small_sources_keep_targets(spark):
    """One large source beside thousands of single rows: each has its share of the slots, and no block is a whole slot off."""
    from sitelens.llm import mixing

    sizes = {"large": 10_000, **{f"one {i}": 1 for i in range(4000)}, **{f"nine {i}": 9 for i in range(50)}}
    docs = spark.createDataFrame([*sizes.items()], "source string, n int").select("source", F.explode(F.sequence(F.lit(1), "n")).alias("k")).select(F.concat("source", F.lit(" "), "k").alias("doc_id"), "source")
    total = sum(n**0.5 for n in sizes.values())
    units = {r["source"]: r["units"] for r in mixing.smoothed_units(spark.createDataFrame([*sizes.items()], "source string, n long")).collect()}
    assert units == {s: round(n**0.5) for s, n in sizes.items()}
    placed = mixing.schedule(docs, block_rows=1).where("source = 'large'").select("__block", "__slot").collect()
    weight = 100 / total
    assert len(placed) == 10_000
    for r in placed:
        assert (r["__block"] / weight) - 1 < r["__slot"] < (r["__block"] + 1) / weight


# 9


def test_licenses(spark, corpus):
    from sitelens.llm import license_scan as ls

    mit = ls.TEMPLATES["MIT"][2]
    noisy = " ".join(w for k, w in enumerate(mit.split()) if k not in (20, 50)).upper()
    rows = [(0, "head words here " + mit + " tail"), (1, noisy), (2, "Licensed under CC BY-NC 4.0."), (3, "licensed under\n * the apache license version 2.0"), (4, " ".join(mit.split()[:40])), (5, None), (6, ""), (7, prose(random.Random(1), 5000) + " Released under the MIT License. " + prose(random.Random(2), 3000))]
    got = defaultdict(set)
    for r in ls.scan(frame(spark, rows, "doc_id long, text string").withColumn("license", F.lit("clash"))).collect():
        got[r["doc_id"]].add(r["license"])
    assert got == {0: {"MIT"}, 1: {"MIT"}, 2: {"CC-BY-NC-4.0"}, 3: {"Apache-2.0"}, 7: {"MIT"}}
    assert ls.scan(frame(spark, corpus)).count() == 0 and ls.scan(empty(spark)).count() == 0
    assert 1 - (1 - (ls.CONTAINMENT - 1 / 16) / (2 - ls.CONTAINMENT + 1 / 16)) ** ls.bands_needed() >= ls.COLLISION


def test_every_license_template_is_found(spark):
    """Against brute force: each notice in prose, whole, and with a word in twenty changed; no other license but such that hold its text."""
    from sitelens.llm import license_scan as ls

    rng, rows, want = random.Random(12), [], {}
    known = [(name, t) for name, texts in ls.TEMPLATES.items() for t in texts]
    cut = lambda t: re.findall(r"[a-z0-9\x80-\uffff]+", t.lower())
    shingled = lambda t: {tuple(w[k : k + 5]) for w in [cut(t)] for k in range(len(w) - 4)}
    sets = [(name, shingled(t)) for name, t in known]
    for k, (name, t) in enumerate(known):
        for changed in (False, True):
            words = t.split()
            if changed and len(words) > 40:
                words[rng.randrange(len(words))] = "changed"
            text = prose(rng, 300) + ". " + " ".join(words) + " . " + prose(rng, 300)
            rows.append((len(rows), text))
            own = shingled(text)
            want[rows[-1][0]] = (name, {n for n, s in sets if len(s & own) >= ls.CONTAINMENT * len(s)})
    found = defaultdict(set)
    for r in ls.scan(frame(spark, rows, "doc_id long, text string")).collect():
        found[r["doc_id"]].add(r["license"])
    for i, (name, allowed) in want.items():  # of overlapping matches the best one stays
        assert name in allowed and found[i] and found[i] <= allowed, (name, found[i], allowed)
        assert name in found[i] or len(allowed) > 1


def test_license_bands_cover_spread_matches():
    from sitelens.llm import license_scan as ls

    held = ls.CONTAINMENT / 1.5  # what a window holds of a match spread over 1.5 template lengths
    assert (1 - held / (2 - held)) ** ls.bands_needed() <= 1 - ls.COLLISION


# 10


def test_lines(spark):
    from sitelens.llm.line_dedup import dedup_lines

    common, rare = "this line is on every site", "this line is on two sites"
    rows = [(i, f"own line number {i} of text\n{common}\n" + (rare if i < 2 else f"tail {i} of its own page\n\n"), "en", f"s{i}", 0) for i in range(12)]
    rows += [(20, None, "en", "s1", 0), (21, "", "en", None, 0), (22, common, "en", "s2", 0), (23, common + "\n" + common, "en", None, 0), (2, *rows[2][1:])]
    for sites in (3, 8):  # near the threshold, and well beyond it
        out = sorted((r["doc_id"], r["text"], r["__n_removed"]) for r in dedup_lines(frame(spark, rows).withColumn("line", F.lit(1)).withColumn("id", F.lit("clash")), min_sites=sites, counts=True).where("text is not null").collect())
        want = sorted((i, t if i == 0 else "\n".join(x for x in t.split("\n") if x != common), 0 if i == 0 else t.split("\n").count(common)) for i, t, *_ in rows if t is not None)
        assert out == want
    assert dedup_lines(empty(spark)).count() == 0
    names = ("gone", "__gone", "_id", "__id", "th", "__th", "line", "site", "h1", "first", "__n_lines")
    clash = frame(spark, rows).withColumns({c: F.lit(c) for c in names})
    for r in dedup_lines(clash, min_sites=3).collect():
        assert all(r[c] == c for c in names)
    out = dedup_lines(clash, min_sites=3, counts=True)
    assert out.columns.count("__n_lines") == 1 and all(isinstance(r["__n_lines"], int) and r["th"] == "th" for r in out.collect())
    short = [(i, f"Les.\nown {i}", "en", f"s{i}", 0) for i in range(3)]  # lines of one word count too
    assert sorted(r["text"] for r in dedup_lines(frame(spark, short)).collect()) == ["Les.\nown 0", "own 1", "own 2"]


def test_documents_of_many_lines(spark):
    """Tens of thousands of repeated lines in one document take time in proportion."""
    import time

    from sitelens.llm.line_dedup import dedup_lines

    def rows(n):
        return [(i, f"own {i}\n" + "the same line\n" * n + f"end {i}", "en", f"s{i}", 0) for i in range(4)]

    seconds = []
    for n in (1000, 60_000):
        began = time.time()
        out = {r["doc_id"]: (r["text"], r["__n_removed"]) for r in dedup_lines(frame(spark, rows(n)), counts=True).collect()}
        seconds.append(time.time() - began)
        assert out == {i: (f"own {i}\n" + "the same line\n" * (i == 0) + f"end {i}", n - (i == 0)) for i in range(4)}
    assert seconds[1] < seconds[0] + 20


@pytest.mark.parametrize("name", ["op8_mixing", "op10_line_dedup"])
def test_sql(spark, sf, name):
    import duckdb

    from sitelens.llm.queries import ORACLE_SQL, QUERIES

    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    got, want = QUERIES[name](spark, sf), con.execute(ORACLE_SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(c[0] for c in want.description)
    mine = sorted((tuple(r[c] for c in columns) for r in got.collect()), key=repr)
    names = [c[0] for c in want.description]
    assert mine == sorted((tuple(dict(zip(names, r, strict=True))[c] for c in columns) for r in want.fetchall()), key=repr)


def test_pipeline_removes_short_lines(spark, sf):
    import corpus_pipeline

    rows = [(i, f"own line {i}\nLes.\n\nAll rights reserved.\n\n{'on two' if i < 2 else i}", "en", f"s{i}", 0) for i in range(6)]
    out = {r["doc_id"]: (r["text"], r["n_chars"]) for r in corpus_pipeline.line_dedup(spark, frame(spark, rows), sf).collect()}
    want = {i: t if i == 0 else "\n".join(x for x in t.split("\n") if x not in ("Les.", "All rights reserved.")) for i, t, *_ in rows}
    assert out == {i: (t, len(t)) for i, t in want.items()}


# Pipeline


def test_pipeline(spark, sf):
    import corpus_pipeline

    from sitelens.llm.common import DOCUMENT_COLUMNS, cut, table

    docs, seen = table(spark, sf, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        docs = cut(stage(spark, docs, sf), name)
        seen.append((name, docs.count(), docs.columns))
    assert [s[0] for s in seen] == ["quality", "line_dedup", "near_dedup", "mixing", "tokenise"]
    assert all(c == DOCUMENT_COLUMNS for *_, c in seen[:4]) and seen[1][1] == seen[0][1] and seen[2][1] == seen[3][1] == seen[4][1]
    bad = {r["doc_id"] for r in table(spark, sf, "labels").where("quality = 0").collect()}
    assert len(bad & {r["doc_id"] for r in docs.collect()}) <= len(bad) * 0.2


def test_pipeline_rows(spark, sf):
    import corpus_pipeline
    import public_tokenizers
    import sentencepiece

    from sitelens.llm import mixing, quality
    from sitelens.llm.common import table

    docs = table(spark, sf, "documents")
    model = quality.fit(docs, table(spark, sf, "labels"))
    rows = {r["doc_id"]: r for r in docs.collect()}
    text = {i: r["text"] for i, r in rows.items() if model.predict(quality.statistics_of(np.array([0, len(t := (r["text"] or "").encode())]), np.frombuffer(t, np.uint8))[:1])[0] >= quality.THRESHOLD}
    source = {i: rows[i]["source"] or "" for i in text}
    sites, first = defaultdict(set), {}
    for i in sorted(text):
        for k, line in enumerate((text[i] or "").split("\n")):
            sites[line].add(source[i])
            first.setdefault(line, (i, k))
    text = {i: t and "\n".join(x for k, x in enumerate(t.split("\n")) if not x or len(sites[x]) < 3 or first[x] == (i, k)) for i, t in text.items()}
    sets = {i: shingle_set(t, 5) for i, t in text.items()}
    ids = sorted(i for i in sets if sets[i])
    pairs = [(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if 100 * (both := len(sets[a] & sets[b])) >= 80 * (len(sets[a]) + len(sets[b]) - both)]
    text = {i: text[i] for i, root in brute_components(pairs, sets).items() if root == i}
    size = Counter(source[i] for i in text)
    units = {s: max(1, math.floor(round(1000 * n**0.5 / sum(m**0.5 for m in size.values()), 6))) for s, n in sorted(size.items())}
    total, slot = sum(units.values()), brute_schedule(units)
    library, want, rank = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model")), {}, Counter()
    for i in sorted(text, key=lambda i: hashlib.md5(str(i).encode()).hexdigest()):
        block, s = rank[source[i]] // mixing.BLOCK_ROWS, source[i]
        want[i] = (rows[i]["lang"], rows[i]["source"], (block // units[s] * total + slot[s, block % units[s]]) * mixing.BLOCK_ROWS + rank[s] % mixing.BLOCK_ROWS, library.encode(text[i] or ""))
        rank[s] += 1
    out = corpus_pipeline.run(spark, sf).collect()
    assert len(out) == len(want) and {r["doc_id"]: (r["lang"], r["source"], r["position"], r["ids"]) for r in out} == want


def test_pipeline_edges(spark, sf, corpus):
    """Nulls, empty and very long texts, repeated rows and ids, extra columns and an empty table go through every stage."""
    import corpus_pipeline
    import public_tokenizers
    import sentencepiece

    from sitelens.llm.common import DOCUMENT_COLUMNS, cut

    repeated = [corpus[3], (3, "another text of the same id, long enough to be one of its own " * 3, None, None, None), (None, "no id here", "en", None, 10), (None, None, None, None, None)]
    clash = ("id", "rep", "__score", "words", "gone", "__position", "turn", "ids", "position", "n_tokens")
    docs = frame(spark, [*corpus, *repeated]).withColumns({c: F.lit("clash") for c in clash})
    labelled = spark.read.parquet(f"{sf}/documents.parquet").withColumns({c: F.lit("clash") for c in clash}).withColumn("doc_id", F.col("doc_id"))
    texts = Counter()
    for name, stage in corpus_pipeline.STAGES:
        given = docs.count()
        docs = cut(stage(spark, docs if name != "quality" else docs.unionByName(labelled), sf), name)
        if name in ("line_dedup", "mixing", "tokenise"):
            assert docs.count() == given
        if name != "tokenise":
            assert docs.columns == DOCUMENT_COLUMNS
        if name == "mixing":
            texts = Counter((r["doc_id"], r["text"]) for r in docs.collect())
    out = docs.collect()
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = Counter((i, tuple(library.encode(t or ""))) for (i, t), n in texts.items() for _ in range(n))
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in out) == want and len({r["position"] for r in out}) == len(out)
    none = empty(spark)
    for _, stage in corpus_pipeline.STAGES:
        none = stage(spark, none, sf)
        assert none.count() == 0
        none = none if "text" in none.columns else none


def test_repeated_rows(spark, corpus):
    """Repeated rows give repeated results in encoding, scans and extraction."""
    import public_tokenizers

    from sitelens.llm import license_scan as ls
    from sitelens.llm import piece_codec

    rows = [(1, "Licensed under the MIT License."), (1, "Licensed under the MIT License."), (None, "Licensed under the MIT License.")]
    docs = frame(spark, rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("license", "start_word", "containment")})
    assert sorted((r["doc_id"] or 0, r["license"]) for r in ls.scan(docs).collect()) == [(0, "MIT"), (1, "MIT"), (1, "MIT")]
    got = piece_codec.encode(docs, public_tokenizers.path("piece_bpe_32k.model"), keep=["doc_id"], digests=True).collect()
    assert len(got) == 3 and len({r["ids_sha256"] for r in got}) == 1
