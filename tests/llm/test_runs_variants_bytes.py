"""Periodic runs, spelling variants and byte-level BPE against brute force and the library."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

WORD = re.compile("[^\x20\x09-\x0d]+")
ODD = [None, "", " \n\t ", "word", "x" * 3000, "a b " * 500, "naïve ñandú 你好 😀\n▁mark z y"]


def sha(x):
    return hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()


# 11


def brute_runs(words, least=12):
    """Every maximal stretch of each period, kept if the period is its smallest."""
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, 2 * q):
                found.setdefault((i, j + q - i), q)
            i = max(j, i + 1)
    return sorted((s, length, q) for (s, length), q in found.items())


def brute_row(words):
    runs = brute_runs(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    text = " ".join(w for i, w in enumerate(words) if i not in gone)
    return (len(runs), *best, sha("".join("%d,%d,%d\n" % r for r in runs)), sha(text)), runs, text


def planted(doc_id, words):
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


@pytest.mark.parametrize("seed", range(4))
def test_runs_of_sequences(seed):
    """Short alphabets, periods within periods, Fibonacci words, random ones: all runs, whatever the length asked for."""
    from sitelens.llm.periodic_runs import Factors, batch_runs

    rng = random.Random(seed)
    fib = ["a", "ab"]
    for _ in range(9):
        fib.append(fib[-1] + fib[-2])
    rows = [list(fib[-1]), ["a"] * 100, list("ab" * 40 + "a"), list("abaab" * 7 + "ab" * 9), []]
    for _ in range(60):
        k, n = rng.choice([1, 2, 2, 3, 5]), rng.randrange(1, 120)
        x = [rng.choice("abcde"[:k]) for _ in range(n)]
        rows.append(x if rng.random() < 0.5 else [*x, *(x[-rng.randrange(1, n + 1) :] * rng.randrange(1, 5)), *rng.choices("abc", k=rng.randrange(9))])
    for x in rows[:-1]:
        if x:
            got = Factors(np.array([ord(c) for c in x]) - 97).runs()
            assert [*zip(*(v.tolist() for v in got), strict=True)] == brute_runs(x, 2)
    texts = [" ".join(x).encode() for x in rows]
    for least in (2, 12, 20):
        row, start, length, period, *_ = batch_runs(np.cumsum([0, *map(len, texts)]), np.frombuffer(b"".join(texts), dtype=np.uint8), least)
        want = [(i, *r) for i, x in enumerate(rows) for r in brute_runs(x, least)]
        assert [*zip(row.tolist(), start.tolist(), length.tolist(), period.tolist(), strict=True)] == want


def test_runs_query(spark, sf):
    from sitelens.llm.periodic_runs import op11_periodic_runs

    got = {r["doc_id"]: r for r in op11_periodic_runs(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(got) == len(docs)
    some = 0
    for d in docs:
        r = got[d["doc_id"]]
        words = planted(d["doc_id"], WORD.findall(d["text"] or ""))
        if len(words) > 3000 and not zlib.crc32(str(d["doc_id"]).encode()) % 10 == 0:
            continue
        want, runs, _ = brute_row(words)
        assert (r["n_runs"], r["start"], r["length"], r["period"], r["runs_sha256"], r["collapsed_sha256"]) == want, d["doc_id"]
        assert r["exponent_milli"] == (1000 * r["length"] // r["period"] if runs else None)
        some += len(runs)
    assert some > 15


def test_runs_edges(spark):
    """Nulls, empty and long texts, repeated rows, extra columns with names of results, an empty table."""
    from sitelens.llm.periodic_runs import find_runs, with_planted_runs

    rng = random.Random(5)
    long = " ".join([*(f"w{i}" for i in range(20_000)), *(["a", "b", "c"] * 4000), *(f"v{i % 977}" for i in range(20_000))])
    texts = [*ODD, "  lead\vand\ftrail \r\n", "one two " * 6, "one two\n" * 5, long, " ".join(rng.choices("ab", k=400))]
    rows = [(i, t) for i, t in enumerate(texts)] + [(5, "a b " * 500), (None, "c d " * 9)]
    clash = {c: F.lit("clash") for c in ("n_runs", "start", "runs", "collapsed", "period", "length")}
    docs = spark.createDataFrame(rows, "id long, text string").withColumns(clash).withColumn("other", F.lit(7))
    out = find_runs(docs, digests=True)
    assert out.columns == ["id", "other", "n_runs", "start", "length", "period", "runs", "collapsed", "runs_sha256", "collapsed_sha256"]
    out = out.collect()
    assert len(out) == len(rows)
    for r in out:
        text = dict(rows)[r["id"]] if r["id"] is not None else rows[-1][1]
        if text is long:
            assert [tuple(x) for x in r["runs"]] == [(20_000, 12_000, 3), (32_000, 20_000, 977)]
            continue
        want, runs, collapsed = brute_row(WORD.findall(text or ""))
        assert (r["n_runs"], r["start"], r["length"], r["period"], r["runs_sha256"], r["collapsed_sha256"]) == want
        assert [tuple(x) for x in r["runs"]] == runs and r["collapsed"] == collapsed
    assert find_runs(spark.createDataFrame([], "id long, text string")).count() == 0
    keyed = spark.createDataFrame([(None, "a b c d"), (30, None), (30, " "), (30, "p q r s t u v")], "id long, text string")
    got = [r[0] for r in keyed.select(with_planted_runs(F.col("id"), F.col("text"))).collect()]
    assert got[:3] == ["a b c d", None, " "]
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 10 == 0]
    words = [f"w{i}" for i in range(57)]
    made = spark.createDataFrame([(i, "\t".join(words)) for i in ids], "id long, text string").select("id", with_planted_runs(F.col("id"), F.col("text")).alias("t")).collect()
    assert all(r["t"].split(" ") == planted(r["id"], words) for r in made)


# 12


def brute_variants(counts, ratio=10):
    def one_apart(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    words, by, near = sorted(counts), {}, {w: [] for w in counts}
    for w in words:
        for m in {(w[:i] + "\0" + w[i + 1 :]) for i in range(len(w))} | {w[:i] + "\0" + w[i:] for i in range(len(w) + 1)}:
            by.setdefault(m, []).append(w)
    for group in by.values():
        for a in group:
            near[a] += [b for b in group if b != a and one_apart(a, b)]
    form = {}
    for w in words:
        best = min(set(near[w]), key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * counts[w] else None
    out = {}
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, counts[w], len(set(near[w])), counts[form[w]] if form[w] else None)
    return out


def brute_words(rows):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    counts = Counter()
    for i, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = w.translate(low)
            h = zlib.crc32(f"{i}:{w}".encode())
            if h % 31 == 0 and i is not None:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            counts[w] += len(w) >= 7
    return {w: n for w, n in counts.items() if n >= 2}


def as_rows(df):
    rows = df.collect()
    out = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows}
    assert len(out) == len(rows)
    return out


def test_variants_query(spark, sf):
    from sitelens.llm.spelling_variants import op12_spelling_variants

    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = brute_variants(brute_words(docs))
    got = as_rows(op12_spelling_variants(spark, sf))
    assert got == want and any(v[0] for v in want.values())


def test_variants_of_chosen_words(spark):
    """Chains of forms, ties, anagrams, accents, exchanges at either end, many words one letter apart, very long words."""
    from sitelens.llm.spelling_variants import variants

    rng = random.Random(2)
    counts = {"kitchen": 5000, "kitchan": 500, "kitchn": 50, "itchan": 5, "kitchenx": 2, "xkitchen": 2, "kytchen": 500, "listens": 30, "silents": 2, "enlists": 2, "tinsels": 300, "élèvesé": 20, "élèvese": 2, "éleveso": 2, "a": 50, "b": 5, "ab": 5, "aaaaaaaa": 100, "aaaaaaaaa": 10, "aaaaaaab": 1}
    counts |= {"hub" + a + "word": 3 for a in "abcdefghijklmnopqrstuvwxyz"} | {"hubword": 3000}
    counts |= {"".join(rng.choices("ab", k=12)): rng.choice([2, 3, 40, 500]) for _ in range(400)}
    counts |= {"z" * 20_000: 70, "z" * 19_999: 3, "z" * 9_999 + "y" + "z" * 10_000: 4}
    rows = spark.createDataFrame([*counts.items()], "word string, n long").withColumn("form", F.lit("clash"))
    got = as_rows(variants(rows))
    assert got == brute_variants(counts)
    assert got["kitchn"][1] == "kitchen" and got["hubaword"][0] == "hubword"
    assert variants(rows.where("false")).count() == 0
    with pytest.raises(ValueError):
        variants(rows, ratio=1)


def test_variant_words(spark):
    from sitelens.llm.spelling_variants import LOWER, misspelt, words

    rows = [(i, t) for i, t in enumerate([*ODD, "Éclairage ÉCLAIRAGE x×÷ÿzÿz12abcdefgh", "under_scores Underscores"] * 2)] + [(None, "Nullable nullable"), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit("clash"))
    got = Counter(r[0] for r in words(docs, keep=["doc_id"]).select(misspelt(F.col("doc_id"), F.col("word")).alias("word")).where(F.length("word") >= 7).collect())
    assert {w: n for w, n in got.items() if n >= 2} == brute_words(rows)
    # Letters' values have distinct differences, so that two words meet once.
    value = [ord(c) ** 4 for c in LOWER] + [c**4 for c in range(0xC0, 0x100)]
    differences = [a - b for a in value for b in value if a != b]
    assert len(differences) == len(set(differences))


# 13


@pytest.fixture(scope="module")
def bpe():
    import public_tokenizers as P
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return path, tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def flat(texts):
    coded = [(t or "").encode() for t in texts]
    return np.cumsum([0, *map(len, coded)]), np.frombuffer(b"".join(coded), dtype=np.uint8)


def test_slices_are_the_patterns(bpe):
    """Boundaries against the pattern: random texts of what the automaton tells apart, and every code point in several places."""
    import public_tokenizers as P
    import regex

    from sitelens.llm.byte_codec import slices

    rng = random.Random(1)
    pieces = ["'", "'s", "'re", "'ve", "'ll", "'l", "l", "r", "e", "v", "s", "t", "m", "d", "S", "é", "你", " ", "  ", "\n", "\t", " ", "\x1c", "1", "²", "Ⅷ", ".", "-", "😀", "́", "", "x"]
    texts = ["".join(rng.choices(pieces, k=rng.randrange(14))) for _ in range(20_000)]
    offsets, data = flat(texts)
    first, rows = slices(offsets, data)
    bounds = [*first.tolist(), len(data)]
    raw = data.tobytes()
    pattern = regex.compile(P.PATTERN)
    for i, t in enumerate(texts):
        assert [raw[bounds[k] : bounds[k + 1]].decode() for k in range(rows[i], rows[i + 1])] == pattern.findall(t), repr(t)


def test_kinds_are_the_librarys():
    import tiktoken

    from sitelens.llm import byte_codec as bc

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    points, kinds = np.array([*map(ord, every)]), bc._kinds()
    for pattern, own in ((r"\p{L}", kinds >= bc.LETTER - 0), (r"\p{N}", kinds == bc.NUMBER), (r"\s", (kinds == bc.SPACE) | (kinds == bc.WHITE))):
        probe = tiktoken.Encoding("probe", pat_str=pattern, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
        if pattern == r"\p{L}":
            own = np.isin(kinds, [bc.LETTER, bc.ONE, bc.R, bc.V, bc.L, bc.E])
        assert bytes(probe.encode_ordinary(every)).decode() == "".join(map(chr, points[own[points]]))


def test_bytes_encode_as_the_library(spark, sf, bpe):
    from sitelens.llm import byte_codec as bc

    path, library = bpe
    rng = random.Random(4)
    texts = [*ODD, *ODD[:6]] + [c * n for c in (" ", "\n", "=", "-", "a", "'", "你", "ab", " \t") for n in (2, 17, 100, 533, 4097)] + ["".join(rng.choices("abcdefghij'  \n.é😀12", k=rng.randrange(300))) for _ in range(300)]
    texts += ["".join(rng.choices("abcdefghijklmnopqrstuvwxyzABC", k=20_000))] + [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").limit(200).collect()]
    rows = [(i, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "id long, text string").withColumns({c: F.lit("clash") for c in ("ids", "offsets", "n_tokens")}).withColumn("extra", F.lit(1))
    out = bc.encode(docs, path, digests=True)
    assert out.columns == ["id", "extra", "n_tokens", "ids", "offsets", "ids_sha256", "decoded_sha256"]
    out = bc.decode(bc.decode(out, path), path, into="span", start=3, end=11).collect()
    assert len(out) == len(rows)
    for r in out:
        t = texts[r["id"]] or ""
        want = library.encode_ordinary(t)
        assert r["ids"] == want and r["n_tokens"] == len(want) and r["ids_sha256"] == sha(",".join(map(str, want))), repr(t[:50])
        assert bytes(r["bytes"]) == t.encode() == library.decode_bytes(want) and r["decoded_sha256"] == sha(t) and bytes(r["span"]) == t.encode()[3:11]
        sizes = [len(library.decode_single_token_bytes(i)) for i in want]
        assert r["offsets"] == [sum(sizes[:k]) for k in range(min(len(sizes), 50))] + r["offsets"][50:]
    assert bc.encode(spark.createDataFrame([], "id long, text string"), path).count() == 0
    none = spark.createDataFrame([(None, None)], "ids array<int>, offsets array<int>")
    assert bc.decode(none, path).collect()[0]["bytes"] is None


def test_bytes_that_are_no_text():
    """Bytes that aren't UTF-8 are marks; whatever the bytes, ids decode to them."""
    import public_tokenizers as P

    from sitelens.llm.byte_codec import load

    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = load(f.read())
    rng = random.Random(9)
    rows = [bytes(rng.choices([0x20, 0x61, 0xC3, 0xA9, 0xE4, 0xBD, 0xA0, 0xF0, 0x9F, 0x98, 0x80, 0xFF], k=rng.randrange(40))) for _ in range(2000)]
    offsets, data = np.cumsum([0, *map(len, rows)]), np.frombuffer(b"".join(rows), dtype=np.uint8)
    for raw, found in zip(rows, ranks.encode(offsets, data), strict=True):
        ids = [int(x) for s, _, _ in found for x in s.split(",")]
        assert ranks.decode(ids) == raw == b"".join(x[1] for x in found)
