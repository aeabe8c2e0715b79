"""Near-duplicate pages by fingerprint, with every pair within the distance found and none expanded.

Pages of one fingerprint are one row. Fingerprints meet in permuted tables: 64 bits are cut into blocks, of which a pair at most
`distance` bits apart has all but `distance` equal; so there is a table for each choice of that many blocks, and a pair meets in one
of them at least. It counts in the first one where it does. More fingerprints take more blocks, and so longer keys: that changes
what the search costs, never what it finds.

Two pages are near-duplicates if their fingerprints are near and their contents aren't equal (an unknown content equals none).
"""

from __future__ import annotations

import itertools
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.components import components
from ..functions.lineage import cut, discard
from ..functions.text import NEAR_DISTANCE, hex_half, similarity_percent

#: Fingerprints that a key of a table should meet by chance at most, and the largest number of blocks.
BY_CHANCE = 16
MOST_BLOCKS = 11


def index_plan(n: int, distance: int = NEAR_DISTANCE) -> tuple[int, int]:
    """Number of blocks, and of those that make a table's key, for n fingerprints."""
    blocks = distance + 1
    while blocks < max(MOST_BLOCKS, distance + 1) and n > BY_CHANCE << (64 * (blocks - distance) // blocks):
        blocks += 1
    return blocks, blocks - distance


def _tables(bits: Column, blocks: int, kept: int) -> Column:
    """Number, key and skipped blocks of every table for a fingerprint as a long."""
    ends = [64 * k // blocks for k in range(blocks + 1)]
    part = lambda k: F.shiftrightunsigned(bits, ends[k]).bitwiseAND((1 << (ends[k + 1] - ends[k])) - 1)
    rows = []
    for t, chosen in enumerate(itertools.combinations(range(blocks), kept)):
        key = reduce(lambda x, k: F.shiftleft(x, ends[k + 1] - ends[k]).bitwiseOR(part(k)), chosen[1:], part(chosen[0]))
        skipped = sum(1 << k for k in range(chosen[-1]) if k not in chosen)
        rows.append(F.struct(F.lit(t).alias("t"), key.alias("key"), F.lit(skipped).alias("skipped")))
    return F.array(*rows)


def _equal_blocks(a: Column, b: Column, blocks: int) -> Column:
    """Bits of the blocks in which two fingerprints agree."""
    ends, differ = [64 * k // blocks for k in range(blocks + 1)], a.bitwiseXOR(b)
    each = [F.when(F.shiftrightunsigned(differ, ends[k]).bitwiseAND((1 << (ends[k + 1] - ends[k])) - 1) == 0, 1 << k).otherwise(0) for k in range(blocks)]
    return reduce(Column.__add__, each)


def near_prints(prints: DataFrame, keys: list[str], *, distance: int = NEAR_DISTANCE) -> DataFrame:
    """keys, simhash_a < simhash_b, distance: every two fingerprints (rows of keys and simhash, each once) at most so many bits apart."""
    bits = F.shiftleft(hex_half(F.col("simhash"), True), 32).bitwiseOR(hex_half(F.col("simhash"), False))
    own = cut(prints.select(*keys, "simhash", bits.alias("bits")), "prints")
    blocks, kept = index_plan(own.count(), distance)
    posted = own.select("*", F.explode(_tables(F.col("bits"), blocks, kept)).alias("x")).select(*keys, "simhash", "bits", "x.*")
    one = posted.select(*keys, "t", "key", "skipped", F.col("simhash").alias("simhash_a"), F.col("bits").alias("bits_a"))
    two = posted.select(*keys, "t", "key", F.col("simhash").alias("simhash_b"), F.col("bits").alias("bits_b"))
    met = one.join(two, [*keys, "t", "key"]).where("simhash_a < simhash_b").withColumn("distance", F.bit_count(F.col("bits_a").bitwiseXOR(F.col("bits_b"))).cast("int"))
    first = _equal_blocks(F.col("bits_a"), F.col("bits_b"), blocks).bitwiseAND(F.col("skipped")) == 0
    return met.where((F.col("distance") <= distance) & first).select(*keys, "simhash_a", "simhash_b", "distance")


def _comparable(pages: DataFrame) -> tuple[DataFrame, list[str]]:
    crawl = ["crawl_id"] if "crawl_id" in pages.columns else []
    own = pages.where(F.col("indexable") & F.col("simhash").isNotNull() & (F.col("word_count") >= 50))
    content = F.coalesce(F.concat(F.lit("="), "content_hash"), F.concat(F.lit("id "), F.col("id").cast("string")))
    return own.select(*crawl, "id", F.col("normalized_url").alias("url"), "simhash", content.alias("content")), crawl


def _links(own: DataFrame, crawl: list[str]) -> DataFrame:
    """simhash_a <= simhash_b, distance of fingerprints that have pages of unequal contents; one with itself if it has such pages."""
    by = [*crawl, "simhash"]
    prints = cut(own.groupBy(*by).agg(F.min("content").alias("low"), F.max("content").alias("high")), "contents")
    several = prints.where("low <> high").select(*crawl, F.col("simhash").alias("simhash_a"), F.col("simhash").alias("simhash_b"), F.lit(0).alias("distance"))
    side = lambda x: prints.select(*crawl, *(F.col(c).alias(f"{c}_{x}") for c in ("simhash", "low", "high")))
    near = near_prints(prints, crawl).join(side("a"), [*crawl, "simhash_a"]).join(side("b"), [*crawl, "simhash_b"])
    same = (F.col("low_a") == F.col("high_a")) & (F.col("low_a") == F.col("low_b")) & (F.col("low_b") == F.col("high_b"))
    return cut(near.where(~same).select(*several.columns).unionByName(several), "near-prints")


def near_duplicate_groups(pages: DataFrame) -> DataFrame:
    """crawl_id (if there), id, url, simhash, group_id (the group's smallest page id) and group_pages of pages that have near-duplicates."""
    own, crawl = _comparable(pages)
    own = cut(own, "comparable")
    links = _links(own, crawl)
    name = lambda c: F.struct(*crawl, F.col(c).alias("simhash")) if crawl else F.struct(F.col(c).alias("simhash"))
    root = components(links.select(name("simhash_a").alias("a"), name("simhash_b").alias("b")), "a", "b").select("node.*", F.col("root.simhash").alias("root"))
    members = cut(own.join(root, [*crawl, "simhash"]), "members")
    sizes = members.groupBy(*crawl, "root").agg(F.min("id").alias("group_id"), F.count("*").alias("group_pages"))
    return members.join(sizes, [*crawl, "root"]).select(*crawl, "id", "url", "simhash", "group_id", "group_pages")


def nearest_duplicates(pages: DataFrame) -> DataFrame:
    """id, url and of the nearest near-duplicate (then the one with the smallest id) other_id, other_url, distance, similarity.

    A page whose content is that of the first candidate takes the first one of another content. So of each fingerprint two pages of
    different contents are looked at, and of its neighbours' the two nearest: no group is expanded.
    """
    own, crawl = _comparable(pages)
    own = cut(own, "comparable")
    by = [*crawl, "simhash"]
    links = _links(own, crawl)
    both = links.select(*crawl, F.col("simhash_a").alias("simhash"), F.col("simhash_b").alias("other"), "distance")
    both = both.unionByName(links.where("simhash_a < simhash_b").select(*crawl, F.col("simhash_b").alias("simhash"), F.col("simhash_a").alias("other"), "distance"))
    heads = _two(own.select(*by, F.struct("id", "content", "url").alias("page")), by)
    offered = both.join(heads.withColumnRenamed("simhash", "other"), [*crawl, "other"])
    best = _two(offered.select(*by, F.struct("distance", "page.id", "page.content", "page.url").alias("page")), by)
    ranked = best.groupBy(*by).agg(F.min("page").alias("first"), F.max("page").alias("second"))  # of one row or two
    chosen = F.when(F.col("first.content") != F.col("content"), F.col("first")).when(F.col("second.content") != F.col("content"), F.col("second"))
    found = own.join(ranked, by).select(*crawl, "id", "url", chosen.alias("c")).where("c is not null")
    out = found.select(*crawl, "id", "url", F.col("c.id").alias("other_id"), F.col("c.url").alias("other_url"), F.col("c.distance").alias("distance"))
    return out.withColumn("similarity", similarity_percent(F.col("distance")))


def _two(rows: DataFrame, by: list[str]) -> DataFrame:
    """by and page: the smallest page (a struct with content) of each group, and the smallest of another content than that."""
    rows = cut(rows, "offers")
    first = cut(rows.groupBy(*by).agg(F.min("page").alias("page")), "first")
    rest = rows.join(first.select(*by, F.col("page.content").alias("taken")), by).where(F.col("page.content") != F.col("taken"))
    out = cut(first.unionByName(rest.groupBy(*by).agg(F.min("page").alias("page"))), "two")
    discard(rows, first)
    return out
