"""Sketches and the next document against brute force; hot ids."""

import collections
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from binscore.llm import sketches

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def successors(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1].encode()))
    return collections.Counter((i, t, order[(k + 1) % len(order)][1]) for k, (i, t) in enumerate(order))


@pytest.mark.parametrize("parts", [1, 7, 40])
def test_next_is_the_next_of_the_whole_order(spark, parts):
    """Ids in ranges, many rows without id (with common beginnings), repeated
    ids and rows: however many ranges, the one order."""
    rows = [(i, f"text {i * 7919 % 31} of {i}") for i in range(-40, 200, 3)]
    rows += [(None, f"the same long beginning {'x' * (i % 5)}{i}") for i in range(150)]
    rows += [(77, f"again {i % 4}") for i in range(60)] + [(-(1 << 63), "least"), ((1 << 63) - 1, "most"), (None, "")]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
        got = collections.Counter((r.doc_id, r.text, r.next_text) for r in sketches.with_next(df).collect())
        ranges = df.withColumn("r", sketches._range_of(sketches._place(F.substring("text", 1, sketches.PREFIX)), sketches._cuts(df, parts)))
        sizes = [r["count"] for r in ranges.groupBy("r").count().collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert got == successors(rows)
    assert parts < 40 or max(sizes) < 40  # the 150 rows without id are spread


def test_one_row_is_its_own_next(spark):
    df = spark.createDataFrame([(None, "abc")], "doc_id long, text string")
    assert [r.next_text for r in sketches.with_next(df).collect()] == ["abc"]
    row = sketches.fingerprints(df).first()
    assert row.edited == "aba" and row.near_next == 1.0


def plain_sketch(text, scale=sketches.SCALE):
    """Spark's xxhash64 of an array of strings chains: the hash of each word is
    the seed of the next."""
    def chained(ws):
        seed = 42
        for w in ws:
            seed = xxhash.xxh64_intdigest(w.encode(), seed)
        return seed - (1 << 64) if seed >> 63 else seed
    w = WORD.findall(text)
    if not w:
        return []
    h = {chained(w[i:i + 5]) for i in range(max(1, len(w) - 4))}
    limit = -(1 << 63) + (1 << 64) // scale
    return sorted(x for x in h if x < limit or x == min(h))


def test_sketches_and_likeness_equal_brute_force(spark):
    texts = ["", "one two", "a b c d e", "a b c d e f g h " * 6, " ".join(f"w{i % 37}" for i in range(400)),
             " ".join(f"w{i % 37}" for i in range(400)) + " and more words at the end here", "x  y\tz\n" * 30]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")

    def near(a, b, n, m):
        if not a or not b:
            return float(len(a) == len(b))
        return len(set(a) & set(b)) / len(a if n <= m else b)

    for r in sketches.fingerprints(df).collect():
        text, following = texts[r.doc_id], texts[r.doc_id - 1]
        half = len(text) // 2
        edited = text[:len(text) - half] + following[:half]
        assert r.edited == edited and r.n_chars == len(text)
        mine, changed, other = plain_sketch(text), plain_sketch(edited), plain_sketch(following)
        assert r.kept == mine and r.edited_kept == changed
        assert r.near_edited == pytest.approx(near(mine, changed, len(text), len(edited)))
        assert r.near_next == pytest.approx(near(mine, other, len(text), len(following)))
