"""SimHash near-duplicates by bit-sliced comparison.

* a document's fingerprint: each bit is the majority over the XXH64 hashes of
  its word shingles;
* two fingerprints within ``radius`` differing bits agree on at least
  ``blocks - radius`` of ``blocks`` bit blocks, so each fingerprint is dealt
  under every choice of that many blocks (15 keys of 21 or 22 bits for six
  blocks and radius four): no pair within the radius is missed, and buckets
  stay small as the corpus grows;
* within a bucket fingerprints are compared bit-sliced: 64 bit planes hold 64
  fingerprints a word, carry-save counters add up the differing bits of 64
  pairs at a time, and words of pairs whose counters all passed the radius are
  dropped;
* a bucket gives stars (a representative and its members), never all pairs;
  stars are joined to components by alternating large-star and small-star
  steps, each checkpointed.

Only distinct fingerprints take part, so copies cost one row.

Defined results: a null or empty text has fingerprint zero and links with its
like; a bit that half of the hashes have is 0; repeated rows have one
fingerprint; the component's id is its smallest id, null if it has none; an
empty table gives no rows; whole texts count whatever their length; other columns
are carried along by ``keep_one`` and not read else.
"""

from __future__ import annotations

import functools
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from binscore.llm.common import WHITE, runs, spaced, steps, text_buffer
from binscore.session import cut_lineage

SEED = 42
ONE = np.uint64(1)
FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


# --- fingerprints -------------------------------------------------------------

def fingerprints(texts: pa.Array, shingle: int = 4) -> np.ndarray:
    """64-bit fingerprint of each text (zero for one without words)."""
    out = []
    for part in steps(texts, 1 << 20):
        data, offs = text_buffer(part)
        inside = ~WHITE[data]
        starts, ends, first = runs(inside, offs)
        n_words = np.diff(first)
        line, at = spaced(data, inside, starts, ends, first)
        lengths = ends - starts
        n_shingles = np.where(n_words > 0, np.maximum(n_words - shingle + 1, 1), 0)
        begin = np.concatenate([[0], np.cumsum(n_shingles)])
        text = np.repeat(np.arange(len(n_words)), n_shingles)
        lead = first[text] + np.arange(begin[-1]) - begin[text]
        tail = np.minimum(lead + shingle, first[text + 1]) - 1
        view, digest = memoryview(line), xxhash.xxh64_intdigest
        h = np.fromiter((digest(view[a:b], SEED) for a, b in zip(at[lead].tolist(), (at[tail] + lengths[tail]).tolist())),
                        np.uint64, len(lead))
        out.append(_majority(h, begin, n_shingles))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _majority(h: np.ndarray, begin: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Bits set in over half of each text's hashes."""
    out = np.zeros(len(counts), np.uint64)
    some = np.flatnonzero(counts)
    if not len(some):
        return out
    bits = np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    ones = np.add.reduceat(bits, begin[:-1][some], axis=0, dtype=np.int32)
    out[some] = np.packbits(ones * 2 > counts[some, None], axis=1).view(">u8").ravel()
    return out


@functools.cache
def fingerprint_udf(shingle: int):
    @F.arrow_udf("long")
    def fingerprint(text: pa.Array) -> pa.Array:
        return pa.array(fingerprints(text, shingle).view(np.int64), pa.int64())
    return fingerprint


# --- bit-sliced comparison within buckets ----------------------------------------

def planes_of(f: np.ndarray) -> np.ndarray:
    """64 bit planes: plane k holds bit k of 64 fingerprints per word (one word
    of zeros follows, so that shifted reads stay inside)."""
    pad = np.zeros((len(f) + 63) // 64 * 64, np.uint64)
    pad[:len(f)] = f
    bits = np.unpackbits(pad.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    planes = np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(np.uint64)
    return np.concatenate([planes, np.zeros((64, 2), np.uint64)], axis=1)


def _shifted(plane: np.ndarray, words: np.ndarray, q: int, r: np.uint64) -> np.ndarray:
    last = len(plane) - 1
    low = plane[np.minimum(words + q, last)]
    if not r:
        return low
    return (low >> r) | (plane[np.minimum(words + q + 1, last)] << (np.uint64(64) - r))


def near_at(planes: np.ndarray, lanes: np.ndarray, words: np.ndarray, d: int, radius: int) -> tuple:
    """Of the pairs (i, i+d) for the lanes set in ``lanes`` at ``words``: the
    words and lanes of those that differ in at most ``radius`` bits."""
    q, r = d // 64, np.uint64(d % 64)
    width = radius.bit_length()
    counters = [np.zeros(len(words), np.uint64) for _ in range(width)]
    alive = lanes.copy()
    step = 0
    for k in range(64):
        carry = planes[k][words] ^ _shifted(planes[k], words, q, r)
        for c in range(width):
            carry, counters[c] = counters[c] & carry, counters[c] ^ carry
        alive &= ~carry  # the counter ran over
        step += 1
        if step % 8 == 0:
            over, equal = np.zeros(len(words), np.uint64), np.full(len(words), FULL)
            for c in reversed(range(width)):  # counter > radius, bit by bit
                if radius >> c & 1:
                    equal &= counters[c]
                else:
                    over |= equal & counters[c]
                    equal &= ~counters[c]
            alive &= ~over
            keep = alive != 0
            if not keep.all():
                words, alive = words[keep], alive[keep]
                counters = [x[keep] for x in counters]
                if not len(words):
                    break
    return words, alive


def _lanes(bits: np.ndarray) -> np.ndarray:
    """Bool per element to lane words."""
    pad = np.zeros((len(bits) + 63) // 64 * 64, np.uint8)
    pad[:len(bits)] = bits
    return np.packbits(pad, bitorder="little").view(np.uint64)


def link_buckets(bucket: np.ndarray, f: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Members and representatives of linked fingerprints.  ``bucket`` numbers
    the buckets and is sorted.  All buckets are compared at once, at distance
    d = 1, 2, ... in the sorted order; a bucket is done when d reaches its size
    or when all of it is linked."""
    n = len(f)
    parent = np.arange(n)
    if n < 2:
        return f[:0], f[:0]
    planes = planes_of(f)
    sizes = np.bincount(bucket)
    place = np.arange(n) - np.concatenate([[0], np.cumsum(sizes)])[bucket]
    remaining = sizes[bucket] - place  # partners exist at distance d < remaining
    parts = sizes.copy()  # components of each bucket
    most = int(sizes.max())
    active = np.flatnonzero(remaining > 1)
    for d in range(1, most):
        active = active[(remaining[active] > d) & (parts[bucket[active]] > 1)]
        if not len(active):
            break
        bits = np.zeros(n, bool)
        bits[active] = True
        lanes = _lanes(bits)
        words = np.flatnonzero(lanes)
        words, hit = near_at(planes, lanes[words], words, d, radius)
        if not len(words):
            continue
        lane = np.unpackbits(hit.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        row, bit = np.nonzero(lane)
        a = words[row] * 64 + bit
        ra, rb = parent[a], parent[a + d]
        differ = ra != rb
        if not differ.any():
            continue
        _union(parent, ra[differ], rb[differ], parts, bucket)
    rep = parent
    moved = np.flatnonzero(rep != np.arange(n))
    return f[moved], f[rep[moved]]


def _union(parent: np.ndarray, a: np.ndarray, b: np.ndarray, parts: np.ndarray, bucket: np.ndarray) -> None:
    """Joins the roots ``a`` and ``b`` pairwise; afterwards every element
    points at its root (the smallest index)."""
    for x, y in zip(a.tolist(), b.tolist()):
        while parent[x] != x:
            x = parent[x]
        while parent[y] != y:
            y = parent[y]
        if x != y:
            x, y = min(x, y), max(x, y)
            parent[y] = x
            parts[bucket[x]] -= 1
    while True:
        up = parent[parent]
        if (up == parent).all():
            return
        parent[:] = up


def _bucket_links(radius: int, hold: int = 1 << 17):
    """Over partitions sorted by (choice, key): links within each bucket.  A
    bucket is held until it is complete; about ``hold`` rows are compared at a
    time."""
    def run(batches):
        held: list[pa.RecordBatch] = []
        count = 0

        def solve(table: pa.Table):
            key = table["key"].to_numpy()
            new = np.concatenate([[False], (np.diff(key) != 0) | (np.diff(table["choice"].to_numpy()) != 0)])
            bucket = np.cumsum(new)
            several = np.bincount(bucket)[bucket] > 1
            f = table["fp"].to_numpy().view(np.uint64)[several]
            _, bucket = np.unique(bucket[several], return_inverse=True)
            a, b = link_buckets(bucket, f, radius)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            count += batch.num_rows
            if count >= hold:
                table = pa.Table.from_batches(held).combine_chunks()
                key, choice = table["key"].to_numpy(), table["choice"].to_numpy()
                same = (key == key[-1]) & (choice == choice[-1])
                cut = int(np.argmax(same))  # where the last, perhaps unfinished, bucket begins
                if cut:
                    yield solve(table.slice(0, cut))
                held, count = table.slice(cut).to_batches(), len(table) - cut
        if count:
            yield solve(pa.Table.from_batches(held).combine_chunks())
    return run


def block_masks(blocks: int, radius: int) -> list[int]:
    """Masks of every choice of ``blocks - radius`` of the bit blocks."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    block = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]
    return [sum(c) for c in combinations(block, blocks - radius)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint_links(prints: DataFrame, radius: int = 4, blocks: int = 6) -> DataFrame:
    """Links ``(a, b)`` whose components are those of all pairs of distinct
    fingerprints (column ``fp``) within ``radius`` bits."""
    masks = block_masks(blocks, radius)
    choice = F.explode(F.array(*[F.struct(F.lit(i).alias("choice"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key"))
                                 for i, m in enumerate(masks)])).alias("c")
    n = max(int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    return (prints.select("fp", choice).select("fp", "c.choice", "c.key")
            .repartition(n, "choice", "key").sortWithinPartitions("choice", "key", "fp")
            .mapInArrow(_bucket_links(radius), "a long, b long"))


# --- components -------------------------------------------------------------------

def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(node, root)`` of every linked node; the root is the smallest node.

    Alternates large-star and small-star steps until the links no longer
    change.  Nodes and links stay in DataFrames; each round is checkpointed."""
    edges = cut_lineage(links.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u"))
                        .distinct())
    mark = None
    for _ in range(max_rounds):
        both = edges.select(F.col("v").alias("x"), F.col("u").alias("y")).union(edges.select("u", "v"))
        least = both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m"))
        large = (both.join(least, "x").where("y > x").select(F.col("y").alias("v"), F.col("m").alias("u"))
                 .where("v <> u").distinct())
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(least, "v")
        edges = cut_lineage(small.where("u <> m").select(F.col("u").alias("v"), F.col("m").alias("u"))
                            .union(least.select("v", F.col("m"))).where("v <> u").distinct())
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first())
        if now == mark:
            return edges.select(F.col("v").alias("node"), F.col("u").alias("root"))
        mark = now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def _rooted(classes: DataFrame, radius: int, blocks: int) -> DataFrame:
    """``fp, least, root`` of the distinct fingerprints (``fp, least``)."""
    roots = components(fingerprint_links(classes.select("fp"), radius, blocks))
    return (classes.join(roots, F.col("fp") == F.col("node"), "left")
            .select("fp", "least", F.coalesce("root", "fp").alias("root")))


def near_duplicates(docs: DataFrame, shingle: int = 4, radius: int = 4, blocks: int = 6) -> DataFrame:
    """``doc_id, fp, component_id`` of every row: the smallest id reachable over
    links of ``radius`` or fewer differing bits.

    Null and empty texts have fingerprint zero and link like any other; rows
    that repeat an id each follow their own fingerprint; a null id is never
    the smallest unless the whole component has no other, then it is null."""
    prints = cut_lineage(docs.select("doc_id", fingerprint_udf(shingle)(F.col("text")).alias("fp")))
    rooted = _rooted(cut_lineage(prints.groupBy("fp").agg(F.min("doc_id").alias("least"))), radius, blocks)
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    ids = rooted.join(named, "root").select(F.col("fp").alias("_fp"), "component_id")
    return prints.join(ids, F.col("fp") == F.col("_fp")).select("doc_id", "fp", "component_id")


def fingerprint_hex(fp) -> F.Column:
    """16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_one(docs: DataFrame, shingle: int = 4, radius: int = 4, blocks: int = 6) -> DataFrame:
    """Rows of ``docs``, all columns kept: one of each component, the row with
    the smallest id; of rows that share this id, the one with the smallest text
    digest, then the smallest other columns.  A row without an id is kept only
    if its component has no row with one."""
    # the key: equal texts have equal fingerprints, so no key is in two components
    text_key = F.concat_ws(" ", F.coalesce(docs["doc_id"].cast("string"), F.lit("null")),
                           F.coalesce(F.md5(docs["text"].cast("binary")), F.lit("null")))
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "_llm_key")
    prints = docs.select("doc_id", text_key.alias("_llm_key"), fingerprint_udf(shingle)(docs["text"]).alias("fp"))
    rooted = _rooted(cut_lineage(prints.groupBy("fp").agg(F.min(order).alias("least"))), radius, blocks)
    kept = rooted.groupBy("root").agg(F.min("least").alias("least")).select(F.col("least._llm_key").alias("_llm_key"))
    names = docs.columns
    rest = F.to_json(F.struct(F.lit(0).alias("_llm"), *[docs[c] for c in names if c not in ("doc_id", "text")]))
    rows = docs.select(F.struct(*[docs[c] for c in names]).alias("_llm_row"), rest.alias("_llm_rest"),
                       text_key.alias("_llm_key"))
    return (rows.join(kept, "_llm_key").groupBy("_llm_key").agg(F.min_by("_llm_row", "_llm_rest").alias("_llm_row"))
            .select("_llm_row.*"))
