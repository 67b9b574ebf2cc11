"""Global distinct-word shuffle.

Texts are cut into tokens in their scan partition.  About ``CHUNK_BYTES`` of
text make a chunk: its distinct tokens (the chunk dictionary, ordered by
frequency) and, for every text, its tokens as positions in that dictionary.
The dictionaries are dealt by a hash of the token, so all occurrences of a
token in all chunks meet once (``reduce_words``) whatever its frequency; the
answers go back to the chunk, where ``assemble`` puts them at every position.

A hot token is one row part per chunk, not one row per occurrence, and a text
never leaves its chunk.  Chunk and dictionaries travel in one exchange that
both readers use.

The chunk's id is a digest of its place (partition, running number) and its
contents: chunks of equal rows stay apart, and should a lost executor's chunk
be cut differently when it is computed anew, its answers are missing and
``assemble`` fails instead of mixing two versions.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

from binscore.llm.common import mix64, staged, steps, text_buffer

CHUNK_BYTES = 8 << 20
#: home: what the exchange deals by (a chunk's id, or a bucket number).
SCHEMA = "home long, chunk long, bucket int, payload binary"
BACK = "home long, bucket int, payload binary"
DOCS = -1  # bucket of a chunk's texts


# --- packed arrays ------------------------------------------------------------------

def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one zstd-compressed value."""
    sizes = np.array([len(arrays), *[a.nbytes for a in arrays]], np.int64)
    return sizes.tobytes() + pa.compress(b"".join(a.tobytes() for a in arrays), codec="zstd", asbytes=True)


def unpack(blob: bytes, *kinds) -> list[np.ndarray]:
    n = int(np.frombuffer(blob, np.int64, 1)[0])
    sizes = np.frombuffer(blob, np.int64, n, 8)
    raw = pa.decompress(blob[8 * (n + 1):], decompressed_size=int(sizes.sum()), codec="zstd") if sizes.sum() else b""
    at, out = 0, []
    for size, kind in zip(sizes.tolist(), kinds):
        out.append(np.frombuffer(raw, kind, size // np.dtype(kind).itemsize, at) if size else np.zeros(0, kind))
        at += size
    return out


def _planes(codes: np.ndarray) -> list[np.ndarray]:
    c = codes.astype(np.uint32)
    return [(c & 255).astype(np.uint8), (c >> 8 & 255).astype(np.uint8), (c >> 16).astype(np.uint16)]


def take_lists(ends: np.ndarray, values: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lists ``index`` of the lists that end at ``ends`` (n+1 values): their
    values and lengths."""
    lengths = ends[index + 1] - ends[index]
    begin = np.cumsum(lengths) - lengths
    return values[np.repeat(ends[index] - begin, lengths) + np.arange(int(lengths.sum()))], lengths


def binary_parts(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n+1 offsets of a binary array."""
    _, offs, data = arr.buffers()
    offs = np.frombuffer(offs, np.int32)[arr.offset:arr.offset + len(arr) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[offs[0]:offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offs - offs[0]


def binary_array(data: np.ndarray, lengths: np.ndarray) -> pa.Array:
    ends = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=ends[1:])
    return pa.Array.from_buffers(pa.binary(), len(lengths),
                                 [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))])


def word_hash(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """64-bit polynomial hash of each word's bytes, mixed."""
    n = len(offs) - 1
    if not n:
        return np.zeros(0, np.uint64)
    lengths = np.diff(offs)
    power = np.cumprod(np.full(int(lengths.max()) + 1, 0x9E3779B97F4A7C15, np.uint64), dtype=np.uint64)
    place = np.arange(len(data)) - np.repeat(offs[:-1], lengths)
    terms = np.concatenate([[np.uint64(0)], np.cumsum((data + np.uint64(1)) * power[place], dtype=np.uint64)])
    return mix64(terms[offs[1:]] - terms[offs[:-1]])


# --- the exchange -----------------------------------------------------------------------

def _chunks(tokenise: Callable, buckets: int):
    """mapInArrow over ``doc_id, text, weight``: rows of ``SCHEMA``."""
    def emit(number, tokens, doc_ids, firsts, weights):
        ids = pa.concat_arrays(doc_ids)
        counts = np.concatenate(firsts)
        weight = np.concatenate(weights)
        coded = pa.concat_arrays(tokens).dictionary_encode()
        codes = coded.indices.to_numpy()
        size = len(coded.dictionary)
        order = np.argsort(-np.bincount(codes, minlength=size), kind="stable")
        rank = np.empty(size, np.int64)
        rank[order] = np.arange(size)
        codes = rank[codes]
        distinct = coded.dictionary.take(pa.array(order))
        data, offs = binary_parts(distinct)
        known = ids.fill_null(0).to_numpy()
        mask = np.asarray(ids.is_null()).astype(np.uint8)
        from pyspark import TaskContext
        digest = xxhash.xxh64(data.tobytes(), seed=TaskContext.get().partitionId())
        for part in (np.array([number]), offs, known, mask, counts, weight, codes):
            digest.update(part.tobytes())
        chunk = digest.intdigest() >> 1 | 1 << 62
        heavy = np.bincount(codes[np.repeat(weight, counts) != 0], minlength=size).astype(np.uint32)
        bucket = (word_hash(data, offs) % np.uint64(buckets)).astype(np.int64)
        homes, numbers, payloads = [chunk], [DOCS], [pack(known, mask, counts.astype(np.uint32), weight, *_planes(codes),
                                                          bucket.astype(np.uint32))]
        by_bucket = np.argsort(bucket, kind="stable")
        edges = np.searchsorted(bucket[by_bucket], np.arange(buckets + 1))
        lengths = np.diff(offs)
        for b in np.flatnonzero(np.diff(edges)):
            own = by_bucket[edges[b]:edges[b + 1]]
            homes.append(int(b))
            numbers.append(int(b))
            payloads.append(pack(lengths[own].astype(np.uint32), take_lists(offs, data, own)[0], heavy[own]))
        return pa.RecordBatch.from_arrays([pa.array(homes, pa.int64()), pa.array([chunk] * len(homes), pa.int64()),
                                           pa.array(numbers, pa.int32()), pa.array(payloads, pa.binary())],
                                          names=["home", "chunk", "bucket", "payload"])

    def run(batches):
        held, size, number = ([], [], [], []), 0, 0
        for batch in batches:
            at = 0
            for part in steps(batch.column("text")):
                data, offs = text_buffer(part)
                tokens, first = tokenise(data, offs)
                rows = batch.slice(at, len(part))
                at += len(part)
                for where, what in zip(held, (tokens, rows.column("doc_id"), np.diff(first),
                                              rows.column("weight").to_numpy(zero_copy_only=False).astype(np.uint8))):
                    where.append(what)
                size += len(data) + 16 * len(part)
                if size >= CHUNK_BYTES:
                    yield emit(number, *held)
                    held, size, number = ([], [], [], []), 0, number + 1
        if held[0]:
            yield emit(number, *held)
    return run


def buckets(spark: SparkSession) -> int:
    """Buckets that words are dealt to: twice as many as shuffle partitions."""
    return 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))


def deal(docs: DataFrame, tokenise: Callable, stage: bool = False) -> DataFrame:
    """The exchange's rows for ``docs`` (``doc_id`` long, ``text`` string,
    ``weight`` byte 0 or 1): chunks at home, dictionaries dealt by token.

    ``stage`` writes the rows to the shared folder first, for use by more than
    one job."""
    n = buckets(docs.sparkSession)
    rows = docs.select("doc_id", "text", "weight").mapInArrow(_chunks(tokenise, n), SCHEMA)
    return (staged(rows, "chunks") if stage else rows).repartition(n // 2, "home")


def reduce_words(dealt: DataFrame, answer: Callable, schema: str = BACK, summary: Callable | None = None,
                 side: DataFrame | None = None) -> DataFrame:
    """Calls ``answer(words, counts)`` once for each bucket with its distinct
    words (a binary array) and the sum of their weighted counts; it returns a
    list of arrays, n+1 list ends first, that holds for each word a list of values.  Each
    chunk gets back the lists of its own words, in their order.

    With ``summary`` the buckets' ``summary(words, counts)`` batches are
    returned instead; with ``side``, a table with the bucket number as ``home``,
    ``answer`` also gets the bucket's rows of it."""
    def run(key, table, *more):
        rows = [(c, b, p) for c, b, p in zip(table["chunk"].to_pylist(), table["bucket"].to_pylist(),
                                             table["payload"].to_pylist()) if b != DOCS]
        if not rows:
            return empty
        parts = [unpack(p, np.uint32, np.uint8, np.uint32) for _, _, p in rows]
        coded = pa.concat_arrays([binary_array(d, n) for n, d, _ in parts]).dictionary_encode()
        codes = coded.indices.to_numpy()
        counts = np.bincount(codes, weights=np.concatenate([h for _, _, h in parts]),
                             minlength=len(coded.dictionary)).astype(np.int64)
        if summary:
            return summary(coded.dictionary, counts)
        ends, *values = answer(coded.dictionary, counts, *more)
        out, at = [], 0
        for n, _, _ in parts:
            own = codes[at:at + len(n)]
            at += len(n)
            lists = [take_lists(ends, v, own) for v in values]
            out.append(pack(lists[0][1].astype(np.uint32), *[x[0] for x in lists]))
        return pa.table([pa.array([c for c, _, _ in rows], pa.int64()), pa.array([b for _, b, _ in rows], pa.int32()),
                         pa.array(out, pa.binary())], names=["home", "bucket", "payload"])

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string
    empty = to_arrow_schema(_parse_datatype_string(schema)).empty_table()
    if side is not None:
        return dealt.groupBy("home").cogroup(side.groupBy("home")).applyInArrow(lambda k, t, more: run(k, t, more), schema)
    return dealt.groupBy("home").applyInArrow(lambda k, t: run(k, t), schema)


def assemble(dealt: DataFrame, back: DataFrame, kinds: tuple, build: Callable, schema: str) -> DataFrame:
    """Calls ``build(doc_ids, counts, weight, codes, ends, *values)`` once for
    each chunk: ``codes`` are its texts' tokens as positions in the chunk
    dictionary, list ``k`` of ``values`` (of ``kinds``) belongs to its word k.
    It returns a table of ``schema``."""
    def run(key, chunk, answers):
        rows = [p for b, p in zip(chunk["bucket"].to_pylist(), chunk["payload"].to_pylist()) if b == DOCS]
        if not rows and not len(answers):
            return empty
        if len(rows) != 1:
            raise RuntimeError(f"{len(rows)} chunks under one id; run the query again")
        known, mask, counts, weight, low, mid, high, bucket = unpack(
            rows[0], np.int64, np.uint8, np.uint32, np.uint8, np.uint8, np.uint8, np.uint16, np.uint32)
        codes = low.astype(np.int64) | mid.astype(np.int64) << 8 | high.astype(np.int64) << 16
        got = dict(zip(answers["bucket"].to_pylist(), answers["payload"].to_pylist()))
        by_bucket = np.argsort(bucket, kind="stable")
        needed = np.unique(bucket)
        if len(got) != len(answers) or set(got) != set(needed.tolist()):
            raise RuntimeError("a chunk's answers do not match it; run the query again")
        parts = [unpack(got[b], np.uint32, *kinds) for b in needed.tolist()]
        lengths = np.concatenate([p[0] for p in parts]).astype(np.int64) if parts else np.zeros(0, np.int64)
        if len(lengths) != len(bucket):
            raise RuntimeError("a chunk's answers do not match it; run the query again")
        values = [np.concatenate([p[i + 1] for p in parts]) if parts else np.zeros(0, k) for i, k in enumerate(kinds)]
        # lists came bucket by bucket; put them in the order of the chunk dictionary
        ends = np.concatenate([[0], np.cumsum(lengths)])
        place = np.empty(len(by_bucket), np.int64)
        place[by_bucket] = np.arange(len(by_bucket))
        sorted_values = []
        for v in values:
            v, n = take_lists(ends, v, place)
            sorted_values.append(v)
        new_ends = np.concatenate([[0], np.cumsum(lengths[place])]) if len(place) else np.zeros(1, np.int64)
        ids = pa.array(known, pa.int64(), mask=mask.astype(bool))
        return build(ids, counts.astype(np.int64), weight, codes, new_ends, *sorted_values)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string
    empty = to_arrow_schema(_parse_datatype_string(schema)).empty_table()
    return dealt.groupBy("home").cogroup(back.groupBy("home")).applyInArrow(run, schema)
