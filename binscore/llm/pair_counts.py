"""Counts of the neighbours of all words over all texts, whatever their number.

Some words have a symbol of their own, a number below a given width; the others
are known by their hash.  Of each other word (the context) there are counts of
every word after it and of every symbol before it, so every pair of words that is
not of two symbols is counted once, at one of its words that is in no text often.

Rows are taken in chunks of about ``CHUNK_BYTES`` of text.  A chunk's pairs are
dealt by the hash of their context, so all pairs of a word meet once (``answers``);
each chunk gets back how often its pairs and contexts occur in all texts
(``Counted``).  Chunks (texts as word numbers) and pairs travel in one exchange
that both readers use.  Contexts are known by 48 bits of their hash, other words
after them by 40.

The chunk's id is a digest of its place and its contents, as in ``dictionary.py``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from binscore.llm import dictionary
from binscore.llm.common import mix64, steps
from binscore.llm.dictionary import BACK, DOCS, SCHEMA, pack, unpack

CHUNK_BYTES = 10 << 20
CONTEXT_BITS, WORD_BITS = 48, 40
#: Kinds of a context's pairs: a symbol after it, one before it, another word after it.
AFTER, BEFORE, OTHER = range(3)


class Texts(NamedTuple):
    """Texts as numbers, language by language.  The number of a word is its
    symbol, ``width`` higher for each language before, or after all symbols the
    rank of the other word by its hash.  The last symbol of a language is a text's end."""
    rows: pa.Table  # what to keep of each text
    n: np.ndarray  # words of each text
    lang: np.ndarray  # number of each text's language
    codes: np.ndarray  # of each word
    group: np.ndarray  # of each other word: a number below 256
    hashes: np.ndarray  # of each other word, in order


class Pairs(NamedTuple):
    """The positions of texts (words and ends), and their pairs with another word."""
    line: np.ndarray  # number at each position
    before: np.ndarray  # number before it, the end before a text
    text: np.ndarray  # text of each position
    context: np.ndarray  # of each distinct pair
    kind: np.ndarray
    event: np.ndarray  # the number beside the context
    pair: np.ndarray  # of each entry (pair and text) its pair
    at: np.ndarray  # of each entry its first position
    own: np.ndarray  # of each entry its occurrences


class Counted(NamedTuple):
    """Of each entry the counts of all texts."""
    pair: np.ndarray  # occurrences of the pair
    total: np.ndarray  # occurrences of the context with a pair of that side
    once: np.ndarray  # its pairs of that side that occur once
    event: np.ndarray  # occurrences of the other word after the context, else 1


def in_order(key: np.ndarray, bound: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys (below ``bound``) and their places, equal ones in order."""
    bits = len(key).bit_length()
    if bound << bits < 1 << 63:  # one number for both sorts fastest
        both = key << bits
        both |= np.arange(len(key))
        both.sort()
        place = (both & ((1 << bits) - 1)).astype(np.int32) if bits < 31 else both & ((1 << bits) - 1)
        both >>= bits
        return both, place
    order = np.argsort(key, kind="stable")
    return key[order], order


def changes(key: np.ndarray) -> np.ndarray:
    """Whether each value differs from the one before."""
    out = np.ones(len(key), bool)
    out[1:] = key[1:] != key[:-1]
    return out


def pairs_of(n: np.ndarray, lang: np.ndarray, codes: np.ndarray, others: int, langs: int, width: int) -> Pairs:
    """All pairs with another word, in order of context, kind and event."""
    symbols = langs * width
    end = (lang * width + width - 1).astype(np.int32)
    line = np.insert(codes.astype(np.int32), np.cumsum(n), end)
    before = np.empty_like(line)
    before[1:] = line[:-1]
    before[np.cumsum(n + 1) - (n + 1)] = end
    text = np.repeat(np.arange(len(n), dtype=np.int32), n + 1)
    at = np.flatnonzero((before >= symbols) | (line >= symbols)).astype(np.int32)
    v, w = before[at], line[at]
    after = v >= symbols
    span = 2 * symbols + others
    key = (np.where(after, v, w) - symbols).astype(np.int64) * span
    key += np.where(after, np.where(w < symbols, w, w + symbols), v + symbols)
    key, by = in_order(key, others * span)
    at = at[by]
    del v, w, after, by
    new = changes(key)
    entry = np.flatnonzero(new | changes(text[at])).astype(np.int32)
    own = np.diff(np.append(entry, len(key))).astype(np.int32)
    pair = np.cumsum(new, dtype=np.int32)[entry] - 1
    key = key[new]
    context = (key // span).astype(np.int32)
    event = (key - context.astype(np.int64) * span).astype(np.int32)
    kind = np.where(event < symbols, AFTER, np.where(event < 2 * symbols, BEFORE, OTHER)).astype(np.int8)
    event[kind != AFTER] -= symbols
    return Pairs(line, before, text, context, kind, event, pair, at[entry], own)


def side_of(pairs: Pairs) -> np.ndarray:
    """Of each entry a number for its context and whether the word is before it."""
    return (2 * pairs.context + (pairs.kind == BEFORE))[pairs.pair]


def _two(x: np.ndarray) -> list[np.ndarray]:
    return [(x & 255).astype(np.uint8), (x >> 8).astype(np.uint8)]


#: Counts are kept as their bytes in order of weight: most are small.
PLANES = (np.uint8, np.uint8, np.uint16, np.uint32)


def _planes(x: np.ndarray) -> list[np.ndarray]:
    return [(x >> shift).astype(kind) for shift, kind in zip((0, 8, 16, 32), PLANES)]


def _joined(planes: list[np.ndarray]) -> np.ndarray:
    out = planes[0].astype(np.int64)
    for plane, shift in zip(planes[1:], (8, 16, 32)):
        out |= plane.astype(np.int64) << shift
    return out


def _emit(number: int, texts: Texts, buckets: int, width: int) -> pa.RecordBatch:
    from pyspark import TaskContext
    others, langs = len(texts.hashes), int(texts.lang.max(initial=-1)) + 1
    symbols = langs * width
    got = pairs_of(texts.n, texts.lang, texts.codes, others, langs, width)
    many = np.bincount(got.pair, weights=got.own, minlength=len(got.context)).astype(np.int64)
    edges = np.searchsorted((texts.hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32), np.arange(buckets + 1, dtype=np.uint64))
    at = np.searchsorted(got.context, edges)
    short = texts.hashes >> np.uint64(64 - CONTEXT_BITS)
    sizes = np.bincount(got.context * np.int64(3) + got.kind, minlength=3 * others).reshape(-1, 3)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, texts.rows.schema) as out:
        out.write_table(texts.rows)
    known = texts.codes < symbols
    symbol = (texts.codes - np.repeat(texts.lang, texts.n) * width)[known]
    payload = pack(np.frombuffer(sink.getvalue(), np.uint8), np.diff(edges).astype(np.uint32), texts.n.astype(np.uint32),
                   texts.lang.astype(np.uint32), texts.group.astype(np.uint8), np.packbits(known), *_two(symbol),
                   *dictionary._planes(texts.codes[~known] - symbols))
    digest = xxhash.xxh64(payload, seed=TaskContext.get().partitionId())
    digest.update(np.array([number]).tobytes())
    chunk = digest.intdigest() >> 1 | 1 << 62
    homes, numbers, payloads = [chunk], [DOCS], [payload]
    for b in np.flatnonzero(np.diff(edges)).tolist():
        contexts, pairs = slice(edges[b], edges[b + 1]), slice(at[b], at[b + 1])
        gap = np.diff(short[contexts], prepend=np.uint64(0))
        other = got.kind[pairs] == OTHER
        event = got.event[pairs]
        word = texts.hashes[event[other] - symbols] >> np.uint64(64 - WORD_BITS)
        homes.append(b)
        numbers.append(b)
        payloads.append(pack(gap.astype(np.uint32), (gap >> np.uint64(32)).astype(np.uint16),
                             *_planes(sizes[contexts].T.ravel()), *_two(event[~other] % width),
                             word.astype(np.uint32), (word >> np.uint64(32)).astype(np.uint8), *_planes(many[pairs])))
    return pa.RecordBatch.from_arrays([pa.array(homes, pa.int64()), pa.array([chunk] * len(homes), pa.int64()),
                                       pa.array(numbers, pa.int32()), pa.array(payloads, pa.binary())],
                                      names=["home", "chunk", "bucket", "payload"])


def deal(docs: DataFrame, read: Callable, width: int) -> DataFrame:
    """The exchange's rows.  ``read(rows)`` turns a chunk's rows of ``docs`` (a
    table with a column ``text``) into ``Texts``."""
    n = dictionary.buckets(docs.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]):
        held, size, number = [], 0, 0
        for batch in batches:
            at = 0
            for part in steps(batch.column("text")):
                held.append(batch.slice(at, len(part)))
                at += len(part)
                size += part.nbytes
                if size >= CHUNK_BYTES:
                    yield _emit(number, read(pa.Table.from_batches(held)), n, width)
                    held, size, number = [], 0, number + 1
        if held:
            yield _emit(number, read(pa.Table.from_batches(held)), n, width)

    return docs.mapInArrow(run, SCHEMA).repartition(n // 2, "home")


def _neighbours(blob: bytes) -> tuple[np.ndarray, ...]:
    """Of a chunk's part of a bucket: its contexts, the context and the kind of
    each pair, a number for the word beside it, occurrences."""
    low, high, *rest = unpack(blob, np.uint32, np.uint16, *PLANES, np.uint8, np.uint8, np.uint32, np.uint8, *PLANES)
    sizes, (s0, s1, w0, w1), many = _joined(rest[:4]), rest[4:8], _joined(rest[8:])
    contexts = np.cumsum(low.astype(np.uint64) | high.astype(np.uint64) << np.uint64(32), dtype=np.uint64)
    sizes = sizes.reshape(3, -1).T.ravel()
    kind = np.repeat(np.tile(np.arange(3, dtype=np.uint64), len(contexts)), sizes)
    event = np.empty(len(many), np.uint64)
    event[kind < OTHER] = s0 | s1.astype(np.uint64) << np.uint64(8)
    event[kind == OTHER] = w0 | w1.astype(np.uint64) << np.uint64(32)
    return contexts, np.repeat(np.repeat(np.arange(len(contexts)), 3), sizes), kind, event, many


def answers(dealt: DataFrame) -> DataFrame:
    """To each chunk, bucket by bucket: of its contexts how often they occur with
    a pair after and before them and how many of these pairs occur once, and the
    occurrences of its pairs."""
    def run(key, table):
        rows = [(c, b, p) for c, b, p in zip(table["chunk"].to_pylist(), table["bucket"].to_pylist(),
                                             table["payload"].to_pylist()) if b != DOCS]
        if not rows:
            return empty
        parts = [_neighbours(p) for _, _, p in rows]
        every = np.concatenate([p[0] for p in parts])
        starts = np.cumsum([0, *[len(p[0]) for p in parts]])
        contexts, which = np.unique(every, return_inverse=True)
        place = np.concatenate([p[1] + s for p, s in zip(parts, starts)])
        kind, event, many = (np.concatenate([p[k] for p in parts]) for k in (2, 3, 4))
        _, first, pair = np.unique(mix64(every[place] ^ mix64(event << np.uint64(2) | kind)), return_index=True, return_inverse=True)
        n = np.bincount(pair, weights=many).astype(np.int64)
        side = 2 * which[place] + (kind == BEFORE)
        total = np.bincount(side, weights=many, minlength=2 * len(contexts)).astype(np.int64).reshape(-1, 2)
        once = np.bincount(side[first], weights=n == 1, minlength=2 * len(contexts)).astype(np.int64).reshape(-1, 2)
        n = n[pair]
        out, y = [], 0
        for x, part in zip(starts, parts):
            own = which[x:x + len(part[0])]
            more = n[y:y + len(part[4])] - part[4]  # elsewhere
            out.append(pack(*(x for values in (total[own].T.ravel(), once[own].T.ravel(), more) for x in _planes(values))))
            y += len(part[4])
        return pa.table([pa.array([c for c, _, _ in rows], pa.int64()), pa.array([b for _, b, _ in rows], pa.int32()),
                         pa.array(out, pa.binary())], names=["home", "bucket", "payload"])

    empty = _empty(BACK)
    return dealt.groupBy("home").applyInArrow(lambda k, t: run(k, t), BACK)


def assemble(dealt: DataFrame, back: DataFrame, width: int, build: Callable, schema: str) -> DataFrame:
    """Calls ``build(texts, pairs, counted)`` once for each chunk; it returns a
    table of ``schema``.  The texts have no hashes any more."""
    def run(key, chunk, got):
        docs = [p for b, p in zip(chunk["bucket"].to_pylist(), chunk["payload"].to_pylist()) if b == DOCS]
        if not docs and not len(got):
            return empty
        if len(docs) != 1:
            raise RuntimeError(f"{len(docs)} chunks under one id; run the query again")
        rows, held, n, lang, group, known, s0, s1, r0, r1, r2 = unpack(
            docs[0], np.uint8, np.uint32, np.uint32, np.uint32, np.uint8, np.uint8, np.uint8, np.uint8, np.uint8, np.uint8, np.uint16)
        n, lang = n.astype(np.int64), lang.astype(np.int64)
        langs = int(lang.max(initial=-1)) + 1
        known = np.unpackbits(known, count=int(n.sum())).astype(bool)
        codes = np.empty(len(known), np.int64)
        codes[known] = (s0 | s1.astype(np.int64) << 8) + (np.repeat(lang, n) * width)[known]
        codes[~known] = (r0 | r1.astype(np.int64) << 8 | r2.astype(np.int64) << 16) + langs * width
        pairs = pairs_of(n, lang, codes, len(group), langs, width)
        parts = dict(zip(got["bucket"].to_pylist(), got["payload"].to_pylist()))
        needed = np.flatnonzero(held).tolist()
        if len(parts) != len(got) or sorted(parts) != needed:
            raise RuntimeError("a chunk's answers do not match it; run the query again")
        found = [[np.zeros(0, np.int64)] for _ in range(3)]
        for b in needed:
            planes = unpack(parts[b], *PLANES * 3)
            total, once, more = (_joined(planes[k:k + 4]) for k in (0, 4, 8))
            for where, what in zip(found, (total.reshape(2, -1).T.ravel(), once.reshape(2, -1).T.ravel(), more)):
                where.append(what)
        total, once, count = (np.concatenate(x) for x in found)
        if len(total) != 2 * len(group) or len(count) != len(pairs.context):
            raise RuntimeError("a chunk's answers do not match it; run the query again")
        count += np.bincount(pairs.pair, weights=pairs.own, minlength=len(count)).astype(np.int64)
        side = side_of(pairs)
        event = np.ones(len(pairs.context), np.int64)
        other = pairs.kind == OTHER
        event[other] = total[2 * (pairs.event[other] - langs * width)]
        texts = Texts(pa.ipc.open_stream(pa.py_buffer(rows.tobytes())).read_all(), n, lang, codes, group.astype(np.int64), np.zeros(0, np.uint64))
        return build(texts, pairs, Counted(count[pairs.pair], total[side], once[side], event[pairs.pair]))

    empty = _empty(schema)
    return dealt.groupBy("home").cogroup(back.groupBy("home")).applyInArrow(lambda k, a, b: run(k, a, b), schema)


def _empty(schema: str) -> pa.Table:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string
    return to_arrow_schema(_parse_datatype_string(schema)).empty_table()
