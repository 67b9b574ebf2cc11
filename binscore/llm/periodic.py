"""Periodic run detection by string synchronising sets over words.

A run is a stretch of words with smallest period q and length at least
``max(MIN_LENGTH, MIN_EXPONENT * q)`` that neither neighbour extends.

All texts of a step are one array of word codes, each text closed by a code of
its own, so that no two equal windows reach over a text's edge.

* Periods below ``SMALL`` are read off directly: stretches in which word i
  equals word i + q.
* At each scale tau = SMALL, 2 SMALL, ... a synchronising set is selected:
  place i is in it if the least hash of a tau-window beginning in [i, i + tau]
  is that at i or at i + tau.  Windows with a period of at most tau/4 (the highly
  periodic regions) do not take part, or the set would be dense in them; the
  runs found at smaller scales tell where they are, and supply their periods.
  Selection depends on the 2 tau words from i alone, so it agrees wherever the
  text repeats, and of tau places in a row one is selected unless their
  surroundings are highly periodic.  A run with period q in [tau, 2 tau) and
  four periods or more therefore has selected places i and i + q with equal
  contexts of 2 tau words, next to each other among the places with that context:
  such neighbours propose the period q.
* Proposals are joined, compared word by word and extended to both sides.

Window hashes are made by doubling (a window's hash mixes those of its halves);
codes are exact, and every run is confirmed by its words.

A text is handled in the task that reads it: nothing is shuffled.  Memory is
that of one step (``STEP_BYTES`` of text, or one text if it is longer: about 60
bytes a word).

Defined results: a null or empty text has no words and no runs, and collapses
to the empty text; repeated rows are each analysed; a null id stays null; an
empty table gives no rows; whole texts are compared whatever their length; of
equal stretches the smallest period counts; other columns are carried along,
those named ``runs`` or ``collapsed`` are replaced.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from binscore.llm.common import mix64, steps, text_buffer, words
from binscore.llm.dictionary import binary_parts, take_lists

MIN_LENGTH, MIN_EXPONENT = 6, 4
#: Periods below are read off directly; the first scale.
SMALL = 8
TOP = np.uint64(2**64 - 1)
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def stretches(same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the maximal stretches of true places."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], same, [False]])))
    return edge[::2], edge[1::2]


def sliding_minimum(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each ``w`` values in a row, by prefix and suffix minima of blocks."""
    n = len(x) - w + 1
    padded = np.full(-(-len(x) // w) * w, TOP, np.uint64)
    padded[:len(x)] = x
    blocks = padded.reshape(-1, w)
    before = np.minimum.accumulate(blocks, axis=1).ravel()
    after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[:n], before[w - 1:w - 1 + n])


def doubled(h: np.ndarray, w: int) -> np.ndarray:
    """Hashes of windows of 2w words from those of w words."""
    return mix64(h[:-w] * np.uint64(0x9E3779B97F4A7C15) + (h[w:] ^ np.uint64(0xD1B54A32D192ED03)))


def synchronising_set(h: np.ndarray, tau: int, periodic: np.ndarray) -> np.ndarray:
    """Selected places, ascending; ``h``: hashes of tau-windows, ``periodic``:
    windows that do not take part."""
    ids = np.where(periodic, TOP, h)
    least = sliding_minimum(ids, tau + 1)
    return np.flatnonzero(((least == ids[:len(least)]) | (least == ids[tau:])) & (least != TOP))


def equal_contexts(context: np.ndarray, at: np.ndarray, tau: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and distances of neighbours with one context, at least tau and
    less than 2 tau apart."""
    order = np.argsort(context[at], kind="stable")
    place, name = at[order], context[at][order]
    gap = np.diff(place)
    hit = np.flatnonzero((name[1:] == name[:-1]) & (gap >= tau) & (gap < 2 * tau))
    return place[hit], gap[hit]


def joined(place: np.ndarray, period: np.ndarray, width: int) -> list[tuple[int, int, int]]:
    """Proposals of one period whose stretches ``[place, place + width)`` touch,
    as one ``(begin, end, period)``: there word i should equal word i + period."""
    order = np.lexsort((place, period))
    p, q = place[order], period[order]
    new = np.append(True, (q[1:] != q[:-1]) | (np.diff(p) > width)) if len(p) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(p)) - 1
    return list(zip(p[first].tolist(), (p[last] + width).tolist(), q[first].tolist())) if len(first) else []


def _agree_right(t: np.ndarray, i: int, q: int) -> int:
    """First place from ``i`` on whose word differs from the one q later."""
    step = 64
    while True:
        end = min(i + step, len(t) - q)
        differ = np.flatnonzero(t[i:end] != t[i + q:end + q])
        if len(differ):
            return i + int(differ[0])
        if end == len(t) - q:
            return end
        i, step = end, 2 * step


def _agree_left(t: np.ndarray, i: int, q: int) -> int:
    """Begin of the stretch of such equal words that ends at ``i``."""
    step = 64
    while i > 0:
        begin = max(0, i - step)
        differ = np.flatnonzero(t[begin:i] != t[begin + q:i + q])
        if len(differ):
            return begin + int(differ[-1]) + 1
        i, step = begin, 2 * step
    return 0


def find(t: np.ndarray, first: np.ndarray) -> np.ndarray:
    """All runs of the texts ``t[first[i]:first[i + 1] - 1]``, each closed by a
    code that occurs once: rows ``start, end, period`` by start, then period."""
    found: dict[tuple[int, int], int] = {}

    def keep(s: int, e: int, q: int) -> None:
        if e - s >= max(MIN_LENGTH, MIN_EXPONENT * q):
            found[s, e] = min(q, found.get((s, e), q))

    for q in range(1, min(SMALL, len(t))):
        begin, end = stretches(t[:-q] == t[q:])
        long = end - begin + q >= max(MIN_LENGTH, MIN_EXPONENT * q)
        for s, e in zip(begin[long].tolist(), (end[long] + q).tolist()):
            keep(s, e, q)
    h, w = mix64(t.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)), 1
    size, place = np.diff(first), np.arange(len(t))
    tau = SMALL
    while True:
        # only texts that can hold four periods of tau words go on
        on = size > MIN_EXPONENT * tau
        if not on.any():
            break
        if not on.all():
            stay = np.repeat(on, size)
            place, h, size = place[stay], h[stay[:len(h)]], size[on]
        while w < tau:
            h, w = doubled(h, w), 2 * w
        n = len(h)
        change = np.zeros(n + 1, np.int64)
        known = np.array([(s, e) for (s, e), q in found.items() if MIN_EXPONENT * q <= tau <= e - s], np.int64).reshape(-1, 2)
        at = np.searchsorted(place, known[:, 0])
        here = place[np.minimum(at, len(place) - 1)] == known[:, 0]
        at, width = at[here], (known[:, 1] - known[:, 0])[here] - tau + 1
        np.add.at(change, np.minimum(at, n), 1)
        np.add.at(change, np.minimum(at + width, n), -1)
        if n <= 2 * tau:
            break
        at = synchronising_set(h, tau, np.cumsum(change[:n]) > 0)
        double = doubled(h, tau)
        i, q = equal_contexts(double, at[at < len(double)], tau)
        for begin, end, period in joined(place[i], q, 2 * tau):
            if (t[begin:end] == t[begin + period:end + period]).all():
                keep(_agree_left(t, begin, period), _agree_right(t, end, period) + period, period)
        h, w, tau = double, 2 * tau, 2 * tau
    out = np.array([(s, e, q) for (s, e), q in found.items()], np.int64).reshape(-1, 3)
    return out[np.lexsort((out[:, 2], out[:, 0]))]


def analyse(texts: pa.Array) -> pa.StructArray:
    """``runs`` (by start, then period) and ``collapsed`` of each text."""
    runs, kept = [pa.array([], pa.list_(RUN))], [pa.array([], pa.string())]
    for part in steps(texts):
        data, offs = text_buffer(part)
        found, first = words(data, offs)
        coded = found.dictionary_encode()
        n = np.diff(first)
        # a closing code after each text
        bounds = first + np.arange(len(first))
        t = np.empty(len(found) + len(n), np.int64)
        closing = bounds[1:] - 1
        inside = np.ones(len(t), bool)
        inside[closing] = False
        t[inside] = coded.indices.to_numpy()
        t[closing] = len(coded.dictionary) + np.arange(len(n))
        run = find(t, bounds)
        text = np.searchsorted(bounds, run[:, 0], side="right") - 1
        ends = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=len(n)))]).astype(np.int32)
        runs.append(pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(
            [pa.array(run[:, 0] - bounds[text]), pa.array(run[:, 1] - run[:, 0]), pa.array(run[:, 2])], fields=list(RUN))))
        drop = np.zeros(len(t) + 1, np.int64)
        np.add.at(drop, run[:, 0] + run[:, 2], 1)
        np.add.at(drop, run[:, 1], -1)
        kept.append(_joined_words(found, ~(np.cumsum(drop[:-1]) > 0)[inside], first))
    return pa.StructArray.from_arrays([pa.concat_arrays(runs), pa.concat_arrays(kept)], names=["runs", "collapsed"])


def _joined_words(found: pa.Array, keep: np.ndarray, first: np.ndarray) -> pa.Array:
    """The kept words of each text, joined by one space."""
    data, offs = binary_parts(found)
    at = np.flatnonzero(keep)
    inside, lengths = take_lists(offs, data, at)
    count = np.concatenate([[0], np.cumsum(keep)])[first]  # kept words before each text
    begin = np.cumsum(lengths + 1) - (lengths + 1)
    line = np.full(int(lengths.sum()) + len(at), 0x20, np.uint8)
    line[np.repeat(begin - (np.cumsum(lengths) - lengths), lengths) + np.arange(len(inside))] = inside
    edge = np.append(begin, len(line))[count]
    # the space after a text's last word goes
    last = edge[1:][np.diff(count) > 0] - 1
    stay = np.ones(len(line), bool)
    stay[last] = False
    ends = np.concatenate([[0], np.cumsum(np.diff(edge) - (np.diff(count) > 0))]).astype(np.int32)
    return pa.Array.from_buffers(pa.string(), len(first) - 1, [None, pa.py_buffer(ends), pa.py_buffer(line[stay])])


@functools.cache
def _analyser():
    @F.arrow_udf("runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string")
    def periodic(text: pa.Array) -> pa.Array:
        return analyse(text)
    return periodic


def find_runs(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``runs``, all runs of the text's words (first word's number,
    length, period), and ``collapsed``, the words outside of runs or within a
    run's first period, joined by spaces (dropped: those that any run contains
    after its first period)."""
    mine = ("runs", "collapsed")
    return (docs.select(*[c for c in docs.columns if c not in mine], _analyser()(F.col(text_col)).alias("_found"))
            .select(*[c for c in docs.columns if c not in mine], *[F.col(f"_found.{m}").alias(m) for m in mine]))


def digests(found: DataFrame) -> DataFrame:
    """``doc_id, n_runs``, the longest run (ties: smallest start, then period)
    and digests of all runs and of the collapsed text."""
    best = F.aggregate("runs", F.lit(None).cast("struct<start: bigint, length: bigint, period: bigint>"),
                       lambda a, r: F.when(a.isNull() | (r["length"] > a["length"]), r).otherwise(a))
    line = F.array_join(F.transform("runs", lambda r: F.concat(
        r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    return (found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("b"),
                         F.sha2(line, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
            .select("doc_id", "n_runs", "b.start", "b.length", "b.period",
                    F.expr("1000 * b.length div b.period").alias("exponent_milli"),
                    "runs_sha256", "collapsed_sha256"))


def with_periods(docs: DataFrame) -> DataFrame:
    """Input of the registered query: ``doc_id, text`` where the words of every
    document with crc32(id) % 10 = 0 repeat from word g % n on with a period of
    1 + (n - g % n) div (3 + g % 8), g = crc32(id) div 10."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    text = F.coalesce(F.col("text"), F.lit(""))
    repeat = (h % 10 == 0) & text.rlike(r"[^\x20\x09-\x0D]")
    some = docs.select("doc_id", text.alias("text"), F.when(repeat, F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
                       .alias("w"), F.floor(h / 10).cast("long").alias("g"))
    some = some.withColumn("n", F.size("w").cast("long")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    some = some.withColumn("p", F.lit(1) + F.floor((F.col("n") - F.col("a")) / (F.lit(3) + F.col("g") % 8)))
    turn = F.transform("w", lambda x, i: F.when(i < F.col("a"), x).otherwise(
        F.get("w", (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int"))))
    return some.select("doc_id", F.when(F.col("w").isNull(), F.col("text")).otherwise(F.array_join(turn, " ")).alias("text"))
