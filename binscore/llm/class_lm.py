"""Language-model scores of class-based n-grams with exchange clustering.

* words are counted by the global distinct-word shuffle (``dictionary.py``):
  every word of the training texts, whatever its frequency.  Chunks (texts as
  word numbers) and buckets (distinct words) are written once as tables bucketed
  by their key, so that no later step shuffles them again;
* first classes come from a small table: its units are the ``TOP`` most
  frequent words, one unit for each of ``ENDINGS`` groups of word endings (all
  other words) and the end of a text; the exchange algorithm moves one unit at
  a time to the class with which the class bigram likelihood grows most;
* then every training word, whatever its frequency, is exchanged by its own
  bigrams.  A pass sends the words' classes to the chunks, where each word's
  neighbouring classes are counted (at most two numbers a class and word, no
  table of word pairs is ever made); the counts go to the words' buckets, where
  the words of one half (by a bit of the hash, the halves take turns) move to
  their best class, the others held.  Of all passes the classes with the largest
  likelihood are the model's;
* a word that no training text has takes the class of most words of its ending;
* P(word | previous) = P(class | previous class) P(word | class), the first
  smoothed with class unigrams, the second with 0.5 added to each count and to
  one unseen word per class; a text's score is the log10 of the product over
  its words and the end, which also stands before the first word.

The number of classes (``CLASSES``) and of passes (``PASSES``) are parameters of
the model; they leave no word out.

Defined results: a null or empty text is its end alone; without training texts
all counts are zero; rows that repeat a document count each; a null id's fold
is that of the empty text; an empty table gives no rows; whole texts are scored
whatever their length; equally likely classes: the first; other columns are not
read.
"""

from __future__ import annotations

import uuid
import zlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from binscore.llm import dictionary
from binscore.llm.common import fold, words
from binscore.llm.dictionary import pack, unpack
from binscore.session import scratch_dir

TOP, ENDINGS, CLASSES, PASSES = 1000, 256, 64, 6
BETA, ADD = 10.0, 0.5


def lower_words(data: np.ndarray, offs: np.ndarray):
    return words(data, offs, lower=True)


def ending(word: bytes) -> int:
    """Group of a word's last three bytes."""
    return zlib.crc32(word[-3:]) % ENDINGS


def sequence(units: np.ndarray, counts: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The texts' units one after another, each text closed by ``end``, and
    the unit before each (``end`` before a text)."""
    out = np.insert(units, np.cumsum(counts), end)
    before = np.concatenate([[end], out[:-1]]) if len(out) else out
    return out, before


# --- tables that later steps read without a shuffle ------------------------------

def hashes(distinct: pa.Array) -> np.ndarray:
    return dictionary.word_hash(*dictionary.binary_parts(distinct))


class Tables:
    """The chunks and buckets of a corpus, in the shared folder."""

    def __init__(self, dealt: DataFrame):
        """``dealt``: rows of ``dictionary.deal``."""
        self.spark = dealt.sparkSession
        self.parts = max(1, dictionary.buckets(self.spark) // 2)
        self.names: list[str] = []
        both = self._bucketed(dealt.withColumn("kind", (F.col("bucket") != dictionary.DOCS).cast("int")), "rows", ["kind"])
        self.chunks = both.where("kind = 0").select("home", "chunk", "bucket", "payload")
        buckets = both.where("kind = 1").select("home", "chunk", "payload")
        self.buckets = self._bucketed(buckets.groupBy("home").applyInArrow(_bucket, BUCKET), "buckets")

    def _bucketed(self, df: DataFrame, name: str, folders=()) -> DataFrame:
        table = f"class_lm_{name}_{uuid.uuid4().hex}"
        df.write.partitionBy(*folders).bucketBy(self.parts, "home").option("path", scratch_dir(self.spark, f"llm-{name}")).saveAsTable(table)
        self.names.append(table)
        return self.spark.table(table)

    def drop(self) -> None:
        """Takes the tables out of the catalog; their files go with the scratch folder."""
        for name in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


def written(df: DataFrame, name: str, before: str | None = None, folders=()) -> tuple[DataFrame, str]:
    """``df`` read back from the shared folder, and its path; the folder
    ``before`` is no longer needed and deleted."""
    spark = df.sparkSession
    path = scratch_dir(spark, f"llm-class-{name}")
    df.write.partitionBy(*folders).parquet(path)
    if before:
        at = spark._jvm.org.apache.hadoop.fs.Path(before)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    return spark.read.schema(df.schema).parquet(path), path


BUCKET = "home long, chunks binary, words binary"


def _bucket(key, table):
    """The bucket's chunk lists, as numbers of its distinct words, and the words'
    hashes, training counts and endings.  Chunks are in order of their id."""
    order = np.argsort(table["chunk"].to_numpy())
    chunks = table["chunk"].to_numpy()[order]
    blobs = table["payload"].to_pylist()
    parts = [unpack(blobs[i], np.uint32, np.uint8, np.uint32) for i in order]
    coded = pa.concat_arrays([dictionary.binary_array(d, n) for n, d, _ in parts]).dictionary_encode()
    codes, distinct = coded.indices.to_numpy(), coded.dictionary
    counts = np.bincount(codes, weights=np.concatenate([h for _, _, h in parts]), minlength=len(distinct)).astype(np.int64)
    endings = np.array([ending(w) for w in distinct.to_pylist()], np.int32)
    return pa.table([pa.array([key[0].as_py()], pa.int64()),
                     pa.array([pack(chunks, np.array([len(n) for n, _, _ in parts]), codes.astype(np.uint32))], pa.binary()),
                     pa.array([pack(hashes(distinct), counts, endings)], pa.binary())], names=["home", "chunks", "words"])


def _read_words(blob: bytes) -> list[np.ndarray]:
    """Hashes, training counts and endings."""
    return unpack(blob, np.uint64, np.int64, np.int32)


ANSWERS = "kind int, home long, bucket int, payload binary"
STATE, ANSWER = 0, 1


def _answers(home: int, chunks: bytes, state: bytes | None, *values: np.ndarray, numbered: bool = True) -> pa.Table:
    """To each chunk the values of its words (and, ``numbered``, its number among
    the bucket's chunks); and the bucket's own new state."""
    ids, lengths, codes = unpack(chunks, np.int64, np.int64, np.uint32)
    ends = np.concatenate([[0], np.cumsum(lengths)])
    kinds, homes, payloads = [], [], []
    if state is not None:
        kinds, homes, payloads = [STATE], [home], [state]
    for i, chunk in enumerate(ids.tolist()):
        own = codes[ends[i]:ends[i + 1]]
        kinds.append(ANSWER)
        homes.append(chunk)
        number = [np.full(len(own), i, np.int32)] if numbered else []
        payloads.append(pack(np.ones(len(own), np.uint32), *[v[own] for v in values], *number))
    return pa.table([pa.array(kinds, pa.int32()), pa.array(homes, pa.int64()), pa.array([home] * len(homes), pa.int32()),
                     pa.array(payloads, pa.binary())], names=["kind", "home", "bucket", "payload"])


#: What a chunk is sent for each of its words: class, bucket, the half it belongs
#: to, and the chunk's number in the bucket.
SENT = (np.uint16, np.int32, np.uint8, np.int32)


# --- exchange clustering --------------------------------------------------------

def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def exchange(bigrams: np.ndarray, fixed: int, classes: int = CLASSES, passes: int = PASSES) -> np.ndarray:
    """Class of each unit; unit ``fixed`` has the last class to itself."""
    b = bigrams.astype(np.float64)
    n_units = len(b)
    weight = b.sum(axis=0)
    order = np.argsort(-weight, kind="stable")
    order = order[order != fixed]
    free = max(classes - 1, 1)
    cls = np.empty(n_units, np.int64)
    cls[order] = np.arange(len(order)) % free
    cls[fixed] = free
    width = free + 1
    to_class = np.zeros((n_units, width))  # unit, class after it
    from_class = np.zeros((n_units, width))  # unit, class before it
    for c in range(width):
        to_class[:, c] = b[:, cls == c].sum(axis=1)
        from_class[:, c] = b[cls == c].sum(axis=0)
    table = np.zeros((width, width))
    np.add.at(table, cls, to_class)
    some = np.flatnonzero(weight[order])
    for _ in range(passes):
        moved = 0
        for u in order[some]:
            a, own = cls[u], b[u, u]
            right, left = to_class[u].copy(), from_class[u].copy()
            right[a] -= own
            left[a] -= own
            table[a] -= right
            table[:, a] -= left
            table[a, a] -= own
            rows, cols = table.sum(axis=1), table.sum(axis=0)
            gain = _xlogx(table + right) - _xlogx(table)
            gain_left = _xlogx(table.T + left) - _xlogx(table.T)
            corner = np.diag(table)
            value = (gain.sum(axis=1) - np.diag(gain) + gain_left.sum(axis=1) - np.diag(gain_left)
                     + _xlogx(corner + right + left + own) - _xlogx(corner)
                     - _xlogx(rows + right.sum() + own) + _xlogx(rows)
                     - _xlogx(cols + left.sum() + own) + _xlogx(cols))
            best = int(value[:free].argmax())
            if value[best] <= value[a] + 1e-9:
                best = a
            table[best] += right
            table[:, best] += left
            table[best, best] += own
            if best != a:
                moved += 1
                cls[u] = best
                to_class[:, a] -= b[:, u]
                to_class[:, best] += b[:, u]
                from_class[:, a] -= b[u]
                from_class[:, best] += b[u]
        if not moved:
            break
    return cls


def best_classes(table: np.ndarray, cls: np.ndarray, right: np.ndarray, left: np.ndarray, own: np.ndarray,
                 free: int) -> np.ndarray:
    """For each word, the other words held, the class below ``free`` with which
    the likelihood is largest: a word of class ``cls`` has ``right`` (``left``)
    of each class after (before) it, ``own`` of them itself."""
    every = np.arange(len(cls))
    right, left = right.astype(np.float64), left.astype(np.float64)
    right[every, cls] -= own
    left[every, cls] -= own
    corner = np.tile(np.diag(table), (len(cls), 1))  # word, class: without the word
    corner[every, cls] -= right[every, cls] + left[every, cls] + own
    value = _xlogx(corner + right + left + own[:, None]) - _xlogx(corner)
    for side, n, other in ((table.T, right, left), (table, left, right)):
        size = n.sum(axis=1) + own
        total = np.tile(side.sum(axis=0), (len(cls), 1))
        total[every, cls] -= size
        value -= _xlogx(total + size[:, None]) - _xlogx(total)
        word, near = np.nonzero(n)
        many, mine = n[word, near], cls[word]
        cell = side[near]  # word's neighbouring class, class
        same = np.flatnonzero(near == mine)
        cell[same] -= other[word[same]]
        cell[same, mine[same]] -= own[word[same]]
        cell[np.arange(len(word)), mine] -= many
        gain = _xlogx(cell + many[:, None]) - _xlogx(cell)
        gain[np.arange(len(word)), near] = 0
        some, begin = np.unique(word, return_index=True)
        if len(some):
            value[some] += np.add.reduceat(gain, begin, axis=0)
    best = value[:, :free].argmax(axis=1)
    return np.where(value[every, best] > value[every, cls] + 1e-9, best, cls)


def likelihood(table: np.ndarray) -> float:
    """Of the class bigrams, but for what no exchange changes."""
    return float(_xlogx(table).sum() - _xlogx(table.sum(axis=0)).sum() - _xlogx(table.sum(axis=1)).sum())


def pairs(codes: np.ndarray, counts: np.ndarray, weight: np.ndarray, cls: np.ndarray, end: int) -> tuple[np.ndarray, ...]:
    """The training texts' bigrams, as words (the end of a text: the number after
    the last word) and as classes: ``a, b, ca, cb``."""
    size = len(cls)
    now, before = sequence(codes, counts, size)
    on = np.repeat(weight != 0, counts + 1)
    now, before = now[on], before[on]
    named = np.append(cls.astype(np.int64), end)
    return before, now, named[before], named[now]


def cells(ca: np.ndarray, cb: np.ndarray, width: int) -> list[dict]:
    cell, n = np.unique(ca * width + cb, return_counts=True)
    return [{"a": int(x) // width, "b": int(x) % width, "n": int(k)} for x, k in zip(cell, n)]


SUMS = "home long, chunk int, payload binary, cells array<struct<a: int, b: int, n: bigint>>"


def _neighbour_sums(width: int, half: int | None):
    """For ``assemble``: a chunk's class bigrams, and for each bucket its words'
    numbers of neighbours by side and class (side 2: with itself).  ``half``: the
    words that move next, None if there is no next move."""
    end = width - 1

    def build(ids, counts, weight, codes, ends, cls, bucket, bit, number):
        a, b, ca, cb = pairs(codes, counts, weight, cls, end)
        size = len(cls)
        homes, numbers, payloads, all_cells = [-1], [None], [None], [cells(ca, cb, width)]
        if half is not None and size:
            moves = np.append(bit == half, False)
            found = []
            for side, word, near in ((0, a, cb), (1, b, ca)):
                on = moves[word]
                key, n = np.unique((word[on] * 3 + side) * width + near[on], return_counts=True)
                found.append((key, n))
            on = (a == b) & moves[a]
            key, n = np.unique((a[on] * 3 + 2) * width, return_counts=True)
            found.append((key, n))
            key, n = (np.concatenate(x) for x in zip(*found))
            # a word's place in its bucket's list of this chunk
            by_bucket = np.argsort(bucket, kind="stable")
            first = np.searchsorted(bucket[by_bucket], bucket[by_bucket])
            place = np.empty(size, np.int64)
            place[by_bucket] = np.arange(size) - first
            word = key // (3 * width)
            order = np.lexsort((key, bucket[word]))
            key, n, word = key[order], n[order], word[order]
            homes_of = bucket[word]
            cut = np.concatenate([[0], np.flatnonzero(np.diff(homes_of)) + 1, [len(homes_of)]]) if len(homes_of) else [0]
            for x, y in zip(cut[:-1], cut[1:]):
                homes.append(int(homes_of[x]))
                numbers.append(int(number[word[x]]))
                payloads.append(pack(place[word[x:y]].astype(np.uint32), (key[x:y] % (3 * width)).astype(np.uint16), n[x:y].astype(np.uint32)))
                all_cells.append([])
        return pa.table([pa.array(homes, pa.int64()), pa.array(numbers, pa.int32()), pa.array(payloads, pa.binary()),
                         pa.array(all_cells, pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("n", pa.int64())])))],
                        names=["home", "chunk", "payload", "cells"])
    return build


def chunk_sums(tables: Tables, answers: DataFrame, width: int, half: int | None) -> DataFrame:
    """``home, chunk, payload, cells`` of all chunks."""
    build = _neighbour_sums(width, half)
    back = answers.where(F.col("kind") == ANSWER).select("home", "bucket", "payload")
    return dictionary.assemble(tables.chunks, back, SENT, build, SUMS)


def class_table(sums: DataFrame, width: int) -> np.ndarray:
    """Class bigrams of all chunks: at most ``width`` squared rows reach the driver."""
    out = np.zeros((width, width))
    for r in sums.select(F.inline("cells")).groupBy("a", "b").agg(F.sum("n").alias("n")).toLocalIterator():
        out[r["a"], r["b"]] = r["n"]
    return out


def _moved(table: np.ndarray, half: int):
    """cogroup of a bucket with its state and its sums: new state and answers."""
    free = len(table) - 1
    width = len(table)

    def run(key, bucket, side):
        if not len(bucket):
            return EMPTY_ANSWERS
        h, _, _ = _read_words(bucket["words"][0].as_py())
        _, lengths, codes = unpack(bucket["chunks"][0].as_py(), np.int64, np.int64, np.uint32)
        ends = np.concatenate([[0], np.cumsum(lengths)])
        cls, word, kind, n = None, [], [], []
        for chunk, blob in zip(side["chunk"].to_pylist(), side["payload"].to_pylist()):
            if chunk is None:
                cls = unpack(blob, np.uint16)[0].astype(np.int64)
                continue
            place, what, many = unpack(blob, np.uint32, np.uint16, np.uint32)
            word.append(codes[ends[chunk]:ends[chunk + 1]][place].astype(np.int64))
            kind.append(what.astype(np.int64))
            n.append(many.astype(np.int64))
        cls = cls.copy()
        if word:
            word, kind, n = (np.concatenate(x) for x in (word, kind, n))
            key_, back = np.unique(word * (3 * width) + kind, return_inverse=True)
            n = np.bincount(back, weights=n)
            word, kind = key_ // (3 * width), key_ % (3 * width)
            mine = np.unique(word)
            first = np.searchsorted(word, mine)
            for i in range(0, len(mine), 256):
                now = mine[i:i + 256]
                x, y = first[i], first[i + 256] if i + 256 < len(mine) else len(word)
                counts = np.zeros((3, len(now), width))
                counts[kind[x:y] // width, np.searchsorted(now, word[x:y]), kind[x:y] % width] = n[x:y]
                cls[now] = best_classes(table, cls[now], counts[0], counts[1], counts[2, :, 0], free)
        return _send(key[0].as_py(), bucket["chunks"][0].as_py(), h, cls)

    return run


def _send(home: int, chunks: bytes, h: np.ndarray, cls: np.ndarray) -> pa.Table:
    return _answers(home, chunks, pack(cls.astype(np.uint16)), cls.astype(np.uint16), np.full(len(cls), home, np.int32),
                    (h & np.uint64(1)).astype(np.uint8))


EMPTY_ANSWERS = pa.table([pa.array([], t) for t in (pa.int32(), pa.int64(), pa.int32(), pa.binary())],
                         names=["kind", "home", "bucket", "payload"])


def _first_classes(of_unit: np.ndarray | None, units: dict[int, dict[int, int]], top: int):
    """applyInArrow over buckets: each word's unit, or the class of its unit."""
    def run(key, bucket):
        home = key[0].as_py()
        h, _, endings = _read_words(bucket["words"][0].as_py())
        unit = endings.astype(np.int64) + top
        own = units.get(home, {})
        if own:
            place = {int(x): i for i, x in enumerate(h.view(np.int64).tolist()) if int(x) in own}
            for word, i in place.items():
                unit[i] = own[word]
        return _send(home, bucket["chunks"][0].as_py(), h, unit if of_unit is None else of_unit[unit])
    return run


def frequent_words(tables: Tables, n: int) -> list[tuple[int, int]]:
    """``home, hash`` of the ``n`` most frequent training words: a top-k.  How
    many words have at least 2^k occurrences is counted first, so that buckets
    send only words that can be among them."""
    def sizes(batches):
        total = np.zeros(64, np.int64)
        for batch in batches:
            for blob in batch.column("words").to_pylist():
                counts = _read_words(blob)[1]
                total += np.bincount(np.frexp(counts[counts > 0].astype(float))[1], minlength=64)
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.int64()))], names=["n"])

    table = tables.buckets.select("words").mapInArrow(sizes, "n array<bigint>")
    found = {r.k: r.n for r in table.select(F.posexplode("n").alias("k", "n")).groupBy("k").agg(F.sum("n").alias("n")).collect()}
    least, seen = 1, 0
    for k in reversed(range(1, 64)):
        seen += found.get(k, 0)
        if seen >= n:
            least = 1 << (k - 1)
            break

    def listed(batches):
        for batch in batches:
            for home, blob in zip(batch.column("home").to_pylist(), batch.column("words").to_pylist()):
                h, counts, _ = _read_words(blob)
                at = np.flatnonzero(counts >= least)
                at = at[np.lexsort((h.view(np.int64)[at], -counts[at]))][:n]
                yield pa.RecordBatch.from_arrays([pa.array([home] * len(at), pa.int64()), pa.array(h.view(np.int64)[at]),
                                                  pa.array(counts[at])], names=["home", "word", "n"])
    rows = tables.buckets.select("home", "words").mapInArrow(listed, "home long, word long, n long")
    return [(r.home, r.word) for r in rows.orderBy(F.col("n").desc(), "word").limit(n).collect()]


def exchange_words(tables: Tables, answers: DataFrame, path: str, width: int, passes: int = PASSES) -> tuple[DataFrame, np.ndarray]:
    """The best state found from ``answers`` on (kept at ``path``), and its class
    bigrams.  A pass deletes what only the pass before needed."""
    best, kept, last = None, None, None
    for k in range(passes + 1):
        half = k % 2 if k < passes else None
        sums, last = written(chunk_sums(tables, answers, width, half), f"sums-{k}", last)
        table = class_table(sums, width)
        old = path
        if best is None or likelihood(table) > likelihood(best[1]):
            best, kept, old = (answers, table), path, kept
        elif path == kept:
            old = None
        if k < passes:
            state = answers.where(F.col("kind") == STATE).select("home", F.lit(None).cast("int").alias("chunk"), "payload")
            side = state.unionByName(sums.where("home >= 0").select("home", "chunk", "payload"))
            moved = tables.buckets.groupBy("home").cogroup(side.groupBy("home")).applyInArrow(_moved(table, half), ANSWERS)
            answers, path = written(moved, f"state-{k}", old, ["kind"])
    return best


class Model:
    """Classes' transitions and sizes, and the class of each group of endings;
    bounded by the numbers of classes and endings."""

    def __init__(self, table: np.ndarray, distinct: np.ndarray, endings: np.ndarray, n_train: int):
        width = len(table)
        self.end, self.endings = width - 1, endings
        self.size = table.sum(axis=0)
        self.total = int(table.sum())
        share = (self.size + 1) / (self.size.sum() + width)
        self.step = np.log10((table + BETA * share) / (table.sum(axis=1, keepdims=True) + BETA))
        self.distinct = distinct
        self.vocabulary = int(distinct.sum())
        self.n_train = n_train


def word_classes(tables: Tables, state: DataFrame) -> DataFrame:
    """``home, word, n, ending, cls`` of every word, ``word`` its hash."""
    def flat(key, bucket, side):
        if not len(bucket):
            return pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32())],
                            names=["home", "word", "n", "ending", "cls"])
        h, counts, endings = _read_words(bucket["words"][0].as_py())
        cls = unpack(side["payload"][0].as_py(), np.uint16)[0]
        return pa.table([pa.array([key[0].as_py()] * len(h), pa.int64()), pa.array(h.view(np.int64)), pa.array(counts), pa.array(endings),
                         pa.array(cls.astype(np.int32))], names=["home", "word", "n", "ending", "cls"])
    own = state.where(F.col("kind") == STATE).select("home", "payload")
    return tables.buckets.groupBy("home").cogroup(own.groupBy("home")).applyInArrow(flat, "home long, word long, n long, ending int, cls int")


def fit(tables: Tables, n_train: int) -> tuple[Model, DataFrame]:
    """The model of ``n_train`` training texts, and the state of its classes."""
    top = frequent_words(tables, TOP)
    units: dict[int, dict[int, int]] = {}
    for place, (home, word) in enumerate(top):
        units.setdefault(home, {})[word] = place
    last = len(top) + ENDINGS
    named = partial(_first_classes, units=units, top=len(top))
    by_bucket = tables.buckets.groupBy("home")
    first_units, path = written(by_bucket.applyInArrow(named(None), ANSWERS), "units", None, ["kind"])
    sums, sums_path = written(chunk_sums(tables, first_units, last + 1, None), "units-sums", None)
    first = exchange(class_table(sums, last + 1).astype(np.int64), last)
    width = int(first[last]) + 1
    classes, path = written(by_bucket.applyInArrow(named(first), ANSWERS), "classes", path, ["kind"])
    state, table = exchange_words(tables, classes, path, width)
    share = np.zeros((ENDINGS, width))
    known = word_classes(tables, state).where("n > 0").groupBy("ending", "cls").count()
    for r in known.toLocalIterator():  # at most ENDINGS x classes rows
        share[r["ending"], r["cls"]] = r["count"]
    distinct = share.sum(axis=0)
    distinct[-1] = 1 if n_train else 0
    endings = np.where(share.any(axis=1), share.argmax(axis=1), first[len(top):last])
    return Model(table, distinct, endings, n_train), state


def train(docs: DataFrame, dealt: DataFrame) -> tuple[Model, DataFrame]:
    """The model of the texts whose ``weight`` is 1, and ``home, word, cls`` of
    all their words."""
    tables = Tables(dealt)
    model, state = fit(tables, int(docs.agg(F.sum("weight")).first()[0] or 0))
    found, _ = written(word_classes(tables, state).where("n > 0").select("home", "word", "cls"), "found")
    tables.drop()
    return model, found


def _final_answers(sent):
    """cogroup of a bucket with its state: to each chunk its words' training
    counts and classes."""
    def run(key, bucket, side):
        if not len(bucket):
            return EMPTY_ANSWERS.drop_columns(["kind"])
        _, counts, endings = _read_words(bucket["words"][0].as_py())
        cls = unpack(side["payload"][0].as_py(), np.uint16)[0].copy()
        new = counts == 0
        cls[new] = sent.value.endings[endings[new]]
        return _answers(key[0].as_py(), bucket["chunks"][0].as_py(), None, counts, cls, numbered=False).drop_columns(["kind"])
    return run


def score_documents(docs: DataFrame, held: int = 1) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``
    of every row; the texts of fold ``held`` are not learnt from."""
    rows = docs.select("doc_id", "text", (fold(F.col("doc_id")) != held).cast("byte").alias("weight"))
    tables = Tables(dictionary.deal(rows, lower_words))
    model, state = fit(tables, int(rows.agg(F.sum("weight")).first()[0] or 0))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def build(ids, counts, weight, codes, ends, n, cls):
        m = sent.value
        c = n[codes].astype(np.float64)
        k = cls[codes].astype(np.int64)
        now, before = sequence(k, counts, m.end)
        seen = np.insert(c, np.cumsum(counts), m.n_train)
        base = np.log10((seen + ADD) / (m.total + ADD * (m.vocabulary + 1)))
        score = np.log10((seen + ADD) / (m.size[now] + ADD * (m.distinct[now] + 1))) + m.step[before, now]
        first = np.concatenate([[0], np.cumsum(counts + 1)])

        def per_text(x):
            return np.add.reduceat(x, first[:-1]) if len(counts) else np.zeros(0)

        return pa.table([ids, pa.array(weight == 0), pa.array(counts + 1, pa.int64()),
                         pa.array(per_text((seen > 0).astype(np.int64)), pa.int64()),
                         pa.array(np.full(len(counts), m.total), pa.int64()), pa.array(per_text(base), pa.float64()),
                         pa.array(per_text(score), pa.float64())],
                        names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    own = state.where(F.col("kind") == STATE).select("home", "payload")
    back = tables.buckets.groupBy("home").cogroup(own.groupBy("home")).applyInArrow(_final_answers(sent), dictionary.BACK)
    scored, _ = written(dictionary.assemble(tables.chunks, back, (np.int64, np.uint16), build,
                                            "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
                                            "base_score double, score double"), "scores")
    tables.drop()
    return scored
