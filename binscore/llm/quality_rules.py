"""Quality rules: word and line rules, and n-gram perplexity bands.

Every language has two n-gram models with modified Kneser-Ney discounts, counted
by Spark over all its texts:

* of byte trigrams (lower case, one space after each word), interpolated with
  continuation counts, for how words are spelled.  A text's measure is that of its
  median word, per byte, so that a few odd words (a key, a name, a foreign line)
  do not decide.  A language's band is its median plus and minus ``WIDTH``
  robust standard deviations, which shrink with the root of the text's words
  up to ``FULL_WORDS``; texts outside are rejected;
* of word pairs, for their order, of all words in two steps.  The lower one has
  symbols: the language's ``FREQUENT`` most frequent words, ``ENDINGS`` groups of
  endings for all others, and a text's end.  The upper one has the pairs of the
  other words themselves, whatever their number: each such word's own counts of
  every word after it and of the frequent words before it.  They back off to the
  lower one by their share of words seen once there (Good-Turing).
  A text's measure is over all its words: their mean log perplexity given
  the word before, less that by their frequency alone.  The text's own pairs are
  taken out of the counts first, or every text would vouch for its own order.
  Words that are much less likely after each other than alone (``MARGIN``, over
  the root of the words up to ``FULL_WORDS``) are not in the order of their
  language, and the text is rejected.

N-grams of bytes and symbols are packed into one number and stored as sorted
arrays, looked up by binary search.  A language has at most 2^24 of bytes and
1,153^2 of symbols, whatever the corpus.  Their counts meet by language, are
written to the shared folder and read by the tasks when they meet the language.
Pairs of the other words grow with the corpus: they meet by the word, and each
text gets back the counts of its own (``pair_counts.py``).

Counts, medians and deviations are over all documents.

Defined results: a null text has no words; a null language is a language of
its own; a text without words has no perplexity and fails the base rules; an
empty table gives an empty result; repeated rows score alike; of equally
frequent words the first by bytes is taken; whole texts are measured whatever
their length; other columns are not read.
"""

from __future__ import annotations

import functools
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from binscore.llm import pair_counts
from binscore.llm.common import WHITE, mix64, runs, spaced, steps, text_buffer, words
from binscore.llm.dictionary import binary_parts, word_hash
from binscore.llm.textstats import text_stats
from binscore.session import cut_lineage, release_shuffles, scratch_dir
from binscore.sources.files import arrow_store

MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
WIDTH, FULL_WORDS = 4.0, 400
FREQUENT, ENDINGS, MARGIN = 1024, 128, 1.1
#: Symbols: words, endings, a text's end, which also stands before its first word.
END, SYMBOLS = FREQUENT + ENDINGS, FREQUENT + ENDINGS + 1
#: Symbols that are one word, or the end.
OWN = FREQUENT + 1
BYTES = 256
#: N-grams that a task counts before it sends their sums.
HELD = 1 << 22
#: Entries of a model's direct lookup at most (8 bytes each); others are searched.
DIRECT = 1 << 22
#: Log perplexities are counted in bins of this width for medians.
GRAIN = 0.0005


def trigrams(texts: pa.Array):
    """Packed byte trigrams of texts, part by part, with the first of each text
    (n+1 values).  A text begins after two spaces."""
    for part in steps(texts, 1 << 20):
        data, offs = text_buffer(part)
        inside = ~WHITE[data]
        starts, ends, first = runs(inside, offs)
        line, at = spaced(data, inside, starts, ends, first, lead=2)
        if not len(line):
            yield np.zeros(0, np.int32), np.zeros(len(offs), np.int64)
            continue
        b = line.astype(np.int32)
        key = b[:-2] << 16 | b[1:-1] << 8 | b[2:]
        sizes = np.bincount(np.repeat(np.arange(len(offs) - 1), np.diff(first)), weights=ends - starts + 1,
                            minlength=len(offs) - 1).astype(np.int64)
        total = sizes + 2 * (sizes > 0)
        edge = np.cumsum(total) - total  # a text's two leading spaces begin no trigram of it
        keep = np.ones(len(line), bool)
        keep[edge[sizes > 0]] = False
        keep[edge[sizes > 0] + 1] = False
        yield key[keep[2:]], np.concatenate([[0], np.cumsum(sizes)])


def _discounts(counts: np.ndarray) -> np.ndarray:
    """Discounts of counts 0, 1, 2 and 3 or more."""
    n = [max(int((counts == k).sum()), 1) for k in range(1, 5)]
    y = n[0] / (n[0] + 2 * n[1])
    d = [1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2]]
    return np.array([0.0, *[min(max(x, 0.1), k) for k, x in enumerate(d, 1)]])


def _level(context: np.ndarray, counts: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Interpolated probabilities of n-grams (sorted by context) and, for each
    distinct context, the weight it gives to the lower order."""
    d = _discounts(counts)
    cut = d[np.minimum(counts, 3)]
    ctx, back = np.unique(context, return_inverse=True)
    total = np.bincount(back, counts)
    weight = np.bincount(back, cut) / total
    return (counts - cut) / total[back] + weight[back] * lower, ctx, weight


class KneserNey:
    """A byte trigram model in sorted arrays; an n-gram is the number whose
    digits are its bytes."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, base: int = BYTES):
        order = np.argsort(keys)
        self.base = base
        self.keys3, counts = keys[order].astype(np.int32), counts[order].astype(np.int64)
        if not len(counts):
            self.keys3 = None
            return
        self.keys2, n2 = np.unique(self.keys3 % (base * base), return_counts=True)
        last, n1 = np.unique(self.keys2 % base, return_counts=True)
        d = _discounts(n1)
        cut = d[np.minimum(n1, 3)]
        self.p1 = np.full(base, cut.sum() / n1.sum() / base)
        self.p1[last] += (n1 - cut) / n1.sum()
        self.p2, ctx, weight = _level(self.keys2 // base, n2, self.p1[self.keys2 % base])
        self.w1 = np.ones(base)
        self.w1[ctx] = weight
        lower = self.p2[np.searchsorted(self.keys2, self.keys3 % (base * base))]
        p3, self.ctx2, self.w2 = _level(self.keys3 // base, counts, lower)
        self.log3 = np.log10(p3)
        # trigrams of the symbols in use by direct lookup, where their cube is small
        self.rank = np.zeros(base, np.int32)
        present = np.unique(np.concatenate([self.keys3 // (base * base), self.keys3 // base % base, self.keys3 % base]))
        self.size = len(present) + 1
        self.table = None
        if self.size ** 3 <= DIRECT:
            self.rank[present] = np.arange(1, self.size)
            self.table = np.full(self.size ** 3, np.nan)
            self.table[self._place(self.keys3)] = self.log3

    def _place(self, keys: np.ndarray) -> np.ndarray:
        base, rank, size = self.base, self.rank, self.size
        return (rank[keys // (base * base)] * size + rank[keys // base % base]) * size + rank[keys % base]

    def log10(self, keys: np.ndarray) -> np.ndarray:
        """log10 probability of each trigram's last symbol."""
        base = self.base
        if self.table is not None:
            out = self.table[self._place(keys)]
            miss = np.flatnonzero(np.isnan(out))
        else:
            at = np.minimum(np.searchsorted(self.keys3, keys), len(self.keys3) - 1)
            out = self.log3[at]
            miss = np.flatnonzero(self.keys3[at] != keys)
        if len(miss):
            k = keys[miss]
            two = k % (base * base)
            j = np.minimum(np.searchsorted(self.keys2, two), len(self.keys2) - 1)
            p = np.where(self.keys2[j] == two, self.p2[j], self.w1[two // base] * self.p1[two % base])
            c = np.minimum(np.searchsorted(self.ctx2, k // base), len(self.ctx2) - 1)
            out[miss] = np.log10(p * np.where(self.ctx2[c] == k // base, self.w2[c], 1.0))
        return out


def median_word(log10: np.ndarray, keys: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The median over each text's words (with the space that ends them) of
    log10 perplexity per byte; nan without words."""
    end = np.flatnonzero((keys & 0xFF) == 0x20) + 1
    begin = np.concatenate([[0], end[:-1]])
    total = np.concatenate([[0.0], np.cumsum(log10)])
    value = (total[begin] - total[end]) / (end - begin)
    edge = np.searchsorted(end, first, side="right")
    n = np.diff(edge)
    ordered = value[np.lexsort((value, np.repeat(np.arange(len(n)), n)))]
    out = np.full(len(n), np.nan)
    some = np.flatnonzero(n)
    low, high = edge[some] + (n[some] - 1) // 2, edge[some] + n[some] // 2
    out[some] = (ordered[low] + ordered[high]) / 2
    return out


# --- words as symbols -----------------------------------------------------------

def ending(word: bytes) -> int:
    return FREQUENT + zlib.crc32(word[-2:]) % ENDINGS


@functools.cache
def _endings() -> tuple[np.ndarray, np.ndarray]:
    """``ending`` of all words of one byte and of all last two bytes."""
    return (np.array([ending(bytes([a])) for a in range(256)]),
            np.array([ending(bytes([a, b])) for a in range(256) for b in range(256)]))


def symbols_of(distinct: pa.Array, frequent: dict[bytes, int]) -> np.ndarray:
    """The symbol of each word."""
    if not len(distinct):
        return np.zeros(0, np.int64)
    data, offs = binary_parts(distinct)
    last = data[offs[1:] - 1].astype(np.int64)
    one, two = _endings()
    symbol = np.where(np.diff(offs) > 1, two[data[np.maximum(offs[1:] - 2, 0)].astype(np.int64) << 8 | last], one[last])
    place = pyarrow.compute.index_in(distinct, pa.array(list(frequent), pa.binary()))
    known = np.flatnonzero(np.asarray(place.is_valid()))
    symbol[known] = np.array(list(frequent.values()), np.int64)[place.drop_null().to_numpy()]
    return symbol


def word_pairs(texts: pa.Array, frequent: dict[bytes, int]):
    """Packed pairs of symbols of texts, part by part, one for each word and the
    end, with the first of each text (n+1 values)."""
    for part in steps(texts):
        found, first = words(*text_buffer(part), lower=True)
        coded = found.dictionary_encode()
        line = symbols_of(coded.dictionary, frequent)[coded.indices.to_numpy()] if len(coded) else np.zeros(0, np.int64)
        line = np.insert(line, first[1:], END)
        before = np.concatenate([[END], line[:-1]])[:len(line)]
        yield (before * SYMBOLS + line).astype(np.int32), np.concatenate([[0], np.cumsum(np.diff(first) + 1)])


class WordOrder:
    """Pairs of symbols, scored without the scored text's own counts."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        before, word = keys // SYMBOLS, keys % SYMBOLS
        self.total = np.bincount(before, counts, SYMBOLS)
        d = _discounts(counts)
        self.discount = d
        self.left = np.bincount(before, d[np.minimum(counts, 3)], SYMBOLS)  # what the discounts leave over
        alone = np.bincount(word, counts, SYMBOLS) + 0.5
        self.words = np.bincount(word, counts, SYMBOLS)
        own = (before < FREQUENT) | (before == END)  # words with a symbol, and the end
        self.before = np.bincount(word[own], counts[own], SYMBOLS).astype(np.int64)
        self.first = (self.total + 0.5) / (self.total[:FREQUENT].sum() + self.total[END] + 0.5 * OWN)
        self.alone = alone / alone.sum()
        self.count = np.zeros(SYMBOLS * SYMBOLS, np.int32 if counts.max(initial=0) < 1 << 31 else np.int64)
        self.count[keys] = counts

    def given(self, keys: np.ndarray, text: np.ndarray, n_texts: int) -> tuple[np.ndarray, np.ndarray]:
        """The probability of each pair's last symbol given the one before, by the
        counts of all other texts, and its count there; ``text`` is the pair's text."""
        before, word = keys // SYMBOLS, keys % SYMBOLS
        n = self.count[keys] - _own(text, keys, n_texts, SYMBOLS * SYMBOLS)
        total = self.total[before] - _own(text, before, n_texts, SYMBOLS)
        rest = np.where(total > 0, np.minimum(self.left[before] / np.maximum(total, 1), 1.0), 1.0)
        return np.maximum(n - self.discount[np.minimum(n, 3)], 0) / np.maximum(total, 1) + rest * self.alone[word], n

    def share_before(self, keys: np.ndarray, n: np.ndarray, text: np.ndarray, n_texts: int) -> np.ndarray:
        """Of pairs of a word (or the end) and an ending, all there are in the texts:
        the share of the word among all words with a symbol before that ending, by
        the counts ``n`` of all other texts, one added by frequency alone."""
        before, word = keys // SYMBOLS, keys % SYMBOLS
        total = self.before[word] - _own(text, word, n_texts, SYMBOLS)
        return (n + self.first[before]) / (total + 1)

    def gain(self, keys: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Of each text the mean over its words and end of log10 perplexity given
        the word before, less that by frequency alone."""
        n = np.diff(first)
        text = np.repeat(np.arange(len(n)), n)
        p, _ = self.given(keys, text, len(n))
        return np.bincount(text, np.log10(self.alone[keys % SYMBOLS]) - np.log10(p), len(n)) / n


def _own(text: np.ndarray, x: np.ndarray, n_texts: int, width: int) -> np.ndarray:
    """How often each value (below ``width``) is in its text."""
    x = text.astype(np.int64) * width + x
    if n_texts * width <= 4 * len(x):
        return np.bincount(x, minlength=n_texts * width)[x]
    ordered, order = pair_counts.in_order(x, n_texts * width)
    begin = np.flatnonzero(pair_counts.changes(ordered))
    many = np.diff(np.append(begin, len(x))).astype(np.int32)
    n = np.empty(len(x), np.int32)
    n[order] = np.repeat(many, many)
    return n


# --- pairs of all words ------------------------------------------------------------

def as_numbers(texts: pa.Array, frequent: dict[bytes, int], lang: str) -> tuple[np.ndarray, ...]:
    """Words of each text; of each word its symbol, or past the symbols the rank of
    the other word by its hash; these words' endings and hashes."""
    found, first = words(*text_buffer(texts), lower=True)
    coded = found.dictionary_encode()
    number = symbols_of(coded.dictionary, frequent)
    rare = np.flatnonzero(number >= FREQUENT)
    seed = np.uint64(xxhash.xxh64(lang.encode()).intdigest())
    hashes = mix64(word_hash(*binary_parts(coded.dictionary.take(pa.array(rare)))) ^ seed) if len(rare) else np.zeros(0, np.uint64)
    order = np.argsort(hashes)
    group = number[rare[order]] - FREQUENT
    number[rare[order]] = OWN + np.arange(len(rare))
    return np.diff(first), number[coded.indices.to_numpy()] if len(coded) else np.zeros(0, np.int64), group, hashes[order]


def together(rows: pa.Table, parts: list[tuple[np.ndarray, ...]]) -> pair_counts.Texts:
    """Languages' ``as_numbers`` as one, ``rows`` being in their order."""
    n, codes, group, hashes = ([p[k] for p in parts] for k in range(4))
    order = np.argsort(np.concatenate(hashes), kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    edges = np.cumsum([0, *map(len, hashes)])
    numbers = [np.concatenate([k * OWN + np.arange(OWN), len(parts) * OWN + rank[edges[k]:edges[k + 1]]]) for k in range(len(parts))]
    return pair_counts.Texts(rows, np.concatenate(n), np.repeat(np.arange(len(n)), [len(x) for x in n]),
                             np.concatenate([of[c] for of, c in zip(numbers, codes)]),
                             np.concatenate(group)[order], np.concatenate(hashes)[order])


def gains(texts: pair_counts.Texts, pairs: pair_counts.Pairs, counted: pair_counts.Counted, orders: list[WordOrder]) -> np.ndarray:
    """Of each text the mean over its words and end of log10 perplexity given the
    word before, less that by frequency alone; nan without words.

    Of a pair with another word, what the lower step says is multiplied by the
    word's own share over its share in the lower step: that of the second word among
    those after the first, or, after a frequent word, that of the first among those
    before the second.  An own share is mixed with the lower one by what is seen once."""
    n_texts = len(texts.n)
    symbol = np.concatenate([*[np.append(np.arange(FREQUENT), END)] * len(orders), FREQUENT + texts.group]).astype(np.int32)
    keys = symbol[pairs.before] * SYMBOLS + symbol[pairs.line]
    first = np.cumsum(texts.n + 1) - (texts.n + 1)
    edges = np.append(first, len(keys))[np.searchsorted(texts.lang, np.arange(len(orders) + 1))]
    symbols = len(orders) * OWN
    lower, more = np.zeros(len(keys)), np.zeros(len(keys))  # share of the word in the lower step
    of_frequent = (pairs.before < symbols) & (pairs.line >= symbols)
    for k, order in enumerate(orders):
        own = slice(edges[k], edges[k + 1])
        at, some = (int(x) for x in np.searchsorted(texts.lang, [k, k + 1]))
        of = pairs.text[own] - at
        p, n = order.given(keys[own], of, some - at)
        more[own] = np.log10(order.alone[keys[own] % SYMBOLS]) - np.log10(p)
        on = np.flatnonzero(of_frequent[own])
        p[on] = order.share_before(keys[own][on], n[on], of[on], some - at)
        lower[own] = p
    sums = np.bincount(pairs.text, more, n_texts)
    event = symbol[pairs.line[pairs.at]]
    text = pairs.text[pairs.at]
    q = lower[pairs.at]
    del keys, lower, more, of_frequent
    other = pairs.kind[pairs.pair] == pair_counts.OTHER
    every = np.stack([order.words for order in orders]) if orders else np.zeros((1, SYMBOLS))
    q[other] *= counted.event[other] / every[texts.lang[text[other]], event[other]]
    # the text's own pairs are taken out
    group, back = _groups(text, pair_counts.side_of(pairs), 2 * len(texts.group))
    pair = counted.pair - pairs.own
    total = counted.total - np.bincount(back, pairs.own, group)[back]
    once = counted.once + (np.bincount(back, pair == 1, group) - np.bincount(back, counted.pair == 1, group))[back]
    rest = (once + 1) / (total + 1)
    ratio = (1 - rest) * pair / (np.maximum(total, 1) * q) + rest
    sums -= np.bincount(text, pairs.own * np.log10(ratio), n_texts)
    return np.where(texts.n > 0, sums / (texts.n + 1), np.nan)


def _groups(text: np.ndarray, x: np.ndarray, width: int) -> tuple[int, np.ndarray]:
    """Number of distinct (text, x), and the number of each."""
    key, order = pair_counts.in_order(text.astype(np.int64) * width + x, (int(text.max(initial=0)) + 1) * width)
    number = np.cumsum(pair_counts.changes(key), dtype=np.int32) - 1
    back = np.empty(len(key), np.int32)
    back[order] = number
    return int(number[-1]) + 1 if len(number) else 0, back


def _key(lang) -> F.Column:
    """A language as text that is never null."""
    return F.coalesce(F.concat(F.lit("="), lang), F.lit(""))


def _by_language(batch: pa.RecordBatch):
    """Languages of a batch with their texts."""
    keys = batch.column("key")
    for name in keys.unique().to_pylist():
        yield name, batch.column("text").filter(pa.compute.equal(keys, name))


def frequent_words(docs: DataFrame) -> DataFrame:
    """``key, words``: each language's most frequent words (lower case), which are
    symbols of their own.  The pairs of all others are counted by ``pair_counts``."""
    def count(batches):
        for batch in batches:
            for name, texts in _by_language(batch):
                for part in steps(texts):
                    found = words(*text_buffer(part), lower=True)[0].value_counts()
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(found), pa.string()), found.field(0), found.field(1)],
                                                     names=["key", "word", "n"])

    def largest(batches):
        # every word's whole count lies in one partition: its first ones hold all that can be among the first
        held: dict[str, list] = {}
        for batch in batches:
            keys = batch.column("key")
            for name in keys.unique().to_pylist():
                own = batch.filter(pa.compute.equal(keys, name))
                rows = held.get(name, []) + list(zip(own.column("n").to_pylist(), own.column("word").to_pylist()))
                held[name] = sorted(rows, key=lambda r: (-r[0], r[1]))[:FREQUENT]
        for name, rows in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(rows), pa.string()), pa.array([w for _, w in rows], pa.binary()),
                                              pa.array([n for n, _ in rows], pa.int64())], names=["key", "word", "n"])

    counted = docs.mapInArrow(count, "key string, word binary, n long").groupBy("key", "word").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("key").orderBy(F.col("n").desc(), "word")
    first = counted.mapInArrow(largest, "key string, word binary, n long").withColumn("place", F.row_number().over(order))
    return first.where(F.col("place") <= FREQUENT).groupBy("key").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("place", "word"))), lambda r: r["word"]).alias("words"))


class Kept:
    """A table with a row per language in the shared folder, read in the tasks
    when they meet the language."""

    def __init__(self, df: DataFrame, name: str):
        self.path = scratch_dir(df.sparkSession, f"llm-quality-{name}")
        df.withColumn("part", F.pmod(F.crc32("key"), F.lit(64)).cast("int")).write.partitionBy("part").parquet(self.path)

    def __getitem__(self, key: str) -> dict:
        return _row_of(self.path, key)


def _row_of(path: str, key: str, columns: list[str] | None = None) -> dict:
    import pyarrow.dataset
    store, base = arrow_store(path)
    part = pyarrow.dataset.dataset(f"{base}/part={zlib.crc32(key.encode()) % 64}", filesystem=store, format="parquet")
    return part.to_table(columns, filter=pyarrow.dataset.field("key") == key).to_pylist()[0]


@functools.lru_cache(maxsize=8)
def _symbols(path: str, key: str) -> dict[bytes, int]:
    return {w: i for i, w in enumerate(_row_of(path, key)["words"])}


def _counts(path: str, key: str, kind: int) -> tuple[np.ndarray, np.ndarray]:
    row = _row_of(path, key, [f"keys{kind}", f"counts{kind}"])
    return np.frombuffer(row[f"keys{kind}"], np.int32), np.frombuffer(row[f"counts{kind}"], np.int64)


# fitting sorted counts is cheap beside counting them, so the counts are what is kept

@functools.lru_cache(maxsize=8)
def _spelling(path: str, key: str) -> KneserNey:
    """The language's model of bytes."""
    return KneserNey(*_counts(path, key, 0))


@functools.lru_cache(maxsize=8)
def _order(path: str, key: str) -> WordOrder:
    """The language's model of pairs of symbols."""
    return WordOrder(*_counts(path, key, 1))


def language_models(docs: DataFrame, symbols: Kept) -> Kept:
    """Counts of byte trigrams (0) and symbol pairs (1) of each language, over
    all texts, as sorted arrays."""
    def count(batches):
        held: dict[tuple[str, int], list] = {}
        size = 0

        def sums(arrays):
            keys, n = (np.concatenate(x) for x in zip(*arrays))
            key, back = np.unique(keys, return_inverse=True)
            return key, np.bincount(back, weights=n).astype(np.int64)

        def out():
            for (name, kind), arrays in held.items():
                key, n = sums(arrays)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(key), pa.string()), pa.array(np.full(len(key), kind, np.int8)),
                                                  pa.array(key.astype(np.int32)), pa.array(n)], names=["key", "kind", "gram", "n"])
            held.clear()

        for batch in batches:
            for name, texts in _by_language(batch):
                for kind, parts in ((0, trigrams(texts)), (1, word_pairs(texts, _symbols(symbols.path, name)))):
                    for keys, _ in parts:
                        key, n = np.unique(keys, return_counts=True)
                        held.setdefault((name, kind), []).append((key, n))
                        size += len(key)
            if size > HELD:
                for k, arrays in held.items():
                    held[k] = [sums(arrays)]
                size = sum(len(a[0][0]) for a in held.values())
                if size > HELD // 2:
                    yield from out()
                    size = 0
        yield from out()

    counted = docs.mapInArrow(count, "key string, kind byte, gram int, n long").groupBy("key", "kind", "gram").agg(F.sum("n").alias("n"))

    def gather(key, table):
        name = key[0].as_py()
        values = {"key": name}
        for k in (0, 1):
            own = table.filter(pa.compute.equal(table["kind"], k))
            gram, n = own["gram"].to_numpy(), own["n"].to_numpy()
            order = np.argsort(gram)
            values[f"keys{k}"], values[f"counts{k}"] = gram[order].astype(np.int32).tobytes(), n[order].astype(np.int64).tobytes()
        return pa.Table.from_pylist([values], pa.schema([("key", pa.string()), *[(f"{c}{k}", pa.binary()) for k in (0, 1) for c in ("keys", "counts")]]))

    return Kept(counted.groupBy("key").applyInArrow(lambda k, t: gather(k, t), "key string, keys0 binary, counts0 binary, keys1 binary, counts1 binary"),
                "models")


def measured(docs: DataFrame) -> DataFrame:
    """Rule counts, log10 perplexity per byte (``log_ppl``) and what the word
    before adds to that per word (``word_gain``; both null without words) of
    every row."""
    texts = docs.select(_key(F.col("lang")).alias("key"), "text")
    symbols = Kept(frequent_words(texts), "words")
    models = language_models(texts, symbols)
    release_shuffles(docs.sparkSession)
    fields = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    kinds = ", ".join([f"doc_id {docs.schema['doc_id'].dataType.simpleString()}", f"lang {docs.schema['lang'].dataType.simpleString()}",
                       *[f"{f} long" for f in fields], "log_ppl double", "word_gain double"])

    def measure(rows: pa.Table) -> pair_counts.Texts:
        names = rows["key"].unique().to_pylist()
        place = pyarrow.compute.index_in(rows["key"], pa.array(names, pa.string())).to_numpy()
        order = np.argsort(place, kind="stable")
        rows = rows.take(pa.array(order)).combine_chunks()
        edges = np.searchsorted(place[order], np.arange(len(names) + 1))
        text = rows["text"].combine_chunks()
        ppl, parts = np.full(len(text), np.nan), []
        for name, at, end in zip(names, edges[:-1].tolist(), edges[1:].tolist()):
            own = text.slice(at, end - at)
            spelling = _spelling(models.path, name)
            for keys, first in trigrams(own):
                n = len(first) - 1
                if len(keys):
                    ppl[at:at + n] = median_word(spelling.log10(keys), keys, first)
                at += n
            parts.append(as_numbers(own, _symbols(symbols.path, name), name))
        got = text_stats(text)
        kept = rows.select(["doc_id", "lang", "key"])
        for f, values in [*((f, pa.array(got[f], pa.int64())) for f in fields), ("log_ppl", pa.array(ppl, pa.float64(), from_pandas=True))]:
            kept = kept.append_column(f, values)
        return together(kept, parts)

    def gained(texts: pair_counts.Texts, pairs: pair_counts.Pairs, counted: pair_counts.Counted) -> pa.Table:
        _spelling.cache_clear()  # not needed any more, and large
        names = texts.rows["key"].unique().to_pylist()
        gain = gains(texts, pairs, counted, [_order(models.path, name) for name in names])
        return texts.rows.drop_columns("key").append_column("word_gain", pa.array(gain, pa.float64(), from_pandas=True))

    dealt = pair_counts.deal(docs.select("doc_id", "lang", _key(F.col("lang")).alias("key"), "text"), measure, OWN)
    return pair_counts.assemble(dealt, pair_counts.answers(dealt), OWN, gained, kinds)


def _weight(n_words) -> F.Column:
    return F.sqrt(F.greatest(F.least(n_words, F.lit(FULL_WORDS)), F.lit(1)))


def bands(rows: DataFrame, width: float = WIDTH) -> DataFrame:
    """``_lang, mid, reach``: each language's median log perplexity, and
    ``width`` robust standard deviations of its texts from it, as of a text of
    one word.  Medians come from counts of narrow bins, so no group's rows meet
    in one task."""
    def median(table: DataFrame, name: str, grain: float) -> DataFrame:
        order = Window.partitionBy("lang").orderBy("bin")
        until = (table.groupBy("lang", "bin").agg(F.count("*").alias("n")).withColumn("until", F.sum("n").over(order))
                 .withColumn("every", F.sum("n").over(Window.partitionBy("lang"))))
        return (until.where(F.col("until") * 2 >= F.col("every")).groupBy(F.col("lang").alias("_lang"))
                .agg((F.min("bin") * grain).alias(name)))  # one row per language

    known = rows.where(F.col("log_ppl").isNotNull())
    mid = F.broadcast(cut_lineage(median(known.select("lang", F.round(F.col("log_ppl") / GRAIN).cast("long").alias("bin")), "mid", GRAIN)))
    off = (known.join(mid, F.col("lang").eqNullSafe(F.col("_lang")))
           .select("lang", F.abs(F.col("log_ppl") - F.col("mid")) * _weight(F.col("n_words")) / (10 * GRAIN)))
    off = off.toDF("lang", "off").select("lang", F.round("off").cast("long").alias("bin"))
    spread = F.broadcast(median(off, "mad", 10 * GRAIN).withColumnRenamed("_lang", "lang"))
    return mid.join(spread, F.col("lang").eqNullSafe(F.col("_lang"))).select(
        F.col("_lang"), "mid",
        F.greatest(F.lit(width * 1.4826) * F.col("mad"), F.lit(GRAIN * FULL_WORDS ** 0.5)).alias("reach"))


def judge(docs: DataFrame) -> DataFrame:
    """``doc_id``, the rule counts, ``log_ppl``, ``word_gain``, ``base_failed``
    and ``kept`` of every row of ``docs`` (``doc_id, lang, text``)."""
    rows = cut_lineage(measured(docs))
    limits = F.broadcast(cut_lineage(bands(rows)))  # one row per language
    failed = ((F.col("n_words") < MIN_WORDS)
              | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))
    reach = F.col("reach") / _weight(F.col("n_words"))
    spelt = F.col("log_ppl").between(F.col("mid") - reach, F.col("mid") + reach)
    ordered = F.col("word_gain") <= F.lit(MARGIN) / _weight(F.col("n_words"))
    return (rows.join(limits, F.col("lang").eqNullSafe(F.col("_lang")), "left")
            .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "log_ppl", "word_gain",
                    failed.alias("base_failed"), (~failed & F.coalesce(spelt & ordered, F.lit(False))).alias("kept")))
