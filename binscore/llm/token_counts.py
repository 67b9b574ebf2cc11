"""Token counts by rank-synchronous array merging.

The texts of a batch are cut into pre-tokens; each distinct one of a step is a
sequence of symbols, all sequences lying one after the other in one array (a
ragged array).  In a round every sequence finds its lowest-ranked adjacent
pair and all its occurrences are merged at once, in all sequences together;
sequences without a pair that merges leave the array.  What counts is the
number of symbols that survive.

A merge only makes pairs of a higher rank (checked when the vocabulary is
read), so merging all occurrences of the lowest pair from the left equals
merging them one by one.  A sequence of more than ``LONG`` symbols does not
wait for its one lowest pair: an occurrence merges once it is the lowest within
the longest token's length on both sides, which no other merge can reach
before; so a very long text without spaces takes hundreds of rounds, not one for
every rank in it.

The vocabulary file's added tokens are found in the texts as the library does
by default: each is one token and cuts the text.

Defined results: a null or empty text has no tokens (0 bytes); repeated rows
are each counted; a null id stays null; an empty table gives no rows; whole
texts are counted whatever their length; only the columns asked for are read,
so others cannot clash.  There are no ties: ranks differ.
"""

from __future__ import annotations

import functools
import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from binscore.llm.bpe import pre_tokens
from binscore.llm.common import steps, text_buffer
from binscore.llm.dictionary import binary_parts

#: Symbols from which a sequence merges by windows.
LONG = 512
NONE = np.int32(2**31 - 1)


def byte_symbols() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: itself
    where it is printable Latin-1, else the next one from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, extra = [], 0x100
    for b in range(256):
        out.append(chr(b if b in plain else extra))
        extra += b not in plain
    return out


class Merges:
    """The merges of a byte-level vocabulary file, read in the driver; its size
    is that of the file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, pre = spec["model"], spec["pre_tokenizer"]
        if (model["type"] != "BPE" or model.get("dropout") or model.get("byte_fallback") or model.get("ignore_merges")
                or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix") or spec["normalizer"]
                or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"]
                or any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec["added_tokens"])):
            raise ValueError(f"{path}: not a plain byte-level vocabulary")
        vocab = model["vocab"]
        self.bytes = np.array([vocab[c] for c in byte_symbols()], np.int64)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        #: symbol that each rank's merge makes
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.size = max(vocab.values()) + 1
        self.longest = max(map(len, vocab))
        age = np.full(self.size, -1, np.int64)
        age[self.made] = np.arange(len(pairs))
        if len(np.unique(self.made)) != len(pairs) or (np.maximum(age[left], age[right]) >= np.arange(len(pairs))).any():
            raise ValueError(f"{path}: a merge needs a symbol of a higher rank")
        keys = left * self.size + right
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        #: ranks of pairs of bytes, the first round's
        self.byte_ranks = self.rank(np.repeat(self.bytes, 256), np.tile(self.bytes, 256)).reshape(256, 256)
        added = sorted((t["content"].encode() for t in spec["added_tokens"]), key=len, reverse=True)
        self.added = re.compile(b"|".join(map(re.escape, added))) if added else None

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of symbols, ``NONE`` where it does not merge."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)


def window_minimum(x: np.ndarray, reach: int) -> np.ndarray:
    """Minimum of ``x`` from ``reach`` places before to ``reach`` after each
    place, by prefix and suffix minima of blocks."""
    w, n = 2 * reach + 1, len(x)
    padded = np.full(-(-(n + 2 * reach) // w) * w, NONE, x.dtype)
    padded[reach:reach + n] = x
    blocks = padded.reshape(-1, w)
    before = np.minimum.accumulate(blocks, axis=1).ravel()
    after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[:n], before[2 * reach:2 * reach + n])


def from_left(chosen: np.ndarray) -> np.ndarray:
    """Of chosen places that follow one another (overlapping occurrences of a
    pair of equal symbols) every other one, from the first of each run."""
    at = np.flatnonzero(chosen)
    if not len(at):
        return at
    first = np.append(True, np.diff(at) > 1)
    run = np.flatnonzero(first)[np.cumsum(first) - 1]
    return at[(np.arange(len(at)) - run) % 2 == 0]


def survivors(merges: Merges, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Number of symbols that each byte sequence ``data[offs[i]:offs[i + 1]]``
    ends up with; sequences are not empty."""
    n = np.diff(offs)
    out = n.copy()
    symbols, owner = merges.bytes[data], np.repeat(np.arange(len(n)), n)
    rank = np.full(len(data), NONE, np.int32)  # of the pair that begins at a place
    if len(data) > 1:
        rank[:-1] = merges.byte_ranks[data[:-1], data[1:]]
    rank[offs[1:] - 1] = NONE
    while True:
        # sequences that still have a pair; the others keep their count
        starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1])) if len(owner) else np.zeros(0, np.int64)
        if not len(starts):
            return out
        lengths = np.diff(np.append(starts, len(owner)))
        lowest = np.minimum.reduceat(rank, starts)
        out[owner[starts]] = lengths
        alive = lowest < NONE
        if not alive.all():
            keep = np.repeat(alive, lengths)
            symbols, owner, rank, lengths, lowest = symbols[keep], owner[keep], rank[keep], lengths[alive], lowest[alive]
            if not len(owner):
                return out
        least = np.repeat(lowest, lengths)
        chosen = rank == least
        if lengths.max() > LONG:
            begin = np.cumsum(lengths) - lengths
            for s, e in zip(begin[lengths > LONG].tolist(), (begin + lengths)[lengths > LONG].tolist()):
                chosen[s:e] = _by_windows(rank[s:e], symbols[s:e], merges.longest)
        at = from_left(chosen)
        symbols[at] = merges.made[rank[at]]
        gone = np.zeros(len(symbols), bool)
        gone[at + 1] = True
        # ranks change at the new symbols and at those before them
        symbols, owner, rank = symbols[~gone], owner[~gone], rank[~gone]
        new = at - np.arange(len(at))
        touched = np.unique(np.concatenate([new, new[new > 0] - 1]))
        rank[touched] = NONE
        touched = touched[touched + 1 < len(symbols)]
        touched = touched[owner[touched] == owner[touched + 1]]
        rank[touched] = merges.rank(symbols[touched], symbols[touched + 1])


def _by_windows(rank: np.ndarray, symbols: np.ndarray, reach: int) -> np.ndarray:
    """Places of one long sequence that may merge now: lowest within ``reach``
    on both sides.  Overlapping occurrences wait for the first of their run,
    as merging starts there."""
    lowest = (rank < NONE) & (rank == window_minimum(rank, reach))
    same = np.zeros(len(rank), bool)  # this place's pair repeats the one before it
    same[1:] = (rank[1:] == rank[:-1]) & (rank[1:] < NONE)
    first = np.flatnonzero(~same)
    return lowest & lowest[first[np.cumsum(~same) - 1]]


def counts(merges: Merges, texts: pa.Array) -> np.ndarray:
    """Tokens of each text."""
    out = [np.zeros(0, np.int64)]
    for part in steps(texts):
        data, offs = text_buffer(part)
        n = np.zeros(len(part), np.int64)
        home = np.arange(len(part))
        if merges.added is not None and merges.added.search(data):
            data, offs, home = _without_added(merges, data, offs, n)
        tokens, first = pre_tokens(data, offs)
        if len(tokens):
            coded = tokens.dictionary_encode()
            each = survivors(merges, *binary_parts(coded.dictionary))[coded.indices.to_numpy()]
            sums = np.concatenate([[0], np.cumsum(each)])
            np.add.at(n, home, sums[first[1:]] - sums[first[:-1]])
        out.append(n)
    return np.concatenate(out)


def _without_added(merges: Merges, data: np.ndarray, offs: np.ndarray, n: np.ndarray):
    """Texts cut at their added tokens, which are counted in ``n``: bytes and
    offsets of the pieces and the text that each belongs to."""
    pieces, home, raw = [], [], data.tobytes()
    for i, (a, b) in enumerate(zip(offs[:-1].tolist(), offs[1:].tolist())):
        at = a
        for m in merges.added.finditer(raw, a, b):
            n[i] += 1
            pieces.append(raw[at:m.start()])
            home.append(i)
            at = m.end()
        pieces.append(raw[at:b])
        home.append(i)
    return (np.frombuffer(b"".join(pieces), np.uint8), np.concatenate([[0], np.cumsum([len(p) for p in pieces])]),
            np.array(home))


@functools.cache
def _counter(shared):
    @F.arrow_udf("long")
    def n_tokens(text: pa.Array) -> pa.Array:
        return pa.array(counts(shared.value, text), pa.int64())
    return n_tokens


def count_tokens(docs: DataFrame, path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``<id_col>, n_bytes, n_tokens, over_limit`` of every row: bytes of its
    UTF-8 text, tokens by the vocabulary file at ``path``, more than ``limit``."""
    shared = docs.sparkSession.sparkContext.broadcast(Merges(path))
    text = F.coalesce(F.col(text_col), F.lit(""))
    return (docs.select(F.col(id_col).alias("_id"), F.octet_length(text).cast("long").alias("n_bytes"),
                        _counter(shared)(text).alias("n_tokens"))
            .select(F.col("_id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")))
