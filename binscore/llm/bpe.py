"""Byte-level BPE encoding and decoding by a global distinct-word shuffle.

Texts are cut into pre-tokens by the tokenizer's pattern, each distinct
pre-token of the corpus is encoded once, its ids are joined back to every
chunk that has it and put at the token's positions (``dictionary.py``).
Decoding joins the token-byte table, whose size is the tokenizer's.

Defined results: a null or empty text has no ids; rows that repeat a document
are each encoded; a null id stays null; an empty table gives no rows; whole
texts are encoded whatever their length; other columns are not read.  There are
no ties: ranks differ.
"""

from __future__ import annotations

import base64
import functools

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from binscore.llm import dictionary

LETTER, NUMBER, OTHER, BLANK = 1, 2, 0, 3
#: Ids that one step of decoding works on.
STEP_IDS = 1 << 18


@functools.cache
def classes() -> np.ndarray:
    """Class of every code point under the pattern: letter, number, white
    space or other.  The tokenizer library itself says which match, as its
    Unicode version counts."""
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    out = np.full(0x110000, OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (BLANK, r"\s")):
        only = tiktoken.Encoding("class", pat_str=pattern, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
        matched = bytes(only.encode_ordinary(every)).decode()  # what does not match is left out
        out[np.frombuffer(matched.encode("utf-32-le"), np.uint32)] = kind
    return out


def pre_tokens(data: np.ndarray, offs: np.ndarray):
    """Cuts texts as the pattern ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+|
    ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+`` does, all texts at once: a binary
    array of pre-tokens and the first of each text (n+1 values).

    Runs of one class are tokens, but: a space right before a run belongs to
    it; the last blank before a run leaves its blank run; an apostrophe that
    begins a token takes one of the listed endings with it."""
    cp = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    n = len(cp)
    if not n:
        return dictionary.binary_array(data, np.zeros(0, np.int64)), np.zeros(len(offs), np.int64)
    at = np.flatnonzero((data & 0xC0) != 0x80)  # byte offset of each code point
    kind = classes()[cp]
    edge = np.zeros(n + 1, bool)  # a text begins here
    edge[np.searchsorted(at, offs)] = True
    start = np.empty(n, bool)
    start[0], start[1:] = True, kind[1:] != kind[:-1]
    start |= edge[:-1]
    begin = np.flatnonzero(start)
    end = np.append(begin[1:], n)
    blank = (kind[begin] == BLANK) & ~edge[end]  # blank runs that a token of the same text follows
    last = end[blank]
    start[last - 1] = True
    start[last[cp[last - 1] == 0x20]] = False
    # endings after an apostrophe that begins a token and is a run of its own
    p = begin[(end - begin == 1) & (cp[begin] == 0x27) & start[begin]]
    p = p[p + 1 < n]
    p = p[~edge[p + 1]]
    one = np.isin(cp[p + 1], [ord(c) for c in "stmd"])
    second = np.minimum(p + 2, n - 1)
    inner = (p + 2 < n) & ~edge[second]
    two = np.zeros(len(p), bool)
    for a, b in ("re", "ve", "ll"):
        two |= inner & (cp[p + 1] == ord(a)) & (cp[second] == ord(b))
    for q, k in ((p[one], 1), (p[two], 2)):
        start[q + 1] = False
        rest = q + 1 + k
        rest = rest[rest < n]
        start[rest[~edge[rest] & (kind[rest] == LETTER)]] = True
    begin = at[start]
    return (dictionary.binary_array(data, np.diff(np.append(begin, len(data)))),
            np.searchsorted(begin, offs))


class Ranks:
    """A byte-level vocabulary, read from its rank file in the driver and sent
    to the tasks; its size is that of the file."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}

    @functools.cached_property
    def pieces(self) -> tiktoken.Encoding:
        """Merges one whole pre-token."""
        return tiktoken.Encoding("pieces", pat_str=r"[\s\S]+", mergeable_ranks=self.ranks, special_tokens={})

    @functools.cached_property
    def table(self) -> tuple[np.ndarray, np.ndarray]:
        """Token-byte table: bytes of all tokens and where each id's end."""
        tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, i in self.ranks.items():
            tokens[i] = token
        return (np.concatenate([[0], np.cumsum([len(t) for t in tokens])]),
                np.frombuffer(b"".join(tokens), np.uint8))

    def __getstate__(self):
        return {"ranks": self.ranks}


def encode(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, ids``: the ids of every row's whole text, array of int."""
    spark = docs.sparkSession
    ranks = spark.sparkContext.broadcast(Ranks(path))

    def answer(words: pa.Array, counts):
        merge = ranks.value.pieces.encode_ordinary
        lists = [merge(w.decode()) for w in words.to_pylist()]
        ends = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
        return ends, np.fromiter((i for x in lists for i in x), np.uint32, int(ends[-1]))

    def build(ids, counts, weight, codes, ends, values):
        tokens, lengths = dictionary.take_lists(ends, values, codes)
        per_text = np.concatenate([[0], np.cumsum(lengths)])[np.concatenate([[0], np.cumsum(counts)])]
        lists = pa.ListArray.from_arrays(pa.array(per_text.astype(np.int32)), pa.array(tokens.astype(np.int32)))
        return pa.table([ids, lists], names=["doc_id", "ids"])

    dealt = dictionary.deal(docs.select("doc_id", "text", F.lit(0).cast("byte").alias("weight")), pre_tokens)
    back = dictionary.reduce_words(dealt, answer)
    return dictionary.assemble(dealt, back, (np.uint32,), build, "doc_id long, ids array<int>")


def decode_udf(spark: SparkSession, path: str):
    """Bytes of an id array, from the token-byte table."""
    ranks = spark.sparkContext.broadcast(Ranks(path))

    @F.arrow_udf("binary")
    def decode(ids: pa.Array) -> pa.Array:
        ends, table = ranks.value.table
        sizes = ids.value_lengths().fill_null(0).to_numpy().astype(np.int64)
        until = np.cumsum(sizes)
        out, at = [], 0
        while at < len(ids):  # about STEP_IDS at a time; one text is never cut
            end = max(at + 1, int(np.searchsorted(until, (until[at - 1] if at else 0) + STEP_IDS, side="right")))
            data, lengths = dictionary.take_lists(ends, table, ids.slice(at, end - at).flatten().to_numpy())
            bytes_to = np.concatenate([[0], np.cumsum(lengths)])
            part = np.concatenate([[0], np.cumsum(sizes[at:end])])
            out.append(dictionary.binary_array(data, np.diff(bytes_to[part])))
            at = end
        return pa.concat_arrays(out) if out else pa.array([], pa.binary())
    return decode


@functools.cache
def little_endian_udf():
    """Ids as little-endian unsigned 32-bit integers."""
    @F.arrow_udf("binary")
    def little_endian(ids: pa.Array) -> pa.Array:
        flat = ids.flatten().to_numpy().astype("<u4")
        return dictionary.binary_array(flat.view(np.uint8), 4 * ids.value_lengths().fill_null(0).to_numpy())
    return little_endian


def digests(encoded: DataFrame, path: str, keep_ids: bool = False) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of encoded texts, and
    the ids themselves if asked for."""
    spark = encoded.sparkSession
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), *["ids"] * keep_ids,
                          F.sha2(little_endian_udf()(F.col("ids")), 256).alias("ids_sha256"),
                          F.sha2(decode_udf(spark, path)(F.col("ids")), 256).alias("decoded_sha256"))
