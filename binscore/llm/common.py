"""Helpers shared by the operators: table access, folds, and vectorised text
segmentation over Arrow string buffers.

Inside a task texts stay in their Arrow buffer: bytes are classified through a
256-entry table and cut with numpy, words become a dictionary-encoded Arrow
array.  No Python object per word is made.
"""

from __future__ import annotations

import functools
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from binscore.session import checkpoint_dir, ship_package
from binscore.sources.tables import read_table

#: White space of the word contracts: 0x20 and 0x09 to 0x0D.
WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
#: A-Z to a-z, every other byte itself.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of text that one numpy step works on.
STEP_BYTES = 2 << 20


#: Rows of an Arrow batch: batches carry whole texts.
BATCH_ROWS = 1000


def prepare(spark: SparkSession) -> None:
    """Makes the package importable on the workers and Arrow batches small."""
    ship_package(spark)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The ``documents`` table with only the named columns."""
    prepare(spark)
    return read_table(spark, sf_dir, "documents", list(columns))


def fold(doc_id) -> F.Column:
    """crc32 of the id as text, modulo 5 (a null id counts as empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, max_rows: int) -> DataFrame:
    """``(text, label)`` of about ``max_rows`` training rows (fold not 0).

    Rows are taken by a hash of their id below a threshold, so the choice does
    not depend on partitioning.  The id list is bounded by ``max_rows`` and so
    may be broadcast.  An id with several labels takes the largest; null
    labels and ids are left out."""
    known = (labels.select(F.col("doc_id").alias("_llm_id"), F.col(label).cast("int").alias("_llm_label"))
             .where(F.col("_llm_id").isNotNull() & F.col("_llm_label").isNotNull() & (fold(F.col("_llm_id")) != 0))
             .groupBy("_llm_id").agg(F.max("_llm_label").alias("_llm_label")))
    n = known.count()
    if n > max_rows:
        cut = int((1 << 31) * max_rows / n)
        known = known.where(F.pmod(F.xxhash64(F.col("_llm_id"), F.lit("sample")), F.lit(1 << 31)) < cut)
    return (docs.select(F.col("doc_id").alias("_llm_doc"), F.col("text").alias("_llm_text"))
            .join(F.broadcast(known), F.col("_llm_doc") == F.col("_llm_id"))
            .select(F.col("_llm_text").alias("text"), F.col("_llm_label").alias("label")))


def broadcast_if_small(df: DataFrame, limit: int = 16 << 20) -> DataFrame:
    """``df``, marked for broadcast if its measured size (its values as JSON)
    is within ``limit`` bytes; else as it is, for a shuffle join that AQE may
    split.  ``df`` should be materialised: it is read for the measure."""
    size = df.agg(F.sum(F.octet_length(F.to_json(F.struct(*df.columns))))).first()[0] or 0
    return F.broadcast(df) if size <= limit else df


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared checkpoint folder and read back: later
    readers, and tasks repeated after a lost executor, read the same rows."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


# --- inside tasks -----------------------------------------------------------

def text_buffer(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and their n+1 offsets; a null is empty."""
    arr = arr.fill_null("") if arr.null_count else arr
    kind = np.int64 if pa.types.is_large_string(arr.type) else np.int32
    _, offs, data = arr.buffers()
    if not len(arr):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(offs, kind)[arr.offset:arr.offset + len(arr) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[offs[0]:offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offs - offs[0]


def steps(arr: pa.Array, limit: int = STEP_BYTES):
    """Slices of ``arr`` of about ``limit`` bytes; one text is never cut."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if not len(arr):
        return
    _, offs = text_buffer(arr)
    at = 0
    while at < len(arr):
        end = max(at + 1, int(np.searchsorted(offs, offs[at] + limit, side="right")) - 1)
        yield arr.slice(at, end - at)
        at = end


def runs(inside: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of true positions that do not cross a text's edge: starts,
    ends, and for each text edge the index of its first run (n+1 values)."""
    if not len(inside):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offs), np.int64)
    edge = np.zeros(len(inside) + 1, bool)
    edge[offs] = True
    before = np.empty(len(inside), bool)
    before[0], before[1:] = False, inside[:-1]
    after = np.empty(len(inside), bool)
    after[-1], after[:-1] = False, inside[1:]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offs)


def packed(data: np.ndarray, inside: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """The runs of ``inside`` as a binary Arrow array."""
    ends = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=ends[1:])
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(ends),
                                                             pa.py_buffer(np.ascontiguousarray(data[inside]))])


def spaced(data: np.ndarray, inside: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray,
           lead: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """All words in lower case (A-Z), each followed by one space and each
    text's first one preceded by ``lead`` spaces; where each word begins."""
    lengths = ends - starts
    extra = np.zeros(len(starts) + 1, np.int64)
    begins = first[:-1][np.diff(first) > 0]
    extra[begins] = lead
    extra = np.cumsum(extra)[:-1]
    at = np.concatenate([[0], np.cumsum(lengths + 1)])
    line = np.full(at[-1] + lead * len(begins), 0x20, np.uint8)
    at = at[:-1] + extra
    line[np.repeat(at - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))] = LOWER[data[inside]]
    return line, at


def words(data: np.ndarray, offs: np.ndarray, lower: bool = False):
    """Words ``[^\\x20\\x09-\\x0D]+``: binary Arrow array of all texts' words and
    for each text edge the index of its first word (n+1 values)."""
    inside = ~WHITE[data]
    starts, ends, first = runs(inside, offs)
    return packed(LOWER[data] if lower else data, inside, ends - starts), first


def per_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of ``values`` of each text; ``first`` as from ``runs``."""
    total = np.concatenate([[0], np.cumsum(values)])
    return total[first[1:]] - total[first[:-1]]


def owner(first: np.ndarray) -> np.ndarray:
    """The text that each run belongs to."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def word_counts(arr: pa.Array) -> np.ndarray:
    """Number of words of each text."""
    out = [np.zeros(0, np.int64)]
    for part in steps(arr):
        data, offs = text_buffer(part)
        out.append(np.diff(runs(~WHITE[data], offs)[2]))
    return np.concatenate(out)


@functools.cache
def word_count_udf():
    @F.arrow_udf("long")
    def n_words(text: pa.Array) -> pa.Array:
        return pa.array(word_counts(text), pa.int64())
    return n_words


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (wrapping multiply and shift), for hashed keys."""
    x = x.astype(np.uint64, copy=True)
    for m in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        x ^= x >> np.uint64(33)
        x *= np.uint64(m)
    return x ^ (x >> np.uint64(33))
