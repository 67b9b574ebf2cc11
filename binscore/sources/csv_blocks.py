"""CSV files with quoted line ends, read by many tasks (A1, A3).

A whole-file reader must see a file from its start, as only the quotes before a
line end tell whether it ends a record.  Here files are read as lines, which
split anywhere (Spark's text source cuts at its partition size), in two passes:

1. every block (a file's part that one split holds) counts its quotes; a prefix
   sum over the blocks of a file, one row a block, tells in which state each
   begins;
2. every block cuts its lines into records from that state.  A record that
   crosses block edges comes in pieces, which meet by the block in which it
   began; all others never leave their task.

Records are then parsed by Spark's own CSV expression.  Quotes are as in RFC
4180: only around whole fields, doubled inside.  A file's first record is its
header.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from binscore.session import cut_lineage

PIECES = "file string, block long, piece int, record string, first boolean"
WHOLE, HEAD, TAIL, MIDDLE = 0, 1, 2, 3


def _cut():
    """mapInArrow over a split's lines in order, ``file, block, quoted, line``:
    the block's records, and its pieces of records that cross its edges.  A
    piece is the block's head, tail or, if no record ends in it, its middle."""
    def block(file: str, at: int, quoted: bool, lines: pa.Array):
        odd = np.cumsum(pc.count_substring(lines, '"').to_numpy(zero_copy_only=False)) + int(quoted)
        ends = np.flatnonzero(odd % 2 == 0) + 1  # a record ends with these lines
        text = lines.to_pylist()
        begin = np.concatenate([[0], ends])
        out = [(WHOLE, "\n".join(text[a:b]) if b > a + 1 else text[a]) for a, b in zip(begin[:-1].tolist(), begin[1:].tolist())]
        if quoted and out:
            out[0] = (HEAD, out[0][1])
        if begin[-1] < len(text):
            out.append((MIDDLE if quoted and not len(ends) else TAIL, "\n".join(text[begin[-1]:])))
        n = len(out)
        return pa.RecordBatch.from_arrays(
            [pa.array([file] * n, pa.string()), pa.array([at] * n, pa.int64()), pa.array([k for k, _ in out], pa.int32()),
             pa.array([r for _, r in out], pa.string()), pa.array([at == 0 and i == 0 for i in range(n)], pa.bool_())],
            names=["file", "block", "piece", "record", "first"])

    def run(batches):
        held, key = [], None
        for batch in batches:
            files, blocks = batch.column("file").to_numpy(zero_copy_only=False), batch.column("block").to_numpy()
            edge = np.flatnonzero((files[1:] != files[:-1]) | (blocks[1:] != blocks[:-1])) + 1 if len(files) else []
            for a, b in zip([0, *edge], [*edge, len(files)]):
                if a == b:
                    continue
                now = (files[a], int(blocks[a]), bool(batch.column("quoted")[a].as_py()))
                if held and now != key:
                    yield block(*key, pa.concat_arrays(held))
                    held = []
                key = now
                held.append(batch.column("line").slice(a, b - a))
        if held:
            yield block(*key, pa.concat_arrays(held))
    return run


def records(spark: SparkSession, path, **options) -> DataFrame:
    """``file, record`` of every record of the CSV files at ``path`` but their
    headers, in no order.  ``options`` go to the text source.  A line end inside
    a record is ``\\n``; empty lines are no records."""
    # \n alone ends a line: \r\n inside quotes stays as it is
    raw = spark.read.options(lineSep="\n", **options).text(path)
    lines = raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("line"))
    quotes = F.length("line") - F.length(F.replace("line", F.lit('"'), F.lit("")))
    odd = lines.groupBy("file", "block").agg((F.sum(quotes) % 2).alias("odd"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    states = odd.select("file", "block", (F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2 == 1).alias("quoted"))
    # a row for each split of the scan, as many as the driver itself lists for it;
    # a broadcast keeps the lines in order
    cut = (lines.join(F.broadcast(cut_lineage(states)), ["file", "block"])
           .select("file", "block", "quoted", "line").mapInArrow(_cut(), PIECES))
    whole = cut.where(F.col("piece") == WHOLE)
    parts = cut.where(F.col("piece") != WHOLE)
    # a crossing record is known by the block of its tail, the last one at or before a piece
    order = Window.partitionBy("file").orderBy("block", F.when(F.col("piece") == TAIL, 1).otherwise(0))
    owner = F.max(F.when(F.col("piece") == TAIL, F.col("block"))).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    joined = (parts.withColumn("owner", owner).groupBy("file", "owner")
              .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "record"))), lambda p: p["record"]), "\n")
                   .alias("record"), F.max("first").alias("first")))
    both = whole.select("file", "record", "first").unionByName(joined.select("file", "record", "first"))
    text = F.regexp_replace("record", "\r$", "")
    return both.where(~F.col("first")).select("file", text.alias("record")).where("record <> ''")


def read_csv_records(spark: SparkSession, path, names: list[str], csv_options: dict, **options) -> DataFrame:
    """The columns ``names`` (strings, by position) and ``_file`` of every record."""
    kept = {k: v for k, v in csv_options.items() if k not in ("header", "multiLine")}
    ddl = ", ".join(f"`{n}` string" for n in names)
    return (records(spark, path, **options).select("file", F.from_csv("record", ddl, kept).alias("r"))
            .select("r.*", F.col("file").alias("_file")))
