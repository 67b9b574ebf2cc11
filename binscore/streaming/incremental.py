"""Restartable incremental scoring on Structured Streaming.

The reference scores files in chunks of five and writes one CSV per chunk,
resuming by hand-editing a batch number, and prints the time of each chunk.  Here
prepared prompts sit as parquet files in a folder; a file-source stream picks
them up ``max_files`` at a time, scores them (K1) and appends the results to a
parquet sink.  The checkpoint records which input files are done, so a re-run
after a crash or on the same folder scores only new files, and the file sink's
log makes every micro-batch visible exactly once.

Rows and errors are counted while they pass (observed metrics); when a run
ends, a row per micro-batch goes to the report beside the sink.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from binscore.operators import score

REPORT = ("run string, batch long, started string, seconds double, start_row long, rows long, errors long, total_seconds double")


def files_at_a_time(spark: SparkSession) -> int:
    """Input files of a micro-batch: two for every core, so that it fills them."""
    return 2 * spark.sparkContext.defaultParallelism


def score_stream(spark: SparkSession, prompts_dir: str, out_dir: str, checkpoint: str,
                 schema, text_col: str = "prompt_text", keys=None,
                 factory=score.KeywordPredictor, max_files: int | None = None):
    """Start the stream; ``trigger(availableNow=True)`` processes what is
    there now, in micro-batches of ``max_files`` input files, then stops.
    Returns the StreamingQuery (call ``awaitTermination()``)."""
    src = (spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files or files_at_a_time(spark))
           .parquet(prompts_dir))
    scored = score.score_prompts(src, text_col, factory, keys).observe(
        "scored", F.count(F.lit(1)).alias("rows"), F.count("score_error").alias("errors"))
    return (scored.writeStream.format("parquet").option("path", out_dir)
            .option("checkpointLocation", checkpoint).outputMode("append")
            .trigger(availableNow=True).start())


def batch_report(spark: SparkSession, progress, start_row: int) -> DataFrame:
    """A row for each micro-batch of a run that scored rows: the engine keeps
    their progress in the driver anyway.  ``start_row``: rows of runs before."""
    run, out = uuid.uuid4().hex, []
    for p in progress:
        seen = p.observedMetrics.get("scored")
        if seen is not None and seen["rows"]:
            out.append((run, p.batchId, p.timestamp, p.batchDuration / 1000, start_row, seen["rows"], seen["errors"]))
            start_row += seen["rows"]
    total = sum(r[3] for r in out)
    return spark.createDataFrame([(*r, total) for r in out], REPORT)


def run_incremental(spark: SparkSession, prompts_dir: str, out_dir: str, checkpoint: str,
                    schema, text_col: str = "prompt_text", keys=None,
                    factory=score.KeywordPredictor, max_files: int | None = None, report_dir: str | None = None) -> DataFrame:
    """Run the stream to completion and return everything scored so far.
    ``report_dir``: where the run's report is appended (none for a run that
    found nothing new); the sum of its rows so far is the next run's start row."""
    if report_dir:
        # the engine keeps this many batches' progress: enough for all of a run
        n = len(spark.read.schema(schema).parquet(prompts_dir).inputFiles())
        spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", str(max(100, n + 10)))
    q = score_stream(spark, prompts_dir, out_dir, checkpoint, schema, text_col, keys, factory, max_files)
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()
    if report_dir:
        spark.createDataFrame([], REPORT).write.mode("append").parquet(report_dir)
        before = read_report(spark, report_dir).agg(F.sum("rows")).first()[0] or 0
        batch_report(spark, q.recentProgress, before).write.mode("append").parquet(report_dir)
    return spark.read.parquet(out_dir)


def read_report(spark: SparkSession, report_dir: str) -> DataFrame:
    return spark.read.schema(REPORT).parquet(report_dir)
