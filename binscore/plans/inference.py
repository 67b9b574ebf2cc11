"""Entry 1, inference: samples -> source text [-> exemplars] -> prompt ->
scorer -> raw output table.

Zero-shot keeps available test files (B1), few-shot pairs every test file
with its project's smallest positive and negative train file (D12, C5).
Lookup failures (B16) keep their row with an error text and no prompt.
Exemplar texts are looked up once per project, not once per test row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from binscore.functions.prompts import render_prompt, two_shot_prompt, zero_shot_prompt
from binscore.functions.text import whitespace_token_count
from binscore.operators import joins, lookup, ranking, score
from binscore.session import scratch_dir
from binscore.sources import testbed
from binscore.sources.files import sink_table

SAMPLE_COLS = ("project_name", "file", "github_path", "label")
BATCH_SIZE = 5
EXEMPLAR_KINDS = ("positive", "negative")


def filter_available(df: DataFrame) -> DataFrame:
    """B1: files marked available."""
    return df.where(F.col("file_available") == 1)


def project_sample_cols(df: DataFrame, extra=()) -> DataFrame:
    """B2: the columns the inference keeps."""
    return df.select(*extra, *SAMPLE_COLS)


def zero_shot_inputs(spark, sf_dir: str, variant: str = "with") -> DataFrame:
    """Test files with their text, status, failure text and prompt."""
    s = testbed.samples(spark, sf_dir)
    test = project_sample_cols(filter_available(testbed.split_of(s, "test")), ["doc_id"])
    files = testbed.source_files(spark, sf_dir, variant)
    looked = lookup.lookup_text(test, files, "github_path", "content")
    status = lookup.status_of("content")
    prompt = F.when(status == 1, zero_shot_prompt("content"))
    return looked.select(
        "doc_id", *SAMPLE_COLS, status.alias("status"),
        lookup.failure_text(status, few_shot=False).alias("failure"),
        prompt.alias("prompt"), F.col("content"))


def exemplar_texts(spark, sf_dir: str, variant: str = "with", samples_df=None) -> DataFrame:
    """D12 + C4: per project the exemplar paths and their texts (one row per
    project with both exemplars).  Both kinds are looked up in one pass over
    the files."""
    s = samples_df if samples_df is not None else testbed.samples(spark, sf_dir)
    ex = joins.pick_exemplars(testbed.split_of(s, "train"))
    files = testbed.source_files(spark, sf_dir, variant)
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"{k}_example").alias("example"))
                                for k in EXEMPLAR_KINDS]))
    paths = [f"{k}_example" for k in EXEMPLAR_KINDS]
    long = ex.select("project_name", *paths, kinds.alias("_k")).select("project_name", *paths, "_k.*")
    found = lookup.lookup_text(long, files, "example", "text", dirs=files.select("project"))
    return found.groupBy("project_name", *paths).agg(*[
        F.max(F.when(F.col("kind") == k, F.col("text"))).alias(f"{k}_text") for k in EXEMPLAR_KINDS])


def few_shot_inputs(spark, sf_dir: str, variant: str = "with") -> DataFrame:
    """Test files of projects with both exemplars, the three texts, status,
    failure text and the two-shot prompt."""
    s = testbed.samples(spark, sf_dir)
    test = project_sample_cols(testbed.split_of(s, "test"), ["doc_id"])
    ex = exemplar_texts(spark, sf_dir, variant, s)
    paired = joins.join_exemplars(test, ex)
    files = testbed.source_files(spark, sf_dir, variant)
    looked = lookup.lookup_text(paired, files, "github_path", "content")
    status = lookup.status_of("content", "positive_text", "negative_text")
    prompt = F.when(status == 1, two_shot_prompt("content", "positive_text", "negative_text"))
    return looked.select(
        "doc_id", *SAMPLE_COLS, "positive_example", "negative_example", status.alias("status"),
        lookup.failure_text(status, few_shot=True).alias("failure"), prompt.alias("prompt"),
        F.col("content"))


def with_prompt_text(df: DataFrame) -> DataFrame:
    """Rendered prompt and its whitespace token count."""
    text = render_prompt("prompt")
    return df.withColumn("prompt_text", text).withColumn("prompt_tokens", whitespace_token_count("prompt_text"))


def score_inputs(inputs: DataFrame, few_shot: bool, factory=score.KeywordPredictor) -> DataFrame:
    """K1 on prepared inputs: the raw output table of one configuration
    (sample columns, [exemplars], response, prediction, errors, token_size)."""
    keys = ["doc_id", *SAMPLE_COLS, *(["positive_example", "negative_example"] if few_shot else []),
            "failure"]
    rendered = inputs.withColumn("prompt_text", render_prompt("prompt"))
    scored = score.score_prompts(rendered, "prompt_text", factory, keys)
    return scored.select(*keys[:-1], "response", "prediction",
                         score.merge_errors().alias("errors"), "token_size")


#: Shipped predictors, one per model name.
PREDICTORS = {"artigenz": score.KeywordPredictor, "codellama": score.SecondPredictor, "qwen": score.ThirdPredictor}


def scored_runs(spark, sf_dir: str, factories=PREDICTORS) -> DataFrame:
    """The raw output table of all configurations (models x trees x prompting
    styles), in the shape of the run table that the analysis reads.  Its rows
    carry answers, not texts; they are written once and read back, as several
    steps of the analysis read them."""
    parts = []
    for variant in ("with", "without"):
        for style, inputs in (("zeroShot", zero_shot_inputs), ("fewShot", few_shot_inputs)):
            rendered = inputs(spark, sf_dir, variant).withColumn("prompt_text", render_prompt("prompt"))
            scored = score.score_models(rendered, factories, keys=["doc_id", *SAMPLE_COLS, "failure"])
            parts.append(scored.select(
                *SAMPLE_COLS, "model", F.lit(variant == "with").alias("comments_included"),
                F.lit(style).alias("prompting"), "response", "prediction",
                score.merge_errors().alias("errors"), "doc_id"))
    path = scratch_dir(spark, "scored-runs")
    sink_table(reduce(DataFrame.unionByName, parts), path)
    return spark.read.parquet(path)


def limit_batches(df: DataFrame, order_cols, max_batches: int | None, batch_size: int = BATCH_SIZE) -> DataFrame:
    """the first ``max_batches`` chunks of ``batch_size`` rows in
    ``order_cols`` order (all chunks when ``None``), with their chunk number.
    With a cap this is a distributed top-k, so only ``max_batches *
    batch_size`` rows reach the numbering window; without one the rows are
    numbered by the partition-offset index (no single-task window)."""
    order = [F.col(c) for c in order_cols]
    if max_batches is None:
        numbered = ranking.row_index(df, order_cols, "_rn")
    else:
        top = df.orderBy(*order).limit(max_batches * batch_size)
        numbered = top.withColumn("_rn", F.row_number().over(Window.orderBy(*order)) - 1)
    return numbered.withColumn("batch_number", F.floor(F.col("_rn") / F.lit(batch_size)).cast("int")).drop("_rn")
