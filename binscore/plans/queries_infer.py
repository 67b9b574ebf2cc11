"""Registered queries: source text, exemplars, prompts, scoring, file I/O and
incremental scoring (A1-A9, B1-B9, B16, C4, C5, D12, F2, F4, F5, G1, G3, K1)."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from binscore.functions import text as T
from binscore.functions.prompts import render_prompt
from binscore.operators import joins, lookup, metrics, score, tokens
from binscore.plans import analysis, inference
from binscore.plans.catalog import register
from binscore.plans import queries_pipeline  # noqa: F401  (SQL of the prompts without comments)
from binscore.plans.oracle import cnt, has_err, sql, ws_tokens
from binscore.session import scratch_dir
from binscore.sources import files, testbed
from binscore.streaming import incremental

S4 = "project_name, file, github_path, label"


def _md5(c: str):
    return F.md5(F.col(c).cast("binary"))


# ---- B1, B2, B3, B4, B5, A5 ----------------------------------------------------------

@register("filter_available", sql(
    f"SELECT doc_id, {S4} FROM samples WHERE split = 'test' AND file_available = 1"))
def q_filter_available(spark, sf_dir):
    s = testbed.split_of(testbed.samples(spark, sf_dir), "test")
    return inference.project_sample_cols(inference.filter_available(s), ["doc_id"])


@register("project_sample_cols", sql(f"SELECT doc_id, {S4} FROM samples WHERE split = 'test'"))
def q_project_sample_cols(spark, sf_dir):
    s = testbed.split_of(testbed.samples(spark, sf_dir), "test")
    return inference.project_sample_cols(s, ["doc_id"])


@register("alias_project", sql("""
  SELECT doc_id, project_name, CASE project_name WHEN 'Openolat' THEN 'OpenOLAT' WHEN 'Exoplayer' THEN 'ExoPlayer'
    ELSE project_name END AS project
  FROM (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'Openolat' WHEN 1 THEN 'Exoplayer' WHEN 2 THEN 'OpenOLAT'
          ELSE project_name END AS project_name FROM samples)"""))
def q_alias_project(spark, sf_dir):
    """Every sample; three in five carry one of the spellings concerned."""
    names = F.array(F.lit("Openolat"), F.lit("Exoplayer"), F.lit("OpenOLAT"))
    s = testbed.samples(spark, sf_dir).withColumn(
        "project_name", F.coalesce(F.get(names, (F.col("doc_id") % 5).cast("int")), "project_name"))
    return s.select("doc_id", "project_name", lookup.alias_project("project_name").alias("project"))


@register("resolve_case_variants", sql("""
  SELECT n.project_name, CASE
      WHEN n.project_name IN (SELECT project FROM files_with) THEN n.project_name
      WHEN lower(substr(n.project_name, 1, 1)) || substr(n.project_name, 2) IN (SELECT project FROM files_with)
        THEN lower(substr(n.project_name, 1, 1)) || substr(n.project_name, 2)
      WHEN upper(substr(n.project_name, 1, 1)) || substr(n.project_name, 2) IN (SELECT project FROM files_with)
        THEN upper(substr(n.project_name, 1, 1)) || substr(n.project_name, 2) END AS project_dir
  FROM (SELECT DISTINCT project_name FROM samples
        UNION SELECT DISTINCT upper(substr(project_name, 1, 1)) || substr(project_name, 2) FROM samples
        UNION SELECT DISTINCT upper(project_name) FROM samples) n"""))
def q_resolve_case_variants(spark, sf_dir):
    s = testbed.samples(spark, sf_dir)
    names = (s.select("project_name")
             .unionByName(s.select(T.first_upper("project_name").alias("project_name")))
             .unionByName(s.select(F.upper("project_name").alias("project_name"))))
    dirs = testbed.source_files(spark, sf_dir, "with").select("project")
    return lookup.resolve_project_dirs(names, dirs, "project_name", "project_dir")


_PATH_KINDS = {
    "raw": lambda p: p,
    "dots": lambda p: F.concat(F.lit("/"), F.regexp_replace(p, "^/src/", "src/./x/../")),
    "slashes": lambda p: F.regexp_replace(p, "/", "//"),
    "climb": lambda p: F.concat(F.lit("/../"), p),
}


@register("normalise_path", sql("\n  UNION ALL ".join(
    f"SELECT doc_id, '{k}' AS kind, {'NULL' if k == 'climb' else chr(39).join(['ltrim(github_path, ', '/', ')'])}"
    " AS path FROM samples" for k in _PATH_KINDS)))
def q_normalise_path(spark, sf_dir):
    s = testbed.samples(spark, sf_dir)
    out = None
    for kind, make in _PATH_KINDS.items():
        part = s.select("doc_id", F.lit(kind).alias("kind"),
                        T.normalise_path(make(F.col("github_path"))).alias("path"))
        out = part if out is None else out.unionByName(part)
    return out


@register("select_variant", sql("SELECT doc_id, project, path, md5(text) AS text_md5 FROM files_without"))
def q_select_variant(spark, sf_dir):
    f = testbed.source_files(spark, sf_dir, "without")
    return f.select("doc_id", "project", "path",
                                                       _md5("text").alias("text_md5"))


# ---- C4, D12, F5, C5 ---------------------------------------------------------------

@register("join_source_text", sql(
    "SELECT doc_id, project_name, github_path, status, md5(content) AS content_md5 FROM zs_in"))
def q_join_source_text(spark, sf_dir):
    z = inference.zero_shot_inputs(spark, sf_dir, "with")
    return z.select("doc_id", "project_name", "github_path", "status", _md5("content").alias("content_md5"))


@register("pick_exemplars", sql("SELECT project_name, positive_example, negative_example FROM exemplars"))
def q_pick_exemplars(spark, sf_dir):
    return joins.pick_exemplars(testbed.split_of(testbed.samples(spark, sf_dir), "train"))


@register("top1_per_group", sql("""
  SELECT project_name, label, github_path, token_size FROM (
    SELECT project_name, label, github_path, token_size, row_number() OVER (
      PARTITION BY project_name, label ORDER BY token_size ASC NULLS LAST, github_path) AS rn
    FROM samples WHERE split = 'train') WHERE rn = 1"""))
def q_top1_per_group(spark, sf_dir):
    train = testbed.split_of(testbed.samples(spark, sf_dir), "train")
    best = F.min(F.struct(F.col("token_size").isNull().alias("_null"), "token_size", "github_path"))
    return (train.groupBy("project_name", "label").agg(best.alias("b"))
                 .select("project_name", "label", "b.github_path", "b.token_size"))


@register("join_exemplars", sql("""
  SELECT s.doc_id, s.project_name, s.github_path, e.positive_example, e.negative_example
  FROM samples s JOIN exemplars e ON s.project_name = e.project_name WHERE s.split = 'test'"""))
def q_join_exemplars(spark, sf_dir):
    s = testbed.samples(spark, sf_dir)
    ex = joins.pick_exemplars(testbed.split_of(s, "train"))
    test = testbed.split_of(s, "test").select("doc_id", "project_name", "github_path")
    return joins.join_exemplars(test, ex)


# ---- B7, B8, B9, B16 ---------------------------------------------------------------

@register("zero_shot_prompt", sql("SELECT doc_id, md5(prompt_text) AS prompt_md5 FROM zs_in"))
def q_zero_shot_prompt(spark, sf_dir):
    z = inference.zero_shot_inputs(spark, sf_dir, "with")
    return z.select("doc_id", F.md5(render_prompt("prompt").cast("binary")).alias("prompt_md5"))


@register("two_shot_prompt", sql("SELECT doc_id, md5(prompt_text) AS prompt_md5 FROM fs_in"))
def q_two_shot_prompt(spark, sf_dir):
    f = inference.few_shot_inputs(spark, sf_dir, "with")
    return f.select("doc_id", F.md5(render_prompt("prompt").cast("binary")).alias("prompt_md5"))


@register("prompt_token_size", sql(f"""
  SELECT 'zeroShot' AS prompting, doc_id, {ws_tokens('prompt_text')} AS prompt_tokens FROM zs_in
  UNION ALL SELECT 'fewShot', doc_id, {ws_tokens('prompt_text')} FROM fs_in"""))
def q_prompt_token_size(spark, sf_dir):
    z = inference.with_prompt_text(inference.zero_shot_inputs(spark, sf_dir, "with"))
    f = inference.with_prompt_text(inference.few_shot_inputs(spark, sf_dir, "with"))
    return (z.select(F.lit("zeroShot").alias("prompting"), "doc_id", "prompt_tokens")
             .unionByName(f.select(F.lit("fewShot").alias("prompting"), "doc_id", "prompt_tokens")))


@register("prompt_token_size_bpe")
def q_prompt_token_size_bpe(spark, sf_dir):
    """B9 with a public byte-level tokenizer plugged in, over the prompts as a chat
    model gets them; held against the library in tests, as SQL has no merges."""
    import public_tokenizers
    path = public_tokenizers.path("byte_bpe_50k.json")
    out = [tokens.prompt_sizes(rows.select("doc_id", "prompt"), "prompt", tokens.CHATML, tokens.LibraryTokenizer, path)
           .select(F.lit(style).alias("prompting"), "doc_id", "prompt_tokens")
           for style, rows in (("zeroShot", inference.zero_shot_inputs(spark, sf_dir, "with")),
                               ("fewShot", inference.few_shot_inputs(spark, sf_dir, "with")))]
    return out[0].unionByName(out[1])


@register("classify_failure", sql("""
  SELECT 'zeroShot' AS prompting, doc_id, status, failure FROM zs_in
  UNION ALL SELECT 'fewShot', doc_id, status, failure FROM fs_in"""))
def q_classify_failure(spark, sf_dir):
    z = inference.zero_shot_inputs(spark, sf_dir, "with")
    f = inference.few_shot_inputs(spark, sf_dir, "with")
    return (z.select(F.lit("zeroShot").alias("prompting"), "doc_id", "status", "failure")
             .unionByName(f.select(F.lit("fewShot").alias("prompting"), "doc_id", "status", "failure")))


# ---- K1, G1 ------------------------------------------------------------------------

_RAW = "doc_id, project_name, github_path, label, response, prediction, errors, token_size"


def _scored(spark, sf_dir):
    z = inference.score_inputs(inference.zero_shot_inputs(spark, sf_dir, "with"), False)
    f = inference.score_inputs(inference.few_shot_inputs(spark, sf_dir, "with"), True)
    return z, f


@register("score_batch_udf", sql(f"""
  SELECT 'zeroShot' AS prompting, {_RAW} FROM zs_scored
  UNION ALL SELECT 'fewShot', {_RAW} FROM fs_scored"""))
def q_score_batch_udf(spark, sf_dir):
    z, f = _scored(spark, sf_dir)
    cols = [c.strip() for c in _RAW.split(",")]
    return (z.select(F.lit("zeroShot").alias("prompting"), *cols)
             .unionByName(f.select(F.lit("fewShot").alias("prompting"), *cols)))


def _limited_sql(style: str, src: str) -> str:
    n = ws_tokens("prompt_text")
    ok = f"{n} BETWEEN {score.MIN_TOKENS} AND {score.MAX_TOKENS}"
    return f"""
  SELECT '{style}' AS prompting, doc_id, CASE WHEN {ok} THEN response END AS response,
    CASE WHEN {ok} THEN prediction END AS prediction,
    CASE WHEN failure IS NOT NULL THEN failure WHEN {n} > {score.MAX_TOKENS} THEN '{score.TOO_LONG}'
         WHEN {n} < {score.MIN_TOKENS} THEN '0 answers to 1 prompt' END AS errors,
    CASE WHEN {ok} THEN token_size END AS token_size
  FROM (SELECT s.*, i.prompt_text, i.failure FROM {src}_scored s JOIN {src}_in i ON s.doc_id = i.doc_id)"""


@register("score_batch_errors", sql(f"{_limited_sql('zeroShot', 'zs')} UNION ALL {_limited_sql('fewShot', 'fs')}"))
def q_score_batch_errors(spark, sf_dir):
    """K1 with a predictor that fails on some prompts and answers too few:
    only those rows carry an error, every other row its answer."""
    parts = []
    for style, few, inputs in (("zeroShot", False, inference.zero_shot_inputs), ("fewShot", True, inference.few_shot_inputs)):
        out = inference.score_inputs(inputs(spark, sf_dir, "with"), few, score.LimitedPredictor)
        parts.append(out.select(F.lit(style).alias("prompting"), "doc_id", "response", "prediction", "errors", "token_size"))
    return parts[0].unionByName(parts[1])


@register("union_runs", sql(f"""
  SELECT 'zeroShot' AS prompting, {_RAW}, NULL AS positive_example, NULL AS negative_example FROM zs_scored
  UNION ALL SELECT 'fewShot', {_RAW}, positive_example, negative_example FROM fs_scored"""))
def q_union_runs(spark, sf_dir):
    from binscore.operators.reshape import union_runs
    z, f = _scored(spark, sf_dir)
    cols = [c.strip() for c in _RAW.split(",")]
    return union_runs([z.select(F.lit("zeroShot").alias("prompting"), *cols),
                       f.select(F.lit("fewShot").alias("prompting"), *cols, "positive_example",
                                "negative_example")])


@register("distinct_keys", sql("SELECT DISTINCT project_name, github_path FROM runs"))
def q_distinct_keys(spark, sf_dir):
    return testbed.runs(spark, sf_dir).select("project_name", "github_path").distinct()


@register("sort_errors", sql(
    f"SELECT DISTINCT project_name, github_path FROM runs WHERE {has_err('errors')} ORDER BY 1, 2"))
def q_sort_errors(spark, sf_dir):
    return joins.error_keys(testbed.runs(spark, sf_dir)).orderBy("project_name", "github_path")


@register("limit_batches", sql("""
  SELECT doc_id, CAST((rn - 1) // 5 AS INTEGER) AS batch_number FROM (
    SELECT doc_id, row_number() OVER (ORDER BY project_name, github_path) AS rn
    FROM samples WHERE split = 'test' AND file_available = 1) WHERE rn <= 15"""))
def q_limit_batches(spark, sf_dir):
    s = q_filter_available(spark, sf_dir)
    return inference.limit_batches(s, ["project_name", "github_path"], 3).select("doc_id", "batch_number")


@register("all_batches", sql("""
  SELECT doc_id, CAST((row_number() OVER (ORDER BY project_name, github_path) - 1) // 5 AS INTEGER) AS batch_number
  FROM samples WHERE split = 'test' AND file_available = 1"""))
def q_all_batches(spark, sf_dir):
    s = q_filter_available(spark, sf_dir)
    return inference.limit_batches(s, ["project_name", "github_path"], None).select("doc_id", "batch_number")


# ---- A1, A3, A4, A6, A7, A8, A9 ------------------------------------------------------

def _staged_runs(spark, sf_dir, by):
    """The run table, derived once and written with a folder per ``by``, so
    that each part written from it reads its own rows only."""
    path = scratch_dir(spark, "runs")
    files.sink_table(testbed.runs(spark, sf_dir).hint("rebalance", *by), path, partition_by=by)
    return spark.read.parquet(path)


RUN_SCHEMA = ("project_name string, file string, github_path string, label int, response string, "
              "prediction int, errors string")
_RUN_COLS = "project_name, file, github_path, label, response, prediction, errors"


@register("scan_csv", sql(f"SELECT {_RUN_COLS} FROM runs"))
def q_scan_csv(spark, sf_dir):
    path = scratch_dir(spark, "scan-csv")
    runs = testbed.runs(spark, sf_dir).select(*[c.strip() for c in _RUN_COLS.split(",")])
    files.write_csv_table(runs, path)
    return files.read_csv_table(spark, path, RUN_SCHEMA)


@register("scan_runs_with_file_meta", sql(f"""
  SELECT model, comments_included, prompting, {_RUN_COLS} FROM runs
  UNION ALL SELECT 'qwen', true, NULL, {_RUN_COLS} FROM runs
  WHERE model = 'qwen' AND comments_included AND prompting = 'zeroShot'"""))
def q_scan_runs_with_file_meta(spark, sf_dir):
    """One CSV entry per configuration, as the inference writes them, plus a
    file of another model, a non-run file and a name without prompting."""
    folder = scratch_dir(spark, "runs-dir")
    runs = _staged_runs(spark, sf_dir, ["model", "comments_included", "prompting"])
    cols = [c.strip() for c in _RUN_COLS.split(",")]
    for m in testbed.MODELS:
        for ci in (False, True):
            for pr in ("zeroShot", "fewShot"):
                part = runs.where((F.col("model") == m) & (F.col("comments_included") == ci)
                                  & (F.col("prompting") == pr)).select(*cols)
                files.write_csv_table(part, os.path.join(folder, files.run_file_name(m, ci, pr)))
    qwen_zero = runs.where("model = 'qwen' AND comments_included AND prompting = 'zeroShot'").select(*cols)
    files.write_csv_table(qwen_zero, os.path.join(folder, files.run_file_name("qwen", True, None)))
    files.write_csv_table(qwen_zero, os.path.join(folder, "llama_withComments_zeroShot.csv"))
    files.write_csv_table(qwen_zero, os.path.join(folder, "notes.csv"))
    return files.scan_runs_dir(spark, folder, RUN_SCHEMA)


@register("read_source_text", sql(
    "SELECT project, path, md5(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10))) AS text_md5 "
    "FROM files_with"))
def q_read_source_text(spark, sf_dir):
    root = scratch_dir(spark, "source-tree")
    tree = testbed.source_files(spark, sf_dir, "with").select("project", "path", "text")
    files.write_source_tree(tree, root).count()
    return files.read_source_tree(spark, root).select("project", "path", _md5("text").alias("text_md5"))


@register("sink_table", sql("SELECT * FROM summary"))
def q_sink_table(spark, sf_dir):
    path = scratch_dir(spark, "summary")
    files.sink_table(analysis.config_summary(spark, sf_dir), path)
    return spark.read.parquet(path)


@register("sink_skip_list", sql("SELECT project AS value FROM skipped_projects"))
def q_sink_skip_list(spark, sf_dir):
    path = scratch_dir(spark, "skipped")
    s = testbed.samples(spark, sf_dir)
    files.sink_lines(metrics.zero_positive_projects(testbed.split_of(s, "test")), "project", path)
    return spark.read.text(path)


@register("combine_batches", sql(f"SELECT model, comments_included, prompting, {_RUN_COLS} FROM runs"))
def q_combine_batches(spark, sf_dir):
    root = scratch_dir(spark, "batches")
    runs = _staged_runs(spark, sf_dir, ["model"]).select("model", "comments_included", "prompting",
                                                         *[c.strip() for c in _RUN_COLS.split(",")])
    paths = []
    for i, m in enumerate(testbed.MODELS):
        p = os.path.join(root, f"batch_{i}")
        files.sink_table(runs.where(F.col("model") == m), p)
        paths.append(p)
    return files.combine_batches(spark, paths)


def _staged_prompts(spark, sf_dir, prompts_dir, comments="with"):
    keys = ["doc_id", "project_name", "github_path", "label", "failure"]
    staged = inference.zero_shot_inputs(spark, sf_dir, comments).select(*keys, render_prompt("prompt").alias("prompt_text"))
    staged.write.mode("append").parquet(prompts_dir)
    return keys, spark.read.parquet(prompts_dir).schema


@register("score_incremental", sql(f"SELECT {_RAW} FROM zs_scored"))
def q_score_incremental(spark, sf_dir):
    """Prompts staged as parquet files, scored by an availableNow stream into
    a parquet sink."""
    root = scratch_dir(spark, "incremental")
    prompts_dir, out_dir, ckpt = (os.path.join(root, x) for x in ("prompts", "scored", "checkpoint"))
    keys, schema = _staged_prompts(spark, sf_dir, prompts_dir)
    out = incremental.run_incremental(spark, prompts_dir, out_dir, ckpt, schema, "prompt_text", keys)
    return out.select("doc_id", "project_name", "github_path", "label", "response", "prediction",
                      F.coalesce("failure", "score_error").alias("errors"), "token_size")


@register("run_report", sql(f"""
  SELECT 1 AS run, 0::BIGINT AS start_row, count(*) AS rows, {cnt(f"token_size > {score.CONTEXT_TOKENS}")} AS errors, true AS timed
  FROM zs_scored HAVING count(*) > 0
  UNION ALL SELECT 2, count(*), count(*), {cnt(f"n > {score.CONTEXT_TOKENS}")}, true
  FROM (SELECT CASE WHEN prompt_text IS NOT NULL THEN {ws_tokens('prompt_text')} END AS n FROM nc_zs_in) HAVING count(*) > 0"""))
def q_run_report(spark, sf_dir):
    """Three runs of a scorer that refuses long prompts: the prompts with
    comments; the same again, which finds nothing; those without comments added."""
    root = scratch_dir(spark, "report")
    prompts_dir, out_dir, ckpt, report = (os.path.join(root, x) for x in ("prompts", "scored", "checkpoint", "report"))
    for comments in ("with", None, "without"):
        if comments:
            keys, schema = _staged_prompts(spark, sf_dir, prompts_dir, comments)
        incremental.run_incremental(spark, prompts_dir, out_dir, ckpt, schema, "prompt_text", keys, score.ThirdPredictor,
                                    report_dir=report)
    per_run = incremental.read_report(spark, report).groupBy(F.col("run").alias("_run")).agg(
        F.min("start_row").alias("start_row"), F.sum("rows").alias("rows"), F.sum("errors").alias("errors"),
        ((F.min("seconds") > 0) & (F.max("total_seconds") >= F.sum("seconds") - 1e-6)).alias("timed"))
    return per_run.select(F.when(F.col("start_row") == 0, 1).otherwise(2).alias("run"), "start_row", "rows", "errors", "timed")


@register("scan_pruned", sql("SELECT doc_id, source FROM documents"))
def q_scan_pruned(spark, sf_dir):
    """A2: only the named columns are read (the scan's ReadSchema holds
    just them; the large text column is never decoded)."""
    from binscore.sources.tables import read_table
    return read_table(spark, sf_dir, "documents", ["doc_id", "source"])
