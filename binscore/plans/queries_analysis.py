"""Registered queries: scalar text operators, cleaning and metric tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from binscore.functions import text as T
from binscore.operators import joins, metrics
from binscore.plans import analysis
from binscore.plans.catalog import register
from binscore.plans.oracle import (CONFUSION, clean, cnt, has_err, interp, norm, parse, sql)
from binscore.sources import testbed
from binscore.sources.tables import read_table

RUN_OUT = ("project_name", "github_path", "model", "comments_included", "prompting")


# ---- flagship and metric tables -------------------------------------------------

@register("config_summary", sql("SELECT * FROM summary"))
def q_config_summary(spark, sf_dir):
    return analysis.config_summary(spark, sf_dir)


@register("project_metrics", sql("SELECT * FROM project_metrics"))
def q_project_metrics(spark, sf_dir):
    return analysis.project_metrics(spark, sf_dir)


@register("summary_and_projects", sql("""
  SELECT model, comments_included, prompting, NULL AS project, total_inferences, precision, recall, f1, tp, fp, tn, fn FROM summary
  UNION ALL SELECT model, comments_included, prompting, project, NULL, precision, recall, f1, tp, fp, tn, fn FROM project_metrics"""))
def q_summary_and_projects(spark, sf_dir):
    """D1 and D2 from one scan and one exchange (grouping sets)."""
    summary, projects = analysis.summary_and_projects(spark, sf_dir)
    cols = ["model", "comments_included", "prompting", "project", "total_inferences", "precision", "recall", "f1", "tp", "fp", "tn", "fn"]
    return (summary.withColumn("project", F.lit(None).cast("string")).select(*cols)
            .unionByName(projects.withColumn("total_inferences", F.lit(None).cast("bigint")).select(*cols)))


@register("coverage_counts", sql("""
  SELECT model, comments_included, prompting, count(*) AS total_inferences, count(response) AS responses,
    count(prediction) AS yes_no, count(interpreted) AS heuristic
  FROM runs_eval GROUP BY ALL"""))
def q_coverage_counts(spark, sf_dir):
    return (analysis.evaluated_runs(spark, sf_dir)
            .groupBy(*metrics.CONFIG_KEYS).agg(*metrics.coverage_aggs()))


@register("label_value_counts", sql(f"""
  SELECT model, comments_included, prompting, {cnt('label = 1')} AS gt_true, {cnt('label = 0')} AS gt_false,
    {cnt('prediction = 1')} AS predicted_true, {cnt('prediction = 0')} AS predicted_false
  FROM runs_eval GROUP BY ALL"""))
def q_label_value_counts(spark, sf_dir):
    return (analysis.evaluated_runs(spark, sf_dir)
            .groupBy(*metrics.CONFIG_KEYS).agg(*metrics.value_count_aggs()))


@register("confusion", sql(f"""
  SELECT project_name AS project, model, comments_included, prompting, {CONFUSION}
  FROM runs_eval WHERE prediction IS NOT NULL GROUP BY ALL"""))
def q_confusion(spark, sf_dir):
    return (analysis.evaluated_runs(spark, sf_dir).where("prediction is not null")
            .groupBy(F.col("project_name").alias("project"), *metrics.CONFIG_KEYS)
            .agg(*metrics.confusion_aggs()))


@register("precision_recall_f1", sql(
    "SELECT project, model, comments_included, prompting, precision, recall, f1 FROM project_metrics"))
def q_prf(spark, sf_dir):
    return analysis.project_metrics(spark, sf_dir).select(
        "project", *metrics.CONFIG_KEYS, "precision", "recall", "f1")


@register("zero_positive_projects", sql("SELECT project FROM skipped_projects"))
def q_zero_positive_projects(spark, sf_dir):
    s = testbed.samples(spark, sf_dir)
    return metrics.zero_positive_projects(testbed.split_of(s, "test"))


@register("error_keys", sql("SELECT project_name, github_path FROM error_keys"))
def q_error_keys(spark, sf_dir):
    return joins.error_keys(testbed.runs(spark, sf_dir)).orderBy("project_name", "github_path")


@register("anti_join_errors", sql(
    f"SELECT {', '.join(RUN_OUT)}, label, response, prediction, errors FROM runs_clean"))
def q_anti_join_errors(spark, sf_dir):
    return joins.anti_join_errors(testbed.runs(spark, sf_dir)).select(
        *RUN_OUT, "label", "response", "prediction", "errors")


@register("anti_join_skipped_projects", sql(
    f"SELECT {', '.join(RUN_OUT)}, label, prediction FROM runs_eval"))
def q_anti_join_skipped(spark, sf_dir):
    return analysis.evaluated_runs(spark, sf_dir).select(*RUN_OUT, "label", "prediction")


# ---- response text operators ---------------------------------------------------

@register("clean_response", sql(f"""
  SELECT {', '.join(RUN_OUT)}, {clean('response')} AS cleaned FROM runs
  UNION ALL SELECT 'conversations', CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR), role, NULL, NULL,
    {clean('text')} FROM conversations"""))
def q_clean_response(spark, sf_dir):
    runs = testbed.runs(spark, sf_dir).select(*RUN_OUT, T.clean_response("response").alias("cleaned"))
    conv = read_table(spark, sf_dir, "conversations", ["conv_id", "turn", "role", "text"]).select(
        F.lit("conversations").alias("project_name"),
        F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("github_path"),
        F.col("role").alias("model"), F.lit(None).cast("boolean").alias("comments_included"),
        F.lit(None).cast("string").alias("prompting"), T.clean_response("text").alias("cleaned"))
    return runs.unionByName(conv)


@register("parse_yes_no", sql(f"""
  SELECT 'runs' AS source, project_name || '|' || github_path || '|' || model || '|' ||
      CAST(comments_included AS VARCHAR) || '|' || prompting AS id, {parse(clean('response'))} AS parsed FROM runs
  UNION ALL SELECT 'documents', CAST(doc_id AS VARCHAR), {parse(clean('text'))} FROM documents
  UNION ALL SELECT 'conversations', CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR),
    {parse(clean('text'))} FROM conversations"""))
def q_parse_yes_no(spark, sf_dir):
    runs = testbed.runs(spark, sf_dir).select(
        F.lit("runs").alias("source"),
        F.concat_ws("|", "project_name", "github_path", "model",
                    F.lower(F.col("comments_included").cast("string")), "prompting").alias("id"),
        T.parse_yes_no(T.clean_response("response")).alias("parsed"))
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "text"]).select(
        F.lit("documents").alias("source"), F.col("doc_id").cast("string").alias("id"),
        T.parse_yes_no(T.clean_response("text")).alias("parsed"))
    conv = read_table(spark, sf_dir, "conversations", ["conv_id", "turn", "text"]).select(
        F.lit("conversations").alias("source"),
        F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"),
        T.parse_yes_no(T.clean_response("text")).alias("parsed"))
    return runs.unionByName(docs).unionByName(conv)


@register("interpret_response", sql(f"""
  SELECT 'runs' AS source, project_name || '|' || github_path || '|' || model || '|' ||
      CAST(comments_included AS VARCHAR) || '|' || prompting AS id, {interp('response')} AS bug FROM runs
  UNION ALL SELECT 'conversations', CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR),
    {interp('text')} FROM conversations"""))
def q_interpret_response(spark, sf_dir):
    runs = testbed.runs(spark, sf_dir).select(
        F.lit("runs").alias("source"),
        F.concat_ws("|", "project_name", "github_path", "model",
                    F.lower(F.col("comments_included").cast("string")), "prompting").alias("id"),
        T.interpret_response("response").alias("bug"))
    conv = read_table(spark, sf_dir, "conversations", ["conv_id", "turn", "text"]).select(
        F.lit("conversations").alias("source"),
        F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"),
        T.interpret_response("text").alias("bug"))
    return runs.unionByName(conv)


@register("interpreted_column", sql(
    f"SELECT {', '.join(RUN_OUT)}, interpreted FROM runs_clean"))
def q_interpreted_column(spark, sf_dir):
    return analysis.clean_runs(testbed.runs(spark, sf_dir)).select(*RUN_OUT, "interpreted")


@register("has_error", sql(f"SELECT {', '.join(RUN_OUT)}, {has_err('errors')} AS has_error FROM runs"))
def q_has_error(spark, sf_dir):
    return testbed.runs(spark, sf_dir).select(*RUN_OUT, T.has_error("errors").alias("has_error"))


@register("fill_prediction", sql(
    f"SELECT {', '.join(RUN_OUT)}, coalesce(prediction, interpreted) AS filled FROM runs_clean"))
def q_fill_prediction(spark, sf_dir):
    return analysis.clean_runs(testbed.runs(spark, sf_dir)).select(
        *RUN_OUT, T.fill_prediction().alias("filled"))


@register("normalise_key", sql(f"""
  SELECT doc_id, {norm("' ' || upper(project_name) || chr(9)")} AS project,
         {norm("upper(github_path) || chr(10)")} AS path FROM samples"""))
def q_normalise_key(spark, sf_dir):
    s = testbed.samples(spark, sf_dir)
    return s.select(
        "doc_id",
        T.normalise_key(F.concat(F.lit(" "), F.upper("project_name"), F.lit("\t"))).alias("project"),
        T.normalise_key(F.concat(F.upper("github_path"), F.lit("\n"))).alias("path"))


@register("as_bool", sql("SELECT doc_id, CAST(file_available AS BOOLEAN) AS available FROM samples"))
def q_as_bool(spark, sf_dir):
    return testbed.samples(spark, sf_dir).select("doc_id", T.as_bool("file_available").alias("available"))

