"""Registered queries: ranks, ROC/AUC, ML metrics, F1 tables, paired tests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from binscore.functions.text import algorithm_short_name, map_with_default
from binscore.operators import joins, metrics, ranking, reshape, stats
from binscore.plans import analysis, comparison
from binscore.plans.catalog import register
from binscore.plans.oracle import cte, sql
from binscore.plans.oracle_learners import draws, scr
from binscore.session import cut_lineage
from binscore.sources import testbed

G = ("project", "algorithm", "arm")
GS = "project, algorithm, arm"

# ---- fixed values: display names of the language models (chart legend) -------
MODEL_DISPLAY = {
    "artigenz": "Artigenz Coder 6.7b",
    "codellama": "CodeLlama 7b instruct",
    "qwen": "Qwen Coder 7b instruct",
}
# -------------------------------------------------------------------------------


@register("average_rank", sql(f"SELECT {GS}, github_path, score, avg_rank FROM pred_ranked"))
def q_average_rank(spark, sf_dir):
    p = testbed.predictions(spark, sf_dir)
    return ranking.average_rank(p, G, "score").select(*G, "github_path", "score", "avg_rank")


@register("running_tp_fp", sql(f"""
  SELECT {GS}, score AS threshold,
    CAST(sum(npos) OVER (PARTITION BY {GS} ORDER BY score DESC) AS BIGINT) AS tps,
    CAST(sum(nneg) OVER (PARTITION BY {GS} ORDER BY score DESC) AS BIGINT) AS fps
  FROM (SELECT {GS}, score, sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS npos,
          sum(CASE WHEN label = 0 THEN 1 ELSE 0 END) AS nneg FROM predictions GROUP BY ALL)"""))
def q_running_tp_fp(spark, sf_dir):
    p = testbed.predictions(spark, sf_dir)
    return ranking.running_counts(p, G).select(*G, "threshold", "tps", "fps")


@register("roc_curve", sql(f"""
  SELECT {GS}, threshold, CAST(fps AS DOUBLE) / nullif(N, 0) AS fpr, CAST(tps AS DOUBLE) / nullif(P, 0) AS tpr
  FROM (SELECT {GS}, score AS threshold,
      sum(npos) OVER (PARTITION BY {GS} ORDER BY score DESC) AS tps,
      sum(nneg) OVER (PARTITION BY {GS} ORDER BY score DESC) AS fps,
      sum(npos) OVER (PARTITION BY {GS}) AS P, sum(nneg) OVER (PARTITION BY {GS}) AS N
    FROM (SELECT {GS}, score, sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS npos,
            sum(CASE WHEN label = 0 THEN 1 ELSE 0 END) AS nneg FROM predictions GROUP BY ALL))"""))
def q_roc_curve(spark, sf_dir):
    p = testbed.predictions(spark, sf_dir)
    return ranking.roc_curve(p, G).select(*G, "threshold", "fpr", "tpr")


@register("roc_points", sql(f"""
  SELECT {GS}, threshold, CAST(fps AS DOUBLE) / nullif(N, 0) AS fpr, CAST(tps AS DOUBLE) / nullif(P, 0) AS tpr
  FROM (SELECT {GS}, score AS threshold, npos, nneg, sum(npos) OVER (PARTITION BY {GS} ORDER BY score DESC) AS tps,
      sum(nneg) OVER (PARTITION BY {GS} ORDER BY score DESC) AS fps,
      sum(npos) OVER (PARTITION BY {GS}) AS P, sum(nneg) OVER (PARTITION BY {GS}) AS N,
      row_number() OVER (PARTITION BY {GS} ORDER BY score DESC) AS place,
      lead(npos) OVER (PARTITION BY {GS} ORDER BY score DESC) AS npos2,
      lead(nneg) OVER (PARTITION BY {GS} ORDER BY score DESC) AS nneg2
    FROM (SELECT {GS}, score, sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS npos,
            sum(CASE WHEN label = 0 THEN 1 ELSE 0 END) AS nneg FROM predictions GROUP BY ALL))
  WHERE place = 1 OR npos2 IS NULL OR npos <> npos2 OR nneg <> nneg2
  UNION ALL SELECT {GS}, NULL, CASE WHEN bool_or(label = 0) THEN 0.0 END, CASE WHEN bool_or(label = 1) THEN 0.0 END
  FROM predictions GROUP BY {GS}"""))
def q_roc_points(spark, sf_dir):
    """D18 as plotted: without points on a straight, equally spaced stretch."""
    return ranking.roc_points(testbed.predictions(spark, sf_dir), G)


@register("roc_auc", sql(f"SELECT {GS}, auc FROM auc"))
def q_roc_auc(spark, sf_dir):
    return ranking.roc_auc(testbed.predictions(spark, sf_dir), G)


@register("score_minmax", sql(f"""
  SELECT {GS}, github_path, (score - min(score) OVER w) / nullif(max(score) OVER w - min(score) OVER w, 0) AS scaled
  FROM predictions WINDOW w AS (PARTITION BY {GS})"""))
def q_score_minmax(spark, sf_dir):
    p = testbed.predictions(spark, sf_dir)
    return ranking.score_minmax(p, G).select(*G, "github_path", "scaled")


@register("accuracy", sql(f"SELECT {GS}, accuracy FROM ml_eval"))
def q_accuracy(spark, sf_dir):
    p = testbed.predictions(spark, sf_dir)
    return (p.groupBy(*G).agg(F.count(F.lit(1)).alias("n"), *metrics.confusion_aggs())
             .select(*G, metrics.accuracy_col().alias("accuracy")))


@register("evaluate_model", sql("SELECT * FROM ml_metrics"))
def q_evaluate_model(spark, sf_dir):
    return comparison.ml_metrics(spark, sf_dir)


@register("mean_or_default", sql(f"SELECT {GS}, auc FROM ml_eval"))
def q_mean_or_default(spark, sf_dir):
    return comparison.evaluate_predictions(testbed.predictions(spark, sf_dir)).select(*G, "auc")


@register("append_result_rows", sql("""
  SELECT project, algorithm_metric, f1 FROM ml_metrics WHERE algorithm_metric LIKE '% with anti-pattern metrics'
  UNION ALL
  SELECT project, algorithm_metric, f1 FROM ml_metrics WHERE algorithm_metric LIKE '% without_anti-pattern_metrics'"""))
def q_append_result_rows(spark, sf_dir):
    ml = comparison.ml_metrics(spark, sf_dir).select("project", "algorithm_metric", "f1")
    arm_with = ml.where(F.col("algorithm_metric").endswith(comparison.WITH_SUFFIX))
    arm_without = ml.where(F.col("algorithm_metric").endswith(comparison.WITHOUT_SUFFIX))
    return reshape.union_runs([arm_with, arm_without])


@register("filter_valid_algorithms", sql("""
  SELECT project, algorithm_metric, f1 FROM ml_metrics WHERE algorithm_metric IN (
    'CNB with anti-pattern metrics', 'LR with anti-pattern metrics', 'DT with anti-pattern metrics',
    'MLP with anti-pattern metrics', 'SVM with anti-pattern metrics', 'RF with anti-pattern metrics')"""))
def q_filter_valid_algorithms(spark, sf_dir):
    ml = comparison.ml_metrics(spark, sf_dir)
    return ml.where(F.col("algorithm_metric").isin(*comparison.VALID_ALGORITHMS)).select(
        "project", "algorithm_metric", "f1")


@register("rename_columns", sql("""
  SELECT algorithm_metric, CASE WHEN contains(algorithm_metric, 'with anti-pattern metrics')
    THEN split_part(algorithm_metric, ' ', 1) ELSE algorithm_metric END AS short_name
  FROM (SELECT DISTINCT algorithm_metric FROM ml_metrics)"""))
def q_rename_columns(spark, sf_dir):
    ml = comparison.ml_metrics(spark, sf_dir).select("algorithm_metric").distinct()
    return ml.select("algorithm_metric", algorithm_short_name("algorithm_metric").alias("short_name"))


@register("filter_best_config", sql("SELECT * FROM project_metrics WHERE comments_included AND prompting = 'fewShot'"))
def q_filter_best_config(spark, sf_dir):
    return analysis.best_config(analysis.project_metrics(spark, sf_dir))


@register("config_struct", sql("""
  SELECT model || '|' || CAST(comments_included AS VARCHAR) || '|' || prompting AS config, f1 FROM summary"""))
def q_config_struct(spark, sf_dir):
    s = analysis.config_summary(spark, sf_dir).withColumn(
        "cfg", F.struct("model", "comments_included", "prompting"))
    return s.select(F.concat_ws("|", "cfg.model", F.lower(F.col("cfg.comments_included").cast("string")),
                                "cfg.prompting").alias("config"), "f1")


STYLES = ("fewShot", "zeroShot")


@register("filter_config_contains", sql("SELECT * FROM summary WHERE contains(lower(prompting), 'zeroshot')"))
def q_filter_config_contains(spark, sf_dir, style: str = "zeroShot"):
    s = analysis.config_summary(spark, sf_dir)
    return s.where(F.lower("prompting").contains(style.lower()))


@register("mean_scores", sql("""
  SELECT model, comments_included, prompting, avg(precision) AS precision, avg(recall) AS recall, avg(f1) AS f1
  FROM (SELECT *, CASE WHEN contains(lower(prompting), 'zeroshot') THEN 'zeroShot' ELSE 'fewShot' END AS style
        FROM summary) GROUP BY model, comments_included, prompting"""))
def q_mean_scores(spark, sf_dir):
    s = analysis.config_summary(spark, sf_dir)
    zero = metrics.mean_scores(s.where(F.lower("prompting").contains("zeroshot"))).withColumn(
        "prompting", F.lit("zeroShot"))
    few = metrics.mean_scores(s.where(F.lower("prompting").contains("fewshot"))).withColumn(
        "prompting", F.lit("fewShot"))
    return zero.unionByName(few)


@register("sort_model_f1", sql("""
  SELECT prompting, model, comments_included, avg(precision) AS precision, avg(recall) AS recall, avg(f1) AS f1
  FROM summary GROUP BY ALL ORDER BY prompting, model, f1 DESC"""))
def q_sort_model_f1(spark, sf_dir):
    """both tables, few-shot and zero-shot, each by model and F1."""
    parts = [metrics.mean_scores(q_filter_config_contains(spark, sf_dir, style)).withColumn("prompting", F.lit(style))
             for style in STYLES]
    return reduce(DataFrame.unionByName, parts).orderBy("prompting", F.col("model").asc(), F.col("f1").desc())


@register("pivot_llm_f1", sql("SELECT project, artigenz, codellama, qwen FROM f1_wide WHERE artigenz IS NOT NULL "
                               "OR codellama IS NOT NULL OR qwen IS NOT NULL"))
def q_pivot_llm_f1(spark, sf_dir):
    return reshape.pivot_unique(comparison.llm_best_f1(spark, sf_dir), "project", "model", "f1",
                                list(comparison.LLM_NAMES))


@register("pivot_ml_f1", sql("SELECT project, CNB, DT, LR, MLP, RF, SVM FROM f1_wide WHERE CNB IS NOT NULL "
                              "OR DT IS NOT NULL OR LR IS NOT NULL OR MLP IS NOT NULL OR RF IS NOT NULL "
                              "OR SVM IS NOT NULL"))
def q_pivot_ml_f1(spark, sf_dir):
    ml = comparison.ml_with_f1(comparison.ml_metrics(spark, sf_dir))
    return reshape.pivot_unique(ml, "project", "algorithm", "f1", list(comparison.ML_NAMES))


@register("outer_join_f1", sql("SELECT * FROM f1_wide"))
def q_outer_join_f1(spark, sf_dir):
    return comparison.f1_wide(spark, sf_dir)


@register("unpivot_f1", sql("SELECT project, name, f1, family FROM f1_long"))
def q_unpivot_f1(spark, sf_dir):
    return comparison.f1_long(spark, sf_dir)


@register("cross_compare", sql("""
  SELECT l.project, l.name AS llm, m.name AS ml, l.f1 AS llm_f1, m.f1 AS ml_f1
  FROM f1_long l JOIN f1_long m ON l.project = m.project WHERE l.family = 'llm' AND m.family = 'ml'"""))
def q_cross_compare(spark, sf_dir):
    return joins.cross_compare(comparison.f1_wide(spark, sf_dir), comparison.LLM_NAMES, comparison.ML_NAMES)


@register("pairwise_complete", sql("SELECT project, llm, ml, llm_f1, ml_f1 FROM pairs"))
def q_pairwise_complete(spark, sf_dir):
    return comparison.paired_scores(spark, sf_dir)


@register("cles", sql("SELECT llm, ml, n_pairs, cles FROM cles"))
def q_cles(spark, sf_dir):
    return stats.cles(comparison.paired_scores(spark, sf_dir))


@register("wilcoxon", sql("SELECT llm, ml, n_pairs, n, r_plus, r_minus, tie_term, z FROM signed_rank"))
def q_wilcoxon(spark, sf_dir):
    return stats.signed_rank_stats(comparison.paired_scores(spark, sf_dir))


@register("wilcoxon_pvalue", sql(
    "SELECT llm, ml, n_pairs, n, z, round(p_value, 9) AS p_value, p_rounded, cles, cles_rounded FROM paired_tests"))
def q_wilcoxon_pvalue(spark, sf_dir):
    return comparison.comparison(spark, sf_dir).select(
        "llm", "ml", "n_pairs", "n", "z", F.round("p_value", 9).alias("p_value"), "p_rounded", "cles", "cles_rounded")


@register("mask_significance", sql("SELECT llm, ml, p_rounded, cles_rounded, cles_shown FROM paired_tests"))
def q_mask_significance(spark, sf_dir):
    return comparison.comparison(spark, sf_dir).select("llm", "ml", "p_rounded", "cles_rounded", "cles_shown")


@register("pivot_cles", sql("""
  SELECT ml, """ + ", ".join(f"max(CASE WHEN llm = '{x}' THEN round_even(cles, 2) END) AS {x}"
                             for x in ("artigenz", "codellama", "qwen")) + """
  FROM cles GROUP BY ml"""))
def q_pivot_cles(spark, sf_dir):
    c = stats.cles(comparison.paired_scores(spark, sf_dir)).withColumn("cles_rounded", F.bround("cles", 2))
    return reshape.pivot_unique(c, "ml", "llm", "cles_rounded", list(comparison.LLM_NAMES))


_P_TEXT = "CASE WHEN p_rounded = 0 THEN '0' ELSE coalesce(CAST(p_rounded AS VARCHAR), 'nan') END"


def _by_llm(value: str) -> str:
    return ("SELECT ml, " + ", ".join(f"max(CASE WHEN llm = '{x}' THEN {value} END) AS {x}" for x in comparison.LLM_NAMES)
            + " FROM paired_tests GROUP BY ml")


@register("pivot_pvalues", sql(_by_llm("p_rounded")))
def q_pivot_pvalues(spark, sf_dir):
    c = comparison.comparison(spark, sf_dir)
    return reshape.pivot_unique(c, "ml", "llm", "p_rounded", list(comparison.LLM_NAMES))


@register("combined_matrix", sql(_by_llm(f"{_P_TEXT} || ' (' || cles_shown || ')'")))
def q_combined_matrix(spark, sf_dir):
    return comparison.combined_matrix(spark, sf_dir)


# ---- chart data (C9, D14, D15, E3, B25) --------------------------------------------

def _chart_base(spark, sf_dir):
    """F1 with comments; one chart for each prompting style."""
    pm = analysis.project_metrics(spark, sf_dir)
    return pm.where("comments_included").select("prompting", "project", "model", "f1")


_CHART = "(SELECT prompting, project, model, f1 FROM project_metrics WHERE comments_included)"
_BARS = f"""(SELECT * FROM {_CHART} c WHERE (prompting, project) NOT IN (
    SELECT (prompting, project) FROM {_CHART} GROUP BY prompting, project HAVING sum(f1) = 0))"""
CHART_KEY = ("prompting", "project")


MISSED = "-missed"


def _with_missed(spark, sf_dir):
    """The chart's rows, and those of a copy of every project in which each
    positive file was answered with no, so that its F1 is 0."""
    ev = analysis.evaluated_runs(spark, sf_dir).where("comments_included")
    missed = ev.withColumns({"project_name": F.concat("project_name", F.lit(MISSED)),
                             "prediction": F.when(F.col("label") == 1, F.lit(0)).otherwise(F.col("prediction"))})
    pm = metrics.project_metrics(ev.unionByName(missed))
    return pm.select("prompting", "project", "model", "f1")


_MISSED = f"""(SELECT * FROM {_CHART} UNION ALL
  SELECT prompting, project || '{MISSED}', model, 0.0 AS f1 FROM runs_eval_missed)"""
cte("runs_eval_missed", ("runs_eval",), """
  SELECT DISTINCT prompting, project_name AS project, model FROM runs_eval
  WHERE comments_included AND (label = 1 OR prediction IS NOT NULL)""")


@register("zero_f1_projects", sql(
    f"SELECT prompting, project FROM {_MISSED} GROUP BY prompting, project HAVING sum(f1) = 0"))
def q_zero_f1_projects(spark, sf_dir):
    return metrics.zero_f1_projects(_with_missed(spark, sf_dir), CHART_KEY)


@register("anti_join_zero_f1", sql(f"""
  SELECT * FROM {_MISSED} c WHERE (prompting, project) NOT IN (
    SELECT (prompting, project) FROM {_MISSED} GROUP BY prompting, project HAVING sum(f1) = 0)"""))
def q_anti_join_zero_f1(spark, sf_dir):
    return joins.anti_join_zero_f1(_with_missed(spark, sf_dir), CHART_KEY)


@register("bar_means", sql(
    f"SELECT prompting, project, model, avg(f1) AS mean_f1 FROM {_BARS} GROUP BY prompting, project, model"))
def q_bar_means(spark, sf_dir):
    return metrics.bar_means(joins.anti_join_zero_f1(_chart_base(spark, sf_dir), CHART_KEY), CHART_KEY)


def _mean_interval(source: str, keys: str, row: str) -> str:
    """Mean and 95 % bootstrap interval of ``f1`` in each cell of ``keys``."""
    h = scr(f"('0x' || substr(md5({row}), 1, 8))::BIGINT % 2147483647", "b")
    return f"""
  SELECT {keys}, any_value(mean) AS mean, quantile_cont(m, 0.025) AS low, quantile_cont(m, 0.975) AS high FROM (
    SELECT {keys}, b, avg(f1) AS mean, sum(t * f1) / nullif(sum(t), 0) AS m
    FROM (SELECT *, {draws(1.0, 'h')} AS t FROM (SELECT *, {h} AS h FROM {source}, range(1000) r(b)))
    GROUP BY {keys}, b) GROUP BY {keys}"""


@register("bar_intervals", sql(f"""
  SELECT prompting, model, project, round(mean, 9) AS mean, round(low, 9) AS low, round(high, 9) AS high FROM (
    SELECT prompting, model, project, mean, low, high
    FROM ({_mean_interval(_BARS, 'prompting, model, project', "prompting || '/' || project || '/' || model")})
    UNION ALL SELECT prompting, model, NULL, mean, low, high
    FROM ({_mean_interval(_BARS, 'prompting, model', "prompting || '/' || project || '/' || model")}))"""))
def q_bar_intervals(spark, sf_dir):
    """The charts' bars with their error bars, and those of each model
    over all projects (no project)."""
    rows = cut_lineage(joins.anti_join_zero_f1(_chart_base(spark, sf_dir), CHART_KEY))
    key = ["prompting", "project", "model"]
    bars = metrics.bar_intervals(rows, ["prompting", "model", "project"], "f1", key)
    overall = metrics.bar_intervals(rows, ["prompting", "model"], "f1", key).withColumn("project", F.lit(None).cast("string"))
    return bars.unionByName(overall).select("prompting", "model", "project", *[F.round(c, 9).alias(c) for c in ("mean", "low", "high")])


@register("project_order", sql(f"""
  SELECT prompting, project, max_f1,
    CAST(row_number() OVER (PARTITION BY prompting ORDER BY max_f1 DESC, project) AS INTEGER) AS position
  FROM (SELECT prompting, project, max(f1) AS max_f1 FROM {_BARS} GROUP BY prompting, project)"""))
def q_project_order(spark, sf_dir):
    kept = joins.anti_join_zero_f1(_chart_base(spark, sf_dir), CHART_KEY)
    best = kept.groupBy(*CHART_KEY).agg(F.max("f1").alias("max_f1"))
    # position within its chart by best F1 descending, project as tie-break,
    # numbered by partition offsets (no single-task global window)
    ordered = ranking.row_index(best.withColumn("_neg", -F.col("max_f1")), ["prompting", "_neg", "project"], "_i")
    first = F.broadcast(ordered.groupBy("prompting").agg(F.min("_i").alias("_first")))  # one row per chart
    return ordered.join(first, "prompting").select("prompting", "project", "max_f1",
                                                   (F.col("_i") - F.col("_first") + 1).cast("int").alias("position"))


@register("map_labels", sql("""
  SELECT prompting, project, model, CASE model WHEN 'artigenz' THEN 'Artigenz Coder 6.7b'
    WHEN 'codellama' THEN 'CodeLlama 7b instruct' WHEN 'qwen' THEN 'Qwen Coder 7b instruct' ELSE model END AS label
  FROM project_metrics WHERE comments_included"""))
def q_map_labels(spark, sf_dir):
    return _chart_base(spark, sf_dir).select("prompting", "project", "model",
                                             map_with_default("model", MODEL_DISPLAY).alias("label"))
