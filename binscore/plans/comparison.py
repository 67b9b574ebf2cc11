"""Classifier-family comparison: ML metrics from scores, F1 tables, paired
tests and the formatted matrix (I9, D13, H1-H5, C6-C8, D22-D23, B24-B27)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from binscore.functions.text import algorithm_short_name, format_cell, mask_significance, normalise_key
from binscore.operators import metrics, ranking, reshape, stats
from binscore.operators.joins import cross_compare, outer_join_f1, pairwise_complete
from binscore.plans import analysis
from binscore.session import cut_lineage
from binscore.sources import testbed

# ---- fixed values: naming of the two evaluation arms and the valid names ----
WITH_SUFFIX = " with anti-pattern metrics"
WITHOUT_SUFFIX = " without_anti-pattern_metrics"
VALID_ALGORITHMS = (
    "CNB with anti-pattern metrics",
    "LR with anti-pattern metrics",
    "DT with anti-pattern metrics",
    "MLP with anti-pattern metrics",
    "SVM with anti-pattern metrics",
    "RF with anti-pattern metrics",
)
LLM_NAMES = ("artigenz", "codellama", "qwen")
ML_NAMES = ("CNB", "DT", "LR", "MLP", "RF", "SVM")
# -----------------------------------------------------------------------------

GROUP = ("project", "algorithm", "arm")


def algorithm_metric(algorithm="algorithm", arm="arm"):
    return F.concat(F.col(algorithm),
                    F.when(F.col(arm) == 0, F.lit(WITH_SUFFIX)).otherwise(F.lit(WITHOUT_SUFFIX)))


def evaluate_predictions(preds: DataFrame, group=GROUP) -> DataFrame:
    """AUC (exact), accuracy, P/R/F1 and confusion per model, one pass
    for all (project, algorithm, arm) groups; D20 turns AUC 0.0 into NULL."""
    g = list(group)
    counts = preds.groupBy(*g).agg(F.count(F.lit(1)).alias("n"), *metrics.confusion_aggs())
    auc = ranking.roc_auc(preds, g)
    out = counts.join(auc, g, "left").select(
        *g, "auc", metrics.accuracy_col().alias("accuracy"), metrics.precision_col().alias("precision"),
        metrics.recall_col().alias("recall"), metrics.f1_col().alias("f1"), "tp", "fp", "tn", "fn")
    return metrics.mean_or_default(out)


def ml_metrics(spark, sf_dir: str, preds: DataFrame | None = None) -> DataFrame:
    """The ML results table of ``preds`` (default: the fixture's scores):
    project, algorithm_metric, metrics."""
    ev = evaluate_predictions(testbed.predictions(spark, sf_dir) if preds is None else preds)
    return ev.select("project", algorithm_metric().alias("algorithm_metric"), "auc", "accuracy",
                     "precision", "recall", "f1", "tp", "fp", "tn", "fn")


def llm_best_f1(spark, sf_dir: str) -> DataFrame:
    """(project, model, f1) of the best configuration."""
    pm = analysis.project_metrics(spark, sf_dir)
    return analysis.best_config(pm).select("project", "model", "f1")


def ml_with_f1(ml: DataFrame) -> DataFrame:
    """B20 + B24: valid 'with' arms, algorithm renamed to its short name,
    project normalised as on the LLM side."""
    return (ml.where(F.col("algorithm_metric").isin(*VALID_ALGORITHMS))
              .select(normalise_key("project").alias("project"), algorithm_short_name("algorithm_metric").alias("algorithm"), "f1"))


def wide_f1(llm: DataFrame, ml: DataFrame, llm_names=LLM_NAMES, ml_names=ML_NAMES) -> DataFrame:
    """H1 + H2 + C6 on any two result tables: (project, model, f1) and the ML
    results table."""
    return outer_join_f1(reshape.pivot_unique(llm, "project", "model", "f1", list(llm_names)),
                         reshape.pivot_unique(ml_with_f1(ml), "project", "algorithm", "f1", list(ml_names)))


def f1_wide(spark, sf_dir: str) -> DataFrame:
    """H1 + H2 + C6: project x (3 LLMs, 6 algorithms) F1 table."""
    return wide_f1(llm_best_f1(spark, sf_dir), ml_metrics(spark, sf_dir))


def f1_long(spark, sf_dir: str) -> DataFrame:
    """H5: the F1 table in long form with the family of each column."""
    long = reshape.unpivot_wide(f1_wide(spark, sf_dir), "project", [*LLM_NAMES, *ML_NAMES], "name", "f1")
    return long.withColumn("family", F.when(F.col("name").isin(*LLM_NAMES), F.lit("llm"))
                           .otherwise(F.lit("ml")))


def paired_scores(spark, sf_dir: str) -> DataFrame:
    """C7 + C8: complete (LLM, ML) score pairs per project.  The pair table
    (projects x LLMs x algorithms rows) feeds several aggregations, so it is
    checkpointed once instead of being re-derived from the runs and scores
    by each of them."""
    wide = f1_wide(spark, sf_dir)
    return cut_lineage(pairwise_complete(cross_compare(wide, LLM_NAMES, ML_NAMES)))


def masked_tests(pairs: DataFrame) -> DataFrame:
    """D22 + D23 + B26: per (LLM, ML) the test results and the masked CLES."""
    return stats.wilcoxon(pairs).withColumn("cles_shown", mask_significance("p_rounded", "cles_rounded"))


def comparison(spark, sf_dir: str) -> DataFrame:
    """``masked_tests`` of the fixture's pairs."""
    return masked_tests(paired_scores(spark, sf_dir))


def combined_matrix(spark, sf_dir: str) -> DataFrame:
    """H4: ML algorithm x LLM cells ``"p (cles)"``."""
    cmp_ = comparison(spark, sf_dir).withColumn("cell", format_cell("p_rounded", "cles_shown"))
    return reshape.pivot_unique(cmp_, "ml", "llm", "cell", list(LLM_NAMES))
