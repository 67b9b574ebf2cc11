"""Response analysis: merged runs -> cleaned runs -> metric tables.

One lazy DataFrame DAG replaces the reference's CSV hand-offs between
processes.  Small sides of anti-joins are materialised while the plan is built
(``bounded_broadcast``).  D1 and D2 alone are one plan each;
``summary_and_projects`` makes both from one scan and one exchange.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from binscore.functions.text import fill_prediction, interpreted, normalise_key
from binscore.operators import joins, metrics
from binscore.sources import testbed


def clean_runs(runs: DataFrame) -> DataFrame:
    """C2 + B13: drop failed files from every configuration, then add the
    heuristic label for answers that did not parse."""
    kept = joins.anti_join_errors(runs)
    return kept.withColumn("interpreted", interpreted())


def prepare_for_metrics(clean: DataFrame, test_split: DataFrame) -> DataFrame:
    """B15 + B6 + C3: fill predictions with heuristic labels, normalise the
    project key and drop projects without a positive test label."""
    filled = clean.withColumns({
        "prediction": fill_prediction(),
        "project_name": normalise_key("project_name"),
    })
    skipped = metrics.zero_positive_projects(test_split)
    return joins.anti_join_projects(filled, skipped)


def evaluated_runs(spark, sf_dir: str, runs: DataFrame | None = None) -> DataFrame:
    """``runs``: the run table (default: the fixture's)."""
    s = testbed.samples(spark, sf_dir)
    runs = testbed.runs(spark, sf_dir, s) if runs is None else runs
    return prepare_for_metrics(clean_runs(runs), testbed.split_of(s, "test"))


def config_summary(spark, sf_dir: str) -> DataFrame:
    """Flagship: which configuration detects positives best."""
    return metrics.config_summary(evaluated_runs(spark, sf_dir))


def project_metrics(spark, sf_dir: str) -> DataFrame:
    """D2 per (configuration, project)."""
    return metrics.project_metrics(evaluated_runs(spark, sf_dir))


def summary_and_projects(spark, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """D1 and D2 in one pass."""
    return metrics.summary_and_projects(evaluated_runs(spark, sf_dir))


def best_config(df: DataFrame, comments: bool = True, prompting: str = "fewShot") -> DataFrame:
    """Rows of the selected configuration."""
    return df.where((F.col("comments_included") == F.lit(comments))
                    & (F.col("prompting") == F.lit(prompting)))
