"""Confusion counts, P/R/F1, summaries, cleaning joins; published goldens."""

import csv
import os

import pytest
from pyspark.sql import functions as F

from binscore.operators import joins, metrics
from conftest import GOLDEN

RUNS = "project_name string, github_path string, model string, comments_included boolean, " \
       "prompting string, label int, prediction int, response string, errors string"


def test_config_summary_all_null_group_and_zero_division(spark):
    rows = [
        ("p", "a", "m1", True, "zeroShot", 1, None, None, None),
        ("p", "b", "m1", True, "zeroShot", 0, None, "x", None),
        ("p", "a", "m2", True, "zeroShot", 1, 0, "no", None),
        ("p", "b", "m2", True, "zeroShot", 0, 0, "no", None),
        ("p", "c", "m2", True, None, 0, 1, "yes", None),  # NULL key: not grouped
    ]
    df = spark.createDataFrame(rows, RUNS).withColumn("interpreted", F.lit(None).cast("int"))
    out = {r.model: r for r in metrics.config_summary(df).collect()}
    assert set(out) == {"m1", "m2"}
    assert out["m1"].precision is None and out["m1"].tp is None and out["m1"].total_inferences == 2
    assert out["m2"].precision == 0.0 and out["m2"].recall == 0.0 and out["m2"].f1 == 0.0
    assert (out["m2"].tn, out["m2"].fn) == (1, 1)
    pm = metrics.project_metrics(df).collect()
    assert [r.model for r in pm] == ["m2"]  # group without predictions omitted


def test_error_anti_join_removes_file_from_every_configuration(spark):
    rows = [
        ("p", "a", "m1", True, "zeroShot", 1, None, None, "Out of Memory"),
        ("p", "a", "m2", True, "zeroShot", 1, 1, "yes", None),
        ("p", "b", "m1", True, "zeroShot", 0, None, None, "  "),  # blank: not an error
        ("p", "b", "m2", True, "zeroShot", 0, 0, "no", None),
    ]
    df = spark.createDataFrame(rows, RUNS)
    kept = joins.anti_join_errors(df)
    assert sorted((r.github_path, r.model) for r in kept.collect()) == [("b", "m1"), ("b", "m2")]
    # idempotent
    assert joins.anti_join_errors(kept).count() == 2


def test_zero_positive_projects_null_label(spark):
    df = spark.createDataFrame([(" P1 ", 0), (" P1 ", 0), ("p2", 0), ("p2", 1), ("p3", None)],
                               "project_name string, label int")
    got = sorted(r.project for r in metrics.zero_positive_projects(df).collect())
    assert got == ["p1"]


def test_confusion_sums_to_predicted_rows(spark):
    df = spark.createDataFrame([(i % 2, (i // 2) % 2 if i % 5 else None) for i in range(40)],
                               "label int, prediction int")
    r = df.agg(*metrics.confusion_aggs(), F.count("prediction").alias("n")).first()
    assert r.tp + r.fp + r.tn + r.fn == r.n


def _golden_summary():
    with open(os.path.join(GOLDEN, "summary_llms.csv")) as fh:
        return list(csv.DictReader(fh))


def test_published_scores_follow_from_published_counts(spark):
    """Golden 1: P/R/F1 recomputed from the confusion counts of the 12
    published configurations equal the published values."""
    rows = _golden_summary()
    df = spark.createDataFrame([(r["Model"], r["CommentsIncluded"], r["Prompting"], int(r["TP"]), int(r["FP"]),
                                 int(r["TN"]), int(r["FN"])) for r in rows],
                               "model string, c string, p string, tp bigint, fp bigint, tn bigint, fn bigint")
    got = {(r.model, r.c, r.p): r for r in df.select(
        "model", "c", "p", metrics.precision_col().alias("pr"), metrics.recall_col().alias("re"),
        metrics.f1_col().alias("f1")).collect()}
    for r in rows:
        g = got[(r["Model"], r["CommentsIncluded"], r["Prompting"])]
        assert g.pr == pytest.approx(float(r["Precision"]), abs=1e-15)
        assert g.re == pytest.approx(float(r["Recall"]), abs=1e-15)
        assert g.f1 == pytest.approx(float(r["F1"]), abs=1e-15)


def test_mean_scores_by_model_and_comments(spark):
    rows = _golden_summary()
    df = spark.createDataFrame([(r["Model"], r["CommentsIncluded"], r["Prompting"], float(r["Precision"]),
                                 float(r["Recall"]), float(r["F1"])) for r in rows],
                               "model string, comments_included string, prompting string, precision double, "
                               "recall double, f1 double")
    zero = metrics.mean_scores(df.where("prompting = 'zeroShot'"))
    best = {(r.model, r.comments_included): r.f1 for r in zero.collect()}
    # published zero-shot mean F1 (one configuration per cell)
    assert best[("qwen", "True")] == pytest.approx(0.024390243902439025, rel=1e-12)
    assert best[("artigenz", "True")] == pytest.approx(0.017756, abs=1e-6)
