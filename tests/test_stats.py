"""Ranks, ROC/AUC, correlation, paired statistics; the published matrix."""

import csv
import math
import os
import random

import pytest
from pyspark.sql import functions as F

from binscore.functions.text import format_cell, mask_significance
from binscore.operators import joins, ranking, reshape, stats
from conftest import GOLDEN

LLM = ["artigenz", "codellama", "qwen"]
ML = ["CNB", "DT", "LR", "MLP", "RF", "SVM"]


def brute_auc(rows):
    pos = [s for s, y in rows if y == 1]
    neg = [s for s, y in rows if y == 0]
    if not pos or not neg:
        return None
    u = sum(1.0 if p > n else 0.5 if p == n else 0.0 for p in pos for n in neg)
    return u / (len(pos) * len(neg))


@pytest.fixture(scope="module")
def scored(spark):
    rnd = random.Random(7)
    rows = []
    for g in range(3):
        for i in range(60 + 40 * g):
            y = 1 if rnd.random() < 0.3 else 0
            rows.append((f"g{g}", y, float(rnd.randint(0, 9 + g * 5)) + 0.5 * y * rnd.randint(0, 1)))
    rows.append(("g3", 1, 1.0))  # a group with one class only
    return rows, spark.createDataFrame(rows, "g string, label int, score double")


def test_auc_matches_brute_force(scored):
    rows, df = scored
    got = {r.g: r.auc for r in ranking.roc_auc(df, ["g"], n_buckets=4).collect()}
    for g in ("g0", "g1", "g2", "g3"):
        exp = brute_auc([(s, y) for gg, y, s in rows if gg == g])
        if exp is None:
            assert got[g] is None
        else:
            assert got[g] == pytest.approx(exp, abs=1e-12)


def test_auc_properties(scored):
    _, df = scored
    base = {r.g: r.auc for r in ranking.roc_auc(df, ["g"]).collect()}
    mono = {r.g: r.auc for r in ranking.roc_auc(df.withColumn("score", F.exp(F.col("score") / 3)), ["g"]).collect()}
    neg = {r.g: r.auc for r in ranking.roc_auc(df.withColumn("score", -F.col("score")), ["g"]).collect()}
    for g in ("g0", "g1", "g2"):
        assert mono[g] == pytest.approx(base[g], abs=1e-12)
        assert base[g] + neg[g] == pytest.approx(1.0, abs=1e-12)


def test_average_rank_with_ties(spark):
    df = spark.createDataFrame([("a", v) for v in (3.0, 1.0, 3.0, 2.0, 3.0, None)] + [("b", 5.0)],
                               "g string, v double")
    got = sorted((r.g, r.v, r.avg_rank) for r in ranking.average_rank(df, ["g"], "v", n_buckets=2).collect()
                 if r.v is not None)
    assert got == [("a", 1.0, 1.0), ("a", 2.0, 2.0), ("a", 3.0, 4.0), ("a", 3.0, 4.0), ("a", 3.0, 4.0),
                   ("b", 5.0, 1.0)]


def test_running_counts_and_partitioning_invariance(scored, spark):
    rows, df = scored
    a = sorted(tuple(r) for r in ranking.running_counts(df, ["g"], n_buckets=3).collect())
    b = sorted(tuple(r) for r in ranking.running_counts(df.repartition(7), ["g"], n_buckets=16).collect())
    assert a == b
    g0 = [(s, y) for g, y, s in rows if g == "g0"]
    for r in a:
        if r[0] == "g0":
            assert r[2] == sum(1 for s, y in g0 if y == 1 and s >= r[1])
            assert r[3] == sum(1 for s, y in g0 if y == 0 and s >= r[1])


def test_row_index_is_contiguous(spark):
    df = spark.range(0, 1000).selectExpr("(id * 7919) % 1000 AS k").repartition(5)
    got = ranking.row_index(df, ["k"]).collect()
    assert sorted((r.k, r.row_index) for r in got) == [(i, i) for i in range(1000)]


def test_score_minmax_all_equal_is_null(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("b", 0.0), ("b", 2.0)], "g string, score double")
    got = sorted((r.g, r.scaled) for r in ranking.score_minmax(df, ["g"]).collect())
    assert got == [("a", None), ("a", None), ("b", 0.0), ("b", 1.0)]


def test_correlation_constant_column_and_pairwise_complete(spark):
    df = spark.createDataFrame([("p", 1.0, 2.0, 5.0, None), ("p", 2.0, 4.0, 5.0, 1.0),
                                ("p", 3.0, 6.5, 5.0, 3.0)], "g string, a double, b double, c double, d double")
    got = {(r.col_a, r.col_b): r.r for r in stats.correlation_matrix(df, ["g"], ["a", "b", "c", "d"]).collect()}
    assert got[("a", "c")] is None
    assert got[("a", "d")] == pytest.approx(1.0)
    assert got[("a", "b")] > 0.99
    dropped = {r.feature for r in stats.correlated_features(
        stats.correlation_matrix(df, ["g"], ["a", "b", "c", "d"]), ["g"]).collect()}
    assert dropped == {"a", "b"}


def test_signed_rank_edge_cases(spark):
    df = spark.createDataFrame([("x", "m", 0.1, 0.2), ("y", "m", 0.3, 0.3), ("y", "m", 0.2, 0.2),
                                ("z", "m", 0.5, 0.1), ("z", "m", 0.6, 0.2), ("z", "m", 0.7, 0.3),
                                ("z", "m", 0.8, 0.4), ("z", "m", 0.9, 0.5)],
                               "llm string, ml string, llm_f1 double, ml_f1 double")
    got = {r.llm: r for r in stats.wilcoxon(df).collect()}
    assert got["x"].p_value is None and got["x"].cles is None          # fewer than 2 pairs
    assert got["y"].p_value is None and got["y"].cles == 0.5           # all differences zero
    assert got["z"].p_value == pytest.approx(2 / 32)                   # exact: all 5 positive
    assert got["z"].cles == 1.0


def test_swapping_pairs_keeps_p_and_mirrors_cles(spark):
    rnd = random.Random(3)
    rows = [("a", "m", round(rnd.random(), 2), round(rnd.random(), 2)) for _ in range(25)]
    df = spark.createDataFrame(rows, "llm string, ml string, llm_f1 double, ml_f1 double")
    sw = df.select("llm", "ml", F.col("ml_f1").alias("llm_f1"), F.col("llm_f1").alias("ml_f1"))
    a, b = stats.wilcoxon(df).first(), stats.wilcoxon(sw).first()
    assert a.p_value == pytest.approx(b.p_value)
    assert a.cles == pytest.approx(1 - b.cles)


def test_exact_distribution_small_n():
    counts = stats._exact_counts(4)
    assert sum(counts) == 16 and counts[:4] == [1, 1, 1, 2]
    # n = 6, R+ = 2: P(R+ <= 2) = 3/64
    assert stats.signed_rank_pvalue(6, 6, 2.0, 19.0, 0) == pytest.approx(2 * 3 / 64)


def test_published_comparison_matrix(spark):
    """Golden 4: the published per-project F1 table -> pairs -> signed-rank
    test + CLES -> masked, formatted cells equal the published matrix."""
    with open(os.path.join(GOLDEN, "combined_f1_scores_pivoted.csv")) as fh:
        recs = list(csv.DictReader(fh))

    def num(x):
        return None if x in ("", None) else float(x)

    wide = spark.createDataFrame([tuple([r["Project"]] + [num(r[c]) for c in LLM + ML]) for r in recs],
                                 "project string, " + ", ".join(f"{c} double" for c in LLM + ML))
    pairs = joins.pairwise_complete(joins.cross_compare(wide, LLM, ML))
    res = stats.wilcoxon(pairs).withColumn("cell", format_cell("p_rounded", mask_significance("p_rounded",
                                                                                           "cles_rounded")))
    got = {(r.ml, r.llm): r.cell for r in res.collect()}
    with open(os.path.join(GOLDEN, "rq3_combined_matrix.csv")) as fh:
        exp = list(csv.DictReader(fh))
    n = 0
    for row in exp:
        for llm in LLM:
            assert got[(row["ML Algo"], llm)] == row[llm], (row["ML Algo"], llm)
            n += 1
    assert n == 18


def test_pivot_rejects_duplicate_cells(spark):
    df = spark.createDataFrame([("p", "qwen", 0.1), ("p", "qwen", 0.2)], "project string, model string, f1 double")
    with pytest.raises(Exception, match="duplicate pivot cell"):
        reshape.pivot_unique(df, "project", "model", "f1", ["qwen"]).collect()


def test_outer_join_keeps_one_sided_projects(spark):
    a = spark.createDataFrame([("p1", 0.1), ("p2", 0.2)], "project string, qwen double")
    b = spark.createDataFrame([("p2", 0.3), ("p3", 0.4)], "project string, CNB double")
    got = sorted(tuple(r) for r in joins.outer_join_f1(a, b).collect())
    assert got == [("p1", 0.1, None), ("p2", 0.2, 0.3), ("p3", None, 0.4)]


def test_erfc_two_sided_normal():
    # normal branch (zeros present): p = erfc(|z| / sqrt 2)
    p = stats.signed_rank_pvalue(10, 8, 5.0, 31.0, 0)
    z = (5.0 - 8 * 9 / 4) / math.sqrt(8 * 9 * 17 / 24)
    assert p == pytest.approx(math.erfc(abs(z) / math.sqrt(2)))
