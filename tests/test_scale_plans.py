"""Plans that carry little, sizes that are checked, and grouped linear learners."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from binscore import session
from binscore.operators import joins, learn, linear, ranking, stats
from binscore.plans import comparison, inference
from binscore.sources import files, testbed
from conftest import SF_SMOKE


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def join_inputs(node):
    """Column names of every input of every join below ``node``."""
    kids = [node.children().apply(i) for i in range(node.children().size())]
    found = [name for k in kids for name in join_inputs(k)]
    if node.nodeName() == "Join":
        found += [k.output().apply(i).name() for k in kids for i in range(k.output().size())]
    return found


def test_feature_shuffle_carries_no_text(spark):
    names = join_inputs(testbed.features(spark, SF_SMOKE)._jdf.queryExecution().optimizedPlan())
    assert "f_commas" in names and "text" not in names


def test_exemplars_are_looked_up_in_one_filtered_pass(spark):
    df = inference.exemplar_texts(spark, SF_SMOKE)
    names = join_inputs(df._jdf.queryExecution().optimizedPlan())
    # texts enter the filter by key, and what is left of them one lookup
    assert "LeftSemi" in plan_of(df) and names.count("text") == 2


def test_broadcast_bound_counts_bytes(spark):
    df = spark.range(10).select("id", F.repeat(F.lit("x"), 1000).alias("t"))
    assert "ResolvedHint" in joins.bounded_broadcast(df)._jdf.queryExecution().analyzed().toString()
    assert "ResolvedHint" not in joins.bounded_broadcast(df, max_bytes=5_000)._jdf.queryExecution().analyzed().toString()
    assert "ResolvedHint" not in joins.bounded_broadcast(df, max_rows=9)._jdf.queryExecution().analyzed().toString()


def test_prefix_sums_have_no_bound_search(spark):
    """Ranks and curves: rows are cut by a sort; no row carries an array of
    bounds, and only groups that cross an edge get an offset."""
    rows = [("big", float(i % 997), i % 3 == 0) for i in range(4_000)] + [(f"g{i % 40}", float(i % 7), i % 2 == 0) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, score double, y boolean").select("g", "score", F.col("y").cast("int").alias("label"))
    curve = ranking.running_counts(df, ["g"], n_buckets=16)
    assert "filter(" not in plan_of(curve).lower().replace("filter (", "")
    hist = ranking.in_ranges(ranking.score_histogram(df, ["g"]), ["g"], "score", 16)
    assert hist.where("g = 'big'").select(ranking.RANGE).distinct().count() > 5
    big = {r.threshold: (r.tps, r.fps) for r in curve.where("g = 'big'").collect()}
    assert all(v == (sum(y for g, s, y in rows if g == "big" and s >= t), sum(not y for g, s, y in rows if g == "big" and s >= t))
               for t, v in list(big.items())[::50])


def test_curve_points_without_straight_stretches(spark):
    """Steps that repeat are dropped, across range edges as well."""
    rows = [("a", float(i), int(i >= 60)) for i in range(100)] + [("b", float(i % 5), i % 2) for i in range(30)] + [("c", 1.0, 1)]
    df = spark.createDataFrame(rows, "g string, score double, label int")
    one, many = (sorted(map(repr, ranking.roc_points(df, ["g"], n_buckets=n).collect())) for n in (1, 13))
    assert one == many
    a = [(r.threshold, r.fpr, r.tpr) for r in ranking.roc_points(df, ["g"], n_buckets=13).where("g = 'a'").orderBy(F.desc("threshold")).collect()]
    assert a == [(99.0, 0.0, 1 / 40), (60.0, 0.0, 1.0), (0.0, 1.0, 1.0), (None, 0.0, 0.0)]
    c = sorted(map(tuple, ranking.roc_points(df, ["g"]).where("g = 'c'").select("threshold", "fpr", "tpr").collect()), key=repr)
    assert c == sorted([(1.0, None, 1.0), (None, None, 0.0)], key=repr)


def test_many_columns_correlate_in_one_aggregation(spark):
    """500 columns: the plan has one aggregation of six sums for all pairs."""
    import numpy as np
    rng = np.random.default_rng(1)
    x = rng.random((60, 500))
    x[:, 1] = 3.0
    df = spark.createDataFrame([("g", *map(float, r)) for r in x], ["g", *[f"c{i}" for i in range(500)]])
    out = stats.correlation_matrix(df, ["g"], [f"c{i}" for i in range(500)])
    assert "sum(si#" in plan_of(out) and plan_of(out).count("c499") < 20
    got = {(r.pos_a, r.pos_b): r.r for r in out.collect()}
    assert len(got) == 500 * 499 // 2 and got[0, 1] is None and got[1, 7] is None
    want = np.corrcoef(x.T)
    assert all(abs(got[i, j] - want[i, j]) < 1e-9 for i, j in ((0, 2), (3, 499), (250, 251)))


def test_both_summaries_come_from_one_exchange(spark):
    from binscore.operators import metrics
    rows = [("m", True, "zeroShot", "p", 1, 1, "yes", None), ("m", True, "zeroShot", None, 0, 1, "yes", None),
            ("m", True, "zeroShot", "q", 0, None, None, None), ("m", None, "zeroShot", "q", 1, 1, "yes", None),
            ("m", True, "fewShot", "p", 1, 0, "no", None)]
    df = spark.createDataFrame(rows, "model string, comments_included boolean, prompting string, project_name string, label int, "
                                     "prediction int, response string, interpreted int")
    summary, projects = metrics.summary_and_projects(df)
    assert sorted(map(repr, summary.collect())) == sorted(map(repr, metrics.config_summary(df).collect()))
    assert sorted(map(repr, projects.collect())) == sorted(map(repr, metrics.project_metrics(df).collect()))


def test_bar_intervals_hold_the_mean_and_agree(spark):
    from binscore.operators import metrics
    rows = [("a", f"r{i}", i / 10) for i in range(20)] + [("b", "only", 0.25), ("c", "null", None)]
    df = spark.createDataFrame(rows, "k string, r string, v double")
    got = {r.k: r for r in metrics.bar_intervals(df, ["k"], "v", ["k", "r"]).collect()}
    again = {r.k: r for r in metrics.bar_intervals(df.repartition(5), ["k"], "v", ["k", "r"]).collect()}
    assert set(got) == {"a", "b"} and all(abs(got[k][i] - again[k][i]) < 1e-12 for k in got for i in (1, 2, 3))
    assert (got["b"]["mean"], got["b"].low, got["b"].high) == (0.25, 0.25, 0.25)
    # a normal interval of the mean is 0.95 -+ 0.25
    assert got["a"].low < got["a"]["mean"] < got["a"].high and 0.35 < got["a"].high - got["a"].low < 0.65


def test_no_machine_local_folder_on_a_cluster(spark):
    class Conf:
        def get(self, key, default):
            return default

    class Context:
        master = "spark://somewhere"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return Conf()

    class Session:
        sparkContext = Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.checkpoint_dir(Session())


def test_line_ends_are_normalised(spark):
    df = spark.createDataFrame([(bytearray(b"a\r\nb\rc\n"),), (bytearray(b"\xe9\r\n"),)], "content binary")
    assert [r[0] for r in df.select(files.decode_text(F.col("content"))).collect()] == ["a\nb\nc\n", "\xe9\n"]


def test_project_names_meet_in_one_spelling(spark):
    ml = spark.createDataFrame([(" MixedCase ", comparison.VALID_ALGORITHMS[0], 0.5)],
                               "project string, algorithm_metric string, f1 double")
    assert comparison.ml_with_f1(ml).first().project == "mixedcase"


# ---- linear learners ------------------------------------------------------------

def objective(algorithm, w, x, y, weight):
    loss, penalised = linear.LOSSES[algorithm]
    value = (weight * loss(x @ w, y)[0]).sum()
    return value + 0.5 * (w @ w if penalised else w[:-1] @ w[:-1])


@pytest.mark.parametrize("algorithm", ["LR", "SVM"])
def test_linear_learners_reach_the_optimum(spark, algorithm):
    """A hot group, a small one, and an arm that leaves a feature out."""
    rng = np.random.default_rng(5)
    rows = []
    for group, n in (("hot", 900), ("small", 40)):
        x = rng.normal(size=(n, 3))
        y = (x @ [2.0, -1.0, 0.5] + rng.normal(size=n) > 0.3).astype(int)
        rows += [(group, *map(float, v), int(label)) for v, label in zip(x, y)]
    train = spark.createDataFrame(rows, "g string, a double, b double, c double, label int").repartition(5)
    weighted = learn.class_weight_col(train, ["g"])
    flags = spark.createDataFrame([(g, arm, 1, 1, 1 - arm) for g in ("hot", "small", "unseen") for arm in (0, 1)],
                                  "g string, arm int, u_a int, u_b int, u_c int")
    models = linear.fit_linear(weighted, flags, ["g"], ["a", "b", "c"], algorithm)
    found = {(r.g, r.arm): np.array(r.w) for r in models.collect()}
    assert set(found) == {(g, arm) for g in ("hot", "small") for arm in (0, 1)}
    # a group of many blocks takes the same steps through Spark
    many = linear.fit_linear(weighted, flags, ["g"], ["a", "b", "c"], algorithm, block=100).collect()
    assert len(many) == 4 and all(r.converged and np.allclose(r.w, found[r.g, r.arm], atol=1e-7) for r in many)
    local = weighted.toPandas()
    for (g, arm), w in found.items():
        part = local[local.g == g]
        x = np.c_[part[["a", "b", "c"]].to_numpy() * [1, 1, 1 - arm], np.ones(len(part))]
        y, weight = part.label.to_numpy(), part.weight.to_numpy()
        assert arm == 0 or w[2] == 0
        best = objective(algorithm, w, x, y, weight)
        for i in range(4):  # no small move lowers a convex objective
            for d in (1e-3, -1e-3):
                moved = w.copy()
                moved[i] += d
                assert arm == 1 and i == 2 or objective(algorithm, moved, x, y, weight) > best
    scored = linear.score_linear(train, models, ["g"], ["a", "b", "c"], algorithm, ["label"]).toPandas()
    assert len(scored) == 2 * 940
    assert ((scored.prediction == scored.label)[scored.arm == 0]).mean() > 0.8


def test_one_class_and_empty_training_sets(spark):
    schema = "g string, a double, label int, weight double"
    flags = spark.createDataFrame([("x", 0, 1)], "g string, arm int, u_a int")
    for algorithm in ("LR", "SVM"):
        one = linear.fit_linear(spark.createDataFrame([("x", 1.0, 1, 0.5), ("x", None, 1, 0.5)], schema), flags, ["g"], ["a"],
                                algorithm, max_steps=5)
        assert np.isfinite(one.first().w).all() and one.first().w[-1] > 0
        assert one.first().converged == (algorithm == "SVM")  # one class: the logistic loss has no least value
        assert linear.fit_linear(spark.createDataFrame([], schema), flags, ["g"], ["a"], algorithm).count() == 0
