"""Groups fitted whole by one task against groups that take their steps
together."""

from unittest import mock

import numpy as np

from binscore.operators import linear, perceptron, trees
from binscore.plans import evaluation
from conftest import SF_SMALL
from test_learners import FEATURES, frames, found_nodes, table


def jobs(spark, work):
    """The result of ``work`` and the number of Spark jobs it ran."""
    group = f"jobs-{id(work)}"
    spark.sparkContext.setJobGroup(group, "")
    try:
        return work(), len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_trees_grown_whole_equal_trees_grown_by_level(spark):
    forest = trees.Forest(70, 0.4, 0.5)
    df, flags = frames(spark, table({"p": 60, "q": 23, "one": 9, "big": 600}), 3)
    (_, by_task), few = jobs(spark, lambda: found_nodes(df, flags, forest))
    fit = trees.fit_forest
    with mock.patch.object(trees, "fit_forest", lambda *a: fit(*a, whole=30)):
        (_, mixed), many = jobs(spark, lambda: found_nodes(df, flags, forest))
    assert by_task == mixed and len(by_task) == 8 * forest.trees
    assert few < many  # small groups need no job a level


def test_perceptrons_of_several_blocks_train_in_one_task(spark):
    df, flags = frames(spark, table({"p": 40, "q": 25}), 2)
    one, few = jobs(spark, lambda: perceptron.fit_perceptrons(df, flags, ["g"], FEATURES, epochs=4, block=7).collect())
    many, more = jobs(spark, lambda: perceptron.fit_perceptrons(df, flags, ["g"], FEATURES, epochs=4, block=7, whole=30).collect())
    a, b = ({(r.gk, r.arm): (r.epoch, r.w) for r in m} for m in (one, many))
    assert a.keys() == b.keys() and len(a) == 4
    assert all(a[k][0] == b[k][0] == 4 and np.allclose(a[k][1], b[k][1], atol=1e-12) for k in a)
    assert few + 8 <= more  # no job an epoch


def test_linear_models_of_several_blocks_are_solved_in_one_task(spark):
    from pyspark.sql import functions as F
    df, flags = frames(spark, table({"p": 40, "q": 25}), 2)
    df = df.withColumn("weight", F.lit(1.0))
    one, many = ({(r.g, r.arm): r.w for r in linear.fit_linear(df, flags, ["g"], FEATURES, "SVM", block=7, whole=w).collect()}
                 for w in (linear.WHOLE, 30))
    assert one.keys() == many.keys() and len(one) == 4
    assert all(np.allclose(one[k], many[k], atol=1e-9) for k in one)


def test_learners_read_their_inputs_once(spark):
    """The scaled rows and the arms' features are not derived again by each learner."""
    inp = evaluation.settled(evaluation.ml_inputs(spark, SF_SMALL))
    for df in (inp.train, inp.test, inp.used):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "ExistingRDD" in plan and "Join" not in plan and "parquet" not in plan
    assert inp.train.count() and inp.test.count() and inp.used.count()
