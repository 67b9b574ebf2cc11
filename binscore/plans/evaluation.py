"""ML evaluation: per-project learners on the feature matrix (entry 3).

skip rule (D9) -> split semi-joins (C1) -> correlation screening per arm
(D16/D17) -> train-fitted scaling (I1) -> learners, each for all projects at
once (I2 closed form; I3, I5, I6 an aggregation a step; I4, I7 an aggregation a
tree level) -> one predictions table -> metrics (I9).
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from binscore.functions.text import normalise_key
from binscore.operators import joins, learn, linear, metrics, perceptron, ranking, stats, trees
from binscore.session import cut_lineage
from binscore.sources import testbed

G = ["project"]
FEATURES = list(testbed.FEATURE_COLUMNS)
ABLATABLE = list(testbed.ABLATABLE_FEATURES)
ML_ALGORITHMS = ("LR", "DT", "MLP", "SVM", "RF")


@dataclass
class MLInputs:
    kept: DataFrame      # (project) passing the skip rule
    features: DataFrame  # feature matrix of kept projects, normalised project key
    train: DataFrame     # scaled train rows
    test: DataFrame      # scaled test rows
    corr: DataFrame      # (project, col_a, pos_a, col_b, pos_b, r)
    used: DataFrame      # (project, arm, feature) used by each arm


def ml_inputs(spark, sf_dir: str, ablation: str = "strict") -> MLInputs:
    s = testbed.samples(spark, sf_dir)
    train_split, test_split = testbed.split_of(s, "train"), testbed.split_of(s, "test")
    skip = metrics.ml_skip_rule(train_split, test_split)
    kept = skip.where(F.col("skip_reason").isNull()).select("project")
    feats = learn.drop_non_features(
        testbed.features(spark, sf_dir, s).withColumn("project", normalise_key("project_name")),
        [n for n in learn.NON_FEATURES if n not in ("github_path", "project_name")])
    # the feature matrix (one numeric row per file) feeds the split
    # semi-joins, the correlations and the scaling: derive it from the texts
    # once and read the written copy back
    kept = cut_lineage(kept)
    feats = cut_lineage(feats.join(joins.bounded_broadcast(kept), "project", "left_semi"))
    train = joins.semi_join_split(feats, train_split)
    test = joins.semi_join_split(feats, test_split)
    corr = stats.correlation_matrix(feats, G, ["label", *FEATURES])
    dropped = learn.dropped_features(corr, G, ABLATABLE)
    used = learn.arm_features(kept, dropped, G, FEATURES, ABLATABLE, ablation)
    mm = cut_lineage(learn.minmax_fit(train, G, FEATURES))
    return MLInputs(kept, feats, learn.minmax_apply(train, mm, G, FEATURES),
                    learn.minmax_apply(test, mm, G, FEATURES), corr, used)


def settled(inp: MLInputs) -> MLInputs:
    """``inp`` with the scaled rows and the arms' features written once and read
    back: every learner reads them several times."""
    return replace(inp, train=cut_lineage(inp.train), test=cut_lineage(inp.test), used=cut_lineage(inp.used))


PREDICTIONS = ("project", "algorithm", "arm", "github_path", "label", "score", "prediction")


def cnb_predictions(spark, sf_dir: str, digits: int | None = None, inp: MLInputs | None = None) -> DataFrame:
    """I2 for every kept project and both arms in one plan."""
    inp = inp or ml_inputs(spark, sf_dir)
    flags = learn.used_flags(inp.used, G, FEATURES)
    out = learn.cnb_train_score(inp.train, inp.test, flags, G, FEATURES, ["github_path", "label"])
    return out.select("project", "arm", "github_path", "label",
                      (F.col("score") if digits is None else F.round("score", digits)).alias("score"), "prediction")


def linear_predictions(inp: MLInputs, algorithm: str) -> DataFrame:
    """I3, I6 for every kept project and both arms, one aggregation a step.  A
    model of two classes without an optimum is an error, not a result."""
    flags = learn.used_flags(inp.used, G, FEATURES)
    models = linear.fit_linear(learn.class_weight_col(inp.train, G), flags, G, FEATURES, algorithm)
    classes = inp.train.groupBy(*G).agg(F.count_distinct("label").alias("_classes"))
    if not models.where("NOT converged").join(classes.where("_classes > 1"), G, "left_semi").isEmpty():
        raise RuntimeError(f"{algorithm}: models without an optimum after {linear.MAX_STEPS} steps")
    return (linear.score_linear(inp.test, models.drop("converged"), G, FEATURES, algorithm, ["github_path", "label"])
            .withColumn("algorithm", F.lit(algorithm)).select(*PREDICTIONS))


FORESTS = {"DT": trees.DECISION_TREE, "RF": trees.RANDOM_FOREST}


def forest_model(inp: MLInputs, forest: trees.Forest) -> DataFrame:
    """I4, I7 for every kept project and both arms."""
    return trees.fit_forest(inp.train, learn.used_flags(inp.used, G, FEATURES), G, FEATURES, forest, ["project", "github_path"])


def tree_predictions(inp: MLInputs, algorithm: str, forest: trees.Forest | None = None) -> DataFrame:
    """Scores of the trees, one aggregation a level for all projects."""
    models = forest_model(inp, forest or FORESTS[algorithm])
    return (trees.score_forest(inp.test, models, G, FEATURES, ["github_path", "label"])
            .withColumn("algorithm", F.lit(algorithm)).select(*PREDICTIONS))


def perceptron_predictions(inp: MLInputs) -> DataFrame:
    """I5 for every kept project and both arms."""
    models = perceptron.fit_perceptrons(inp.train, learn.used_flags(inp.used, G, FEATURES), G, FEATURES)
    return (perceptron.score_perceptrons(inp.test, models, G, FEATURES, ["github_path", "label"])
            .withColumn("algorithm", F.lit("MLP")).select(*PREDICTIONS))


def ml_predictions(spark, sf_dir: str, algorithms=ML_ALGORITHMS, inp: MLInputs | None = None) -> DataFrame:
    """I3-I8 for every kept project, both arms and the given algorithms."""
    inp = inp or settled(ml_inputs(spark, sf_dir))

    def one(algorithm: str) -> DataFrame:
        if algorithm in linear.LOSSES:
            return linear_predictions(inp, algorithm)
        return perceptron_predictions(inp) if algorithm == "MLP" else tree_predictions(inp, algorithm)

    # the scaling reads the scores twice
    preds = cut_lineage(reduce(DataFrame.unionByName, [one(a) for a in algorithms]))
    # decision values (SVM) are min-max scaled within their group
    scaled = ranking.score_minmax(preds, ["project", "algorithm", "arm"], "score", "scaled")
    return scaled.select("project", "algorithm", "arm", "github_path", "label",
                         F.when(F.col("algorithm") == "SVM", F.col("scaled")).otherwise(F.col("score"))
                          .alias("score"), "prediction")


def all_predictions(spark, sf_dir: str, inp: MLInputs | None = None) -> DataFrame:
    """The six learners' scores of every test file of the kept projects,
    both arms."""
    inp = inp or settled(ml_inputs(spark, sf_dir))
    cnb = cnb_predictions(spark, sf_dir, inp=inp).withColumn("algorithm", F.lit("CNB"))
    return cnb.select(*PREDICTIONS).unionByName(ml_predictions(spark, sf_dir, inp=inp).select(*PREDICTIONS))
