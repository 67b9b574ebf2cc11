"""Registered queries: feature matrix preparation and the learners."""

from __future__ import annotations

from pyspark.sql import functions as F

from binscore.functions.text import normalise_key
from binscore.operators import joins, learn, metrics, stats, trees
from binscore.plans import comparison, evaluation
from binscore.plans.catalog import register
from binscore.plans.oracle import CONFUSION, FEATS, cnt, norm, ratio, sql
from binscore.plans.oracle_learners import DT_NODES
from binscore.session import cut_lineage
from binscore.sources import testbed

_F = ", ".join(FEATS)


@register("ml_skip_rule", sql("SELECT * FROM skip_rule"))
def q_ml_skip_rule(spark, sf_dir):
    s = testbed.samples(spark, sf_dir)
    return metrics.ml_skip_rule(testbed.split_of(s, "train"), testbed.split_of(s, "test"))


@register("distinct_projects", sql(f"SELECT DISTINCT {norm('project_name')} AS project FROM samples WHERE split = 'test'"))
def q_distinct_projects(spark, sf_dir):
    return metrics.distinct_projects(testbed.split_of(testbed.samples(spark, sf_dir), "test"))


@register("sort_projects", sql(
    f"SELECT DISTINCT {norm('project_name')} AS project FROM samples WHERE split = 'test' ORDER BY project"))
def q_sort_projects(spark, sf_dir):
    return q_distinct_projects(spark, sf_dir).orderBy("project")


@register("semi_join_split", sql(f"""
  SELECT project, github_path, label, split, {_F} FROM features
  WHERE project IN (SELECT project FROM skip_rule WHERE skip_reason IS NULL)"""))
def q_semi_join_split(spark, sf_dir):
    s = testbed.samples(spark, sf_dir)
    f = testbed.features(spark, sf_dir, s).withColumn("project", normalise_key("project_name"))
    skip = metrics.ml_skip_rule(testbed.split_of(s, "train"), testbed.split_of(s, "test"))
    kept = joins.bounded_broadcast(skip.where("skip_reason is null").select("project"), materialize=True)
    f = f.join(kept, "project", "left_semi")
    train, test = (joins.semi_join_split(f, testbed.split_of(s, split)).select(
        "project", "github_path", "label", F.lit(split).alias("split"), *FEATS) for split in ("train", "test"))
    return train.unionByName(test)


@register("drop_non_features", sql(f"SELECT project_name, github_path, label, {_F} FROM features"))
def q_drop_non_features(spark, sf_dir):
    f = testbed.features(spark, sf_dir)
    return learn.drop_non_features(f, [n for n in learn.NON_FEATURES if n not in ("project_name", "github_path")])


@register("ablate_features", sql(
    "SELECT project_name, github_path, label, f_chars, f_words, f_lines, f_upper_the, f_const, f_dup FROM features"))
def q_ablate_features(spark, sf_dir):
    f = q_drop_non_features(spark, sf_dir)
    return learn.ablate_features(f, testbed.ABLATABLE_FEATURES)


@register("feature_label_split", sql("SELECT project_name, github_path, label, " + ", ".join(
    f"{c} AS x{i}" for i, c in enumerate(FEATS)) + " FROM features"))
def q_feature_label_split(spark, sf_dir):
    """(features vector, label) rows for Spark ML, the vector's places
    as columns."""
    from pyspark.ml.functions import vector_to_array
    rows = learn.assemble(q_drop_non_features(spark, sf_dir), FEATS)
    x = rows.select("project_name", "github_path", "label", vector_to_array("features").alias("x"))
    return x.select("project_name", "github_path", "label", *[F.col("x")[i].alias(f"x{i}") for i in range(len(FEATS))])


@register("correlation_matrix", sql("SELECT * FROM corr"))
def q_correlation_matrix(spark, sf_dir):
    return evaluation.ml_inputs(spark, sf_dir).corr.withColumn("r", F.round("r", 9))


@register("correlated_features", sql(
    "SELECT DISTINCT project, col_a AS feature FROM corr WHERE abs(r) > 0.7 AND col_a <> 'label'"))
def q_correlated_features(spark, sf_dir):
    return stats.correlated_features(evaluation.ml_inputs(spark, sf_dir).corr, ["project"])


@register("arm_features", sql("SELECT project, arm, feature FROM used_features"))
def q_arm_features(spark, sf_dir):
    return evaluation.ml_inputs(spark, sf_dir).used


@register("arm_features_reference", sql(f"""
  SELECT k.project, a.arm, f.feature FROM (SELECT project FROM skip_rule WHERE skip_reason IS NULL) k,
    (VALUES (0), (1)) a(arm), (VALUES {', '.join(f"('{x}')" for x in FEATS)}) f(feature)
  WHERE (k.project, a.arm, f.feature) NOT IN (SELECT project, arm, feature FROM dropped)"""))
def q_arm_features_reference(spark, sf_dir):
    """B18 as the original did it: the arm without the ablatable features leaves
    them out of the correlation screening only."""
    return evaluation.ml_inputs(spark, sf_dir, "reference").used


@register("minmax_scale", sql("""
  SELECT project, github_path, split, feature, round(x, 12) AS x FROM scaled_long"""))
def q_minmax_scale(spark, sf_dir):
    inp = evaluation.ml_inputs(spark, sf_dir)
    ids = ["project", "github_path"]
    tr = learn.to_long(inp.train.select(*ids, *FEATS), ids, FEATS).withColumn("split", F.lit("train"))
    te = learn.to_long(inp.test.select(*ids, *FEATS), ids, FEATS).withColumn("split", F.lit("test"))
    return tr.unionByName(te).select("project", "github_path", "split", "feature",
                                     F.round("x", 12).alias("x"))


@register("class_weights", sql(f"""
  SELECT project, label, n_c, n, CAST(n AS DOUBLE) / (2.0 * n_c) AS weight FROM (
    SELECT project, label, count(*) AS n_c, sum(count(*)) OVER (PARTITION BY project) AS n
    FROM ml_features WHERE split = 'train' GROUP BY project, label)"""))
def q_class_weights(spark, sf_dir):
    inp = evaluation.ml_inputs(spark, sf_dir)
    return metrics.class_weights(inp.train, "project")


@register("cnb_train_score", sql("SELECT * FROM cnb"))
def q_cnb_train_score(spark, sf_dir):
    return evaluation.cnb_predictions(spark, sf_dir, digits=9)


@register("cnb_metrics", sql(f"""
  SELECT project, arm, {cnt('prediction = 1 AND label = 1')} AS tp, {cnt('prediction = 1 AND label = 0')} AS fp,
    {cnt('prediction = 0 AND label = 0')} AS tn, {cnt('prediction = 0 AND label = 1')} AS fn
  FROM cnb GROUP BY ALL"""))
def q_cnb_metrics(spark, sf_dir):
    p = evaluation.cnb_predictions(spark, sf_dir)
    return p.groupBy("project", "arm").agg(*metrics.confusion_aggs())


def _learner(algorithm, digits):
    """A learner's scores of every test file of the kept projects, both arms."""
    def q(spark, sf_dir):
        preds = evaluation.ml_predictions(spark, sf_dir, [algorithm])
        return preds.select("project", "arm", "github_path", "label", F.round("score", digits).alias("score"), "prediction")
    return q


for _key, _algorithm, _digits in (("lr_train_score", "LR", 6), ("dt_train_score", "DT", 9), ("mlp_train_score", "MLP", 6),
                                  ("svm_train_score", "SVM", 6), ("rf_train_score", "RF", 9)):
    register(_key, sql(f"SELECT * FROM {_algorithm.lower()}_scores"))(_learner(_algorithm, _digits))


@register("dt_nodes", sql(DT_NODES))
def q_dt_nodes(spark, sf_dir):
    """I4: the decision trees as a relation, one row per node."""
    inp = evaluation.ml_inputs(spark, sf_dir)
    nodes = trees.forest_nodes(evaluation.forest_model(inp, trees.DECISION_TREE), ["project"], FEATS, inp.train)
    return nodes.select("project", "arm", "depth", "feature", F.round("threshold", 12).alias("threshold"), "n0", "n1")


@register("positive_score", sql("SELECT project, algorithm, arm, github_path, label, score, prediction FROM all_scores"))
def q_positive_score(spark, sf_dir):
    """I8: the probability of class 1, or the scaled decision value, of all six
    learners, arms and test files."""
    preds = evaluation.all_predictions(spark, sf_dir)
    return preds.withColumn("score", F.round("score", 6))


@register("evaluation_grid", sql(f"""
  SELECT c.project, c.algorithm || CASE WHEN c.arm = 0 THEN ' with anti-pattern metrics'
                                        ELSE ' without_anti-pattern_metrics' END AS algorithm_metric,
    CASE WHEN a.auc = 0 THEN NULL ELSE a.auc END AS auc, {ratio('c.tp + c.tn', 'c.n')} AS accuracy,
    {ratio('c.tp', 'c.tp + c.fp')} AS precision, {ratio('c.tp', 'c.tp + c.fn')} AS recall,
    {ratio('2 * c.tp', '2 * c.tp + c.fp + c.fn')} AS f1, c.tp, c.fp, c.tn, c.fn
  FROM (SELECT project, algorithm, arm, count(*) AS n, {CONFUSION} FROM all_scores GROUP BY ALL) c
  LEFT JOIN (
    SELECT project, algorithm, arm, (sum(CASE WHEN label = 1 THEN r ELSE 0 END) - p * (p + 1) / 2.0) / nullif(p * (count(*) - p), 0) AS auc
    FROM (SELECT *, rank() OVER (PARTITION BY project, algorithm, arm ORDER BY score)
            + (count(*) OVER (PARTITION BY project, algorithm, arm, score) - 1) / 2.0::DOUBLE AS r,
            CAST(sum(label) OVER (PARTITION BY project, algorithm, arm) AS DOUBLE) AS p
          FROM all_scores) GROUP BY project, algorithm, arm, p) a
    ON c.project = a.project AND c.algorithm = a.algorithm AND c.arm = a.arm"""))
def q_evaluation_grid(spark, sf_dir):
    """Every kept project x 6 algorithms x 2 arms -> ML metrics table (AUC
    over scores rounded to 6 digits, within the solvers' tolerance)."""
    preds = evaluation.all_predictions(spark, sf_dir)
    ev = comparison.evaluate_predictions(cut_lineage(preds.withColumn("score", F.round("score", 6))))
    return ev.select("project", comparison.algorithm_metric().alias("algorithm_metric"), "auc", "accuracy",
                     "precision", "recall", "f1", "tp", "fp", "tn", "fn")
