"""Confusion counts, precision/recall/F1 and the summary tables (D1-D15,
D20, D21).

All of them are single ``groupBy`` aggregations of algebraic functions
(count / sum / min / max), so Spark runs them as partial (map-side)
aggregation followed by a shuffle of one row per group and task: a group
that holds a third of all rows costs no more than any other.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from binscore.functions.text import normalise_key
from binscore.operators.draws import poisson_limits, row_number_of, scramble_col
from binscore.session import cut_lineage

CONFIG_KEYS = ("model", "comments_included", "prompting")


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def count_when(cond: Column) -> Column:
    return F.sum(F.when(cond, F.lit(1)).otherwise(F.lit(0))).cast("bigint")


def confusion_aggs(label="label", prediction="prediction") -> list[Column]:
    """Tn, fp, fn, tp for labels [0, 1] over rows with a prediction."""
    y, p = _c(label), _c(prediction)
    return [
        count_when((p == 0) & (y == 0)).alias("tn"),
        count_when((p == 1) & (y == 0)).alias("fp"),
        count_when((p == 0) & (y == 1)).alias("fn"),
        count_when((p == 1) & (y == 1)).alias("tp"),
    ]


def safe_ratio(num: Column, den: Column) -> Column:
    """x / y with zero division -> 0 (ANSI-safe)."""
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(0.0))


def precision_col(tp="tp", fp="fp") -> Column:
    return safe_ratio(_c(tp), _c(tp) + _c(fp))


def recall_col(tp="tp", fn="fn") -> Column:
    return safe_ratio(_c(tp), _c(tp) + _c(fn))


def f1_col(tp="tp", fp="fp", fn="fn") -> Column:
    """2tp / (2tp + fp + fn), 0 when undefined."""
    return safe_ratio(F.lit(2) * _c(tp), F.lit(2) * _c(tp) + _c(fp) + _c(fn))


def accuracy_col(tp="tp", tn="tn", n="n") -> Column:
    """(tp + tn) / n."""
    return safe_ratio(_c(tp) + _c(tn), _c(n))


def coverage_aggs(response="response", prediction="prediction",
                  heuristic="interpreted") -> list[Column]:
    """D3: total rows, answers, predictions (heuristic ones included) and
    heuristic labels."""
    return [
        F.count(F.lit(1)).alias("total_inferences"),
        F.count(_c(response)).alias("responses"),
        F.count(_c(prediction)).alias("yes_no"),
        F.count(_c(heuristic)).alias("heuristic"),
    ]


def value_count_aggs(label="label", prediction="prediction") -> list[Column]:
    """1/0 counts of label and prediction over all rows."""
    y, p = _c(label), _c(prediction)
    return [
        count_when(y == 1).alias("gt_true"),
        count_when(y == 0).alias("gt_false"),
        count_when(p == 1).alias("predicted_true"),
        count_when(p == 0).alias("predicted_false"),
    ]


def config_summary(df: DataFrame, keys=CONFIG_KEYS) -> DataFrame:
    """Per configuration coverage, value counts, P/R/F1 and the
    confusion matrix.  Rows with a NULL key are not grouped; scores and
    confusion are NULL when a group has no prediction at all."""
    agg = df.where(_all_there(keys)).groupBy(*keys).agg(
        *coverage_aggs(), *value_count_aggs(), *confusion_aggs(),
        F.count("prediction").alias("_n_pred"))
    return _summary_rows(agg, keys)


def _all_there(keys) -> Column:
    return reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])


def _summary_rows(agg: DataFrame, keys) -> DataFrame:
    has_pred = F.col("_n_pred") > 0
    null_d = F.lit(None).cast("double")
    null_l = F.lit(None).cast("bigint")
    return agg.select(
        *keys, "total_inferences", "responses", "yes_no", "heuristic",
        "gt_true", "gt_false", "predicted_true", "predicted_false",
        F.when(has_pred, precision_col()).otherwise(null_d).alias("precision"),
        F.when(has_pred, recall_col()).otherwise(null_d).alias("recall"),
        F.when(has_pred, f1_col()).otherwise(null_d).alias("f1"),
        *[F.when(has_pred, F.col(c)).otherwise(null_l).alias(c) for c in ("tn", "fp", "fn", "tp")],
    )


def project_metrics(df: DataFrame, keys=CONFIG_KEYS, project="project_name") -> DataFrame:
    """P/R/F1 and confusion per (configuration, project); groups with no
    prediction and rows with a NULL key (not grouped by pandas) are omitted."""
    not_null = F.col("prediction").isNotNull() & F.col(project).isNotNull()
    for k in keys:
        not_null = not_null & F.col(k).isNotNull()
    grouped = (df.where(not_null)
                 .groupBy(*keys, F.col(project).alias("project"))
                 .agg(*confusion_aggs()))
    return grouped.select(
        "project", *keys, precision_col().alias("precision"), recall_col().alias("recall"),
        f1_col().alias("f1"), "tp", "fp", "tn", "fn")


def summary_and_projects(df: DataFrame, keys=CONFIG_KEYS, project="project_name") -> tuple[DataFrame, DataFrame]:
    """D1 and D2 from one scan and one exchange: grouping sets of the
    configuration with and without the project, materialised for both tables."""
    keys = list(keys)
    whole = [F.col(k) for k in keys]
    grouped = (df.where(_all_there(keys)).withColumnRenamed(project, "project")
               .groupingSets([whole, [*whole, F.col("project")]], *whole, F.col("project"))
               .agg(F.grouping_id().alias("_set"), *coverage_aggs(), *value_count_aggs(), *confusion_aggs(),
                    F.count("prediction").alias("_n_pred")))
    grouped = cut_lineage(grouped)
    per_project = grouped.where((F.col("_set") == 0) & F.col("project").isNotNull() & (F.col("_n_pred") > 0))
    return (_summary_rows(grouped.where(F.col("_set") == 1), keys),
            per_project.select("project", *keys, precision_col().alias("precision"), recall_col().alias("recall"),
                               f1_col().alias("f1"), "tp", "fp", "tn", "fn"))


def zero_positive_projects(test_split: DataFrame, project="project_name") -> DataFrame:
    """Projects (grouped on the raw name, emitted normalised) whose test
    labels are all 0.  A NULL label counts as not 0."""
    return (test_split.groupBy(project)
            .agg(F.every(F.coalesce(F.col("label") == 0, F.lit(False))).alias("_all_zero"))
            .where("_all_zero")
            .select(normalise_key(project).alias("project")))


def ml_skip_rule(train: DataFrame, test: DataFrame, project="project_name") -> DataFrame:
    """Per normalised project, whether the learners are run.

    skip_reason: 'no_split' when both splits are empty (cannot occur for a
    project that appears), 'no_positive' when either split has no positive
    label (an empty split counts as none), NULL when kept."""
    def side(df, name):
        return (df.groupBy(normalise_key(project).alias("project"))
                  .agg(F.count(F.lit(1)).alias(f"n_{name}"),
                       count_when(F.col("label") == 1).alias(f"pos_{name}")))

    both = side(train, "train").join(side(test, "test"), "project", "full_outer")
    n_tr = F.coalesce(F.col("n_train"), F.lit(0))
    n_te = F.coalesce(F.col("n_test"), F.lit(0))
    p_tr = F.coalesce(F.col("pos_train"), F.lit(0))
    p_te = F.coalesce(F.col("pos_test"), F.lit(0))
    reason = (F.when((n_tr == 0) & (n_te == 0), F.lit("no_split"))
               .when((p_tr == 0) | (p_te == 0), F.lit("no_positive"))
               .otherwise(F.lit(None).cast("string")))
    return both.select("project", n_tr.cast("bigint").alias("n_train"),
                       n_te.cast("bigint").alias("n_test"),
                       p_tr.cast("bigint").alias("pos_train"),
                       p_te.cast("bigint").alias("pos_test"), reason.alias("skip_reason"))


def distinct_projects(df: DataFrame, project="project_name") -> DataFrame:
    """Unique normalised project names (de-duplicated after
    normalising)."""
    return df.select(normalise_key(project).alias("project")).where("project is not null").distinct()


def mean_scores(summary: DataFrame, keys=("model", "comments_included")) -> DataFrame:
    """Mean precision/recall/F1 per (model, comments)."""
    return summary.groupBy(*keys).agg(
        F.avg("precision").alias("precision"), F.avg("recall").alias("recall"),
        F.avg("f1").alias("f1"))


def zero_f1_projects(metrics: DataFrame, keys=("project",)) -> DataFrame:
    """Projects whose F1 sums to 0."""
    return (metrics.groupBy(*keys).agg(F.sum("f1").alias("f1_sum"))
                   .where(F.col("f1_sum") == 0).select(*keys))


def bar_means(metrics: DataFrame, keys=("project",)) -> DataFrame:
    """Mean F1 per (project, model), the plotted bar height."""
    return metrics.groupBy(*keys, "model").agg(F.avg("f1").alias("mean_f1"))


def bar_intervals(rows: DataFrame, keys, value: str, row_cols, replicates: int = 1000, level: float = 0.95) -> DataFrame:
    """Mean of ``value`` in each cell of ``keys`` and the interval that a bar
    chart draws around it: percentiles of the means of bootstrap replicates.

    A replicate draws each row a Poisson(1) number of times, told by a hash of
    the row (``row_cols``) and the replicate, so all replicates are sums of one
    aggregation, a row is never copied to another task and reruns agree.  A
    replicate that drew none of a cell's rows has no mean there; a cell of one
    row has its value at both ends.  NULL values are left out."""
    g = list(keys)
    hashed = scramble_col(row_number_of(*row_cols), F.col("_b"))
    times = reduce(lambda a, b: a + b, [(hashed >= x).cast("bigint") for x in poisson_limits(1.0)])
    drawn = (rows.where(F.col(value).isNotNull()).withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
             .select(*g, "_b", F.col(value).alias("_v"), times.alias("_times")))
    means = (drawn.groupBy(*g, "_b").agg(F.sum(F.col("_times") * F.col("_v")).alias("_sum"), F.sum("_times").alias("_n"),
                                         F.avg("_v").alias("_mean"))
             .select(*g, F.try_divide("_sum", F.col("_n")).alias("_m"), "_mean"))
    ends = F.percentile("_m", F.array(F.lit((1 - level) / 2), F.lit((1 + level) / 2)))
    return means.groupBy(*g).agg(F.first("_mean").alias("mean"), ends.alias("_e")).select(
        *g, "mean", F.col("_e")[0].alias("low"), F.col("_e")[1].alias("high"))


def mean_or_default(df: DataFrame, auc="auc") -> DataFrame:
    """An AUC of 0.0 (falsy) is reported as NULL, other metrics as is."""
    return df.withColumn(auc, F.when(F.col(auc) == 0, F.lit(None).cast("double"))
                         .otherwise(F.col(auc)))


def class_weights(train: DataFrame, group="project", label="label") -> DataFrame:
    """Balanced class weights n / (2 n_c) per group and class."""
    per_class = train.groupBy(group, label).agg(F.count(F.lit(1)).alias("n_c"))
    totals = train.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    return (per_class.join(totals, group)
            .select(group, label, "n_c", "n",
                    (F.col("n") / (F.lit(2.0) * F.col("n_c"))).alias("weight")))
