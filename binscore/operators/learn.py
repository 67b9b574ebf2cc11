"""Per-project learners and their inputs (B17-B19, D9, D16, D17, D21,
I1-I10).

Scaling and the complement naive Bayes model are closed forms, so they run
for all projects at once as aggregations: a project with a third of all rows is
just more partial-aggregation input.  The iterative learners run an aggregation
a step or a tree level for all projects (``linear.py``, ``trees.py``,
``perceptron.py``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from binscore.operators.joins import bounded_broadcast

NON_FEATURES = ("Project_name", "project_name", "File", "file", "github_path", "token_size",
                "file_available", "token_size_codellama", "doc_id")
CNB_ALPHA = 0.001


def drop_non_features(df: DataFrame, names=NON_FEATURES) -> DataFrame:
    """Drop key and size columns (absent names are ignored; names match
    case-sensitively, so ``project_name`` is not taken for ``Project_name``)."""
    present = set(df.columns)
    return df.drop(*[n for n in names if n in present])


def ablate_features(df: DataFrame, ablatable) -> DataFrame:
    """Remove the ablatable (anti-pattern) feature columns."""
    return df.drop(*ablatable)


def assemble(df: DataFrame, feature_cols, out: str = "features") -> DataFrame:
    """Feature vector + label, as Spark ML expects."""
    from pyspark.ml.feature import VectorAssembler
    return VectorAssembler(inputCols=list(feature_cols), outputCol=out, handleInvalid="keep").transform(df)


def minmax_fit(train: DataFrame, group, columns) -> DataFrame:
    """I1 (fit): per group the train min and max of every column."""
    aggs = []
    for c in columns:
        aggs += [F.min(c).alias(f"_min_{c}"), F.max(c).alias(f"_max_{c}")]
    return train.groupBy(*group).agg(*aggs)


def minmax_apply(df: DataFrame, stats: DataFrame, group, columns) -> DataFrame:
    """I1 (apply): (x - min) / (max - min) with the train statistics, not
    clipped; a constant train column is only shifted (range treated as 1),
    so train rows map to 0."""
    joined = df.join(bounded_broadcast(stats), list(group), "inner")
    scaled = {}
    for c in columns:
        lo, hi = F.col(f"_min_{c}"), F.col(f"_max_{c}")
        rng = hi - lo
        scaled[c] = (F.col(c) - lo) / F.when(rng == 0, F.lit(1.0)).otherwise(rng)
    drop = [f"_{k}_{c}" for c in columns for k in ("min", "max")]
    return joined.withColumns(scaled).drop(*drop)


def to_long(df: DataFrame, id_cols, feature_cols) -> DataFrame:
    return df.unpivot(list(id_cols), list(feature_cols), "feature", "x")


def used_flags(used: DataFrame, group, feature_cols) -> DataFrame:
    """(group..., arm, feature) long -> one row per (group..., arm) with a
    0/1 flag ``u_<feature>`` per feature."""
    g = list(group)
    return used.groupBy(*g, "arm").agg(*[
        F.max(F.when(F.col("feature") == F.lit(c), F.lit(1)).otherwise(F.lit(0))).alias(f"u_{c}")
        for c in feature_cols])


def cnb_train_score(train: DataFrame, test: DataFrame, flags: DataFrame, group, feature_cols,
                    keys, alpha: float = CNB_ALPHA) -> DataFrame:
    """Complement naive Bayes in closed form, for every group and arm at
    once.

    With S_c,i the summed (scaled) feature i over train rows of class c and
    q(c,i) = alpha + S_all,i - S_c,i (for two classes: alpha + S_other,i),
    the weights are w(c,i) = -log(q(c,i) / sum_j q(c,j)) over the arm's
    features j, the joint score jll_c = sum_i x_i w(c,i), the prediction
    argmax_c (ties -> 0) and the probability of class 1 the softmax of
    (jll_0, jll_1).

    Wide form: one partial aggregation of the train rows (2 sums per
    feature and group), a join with the per-arm feature flags (rows =
    groups x 2), and one join of the test rows with those weights; the
    per-row score is a codegen'd expression, no further shuffle."""
    g = list(group)
    feats = list(feature_cols)
    sums = train.groupBy(*g).agg(*[
        e for c in feats for e in (
            F.sum(F.when(F.col("label") == 1, F.col(c)).otherwise(F.lit(0.0))).alias(f"s1_{c}"),
            F.sum(F.when(F.col("label") == 0, F.col(c)).otherwise(F.lit(0.0))).alias(f"s0_{c}"))])
    # complement of class 0 is class 1 and vice versa
    q0 = {c: F.lit(alpha) + F.col(f"s1_{c}") for c in feats}
    q1 = {c: F.lit(alpha) + F.col(f"s0_{c}") for c in feats}
    used = {c: F.col(f"u_{c}") == 1 for c in feats}
    tot0 = sum((F.when(used[c], q0[c]).otherwise(F.lit(0.0)) for c in feats), F.lit(0.0))
    tot1 = sum((F.when(used[c], q1[c]).otherwise(F.lit(0.0)) for c in feats), F.lit(0.0))
    weights = sums.join(flags, g, "inner").select(
        *g, "arm",
        *[F.when(used[c], -F.log(q0[c] / tot0)).otherwise(F.lit(0.0)).alias(f"w0_{c}") for c in feats],
        *[F.when(used[c], -F.log(q1[c] / tot1)).otherwise(F.lit(0.0)).alias(f"w1_{c}") for c in feats])
    x = {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in feats}
    jll0 = sum((x[c] * F.col(f"w0_{c}") for c in feats), F.lit(0.0))
    jll1 = sum((x[c] * F.col(f"w1_{c}") for c in feats), F.lit(0.0))
    scored = test.join(bounded_broadcast(weights, materialize=True), g, "inner").select(*g, "arm", *keys, jll0.alias("jll0"), jll1.alias("jll1"))
    return scored.select(
        *g, "arm", *keys,
        (F.lit(1.0) / (F.lit(1.0) + F.exp(F.col("jll0") - F.col("jll1")))).alias("score"),
        F.when(F.col("jll1") > F.col("jll0"), F.lit(1)).otherwise(F.lit(0)).alias("prediction"))


def dropped_features(corr: DataFrame, group, ablatable, label: str = "label",
                     threshold: float = 0.7) -> DataFrame:
    """D17 for both arms from one correlation table: arm 0 screens all
    columns, arm 1 only the non-ablatable ones; the earlier column of a
    pair with |r| > threshold is dropped, the label never."""
    g = list(group)
    hit = corr.where((F.abs("r") > F.lit(threshold)) & (F.col("col_a") != F.lit(label)))
    arm0 = hit.select(*g, F.lit(0).alias("arm"), F.col("col_a").alias("feature"))
    clean = ~F.col("col_a").isin(*ablatable) & ~F.col("col_b").isin(*ablatable)
    arm1 = hit.where(clean).select(*g, F.lit(1).alias("arm"), F.col("col_a").alias("feature"))
    return arm0.unionByName(arm1).distinct()


def arm_features(kept: DataFrame, dropped: DataFrame, group, feature_cols, ablatable,
                 ablation: str = "strict") -> DataFrame:
    """Features used per (group, arm): all minus the correlated ones, and in
    the 'without' arm (1) minus the ablatable ones (strict mode; the
    'reference' mode keeps them in train/test, as the original did)."""
    g = list(group)
    arms = kept.select(*g).distinct().select(*g, F.explode(F.array(F.lit(0), F.lit(1))).alias("arm"))
    allf = arms.select(*g, "arm", F.explode(F.array(*[F.lit(c) for c in feature_cols])).alias("feature"))
    used = allf.join(dropped, [*g, "arm", "feature"], "left_anti")
    if ablation == "strict":
        used = used.where(~((F.col("arm") == 1) & F.col("feature").isin(*ablatable)))
    return used


def class_weight_col(train: DataFrame, group, label: str = "label", out: str = "weight") -> DataFrame:
    """D21 applied: each train row gets n / (2 n_c) of its group."""
    g = list(group)
    per = train.groupBy(*g, label).agg(F.count(F.lit(1)).alias("_nc"))
    tot = train.groupBy(*g).agg(F.count(F.lit(1)).alias("_n"))
    w = per.join(tot, g).select(*g, label, (F.col("_n") / (F.lit(2.0) * F.col("_nc"))).alias(out))
    return train.join(bounded_broadcast(w, materialize=True), [*g, label], "inner")
