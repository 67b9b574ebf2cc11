"""Exact ranks, running counts, ROC and AUC without a hot window (E1, E2,
E4, D18, D19).

A window ``partition by group order by value`` sends a whole group to one
task; when one group holds a third of the rows, that task holds a third of
the data.  Instead:

1. aggregate to one row per (group, distinct value) with its counts
   (partial aggregation, skew-safe);
2. sort those rows by (group, value) over all partitions and write them once
   with the number of the partition, so that every later reader and every
   repeated task sees the same cut;
3. prefix sums = (running sum inside the partition) + (the group's total in the
   partitions before).  Only a group that goes on from the partition before has
   such a total, at most one in a partition.

The result is exact: a row of (group, value) lies in one partition, so ties
never straddle an edge.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from binscore.operators.metrics import count_when
from binscore.operators.joins import bounded_broadcast
from binscore.session import cut_lineage

RANGE = "_range"


def in_ranges(hist: DataFrame, group_cols, value: str, n_ranges: int | None = None) -> DataFrame:
    """``hist`` (unique per (group, value)) sorted by both and written to the
    shared folder with the number of its partition, ``_range``.  Rows without a
    group are left out.  ``n_ranges``: number of partitions, else the session's."""
    g = list(group_cols)
    for c in g:
        hist = hist.where(F.col(c).isNotNull())
    order = [*g, value]
    ranged = hist.repartitionByRange(n_ranges, *order) if n_ranges else hist.repartitionByRange(*order)
    return cut_lineage(ranged.withColumn(RANGE, F.spark_partition_id()))


def _continued(per_range: DataFrame, group_cols, columns) -> DataFrame:
    """``per_range`` (a row per group and range) where the group goes on from an
    earlier range: at most one row a range, so small enough to broadcast."""
    first = F.min(RANGE).over(Window.partitionBy(*group_cols))
    return F.broadcast(per_range.withColumn("_first", first).where(F.col(RANGE) > F.col("_first"))
                       .select(*group_cols, RANGE, *columns))


def prefix_below(hist: DataFrame, group_cols, value: str, sum_cols, n_buckets: int | None = None,
                 suffix: str = "_below", totals_suffix: str | None = None) -> DataFrame:
    """For each row of ``hist`` (unique per (group, value)), add
    ``<c><suffix>`` = sum of ``c`` over the group's rows with a smaller
    value, for every ``c`` in ``sum_cols`` (and ``<c><totals_suffix>`` =
    the group's total when ``totals_suffix`` is given)."""
    g, sums = list(group_cols), list(sum_cols)
    placed = in_ranges(hist, g, value, n_buckets)
    per_range = placed.groupBy(*g, RANGE).agg(*[F.sum(c).alias(f"_t_{c}") for c in sums])
    lower = Window.partitionBy(*g).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    offsets = _continued(per_range.select(*g, RANGE, *[F.sum(f"_t_{c}").over(lower).alias(f"_o_{c}") for c in sums]),
                         g, [f"_o_{c}" for c in sums])
    before = Window.partitionBy(RANGE, *g).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    inside = placed.select("*", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_i_{c}") for c in sums])
    joined = inside.join(offsets, [*g, RANGE], "left")
    below = [(F.coalesce(F.col(f"_o_{c}"), F.lit(0)) + F.col(f"_i_{c}")).alias(f"{c}{suffix}") for c in sums]
    if not totals_suffix:
        return joined.select(*hist.columns, *below)
    totals = bounded_broadcast(placed.groupBy(*g).agg(*[F.sum(c).alias(f"{c}{totals_suffix}") for c in sums]))
    return joined.join(totals, g).select(*hist.columns, *below, *[f"{c}{totals_suffix}" for c in sums])


def average_rank(df: DataFrame, group_cols, value: str, out: str = "avg_rank",
                 n_buckets: int | None = None) -> DataFrame:
    """Mid-rank of ``value`` within its group (ties share the mean of
    their positions); NULL values get a NULL rank."""
    g = list(group_cols)
    hist = (df.where(F.col(value).isNotNull())
              .groupBy(*g, value).agg(F.count(F.lit(1)).alias("_n")))
    ranked = prefix_below(hist, g, value, ["_n"], n_buckets)
    ranks = ranked.select(*g, value, (F.col("_n_below") + (F.col("_n") + F.lit(1)) / F.lit(2.0)).alias(out))
    return df.join(ranks, [*g, value], "left")


def score_histogram(df: DataFrame, group_cols, score: str = "score", label: str = "label") -> DataFrame:
    """Positives and negatives per (group, distinct score)."""
    return df.where(F.col(score).isNotNull()).groupBy(*group_cols, score).agg(
        count_when(F.col(label) == 1).alias("npos"), count_when(F.col(label) == 0).alias("nneg"))


def running_counts(df: DataFrame, group_cols, score: str = "score", label: str = "label",
                   n_buckets: int | None = None) -> DataFrame:
    """Per distinct score (taken as the threshold, descending order),
    the cumulative true and false positives at score >= threshold."""
    g = list(group_cols)
    hist = score_histogram(df, g, score, label)
    # group totals come with the bucket offsets (windows over groups x buckets rows)
    below = prefix_below(hist, g, score, ["npos", "nneg"], n_buckets, totals_suffix="_total")
    return below.select(
        *g, F.col(score).alias("threshold"),
        (F.col("npos_total") - F.col("npos_below")).cast("bigint").alias("tps"),
        (F.col("nneg_total") - F.col("nneg_below")).cast("bigint").alias("fps"),
        F.col("npos_total").cast("bigint").alias("P"), F.col("nneg_total").cast("bigint").alias("N"))


def roc_curve(df: DataFrame, group_cols, score: str = "score", label: str = "label",
              n_buckets: int | None = None) -> DataFrame:
    """One ROC point per distinct score: fpr, tpr at score >= threshold
    (no points are dropped; an undefined rate is NULL)."""
    rc = running_counts(df, group_cols, score, label, n_buckets)
    return rc.select(
        *group_cols, "threshold", "tps", "fps",
        F.try_divide(F.col("fps").cast("double"), F.col("N").cast("double")).alias("fpr"),
        F.try_divide(F.col("tps").cast("double"), F.col("P").cast("double")).alias("tpr"))


def roc_points(df: DataFrame, group_cols, score: str = "score", label: str = "label",
               n_buckets: int | None = None) -> DataFrame:
    """D18 as plotted: the curve of ``roc_curve`` without the points at which it
    goes straight on with an equal step, and with its origin (NULL threshold).
    The first and the last threshold always stay.

    A point's next one, by descending score, is its lower neighbour; for the
    lowest row of a group in a range that is the highest one of the group's
    range before."""
    g = list(group_cols)
    placed = in_ranges(score_histogram(df, g, score, label), g, score, n_buckets)
    step = F.struct("npos", "nneg")
    per_range = placed.groupBy(*g, RANGE).agg(F.max_by(step, score).alias("_top"),
                                              *[F.sum(c).alias(f"_t_{c}") for c in ("npos", "nneg")])
    ranges = Window.partitionBy(*g).orderBy(RANGE)
    lower = ranges.rowsBetween(Window.unboundedPreceding, -1)
    edges = _continued(per_range.select(*g, RANGE, F.lag("_top").over(ranges).alias("_edge"), *[
        F.sum(f"_t_{c}").over(lower).alias(f"_o_{c}") for c in ("npos", "nneg")]), g, ["_edge", "_o_npos", "_o_nneg"])
    totals = bounded_broadcast(placed.groupBy(*g).agg(F.sum("npos").alias("P"), F.sum("nneg").alias("N"), F.max(score).alias("_high")))
    inside = Window.partitionBy(RANGE, *g).orderBy(score)
    below = inside.rowsBetween(Window.unboundedPreceding, -1)
    rows = placed.select("*", F.lag(step).over(inside).alias("_next"), *[
        F.coalesce(F.sum(c).over(below), F.lit(0)).alias(f"_i_{c}") for c in ("npos", "nneg")])
    rows = rows.join(edges, [*g, RANGE], "left").join(totals, g).withColumn("_next", F.coalesce("_next", "_edge"))
    kept = rows.where(F.col("_next").isNull() | (F.col("_next") != step) | (F.col(score) == F.col("_high")))

    def rate(total, c):
        at = F.col(total) - F.coalesce(F.col(f"_o_{c}"), F.lit(0)) - F.col(f"_i_{c}")
        return F.try_divide(at.cast("double"), F.col(total).cast("double"))

    points = kept.select(*g, F.col(score).alias("threshold"), rate("N", "nneg").alias("fpr"), rate("P", "npos").alias("tpr"))
    origin = [F.when(F.col(c) > 0, F.lit(0.0)) for c in ("N", "P")]
    return points.unionByName(totals.select(*g, F.lit(None).cast(points.schema["threshold"].dataType).alias("threshold"),
                                            origin[0].alias("fpr"), origin[1].alias("tpr")))


def roc_auc(df: DataFrame, group_cols, score: str = "score", label: str = "label",
            n_buckets: int | None = None) -> DataFrame:
    """Exact area under the ROC curve (Mann-Whitney U / (P N)), ties
    counted one half; NULL when a group lacks positives or negatives."""
    g = list(group_cols)
    hist = score_histogram(df, g, score, label)
    below = prefix_below(hist, g, score, ["nneg"], n_buckets)
    u = F.sum(F.col("npos") * (F.col("nneg_below") + F.col("nneg") / F.lit(2.0)))
    agg = below.groupBy(*g).agg(u.alias("_u"), F.sum("npos").alias("_p"), F.sum("nneg").alias("_n"))
    return agg.select(*g, F.try_divide(F.col("_u"), (F.col("_p") * F.col("_n")).cast("double")).alias("auc"))


def score_minmax(df: DataFrame, group_cols, score: str = "score", out: str = "scaled") -> DataFrame:
    """(s - min) / (max - min) within the group; all-equal -> NULL.
    min/max come from a partial aggregate (one row per group) broadcast
    back on a checked bound (no window, no shuffle of the rows)."""
    g = list(group_cols)
    mm = df.groupBy(*g).agg(F.min(score).alias("_min"), F.max(score).alias("_max"))
    return (df.join(bounded_broadcast(mm, materialize=True), g, "inner")
              .withColumn(out, F.try_divide(F.col(score) - F.col("_min"), F.col("_max") - F.col("_min")))
              .drop("_min", "_max"))


def row_index(df: DataFrame, order_cols, out: str = "row_index") -> DataFrame:
    """0-based position of every row in ``order_cols`` order (keys should be
    unique), without a global window: the range-partitioned sort numbers
    rows inside each partition, and each partition's offset is the running
    count of the partitions before it (one row per partition).

    The numbered copy is written to the shared folder once and read by both
    the counts and the join: planned twice, the two sorts could cut their
    partitions differently and lose or misnumber rows."""
    order = [F.col(c) for c in order_cols]
    sorted_df = (df.orderBy(*order)
                   .withColumn("_pid", F.spark_partition_id())
                   .withColumn("_local", F.monotonically_increasing_id()))
    local = F.col("_local") - F.shiftleft(F.col("_pid").cast("bigint"), 33)
    sorted_df = cut_lineage(sorted_df.withColumn("_local", local))
    counts = sorted_df.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    return (sorted_df.join(F.broadcast(offsets), "_pid", "inner")
                     .withColumn(out, (F.col("_off") + F.col("_local")).cast("bigint"))
                     .drop("_pid", "_local", "_off"))
