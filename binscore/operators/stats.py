"""Correlation screening and paired comparison statistics (D16, D17, D22,
D23).

Everything except the final p-value is a Spark aggregation; the p-value
needs the normal tail (erfc) or the exact signed-rank distribution, which
neither Spark SQL nor DuckDB provides, so a small pandas UDF evaluates it on
the already aggregated rows (one row per compared pair of classifiers).
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from binscore.operators.joins import BROADCAST_MAX_ROWS
from binscore.operators.ranking import average_rank
from binscore.session import cut_lineage

CORR_THRESHOLD = 0.7


def _cross_products(d: int):
    """mapInArrow over ``g, x, lo``: per group of a task and pair of columns i < j
    the sums over the rows that have both: count, x_i, x_j, squares, product."""
    i, j = np.triu_indices(d, 1)

    def run(batches):
        held: dict[str, np.ndarray] = {}

        def out():
            n = len(held)
            sums = np.concatenate([s[:, i, j] for s in held.values()], axis=1)
            columns = [pa.array(np.repeat(np.array(list(held), object), len(i)), pa.string()), pa.array(np.tile(i, n).astype(np.int32)),
                       pa.array(np.tile(j, n).astype(np.int32)), *[pa.array(v) for v in sums]]
            held.clear()
            return pa.RecordBatch.from_arrays(columns, names=["gk", "i", "j", *SUMS])

        for batch in batches:
            keys = batch.column("gk").dictionary_encode()
            if not len(keys):
                continue
            x = np.array(batch.column("x").flatten().to_numpy(zero_copy_only=False), float).reshape(-1, d)
            x -= np.array(batch.column("lo").flatten().to_numpy(zero_copy_only=False), float).reshape(-1, d)
            there = ~np.isnan(x)
            x = np.where(there, x, 0.0)
            codes = keys.indices.to_numpy()
            for k, name in enumerate(keys.dictionary.to_pylist()):
                v, m = x[codes == k], there[codes == k].astype(float)
                part = np.stack([m.T @ m, v.T @ m, m.T @ v, (v * v).T @ m, m.T @ (v * v), v.T @ v])
                held[name] = held[name] + part if name in held else part
            if len(held) * d * d > HELD:
                yield out()
        if held:
            yield out()
    return run


SUMS = ("n", "si", "sj", "sii", "sjj", "sij")
#: Sums that a task holds at most, by their number a kind.
HELD = 1 << 20


def correlation_matrix(df: DataFrame, group_cols, columns, digits: int | None = None) -> DataFrame:
    """Pearson r for every column pair (a before b in ``columns``) per
    group, pairwise-complete.  A constant column gives NULL.  ``r`` is rounded to
    ``digits`` decimals if given: only for output, never before a threshold.

    A task forms the cross products of its rows as matrices (values less the
    group's minimum, so that a constant column is exactly zero); one aggregation
    of six sums adds them up by (group, pair).  The plan does not grow with the
    number of columns."""
    g, cols = list(group_cols), list(columns)
    d = len(cols)
    x = F.array(*[F.nanvl(F.col(c).cast("double"), F.lit(None)) for c in cols])
    rows = df.select(F.to_json(F.struct(*g)).alias("gk"), x.alias("x"), *g)
    low = rows.groupBy("gk").agg(F.array(*[F.min(F.col("x")[k]) for k in range(d)]).alias("lo"), *[F.first(c).alias(c) for c in g])
    low = cut_lineage(low)
    # a value a column and group: the bound is checked in values
    small = low.count() * d <= BROADCAST_MAX_ROWS
    near = F.broadcast(low.select("gk", "lo")) if small else low.select("gk", "lo")
    parts = (rows.select("gk", "x").join(near, "gk").select("gk", "x", F.transform("lo", lambda v: F.coalesce(v, F.lit(0.0))).alias("lo"))
             .mapInArrow(_cross_products(d), "gk string, i int, j int, " + ", ".join(f"{c} double" for c in SUMS)))
    total = parts.groupBy("gk", "i", "j").agg(*[F.sum(c).alias(c) for c in SUMS])

    def spread(s, ss):
        mean, square = F.try_divide(F.col(s), F.col("n")), F.try_divide(F.col(ss), F.col("n"))
        # what rounding leaves of a constant column is no spread
        return F.when(square - mean * mean > 1e-14 * square, square - mean * mean)

    cov = F.try_divide(F.col("sij"), F.col("n")) - F.try_divide(F.col("si"), F.col("n")) * F.try_divide(F.col("sj"), F.col("n"))
    r = cov / (F.sqrt(spread("si", "sii")) * F.sqrt(spread("sj", "sjj")))
    names = F.array(*[F.lit(c) for c in cols])
    shown = r if digits is None else F.round(r, digits)
    groups = F.broadcast(low.select("gk", *g)) if small else low.select("gk", *g)
    return total.join(groups, "gk").select(*g, names[F.col("i")].alias("col_a"), F.col("i").alias("pos_a"),
                                           names[F.col("j")].alias("col_b"), F.col("j").alias("pos_b"), shown.alias("r"))


def correlated_features(corr: DataFrame, group_cols, keep=("label",),
                        threshold: float = CORR_THRESHOLD) -> DataFrame:
    """For each pair with |r| > threshold drop the earlier column; the
    columns in ``keep`` (the label) are never dropped; NULL r drops nothing."""
    g = list(group_cols)
    return (corr.where((F.abs("r") > F.lit(threshold)) & ~F.col("col_a").isin(*keep))
                .select(*g, F.col("col_a").alias("feature")).distinct())


def cles(pairs: DataFrame, keys=("llm", "ml"), a="llm_f1", b="ml_f1") -> DataFrame:
    """Common-language effect size on paired rows: mean of 1 / 0.5 / 0
    for a > b, a = b, a < b.  NULL with fewer than two pairs."""
    k = list(keys)
    dom = (F.when(F.col(a) > F.col(b), F.lit(1.0))
            .when(F.col(a) == F.col(b), F.lit(0.5)).otherwise(F.lit(0.0)))
    return pairs.groupBy(*k).agg(F.count(F.lit(1)).alias("n_pairs"), F.avg(dom).alias("_c")).select(
        *k, "n_pairs", F.when(F.col("n_pairs") >= 2, F.col("_c")).alias("cles"))


def signed_rank_stats(pairs: DataFrame, keys=("llm", "ml"), a="llm_f1", b="ml_f1") -> DataFrame:
    """D23 (aggregate part): per key, pairs, non-zero differences n, rank
    sums R+ and R- of |d| (mid-ranks, zeros dropped), the tie term
    sum t (t^2 - 1), and the normal-approximation z (no continuity
    correction)."""
    k = list(keys)
    d = pairs.select(*k, (F.col(a) - F.col(b)).alias("d"))
    counts = d.groupBy(*k).agg(F.count(F.lit(1)).alias("n_pairs"))
    nz = d.where(F.col("d") != 0).withColumn("ad", F.abs("d"))
    ranked = average_rank(nz, k, "ad", "rank")
    sums = ranked.groupBy(*k).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.when(F.col("d") > 0, F.col("rank")).otherwise(F.lit(0.0))).alias("r_plus"),
        F.sum(F.when(F.col("d") < 0, F.col("rank")).otherwise(F.lit(0.0))).alias("r_minus"))
    ties = (nz.groupBy(*k, "ad").agg(F.count(F.lit(1)).alias("t"))
              .groupBy(*k).agg(F.sum(F.col("t") * (F.col("t") * F.col("t") - 1)).alias("tie_term")))
    out = counts.join(sums, k, "left").join(ties, k, "left")
    n = F.coalesce(F.col("n"), F.lit(0)).cast("bigint")
    nd = n.cast("double")
    t_stat = F.least(F.col("r_plus"), F.col("r_minus"))
    mean = nd * (nd + 1) / F.lit(4.0)
    se = F.sqrt((nd * (nd + 1) * (F.lit(2.0) * nd + 1) - F.lit(0.5) * F.col("tie_term").cast("double"))
                / F.lit(24.0))
    return out.select(
        *k, "n_pairs", n.alias("n"),
        F.coalesce(F.col("r_plus"), F.lit(0.0)).alias("r_plus"),
        F.coalesce(F.col("r_minus"), F.lit(0.0)).alias("r_minus"),
        F.coalesce(F.col("tie_term"), F.lit(0)).cast("bigint").alias("tie_term"),
        F.when(n > 0, F.try_divide(t_stat - mean, se)).alias("z"))


def _exact_counts(n: int) -> list[int]:
    """Number of subsets of {1..n} with each rank sum 0..n(n+1)/2."""
    counts = [1]
    for r in range(1, n + 1):
        nxt = counts + [0] * r
        for s, c in enumerate(counts):
            nxt[s + r] += c
        counts = nxt
    return counts


EXACT_MAX_N = 50


def signed_rank_pvalue(n_pairs: int, n: int, r_plus: float, r_minus: float, tie_term: int) -> float | None:
    """Two-sided signed-rank p-value: exact distribution for at most 50
    pairs without zero differences, else the tie-corrected normal
    approximation.  NULL for fewer than 2 pairs or all-zero differences."""
    if n_pairs is None or n_pairs < 2 or not n:
        return None
    if n_pairs <= EXACT_MAX_N and n == n_pairs:
        counts = _exact_counts(n)
        total = 2 ** n
        r = int(math.floor(r_plus))
        if r == (len(counts) - 1) // 2:
            return 1.0
        p_less = sum(counts[: r + 1]) / total
        p_greater = sum(counts[r:]) / total
        return min(1.0, 2.0 * min(p_less, p_greater))
    t_stat = min(r_plus, r_minus)
    mean = n * (n + 1) / 4.0
    se = math.sqrt((n * (n + 1) * (2.0 * n + 1) - 0.5 * tie_term) / 24.0)
    z = (t_stat - mean) / se
    return math.erfc(abs(z) / math.sqrt(2.0))


@F.pandas_udf(DoubleType())
def signed_rank_pvalue_udf(n_pairs: pd.Series, n: pd.Series, r_plus: pd.Series, r_minus: pd.Series,
                           tie_term: pd.Series) -> pd.Series:
    out = [signed_rank_pvalue(None if pd.isna(a) else int(a), 0 if pd.isna(b) else int(b),
                              float(c), float(d), 0 if pd.isna(e) else int(e))
           for a, b, c, d, e in zip(n_pairs, n, r_plus, r_minus, tie_term)]
    return pd.Series(out, dtype="float64")


def wilcoxon(pairs: DataFrame, keys=("llm", "ml"), a="llm_f1", b="ml_f1") -> DataFrame:
    """D23 + D22: per key the signed-rank statistics, the p-value and the
    CLES, raw and rounded (p to 3, CLES to 2 decimals, half-even)."""
    k = list(keys)
    stats = signed_rank_stats(pairs, k, a, b)
    eff = cles(pairs, k, a, b).drop("n_pairs")
    res = stats.join(eff, k, "inner").withColumn(
        "p_value", signed_rank_pvalue_udf("n_pairs", "n", "r_plus", "r_minus", "tie_term"))
    return res.withColumns({
        "p_rounded": F.bround("p_value", 3),
        "cles_rounded": F.bround("cles", 2),
    })
