"""Lookups, semi/anti joins and alignments.

Join strategy: the planner and AQE pick the physical join.  A side is
broadcast explicitly only through ``bounded_broadcast``, which first proves
the row and byte bounds with a LIMIT-ed aggregate; beyond the bound the join stays a
shuffle (sort-merge) join, which AQE may still convert at runtime from
measured shuffle sizes, and whose skewed partitions AQE splits.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from binscore.functions.text import has_error, normalise_key
from binscore.session import cut_lineage

RUN_KEY = ("project_name", "github_path")

# Upper bounds on what ``bounded_broadcast`` sends to every executor.
BROADCAST_MAX_ROWS = 1_000_000
BROADCAST_MAX_BYTES = 64 << 20


def bounded_broadcast(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS,
                      materialize: bool = False, max_bytes: int = BROADCAST_MAX_BYTES) -> DataFrame:
    """``broadcast(df)`` when it provably has at most ``max_rows`` rows and
    ``max_bytes`` bytes (text bytes, 16 for any other value), else ``df``
    unchanged (shuffle join, where AQE still splits skewed partitions).  The
    check reads at most ``max_rows + 1`` rows.

    ``materialize`` first checkpoints ``df`` to the shared folder, so that
    a small side computed from a large table (distinct error keys, skipped
    projects) is computed once for both the check and the join."""
    if materialize:
        df = cut_lineage(df)
    width = reduce(lambda a, b: a + b, [
        F.coalesce(F.octet_length(f.name), F.lit(0)) if isinstance(f.dataType, StringType) else F.lit(16)
        for f in df.schema.fields])
    n, size = df.limit(max_rows + 1).agg(F.count(F.lit(1)), F.sum(width.cast("bigint"))).first()
    return F.broadcast(df) if n <= max_rows and (size or 0) <= max_bytes else df


def error_keys(runs: DataFrame, keys=RUN_KEY) -> DataFrame:
    """Distinct (project, path) with an error in any configuration."""
    return runs.where(has_error("errors")).select(*keys).distinct()


def anti_join_errors(runs: DataFrame, keys=RUN_KEY, errors: DataFrame | None = None) -> DataFrame:
    """Drop every configuration's rows for a file that failed in any
    configuration (raw keys, not normalised)."""
    errs = errors if errors is not None else error_keys(runs, keys)
    # failed files are few next to the run rows: broadcast them (checked),
    # so the run table is filtered where it is read, without a shuffle
    return runs.join(bounded_broadcast(errs, materialize=True), list(keys), "left_anti")


def anti_join_projects(df: DataFrame, skipped: DataFrame, project="project_name") -> DataFrame:
    """Drop rows whose (normalised) project is in ``skipped.project``."""
    # one row per project: broadcast (checked), so no task ever receives all
    # rows of a hot project through a shuffle on the project key
    small = bounded_broadcast(skipped, materialize=True)
    return df.join(small, F.col(project) == small["project"], "left_anti")


def semi_join_split(features: DataFrame, split: DataFrame) -> DataFrame:
    """Keep feature rows whose normalised (project, path) is in the
    split; the path only matches within its own project."""
    keys = split.select(normalise_key("project_name").alias("_p"),
                        normalise_key("github_path").alias("_g")).distinct()
    f = features.withColumns({"_p": normalise_key("project_name"),
                              "_g": normalise_key("github_path")})
    return f.join(keys, ["_p", "_g"], "left_semi").drop("_p", "_g")


def pick_exemplars(train: DataFrame, project="project_name", size="token_size",
                   path="github_path") -> DataFrame:
    """Per project, the smallest positive and smallest negative train
    file (NULL sizes last, ties broken by path).  Projects lacking either
    class are absent.  ``min_by`` is an ordinary (partially aggregated)
    aggregate, so no group is ever materialised."""
    order = F.struct(F.col(size).isNull(), F.col(size), F.col(path))
    pos = F.when(F.col("label") == 1, order)
    neg = F.when(F.col("label") == 0, order)
    return (train.groupBy(project)
            .agg(F.min(pos).alias("_pos"), F.min(neg).alias("_neg"))
            .where(F.col("_pos").isNotNull() & F.col("_neg").isNotNull())
            .select(project, F.col(f"_pos.{path}").alias("positive_example"),
                    F.col(f"_neg.{path}").alias("negative_example")))


def join_exemplars(test: DataFrame, exemplars: DataFrame, project="project_name") -> DataFrame:
    """Attach the project's exemplar pair to every test row; projects
    without both exemplars drop out (inner join, one row per project on
    the right, so the join never multiplies rows)."""
    return test.join(bounded_broadcast(exemplars, materialize=True), project, "inner")


def outer_join_f1(llm_wide: DataFrame, ml_wide: DataFrame) -> DataFrame:
    """Align the LLM and ML pivots on project, keeping both sides."""
    return llm_wide.join(ml_wide, "project", "full_outer")


def cross_compare(f1_wide: DataFrame, llm_cols, ml_cols, project: str = "project") -> DataFrame:
    """Every (LLM, ML) pair per project, generated row by row from the
    wide F1 table (one row per project): a fixed list of
    len(llm_cols) x len(ml_cols) column pairs, so no join and no shuffle."""
    pairs = [F.struct(F.lit(a).alias("llm"), F.lit(b).alias("ml"),
                      F.col(a).cast("double").alias("llm_f1"), F.col(b).cast("double").alias("ml_f1"))
             for a in llm_cols for b in ml_cols]
    return f1_wide.select(F.col(project), F.explode(F.array(*pairs)).alias("_p")).select(project, "_p.*")


def pairwise_complete(pairs: DataFrame) -> DataFrame:
    """Keep projects where both scores of a pair are present."""
    return pairs.where(F.col("llm_f1").isNotNull() & F.col("ml_f1").isNotNull())


def anti_join_zero_f1(metrics: DataFrame, keys=("project",)) -> DataFrame:
    """Drop projects whose F1 sums to 0 in the selected configuration."""
    zero = metrics.groupBy(*keys).agg(F.sum("f1").alias("_s")).where(F.col("_s") == 0)
    return metrics.join(zero.select(*keys), list(keys), "left_anti")
