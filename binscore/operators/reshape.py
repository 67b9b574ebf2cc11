"""Unions, pivots and unpivots."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_runs(frames: list[DataFrame]) -> DataFrame:
    """Vertical concatenation by column name; columns missing on one
    side (zero-shot runs have no exemplar columns) become NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def pivot_unique(df: DataFrame, index: str, column: str, value: str, values: list[str]) -> DataFrame:
    """H1/H2/H3: ``index x column -> value`` with the column values listed
    (no extra job to discover them).  A duplicate (index, column) cell fails
    the query, as a pandas pivot would, instead of silently taking one."""
    checked = (df.groupBy(index, column)
                 .agg(F.count(F.lit(1)).alias("_n"), F.first(value).alias("_v"))
                 .select(index, column,
                         F.when(F.col("_n") > 1,
                                F.raise_error(F.concat(F.lit("duplicate pivot cell: "),
                                                       F.col(index).cast("string"), F.lit(" / "),
                                                       F.col(column).cast("string"))))
                          .otherwise(F.col("_v")).alias("_v")))
    return checked.groupBy(index).pivot(column, values).agg(F.first("_v"))


def unpivot_wide(df: DataFrame, index: str, columns: list[str], name: str = "name",
                 value: str = "value") -> DataFrame:
    """H5: wide -> long; NULL cells are kept (a later filter decides)."""
    return df.unpivot([index], columns, name, value)
