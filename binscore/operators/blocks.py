"""Rows of small groups packed into blocks, for learners that work on all
groups at once: a block is one row with up to ``BLOCK`` rows of one group, so
that a group's model is joined once a block and not once a row."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from binscore.operators.joins import BROADCAST_MAX_BYTES
from binscore.session import scratch_dir

BLOCK = 4096
#: A group of at most this many rows is fitted whole by one task; larger groups
#: take their steps together, an aggregation each.
WHOLE = 1 << 18
#: Tasks for each core that models are dealt to.
DEALT = 4


def group_key(group) -> F.Column:
    return F.to_json(F.struct(*group))


def feature_array(columns) -> F.Column:
    return F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns])


def broadcast_within(df: DataFrame, size: F.Column) -> DataFrame:
    """``df``, broadcast if its values, ``size`` bytes a row, are within the
    bound; else for a shuffle join, which AQE may split.  ``df`` is materialised."""
    total = df.agg(F.sum(size.cast("bigint"))).first()[0] or 0
    return F.broadcast(df) if total <= BROADCAST_MAX_BYTES else df


def spread(df: DataFrame, models: DataFrame, keys) -> DataFrame:
    """Blocks joined with ``models`` (materialised), dealt by model to all cores: a
    model's blocks are small beside the work on them, so sizes in bytes, by which
    AQE would put them together, do not tell."""
    tasks = DEALT * df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(min(max(models.count(), 1), tasks), *keys)


def group_columns(df: DataFrame, group, like: DataFrame) -> DataFrame:
    """The group columns again from ``gk``."""
    kinds = {f.name: f.dataType.simpleString() for f in like.schema.fields}
    return df.withColumn("_g", F.from_json("gk", ", ".join(f"`{c}` {kinds[c]}" for c in group))).select(
        *[F.col(f"_g.{c}").alias(c) for c in group], *[c for c in df.columns if c != "gk"])


def _pack(names, limit: int):
    """mapInArrow over rows sorted by ``gk``: blocks of one group, fixed-width
    columns as bytes, others as lists."""
    def run(batches):
        held, size, key = [], 0, None
        for batch in batches:
            keys = batch.column("gk").to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)] if len(keys) else [0]
            for a, b in zip(edges[:-1], edges[1:]):
                at = a
                if held and (keys[a] != key or size >= limit):
                    yield out(key, held)
                    held, size = [], 0
                key = keys[a]
                while at < b:
                    part = batch.slice(at, min(b - at, limit - size))
                    held.append(part)
                    at, size = at + len(part), size + len(part)
                    if size == limit:
                        yield out(key, held)
                        held, size = [], 0
        if held:
            yield out(key, held)

    def out(key, held):
        n = sum(map(len, held))
        columns = [pa.array([key], pa.string())]
        for name in names:
            col = pa.concat_arrays([h.column(name) for h in held])
            if name == "x":
                columns.append(pa.array([col.flatten().to_numpy().tobytes()], pa.binary()))
            elif name in ("label", "key"):
                columns.append(pa.array([col.fill_null(0).to_numpy().astype(np.int64).tobytes()], pa.binary()))
            else:
                columns.append(pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), col))
        return pa.RecordBatch.from_arrays(columns, names=["gk", *names])
    return run


def blocks_of(rows: DataFrame, name: str, limit: int = BLOCK) -> DataFrame:
    """``rows`` (``gk`` and others) as blocks, written to the shared folder.  AQE
    splits the partitions of a large group."""
    names = [c for c in rows.columns if c != "gk"]
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = "gk string, " + ", ".join(
        f"{c} binary" if c in ("x", "label", "key") else f"{c} array<{kinds[c]}>" for c in names)
    path = scratch_dir(rows.sparkSession, name)
    rows.hint("rebalance", "gk").sortWithinPartitions("gk").mapInArrow(_pack(names, limit), schema).write.parquet(path)
    return rows.sparkSession.read.parquet(path)
