"""Centroid clustering with ns-bounds (norm-of-sum bounds).

Lloyd rounds over integer vectors with exact arithmetic.  Every vector keeps,
for each centroid, a lower bound of its distance and the round in which that
distance was last computed, and the same for the upper bound of its own
centroid.  The history of all centroids is kept: a bound from round T is
loosened in round t by the norm of the centroid's *total* displacement,
``|c_t - c_T|``, which is never more than the sum of the moves between, and
nothing where a centroid has come back.  Pairs whose loosened bound does not
exclude them are computed again exactly, in integers.

Vectors travel in blocks of ``BLOCK`` rows.  A round reads the blocks of the
round before from the shared folder and writes them with new clusters and
bounds and with the block's sums per cluster; the new centroids are an
aggregation that reads the column of sums alone.  No row is shuffled, a hot
vector is one cluster's share of its blocks' sums, and a lost executor's tasks
read the same written blocks again.  To the driver come the centroids and k
sums a round.

Defined results: a vector with another number of components, a null or a
non-finite component is left out; a null id stays null and is hashed as empty;
repeated rows are vectors of their own; equal hashes are ordered by components;
fewer vectors than ``k`` make fewer centroids; an empty table gives no rows;
ties in distance go to the smaller centroid.  A component beyond 2^27 after
scaling raises an error, as its squares need not fit a long.  Other columns of
the table are not read.  Vectors have a fixed length, so none is very long.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from binscore.session import scratch_dir

BLOCK = 4096
LIMIT = 1 << 27
#: Bounds are kept as 32-bit floats; this factor is wider than their rounding.
SLACK = 1e-6
#: One row is a block of vectors: ids, components, cluster, upper bound and its
#: round, lower bounds and their rounds, exact squared distance to the cluster;
#: ``sums``: the block's vectors, components and squared distances by cluster.
SCHEMA = ("ids array<bigint>, vectors binary, cluster binary, upper binary, upper_round binary, lower binary, "
          "lower_round binary, distance binary, computed bigint, "
          "sums array<struct<cluster: int, n: bigint, distance: bigint, total: array<bigint>>>")


def whole_vectors(df: DataFrame, id_col: str, vector_col: str, dims: int, scale: int) -> DataFrame:
    """``_id, _v``: vectors of ``dims`` finite components, each as the integer
    ``floor(scale * x)``, x as double."""
    x = F.col(vector_col)
    fits = (F.size(x) == dims) & F.forall(x, lambda e: F.coalesce(F.abs(e.cast("double")) < F.lit(float("inf")), F.lit(False)))
    return (df.where(F.coalesce(fits, F.lit(False)))
            .select(F.col(id_col).cast("long").alias("_id"),
                    F.transform(x, lambda e: F.floor(e.cast("double") * scale)).alias("_v")))


def first_centroids(vectors: DataFrame, k: int, salt: str) -> np.ndarray:
    """The ``k`` vectors with the smallest sha256 of ``salt`` and id, a top-k
    of the table: at most ``k`` rows reach the driver."""
    key = F.sha2(F.concat(F.lit(salt), F.coalesce(F.col("_id").cast("string"), F.lit(""))), 256)
    rows = vectors.select(key.alias("_h"), "_v").orderBy("_h", "_v").limit(k).collect()
    return np.array([r["_v"] for r in rows], np.int64)


# --- inside tasks -------------------------------------------------------------

def exact_distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of ``x`` to all rows of ``c`` as int64.

    While every partial sum is below 2^53 the product runs in doubles, which
    then hold integers exactly; otherwise in 64-bit integers."""
    top = max(int(np.abs(x).max(initial=0)), int(np.abs(c).max(initial=0)), 1)
    if 4 * x.shape[1] * top * top < 1 << 53:
        a, b = x.astype(np.float64), c.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    out = np.empty((len(x), len(c)), np.int64)
    for j, row in enumerate(c):
        d = x - row
        out[:, j] = (d * d).sum(1)
    return out


def own_distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    d = x - c
    return (d * d).sum(1)


def below(d2: np.ndarray) -> np.ndarray:
    """Lower bounds of the distances: the root, rounded down."""
    return (np.sqrt(d2.astype(np.float64)) * (1 - SLACK)).astype(np.float32)


def above(d2: np.ndarray) -> np.ndarray:
    return (np.sqrt(d2.astype(np.float64)) * (1 + SLACK)).astype(np.float32)


def displacements(history: np.ndarray) -> np.ndarray:
    """``out[T, j]``: norm of centroid j's displacement from round T to the
    last one of ``history`` (rounds x k x dims), rounded up."""
    d = (history[-1] - history).astype(np.float64)
    return np.sqrt((d * d).sum(2)) * (1 + SLACK)


class Block:
    """A block's vectors with their bounds."""

    def __init__(self, ids: pa.Array, x: np.ndarray):
        if len(x) and np.abs(x).max() > LIMIT:
            raise ValueError("a component is beyond 2^27 after scaling; its squares need not fit a long")
        self.ids, self.x = ids, x

    @classmethod
    def read(cls, row: dict, dims: int, k: int) -> Block:
        self = cls.__new__(cls)
        self.ids = row["ids"].values
        n = len(self.ids)
        get = lambda name, kind, *shape: np.frombuffer(row[name].as_py(), kind).reshape(n, *shape).copy()
        self.x = get("vectors", np.int32, dims).astype(np.int64)
        self.cluster, self.distance = get("cluster", np.int32), get("distance", np.int64)
        self.upper, self.upper_round = get("upper", np.float32), get("upper_round", np.uint16)
        self.lower, self.lower_round = get("lower", np.float32, k), get("lower_round", np.uint16, k)
        return self

    def start(self, c: np.ndarray) -> None:
        """Round 0: every distance is computed."""
        d2 = exact_distances(self.x, c)
        n, k = d2.shape
        self.cluster = d2.argmin(1).astype(np.int32)
        self.distance = d2[np.arange(n), self.cluster]
        self.lower, self.lower_round = below(d2), np.zeros((n, k), np.uint16)
        self.upper, self.upper_round = above(self.distance), np.zeros(n, np.uint16)
        self.computed = n * k

    def update(self, history: np.ndarray, moved: np.ndarray, last: bool) -> None:
        """Round t = len(history) - 1.  A vector whose loosened upper bound is
        below all its loosened lower bounds keeps its cluster; for the others
        the own distance is computed, then that of each centroid whose bound
        does not exclude it.  In the last round all own distances are."""
        t, c = len(history) - 1, history[-1]
        n, k = self.lower.shape
        rows, cols = np.arange(n), np.arange(k)
        upper = self.upper + moved[self.upper_round, self.cluster]
        lower = self.lower - moved[self.lower_round, cols]
        lower[rows, self.cluster] = np.inf
        failed = np.flatnonzero(upper >= lower.min(1)) if k > 1 else np.zeros(0, np.int64)
        own = rows if last else failed
        self.distance[own] = own_distances(self.x[own], c[self.cluster[own]])
        self.upper[own], self.upper_round[own] = above(self.distance[own]), t
        # the old own distance is a bound of that centroid from now on
        self.lower[own, self.cluster[own]] = below(self.distance[own])
        self.lower_round[own, self.cluster[own]] = t
        self.computed = len(own)
        best, best_c = self.distance[failed].copy(), self.cluster[failed].copy()
        open_pairs = lower[failed] <= self.upper[failed][:, None]
        for j in np.flatnonzero(open_pairs.any(0)):
            at = np.flatnonzero(open_pairs[:, j])
            who = failed[at]
            d2 = own_distances(self.x[who], c[j])
            self.computed += len(who)
            self.lower[who, j], self.lower_round[who, j] = below(d2), t
            nearer = (d2 < best[at]) | (d2 == best[at]) & (j < best_c[at])
            best[at[nearer]], best_c[at[nearer]] = d2[nearer], j
        self.distance[failed], self.cluster[failed] = best, best_c
        self.upper[failed] = above(best)

    def row(self) -> pa.RecordBatch:
        k, dims = self.lower.shape[1], self.x.shape[1]
        n = np.bincount(self.cluster, minlength=k)
        total = np.zeros((k, dims), np.int64)
        np.add.at(total, self.cluster, self.x)
        inertia = np.zeros(k, np.int64)
        np.add.at(inertia, self.cluster, self.distance)
        sums = [{"cluster": j, "n": int(n[j]), "distance": int(inertia[j]), "total": total[j].tolist()} for j in np.flatnonzero(n)]
        data = lambda a: pa.array([np.ascontiguousarray(a).tobytes()], pa.binary())
        return pa.RecordBatch.from_arrays(
            [pa.ListArray.from_arrays(pa.array([0, len(self.ids)], pa.int32()), self.ids), data(self.x.astype(np.int32)),
             data(self.cluster), data(self.upper), data(self.upper_round), data(self.lower), data(self.lower_round),
             data(self.distance), pa.array([self.computed], pa.int64()),
             pa.array([sums], pa.list_(pa.struct([("cluster", pa.int32()), ("n", pa.int64()), ("distance", pa.int64()),
                                                  ("total", pa.list_(pa.int64()))])))],
            names=["ids", "vectors", "cluster", "upper", "upper_round", "lower", "lower_round", "distance", "computed", "sums"])


def _first_round(c: np.ndarray):
    """mapInArrow over ``_id, _v``: blocks with all distances computed."""
    def run(batches):
        held, size = [], 0
        for batch in batches:
            at = 0
            while at < len(batch):
                part = batch.slice(at, BLOCK - size)
                at += len(part)
                size += len(part)
                held.append(part)
                if size == BLOCK:
                    yield finish(held)
                    held, size = [], 0
        if size:
            yield finish(held)

    def finish(held):
        ids = pa.concat_arrays([b.column("_id") for b in held])
        flat = np.concatenate([b.column("_v").flatten().to_numpy(zero_copy_only=False) for b in held])
        block = Block(ids, flat.reshape(len(ids), c.shape[1]))
        block.start(c)
        return block.row()
    return run


def _next_round(history: np.ndarray, last: bool):
    """mapInArrow over blocks."""
    moved = displacements(history)

    def run(batches):
        for batch in batches:
            for i in range(len(batch)):
                block = Block.read({name: batch.column(name)[i] for name in batch.schema.names}, history.shape[2], history.shape[1])
                block.update(history, moved, last)
                yield block.row()
    return run


def _rows(batches):
    """mapInArrow over blocks: a row per vector."""
    for batch in batches:
        for i in range(len(batch)):
            yield pa.RecordBatch.from_arrays(
                [batch.column("ids")[i].values, pa.array(np.frombuffer(batch.column("cluster")[i].as_py(), np.int32)),
                 pa.array(np.frombuffer(batch.column("distance")[i].as_py(), np.int64))], names=["_id", "cluster", "distance"])


# --- rounds -------------------------------------------------------------------

def _sums(blocks: DataFrame, dims: int) -> list:
    """A row per non-empty cluster: number of vectors, inertia, component sums."""
    part = blocks.select(F.explode("sums").alias("s")).select("s.*")
    total = F.array(*[F.sum(F.get("total", F.lit(i))) for i in range(dims)])
    return part.groupBy("cluster").agg(F.sum("n").alias("n"), F.sum("distance").alias("distance"), total.alias("total")).collect()


def _remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def ns_cluster(df: DataFrame, k: int, rounds: int, id_col: str = "vec_id", vector_col: str = "embedding", dims: int = 64,
               scale: int = 256, salt: str = "2:") -> tuple[DataFrame, list[dict], list[int]]:
    """Clusters after ``rounds`` rounds (at most 65,000) and one more assignment.

    Returns the rows ``<id_col>, cluster, distance`` (squared), a record per
    centroid (``cluster, n, inertia, centroid``) and the number of exact
    distances of each round."""
    spark = df.sparkSession
    vectors = whole_vectors(df, id_col, vector_col, dims, scale)
    c = first_centroids(vectors, k, salt)
    named = lambda rows: rows.select(F.col("_id").alias(id_col), "cluster", "distance")
    if not len(c):
        return named(spark.createDataFrame([], "_id long, cluster int, distance long")), [], []
    history, folder, computed = c[None], None, []
    for t in range(rounds + 1):
        made = (vectors.mapInArrow(_first_round(c), SCHEMA) if t == 0
                else spark.read.schema(SCHEMA).parquet(folder).mapInArrow(_next_round(history, t == rounds), SCHEMA))
        before, folder = folder, scratch_dir(spark, f"llm-centroids-{t}")
        made.write.parquet(folder)
        if before:
            _remove(spark, before)
        blocks = spark.read.schema(SCHEMA).parquet(folder)
        found = _sums(blocks, dims)
        computed.append(blocks.agg(F.sum("computed")).first()[0])
        if t < rounds:
            c = c.copy()
            for r in found:
                c[r["cluster"]] = [s // r["n"] for s in r["total"]]  # floor, also below zero
            history = np.concatenate([history, c[None]])
    by = {r["cluster"]: r for r in found}
    facts = [{"cluster": j, "n": by[j]["n"] if j in by else 0, "inertia": by[j]["distance"] if j in by else 0,
              "centroid": row.tolist()} for j, row in enumerate(c)]
    rows = blocks.select("ids", "cluster", "distance").mapInArrow(_rows, "_id long, cluster int, distance long")
    return named(rows), facts, computed


def with_inertia(rows: DataFrame, facts: list[dict]) -> DataFrame:
    """``rows`` with the inertia of their cluster and of all, and the digest of
    the cluster's centroid.  ``facts`` has a record per centroid."""
    import hashlib
    spark = rows.sparkSession
    total = sum(f["inertia"] for f in facts)
    side = spark.createDataFrame(
        [(f["cluster"], f["inertia"], total, hashlib.sha256(",".join(map(str, f["centroid"])).encode()).hexdigest()) for f in facts],
        "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(side), "cluster").select(rows.columns[0], "cluster", "distance", "cluster_inertia", "inertia",
                                                          "centroid_sha256")


@functools.cache
def sql(k: int = 40, rounds: int = 5) -> str:
    """The same clustering in DuckDB SQL, one table expression a round."""
    steps = ["""v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x
  FROM embeddings
  WHERE len(embedding) = 64 AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('2:' || coalesce(vec_id::VARCHAR, '')), x) - 1 AS c, x FROM v
  ORDER BY c LIMIT %d)""" % k]
    for t in range(rounds + 1):
        steps.append(f"""a{t} AS MATERIALIZED (
  SELECT r, arg_min(c, (d, c)) AS c, min(d) AS d
  FROM (SELECT v.r, k.c, (list_inner_product(v.x, v.x) - 2 * list_inner_product(v.x, k.x)
                          + list_inner_product(k.x, k.x))::BIGINT AS d
        FROM v, c{t} AS k) GROUP BY r)""")
        if t < rounds:
            steps.append(f"""s{t} AS MATERIALIZED (
  SELECT c, i, (s - ((s % n) + n) % n) // n AS x
  FROM (SELECT c, i, sum(x::BIGINT) AS s, count(*) AS n
        FROM (SELECT a.c, unnest(v.x) AS x, unnest(range(64)) AS i FROM a{t} AS a JOIN v USING (r)) GROUP BY c, i)),
c{t + 1} AS MATERIALIZED (
  SELECT c0.c, coalesce(m.x, c0.x) AS x
  FROM c{t} AS c0 LEFT JOIN (SELECT c, list(x::DOUBLE ORDER BY i) AS x FROM s{t} GROUP BY c) AS m ON c0.c = m.c)""")
    return "WITH " + ",\n".join(steps) + f"""
SELECT v.vec_id, a.c::INTEGER AS cluster, a.d AS distance,
       (sum(a.d) OVER (PARTITION BY a.c))::BIGINT AS cluster_inertia, (sum(a.d) OVER ())::BIGINT AS inertia,
       sha256(list_reduce(list_transform(k.x, lambda x: x::BIGINT::VARCHAR), lambda p, q: p || ',' || q)) AS centroid_sha256
FROM a{rounds} AS a JOIN v USING (r) JOIN c{rounds} AS k ON k.c = a.c"""
