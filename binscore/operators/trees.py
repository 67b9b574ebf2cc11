"""Decision trees and random forests (I4, I7) for all groups and arms at once.
The trees of a group of at most ``WHOLE`` rows grow to their end in a task, a
slab of trees each; larger groups grow level by level: one aggregation of
histograms a level, whatever the number of groups, arms and trees.

* Features are cut at up to ``BINS`` quantiles of their group's train rows; a
  group of at most ``BINS`` rows has every value as a bin, and its trees are
  those of an exact search over all thresholds.
* Train rows are packed once into blocks of one group (bins, label, key) and
  written to the shared folder.  A tree copies no rows: which rows it draws (a
  Poisson number of times each) and which features a node looks at are hashes of
  the row's key, the tree and the node's way from the root, so reruns and other
  partitionings give the same trees.
* A level joins the blocks with the unfinished trees, routes each drawn row to
  its open node and counts (node, feature, bin) by class inside the block; the
  counts are summed by Spark, split points compared in windows of at most
  ``BINS`` rows, and the best split of every node goes back to its trees.
* Trees travel in slabs: up to ``SLAB`` trees of a small group, fewer the more
  rows the group has.  A tree's nodes (40 bytes each, at most two for every row
  it drew) are held by one task; that is the only thing that one task holds whole.

The result is a relation, one row per node, and scoring routes rows through it.

Where a node's sampled features are all constant the next ones in its hash
order are drawn, until one splits or none is left.  Equal gains: the first
feature, then the smallest cut.  A tree that drew no row does not vote.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from binscore.operators.blocks import WHOLE, blocks_of, broadcast_within, feature_array, group_columns, group_key, spread
from binscore.operators.draws import poisson_limits, row_number_of, scramble
from binscore.session import cut_lineage, scratch_dir

BINS = 256
SLAB = 64
#: A slab has at most about this many drawn rows.
SLAB_ROWS = 1 << 20
OPEN, LEAF = -2, -1
NODE = np.dtype([("tree", "<i4"), ("feature", "<i4"), ("cut", "<i2"), ("next", "<i2"), ("left", "<i4"), ("depth", "<i2"),
                 ("draws", "<i2"), ("key", "<i4"), ("n0", "<i8"), ("n1", "<i8")])


@dataclass(frozen=True)
class Forest:
    """Parameters.  ``rate``: mean number of times a tree draws a row, None for
    all rows once; ``features``: share of the features a node looks at."""
    trees: int
    rate: float | None
    features: float
    max_depth: int = 30


DECISION_TREE = Forest(1, None, 0.3, 6)
RANDOM_FOREST = Forest(500, 0.2, 0.2)


def _bins(d: int):
    """mapInArrow over blocks joined with their group's edges: ``x`` becomes the
    bin of every value."""
    def run(batches):
        for batch in batches:
            out = []
            for raw, edges in zip(batch.column("x").to_pylist(), batch.column("edges").to_pylist()):
                x = np.frombuffer(raw, np.float64).reshape(-1, d)
                out.append(np.column_stack([np.minimum(np.searchsorted(edges[f], x[:, f]), len(edges[f]) - 1)
                                            for f in range(d)]).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("gk"), pa.array(out, pa.binary()), batch.column("label"),
                                              batch.column("key")], names=["gk", "bins", "label", "key"])
    return run


# --- growing ------------------------------------------------------------------

def _roots(slab: int, n: int) -> bytes:
    nodes = np.zeros(n, NODE)
    nodes["tree"] = slab + np.arange(n)
    nodes["feature"] = OPEN
    nodes["key"] = scramble(nodes["tree"].astype(np.int64), 7)
    return nodes.tobytes()


def sampled(keys: np.ndarray, draws: np.ndarray, used: np.ndarray, share: float) -> np.ndarray:
    """Features that nodes look at in their current draw (a row per node, -1
    where there are fewer): a stretch of the used features in hash order."""
    m = max(1, int(share * len(used)))
    order = used[np.argsort(scramble(keys.astype(np.int64)[:, None], used[None, :].astype(np.int64)), axis=1, kind="stable")]
    padded = np.pad(order, ((0, 0), (0, m)), constant_values=-1)
    return padded[np.arange(len(keys))[:, None], draws.astype(np.int64)[:, None] * m + np.arange(m)]


def _draws(nodes: np.ndarray, key: np.ndarray, limits) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows that the slab's trees draw: place, root and how often."""
    trees = int((nodes["depth"] == 0).sum())  # the roots come first
    if limits is None:
        r, at = np.repeat(np.arange(len(key)), trees), np.tile(np.arange(trees), len(key))
        return r, at, np.ones(len(r), np.int64)
    h = scramble(key[:, None], nodes["tree"][None, :trees].astype(np.int64))
    drawn = np.searchsorted(limits, h, side="right")
    r, at = np.nonzero(drawn)
    return r, at, drawn[r, at]


def _counted(r, at, times, nodes, used, bins, label, slab: int, share: float):
    """Counts by class of (node, feature, bin) of drawn rows at open nodes, and
    the counts at the tree's root (-1: not known yet); None without any."""
    d = bins.shape[1]
    which, place = np.unique(at, return_inverse=True)
    if not len(which) or not len(used):
        return None
    looks = sampled(nodes["key"][which], nodes["draws"][which], used, share)
    codes, rows = [], []
    for c in range(looks.shape[1]):
        f = looks[place, c]
        ok = np.flatnonzero(f >= 0)
        codes.append((place[ok] * d + f[ok]) * BINS + bins[r[ok], f[ok]])
        rows.append(ok)
    codes, rows = np.concatenate(codes), np.concatenate(rows)
    code, back = np.unique(codes, return_inverse=True)
    n1 = np.bincount(back, weights=times[rows] * label[r[rows]], minlength=len(code)).astype(np.int64)
    n0 = np.bincount(back, weights=times[rows], minlength=len(code)).astype(np.int64) - n1
    node = which[code // (d * BINS)]
    root = nodes["tree"][node] - slab
    known = nodes["feature"][root] != OPEN
    return (node.astype(np.int32), (code // BINS % d).astype(np.int32), (code % BINS).astype(np.int32), n0, n1,
            np.where(known, nodes["n0"][root], -1), np.where(known, nodes["n1"][root], -1))


def _histograms(d: int, forest: Forest):
    """mapInArrow over blocks joined with slabs: ``_counted`` of every block."""
    limits = poisson_limits(forest.rate) if forest.rate is not None else None

    def one(row):
        nodes, used = np.frombuffer(row["nodes"], NODE), np.array(row["used"], np.int64)
        bins = np.frombuffer(row["bins"], np.uint8).reshape(-1, d)
        label, key = np.frombuffer(row["label"], np.int64), np.frombuffer(row["key"], np.int64)
        r, at, times = _draws(nodes, key, limits)
        feature, cut, left = nodes["feature"], nodes["cut"], nodes["left"]
        while True:
            inner = np.flatnonzero(feature[at] >= 0)
            if not len(inner):
                break
            node = at[inner]
            at[inner] = left[node] + (bins[r[inner], feature[node]] > cut[node])
        live = feature[at] == OPEN
        return _counted(r[live], at[live], times[live], nodes, used, bins, label, row["slab"], forest.features)

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                found = one(row)
                if found is None:
                    continue
                n = len(found[0])
                same = [pa.array([row["gk"]] * n, pa.string()), pa.array([row["arm"]] * n, pa.int32()),
                        pa.array([row["slab"]] * n, pa.int32())]
                yield pa.RecordBatch.from_arrays([*same, *map(pa.array, found)],
                                                 names=["gk", "arm", "slab", "node", "feature", "bin", "n0", "n1", "r0", "r1"])
    return run


HISTOGRAM = ("gk string, arm int, slab int, node int, feature int, bin int, n0 bigint, n1 bigint, r0 bigint, r1 bigint")


def _entropy(a: F.Column, b: F.Column) -> F.Column:
    p, q = a / (a + b), b / (a + b)
    return F.when((a <= 0) | (b <= 0), F.lit(0.0)).otherwise(-(p * F.log2(p) + q * F.log2(q)))


def best_splits(counts: DataFrame) -> DataFrame:
    """Per slab the list of its open nodes with their counts and best split (null
    if no sampled feature separates rows).  Classes weigh N / (2 N_class) of the
    tree's drawn rows; the split with the least weighted entropy is best."""
    node = ["gk", "arm", "slab", "node"]
    # one exchange serves the sums, the windows and the choice: what a block sends is summed already
    summed = counts.repartition(*node).groupBy(*node, "feature", "bin").agg(*[F.sum(c).alias(c) for c in ("n0", "n1")],
                                                         *[F.max(c).alias(c) for c in ("r0", "r1")])
    whole = Window.partitionBy(*node, "feature")
    upto = whole.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cut = summed.select(*node, "feature", "bin", F.lead("bin").over(whole.orderBy("bin")).alias("next"),
                        *[F.sum(f"n{c}").over(upto).alias(f"l{c}") for c in (0, 1)],
                        *[F.sum(f"n{c}").over(whole).alias(f"t{c}") for c in (0, 1)], "r0", "r1")
    r0, r1 = (F.when(F.col("r0") < 0, F.col(f"t{c}")).otherwise(F.col(f"r{c}")).cast("double") for c in (0, 1))
    # counts with class weights, times 2 / N
    l0, l1 = F.try_divide(F.col("l0"), r0), F.try_divide(F.col("l1"), r1)
    g0, g1 = F.try_divide(F.col("t0") - F.col("l0"), r0), F.try_divide(F.col("t1") - F.col("l1"), r1)
    mixed = ((l0 + l1) * _entropy(l0, l1) + (g0 + g1) * _entropy(g0, g1)) / (l0 + l1 + g0 + g1)
    rank = F.when(F.col("next").isNotNull() & mixed.isNotNull(), F.struct(-F.round(mixed, 12), -F.col("feature"), -F.col("bin")))
    best = cut.groupBy(*node).agg(F.max("t0").alias("t0"), F.max("t1").alias("t1"),
                                  F.max_by(F.struct("feature", F.col("bin").alias("cut"), "next", "l0", "l1"), rank).alias("split"))
    return best.groupBy("gk", "arm", "slab").agg(F.collect_list(F.struct("node", "t0", "t1", "split")).alias("found"))


def _splits(node, feature, bin_, n0, n1, r0, r1):
    """``best_splits`` of the whole counts of one slab, sorted by node, feature
    and bin: nodes with their counts, whether they split, and the split."""
    n = len(node)
    last = np.append((node[1:] != node[:-1]) | (feature[1:] != feature[:-1]), True)
    end = np.flatnonzero(last)
    size = np.diff(np.concatenate([[-1], end]))
    sums = [np.cumsum(c) for c in (n0, n1)]
    base = [np.repeat(np.concatenate([[0], c[end[:-1]]]), size) for c in sums]
    left = [c - o for c, o in zip(sums, base)]
    total = [np.repeat(c[end], size) - o for c, o in zip(sums, base)]
    root = [np.where(r < 0, t, r).astype(float) for r, t in zip((r0, r1), total)]
    at = np.flatnonzero(~last & (root[0] > 0) & (root[1] > 0))
    l0, l1 = (c[at] / r[at] for c, r in zip(left, root))
    g0, g1 = ((t[at] - c[at]) / r[at] for t, c, r in zip(total, left, root))

    def entropy(a, b):
        p, q = a / (a + b), b / (a + b)
        return np.where((a <= 0) | (b <= 0), 0.0, -(p * (np.log(p) / np.log(2)) + q * (np.log(q) / np.log(2))))

    with np.errstate(divide="ignore", invalid="ignore"):
        mixed = np.round(((l0 + l1) * entropy(l0, l1) + (g0 + g1) * entropy(g0, g1)) / (l0 + l1 + g0 + g1), 12)
    # by node, then the least entropy, feature and bin: counts are sorted by feature and bin already
    order = at[np.lexsort((mixed, node[at]))]
    best = order[np.append(True, node[order[1:]] != node[order[:-1]])] if len(order) else order
    first = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
    chosen = np.full(len(first), -1)
    chosen[np.searchsorted(node[first], node[best])] = best
    valid = chosen >= 0
    take = lambda c: np.where(valid, c[chosen], 0).astype(np.int64)
    return (node[first], total[0][first], total[1][first], valid, take(feature), take(bin_), take(np.append(bin_[1:], 0)),
            take(left[0]), take(left[1]))


def _advance(nodes: np.ndarray, n_used: int, forest: Forest, found) -> np.ndarray:
    """A slab's nodes (changed) with its open nodes' splits ``found``, or None."""
    open_ = np.flatnonzero(nodes["feature"] == OPEN)
    seen = np.zeros(len(nodes), bool)
    new = []
    if found is not None:
        node, t0, t1, valid, feature, cut, next_, l0, l1 = found
        seen[node] = True
        nodes["n0"][node], nodes["n1"][node] = t0, t1
        mixed = (t0 > 0) & (t1 > 0) & (nodes["depth"][node] < forest.max_depth)
        nodes["feature"][node[~mixed]] = LEAF
        # nothing separates: the next features in order, a leaf after the last
        dry = node[mixed & ~valid]
        nodes["draws"][dry] += 1
        m = max(1, int(forest.features * n_used))
        nodes["feature"][dry[nodes["draws"][dry].astype(np.int64) * m >= n_used]] = LEAF
        do = mixed & valid
        at = node[do]
        nodes["feature"][at], nodes["cut"][at], nodes["next"][at] = feature[do], cut[do], next_[do]
        nodes["left"][at] = len(nodes) + 2 * np.arange(len(at))
        children = np.zeros(2 * len(at), NODE)
        for side in (0, 1):
            child = children[side::2]
            child["tree"], child["depth"] = nodes["tree"][at], nodes["depth"][at] + 1
            child["key"] = scramble(nodes["key"][at].astype(np.int64), 1 + side)
            child["n0"] = l0[do] if side == 0 else (t0 - l0)[do]
            child["n1"] = l1[do] if side == 0 else (t1 - l1)[do]
        children["feature"] = np.where((children["n0"] > 0) & (children["n1"] > 0)
                                       & (children["depth"] < forest.max_depth), OPEN, LEAF)
        new = [children]
    # an open node without rows is a tree that drew none
    nodes["feature"][open_[~seen[open_]]] = LEAF
    return np.concatenate([nodes, *new])


def _grow(forest: Forest):
    """Puts a level's splits into the nodes of a slab."""
    @F.arrow_udf("struct<nodes: binary, open: boolean>")
    def grow(blobs: pa.Array, used: pa.Array, found: pa.Array) -> pa.Array:
        out = []
        for blob, features, list_ in zip(blobs.to_pylist(), used.to_pylist(), found):
            splits = None
            if list_.is_valid and len(list_.values):
                rows = list_.values
                col = lambda a, i: a.field(i).to_numpy(zero_copy_only=False)
                order = np.argsort(col(rows, 0), kind="stable")
                split = rows.field(3).take(pa.array(order))
                splits = (*(col(rows, i)[order].astype(np.int64) for i in range(3)), np.asarray(split.is_valid()),
                          *(split.field(i).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(5)))
            nodes = _advance(np.frombuffer(blob, NODE).copy(), len(features), forest, splits)
            out.append({"nodes": nodes.tobytes(), "open": bool((nodes["feature"] == OPEN).any())})
        return pa.array(out, pa.struct([("nodes", pa.binary()), ("open", pa.bool_())]))
    return grow


def _grow_whole(d: int, forest: Forest):
    """applyInArrow over the blocks of a slab's whole group: its finished nodes.
    Rows wait at their node and go down one level at a time."""
    limits = poisson_limits(forest.rate) if forest.rate is not None else None

    def run(key, table):
        slab, used = key[2].as_py(), np.array(table["used"][0].as_py(), np.int64)
        nodes = np.frombuffer(table["nodes"][0].as_py(), NODE).copy()
        blocks = [[np.frombuffer(v.as_buffer(), kind) for v in table[c]] for c, kind in (("bins", np.uint8), ("label", np.int64), ("key", np.int64))]
        drawn = [_draws(nodes, k, limits) for k in blocks[2]]
        ahead = np.cumsum([0, *map(len, blocks[2])])
        r = np.concatenate([part[0] + n for part, n in zip(drawn, ahead)])
        at, times = (np.concatenate([part[i] for part in drawn]) for i in (1, 2))
        bins, label = np.concatenate(blocks[0]).reshape(-1, d), np.concatenate(blocks[1])
        while (nodes["feature"] == OPEN).any():
            found = _counted(r, at, times, nodes, used, bins, label, slab, forest.features)
            nodes = _advance(nodes, len(used), forest, None if found is None else _splits(*found))
            inner = np.flatnonzero(nodes["feature"][at] >= 0)
            node = at[inner]
            at[inner] = nodes["left"][node] + (bins[r[inner], nodes["feature"][node]] > nodes["cut"][node])
            live = nodes["feature"][at] == OPEN
            r, at, times = r[live], at[live], times[live]
        return pa.Table.from_pydict({"gk": [key[0].as_py()], "arm": pa.array([key[1].as_py()], pa.int32()), "slab": pa.array([slab], pa.int32()),
                                     "used": pa.array([used.tolist()], pa.list_(pa.int32())), "nodes": pa.array([nodes.tobytes()], pa.binary())})
    return run


def fit_forest(train: DataFrame, flags: DataFrame, group, feature_cols, forest: Forest, key_cols, whole: int = WHOLE) -> DataFrame:
    """Nodes of all trees of every row of ``flags`` (``used_flags``) whose group
    has train rows, in slabs for ``score_forest`` and ``forest_nodes``.
    ``train``: features, ``label`` and ``key_cols``, which identify a row.
    ``whole``: rows of a group at most whose trees grow in one task."""
    g, feats = list(group), list(feature_cols)
    d = len(feats)
    rows = cut_lineage(train.select(group_key(g).alias("gk"), feature_array(feats).alias("x"), F.col("label").cast("long").alias("label"),
                                    row_number_of(*key_cols).alias("key")))
    cuts = F.array(*[F.lit(i / BINS) for i in range(1, BINS + 1)])
    edges = cut_lineage(rows.groupBy("gk").agg(
        F.count(F.lit(1)).alias("n"),
        F.array(*[F.percentile_approx(F.col("x")[i], cuts, F.lit(10000)) for i in range(d)]).alias("edges"))
        .withColumn("edges", F.transform("edges", lambda e: F.array_distinct(e))))
    edge_bytes = F.lit(64) + 8 * F.aggregate("edges", F.lit(0), lambda a, e: a + F.size(e))
    blocks = blocks_of(rows, "tree-rows").join(broadcast_within(edges, edge_bytes), "gk").mapInArrow(
        _bins(d), "gk string, bins binary, label binary, key binary")
    path = scratch_dir(train.sparkSession, "tree-bins")
    blocks.write.parquet(path)
    blocks = train.sparkSession.read.parquet(path)

    drawn = F.col("n") * (1.0 if forest.rate is None else forest.rate)
    width = F.greatest(F.lit(1), F.least(F.lit(min(SLAB, forest.trees)), F.floor(F.lit(SLAB_ROWS) / F.greatest(drawn, F.lit(1.0))))).cast("int")
    used = F.filter(F.array(*[F.when(F.col(f"u_{f}") == 1, F.lit(i)) for i, f in enumerate(feats)]), lambda i: i.isNotNull())

    @F.arrow_udf("binary")
    def roots(slab: pa.Array, n: pa.Array) -> pa.Array:
        return pa.array([_roots(s, k) for s, k in zip(slab.to_pylist(), n.to_pylist())], pa.binary())

    models = (flags.select(group_key(g).alias("gk"), F.col("arm").cast("int").alias("arm"), used.alias("used"))
              .join(edges.select("gk", width.alias("width"), (F.col("n") <= whole).alias("whole")), "gk")
              .withColumn("slab", F.explode(F.sequence(F.lit(0), F.lit(forest.trees - 1), F.col("width"))))
              .select("gk", "arm", "slab", "used", "whole",
                      roots("slab", F.least(F.col("width"), F.lit(forest.trees) - F.col("slab"))).alias("nodes"), F.lit(True).alias("open")))
    models = cut_lineage(models)
    grow, slab = _grow(forest), ["gk", "arm", "slab"]
    small = models.where("whole").drop("whole", "open")
    gathered = spread(blocks.join(broadcast_within(small, F.octet_length("nodes") + 64), "gk"), small, slab)
    done = [cut_lineage(gathered.groupBy(*slab).applyInArrow(_grow_whole(d, forest), small.schema).withColumn("open", F.lit(False)))]
    models = models.where("NOT whole").drop("whole")
    while not models.isEmpty():
        live = models.drop("open")
        sent = broadcast_within(live, F.octet_length("nodes") + 64)
        counts = blocks.join(sent, "gk").mapInArrow(_histograms(d, forest), HISTOGRAM)
        grown = (live.join(best_splits(counts), slab, "left")
                 .select(*slab, "used", grow("nodes", "used", "found").alias("s")).select(*slab, "used", "s.nodes", "s.open"))
        grown = cut_lineage(grown)
        done.append(grown.where("NOT open"))
        models = grown.where("open")
    models = reduce(DataFrame.unionByName, done, models)
    return _finished(models.drop("open").join(broadcast_within(edges, edge_bytes), "gk"), d)


def _finished(models: DataFrame, d: int) -> DataFrame:
    """Slabs with thresholds and leaf scores: parallel lists, a place per node.

    In a group of at most ``BINS`` rows a threshold lies midway between the two
    values it separates; in others it is the upper edge of the lower bin."""
    schema = ("gk string, arm int, slab int, tree array<int>, feature array<int>, threshold array<double>, left array<int>, "
              "depth array<int>, n0 array<bigint>, n1 array<bigint>, score array<double>")

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                nodes = np.frombuffer(row["nodes"], NODE)
                threshold = np.full(len(nodes), np.nan)
                for f in range(d):
                    at = np.flatnonzero(nodes["feature"] == f)
                    e = np.array(row["edges"][f])
                    low, high = e[nodes["cut"][at]], e[nodes["next"][at]]
                    threshold[at] = (low + high) / 2 if row["n"] <= BINS else low
                root = nodes["tree"] - row["slab"]
                with np.errstate(divide="ignore", invalid="ignore"):
                    w0 = np.where(nodes["n0"] > 0, nodes["n0"] / nodes["n0"][root], 0.0)
                    w1 = np.where(nodes["n1"] > 0, nodes["n1"] / nodes["n1"][root], 0.0)
                    score = w1 / (w0 + w1)
                lists = [nodes["tree"], nodes["feature"], threshold, nodes["left"], nodes["depth"].astype(np.int32), nodes["n0"],
                         nodes["n1"], score]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["gk"]], pa.string()), pa.array([row["arm"]], pa.int32()), pa.array([row["slab"]], pa.int32()),
                     *[pa.ListArray.from_arrays(pa.array([0, len(nodes)], pa.int32()), pa.array(np.ascontiguousarray(v))) for v in lists]],
                    names=["gk", "arm", "slab", "tree", "feature", "threshold", "left", "depth", "n0", "n1", "score"])
    return cut_lineage(models.mapInArrow(run, schema))


def forest_nodes(models: DataFrame, group, feature_cols, like: DataFrame) -> DataFrame:
    """The trees as a relation: ``group..., arm, tree, node, depth, feature,
    threshold, left, right, n0, n1, score``; leaves have no feature.  ``n0``,
    ``n1`` count drawn rows, ``score`` is the class-weighted share of class 1.
    Node numbers are unique in their group, arm and slab of trees."""
    lists = ("tree", "feature", "threshold", "left", "depth", "n0", "n1", "score")
    flat = models.select("gk", "arm", F.posexplode(F.arrays_zip(*lists)).alias("node", "v")).select("gk", "arm", "node", "v.*")
    inner = F.col("feature") >= 0
    return group_columns(flat, group, like).select(
        *group, "arm", "tree", "node", "depth",
        F.when(inner, F.array(*[F.lit(f) for f in feature_cols])[F.greatest("feature", F.lit(0))]).alias("feature"),
        F.when(inner, F.col("threshold")).alias("threshold"), F.when(inner, F.col("left")).alias("left"),
        F.when(inner, F.col("left") + 1).alias("right"), "n0", "n1", F.nanvl("score", F.lit(None).cast("double")).alias("score"))


def _route(d: int):
    """mapInArrow over test blocks joined with slabs: per row the sum of its
    leaves' scores and the number of voting trees."""
    def run(batches):
        for batch in batches:
            for i in range(len(batch)):
                row = {c: batch.column(c)[i] for c in batch.schema.names}
                col = {c: row[c].values.to_numpy(zero_copy_only=False) for c in ("tree", "feature", "threshold", "left", "depth", "score")}
                x = np.frombuffer(row["x"].as_py(), np.float64).reshape(-1, d)
                trees = int((col["depth"] == 0).sum())
                at = np.tile(np.arange(trees), (len(x), 1))
                while True:
                    r, t = np.nonzero(col["feature"][at] >= 0)
                    if not len(r):
                        break
                    node = at[r, t]
                    at[r, t] = col["left"][node] + (x[r, col["feature"][node]] > col["threshold"][node])
                votes = col["score"][at]
                n = len(x)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["gk"].as_py()] * n, pa.string()), pa.array([row["arm"].as_py()] * n, pa.int32()),
                     pa.array([row["block"].as_py()] * n, pa.int64()), pa.array(np.arange(n, dtype=np.int32)), row["id"].values,
                     pa.array(np.nansum(votes, axis=1)), pa.array((~np.isnan(votes)).sum(axis=1))],
                    names=["gk", "arm", "block", "pos", "id", "total", "votes"])
    return run


def score_forest(test: DataFrame, models: DataFrame, group, feature_cols, keys) -> DataFrame:
    """``group..., arm, keys..., score, prediction``: the mean of the trees'
    probabilities of class 1; class 1 above a half."""
    g, feats = list(group), list(feature_cols)
    rows = test.select(group_key(g).alias("gk"), feature_array(feats).alias("x"), F.struct(*keys).alias("id"))
    kind = rows.schema["id"].dataType.simpleString()
    blocks = blocks_of(rows, "tree-test")
    # a written row's place is the block's number: the same in every task that reads it
    blocks = blocks.withColumn("block", F.xxhash64("_metadata.file_path", "_metadata.row_index"))
    routed = spread(blocks.join(broadcast_within(models, 64 + 44 * F.size("tree")), "gk"), models, ["gk", "arm", "slab"]).mapInArrow(
        _route(len(feats)), f"gk string, arm int, block bigint, pos int, id {kind}, total double, votes bigint")
    score = F.round(F.sum("total") / F.nullif(F.sum("votes"), F.lit(0)), 12)
    out = routed.groupBy("gk", "arm", "block", "pos").agg(F.first("id").alias("id"), score.alias("score"))
    return group_columns(out, g, test).select(*g, "arm", *[F.col(f"id.{k}").alias(k) for k in keys], "score",
                                               (F.coalesce("score", F.lit(0.0)) > 0.5).cast("int").alias("prediction"))
