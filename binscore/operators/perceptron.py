"""Multi-layer perceptron (I5) for all groups and arms at once.

One hidden layer of ``HIDDEN`` rectified units, a logistic output, log loss with
an L2 penalty, Adam updates, at most ``MAX_EPOCHS`` epochs; training stops when
the loss has not fallen by ``TOLERANCE`` for ``PATIENCE`` epochs.  These are the
reference's parameters and its library's defaults; ``shuffle=False`` and the
learning-rate schedule ``adaptive`` have no effect on this solver beyond the
fixed order of rows.

Initial weights are hashes of their place, so reruns agree.  A batch is the
group's whole train set: the library's batches of min(200, n) rows for groups of
up to 200 rows; larger groups take larger batches and so fewer updates.

A group of at most ``WHOLE`` rows trains to its end in one task an arm.  Larger
groups train together, one aggregation of gradients an epoch for all of them;
their models are checkpointed after each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from binscore.operators.blocks import BLOCK, WHOLE, blocks_of, broadcast_within, feature_array, group_columns, group_key, spread
from binscore.operators.draws import PRIME, scramble
from binscore.operators.joins import bounded_broadcast
from binscore.session import cut_lineage

HIDDEN = 7
MAX_EPOCHS = 200
TOLERANCE, PATIENCE = 1e-4, 10
PENALTY = 1e-4
RATE, BETA1, BETA2, EPSILON = 1e-3, 0.9, 0.999, 1e-8


def width(d: int) -> int:
    """Weights of a network: hidden weights by unit, hidden biases, output
    weights, output bias."""
    return HIDDEN * d + 2 * HIDDEN + 1


def first_weights(used: list[int], d: int) -> np.ndarray:
    """Uniform within sqrt(6 / (inputs + outputs)) of a layer; unused features
    have no weight."""
    n = width(d)
    u = 2 * scramble(np.arange(n), 5) / PRIME - 1
    w = u * np.sqrt(6 / (HIDDEN + 1))
    w[:HIDDEN * d + HIDDEN] = u[:HIDDEN * d + HIDDEN] * np.sqrt(6 / (len(used) + HIDDEN))
    off = np.setdiff1d(np.arange(d), used)
    w[:HIDDEN * d].reshape(HIDDEN, d)[:, off] = 0
    return w


def loss_and_gradient(w: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
    """Sum of the rows' log loss and its gradient, without the penalty."""
    d = x.shape[1]
    w1, b1 = w[:HIDDEN * d].reshape(HIDDEN, d), w[HIDDEN * d:HIDDEN * d + HIDDEN]
    w2, b2 = w[-HIDDEN - 1:-1], w[-1]
    h = np.maximum(0, x @ w1.T + b1)
    z = h @ w2 + b2
    loss = float((np.logaddexp(0, z) - y * z).sum())
    dz = 1 / (1 + np.exp(-z)) - y
    dh = np.where(h > 0, dz[:, None] * w2, 0.0)
    return loss, np.concatenate([(dh.T @ x).ravel(), dh.sum(0), h.T @ dz, [dz.sum()]])


def penalised(d: int) -> np.ndarray:
    """1 for weights, 0 for biases."""
    out = np.ones(width(d))
    out[HIDDEN * d:HIDDEN * d + HIDDEN] = 0
    out[-1] = 0
    return out


class Adam:
    """One network's state between epochs."""

    def __init__(self, w, m, v, epoch=0, best=np.inf, stale=0):
        self.w, self.m, self.v = (np.array(a, float) for a in (w, m, v))
        self.epoch, self.best, self.stale, self.done = epoch, best, stale, False

    def update(self, loss: float, gradient: np.ndarray, n: int, d: int, epochs: int = MAX_EPOCHS) -> None:
        on = penalised(d)
        loss = loss / n + 0.5 * PENALTY / n * float((on * self.w * self.w).sum())
        gradient = gradient / n + PENALTY / n * on * self.w
        self.epoch += 1
        self.m = BETA1 * self.m + (1 - BETA1) * gradient
        self.v = BETA2 * self.v + (1 - BETA2) * gradient * gradient
        rate = RATE * np.sqrt(1 - BETA2 ** self.epoch) / (1 - BETA1 ** self.epoch)
        self.w = self.w - rate * self.m / (np.sqrt(self.v) + EPSILON)
        self.stale = self.stale + 1 if loss > self.best - TOLERANCE else 0
        self.best = min(self.best, loss)
        self.done = self.stale > PATIENCE or self.epoch >= epochs


def _masked(raw: bytes, used: list[int], d: int) -> np.ndarray:
    x = np.frombuffer(raw, np.float64).reshape(-1, d)
    on = np.zeros(d)
    on[used] = 1
    return x * on


def _train_whole(d: int, epochs: int):
    """applyInArrow over the blocks of whole groups joined with their models."""
    def run(key, table):
        used = table["used"][0].as_py()
        x = np.concatenate([_masked(v.as_buffer(), used, d) for v in table["x"]])
        y = np.concatenate([np.frombuffer(v.as_buffer(), np.int64) for v in table["label"]])
        state = Adam(table["w"][0].as_py(), np.zeros(width(d)), np.zeros(width(d)))
        while not state.done:
            state.update(*loss_and_gradient(state.w, x, y), len(y), d, epochs)
        return pa.Table.from_pylist([{"gk": key[0].as_py(), "arm": key[1].as_py(), "w": state.w.tolist(), "epoch": state.epoch}],
                                    pa.schema([("gk", pa.string()), ("arm", pa.int32()), ("w", pa.list_(pa.float64())),
                                               ("epoch", pa.int32())]))
    return run


def _partial(d: int):
    """mapInArrow over blocks joined with models: row count, loss and gradient."""
    def run(batches):
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                x, y = _masked(r["x"], r["used"], d), np.frombuffer(r["label"], np.int64)
                loss, gradient = loss_and_gradient(np.array(r["w"]), x, y)
                rows.append({"gk": r["gk"], "arm": r["arm"], "sums": [float(len(y)), loss, *gradient.tolist()]})
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("gk", pa.string()), ("arm", pa.int32()), ("sums", pa.list_(pa.float64()))]))
    return run


def _update(d: int, epochs: int):
    @F.arrow_udf("struct<w: array<double>, m: array<double>, v: array<double>, epoch: int, best: double, stale: int, done: boolean>")
    def step(w: pa.Array, m: pa.Array, v: pa.Array, epoch: pa.Array, best: pa.Array, stale: pa.Array, sums: pa.Array) -> pa.Array:
        out = []
        for *state, total in zip(*(a.to_pylist() for a in (w, m, v, epoch, best, stale, sums))):
            s = Adam(*state)
            s.update(total[1], np.array(total[2:]), int(total[0]), d, epochs)
            out.append({"w": s.w.tolist(), "m": s.m.tolist(), "v": s.v.tolist(), "epoch": s.epoch, "best": s.best, "stale": s.stale,
                        "done": s.done})
        double = pa.list_(pa.float64())
        return pa.array(out, pa.struct([("w", double), ("m", double), ("v", double), ("epoch", pa.int32()), ("best", pa.float64()),
                                        ("stale", pa.int32()), ("done", pa.bool_())]))
    return step


def fit_perceptrons(train: DataFrame, flags: DataFrame, group, feature_cols, epochs: int = MAX_EPOCHS, block: int = BLOCK,
                    whole: int = WHOLE) -> DataFrame:
    """``gk, arm, w, epoch`` of every row of ``flags`` (``used_flags``) whose group
    has train rows (features and ``label``).  ``block``: rows of a block at most,
    ``whole``: those of a group that trains in one task."""
    g, feats = list(group), list(feature_cols)
    d = len(feats)
    rows = train.select(group_key(g).alias("gk"), feature_array(feats).alias("x"), F.col("label").cast("long").alias("label"))
    blocks = blocks_of(rows, "perceptron-rows", block)
    used = F.filter(F.array(*[F.when(F.col(f"u_{f}") == 1, F.lit(i)) for i, f in enumerate(feats)]), lambda i: i.isNotNull())

    @F.arrow_udf("array<double>")
    def start(used: pa.Array) -> pa.Array:
        return pa.array([first_weights(u, d).tolist() for u in used.to_pylist()], pa.list_(pa.float64()))

    parts = cut_lineage(blocks.groupBy("gk").agg((F.sum(F.octet_length("label")) <= 8 * whole).alias("whole")))
    models = cut_lineage(flags.select(group_key(g).alias("gk"), F.col("arm").cast("int").alias("arm"), used.alias("used"))
                         .join(bounded_broadcast(parts), "gk").withColumn("w", start("used")))
    size = F.lit(8 * 3 * width(d) + 64)
    small = models.where("whole").drop("whole")
    done = [cut_lineage(spread(blocks.join(broadcast_within(small, size), "gk"), small, ["gk", "arm"]).groupBy("gk", "arm")
                        .applyInArrow(_train_whole(d, epochs), "gk string, arm int, w array<double>, epoch int"))]
    zeros, step = F.array_repeat(F.lit(0.0), width(d)), _update(d, epochs)
    live = cut_lineage(models.where("NOT whole").select(
        "gk", "arm", "used", "w", zeros.alias("m"), zeros.alias("v"), F.lit(0).alias("epoch"), F.lit(float("inf")).alias("best"),
        F.lit(0).alias("stale"), F.lit(False).alias("done")))
    while not live.isEmpty():
        sums = (blocks.join(broadcast_within(live, size), "gk").mapInArrow(_partial(d), "gk string, arm int, sums array<double>")
                .select("gk", "arm", F.posexplode("sums").alias("pos", "part"))
                .groupBy("gk", "arm", "pos").agg(F.sum("part").alias("part"))
                .groupBy("gk", "arm").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "part"))),
                                                      lambda s: s["part"]).alias("sums")))
        moved = cut_lineage(live.join(sums, ["gk", "arm"])
                            .select("gk", "arm", "used", step("w", "m", "v", "epoch", "best", "stale", "sums").alias("s"))
                            .select("gk", "arm", "used", "s.*"))
        done.append(moved.where("done").select("gk", "arm", "w", "epoch"))
        live = moved.where("NOT done")
        if moved.where("done").isEmpty():
            done.pop()
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def score_perceptrons(test: DataFrame, models: DataFrame, group, feature_cols, keys) -> DataFrame:
    """``group..., arm, keys..., score, prediction``: the network's probability
    of class 1; class 1 above a half."""
    g, feats = list(group), list(feature_cols)
    d = len(feats)

    def dot(a, b, first):
        return F.aggregate(F.zip_with(a, b, lambda p, q: p * q), first, lambda s, t: s + t)

    x, w = feature_array(feats), F.col("w")
    hidden = F.array(*[F.greatest(F.lit(0.0), dot(x, F.slice(w, j * d + 1, d), w[HIDDEN * d + j])) for j in range(HIDDEN)])
    z = dot(hidden, F.slice(w, HIDDEN * d + HIDDEN + 1, HIDDEN), w[width(d) - 1])
    side = group_columns(models.select("gk", "arm", "w"), g, test)
    return (test.join(broadcast_within(side, F.lit(8 * width(d) + 64)), g)
            .select(*g, "arm", *keys, z.alias("_z"))
            .select(*g, "arm", *keys, (F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("_z")))).alias("score"),
                    (F.col("_z") > 0).cast("int").alias("prediction")))
