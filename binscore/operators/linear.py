"""Linear learners (I3 logistic regression, I6 linear SVM) for all groups and
arms at once.

Both minimise ``|w|^2 / 2 + C sum_i weight_i loss_i``: the logistic loss with
a free intercept, or the squared hinge with a penalised one.  Both problems
have one optimum, so the result does not depend on the solver.

Models take damped Newton steps: a step that raises the loss is halved.  The
train rows are packed once into blocks of a group.  A group of at most
``WHOLE`` rows is solved in one task an arm.  Larger groups take their steps
together: each block sums loss, gradient and Hessian for the models it meets,
one aggregation a step adds them up per position, and the small systems are
solved where those rows lie; models are checkpointed after each step.  A model
that is unfinished after the last step is marked (``converged`` false);
logistic regression of rows of one class has no optimum and is always so.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from binscore.operators.blocks import BLOCK, WHOLE, blocks_of, broadcast_within, feature_array, group_columns, group_key, spread
from binscore.operators.joins import bounded_broadcast
from binscore.session import cut_lineage

MAX_STEPS = 40
#: A group is done when no weight moves by more than this.
STEP_TOLERANCE = 1e-8


def _logistic(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Loss, first and second derivative by the margin; y is 0 or 1."""
    p = 1 / (1 + np.exp(-np.clip(margin, -500, 500)))
    return np.logaddexp(0, margin) - y * margin, p - y, p * (1 - p)


def _squared_hinge(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sign = 2 * y - 1
    short = np.maximum(0, 1 - sign * margin)
    return short ** 2, -2 * sign * short, 2.0 * (short > 0)


#: Loss, and whether the intercept is penalised.
LOSSES: dict[str, tuple[Callable, bool]] = {"LR": (_logistic, False), "SVM": (_squared_hinge, True)}


def _sums(loss: Callable, x: np.ndarray, y: np.ndarray, weight: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Loss, gradient and Hessian over rows, as ``1 + d + d * d`` numbers."""
    value, first, second = (weight * part for part in loss(x @ w, y))
    return np.concatenate([[value.sum()], first @ x, ((second[:, None] * x).T @ x).ravel()])


class Newton:
    """One model's damped steps: ``at`` is tried next, ``good`` the best so far."""

    def __init__(self, at, good, best, used, penalised_intercept: bool):
        self.at, self.good, self.best, self.on, self.done = np.array(at), np.array(good), best, np.array(used) > 0, False
        self.penalty = np.ones(len(self.at))
        self.penalty[-1] = 1.0 if penalised_intercept else 0.0

    def step(self, total: np.ndarray, c: float) -> None:
        """``total``: the sums at ``at``."""
        at, on, d = self.at, self.on, len(self.at)
        total = c * total
        value = float(total[0] + 0.5 * (self.penalty * at * at).sum())
        if self.best is not None and value > self.best + 1e-9 * abs(self.best):
            self.at = (at + self.good) / 2
            return
        slope = (total[1:d + 1] + self.penalty * at)[on]
        # unpenalised intercepts keep a trace of ridge, so one-class groups stay solvable
        bend = total[d + 1:].reshape(d, d)[np.ix_(on, on)] + np.diag(np.maximum(self.penalty, 1e-9)[on])
        move = np.zeros(d)
        move[on] = np.linalg.solve(bend, slope)
        self.at, self.good, self.best = at - move, at, value
        self.done = bool(np.abs(move).max() < STEP_TOLERANCE * max(1.0, np.abs(at).max()))


def _rows_of(r: dict, d: int):
    """A block's used features, labels and weights."""
    return (np.frombuffer(r["x"], np.float64).reshape(-1, d) * np.array(r["used"]), np.frombuffer(r["label"], np.int64).astype(float),
            np.array(r["weight"]))


def _solve_whole(loss: Callable, penalised: bool, d: int, c: float, max_steps: int):
    """applyInArrow over the blocks of whole groups joined with their models."""
    def run(key, table):
        rows = [np.concatenate(part) for part in zip(*(_rows_of(r, d) for r in table.to_pylist()))]
        model = Newton(np.zeros(d), np.zeros(d), None, table["used"][0].as_py(), penalised)
        for _ in range(max_steps):
            model.step(_sums(loss, *rows, model.at), c)
            if model.done:
                break
        return pa.Table.from_pylist([{"gk": key[0].as_py(), "arm": key[1].as_py(), "w": model.good.tolist(), "converged": model.done}],
                                    pa.schema([("gk", pa.string()), ("arm", pa.int32()), ("w", pa.list_(pa.float64())),
                                               ("converged", pa.bool_())]))
    return run


def _partial_sums(loss: Callable, d: int):
    """mapInArrow over blocks joined with models."""
    def run(batches):
        for batch in batches:
            out = [{"gk": r["gk"], "arm": r["arm"], "sums": _sums(loss, *_rows_of(r, d), np.array(r["w"])).tolist()} for r in batch.to_pylist()]
            yield pa.RecordBatch.from_pylist(out, pa.schema([("gk", pa.string()), ("arm", pa.int32()), ("sums", pa.list_(pa.float64()))]))
    return run


def _step_udf(penalised: bool, c: float):
    @F.arrow_udf("struct<w:array<double>,base:array<double>,loss:double,done:boolean>")
    def step(w: pa.Array, base: pa.Array, loss: pa.Array, used: pa.Array, sums: pa.Array) -> pa.Array:
        out = []
        for *state, total in zip(*(a.to_pylist() for a in (w, base, loss, used, sums))):
            model = Newton(*state, penalised)
            model.step(np.array(total), c)
            out.append({"w": model.at.tolist(), "base": model.good.tolist(), "loss": model.best, "done": model.done})
        return pa.array(out, pa.struct([("w", pa.list_(pa.float64())), ("base", pa.list_(pa.float64())),
                                        ("loss", pa.float64()), ("done", pa.bool_())]))
    return step


def _vector(columns) -> F.Column:
    """Features and a one for the intercept (NULL counts as 0)."""
    return F.array_append(feature_array(columns), F.lit(1.0))


def fit_linear(train: DataFrame, flags: DataFrame, group, feature_cols, algorithm: str, c: float = 1.0,
               max_steps: int = MAX_STEPS, block: int = BLOCK, whole: int = WHOLE) -> DataFrame:
    """``group..., arm, w, converged`` (weights of ``feature_cols``, then the
    intercept) of every row of ``flags`` (``used_flags``) whose group has train rows.
    ``train``: features, ``label`` and ``weight``.  Columns an arm does not use
    get weight zero.  ``whole``: rows of a group at most that one task solves."""
    g, d = list(group), len(feature_cols) + 1
    loss, penalised = LOSSES[algorithm]
    rows = train.select(group_key(g).alias("gk"), _vector(feature_cols).alias("x"), F.col("label").cast("long").alias("label"),
                        F.col("weight").cast("double").alias("weight"))
    blocks = blocks_of(rows, "linear-rows", block)
    parts = cut_lineage(blocks.groupBy("gk").agg((F.sum(F.octet_length("label")) <= 8 * whole).alias("whole")))
    used = F.array(*[F.col(f"u_{f}").cast("double") for f in feature_cols], F.lit(1.0))
    models = cut_lineage(flags.select(group_key(g).alias("gk"), F.col("arm").cast("int").alias("arm"), used.alias("used"))
                         .join(bounded_broadcast(parts), "gk"))
    size = F.lit(8 * 3 * d + 64)
    small = models.where("whole").drop("whole")
    done = [cut_lineage(spread(blocks.join(broadcast_within(small, size), "gk"), small, ["gk", "arm"]).groupBy("gk", "arm").applyInArrow(
        _solve_whole(loss, penalised, d, c, max_steps), "gk string, arm int, w array<double>, converged boolean"))]
    zero, step = F.array_repeat(F.lit(0.0), d), _step_udf(penalised, c)
    live = cut_lineage(models.where("NOT whole").select("gk", "arm", "used", zero.alias("w"), zero.alias("base"),
                                                        F.lit(None).cast("double").alias("loss")))
    for _ in range(max_steps):
        if live.isEmpty():
            break
        sums = (blocks.join(broadcast_within(live, size), "gk").mapInArrow(_partial_sums(loss, d), "gk string, arm int, sums array<double>")
                .select("gk", "arm", F.posexplode("sums").alias("pos", "part"))
                .groupBy("gk", "arm", "pos").agg(F.sum("part").alias("part"))
                .groupBy("gk", "arm").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "part"))),
                                                      lambda s: s["part"]).alias("sums")))
        moved = cut_lineage(live.join(sums, ["gk", "arm"]).select("gk", "arm", "used", step("w", "base", "loss", "used", "sums").alias("s"))
                            .select("gk", "arm", "used", "s.*"))
        done.append(moved.where("done").select("gk", "arm", F.col("base").alias("w"), F.lit(True).alias("converged")))
        live = moved.where("NOT done").drop("done")
    done.append(live.select("gk", "arm", F.col("base").alias("w"), F.lit(False).alias("converged")))
    return group_columns(reduce(DataFrame.unionByName, done), g, train)


def score_linear(test: DataFrame, models: DataFrame, group, feature_cols, algorithm: str, keys) -> DataFrame:
    """``group..., arm, keys..., score, prediction``: the probability of class
    1 (LR) or the decision value (SVM)."""
    margin = F.aggregate(F.zip_with(_vector(feature_cols), F.col("w"), lambda a, b: a * b), F.lit(0.0),
                         lambda total, v: total + v)
    scored = (test.join(bounded_broadcast(models), list(group))
              .select(*group, "arm", *keys, margin.alias("_m")))
    score = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("_m"))) if algorithm == "LR" else F.col("_m")
    return scored.select(*group, "arm", *keys, score.alias("score"), (F.col("_m") > 0).cast("int").alias("prediction"))
