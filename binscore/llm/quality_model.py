"""Quality classifier: histogram gradient-boosted trees over document
statistics, flattened into arrays for vectorised traversal.

The statistics of every document are computed where it is read.  The trees are
grown on those of a bounded sample of labelled rows (``MAX_ROWS``): only their
numbers (``MAX_ROWS`` x 16) reach the driver.  A fitted model is four small
arrays.

Defined results: a null or empty text has zero statistics and a score like any
other; without labelled rows, or with one class only, the score is the share
of label 1 (0.5 without rows); repeated rows score alike; an empty table gives no
rows; whole texts count whatever their length; equal gains: the first feature;
other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from binscore.llm.common import fold, labelled_sample
from binscore.llm.textstats import text_stats

MAX_ROWS = 20_000
ROUNDS, DEPTH, BINS, RATE, RIDGE, MIN_HESSIAN = 60, 4, 64, 0.2, 1.0, 2.0


def features(texts: pa.Array) -> np.ndarray:
    """One row of 16 scale-free statistics per text."""
    s = {k: v.astype(np.float64) for k, v in text_stats(texts).items()}
    w, c, lines = np.maximum(s["n_words"], 1), np.maximum(s["word_chars"], 1), np.maximum(s["n_lines"], 1)
    return np.stack([
        np.log1p(s["n_words"]), s["word_chars"] / w, s["n_symbols"] / c, s["n_bang"] / c, s["n_bar"] / w,
        s["n_upper"] / np.maximum(s["n_letter"], 1), s["n_digit"] / c, s["n_dup_lines"] / lines,
        s["n_repeat_words"] / w, s["n_distinct"] / w, s["n_top"] / w, s["n_short"] / w, s["n_no_letter"] / w,
        s["n_stop"] / w, np.log1p(w / lines), s["n_letter"] / c], axis=1)


class Trees:
    """Boosted trees of one depth: for each tree the inner nodes' feature and
    threshold and the leaves' values, level by level."""

    def __init__(self, base: float, feature: np.ndarray, threshold: np.ndarray, leaf: np.ndarray):
        self.base, self.feature, self.threshold, self.leaf = base, feature, threshold, leaf

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        row = np.arange(len(x))
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf):
            node = np.zeros(len(x), np.int64)
            for _ in range(int(np.log2(len(leaf)))):
                node = 2 * node + 1 + (x[row, feature[node]] > threshold[node])
            out += leaf[node - len(feature)]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def fit(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, depth: int = DEPTH, bins: int = BINS) -> Trees:
    """Trees for the logistic loss.  Values are binned once; a level's splits
    come from one histogram of gradients per (node, feature, bin)."""
    inner = 2 ** depth - 1
    share = float(y.mean()) if len(y) else 0.5
    none = (np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)))
    if share in (0.0, 1.0) or not len(y):
        return Trees(float(np.log((share + 1e-6) / (1 - share + 1e-6))), *none)
    n, d = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(d)]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    at = np.arange(d) * bins
    margin = np.full(n, np.log(share / (1 - share)))
    feature = np.zeros((rounds, inner), np.int64)
    threshold = np.full((rounds, inner), np.inf)
    leaf = np.zeros((rounds, inner + 1))
    allowed = np.concatenate([np.arange(bins) < len(c) for c in cuts])  # a split after the last cut is none
    for t in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            nodes, base = 2 ** level, 2 ** level - 1
            cell = ((node - base)[:, None] * (d * bins) + at + binned).ravel()
            grad = np.bincount(cell, np.repeat(g, d), nodes * d * bins).reshape(nodes, d, bins).cumsum(axis=2)
            hess = np.bincount(cell, np.repeat(h, d), nodes * d * bins).reshape(nodes, d, bins).cumsum(axis=2)
            total_g, total_h = grad[:, :, -1:], hess[:, :, -1:]
            gain = (grad ** 2 / (hess + RIDGE) + (total_g - grad) ** 2 / (total_h - hess + RIDGE)
                    - total_g ** 2 / (total_h + RIDGE))
            gain[(hess < MIN_HESSIAN) | (total_h - hess < MIN_HESSIAN)] = 0
            gain = gain.reshape(nodes, d * bins) * allowed
            best = gain.argmax(axis=1)
            for k in np.flatnonzero(gain[np.arange(nodes), best] > 1e-9):
                j, b = divmod(int(best[k]), bins)
                feature[t, base + k], threshold[t, base + k] = j, cuts[j][b]
            node = 2 * node + 1 + (x[np.arange(n), feature[t, node]] > threshold[t, node])
        end = node - inner
        sum_g, sum_h = np.bincount(end, g, inner + 1), np.bincount(end, h, inner + 1)
        leaf[t] = -RATE * sum_g / (sum_h + RIDGE)
        margin += leaf[t, end]
    return Trees(float(np.log(share / (1 - share))), feature, threshold, leaf)


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Trees:
    """Trees from a sample of labelled training rows; their statistics are
    computed by the tasks."""
    @F.arrow_udf("array<double>")
    def stats(text: pa.Array) -> pa.Array:
        x = features(text)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))

    rows = labelled_sample(docs, labels, "quality", max_rows).select(stats(F.col("text")).alias("x"), "label").toArrow()
    x = rows["x"].combine_chunks().flatten().to_numpy().reshape(len(rows), -1) if len(rows) else np.zeros((0, 16))
    y = rows["label"].to_numpy().astype(np.float64)
    order = np.lexsort((*x.T, y))  # the sample's order, and so the sums, do not depend on partitions
    return fit(x[order], y[order])


def score_udf(spark: SparkSession, model: Trees):
    """Score (0 to 1) of a text column."""
    sent = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        return pa.array(sent.value.score(features(text)))
    return score


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score`` of every row."""
    score = score_udf(docs.sparkSession, train(docs, labels))
    return docs.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), score(F.col("text")).alias("score"))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Rows of ``docs``, all columns kept, whose score is at least ``threshold``."""
    score: Column = score_udf(docs.sparkSession, train(docs, labels))(docs["text"])
    return docs.where(score >= threshold)
