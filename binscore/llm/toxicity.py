"""Toxicity by maximum-scoring segments.

* a term is a whole word or a word beginning of 4 to 8 bytes (inflected and
  compound words share theirs); its log-odds between toxic and clean training
  texts have the pooled counts as informative Dirichlet prior, and count texts,
  not occurrences, as words come in bursts; terms within the noise are left
  out; a token scores as its most significant term, else zero; a small drift
  makes clean text negative;
* one linear scan per text finds all maximal scoring segments (Ruzzo and
  Tompa), run over the scored tokens and the drift between them;
* segment scores are calibrated by extreme-value theory on clean training
  texts: lambda solves the Karlin-Altschul equation, K is the maximum
  likelihood of the Gumbel law of clean texts' best segments, so each segment
  has an expected number E of equal segments in clean text of that length;
* a text's score is a logistic function of the evidence ``sum of -log10 E``
  over its significant segments and of its best segment.

The model is learnt from a bounded sample of labelled rows (``MAX_ROWS``), which
bounds its terms; the noise threshold ``Z`` alone decides which are kept.  Every
whole text is scored.

Defined results: a null or empty text has no segment and the score of no
evidence; without labelled rows of both classes the score is the share of
label 1 (0 without rows); repeated rows score alike; an empty table gives no
rows; of equally significant terms of a token the larger log-odds count; other
columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from binscore.llm.common import LOWER, fold, labelled_sample, owner, packed, runs, steps, text_buffer
from binscore.llm.dictionary import take_lists
from binscore.llm.textstats import LETTER

MAX_ROWS = 15_000
PREFIXES = (4, 5, 6, 7, 8)
#: Weight of the pooled counts in the prior, as a share of the counts.
PRIOR = 0.05
Z = 4.0
DRIFT = 0.05
SIGNIFICANT = 0.05


def tokens(data: np.ndarray, offs: np.ndarray):
    """Runs of letters in lower case (A-Z; bytes of other alphabets count as
    letters): binary array, starts, ends and the first of each text."""
    inside = LETTER[data]
    starts, ends, first = runs(inside, offs)
    return packed(LOWER[data], inside, ends - starts), starts, ends, first


def segments(at: np.ndarray, score: np.ndarray, drift: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments of one text in one pass: ``at`` are the
    places of its scored tokens, ``score`` their scores; every token, scored
    or not, also counts ``-drift``.  Returns (first, last, sum) by scored
    token."""
    lefts: list[tuple[int, int, float, float]] = []  # first, last, sum before, sum at the end
    total, previous = 0.0, -1
    for k, (place, s) in enumerate(zip(at.tolist(), score.tolist())):
        total -= drift * (place - previous - 1)
        previous = place
        s -= drift
        if s <= 0:
            total += s
            continue
        first, low, total = k, total, total + s
        last = k
        while lefts:
            j = len(lefts) - 1
            while j >= 0 and lefts[j][2] >= low:
                j -= 1
            if j < 0 or lefts[j][3] >= total:
                break
            first, low = lefts[j][0], lefts[j][2]
            del lefts[j:]
        lefts.append((first, last, low, total))
    return [(a, b, high - low) for a, b, low, high in lefts]


class Model:
    """Token scores, extreme-value parameters and the logistic weights."""

    def __init__(self, terms: dict[bytes, tuple[float, float]], lam: float = 1.0, k: float = 1.0, weights=(0.0, 0.0, 0.0)):
        self.terms, self.lam, self.k, self.weights = terms, lam, k, weights

    def token_score(self, word: bytes) -> float:
        found = [self.terms[t] for t in word_terms(word) if t in self.terms]
        return max(found)[1] if found else 0.0

    def passages(self, texts: pa.Array):
        """For each text its token count and its segments as (first byte, end
        byte, sum)."""
        for part in steps(texts):
            data, offs = text_buffer(part)
            words, starts, ends, first = tokens(data, offs)
            coded = words.dictionary_encode()
            value = np.array([self.token_score(w) for w in coded.dictionary.to_pylist()] or [0.0])
            codes = coded.indices.to_numpy()
            score = value[codes] if len(codes) else np.zeros(0)
            scored = np.flatnonzero(score)
            edge = np.searchsorted(scored, first)
            positive = np.concatenate([[0], np.cumsum(score[scored] > 0)])
            for i in range(len(offs) - 1):
                a, b = edge[i], edge[i + 1]
                n = int(first[i + 1] - first[i])
                if positive[b] == positive[a]:
                    yield n, []
                    continue
                own = scored[a:b]
                yield n, [(int(starts[own[x]] - offs[i]), int(ends[own[y]] - offs[i]), s)
                          for x, y, s in segments(own - first[i], score[own], DRIFT)]

    def evidence(self, n: int, found: list) -> tuple[float, float, int]:
        """``-log10 E`` of the best segment (0 without one), its sum over the
        significant ones, and their number."""
        e = [(self.lam * s - np.log(self.k * max(n, 1))) / np.log(10) for _, _, s in found]
        strong = [x for x in e if x > -np.log10(SIGNIFICANT)]
        return max(e, default=0.0), sum(strong), len(strong)

    def score(self, best: np.ndarray, total: np.ndarray) -> np.ndarray:
        a, b, c = self.weights
        return 1 / (1 + np.exp(-np.clip(a + b * np.clip(best, -5, 20) + c * np.log1p(total), -50, 50)))


def word_terms(word: bytes) -> list[bytes]:
    """The word as a whole (marked by a final space) and its beginnings."""
    return [word + b" ", *(word[:k] for k in PREFIXES if len(word) >= k)]


def term_counts(texts: pa.Array, label: np.ndarray):
    """Number of toxic and of clean texts that have each term."""
    at = 0
    for part in steps(texts):
        words, _, _, first = tokens(*text_buffer(part))
        mark = label[at:at + len(part)]
        at += len(part)
        coded = words.dictionary_encode()
        lists = [word_terms(w) for w in coded.dictionary.to_pylist()]
        if not lists:
            continue
        ends = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
        terms = pa.array([t for x in lists for t in x], pa.binary()).dictionary_encode()
        size, known = len(terms.dictionary), terms.indices.to_numpy().astype(np.int64)
        pair = np.unique(owner(first) * len(coded.dictionary) + coded.indices.to_numpy())
        of, lengths = take_lists(ends, known, pair % len(coded.dictionary))
        pair = np.unique(np.repeat(pair // len(coded.dictionary), lengths) * size + of)
        toxic = mark[pair // size] == 1
        yield pa.RecordBatch.from_arrays(
            [terms.dictionary, pa.array(np.bincount(pair[toxic] % size, minlength=size)),
             pa.array(np.bincount(pair[~toxic] % size, minlength=size))], names=["term", "toxic", "clean"])


def karlin_lambda(scores: np.ndarray, weights: np.ndarray) -> float:
    """The positive root of sum p(s) exp(lambda s) = 1 (1 where the scores
    have no positive value or no negative mean)."""
    p = weights / max(weights.sum(), 1)
    if not (scores > 0).any() or (p * scores).sum() >= 0:
        return 1.0
    low, high = 0.0, 1.0
    while (p * np.exp(np.clip(high * scores, -700, 700))).sum() < 1 and high < 64:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if (p * np.exp(np.clip(mid * scores, -700, 700))).sum() < 1 else (low, mid)
    return max((low + high) / 2, 0.05)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weights of a ridge logistic regression (Newton)."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Model:
    """A model from a sample of labelled training rows.  The tasks count
    tokens and scan texts; the driver gets the terms and three numbers a row."""
    sample = labelled_sample(docs, labels, "toxic", max_rows).select("text", "label").persist()

    def count(batches):
        for batch in batches:
            yield from term_counts(batch.column("text"), batch.column("label").to_numpy())

    try:
        counts = (sample.mapInArrow(count, "term binary, toxic long, clean long")
                  .groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).persist())
        total = counts.agg(F.sum("toxic"), F.sum("clean")).first()
        share = sample.agg(F.avg("label")).first()[0]
        if share in (None, 0.0, 1.0) or not total[0] or not total[1]:
            counts.unpersist()
            share = share or 0.0
            return Model({}, weights=(float(np.log((share + 1e-6) / (1 - share + 1e-6))), 0.0, 0.0))
        # log-odds and their z-score; terms beyond the noise, as many as the sample has
        n1, n0 = float(total[0]), float(total[1])
        prior, mass = F.lit(PRIOR) * (F.col("toxic") + F.col("clean")), PRIOR * (n1 + n0)
        a, b = F.col("toxic") + prior, F.col("clean") + prior
        delta = F.log(a / (n1 + mass - a)) - F.log(b / (n0 + mass - b))
        terms = (counts.select("term", delta.alias("delta"), (delta / F.sqrt(1 / a + 1 / b)).alias("z"))
                 .where(F.abs("z") >= Z).toPandas())
        counts.unpersist()
        model = Model({bytes(w): (abs(float(z)), float(d)) for w, d, z in zip(terms["term"], terms["delta"], terms["z"])})
        sent = docs.sparkSession.sparkContext.broadcast(model)

        def clean_scores(batches):
            for batch in batches:
                text = batch.column("text").filter(pa.compute.equal(batch.column("label"), 0))
                for part in steps(text):
                    coded = tokens(*text_buffer(part))[0].dictionary_encode()
                    value = np.array([sent.value.token_score(w) for w in coded.dictionary.to_pylist()] or [0.0])
                    v, back = np.unique(value, return_inverse=True)
                    n = np.bincount(back[coded.indices.to_numpy()], minlength=len(v)) if len(coded) else np.zeros(len(v), int)
                    yield pa.RecordBatch.from_arrays([pa.array(v), pa.array(n.astype(np.int64))], names=["score", "n"])

        law = (sample.mapInArrow(clean_scores, "score double, n long").groupBy("score").agg(F.sum("n").alias("n"))
               .toPandas().sort_values("score"))
        model.lam = karlin_lambda(law["score"].to_numpy() - DRIFT, law["n"].to_numpy().astype(float))
        sent = docs.sparkSession.sparkContext.broadcast(model)

        def scan(batches):
            for batch in batches:
                best = [(n, max((s for _, _, s in found), default=0.0), [s for _, _, s in found])
                        for n, found in sent.value.passages(batch.column("text"))]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("label"), pa.array([x[0] for x in best], pa.int64()),
                     pa.array([x[1] for x in best], pa.float64()), pa.array([x[2] for x in best], pa.list_(pa.float64()))],
                    names=["label", "n", "best", "sums"])

        rows = sample.mapInArrow(scan, "label int, n long, best double, sums array<double>").toPandas()
    finally:
        sample.unpersist()
    rows = rows.sort_values(["label", "n", "best"], kind="stable")
    clean = rows[rows.label == 0]
    expected = (np.maximum(clean.n, 1) * np.exp(-model.lam * clean.best)).sum()
    model.k = float(len(clean) / max(expected, 1e-9))
    found = [model.evidence(n, [(0, 0, s) for s in sums]) for n, sums in zip(rows.n, rows.sums)]
    x = np.array([(np.clip(b, -5, 20), np.log1p(t)) for b, t, _ in found])
    model.weights = tuple(logistic(x, rows.label.to_numpy().astype(float)).tolist())
    return model


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, n_passages, passages`` of every row;
    ``passages`` are the significant segments as byte ranges of the text with
    their sums."""
    sent = docs.sparkSession.sparkContext.broadcast(train(docs, labels))

    @F.arrow_udf("struct<score:double,passages:array<struct<begin:int,end:int,sum:double>>>")
    def scan(text: pa.Array) -> pa.Array:
        model = sent.value
        best, total, lists = [], [], []
        for n, found in model.passages(text):
            b, t, _ = model.evidence(n, found)
            best.append(b)
            total.append(t)
            lists.append([{"begin": x, "end": y, "sum": s} for x, y, s in found
                          if (model.lam * s - np.log(model.k * max(n, 1))) / np.log(10) > -np.log10(SIGNIFICANT)])
        item = pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("sum", pa.float64())])
        return pa.StructArray.from_arrays([pa.array(model.score(np.array(best), np.array(total)), pa.float64()),
                                           pa.array(lists, pa.list_(item))], names=["score", "passages"])

    return (docs.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), scan(F.col("text")).alias("s"))
            .select("doc_id", "held_out", "s.score", F.size("s.passages").alias("n_passages"), "s.passages"))
