"""The boosted trees' gains and traversal, the toxic terms' log-odds, segments
and their calibration, against plain versions."""

import collections
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from binscore.llm import quality_model, toxicity

LETTERS = re.compile(rb"[A-Za-z\x80-\xff]+")


def test_first_split_has_the_largest_gain():
    rng = np.random.default_rng(1)
    x = np.round(rng.random((80, 3)), 1)
    y = (x[:, 1] + 0.3 * rng.random(80) > 0.6).astype(float)
    model = quality_model.fit(x, y, rounds=1, depth=1)
    share = y.mean()
    g, h = share - y, np.full(80, share * (1 - share))

    def part(on):
        return g[on].sum() ** 2 / (h[on].sum() + quality_model.RIDGE)
    best = max((part(x[:, j] <= c) + part(x[:, j] > c) - part(np.ones(80, bool)), -j, -c) for j in range(3)
               for c in np.unique(np.quantile(x[:, j], np.linspace(0, 1, quality_model.BINS + 1)[1:-1]))
               if min(h[x[:, j] <= c].sum(), h[x[:, j] > c].sum()) >= quality_model.MIN_HESSIAN)
    assert (model.feature[0, 0], model.threshold[0, 0]) == (-best[1], -best[2])
    for side, on in ((0, x[:, -best[1]] <= -best[2]), (1, x[:, -best[1]] > -best[2])):
        assert model.leaf[0, side] == pytest.approx(-quality_model.RATE * g[on].sum() / (h[on].sum() + quality_model.RIDGE))


def test_traversal_follows_the_nodes():
    rng = np.random.default_rng(2)
    x = rng.random((200, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 2] > 0.4)).astype(float)
    model = quality_model.fit(x, y, rounds=7, depth=3)

    def plain(row):
        out = model.base
        for t in range(7):
            node = 0
            for _ in range(3):
                node = 2 * node + 1 + int(row[model.feature[t, node]] > model.threshold[t, node])
            out += model.leaf[t, node - 7]
        return 1 / (1 + math.exp(-out))
    assert np.allclose(model.score(x), [plain(r) for r in x])
    assert ((model.score(x) > 0.5) == (y == 1)).mean() > 0.9


def words_of(text):
    return [w.lower() for w in LETTERS.findall((text or "").encode())]


def test_terms_count_texts_and_their_log_odds(spark):
    from binscore.llm.common import prepare
    prepare(spark)
    rnd = random.Random(3)
    rows = []
    for i in range(300):
        bad = i % 3 == 0
        rows.append((i, " ".join(rnd.choice(["house", "garden", "river", "stupidly" if bad else "kindly", "street"]) for _ in range(12)), int(bad)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    import zlib
    train = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 != 0]
    toxic, clean = collections.Counter(), collections.Counter()
    for _, text, label in train:
        terms = {t for w in words_of(text) for t in toxicity.word_terms(w)}
        (toxic if label else clean).update(terms)
    n1, n0 = sum(toxic.values()), sum(clean.values())
    want = {}
    for t in set(toxic) | set(clean):
        prior, mass = toxicity.PRIOR * (toxic[t] + clean[t]), toxicity.PRIOR * (n1 + n0)
        a, b = toxic[t] + prior, clean[t] + prior
        delta = math.log(a / (n1 + mass - a)) - math.log(b / (n0 + mass - b))
        z = delta / math.sqrt(1 / a + 1 / b)
        if abs(z) >= toxicity.Z:
            want[t] = (abs(z), delta)
    assert want and set(model.terms) == set(want)
    assert all(model.terms[t] == pytest.approx(v) for t, v in want.items())
    # a toxic text whose draw missed the toxic word is no different from a clean one
    scored = toxicity.score_documents(docs, labels).collect()
    held = [r for r in scored if r.held_out]
    assert held and all((r.score >= 0.5) == ("stupidly" in rows[r.doc_id][1]) for r in held)


def plain_segments(score):
    """All maximal scoring segments by their definition, of values with drift:
    the best segment, then the same on both sides of it."""
    best = max(((sum(score[i:j + 1]), -(j - i), -i, j) for i in range(len(score)) for j in range(i, len(score))), default=None)
    if best is None or best[0] <= 0:
        return []
    i, j = -best[2], best[3]
    return [*plain_segments(score[:i]), (i, j, best[0]), *[(a + j + 1, b + j + 1, s) for a, b, s in plain_segments(score[j + 1:])]]


def test_segments_equal_their_definition():
    rng = np.random.default_rng(4)
    for _ in range(60):
        score = rng.integers(-5, 6, rng.integers(1, 15)).astype(float) + rng.random() / 1000
        got = [(a, b, round(s, 6)) for a, b, s in toxicity.segments(np.arange(len(score)), score, 0.0)]
        assert got == [(a, b, round(s, 6)) for a, b, s in plain_segments(score.tolist())]


def test_lambda_is_the_root():
    scores, weights = np.array([-2.0, -0.1, 1.5]), np.array([50.0, 40.0, 10.0])
    x = toxicity.karlin_lambda(scores, weights)
    assert (weights / 100 * np.exp(x * scores)).sum() == pytest.approx(1) and x > 0


def test_term_counts_of_nothing():
    assert sum(b.num_rows for b in toxicity.term_counts(pa.array([None, ""], pa.string()), np.array([0, 1]))) == 0
