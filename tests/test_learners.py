"""The learners that fit all groups at once: trees and forests against a plain
search, the perceptron's gradient against finite differences, SQL fits."""

import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from binscore.operators import draws, perceptron, trees
from binscore.plans import catalog
from conftest import SF_SMALL

FEATURES = ["a", "b", "c", "d"]


def table(sizes, seed=1):
    rnd = random.Random(seed)
    rows = []
    for g, n in sizes.items():
        for i in range(n):
            a, b, c = rnd.randrange(12) / 4, rnd.random(), rnd.choice([0.0, 1.0])
            rows.append((g, f"{g}{i}", a, b, c, 2 * a if i % 3 else None, int(a + 2 * b + rnd.random() > 2.6 and g != "one")))
    return rows


def frames(spark, rows, parts):
    df = spark.createDataFrame(rows, "g string, k string, a double, b double, c double, d double, label int").repartition(parts)
    flags = (spark.createDataFrame([(g, arm) for g in sorted({r[0] for r in rows}) for arm in (0, 1)], "g string, arm int")
             .select("g", "arm", F.lit(1).alias("u_a"), F.lit(1).alias("u_b"), (F.col("arm") == 0).cast("int").alias("u_c"),
                     F.lit(1).alias("u_d")))
    return df, flags


def number(text):
    import hashlib
    return int(hashlib.md5(text.encode()).hexdigest()[:8], 16) % draws.PRIME


def plain_tree(rows, used, tree, forest):
    """Nodes ``(depth, feature, threshold, n0, n1)`` by trying every cut."""
    limits = draws.poisson_limits(forest.rate) if forest.rate else None
    data = []
    for r in rows:
        m = 1 if limits is None else sum(draws.scramble(number(f"{r[0]}/{r[1]}"), tree) >= x for x in limits)
        data += [([v or 0.0 for v in r[2:6]], r[6], m)] if m else []
    total = [sum(m for _, y, m in data if y == c) for c in (0, 1)]
    out = []

    def entropy(a, b):
        return 0.0 if a <= 0 or b <= 0 else -(a / (a + b) * math.log2(a / (a + b)) + b / (a + b) * math.log2(b / (a + b)))

    def grow(part, depth, key):
        n = [sum(m for _, y, m in part if y == c) for c in (0, 1)]
        best = None
        if min(n) and depth < forest.max_depth:
            order = sorted(used, key=lambda f: (draws.scramble(key, f), f))
            m = max(1, int(forest.features * len(used)))
            for at in range(0, len(order), m):
                for f in sorted(order[at:at + m]):
                    values = sorted({x[f] for x, _, _ in part})
                    for low, high in zip(values, values[1:]):
                        left = [sum(m for x, y, m in part if y == c and x[f] <= low) for c in (0, 1)]
                        l0, l1 = left[0] / total[0], left[1] / total[1]
                        g0, g1 = (n[0] - left[0]) / total[0], (n[1] - left[1]) / total[1]
                        cost = round(((l0 + l1) * entropy(l0, l1) + (g0 + g1) * entropy(g0, g1)) / (l0 + l1 + g0 + g1), 12)
                        if best is None or (cost, f, low) < best[:3]:
                            best = (cost, f, low, (low + high) / 2)
                if best:
                    break
        if not best:
            out.append((depth, None, None, n[0], n[1]))
            return
        _, f, _, threshold = best
        out.append((depth, FEATURES[f], round(threshold, 9), n[0], n[1]))
        grow([p for p in part if p[0][f] <= threshold], depth + 1, draws.scramble(key, 1))
        grow([p for p in part if p[0][f] > threshold], depth + 1, draws.scramble(key, 2))

    grow(data, 0, draws.scramble(tree, 7))
    return out


def found_nodes(df, flags, forest):
    models = trees.fit_forest(df, flags, ["g"], FEATURES, forest, ["g", "k"])
    rows = trees.forest_nodes(models, ["g"], FEATURES, df).collect()
    out = {}
    for r in rows:
        out.setdefault((r.g, r.arm, r.tree), []).append(
            (r.depth, r.feature, None if r.threshold is None else round(r.threshold, 9), r.n0, r.n1))
    return models, {k: sorted(v, key=repr) for k, v in out.items()}


@pytest.mark.parametrize("forest", [trees.Forest(1, None, 0.3, 6), trees.Forest(9, 0.4, 0.5)])
def test_trees_equal_a_plain_search(spark, forest):
    rows = table({"p": 60, "q": 23, "one": 9})
    df, flags = frames(spark, rows, 5)
    models, found = found_nodes(df, flags, forest)
    want = {(g, arm, t): sorted(plain_tree([r for r in rows if r[0] == g], [0, 1, 2, 3] if arm == 0 else [0, 1, 3], t, forest), key=repr)
            for g in ("p", "q", "one") for arm in (0, 1) for t in range(forest.trees)}
    assert found == want
    # another partitioning gives the same trees
    again, flags = frames(spark, rows, 1)
    assert found_nodes(again, flags, forest)[1] == found
    scores = {(r.g, r.arm, r.k): r.score for r in trees.score_forest(df, models, ["g"], FEATURES, ["k", "label"]).collect()}
    assert len(scores) == 2 * len(rows) and all(0 <= s <= 1 for s in scores.values())
    assert all(s == 0 for (g, _, _), s in scores.items() if g == "one")


def test_a_group_of_many_blocks_is_routed_as_it_was_counted(spark):
    """9,000 rows: three blocks and binned features; every train row reaches by
    its thresholds the leaf that counted it."""
    rows = table({"big": 9000, "p": 30}, seed=4)
    df, flags = frames(spark, rows, 3)
    forest = trees.Forest(1, None, 0.5, 5)
    models = trees.fit_forest(df, flags, ["g"], FEATURES, forest, ["g", "k"])
    nodes = {(r.g, r.arm, r.node): r for r in trees.forest_nodes(models, ["g"], FEATURES, df).collect()}
    counts = {}
    for r in rows:
        for arm in (0, 1):
            at = nodes[r[0], arm, 0]
            while at.feature is not None:
                at = nodes[r[0], arm, at.left if (r[2 + FEATURES.index(at.feature)] or 0.0) <= at.threshold else at.right]
            counts.setdefault((r[0], arm, at.node), [0, 0])[r[6]] += 1
    leaves = {k: [n.n0, n.n1] for k, n in nodes.items() if n.feature is None}
    assert counts == leaves and sum(k[0] == "big" for k in leaves) > 8


def test_no_rows_no_trees(spark):
    df, flags = frames(spark, table({"p": 12}), 1)
    models = trees.fit_forest(df.limit(0), flags, ["g"], FEATURES, trees.Forest(3, None, 0.5), ["g", "k"])
    assert models.count() == 0
    assert trees.score_forest(df, models, ["g"], FEATURES, ["k"]).count() == 0


def test_perceptron_gradient_is_that_of_the_loss():
    rng = np.random.default_rng(1)
    x, y = rng.random((20, 4)), rng.integers(0, 2, 20)
    w = perceptron.first_weights([0, 1, 3], 4)
    assert not w[:28].reshape(7, 4)[:, 2].any()
    _, gradient = perceptron.loss_and_gradient(w, x, y)
    for i in range(len(w)):
        step = np.zeros(len(w))
        step[i] = 1e-6
        slope = (perceptron.loss_and_gradient(w + step, x, y)[0] - perceptron.loss_and_gradient(w - step, x, y)[0]) / 2e-6
        assert slope == pytest.approx(gradient[i], abs=1e-6)


def test_perceptrons_of_one_and_of_many_blocks_agree(spark):
    df, flags = frames(spark, table({"p": 40, "q": 25}), 2)
    one = perceptron.fit_perceptrons(df, flags, ["g"], FEATURES, epochs=4)
    many = perceptron.fit_perceptrons(df, flags, ["g"], FEATURES, epochs=4, block=7)
    a, b = ({(r.gk, r.arm): (r.epoch, r.w) for r in m.collect()} for m in (one, many))
    assert a.keys() == b.keys() and len(a) == 4
    for k in a:
        assert a[k][0] == b[k][0] == 4 and np.allclose(a[k][1], b[k][1], atol=1e-12)
    scores = perceptron.score_perceptrons(df, one, ["g"], FEATURES, ["k"]).collect()
    assert len(scores) == 130 and all(0 < r.score < 1 and r.prediction == (r.score > 0.5) for r in scores)


@pytest.mark.parametrize("key", ["dt_nodes", "positive_score"])
def test_learners_equal_their_fits_in_sql(spark, key):
    """All six learners, both arms, all test files of the kept projects."""
    catalog.load_all()
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_SMALL}/{t}.parquet'")
    want = con.execute(catalog.ORACLE[key])
    names = [c[0] for c in want.description]
    rows = want.fetchall()
    got = [tuple(r) for r in catalog.QUERIES[key](spark, SF_SMALL).select(*names).collect()]
    assert rows and sorted(map(repr, got)) == sorted(map(repr, rows))
