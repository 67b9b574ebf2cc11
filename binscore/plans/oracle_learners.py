"""DuckDB SQL that fits the learners again (I3-I8, I10): recursive queries over
the scaled features, which share no code with the Spark fits."""

from __future__ import annotations

import math

from binscore.plans.oracle import FEATS, cte

PRIME = 2147483647


def scr(x: str, y: str) -> str:
    """The row, tree and feature hash of the tree learners."""
    return (f"list_reduce([(({x})::BIGINT * 48271 + ({y})::BIGINT * 69621 + 12345) % {PRIME}, 1, 2, 3], "
            f"lambda v, k: (v * v + 16807 * v + k) % {PRIME})")


def draws(rate: float | None, h: str) -> str:
    """How often a tree draws a row: a Poisson quantile of the hash."""
    if rate is None:
        return "1"
    limits, term, total = [], math.exp(-rate), 0.0
    for j in range(12):
        total += term
        if total * PRIME >= PRIME - 1:
            break
        limits.append(int(total * PRIME))
        term *= rate / (j + 1)
    return "(" + " + ".join(f"({h} >= {x})::BIGINT" for x in limits) + ")"


cte("feature_at", (), "SELECT * FROM (VALUES " + ", ".join(f"('{f}', {i})" for i, f in enumerate(FEATS)) + ") t(feature, fi)")

cte("arm_used", ("used_features", "feature_at"), """
  SELECT u.project, u.arm, u.feature, f.fi, count(*) OVER (PARTITION BY u.project, u.arm) AS n_used
  FROM used_features u JOIN feature_at f USING (feature)""")

cte("ml_rows", ("ml_features",), f"""
  SELECT project, github_path, label, split, ('0x' || substr(md5(project || '/' || github_path), 1, 8))::BIGINT % {PRIME} AS k
  FROM ml_features""")


def _entropy(a: str, b: str) -> str:
    return (f"CASE WHEN {a} <= 0 OR {b} <= 0 THEN 0.0 ELSE -({a} / ({a} + {b}) * log2({a} / ({a} + {b})) "
            f"+ {b} / ({a} + {b}) * log2({b} / ({a} + {b}))) END")


def trees(name: str, n: int, rate: float | None, share: float, max_depth: int) -> None:
    """CTE ``name``: every row's way through every tree, level by level.  The
    node is its way from the root; rows of a finished node are ``done``."""
    cte(name, ("ml_rows", "arm_used", "scaled_long"), f"""
  SELECT * FROM (WITH RECURSIVE grow AS (
    SELECT *, sum(CASE WHEN label = 0 THEN m ELSE 0 END) OVER g AS r0, sum(CASE WHEN label = 1 THEN m ELSE 0 END) OVER g AS r1,
      '' AS node, {scr('tree', '7')} AS key, false AS done, 0::HUGEINT AS n0, 0::HUGEINT AS n1,
      NULL::VARCHAR AS p_feature, NULL::DOUBLE AS p_threshold, 0::HUGEINT AS p0, 0::HUGEINT AS p1
    FROM (SELECT r.project, a.arm, t.tree, r.github_path, r.label, r.split,
            CASE WHEN r.split = 'train' THEN {draws(rate, scr('r.k', 't.tree'))} ELSE 0 END AS m
          FROM ml_rows r JOIN (SELECT DISTINCT project, arm FROM arm_used) a USING (project), range({n}) t(tree)
          WHERE r.split IN ('train', 'test'))
    WHERE m > 0 OR split = 'test' WINDOW g AS (PARTITION BY project, arm, tree)
    UNION ALL
    (WITH cur AS (SELECT * FROM grow WHERE NOT done),
     nodes AS (
       SELECT project, arm, tree, node, any_value(key) AS key, any_value(r0)::DOUBLE AS r0, any_value(r1)::DOUBLE AS r1,
         sum(CASE WHEN label = 0 THEN m ELSE 0 END) AS t0, sum(CASE WHEN label = 1 THEN m ELSE 0 END) AS t1
       FROM cur GROUP BY ALL),
     live AS (SELECT * FROM nodes WHERE t0 > 0 AND t1 > 0 AND length(node) < {max_depth}),
     looks AS (
       SELECT n.*, u.feature, u.fi, (row_number() OVER (
           PARTITION BY n.project, n.arm, n.tree, n.node ORDER BY {scr('n.key', 'u.fi')}, u.fi) - 1)
         // greatest(1, floor({share} * u.n_used)::BIGINT) AS draw
       FROM live n JOIN arm_used u ON n.project = u.project AND n.arm = u.arm),
     counts AS (
       SELECT c.project, c.arm, c.tree, c.node, s.feature, s.x, sum(CASE WHEN c.label = 0 THEN m ELSE 0 END) AS c0,
         sum(CASE WHEN c.label = 1 THEN m ELSE 0 END) AS c1
       FROM cur c JOIN scaled_long s ON c.project = s.project AND c.github_path = s.github_path
       WHERE c.m > 0 GROUP BY ALL),
     cuts AS (
       SELECT l.*, c.x, lead(c.x) OVER w AS above, sum(c.c0) OVER w AS s0, sum(c.c1) OVER w AS s1
       FROM looks l JOIN counts c ON l.project = c.project AND l.arm = c.arm AND l.tree = c.tree AND l.node = c.node
         AND l.feature = c.feature
       WINDOW w AS (PARTITION BY l.project, l.arm, l.tree, l.node, l.feature ORDER BY c.x)),
     sides AS (SELECT *, s0 / r0 AS l0, s1 / r1 AS l1, (t0 - s0) / r0 AS g0, (t1 - s1) / r1 AS g1 FROM cuts WHERE above IS NOT NULL),
     best AS (
       SELECT project, arm, tree, node, arg_min({{'feature': feature, 'threshold': (x + above) / 2}}, (draw, cost, fi, x)) AS s
       FROM (SELECT *, round(((l0 + l1) * {_entropy('l0', 'l1')} + (g0 + g1) * {_entropy('g0', 'g1')}) / (l0 + l1 + g0 + g1), 12) AS cost
             FROM sides) GROUP BY ALL)
     SELECT c.project, c.arm, c.tree, c.github_path, c.label, c.split, c.m, c.r0, c.r1,
       CASE WHEN b.s IS NULL THEN c.node WHEN x.x <= b.s.threshold THEN c.node || '0' ELSE c.node || '1' END AS node,
       CASE WHEN b.s IS NULL THEN c.key ELSE {scr('c.key', 'CASE WHEN x.x <= b.s.threshold THEN 1 ELSE 2 END')} END AS key,
       b.s IS NULL AS done, n.t0 AS n0, n.t1 AS n1, b.s.feature AS p_feature, b.s.threshold AS p_threshold, n.t0 AS p0, n.t1 AS p1
     FROM cur c JOIN nodes n ON c.project = n.project AND c.arm = n.arm AND c.tree = n.tree AND c.node = n.node
     LEFT JOIN best b ON c.project = b.project AND c.arm = b.arm AND c.tree = b.tree AND c.node = b.node
     LEFT JOIN scaled_long x ON x.project = c.project AND x.github_path = c.github_path AND x.feature = b.s.feature))
  SELECT * FROM grow)""")


def forest_scores(source: str) -> str:
    """Test rows' mean share of class 1 over the trees that drew a row."""
    return f"""
  SELECT project, arm, github_path, label, round(score, 9) AS score, CAST(coalesce(score, 0.0) > 0.5 AS INTEGER) AS prediction FROM (
    SELECT project, arm, github_path, label, round(avg(w1 / (w0 + w1)) FILTER (WHERE n0 + n1 > 0), 12) AS score FROM (
      SELECT *, CASE WHEN n0 > 0 THEN n0::DOUBLE / r0::DOUBLE ELSE 0.0 END AS w0, CASE WHEN n1 > 0 THEN n1::DOUBLE / r1::DOUBLE ELSE 0.0 END AS w1
      FROM {source} WHERE done AND split = 'test')
    GROUP BY project, arm, github_path, label)"""


trees("dt_ways", 1, None, 0.3, 6)
trees("rf_ways", 500, 0.2, 0.2, 30)
cte("dt_scores", ("dt_ways",), forest_scores("dt_ways"))
cte("rf_scores", ("rf_ways",), forest_scores("rf_ways"))

#: One row per node of the decision trees.
DT_NODES = """
  SELECT project, arm, length(way)::INTEGER AS depth, feature, round(threshold, 12) AS threshold, n0::BIGINT AS n0, n1::BIGINT AS n1
  FROM (SELECT DISTINCT project, arm, left(node, length(node) - 1) AS way, p_feature AS feature, p_threshold AS threshold, p0 AS n0, p1 AS n1
        FROM dt_ways WHERE p_feature IS NOT NULL
        UNION ALL SELECT DISTINCT project, arm, node, NULL, NULL, n0, n1 FROM dt_ways WHERE done)"""


# ---- linear learners and the perceptron: one recursion step an update ----------------

D, H = len(FEATS), 7
WIDTH = H * D + 2 * H + 1

# a row per train file and arm: features that the arm does not use are zero
cte("arm_x", ("scaled_long", "feature_at", "arm_used"), """
  SELECT s.project, a.arm, s.github_path, s.label, s.split,
    list(CASE WHEN u.feature IS NULL THEN 0.0 ELSE s.x END ORDER BY f.fi) AS x
  FROM scaled_long s JOIN feature_at f USING (feature) JOIN (SELECT DISTINCT project, arm FROM arm_used) a ON a.project = s.project
  LEFT JOIN arm_used u ON u.project = s.project AND u.arm = a.arm AND u.feature = s.feature
  GROUP BY ALL""")


def _first_weights() -> str:
    place = f"range({WIDTH})"
    u = f"(2 * {scr('i', '5')}::DOUBLE / {PRIME} - 1)"
    return (f"list_transform({place}, lambda i: CASE WHEN i < {H * D} AND NOT list_contains(on_, i % {D}) THEN 0.0 "
            f"WHEN i < {H * D + H} THEN {u} * sqrt(6.0 / (len(on_) + {H})) ELSE {u} * sqrt(6.0 / {H + 1}) END)")


def _dot(x: str, w: str) -> str:
    return f"list_inner_product({x}, {w})"


_HIDDEN = f"list_transform(range({H}), lambda j: greatest(0.0, {_dot('x', f'w[j * {D} + 1 : j * {D} + {D}]')} + w[{H * D} + j + 1]))"
_OUT = f"{_dot('h', f'w[{H * D + H + 1} : {H * D + 2 * H}]')} + w[{WIDTH}]"
_PENALISED = f"(CASE WHEN i <= {H * D} OR i > {H * D + H} AND i < {WIDTH} THEN 1.0 ELSE 0.0 END)"
# the gradient of one row: place i (from 0)
_GRADIENT = f"""list_transform(range({WIDTH}), lambda i:
    CASE WHEN i < {H * D} THEN CASE WHEN h[i // {D} + 1] > 0 THEN dz * w[{H * D + H} + i // {D} + 1] * x[i % {D} + 1] ELSE 0.0 END
         WHEN i < {H * D + H} THEN CASE WHEN h[i - {H * D} + 1] > 0 THEN dz * w[i + {H} + 1] ELSE 0.0 END
         WHEN i < {H * D + 2 * H} THEN h[i - {H * D + H} + 1] * dz ELSE dz END)"""

cte("mlp_steps", ("arm_x", "arm_used"), f"""
  SELECT * FROM (WITH RECURSIVE net AS (
    SELECT project, arm, {_first_weights()} AS w, list_transform(range({WIDTH}), lambda i: 0.0::DOUBLE) AS m,
      list_transform(range({WIDTH}), lambda i: 0.0::DOUBLE) AS v, 0 AS epoch, 'infinity'::DOUBLE AS best, 0 AS stale
    FROM (SELECT project, arm, list(fi) AS on_ FROM arm_used GROUP BY ALL)
    UNION ALL
    (WITH cur AS (SELECT * FROM net WHERE epoch < 200 AND stale <= 10),
     ahead AS (
       SELECT project, arm, label, x, w, h, {_OUT} AS z FROM (
         SELECT r.project, r.arm, r.label, r.x, n.w, {_HIDDEN.replace("'x'", 'x')} AS h
         FROM cur n JOIN arm_x r USING (project, arm) WHERE r.split = 'train')),
     back AS (
       SELECT project, arm, greatest(z, 0) + ln(1 + exp(-abs(z))) - label * z AS loss, {_GRADIENT} AS g
       FROM (SELECT *, 1 / (1 + exp(-z)) - label AS dz FROM ahead)),
     sums AS (
       SELECT project, arm, list(s ORDER BY i) AS g FROM (
         SELECT project, arm, i, avg(p) AS s FROM (
           SELECT project, arm, unnest(g) AS p, unnest(range(1, {WIDTH + 1})) AS i FROM back) GROUP BY ALL) GROUP BY ALL),
     losses AS (SELECT project, arm, avg(loss) AS loss, count(*) AS n FROM back GROUP BY ALL),
     slope AS (
       SELECT c.*, l.loss + 0.5 * 0.0001 / l.n * list_sum(list_transform(range(1, {WIDTH + 1}), lambda i: {_PENALISED} * c.w[i] * c.w[i])) AS loss,
         list_transform(range(1, {WIDTH + 1}), lambda i: s.g[i] + 0.0001 / l.n * {_PENALISED} * c.w[i]) AS g
       FROM cur c JOIN sums s USING (project, arm) JOIN losses l USING (project, arm)),
     moved AS (
       SELECT *, list_transform(range(1, {WIDTH + 1}), lambda i: 0.9 * m[i] + 0.1 * g[i]) AS m2,
         list_transform(range(1, {WIDTH + 1}), lambda i: 0.999 * v[i] + 0.001 * g[i] * g[i]) AS v2,
         0.001 * sqrt(1 - pow(0.999::DOUBLE, epoch + 1)) / (1 - pow(0.9::DOUBLE, epoch + 1)) AS rate
       FROM slope)
     SELECT project, arm, list_transform(range(1, {WIDTH + 1}), lambda i: w[i] - rate * m2[i] / (sqrt(v2[i]) + 0.00000001)) AS w,
       m2 AS m, v2 AS v, epoch + 1 AS epoch, least(best, loss) AS best, CASE WHEN loss > best - 0.0001 THEN stale + 1 ELSE 0 END AS stale
     FROM moved))
  SELECT project, arm, arg_max(w, epoch) AS w, max(epoch) AS epoch FROM net GROUP BY project, arm)""")

cte("mlp_scores", ("mlp_steps", "arm_x"), f"""
  SELECT project, arm, github_path, label, round(1 / (1 + exp(-z)), 6) AS score, CAST(z > 0 AS INTEGER) AS prediction FROM (
    SELECT project, arm, github_path, label, {_OUT} AS z FROM (
      SELECT r.*, n.w, {_HIDDEN} AS h FROM arm_x r JOIN mlp_steps n USING (project, arm) WHERE r.split = 'test'))""")

cte("train_weight", ("ml_features",), """
  SELECT project, label, sum(count(*)) OVER (PARTITION BY project) / (2.0 * count(*)) AS weight
  FROM ml_features WHERE split = 'train' GROUP BY project, label""")

cte("linear_x", ("arm_x", "train_weight"), """
  SELECT r.project, r.arm, r.github_path, r.label, r.split, list_append(r.x, 1.0) AS x, t.weight::DOUBLE AS weight
  FROM arm_x r LEFT JOIN train_weight t ON t.project = r.project AND t.label = r.label""")


def linear(name: str, slope: str, bend: float, penalised_intercept: bool, steps: int) -> None:
    """CTEs ``<name>_steps`` and ``<name>_margins``: the one optimum by Nesterov's
    gradient steps of 1 / L (the Spark fit takes Newton steps)."""
    penalty = "1.0" if penalised_intercept else f"CASE WHEN i = {D + 1} THEN 0.0 ELSE 1.0 END"
    places = f"range(1, {D + 2})"
    cte(f"{name}_steps", ("linear_x",), f"""
  SELECT * FROM (WITH RECURSIVE fit AS (
    SELECT project, arm, list_transform({places}, lambda i: 0.0::DOUBLE) AS w, list_transform({places}, lambda i: 0.0::DOUBLE) AS y,
      1 + {bend} * sum(weight * {_dot('x', 'x')}) AS curve, 0 AS k
    FROM linear_x WHERE split = 'train' GROUP BY ALL
    UNION ALL
    (WITH part AS (
       SELECT project, arm, x, weight * {slope} AS p FROM (
         SELECT f.project, f.arm, r.x, r.label, r.weight, {_dot('r.x', 'f.y')} AS z
         FROM fit f JOIN linear_x r USING (project, arm) WHERE r.split = 'train' AND f.k < {steps})),
     slope AS (
       SELECT project, arm, list(g ORDER BY i) AS g FROM (
         SELECT project, arm, i, sum(p * v) AS g FROM (SELECT project, arm, p, unnest(x) AS v, unnest({places}) AS i FROM part) GROUP BY ALL)
       GROUP BY ALL),
     moved AS (
       SELECT f.*, list_transform({places}, lambda i: f.y[i] - (s.g[i] + {penalty} * f.y[i]) / f.curve) AS to_
       FROM fit f JOIN slope s USING (project, arm) WHERE f.k < {steps})
     SELECT project, arm, to_ AS w,
       list_transform({places}, lambda i: to_[i] + (sqrt(curve) - 1) / (sqrt(curve) + 1) * (to_[i] - w[i])) AS y, curve, k + 1 AS k
     FROM moved))
  SELECT project, arm, w FROM fit WHERE k = {steps})""")
    cte(f"{name}_margins", (f"{name}_steps", "linear_x"), f"""
  SELECT r.project, r.arm, r.github_path, r.label, {_dot('r.x', 'f.w')} AS z
  FROM linear_x r JOIN {name}_steps f USING (project, arm) WHERE r.split = 'test'""")


linear("lr", "(1 / (1 + exp(-z)) - label)", 0.25, False, 1500)
linear("svm", "(-2 * (2 * label - 1) * greatest(0.0, 1 - (2 * label - 1) * z))", 2.0, True, 3000)

cte("lr_scores", ("lr_margins",), """
  SELECT project, arm, github_path, label, round(1 / (1 + exp(-z)), 6) AS score, CAST(z > 0 AS INTEGER) AS prediction FROM lr_margins""")

# decision values on the scale of their group
cte("svm_scores", ("svm_margins",), """
  SELECT project, arm, github_path, label, round((z - min(z) OVER g) / nullif(max(z) OVER g - min(z) OVER g, 0), 6) AS score,
    CAST(z > 0 AS INTEGER) AS prediction
  FROM svm_margins WINDOW g AS (PARTITION BY project, arm)""")

cte("all_scores", ("cnb", "lr_scores", "dt_scores", "mlp_scores", "svm_scores", "rf_scores"), "\n  UNION ALL ".join(
    f"SELECT project, '{a}' AS algorithm, arm, github_path, label, round(score, 6) AS score, prediction FROM {t}"
    for a, t in (("CNB", "cnb"), ("LR", "lr_scores"), ("DT", "dt_scores"), ("MLP", "mlp_scores"), ("SVM", "svm_scores"),
                 ("RF", "rf_scores"))))
