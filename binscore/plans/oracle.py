"""Independent DuckDB SQL for each registered query (the correctness gate).

The bindings of FIXTURES.md section 2 are written again here as CTEs over
the raw driver tables, so the SQL shares no code with the Spark plans.
``sql(name, body)`` prefixes ``body`` with the CTEs it needs.
"""

from __future__ import annotations

import re

TRIMMED = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
           "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")
R_YES = r"(^|[^\p{L}\p{N}_])yes($|[^\p{L}\p{N}_])"
R_NO = r"(^|[^\p{L}\p{N}_])no($|[^\p{L}\p{N}_])"
R_BUG = ("potential|contains|possible|has a few|several|small performance|minor issues|"
         "there are a few|there is a")


def strip(x: str) -> str:
    return f"trim({x}, '{TRIMMED}')"


def norm(x: str) -> str:
    return f"lower({strip(x)})"


def clean(x: str) -> str:
    return strip(f"string_split(lower({strip(x)}), '[/inst]')[-1]")


def parse(x: str) -> str:
    return (f"CASE WHEN regexp_matches({x}, '{R_YES}') THEN 1 "
            f"WHEN regexp_matches({x}, '{R_NO}') THEN 0 ELSE NULL END")


def interp(x: str) -> str:
    return f"CAST(regexp_matches(coalesce(lower({x}), ''), '{R_BUG}') AS INTEGER)"


def has_err(x: str) -> str:
    return f"({x} IS NOT NULL AND {strip(x)} <> '')"


def ratio(n: str, d: str) -> str:
    return f"coalesce(CAST({n} AS DOUBLE) / nullif(CAST({d} AS DOUBLE), 0), 0.0)"


def cnt(cond: str) -> str:
    return f"CAST(sum(CASE WHEN {cond} THEN 1 ELSE 0 END) AS BIGINT)"


CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def cte(name: str, deps: tuple[str, ...], body: str) -> None:
    CTES[name] = (deps, body)


cte("samples", (), """
  SELECT d.doc_id, d.source AS project_name,
         'doc_' || CAST(d.doc_id AS VARCHAR) || '.txt' AS file,
         '/src/doc_' || CAST(d.doc_id AS VARCHAR) || '.txt' AS github_path,
         l.toxic AS label, d.n_chars AS token_size,
         CASE WHEN (d.doc_id // 20) % 10 < 6 THEN 'train' ELSE 'test' END AS split,
         CASE WHEN d.doc_id % 41 = 0 THEN 0 ELSE 1 END AS file_available
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id""")

cte("cfg", (), """
  SELECT m.model, m.mi, c.ci, p.pi FROM (VALUES ('artigenz', 0), ('codellama', 1), ('qwen', 2)) m(model, mi),
    (VALUES (0), (1)) c(ci), (VALUES (0), (1)) p(pi)""")

cte("runs_raw", ("samples", "cfg"), """
  SELECT s.doc_id, s.project_name, s.file, s.github_path, s.label, cfg.model,
    cfg.ci = 1 AS comments_included,
    CASE WHEN cfg.pi = 1 THEN 'fewShot' ELSE 'zeroShot' END AS prompting,
    CASE ((s.doc_id // 20) * 7 + (s.doc_id % 20) * 3 + cfg.mi * 3 + cfg.ci * 2 + cfg.pi * 5 + s.label * 2) % 10
      WHEN 0 THEN 'performance bug: YES' WHEN 1 THEN 'performance bug: YES'
      WHEN 2 THEN ' Performance bug: no' WHEN 3 THEN ' Performance bug: no'
      WHEN 4 THEN 'performance bug: NO' WHEN 5 THEN '[INST] no [/INST] yes'
      WHEN 6 THEN 'There is a potential issue' WHEN 7 THEN 'The code looks fine'
      WHEN 8 THEN 'No, or maybe yes' ELSE NULL END AS response,
    CASE WHEN (s.doc_id // 20) % 53 = 7 AND cfg.mi = 0 THEN 'Out of Memory'
         WHEN (s.doc_id // 20) % 11 = 3 THEN '  ' ELSE NULL END AS errors
  FROM samples s, cfg WHERE s.split = 'test'""")

cte("runs", ("runs_raw",), f"""
  SELECT doc_id, project_name, file, github_path, label, model, comments_included, prompting, response,
    CASE WHEN {has_err('errors')} THEN NULL ELSE {parse(clean('response'))} END AS prediction, errors
  FROM runs_raw""")

cte("error_keys", ("runs",), f"""
  SELECT DISTINCT project_name, github_path FROM runs WHERE {has_err('errors')}""")

cte("runs_clean", ("runs", "error_keys"), f"""
  SELECT r.*, CASE WHEN r.errors IS NULL AND r.prediction IS NULL THEN {interp('r.response')}
                   ELSE NULL END AS interpreted
  FROM runs r ANTI JOIN error_keys e ON r.project_name = e.project_name AND r.github_path = e.github_path""")

cte("skipped_projects", ("samples",), f"""
  SELECT {norm('project_name')} AS project FROM samples WHERE split = 'test'
  GROUP BY project_name HAVING bool_and(coalesce(label = 0, false))""")

cte("runs_eval", ("runs_clean", "skipped_projects"), f"""
  SELECT * REPLACE (coalesce(prediction, interpreted) AS prediction, {norm('project_name')} AS project_name)
  FROM runs_clean WHERE {norm('project_name')} NOT IN (SELECT project FROM skipped_projects)""")

CONFUSION = ", ".join([
    f"{cnt('prediction = 0 AND label = 0')} AS tn", f"{cnt('prediction = 1 AND label = 0')} AS fp",
    f"{cnt('prediction = 0 AND label = 1')} AS fn", f"{cnt('prediction = 1 AND label = 1')} AS tp",
])
SCORES = (f"{ratio('tp', 'tp + fp')} AS precision, {ratio('tp', 'tp + fn')} AS recall, "
          f"{ratio('2 * tp', '2 * tp + fp + fn')} AS f1")

cte("summary", ("runs_eval",), f"""
  SELECT model, comments_included, prompting, total_inferences, responses, yes_no, heuristic,
    gt_true, gt_false, predicted_true, predicted_false,
    CASE WHEN n_pred > 0 THEN {ratio('tp', 'tp + fp')} END AS precision,
    CASE WHEN n_pred > 0 THEN {ratio('tp', 'tp + fn')} END AS recall,
    CASE WHEN n_pred > 0 THEN {ratio('2 * tp', '2 * tp + fp + fn')} END AS f1,
    CASE WHEN n_pred > 0 THEN tn END AS tn, CASE WHEN n_pred > 0 THEN fp END AS fp,
    CASE WHEN n_pred > 0 THEN fn END AS fn, CASE WHEN n_pred > 0 THEN tp END AS tp
  FROM (
    SELECT model, comments_included, prompting, count(*) AS total_inferences, count(response) AS responses,
      count(prediction) AS yes_no, count(interpreted) AS heuristic,
      {cnt('label = 1')} AS gt_true, {cnt('label = 0')} AS gt_false,
      {cnt('prediction = 1')} AS predicted_true, {cnt('prediction = 0')} AS predicted_false,
      count(prediction) AS n_pred, {CONFUSION}
    FROM runs_eval WHERE model IS NOT NULL AND comments_included IS NOT NULL AND prompting IS NOT NULL
    GROUP BY model, comments_included, prompting)""")

cte("project_metrics", ("runs_eval",), f"""
  SELECT project, model, comments_included, prompting, {SCORES}, tp, fp, tn, fn FROM (
    SELECT project_name AS project, model, comments_included, prompting, {CONFUSION}
    FROM runs_eval WHERE prediction IS NOT NULL AND project_name IS NOT NULL AND model IS NOT NULL
      AND comments_included IS NOT NULL AND prompting IS NOT NULL
    GROUP BY project_name, model, comments_included, prompting)""")


def clone(prefix: str, names: tuple[str, ...], sources: dict[str, str]) -> None:
    """The CTEs ``names`` again as ``<prefix><name>``, reading ``sources``'
    values for its keys (and each other's copies)."""
    other = sources | {n: prefix + n for n in names}
    for n in names:
        deps, body = CTES[n]
        body = re.sub(r"\b(FROM|JOIN)(\s+)(\w+)\b", lambda m: m[1] + m[2] + other.get(m[3], m[3]), body)
        cte(prefix + n, tuple(other.get(d, d) for d in deps), body)


def _needed(names: list[str]) -> list[str]:
    out: list[str] = []

    def visit(n: str) -> None:
        if n in out:
            return
        for d in CTES[n][0]:
            visit(d)
        out.append(n)

    for n in names:
        visit(n)
    return out


def sql(body: str) -> str:
    """Prefix ``body`` with the CTEs it references (by word match)."""
    used = [n for n in CTES if re.search(rf"\b{n}\b", body)]
    names = _needed(used)
    if not names:
        return body
    parts = [f"{n} AS ({CTES[n][1]}\n)" for n in names]
    return "WITH " + ",\n".join(parts) + "\n" + body


# ---- scores of the ML family and the comparison tables ----------------------------

cte("alg", (), """
  SELECT a.algorithm, a.ai, r.arm FROM (VALUES ('CNB', 0), ('LR', 1), ('DT', 2), ('MLP', 3), ('SVM', 4), ('RF', 5)) a(algorithm, ai),
    (VALUES (0), (1)) r(arm)""")

cte("predictions", ("samples", "alg"), """
  SELECT project, github_path, doc_id, algorithm, arm, label, score, CAST(score >= 0.5 AS INTEGER) AS prediction FROM (
    SELECT s.project_name AS project, s.github_path, s.doc_id, alg.algorithm, alg.arm, s.label,
      CAST(((s.doc_id // 20) * 37 + s.doc_id * 11 + alg.ai * 7 + alg.arm * 13 + s.label * 9) % 100 AS DOUBLE) / 100.0 AS score
    FROM samples s, alg WHERE s.split = 'test')""")

cte("pred_ranked", ("predictions",), """
  SELECT *, rank() OVER (PARTITION BY project, algorithm, arm ORDER BY score)
       + (count(*) OVER (PARTITION BY project, algorithm, arm, score) - 1) / 2.0 AS avg_rank
  FROM predictions""")

cte("auc", ("pred_ranked",), """
  SELECT project, algorithm, arm,
    (sum(CASE WHEN label = 1 THEN avg_rank ELSE 0 END) - CAST(sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS DOUBLE)
       * (sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) + 1) / 2.0)
     / nullif(CAST(sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) * sum(CASE WHEN label = 0 THEN 1 ELSE 0 END) AS DOUBLE), 0)
     AS auc
  FROM pred_ranked GROUP BY project, algorithm, arm""")

cte("ml_eval", ("predictions", "auc"), f"""
  SELECT c.project, c.algorithm, c.arm, CASE WHEN a.auc = 0 THEN NULL ELSE a.auc END AS auc,
    {ratio('c.tp + c.tn', 'c.n')} AS accuracy, {ratio('c.tp', 'c.tp + c.fp')} AS precision,
    {ratio('c.tp', 'c.tp + c.fn')} AS recall, {ratio('2 * c.tp', '2 * c.tp + c.fp + c.fn')} AS f1,
    c.tp, c.fp, c.tn, c.fn
  FROM (SELECT project, algorithm, arm, count(*) AS n, {CONFUSION} FROM predictions GROUP BY ALL) c
  LEFT JOIN auc a ON c.project = a.project AND c.algorithm = a.algorithm AND c.arm = a.arm""")

cte("ml_metrics", ("ml_eval",), """
  SELECT project, algorithm || CASE WHEN arm = 0 THEN ' with anti-pattern metrics'
                                    ELSE ' without_anti-pattern_metrics' END AS algorithm_metric,
    auc, accuracy, precision, recall, f1, tp, fp, tn, fn FROM ml_eval""")

cte("llm_best", ("project_metrics",), """
  SELECT project, model, f1 FROM project_metrics WHERE comments_included AND prompting = 'fewShot'""")

_LLM = ("artigenz", "codellama", "qwen")
_ML = ("CNB", "DT", "LR", "MLP", "RF", "SVM")
cte("f1_wide", ("llm_best", "ml_metrics"), """
  SELECT coalesce(l.project, m.project) AS project, """
    + ", ".join(f'l."{x}"' for x in _LLM) + ", " + ", ".join(f'm."{x}"' for x in _ML) + """
  FROM (SELECT project, """
    + ", ".join(f"max(CASE WHEN model = '{x}' THEN f1 END) AS \"{x}\"" for x in _LLM) + """
        FROM llm_best GROUP BY project) l
  FULL OUTER JOIN (SELECT project, """
    + ", ".join(f"max(CASE WHEN algorithm_metric = '{x} with anti-pattern metrics' THEN f1 END) AS \"{x}\""
                for x in _ML) + """
        FROM ml_metrics GROUP BY project) m ON l.project = m.project""")

cte("f1_long", ("f1_wide",), "\n  UNION ALL ".join(
    f"SELECT project, '{x}' AS name, \"{x}\" AS f1, '{'llm' if x in _LLM else 'ml'}' AS family FROM f1_wide"
    for x in (*_LLM, *_ML)))

cte("pairs", ("f1_long",), """
  SELECT l.project, l.name AS llm, m.name AS ml, l.f1 AS llm_f1, m.f1 AS ml_f1
  FROM f1_long l JOIN f1_long m ON l.project = m.project
  WHERE l.family = 'llm' AND m.family = 'ml' AND l.f1 IS NOT NULL AND m.f1 IS NOT NULL""")

cte("pair_d", ("pairs",), "SELECT llm, ml, project, llm_f1 - ml_f1 AS d FROM pairs")

cte("signed_rank", ("pair_d",), """
  SELECT c.llm, c.ml, c.n_pairs, coalesce(s.n, 0) AS n, coalesce(s.r_plus, 0.0) AS r_plus,
    coalesce(s.r_minus, 0.0) AS r_minus, CAST(coalesce(t.tie_term, 0) AS BIGINT) AS tie_term,
    CASE WHEN coalesce(s.n, 0) > 0 THEN
      (least(s.r_plus, s.r_minus) - CAST(s.n AS DOUBLE) * (s.n + 1) / 4.0)
      / sqrt((CAST(s.n AS DOUBLE) * (s.n + 1) * (2.0 * s.n + 1) - 0.5 * CAST(coalesce(t.tie_term, 0) AS DOUBLE)) / 24.0)
    END AS z
  FROM (SELECT llm, ml, count(*) AS n_pairs FROM pair_d GROUP BY ALL) c
  LEFT JOIN (
    SELECT llm, ml, count(*) AS n, sum(CASE WHEN d > 0 THEN rank ELSE 0.0 END) AS r_plus,
      sum(CASE WHEN d < 0 THEN rank ELSE 0.0 END) AS r_minus
    FROM (SELECT llm, ml, d, rank() OVER (PARTITION BY llm, ml ORDER BY abs(d))
              + (count(*) OVER (PARTITION BY llm, ml, abs(d)) - 1) / 2.0 AS rank
          FROM pair_d WHERE d <> 0)
    GROUP BY ALL) s ON c.llm = s.llm AND c.ml = s.ml
  LEFT JOIN (
    SELECT llm, ml, sum(t * (t * t - 1)) AS tie_term
    FROM (SELECT llm, ml, abs(d) AS ad, count(*) AS t FROM pair_d WHERE d <> 0 GROUP BY ALL) GROUP BY ALL
  ) t ON c.llm = t.llm AND c.ml = t.ml""")

cte("cles", ("pairs",), """
  SELECT llm, ml, count(*) AS n_pairs,
    CASE WHEN count(*) >= 2 THEN avg(CASE WHEN llm_f1 > ml_f1 THEN 1.0 WHEN llm_f1 = ml_f1 THEN 0.5 ELSE 0.0 END) END AS cles
  FROM pairs GROUP BY ALL""")


# subsets of the ranks 1..n by their sum (exact signed-rank distribution)
cte("rank_counts", (), """
  SELECT * FROM (WITH RECURSIVE counts(n, s, c) AS (
    SELECT 0, 0, 1.0::DOUBLE
    UNION ALL
    SELECT n + 1, s + take * (n + 1), sum(c) FROM counts, (VALUES (0), (1)) t(take) WHERE n < 50
    GROUP BY n + 1, s + take * (n + 1))
  SELECT n, s, c FROM counts)""")

# normal tail: erf(x) = 2/sqrt(pi) exp(-x^2) sum_k 2^k x^(2k+1) / (1 3 .. (2k+1))
_X = "(abs(z) / sqrt(2.0))"
_TAIL = (f"CASE WHEN z = 0 THEN 1.0 ELSE greatest(0.0, 1.0 - 2.0 / sqrt(pi()) * exp(-{_X} * {_X}) * list_sum(list_transform("
         f"range(0, 300), lambda k: exp((2 * k + 1) * ln({_X}) + 2 * k * ln(2.0) + lgamma(k + 1) - lgamma(2 * k + 2))))) END")
cte("paired_tests", ("signed_rank", "rank_counts", "cles"), f"""
  SELECT llm, ml, n_pairs, n, z, p AS p_value, round_even(p, 3) AS p_rounded, cles, round_even(cles, 2) AS cles_rounded,
    CASE WHEN round_even(p, 3) > 0.05 THEN '--'
         ELSE coalesce(CAST(round_even(cles, 2) AS VARCHAR), 'nan') END AS cles_shown
  FROM (SELECT s.llm, s.ml, s.n_pairs, s.n, s.z, c.cles,
    CASE WHEN s.n_pairs < 2 OR s.n = 0 THEN NULL
         WHEN s.n_pairs <= 50 AND s.n = s.n_pairs THEN
           CASE WHEN floor(s.r_plus) = (s.n * (s.n + 1) // 2) // 2 THEN 1.0
                ELSE least(1.0, 2.0 * least(
                  (SELECT sum(k.c) FROM rank_counts k WHERE k.n = s.n AND k.s <= floor(s.r_plus)),
                  (SELECT sum(k.c) FROM rank_counts k WHERE k.n = s.n AND k.s >= floor(s.r_plus))) / pow(2.0, s.n)) END
         ELSE {_TAIL} END AS p
    FROM signed_rank s JOIN cles c ON s.llm = c.llm AND s.ml = c.ml)""")


# ---- feature matrix and the closed-form learners ----------------------------------

FEATS = ("f_chars", "f_words", "f_lines", "f_commas", "f_periods", "f_upper_the", "f_no", "f_const", "f_dup")
ABLATABLE = ("f_commas", "f_periods", "f_no")


def occ(t: str, x: str) -> str:
    return f"CAST(length({t}) - length(replace({t}, '{x}', '')) AS DOUBLE) / {len(x)}"


cte("features", ("samples",), f"""
  SELECT s.doc_id, s.project_name, s.file, s.github_path, s.token_size, s.file_available, s.label, s.split,
    {norm('s.project_name')} AS project,
    CAST(s.token_size AS DOUBLE) AS f_chars, {occ('d.text', ' ')} + 1.0 AS f_words,
    {occ('d.text', chr(10))} + 1.0 AS f_lines, {occ('d.text', ',')} AS f_commas, {occ('d.text', '.')} AS f_periods,
    {occ('d.text', 'The')} AS f_upper_the, {occ('d.text', 'no')} AS f_no, 1.0 AS f_const,
    ({occ('d.text', ' ')} + 1.0) * 2.0 AS f_dup
  FROM samples s JOIN documents d ON s.doc_id = d.doc_id""")

cte("skip_rule", ("samples",), f"""
  SELECT coalesce(tr.project, te.project) AS project, coalesce(tr.n, 0) AS n_train, coalesce(te.n, 0) AS n_test,
    coalesce(tr.pos, 0) AS pos_train, coalesce(te.pos, 0) AS pos_test,
    CASE WHEN coalesce(tr.n, 0) = 0 AND coalesce(te.n, 0) = 0 THEN 'no_split'
         WHEN coalesce(tr.pos, 0) = 0 OR coalesce(te.pos, 0) = 0 THEN 'no_positive' END AS skip_reason
  FROM (SELECT {norm('project_name')} AS project, count(*) AS n, {cnt('label = 1')} AS pos
        FROM samples WHERE split = 'train' GROUP BY 1) tr
  FULL OUTER JOIN (SELECT {norm('project_name')} AS project, count(*) AS n, {cnt('label = 1')} AS pos
        FROM samples WHERE split = 'test' GROUP BY 1) te ON tr.project = te.project""")

cte("ml_features", ("features", "skip_rule"), """
  SELECT * FROM features WHERE project IN (SELECT project FROM skip_rule WHERE skip_reason IS NULL)""")

_CORR_COLS = ("label", *FEATS)
_PAIRS = [(i, a, j, b) for i, a in enumerate(_CORR_COLS) for j, b in enumerate(_CORR_COLS) if j > i]


def _masked(x: str, y: str) -> str:
    return f"CASE WHEN {x} IS NOT NULL AND {y} IS NOT NULL THEN CAST({x} AS DOUBLE) END"


cte("corr_wide", ("ml_features",), "SELECT project, " + ", ".join(
    f"covar_pop({_masked(a, b)}, {_masked(b, a)}) AS cov_{i}_{j}, stddev_pop({_masked(a, b)}) AS sa_{i}_{j}, "
    f"stddev_pop({_masked(b, a)}) AS sb_{i}_{j}" for i, a, j, b in _PAIRS) + " FROM ml_features GROUP BY project")

cte("corr", ("corr_wide",), "\n  UNION ALL ".join(
    f"SELECT project, '{a}' AS col_a, {i} AS pos_a, '{b}' AS col_b, {j} AS pos_b, "
    f"round(cov_{i}_{j} / nullif(sa_{i}_{j} * sb_{i}_{j}, 0), 9) AS r FROM corr_wide" for i, a, j, b in _PAIRS))

_ABL = ", ".join(f"'{x}'" for x in ABLATABLE)
cte("dropped", ("corr",), f"""
  SELECT DISTINCT project, 0 AS arm, col_a AS feature FROM corr WHERE abs(r) > 0.7 AND col_a <> 'label'
  UNION SELECT DISTINCT project, 1 AS arm, col_a AS feature FROM corr
    WHERE abs(r) > 0.7 AND col_a <> 'label' AND col_a NOT IN ({_ABL}) AND col_b NOT IN ({_ABL})""")

cte("used_features", ("skip_rule", "dropped"), f"""
  SELECT k.project, a.arm, f.feature FROM (SELECT project FROM skip_rule WHERE skip_reason IS NULL) k,
    (VALUES (0), (1)) a(arm), (VALUES {', '.join(f"('{x}')" for x in FEATS)}) f(feature)
  WHERE NOT (a.arm = 1 AND f.feature IN ({_ABL}))
    AND (k.project, a.arm, f.feature) NOT IN (SELECT project, arm, feature FROM dropped)""")

cte("feat_long", ("ml_features",), "\n  UNION ALL ".join(
    f"SELECT project, github_path, label, split, '{x}' AS feature, CAST({x} AS DOUBLE) AS x FROM ml_features"
    for x in FEATS))

cte("minmax", ("feat_long",), """
  SELECT project, feature, min(x) AS lo, max(x) AS hi FROM feat_long WHERE split = 'train' GROUP BY ALL""")

cte("scaled_long", ("feat_long", "minmax"), """
  SELECT f.project, f.github_path, f.label, f.split, f.feature,
    (f.x - m.lo) / CASE WHEN m.hi - m.lo = 0 THEN 1.0 ELSE m.hi - m.lo END AS x
  FROM feat_long f JOIN minmax m ON f.project = m.project AND f.feature = m.feature""")

cte("cnb_weights", ("scaled_long", "used_features"), """
  SELECT project, arm, feature, -ln(q0 / sum(q0) OVER (PARTITION BY project, arm)) AS w0,
    -ln(q1 / sum(q1) OVER (PARTITION BY project, arm)) AS w1
  FROM (SELECT s.project, u.arm, s.feature,
          0.001 + sum(CASE WHEN s.label = 1 THEN s.x ELSE 0.0 END) AS q0,
          0.001 + sum(CASE WHEN s.label = 0 THEN s.x ELSE 0.0 END) AS q1
        FROM scaled_long s JOIN used_features u ON s.project = u.project AND s.feature = u.feature
        WHERE s.split = 'train' GROUP BY ALL)""")

cte("cnb", ("scaled_long", "cnb_weights"), """
  SELECT project, arm, github_path, label, round(1.0 / (1.0 + exp(jll0 - jll1)), 9) AS score,
    CASE WHEN jll1 > jll0 THEN 1 ELSE 0 END AS prediction
  FROM (SELECT s.project, w.arm, s.github_path, s.label, sum(s.x * w.w0) AS jll0, sum(s.x * w.w1) AS jll1
        FROM scaled_long s JOIN cnb_weights w ON s.project = w.project AND s.feature = w.feature
        WHERE s.split = 'test' GROUP BY ALL)""")


# ---- inference: source text, exemplars, prompts, keyword scorer ---------------------

def lit(s: str) -> str:
    """A Python string as a DuckDB string expression (newlines via chr(10))."""
    parts = [("'" + p.replace("'", "''") + "'") for p in s.split("\n")]
    return " || chr(10) || ".join(parts)


# prompt wording (fixed values, restated for the oracle)
_ZS_SYS = ("You are an AI binary performance bug classifier that identifies whether the provided code contains "
           "perforamnce bug or not.Provide response only in following format: performance bug: <YES or NO>"
           "Do not include anything else in response.")
_ZS_Q = "Does the following code snippet contains any performance bug?"
_FS_SYS = ("You are an AI binary classifier tasked with identifying whether a code file contains performance bugs. "
           "Respond only in the following format: performance bug: <YES or NO>. Do not include anything else in "
           "the response. ")
_FS_Q = "Does the following code snippet contain any performance bug?\n"
_KW = r"(^|[^\p{L}\p{N}_])(while|for|loop)($|[^\p{L}\p{N}_])"
_WS = r"[ \t\n\r\f]+"


def zs_render(c: str) -> str:
    return f"'system: ' || {lit(_ZS_SYS)} || chr(10) || 'user: ' || {lit(_ZS_Q)} || {c}"


def fs_render(c: str, pos: str, neg: str) -> str:
    def ask(x):
        return f"'user: ' || {lit(_FS_Q)} || {x} || chr(10)"
    return " || chr(10) || ".join([f"'system: ' || {lit(_FS_SYS)}", ask(pos), "'assistant: performance bug: YES'",
                                    ask(neg), "'assistant: performance bug: NO'", ask(c)])


def ws_tokens(x: str) -> str:
    return f"CAST(len(list_filter(regexp_split_to_array({x}, '{_WS}'), lambda t: t <> '')) AS BIGINT)"


def kw_response(x: str) -> str:
    return (f"CASE WHEN {x} IS NULL THEN NULL WHEN regexp_matches({x}, '{_KW}') "
            f"THEN 'performance bug: YES' ELSE 'performance bug: NO' END")


cte("files_with", (), """
  SELECT doc_id, source AS project, 'src/doc_' || CAST(doc_id AS VARCHAR) || '.txt' AS path, text
  FROM documents WHERE doc_id % 43 <> 0""")

cte("files_without", (), """
  SELECT doc_id, source AS project, 'src/doc_' || CAST(doc_id AS VARCHAR) || '.txt' AS path,
    CASE WHEN instr(text, chr(10)) > 0 THEN substr(text, instr(text, chr(10)) + 1) ELSE text END AS text
  FROM documents WHERE doc_id % 43 <> 0""")

cte("exemplars", ("samples",), """
  SELECT project_name, max(CASE WHEN label = 1 THEN github_path END) AS positive_example,
    max(CASE WHEN label = 0 THEN github_path END) AS negative_example
  FROM (SELECT project_name, label, github_path, row_number() OVER (
          PARTITION BY project_name, label ORDER BY token_size ASC NULLS LAST, github_path) AS rn
        FROM samples WHERE split = 'train' AND label IN (0, 1))
  WHERE rn = 1 GROUP BY project_name
  HAVING max(CASE WHEN label = 1 THEN github_path END) IS NOT NULL
     AND max(CASE WHEN label = 0 THEN github_path END) IS NOT NULL""")

cte("zs_in", ("samples", "files_with"), f"""
  SELECT s.doc_id, s.project_name, s.file, s.github_path, s.label, f.text AS content,
    CASE WHEN f.text IS NOT NULL THEN 1 ELSE -1 END AS status,
    CASE WHEN f.text IS NULL THEN 'File not found' END AS failure,
    CASE WHEN f.text IS NOT NULL THEN {zs_render('f.text')} END AS prompt_text
  FROM samples s LEFT JOIN files_with f ON f.project = s.project_name AND f.path = ltrim(s.github_path, '/')
  WHERE s.split = 'test' AND s.file_available = 1""")

cte("fs_in", ("samples", "files_with", "exemplars"), f"""
  SELECT doc_id, project_name, file, github_path, label, positive_example, negative_example, content,
    CASE WHEN ok THEN 1 ELSE -1 END AS status,
    CASE WHEN NOT ok THEN 'Failed to read or File not found' END AS failure,
    CASE WHEN ok THEN {fs_render('content', 'pos_text', 'neg_text')} END AS prompt_text
  FROM (SELECT s.doc_id, s.project_name, s.file, s.github_path, s.label, e.positive_example, e.negative_example,
          f.text AS content, p.text AS pos_text, n.text AS neg_text,
          f.text IS NOT NULL AND p.text IS NOT NULL AND n.text IS NOT NULL AS ok
        FROM samples s JOIN exemplars e ON s.project_name = e.project_name
        LEFT JOIN files_with f ON f.project = s.project_name AND f.path = ltrim(s.github_path, '/')
        LEFT JOIN files_with p ON p.project = s.project_name AND p.path = ltrim(e.positive_example, '/')
        LEFT JOIN files_with n ON n.project = s.project_name AND n.path = ltrim(e.negative_example, '/')
        WHERE s.split = 'test')""")


def _scored(src: str, few: bool) -> str:
    ex = "positive_example, negative_example, " if few else ""
    return f"""
  SELECT doc_id, project_name, file, github_path, label, {ex}response,
    {parse(clean('response'))} AS prediction, failure AS errors,
    CASE WHEN prompt_text IS NOT NULL THEN {ws_tokens('prompt_text')} END AS token_size
  FROM (SELECT *, {kw_response('prompt_text')} AS response FROM {src})"""


cte("zs_scored", ("zs_in",), _scored("zs_in", False))
cte("fs_scored", ("fs_in",), _scored("fs_in", True))
