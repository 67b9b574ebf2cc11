"""Registered queries: inference output -> analysis -> comparison, in one go.

Prompts of both source trees and both styles are scored by the shipped
predictors, the raw output is cleaned and measured, and the best configuration
is compared with the six learners' scores on the same test files.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from binscore.functions.prompts import render_prompt
from binscore.operators import metrics
from binscore.operators.joins import cross_compare, pairwise_complete
from binscore.operators.score import CONTEXT_TOKENS, KEYWORDS, SECOND_KEYWORDS, THIRD_KEYWORDS, TOO_LONG, keyword_pattern
from binscore.plans import analysis, comparison, evaluation, inference
from binscore.plans.catalog import register
from binscore.plans import oracle_learners  # noqa: F401  (the learners' CTEs)
from binscore.plans.oracle import CONFUSION, clean, clone, cte, parse, ratio, sql, ws_tokens
from binscore.session import cut_lineage

# ---- the same steps in SQL, over the scored answers -----------------------------------

clone("nc_", ("zs_in", "fs_in"), {"files_with": "files_without"})

_INPUTS = (("zs_in", "true", "zeroShot"), ("fs_in", "true", "fewShot"),
           ("nc_zs_in", "false", "zeroShot"), ("nc_fs_in", "false", "fewShot"))
cte("pipe_prompts", tuple(i[0] for i in _INPUTS), "\n  UNION ALL ".join(
    f"SELECT doc_id, project_name, file, github_path, label, {comments} AS comments_included, '{style}' AS prompting, "
    f"failure, prompt_text, {ws_tokens('prompt_text')} AS n FROM {src}" for src, comments, style in _INPUTS))


def _answer(model: str, keywords, limit: int | None) -> str:
    refused = f"n > {limit}" if limit else "false"
    return f"""
  SELECT doc_id, project_name, file, github_path, label, '{model}' AS model, comments_included, prompting,
    CASE WHEN prompt_text IS NULL OR {refused} THEN NULL
         WHEN regexp_matches(prompt_text, '{keyword_pattern(keywords)}') THEN 'performance bug: YES'
         ELSE 'performance bug: NO' END AS response,
    CASE WHEN failure IS NOT NULL THEN failure WHEN {refused} THEN '{TOO_LONG}' END AS errors
  FROM pipe_prompts"""


_ANSWERS = " UNION ALL ".join([_answer("artigenz", KEYWORDS, None), _answer("codellama", SECOND_KEYWORDS, None),
                               _answer("qwen", THIRD_KEYWORDS, CONTEXT_TOKENS)])
cte("pipe_runs", ("pipe_prompts",),
    f"SELECT *, {parse(clean('response'))} AS prediction FROM ({_ANSWERS})")
clone("pipe_", ("error_keys", "runs_clean", "runs_eval", "summary", "project_metrics", "llm_best"), {"runs": "pipe_runs"})
cte("pipe_pairs", ("pipe_llm_best", "all_scores"), f"""
  SELECT l.project, l.model AS llm, m.algorithm AS ml, l.f1 AS llm_f1, m.f1 AS ml_f1
  FROM pipe_llm_best l JOIN (
    SELECT project, algorithm, {ratio('2 * tp', '2 * tp + fp + fn')} AS f1
    FROM (SELECT project, algorithm, {CONFUSION} FROM all_scores WHERE arm = 0 GROUP BY ALL)) m ON l.project = m.project
  WHERE l.f1 IS NOT NULL AND m.f1 IS NOT NULL""")
clone("pipe_", ("pair_d", "signed_rank", "cles", "paired_tests"), {"pairs": "pipe_pairs"})


# ---- prompts of the tree without comments (A5, B7, B8) ---------------------------------

@register("zero_shot_prompt_without", sql("SELECT doc_id, status, md5(prompt_text) AS prompt_md5 FROM nc_zs_in"))
def q_zero_shot_prompt_without(spark, sf_dir):
    z = inference.zero_shot_inputs(spark, sf_dir, "without")
    return z.select("doc_id", "status", F.md5(render_prompt("prompt").cast("binary")).alias("prompt_md5"))


@register("two_shot_prompt_without", sql("SELECT doc_id, status, md5(prompt_text) AS prompt_md5 FROM nc_fs_in"))
def q_two_shot_prompt_without(spark, sf_dir):
    f = inference.few_shot_inputs(spark, sf_dir, "without")
    return f.select("doc_id", "status", F.md5(render_prompt("prompt").cast("binary")).alias("prompt_md5"))


# ---- the connected pipeline --------------------------------------------------------------

@register("pipeline_runs", sql("""
  SELECT doc_id, model, comments_included, prompting, label, response, prediction, errors FROM pipe_runs"""))
def q_pipeline_runs(spark, sf_dir):
    """Raw output of 3 models x 2 trees x 2 styles."""
    return inference.scored_runs(spark, sf_dir).select(
        "doc_id", "model", "comments_included", "prompting", "label", "response", "prediction", "errors")


@register("pipeline_summary", sql("SELECT * FROM pipe_summary"))
def q_pipeline_summary(spark, sf_dir):
    """Scored answers -> C2 -> B13/B15 -> C3 -> D1."""
    return metrics.config_summary(analysis.evaluated_runs(spark, sf_dir, inference.scored_runs(spark, sf_dir)))


@register("pipeline_projects", sql("SELECT * FROM pipe_project_metrics"))
def q_pipeline_projects(spark, sf_dir):
    """Scored answers -> D2."""
    return metrics.project_metrics(analysis.evaluated_runs(spark, sf_dir, inference.scored_runs(spark, sf_dir)))


@register("pipeline_comparison", sql("""
  SELECT llm, ml, n_pairs, n, z, round(p_value, 9) AS p_value, p_rounded, cles, cles_rounded, cles_shown
  FROM pipe_paired_tests"""))
def q_pipeline_comparison(spark, sf_dir):
    """Scored answers (best configuration) against the six trained learners
    per project: H1/H2 -> C6 -> C7/C8 -> D22/D23 -> B26."""
    runs = analysis.evaluated_runs(spark, sf_dir, inference.scored_runs(spark, sf_dir))
    llm = analysis.best_config(metrics.project_metrics(runs)).select("project", "model", "f1")
    preds = cut_lineage(evaluation.all_predictions(spark, sf_dir))
    wide = comparison.wide_f1(llm, comparison.ml_metrics(spark, sf_dir, preds))
    pairs = cut_lineage(pairwise_complete(cross_compare(wide, comparison.LLM_NAMES, comparison.ML_NAMES)))
    return comparison.masked_tests(pairs).select(
        "llm", "ml", "n_pairs", "n", "z", F.round("p_value", 9).alias("p_value"), "p_rounded", "cles",
        "cles_rounded", "cles_shown")
