"""Scored answers feed the analysis; several models answer one prompt."""

from binscore.operators import score
from binscore.plans import inference
from conftest import SF_SMOKE


def test_models_answer_each_prompt_once(spark):
    long = "des " * (score.CONTEXT_TOKENS + 1)
    rows = spark.createDataFrame([(0, "for it"), (1, "then"), (2, long), (3, None), (4, "")],
                                 "id int, prompt_text string")
    got = {(r.id, r.model): r for r in score.score_models(rows, inference.PREDICTORS, keys=["id"]).collect()}
    assert len(got) == 15
    assert got[0, "artigenz"].prediction == 1 and got[0, "codellama"].prediction == 0
    assert got[1, "codellama"].prediction == 1 and got[1, "qwen"].prediction == 0
    # only the model with a limit refuses the long prompt, and only that one
    assert got[2, "qwen"].score_error == score.TOO_LONG and got[2, "qwen"].response is None
    assert got[2, "artigenz"].score_error is None and got[1, "qwen"].score_error is None
    assert all(got[3, m].response is None and got[3, m].score_error is None for m in inference.PREDICTORS)
    assert all(got[4, m].prediction == 0 and got[4, m].token_size == 0 for m in inference.PREDICTORS)


def test_empty_prompts_table(spark):
    rows = spark.createDataFrame([], "id int, prompt_text string")
    assert score.score_models(rows, inference.PREDICTORS, keys=["id"]).count() == 0


def test_scored_runs_have_every_configuration(spark):
    runs = inference.scored_runs(spark, SF_SMOKE)
    per = {tuple(r)[:3]: r["count"] for r in runs.groupBy("model", "comments_included", "prompting").count().collect()}
    assert len(per) == 12
    # the trees differ in text only, so both have the same prompts
    for (model, comments, style), n in per.items():
        assert n == per[model, not comments, style]


def test_source_tree_round_trip_and_clean_up(spark):
    from binscore import session
    from binscore.sources import files
    rows = [("p", "a/b.txt", "one"), ("p", "c.txt", ""), ("q r", "a/b.txt", "é\n")]
    df = spark.createDataFrame(rows, "project string, path string, text string")
    root = session.scratch_dir(spark, "tree")
    for _ in range(2):  # a repeated task replaces its files
        assert files.write_source_tree(df, root).count() == 3
    assert sorted(map(tuple, files.read_source_tree(spark, root).collect())) == sorted(rows)
    assert files.read_source_tree(spark, root, empty_files=False).count() == 2
    assert session.clear_scratch(spark) and not session.clear_scratch(spark)
