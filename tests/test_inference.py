"""Source lookup, exemplars, prompts, scoring, file I/O, incremental runs."""

import os

import pytest

from binscore.functions.prompts import render_prompt, two_shot_prompt, zero_shot_prompt
from binscore.operators import joins, lookup, score
from binscore.plans import inference
from binscore.session import scratch_dir
from binscore.sources import files
from binscore.streaming import incremental


def test_pick_exemplars_tie_break_and_missing_class(spark):
    train = spark.createDataFrame(
        [("p", "/b", 1, 10), ("p", "/a", 1, 10), ("p", "/c", 0, None), ("p", "/d", 0, 50),
         ("q", "/x", 0, 1)], "project_name string, github_path string, label int, token_size bigint")
    got = [tuple(r) for r in joins.pick_exemplars(train).collect()]
    assert got == [("p", "/a", "/d")]  # size tie -> smaller path; NULL size last; q lacks a positive


def test_resolve_project_dirs_prefers_exact_then_lower_then_upper(spark):
    names = spark.createDataFrame([("Alpha",), ("beta",), ("Gamma",), ("delta",), (None,)], "project_name string")
    dirs = spark.createDataFrame([("Alpha",), ("alpha",), ("Beta",), ("gamma",)], "project string")
    got = {r.project_name: r.project_dir for r in lookup.resolve_project_dirs(names, dirs).collect()}
    assert got == {"Alpha": "Alpha", "beta": "Beta", "Gamma": "gamma", "delta": None}


def test_lookup_text_and_failure_texts(spark):
    files_df = spark.createDataFrame([("OpenOLAT", "src/a.txt", "AAA"), ("proj", "src/b.txt", "BBB")],
                                     "project string, path string, text string")
    df = spark.createDataFrame([("Openolat", "/src/./a.txt"), ("Proj", "//src/b.txt"), ("proj", "/src/zz.txt"),
                                ("proj", "/../b.txt")], "project_name string, github_path string")
    got = lookup.lookup_text(df, files_df, "github_path", "content").select(
        "project_name", "github_path", "content", lookup.failure_text(lookup.status_of("content"), False).alias("f"))
    rows = {(r.project_name, r.github_path): (r.content, r.f) for r in got.collect()}
    assert rows[("Openolat", "/src/./a.txt")] == ("AAA", None)
    assert rows[("Proj", "//src/b.txt")] == ("BBB", None)
    assert rows[("proj", "/src/zz.txt")] == (None, "File not found")
    assert rows[("proj", "/../b.txt")] == (None, "File not found")


def test_prompts_render(spark):
    df = spark.createDataFrame([("CODE", "POS", "NEG")], "c string, p string, n string")
    z = df.select(render_prompt(zero_shot_prompt("c")).alias("t")).first().t
    assert z.startswith("system: You are an AI binary performance bug classifier")
    assert z.endswith("user: Does the following code snippet contains any performance bug?CODE")
    msgs = df.select(two_shot_prompt("c", "p", "n").alias("m")).first().m
    assert [m.role for m in msgs] == ["system", "user", "assistant", "user", "assistant", "user"]
    assert msgs[1].content == "Does the following code snippet contain any performance bug?\nPOS\n"
    assert msgs[4].content == "performance bug: NO"


def test_scoring_isolates_failing_rows(spark):
    class FlakyPredictor:  # defined here so that it is shipped to the workers by value
        """Fails on any prompt containing BOOM (one bad row)."""

        def __call__(self, prompts):
            if any("BOOM" in p for p in prompts):
                raise RuntimeError("cannot score")
            return [("performance bug: YES", len(p.split())) for p in prompts]

    df = spark.createDataFrame([(1, "fine text"), (2, "BOOM here"), (3, None), (4, "ok")],
                               "id int, prompt_text string").repartition(1)
    got = {r.id: r for r in score.score_prompts(df, "prompt_text", FlakyPredictor, ["id"]).collect()}
    assert got[1].prediction == 1 and got[1].score_error is None and got[1].token_size == 2
    assert got[2].prediction is None and got[2].score_error == "cannot score"
    assert got[3].response is None and got[3].score_error is None
    assert got[4].prediction == 1


def test_keyword_predictor_is_whole_word():
    p = score.KeywordPredictor()
    out = p(["a while later", "awhile", "for-loop", "Forest", "x"])
    assert [r for r, _ in out] == [score.ANSWER_YES, score.ANSWER_NO, score.ANSWER_YES, score.ANSWER_NO,
                                   score.ANSWER_NO]


def test_latin1_fallback_and_source_tree(spark):
    root = scratch_dir(spark, "tree")
    os.makedirs(os.path.join(root, "proj", "src"))
    with open(os.path.join(root, "proj", "src", "latin.txt"), "wb") as fh:
        fh.write(b"caf\xe9")
    with open(os.path.join(root, "proj", "src", "utf8.txt"), "wb") as fh:
        fh.write("café".encode())
    got = {r.path: r.text for r in files.read_source_tree(spark, root).collect()}
    assert got == {"src/latin.txt": "café", "src/utf8.txt": "café"}


def test_csv_round_trip_and_na_tokens(spark):
    path = scratch_dir(spark, "csv")
    df = spark.createDataFrame([("a", " Performance bug: no", None, "  "), ("NA", "None", 1, None)],
                               "k string, response string, prediction int, errors string")
    files.write_csv_table(df, path)
    back = {r.k: r for r in files.read_csv_table(spark, path, "k string, response string, prediction int, "
                                                              "errors string").collect()}
    assert back["a"].response == " Performance bug: no" and back["a"].errors == "  "
    assert back[None].response is None and back[None].prediction == 1


def test_scan_runs_dir_file_names(spark):
    folder = scratch_dir(spark, "runs")
    df = spark.createDataFrame([("p", "f", "/f", 1, "yes", 1, None)],
                               "project_name string, file string, github_path string, label int, response string, "
                               "prediction int, errors string")
    for name in ["artigenz_withComments_zeroShot.csv", "codellama_withoutComments_fewShot.csv",
                 "qwen_withComments.csv", "llama_withComments_zeroShot.csv", "notes.csv"]:
        files.write_csv_table(df, os.path.join(folder, name))
    got = sorted((r.model, r.comments_included, r.prompting or "")
                 for r in files.scan_runs_dir(spark, folder, df.schema).collect())
    assert got == [("artigenz", True, "zeroShot"), ("codellama", False, "fewShot"), ("qwen", True, "")]


def test_combine_batches_none_when_empty(spark):
    assert files.combine_batches(spark, []) is None


def test_incremental_rerun_adds_nothing(spark):
    root = scratch_dir(spark, "inc")
    prompts = os.path.join(root, "prompts")
    df = spark.createDataFrame([(i, f"text {i} while" if i % 2 else f"text {i}") for i in range(20)],
                               "id int, prompt_text string")
    df.repartition(4).write.parquet(prompts)
    args = (spark, prompts, os.path.join(root, "out"), os.path.join(root, "ckpt"), df.schema, "prompt_text", ["id"])
    first = incremental.run_incremental(*args).count()
    second = incremental.run_incremental(*args).count()
    assert first == second == 20
    # new input files are picked up, old ones are not rescored
    spark.createDataFrame([(100, "for x")], df.schema).write.mode("append").parquet(prompts)
    out = incremental.run_incremental(*args)
    assert out.count() == 21 and out.where("id = 100").first().prediction == 1


@pytest.mark.parametrize("max_batches,expected", [(2, 10), (None, 37)])
def test_limit_batches(spark, max_batches, expected):
    df = spark.range(37).selectExpr("CAST(id AS STRING) AS k", "id").repartition(3)
    got = inference.limit_batches(df, ["id"], max_batches).collect()
    assert len(got) == expected
    assert all(r.batch_number == r.id // 5 for r in got)
