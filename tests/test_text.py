"""Scalar column expressions: keys, paths, answer parsing, cell formatting."""

from pyspark.sql import functions as F

from binscore.functions import text as T
from binscore.operators import lookup


def one_col(spark, values, expr, dtype="string"):
    df = spark.createDataFrame([(v,) for v in values], f"x {dtype}")
    return [r[0] for r in df.select(expr(F.col("x")).alias("y")).collect()]


def test_normalise_key_strips_all_whitespace(spark):
    assert one_col(spark, ["\t Foo \n", "BAR", None], T.normalise_key) == ["foo", "bar", None]


def test_normalise_path(spark):
    got = one_col(spark, ["/a/./b//c", "//src/x/../y.txt", "a/b", "/../a", "a/../../b", None],
                  T.normalise_path)
    assert got == ["a/b/c", "src/y.txt", "a/b", None, None, None]


def test_clean_and_parse_answers(spark):
    vals = ["éno", "yes and no", "[INST] no [/INST] x [/INST] YES ", "eyes", " Performance bug: no",
            "No, or maybe yes", None]
    got = one_col(spark, vals, lambda c: T.parse_yes_no(T.clean_response(c)))
    assert got == [None, 1, 1, None, 0, 1, None]


def test_clean_response_keeps_last_segment(spark):
    got = one_col(spark, ["  A [/INST] b [/INST]  Last One \n"], T.clean_response)
    assert got == ["last one"]


def test_interpret_response(spark):
    got = one_col(spark, ["There is a potential issue", "fine", None, "SEVERAL things"],
                  T.interpret_response)
    assert got == [1, 0, 0, 1]


def test_interpreted_and_blank_errors(spark):
    df = spark.createDataFrame(
        [("  ", None, "There is a bug"), (None, None, None), (None, 1, "x"), ("Out of Memory", None, "potential")],
        "errors string, prediction int, response string")
    rows = df.select(T.has_error("errors").alias("e"), T.interpreted().alias("i")).collect()
    assert [(r.e, r.i) for r in rows] == [(False, None), (False, 0), (False, None), (True, None)]


def test_algorithm_short_name(spark):
    got = one_col(spark, ["DT with anti-pattern metrics", "DT without_anti-pattern_metrics", "artigenz"],
                  T.algorithm_short_name)
    assert got == ["DT", "DT without_anti-pattern_metrics", "artigenz"]


def test_mask_and_format_cells(spark):
    df = spark.createDataFrame([(0.0, 0.84), (0.045, 0.35), (0.112, 0.4), (None, 0.5), (0.04, 0.4)],
                               "p double, c double")
    out = df.select(T.format_cell("p", T.mask_significance("p", "c")).alias("cell")).collect()
    # a missing p prints as pandas prints NaN; its CLES is kept (NaN > 0.05 is false)
    assert [r.cell for r in out] == ["0 (0.84)", "0.045 (0.35)", "0.112 (--)", "nan (0.5)", "0.04 (0.4)"]


def test_map_with_default(spark):
    got = one_col(spark, ["qwen", "other"], lambda c: T.map_with_default(c, {"qwen": "Qwen"}))
    assert got == ["Qwen", "other"]


def test_alias_project(spark):
    got = one_col(spark, ["Openolat", "Exoplayer", "openolat", "x"], lookup.alias_project)
    assert got == ["OpenOLAT", "ExoPlayer", "openolat", "x"]


def test_whitespace_token_count(spark):
    got = one_col(spark, ["a b\tc\n\nd ", "", None], T.whitespace_token_count)
    assert got == [4, 0, None]


def test_no_python_udf_in_text_operators(spark):
    df = spark.createDataFrame([("a", None, None)], "response string, errors string, prediction int")
    plan = df.select(T.parse_yes_no(T.clean_response("response")), T.interpreted(), T.has_error("errors"),
                     T.fill_prediction("prediction", T.interpreted()))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan
