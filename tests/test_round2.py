"""Rows are neither lost nor misnumbered; rounding and trimming as specified."""

import pytest
from pyspark.sql import functions as F

from binscore.functions.text import strip_ws
from binscore.operators import ranking, score, stats


@pytest.mark.parametrize("conf", [{}, {"spark.sql.adaptive.enabled": "false"},
                                  {"spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
                                   "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1m"},
                                  {"spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
                                   "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8m"}])
def test_row_index_with_wide_payload(spark, conf):
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        df = spark.range(60_000).select(F.xxhash64("id").alias("k"), F.repeat(F.md5(F.col("id").cast("string")), 60).alias("p"))
        got = ranking.row_index(df, ["k"]).select("k", "row_index").toPandas().sort_values("row_index")
        assert got.row_index.tolist() == list(range(60_000))
        assert got.k.is_monotonic_increasing
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_predictor_with_too_few_answers_loses_nothing(spark):
    class Short:
        """Answers once, whatever it is asked; one prompt at a time is fine."""

        def __call__(self, texts):
            return [("yes", 1)]

    df = spark.createDataFrame([(i, f"p{i}") for i in range(6)], "id int, prompt_text string")
    rows = score.score_prompts(df, factory=Short, keys=["id"]).collect()
    assert len(rows) == 6 and all(r.response == "yes" for r in rows)


def test_threshold_sees_unrounded_correlation(spark):
    corr = spark.createDataFrame([("g", "a", "b", 0.7000000003)], "g string, col_a string, col_b string, r double")
    assert stats.correlated_features(corr, ["g"]).count() == 1


def test_trim_is_unicode_and_linear(spark):
    texts = ["\xa0Foo\xa0", "\x85yes\x1f", "a" + " " * 20_000 + "b", " \t "]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(strip_ws("t")).collect()]
    assert got == [t.strip() for t in texts]
