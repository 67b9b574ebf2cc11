"""The registered llm queries: SQL where there is some, held-out figures."""

import duckdb
import pytest
from pyspark.sql import functions as F

from binscore.llm.queries import ORACLE, QUERIES

SF_SMALL = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_SMALL}/{table}.parquet'")
    want = con.execute(ORACLE[name])
    names = [c[0] for c in want.description]
    got = QUERIES[name](spark, SF_SMALL)
    assert sorted(map(repr, map(tuple, got.select(*names).collect()))) == sorted(map(repr, want.fetchall()))


@pytest.mark.parametrize("name,label,least", [("op3_toxic_segments", "toxic", 0.9), ("op9_quality_trees", "quality", 0.95)])
def test_held_out_accuracy(spark, name, label, least):
    labels = spark.read.parquet(f"{SF_SMALL}/labels.parquet").select("doc_id", label)
    right = (QUERIES[name](spark, SF_SMALL).where("held_out").join(labels, "doc_id")
             .agg(F.avg((F.col("predicted") == F.col(label)).cast("double"))).first()[0])
    assert right >= least


def test_model_beats_the_base_on_held_out_texts(spark):
    row = QUERIES["op4_class_ngrams"](spark, SF_SMALL).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert row[0] > row[1]


def test_native_queries_run_no_python(spark):
    for name in ("op7_licence_scan", "op8_scaled_sketches"):
        plan = QUERIES[name](spark, SF_SMALL)._jdf.queryExecution().toString()
        assert "Python" not in plan and "Arrow" not in plan
