"""Driver contract and a DuckDB cross-check of registered queries on sf0.001."""

import os

import duckdb
import pytest

import __spark_entry__ as E
from binscore.sources.tables import TABLES, table_path
from conftest import SF_SMOKE

# the learners fit many models: test_learners.py holds them against SQL on sf0.01
SLOW = {"lr_train_score", "dt_train_score", "mlp_train_score", "svm_train_score", "rf_train_score",
        "evaluation_grid", "dt_nodes", "positive_score"}


def test_entry_flagship(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 12
    assert {"model", "comments_included", "prompting", "precision", "recall", "f1", "tp"} <= set(df.columns)
    assert all(r.total_inferences == 11 for r in rows)


def test_every_oracle_key_is_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())
    assert len(E.queries()) >= 90


def _norm(v):
    if isinstance(v, float):
        return round(v, 9)
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        p = table_path(SF_SMOKE, t)
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


FAST = sorted(k for k in E.oracle_sql() if k not in SLOW)


@pytest.mark.parametrize("key", FAST)
def test_query_matches_oracle(spark, duck, key):
    df = E.queries()[key](spark, SF_SMOKE)
    s_cols = df.columns
    s_rows = df.collect()
    res = duck.execute(E.oracle_sql()[key])
    d_cols = [c[0] for c in res.description]
    d_rows = res.fetchall()
    assert sorted(s_cols) == sorted(d_cols)

    def canon(cols, rows):
        order = sorted(range(len(cols)), key=lambda i: cols[i])
        return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)

    assert canon(s_cols, s_rows) == canon(d_cols, d_rows)


def test_scan_is_pruned_and_filters_pushed(spark):
    from pyspark.sql import functions as F
    df = E.queries()["scan_pruned"](spark, SF_SMOKE).where(F.col("doc_id") > 5)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,source:string>" in plan
    assert "PushedFilters: [IsNotNull(doc_id), GreaterThan(doc_id,5)]" in plan


def test_error_keys_anti_join_is_planned_without_python(spark):
    df = E.queries()["config_summary"](spark, SF_SMOKE)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "LeftAnti" in plan and "Python" not in plan
