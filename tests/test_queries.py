"""Registered queries against their SQL on the smallest tables; the full set is run by
``check_sql.py``."""

import os
import re

import duckdb
import pytest

import __spark_entry__ as entry
from check_sql import TABLES, rows_of

FOLDER = "/root/testdata/sf0.001"
SOME = ("range_audit null_fraction categorical_profile wear_signals chunk_dedup chunk_pack vector_topk "
        "section_ranges model_audit external_inputs maintenance_due wear_fold "
        "column_headings column_parts contents_pages state_audit profile_files maintenance_files").split()


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
@pytest.mark.parametrize("name", SOME)
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    df = entry.queries()[name](spark, FOLDER)
    result = db.execute(entry.oracle_sql()[name])
    assert rows_of(df.columns, df.collect()) == rows_of(
        [d[0] for d in result.description], result.fetchall())


def test_coerced_values_of_odd_events(spark, tmp_path):
    rows = [(i, kind, value) for i, (kind, value) in enumerate(
        [(k, v) for k in ("click", "view", "error", "signup", "purchase", "other", None) for v in (0.00015, 64.82685, -0.00465, 1e300, 3.0, None)])]
    spark.createDataFrame(rows, "event_id long, event_type string, value double").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    df = entry.queries()["coerced_values"](spark, str(tmp_path))
    result = db.execute(entry.oracle_sql()["coerced_values"])
    assert rows_of(df.columns, df.collect()) == rows_of([d[0] for d in result.description], result.fetchall())


def test_rounds_as_sql(spark):
    from millrace.functions.numeric import round_half
    values = [0.00015, 0.00465, 64.82685, -64.82685, 1e300, float("inf"), 0.2224575, 2.5e-7, None]
    got = [tuple(r) for r in spark.createDataFrame([(v,) for v in values], "v double").select(round_half("v", 4), round_half("v", 6)).collect()]
    db = duckdb.connect()
    assert got == [db.execute("SELECT round(?::DOUBLE, 4), round(?::DOUBLE, 6)", [v, v]).fetchone() for v in values]


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_limits_of_an_audit_are_broadcast(spark):
    plan = entry.queries()["range_audit"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and not re.search(r"hashpartitioning\(c#\d+, \d+\)", plan)
