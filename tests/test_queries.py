"""Every registered query of the library gives the rows of its SQL on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from ledgerloom.plans import registry


@pytest.fixture(scope="module")
def duck(small):
    db = duckdb.connect()
    for name in os.listdir(small):
        db.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{small}/{name}'")
    return db


def plain(frame: pd.DataFrame) -> list[tuple]:
    def value(v):
        if v is None or v is pd.NaT or (isinstance(v, float) and v != v) or v is pd.NA:
            return None
        return float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    frame = frame[sorted(frame.columns)]
    return sorted((tuple(value(v) for v in row) for row in frame.astype(object).itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(name, spark, duck, small):
    got = registry.QUERIES[name](spark, small).toPandas()
    want = duck.sql(registry.SQL[name]).df()
    assert len(want) > 0
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


def test_plans_stay_in_the_jvm(spark, small):
    """No query of the library runs Python on the executors, but for the three that fold ordered rows as a stream."""
    for name in ("q_flagship", "q_record_link", "q_rect_overlap_join", "q_label_value_score", "q_doc_json_ingest"):
        plan = registry.QUERIES[name](spark, small)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan


def test_scans_are_pruned(spark, small):
    plan = registry.QUERIES["q_review_state"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "props" not in plan


def test_entry_and_registry():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert len(registry.QUERIES) > 100


def test_a_response_is_parsed_once(spark, small):
    plan = registry.QUERIES["q_doc_json_ingest"](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 1 and plan.count("Relation ") == 1 and "Union" not in plan


def test_label_lookup_joins_nothing(spark, small):
    plan = registry.QUERIES["q_label_value_score"](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


@pytest.mark.parametrize(("name", "tables"), [("q_flagship", 5), ("q_assessment", 5), ("q_insights", 3), ("q_plans", 3), ("q_debt_breakdown", 3)])
def test_accounts_are_read_once(name, tables, spark, small):
    """Each table is scanned once, and at most four times rows are dealt out anew."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = registry.QUERIES[name](spark, small)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("FileScan parquet") == tables
    assert plan.count("Exchange hashpartitioning") <= (5 if tables == 5 else 3)


def test_lcs_is_worked_out_once_a_pair(spark, small):
    """Only the distinct pairs below an aggregate reach the step that measures them."""
    lines = registry.QUERIES["q_lcs"](spark, small)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    at = [k for k, line in enumerate(lines) if "bit_count" in line]
    assert len(at) == 1 and "Aggregate" in lines[at[0]] + lines[at[0] + 1]


@pytest.mark.parametrize("name", ["q_page_reorder", "q_missing_pages"])
def test_pages_are_dealt_once(name, spark, small):
    """Repeated pages go by the sort that their document needs anyway; no table of all pages is built."""
    plan = registry.QUERIES[name](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in plan
    assert registry.QUERIES[name](spark, small)._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
