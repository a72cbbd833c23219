"""Plan checks: work stays in the JVM, filters reach the scan, top-k is limited before the shuffle."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from tallyspark.operators import filters as B
from tallyspark.operators import ordered as E
from tallyspark.operators import relate as Rel
from tallyspark.operators import rollups as C
from tallyspark.plans import registry
from tallyspark.sources.testdata import households, ledger, users


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


SQL_OPS = [n for n in registry.ORACLE_SQL if not n.startswith(("stream_", "csv_", "json_", "append_", "versioned_"))
           and n not in ("note_keywords", "document_keywords", "encryption_roundtrip", "sensitive_columns")]


@pytest.mark.parametrize("name", SQL_OPS)
def test_no_python_in_sql_operators(spark, name):
    p = plan(registry.QUERIES[name](spark, SF_SMALL))
    assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p


def test_filters_and_projection_reach_the_scan(spark):
    from tallyspark.sources.testdata import ledger_view
    v = plan(ledger_view(spark, SF_SMALL).filter("tx_date >= date'2001-05-03'").select("user_id", "amount"))
    assert "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint,l_extendedprice:double,l_shipdate" in v
    assert "PushedFilters: [IsNotNull(o_orderdate), GreaterThanOrEqual(o_orderdate" in v
    stored = ledger(spark, SF_SMALL, with_month=True)
    p = plan(B.time_range(stored, "last_3_months", dt.date(2001, 8, 1)).select("user_id", "amount"))
    assert "PartitionFilters: [isnotnull(tx_month" in p and "(tx_month" in p
    assert "PushedFilters: [IsNotNull(tx_date), GreaterThanOrEqual(tx_date,2001-05-03)]" in p
    assert "ReadSchema: struct<user_id:bigint,amount:decimal(18,2),tx_date:date>" in p


def test_recent_uses_partial_window_group_limit(spark):
    p = plan(E.recent(ledger(spark, SF_SMALL), n=10))
    assert "WindowGroupLimit" in p and "Partial" in p


def test_latest_is_take_ordered(spark):
    p = plan(E.latest(ledger(spark, SF_SMALL), n=50))
    assert "TakeOrderedAndProject" in p


def test_monthly_rollup_has_partial_aggregation(spark):
    p = plan(C.monthly_in_out(ledger(spark, SF_SMALL)))
    assert p.count("HashAggregate") >= 2 and "partial_sum" in p


def test_household_summary_broadcasts_no_facts(spark):
    p = plan(registry.QUERIES["household_summary"](spark, SF_SMALL))
    assert "ShuffledHashJoin" in p and "Broadcast" not in p


def test_drop_known_reads_the_months_of_the_batch(spark):
    stored = ledger(spark, SF_SMALL, with_month=True)
    new = B.time_range(stored, "last_3_months", dt.date(2001, 8, 1))
    p = plan(Rel.drop_known(new, stored))
    assert p.count("PartitionFilters: [tx_month#") >= 1 or "PartitionFilters: [isnotnull(tx_month" in p
    assert all("2001-05" in part or "tx_month" not in part for part in p.split("PartitionFilters: ")[1:])


def test_enrich_forces_no_broadcast(spark):
    df = Rel.enrich(ledger(spark, SF_SMALL), users(spark, SF_SMALL), households(spark, SF_SMALL))
    assert "ResolvedHint" not in df._jdf.queryExecution().analyzed().toString()


REDUCERS = ("HashAggregate", "TakeOrderedAndProject", "WindowGroupLimit", "GlobalLimit", "LocalLimit",
            "CollectLimit", "ObjectHashAggregate", "SortAggregate")


def _single_partition_inputs(p: str) -> list[list[str]]:
    """For every single-partition exchange, the operators below it down to the next exchange or scan."""
    lines = p.split("\n")
    out = []
    for i, line in enumerate(lines):
        if "Exchange SinglePartition" not in line:
            continue
        depth = len(line) - len(line.lstrip(" :+-"))
        below = []
        for nxt in lines[i + 1:]:
            d = len(nxt) - len(nxt.lstrip(" :+-"))
            if d <= depth:
                break
            below.append(nxt.strip(" :+-"))
            if nxt.strip(" :+-").startswith(("Exchange", "FileScan", "Scan")):
                break
        out.append(below)
    return out


@pytest.mark.parametrize("name", SQL_OPS)
def test_no_single_partition_step_over_raw_rows(spark, name):
    # a whole-ledger key (by=[]) may gather into one partition only after an aggregate or a limit
    p = plan(registry.QUERIES[name](spark, SF_SMALL))
    for below in _single_partition_inputs(p):
        assert any(op.startswith(REDUCERS) for op in below), (name, below[:6])


def test_named_periods_and_date_ranges_prune_months(spark):
    stored = ledger(spark, SF_SMALL, with_month=True)
    for df in (Rel.compare_periods(stored, "this_month", "last_month", dt.date(2001, 8, 1)),
               B.multi_filter(stored, None, None, (dt.date(2000, 1, 1), dt.date(2000, 12, 31)))):
        p = plan(df)
        assert "PartitionFilters: [" in p and "PartitionFilters: []" not in p


def test_ledger_joins_orders_without_sorting(spark):
    """The line items meet their orders in hash tables, whatever the size of the orders."""
    from tallyspark.sources.testdata import ledger_view
    p = plan(ledger_view(spark, SF_SMALL))
    assert "ShuffledHashJoin" in p and "SortMergeJoin" not in p


def test_last_month_matrix_widens_the_last_month_alone(spark, make_ledger):
    """one wide row per key, keys may be null."""
    L = make_ledger([("1", 1, "expense", "a", 5, "2024-01-02"), ("2", 1, "expense", "a", 6, "2024-02-03"),
                     ("3", 1, "expense", "b", 7, "2024-02-09"), ("4", 2, "expense", "b", 8, "2024-01-05"),
                     ("5", 2, "income", "b", 9, "2024-03-05"), ("6", 3, "expense", "b", 9, None)])
    L = L.withColumn("user_id", F.expr("nullif(user_id, 2)"))
    m = C.last_month_matrix(L, ["a", "b"])
    assert "LeftSemi" in plan(m) and "Window" not in plan(m)
    rows = {(r["user_id"], r["month"], float(r["a"]), float(r["b"])) for r in m.collect()}
    assert rows == {(1, "2024-02", 6.0, 7.0), (None, "2024-01", 0.0, 8.0)}
    assert [r["month"] for r in C.last_month_matrix(L, ["a"], by=[]).collect()] == ["2024-02"]
    assert C.last_month_matrix(L.limit(0), ["a"], by=[]).count() == 0


def test_insight_report_deals_its_rollup_once(spark, make_ledger):
    """the parts are sums over a rollup that is dealt by key."""
    from tallyspark.plans.report import insight_report
    L = make_ledger([(str(i), i % 3, "expense" if i % 4 else "income", "ab"[i % 2], i, f"2024-0{1 + i % 5}-02") for i in range(60)])
    out = insight_report(L)
    out.collect()
    assert "Exchange hashpartitioning(user_id" in plan(out) and "REPARTITION_BY_NUM" in plan(out)
