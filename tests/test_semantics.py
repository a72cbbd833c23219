"""One test per null/empty/order rule the operators must keep, with hand-computed answers."""

import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from conftest import D, M, collect
from tallyspark.operators import filters as B
from tallyspark.operators import ordered as E
from tallyspark.operators import relate as Rel
from tallyspark.operators import rollups as C


def test_summary_stats_and_zero_income(make_ledger):
    L = make_ledger([
        ("1", 1, "income", "Salary", 1000, "2024-01-05"),
        ("2", 1, "expense", "Rent", 400, "2024-01-06"),
        ("3", 2, "expense", "Food", 50, "2024-01-07"),   # zero_income
    ])
    r = {x["user_id"]: x for x in collect(C.summary_stats(L))}
    assert r[1]["income"] == M(1000) and r[1]["expense"] == M(400) and r[1]["savings"] == M(600)
    assert r[1]["savings_rate"] == 60.0
    assert r[2]["income"] == M(0) and r[2]["savings"] == M(-50) and r[2]["savings_rate"] == 0.0
    g = {x["user_id"]: x for x in collect(C.goal_progress(L))}
    assert g[1]["progress_pct"] == 12.0 and g[1]["progress"] == 0.12
    assert g[2]["progress"] == 0.0


def test_null_category_left_out_of_groups_and_shares(make_ledger):
    L = make_ledger([
        ("1", 1, "expense", None, 10, "2024-01-05"),
        ("2", 1, "expense", "Food", 30, "2024-01-06"),
        ("3", 1, "expense", "Rent", 10, "2024-01-07"),
    ])
    cats = collect(C.expenses_by_category(L), ["category"])
    assert [c["category"] for c in cats] == ["Food", "Rent"]
    assert cats[0]["share"] == 0.75
    sh = collect(C.category_share(L), ["category"])
    assert [s["n"] for s in sh] == [1, 1] and sh[0]["share"] == 0.5
    filled = collect(B.fill_category(L), ["tx_id"])
    assert filled[0]["category"] == "Uncategorized"


def test_top_category_ties_break_by_name(make_ledger):
    L = make_ledger([
        ("1", 1, "expense", "Zoo", 20, "2024-01-05"),
        ("2", 1, "expense", "Art", 20, "2024-01-06"),
        ("3", 1, "expense", "Mid", 5, "2024-01-06"),
    ])
    top = collect(C.top_category(L))
    assert top[0]["category"] == "Art" and top[0]["pct"] == 20 / 45 * 100
    t3 = collect(C.top_categories(L, k=3), ["rank"])
    assert [t["category"] for t in t3] == ["Art", "Zoo", "Mid"]


def test_gap_months_trend_and_forecast_use_observed_months(make_ledger):
    # Jan 100, Feb 200, May 300 -> observed x = 0, 1, 2 (gaps ignored); an exact line -> next 400
    L = make_ledger([
        ("1", 1, "expense", "A", 100, "2024-01-10"),
        ("2", 1, "expense", "A", 200, "2024-02-10"),
        ("3", 1, "income", "B", 300, "2024-05-10"),
        ("4", 2, "expense", "A", 70, "2024-03-01"),   # one month
    ])
    tr = {x["user_id"]: x for x in collect(E.trend(L))}
    assert tr[1]["trend"] == "up" and tr[1]["n_months"] == 3
    assert tr[2]["trend"] == "single" and tr[2]["last_month"] == "2024-03"
    fc = {x["user_id"]: x for x in collect(E.forecast_next(L))}
    assert fc[1]["forecast_next_month"] == 400.0
    assert fc[2]["forecast_next_month"] == 70.0
    mi = collect(E.month_index(L, by=[]), ["month"])
    assert [m["idx"] for m in mi] == [0, 1, 2, 3]


def test_trend_down_and_mixed(make_ledger):
    L = make_ledger([
        ("1", 1, "expense", "A", 300, "2024-01-10"), ("2", 1, "expense", "A", 200, "2024-02-10"),
        ("3", 1, "expense", "A", 100, "2024-03-10"),
        ("4", 2, "expense", "A", 100, "2024-01-10"), ("5", 2, "expense", "A", 300, "2024-02-10"),
        ("6", 2, "expense", "A", 200, "2024-03-10"), ("7", 2, "expense", "A", 900, "2023-12-10"),
    ])
    tr = {x["user_id"]: x["trend"] for x in collect(E.trend(L))}
    assert tr == {1: "down", 2: "mixed"}


def test_weekly_alert(make_ledger):
    # weeks (Mon): 2024-01-01: 100, 2024-01-08: 100, 2024-01-15: 131 -> 131 > 1.3 * 100
    L = make_ledger([
        ("1", 1, "expense", "A", 100, "2024-01-03"), ("2", 1, "expense", "A", 100, "2024-01-14"),
        ("3", 1, "expense", "A", 131, "2024-01-15"),
        ("4", 2, "expense", "A", 50, "2024-01-03"),
    ])
    wa = {x["user_id"]: x for x in collect(E.weekly_alert(L))}
    assert wa[1]["alert"] is True and wa[1]["mean_prev"] == 100.0 and wa[1]["n_weeks"] == 3
    assert wa[1]["last_week"] == D("2024-01-15")
    assert wa[2]["alert"] is None and wa[2]["n_weeks"] == 1


def test_new_year_period_wrap(make_ledger):
    L = make_ledger([
        ("1", 1, "expense", "A", 10, "2023-12-31"), ("2", 1, "expense", "A", 20, "2024-01-02"),
        ("3", 1, "expense", "B", 5, "2023-11-30"),
    ])
    as_of = dt.date(2024, 1, 15)
    assert [r["tx_id"] for r in collect(B.period(L, "Last Month", as_of))] == ["1"]
    assert [r["tx_id"] for r in collect(B.period(L, "this_month", as_of))] == ["2"]
    assert sorted(r["tx_id"] for r in collect(B.period(L, "last_year", as_of))) == ["1", "3"]
    cmp = {r["category"]: r for r in collect(Rel.compare_periods(L, "this_month", "last_month", as_of))}
    assert set(cmp) == {"A"} and cmp["A"]["period1_total"] == M(20) and cmp["A"]["period2_total"] == M(10)


def test_validation_rules(spark):
    from tallyspark.schema import RAW_TX_SCHEMA
    rows = [
        ("1", "1", "2024-1-5", " Income ", "10", "Salary", "  "),
        ("2", "1", "2024-13-01", "expense", "5", "Food", "x"),
        ("3", "1", "01/02/2024", "expense", "5", "Food", None),
        ("4", "1", "", "gift", "abc", " ", None),
        ("5", "1", "2024-02-02", "expense", "0", "Food", None),
        ("6", "1", "2024-02-02", "expense", "-1", "Food", None),
    ]
    v = {r["id"]: r for r in collect(B.validate(spark.createDataFrame(rows, RAW_TX_SCHEMA)))}
    assert v["1"]["valid"] and v["1"]["tx_date"] == D("2024-01-05") and v["1"]["t_type"] == "income"
    assert v["1"]["note_clean"] is None
    assert v["2"]["reasons"] == ["date"] and v["3"]["reasons"] == ["date"]
    assert v["4"]["reasons"] == ["type", "amount", "category", "date"]
    assert v["5"]["reasons"] == ["amount"] and v["6"]["reasons"] == ["amount"]


def test_duplicates_compare_note_null_safely(make_ledger):
    stored = make_ledger([("1", 1, "expense", "Food", 10, "2024-01-05", None)])
    new = make_ledger([
        ("a", 1, "expense", "Food", 10, "2024-01-05", None),      # repeat of stored (null note)
        ("b", 1, "expense", "Food", 10, "2024-01-05", "lunch"),   # differs by note
        ("c", 1, "expense", "Food", 10, "2024-01-05", "lunch"),   # repeat within batch
        ("d", 2, "expense", "Food", 10, "2024-01-05", None),      # other user
    ])
    out = collect(Rel.drop_known(new, stored).select("user_id", "note"), ["user_id"])
    assert out == [{"user_id": 1, "note": "lunch"}, {"user_id": 2, "note": None}]


def test_orphans_and_members(spark):
    users = spark.createDataFrame([(1, "ann", "user", 10), (2, "bob", "admin", None), (3, "cy", "user", 99)],
                                  "user_id long, username string, role string, household_id long")
    hh = spark.createDataFrame([(10, "Home"), (11, "Empty")], "household_id long, name string")
    m = {r["name"]: r["members"] for r in collect(Rel.household_members(hh, users))}
    assert m == {"Home": 1, "Empty": 0}
    orphan = collect(Rel.orphans(users, hh, "household_id"))
    assert [o["username"] for o in orphan] == ["cy"]
    promoted = {r["username"]: r["role"] for r in collect(B.set_role(users, ["bob", "cy"], "user"))}
    assert promoted == {"ann": "user", "bob": "admin", "cy": "user"}


def test_recent_and_latest_order(make_ledger):
    rows = [(f"{i:02d}", 1, "expense", "A", 1, f"2024-01-{1 + i // 2:02d}") for i in range(14)]
    L = make_ledger(rows)
    r = collect(E.recent(L, n=10), ["pos"])
    assert [x["tx_id"] for x in r[:3]] == ["13", "12", "11"] and len(r) == 10
    assert [x["tx_id"] for x in collect(E.latest(L, n=2))] == ["13", "12"]


def test_savings_over_time_running_total(make_ledger):
    L = make_ledger([
        ("1", 1, "income", "S", 100, "2024-01-05"), ("2", 1, "expense", "R", 30, "2024-01-06"),
        ("3", 1, "expense", "R", 50, "2024-03-06"),
    ])
    s = collect(E.savings_over_time(L), ["month"])
    assert [(x["month"], x["savings"], x["cumulative_savings"]) for x in s] == [
        ("2024-01", M(70), M(70)), ("2024-03", M(-50), M(20))]
    st = collect(C.savings_stats(L))[0]
    assert st["current_savings"] == M(20) and st["avg_monthly_savings"] == 10.0


def test_project_zero_fills_and_extends(make_ledger):
    L = make_ledger([
        ("1", 1, "income", "S", 100, "2024-01-05"), ("2", 1, "income", "S", 200, "2024-02-05"),
        ("3", 1, "expense", "R", 30, "2024-02-06"),
    ])
    p = collect(E.project(L, periods=2), ["t_type", "month"])
    inc = [(x["month"], x["value"], x["is_forecast"]) for x in p if x["t_type"] == "income"]
    assert inc == [("2024-01", 100.0, False), ("2024-02", 200.0, False), ("2024-03", 300.0, True),
                   ("2024-04", 400.0, True)]
    exp = [(x["month"], x["value"]) for x in p if x["t_type"] == "expense"]
    assert exp == [("2024-01", 0.0), ("2024-02", 30.0), ("2024-03", 60.0), ("2024-04", 90.0)]


def test_audit_view_and_formats(make_ledger):
    L = make_ledger([("1", 1, "expense", "A", 1234.5, "2024-01-05", "n" * 60)])
    a = collect(B.audit_view(L))[0]
    assert a["note_short"] == "n" * 50 + "..." and a["amount_text"] == "$1234.50"
    f = collect(B.display_format(L))[0]
    assert f["expense_text"] == "$1,234.50" and f["savings_rate_text"] == "0.0%"


def test_null_audit_and_coverage(make_ledger):
    L = make_ledger([("1", 1, "expense", None, 5, None, None), ("2", 1, "income", "S", 7, "2024-01-01", "x")])
    n = collect(C.null_audit(L))[0]
    assert n["null_category"] == 1 and n["null_tx_date"] == 1 and n["null_note"] == 1 and n["null_total"] == 3
    cov = collect(C.coverage(L))[0]
    assert cov["n_rows"] == 2 and cov["n_categories"] == 1 and cov["min_date"] == D("2024-01-01")
    mo = collect(C.monthly_total(L))
    assert mo == [{"user_id": 1, "month": "2024-01", "total": M(7)}]   # null date dropped


def test_whole_ledger_key(make_ledger):
    L = make_ledger([("1", 1, "income", "S", 10, "2024-01-05"), ("2", 2, "expense", "R", 4, "2024-01-06")])
    s = collect(C.summary_stats(L, by=[]))
    assert len(s) == 1 and s[0]["savings"] == M(6)
    mm = collect(C.mini_metrics(L, by=[]))[0]
    assert mm["top_category"] == "R" and mm["total_amount"] == M(14)


def test_forecast_survives_sums_beyond_64_bits(make_ledger):
    rows = [(f"t{i}", 1, "income", "S", "90000000000000", f"{2000 + i // 12}-{i % 12 + 1:02d}-05") for i in range(84)]
    r = collect(E.forecast_next(make_ledger(rows)))[0]
    assert r["n"] == 84 and abs(r["forecast_next_month"] / 9e13 - 1) < 1e-9


def test_project_leaves_out_a_type_the_user_never_had(make_ledger):
    L = make_ledger([("a", 1, "income", "S", 10, "2024-01-05"), ("b", 1, "income", "S", 20, "2024-02-05")])
    assert {r["t_type"] for r in collect(E.project(L))} == {"income"}
