"""Registered queries: one per operator, each over the driver tables.

``QUERIES[name](spark, sf_dir)`` returns the operator's result in
presentation form (``present``: money as double from exact sums, dates as
ISO text).  ``ORACLE_SQL[name]`` is an independent DuckDB statement over the
same tables computing the same bag of rows.  Operators without an exact SQL
twin (models, sampling, streaming) have no oracle entry.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.functions.columns import present
from tallyspark.operators import filters as B
from tallyspark.operators import ordered as E
from tallyspark.operators import quality as Q
from tallyspark.operators import relate as D
from tallyspark.operators import rollups as C
from tallyspark.plans import report as R
from tallyspark.session import ship_package
from tallyspark.sources import files as A
from tallyspark.sources.testdata import (HOUSEHOLDS_SQL, LEDGER_SQL, USERS_SQL, audit_events, households,
                                         ledger, users)

# ---- fixed query parameters ----
AS_OF = dt.date(2001, 8, 1)
AS_OF_SQL = "date '2001-08-01'"
# the categories of the driver tables, which the SQL twins name as columns; the queries read them from the data
EXPENSE_CATS = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
ERASED_HOUSEHOLDS = ["NATION_3", "NATION_7"]
FOUND_WORDS = ["promo", "urgent"]      # words that occur in the driver tables' categories
PROMOTED_USERS = ["Customer#000000001", "Customer#000000002", "Customer#000000100"]


def _L(spark, d):
    """The stored ledger with its ``tx_month`` partition column (dropped again by ``run``)."""
    return ledger(spark, d, with_month=True)


def raw_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw text rows (as from a form or CSV) derived from the audit events.

    Types, amounts, categories and date formats are mixed so every validation
    rule both passes and fails somewhere.
    """
    e = audit_events(spark, sf_dir)
    return e.select(
        F.col("event_id").cast("string").alias("id"),
        F.col("user_id").cast("string").alias("user_id"),
        F.when(F.col("event_type") == "click", F.date_format("ts", "MM/dd/yyyy"))
         .otherwise(F.date_format("ts", "yyyy-M-d")).alias("date"),
        F.when(F.col("event_type") == "purchase", F.lit("expense"))
         .when(F.col("event_type") == "signup", F.lit(" Income ")).otherwise(F.col("event_type")).alias("type"),
        (F.col("value") - 10).cast("decimal(18,2)").cast("string").alias("amount"),
        F.when(F.col("event_type") == "error", F.lit(" ")).otherwise(F.col("event_type")).alias("category"),
        F.when(F.col("event_type") == "view", F.lit("")).otherwise(F.col("props")).alias("note"),
    )


RAW_SQL = """
select cast(event_id as varchar) id, cast(user_id as varchar) user_id,
       case when event_type = 'click' then strftime(ts, '%m/%d/%Y') else strftime(ts, '%Y-%-m-%-d') end date,
       case when event_type = 'purchase' then 'expense' when event_type = 'signup' then ' Income ' else event_type end type,
       cast(cast(value - 10 as decimal(18,2)) as varchar) amount,
       case when event_type = 'error' then ' ' else event_type end category,
       case when event_type = 'view' then '' else props end note
from events
"""


def _validated(spark, d):
    v = B.validate(raw_transactions(spark, d))
    return v.withColumn("reasons", F.array_join("reasons", ","))


def _drop_known(spark, d):
    L = _L(spark, d)
    recent = B.time_range(L, "last_3_months", AS_OF)
    new = recent.withColumn("tx_date", F.date_add("tx_date", 1)).unionByName(recent)
    return D.drop_known(new, L).select(*D.DUP_COLS)


QUERIES = {
    # --- C: aggregations ---
    "monthly_in_out": lambda s, d: C.monthly_in_out(_L(s, d)),
    "summary_stats": lambda s, d: C.summary_stats(_L(s, d)),
    "summarize": lambda s, d: C.summarize(_L(s, d)),
    "dashboard_totals": lambda s, d: C.dashboard_totals(_L(s, d)),
    "expenses_by_category": lambda s, d: C.expenses_by_category(_L(s, d)),
    "top_category": lambda s, d: C.top_category(_L(s, d)),
    "monthly_averages": lambda s, d: C.monthly_averages(_L(s, d)),
    "monthly_total": lambda s, d: C.monthly_total(_L(s, d)),
    "weekly_total": lambda s, d: C.weekly_total(_L(s, d)),
    "monthly_expense": lambda s, d: C.monthly_expense(_L(s, d)),
    "category_matrix": lambda s, d: C.category_matrix(_L(s, d), C.expense_categories(_L(s, d))),
    "last_month_matrix": lambda s, d: C.last_month_matrix(_L(s, d), C.expense_categories(_L(s, d))),
    "category_share": lambda s, d: C.category_share(_L(s, d)),
    "mini_metrics": lambda s, d: C.mini_metrics(_L(s, d)),
    "coverage": lambda s, d: C.coverage(_L(s, d)),
    "categories": lambda s, d: C.categories(_L(s, d)),
    "system_overview": lambda s, d: C.system_overview(users(s, d), households(s, d), _L(s, d)),
    "mean_amount": lambda s, d: C.mean_amount(_L(s, d)),
    "null_audit": lambda s, d: C.null_audit(ledger(s, d)),
    "savings_stats": lambda s, d: C.savings_stats(_L(s, d)),
    "goal_progress": lambda s, d: C.goal_progress(_L(s, d)),
    "whole_ledger_summary": lambda s, d: C.summary_stats(_L(s, d), by=[]),
    "household_summary": lambda s, d: C.summary_by_group(_L(s, d), users(s, d)),
    # --- E / F / H1 / H2: ordered ---
    "savings_over_time": lambda s, d: E.savings_over_time(_L(s, d)),
    "trend": lambda s, d: E.trend(_L(s, d)),
    "trend_expense": lambda s, d: E.trend(_L(s, d), types=["expense"]),
    "weekly_alert": lambda s, d: E.weekly_alert(_L(s, d)),
    "last_month_total": lambda s, d: E.last_month_total(_L(s, d)),
    "recent": lambda s, d: E.recent(_L(s, d)),
    "month_index": lambda s, d: E.month_index(_L(s, d)),
    "ordered": lambda s, d: E.ordered(_L(s, d)),
    "latest": lambda s, d: E.latest(_L(s, d)),
    "latest_events": lambda s, d: E.latest_events(audit_events(s, d)),
    "top_categories": lambda s, d: C.top_categories(_L(s, d)),
    "forecast_next": lambda s, d: E.forecast_next(_L(s, d)),
    "forecast_next_ledger": lambda s, d: E.forecast_next(_L(s, d), by=[]),
    "project": lambda s, d: E.project(_L(s, d)),
    # --- D: joins ---
    "enrich": lambda s, d: D.enrich(_L(s, d), users(s, d), households(s, d)),
    "active_users": lambda s, d: D.active_users(users(s, d), _L(s, d)),
    "compare_periods": lambda s, d: D.compare_periods(_L(s, d), "This Month", "Last Month", AS_OF),
    "compare_years": lambda s, d: D.compare_periods(_L(s, d), "this_year", "last_year", AS_OF),
    "drop_known": _drop_known,
    "household_members": lambda s, d: D.household_members(households(s, d), users(s, d)),
    "erase_households": lambda s, d: D.erase_households(_L(s, d), users(s, d), households(s, d),
                                                        ERASED_HOUSEHOLDS)[0],
    "uniqueness_violations": lambda s, d: D.uniqueness_violations(users(s, d), "username"),
    "orphans": lambda s, d: D.orphans(_L(s, d), users(s, d), "user_id"),
    "orphan_users": lambda s, d: D.orphans(users(s, d), households(s, d), "household_id"),
    "shared_households": lambda s, d: D.uniqueness_violations(users(s, d), "household_id"),
    "orphan_rows": lambda s, d: D.orphans(_L(s, d), B.coerce_role(users(s, d)).filter(F.col("role") == "user"), "user_id"),
    "homeless_users": lambda s, d: D.orphans(
        users(s, d), households(s, d).filter(~F.col("name").isin(ERASED_HOUSEHOLDS)), "household_id"),
    "erase_users": lambda s, d: D.erase_users(_L(s, d), users(s, d), PROMOTED_USERS)[0],
    "ledger_for_users": lambda s, d: D.ledger_for_users(
        _L(s, d), users(s, d).filter(F.col("household_id") == 1)),
    "users": lambda s, d: users(s, d),
    "households": lambda s, d: households(s, d),
    # --- B: filters and validation ---
    "of_type": lambda s, d: B.of_type(_L(s, d), "expense"),
    "validate": _validated,
    "lenient_date": lambda s, d: B.lenient_date(raw_transactions(s, d)).select("id", "date", "tx_date"),
    "time_range": lambda s, d: B.time_range(_L(s, d), "last_3_months", AS_OF),
    "this_year": lambda s, d: B.time_range(_L(s, d), "this_year", AS_OF),
    "period": lambda s, d: B.period(_L(s, d), "last_month", AS_OF),
    "multi_filter": lambda s, d: B.multi_filter(_L(s, d), ["PROMO", "STANDARD"], ["expense"],
                                                (dt.date(2000, 1, 1), dt.date(2000, 12, 31))),
    "browse": lambda s, d: B.browse(_L(s, d), "expense", "PROMO", "amount"),
    "search_users": lambda s, d: B.search_users(users(s, d), "customer#00000001"),
    "search_households": lambda s, d: B.search_households(households(s, d), users(s, d), "nation_1"),
    "fill_category": lambda s, d: B.fill_category(_L(s, d)),
    "labelled_notes": lambda s, d: B.labelled_notes(_L(s, d)),
    "audit_view": lambda s, d: B.audit_view(_L(s, d)),
    "validate_accounts": lambda s, d: B.validate_accounts(users(s, d), households(s, d))[0],
    "validate_households": lambda s, d: B.validate_accounts(users(s, d), households(s, d))[1],
    "coerce_role": lambda s, d: B.coerce_role(users(s, d)),
    "keyword_series": lambda s, d: B.keyword_series(_L(s, d)),
    "keyword_series_found": lambda s, d: B.keyword_series(_L(s, d), FOUND_WORDS),
    "set_role": lambda s, d: B.set_role(users(s, d), PROMOTED_USERS, "admin"),
    # --- I: quality ---
    "imbalance": lambda s, d: Q.imbalance(_L(s, d)),
    "underrepresented": lambda s, d: Q.underrepresented(_L(s, d)),
    "missing_verdict": lambda s, d: Q.missing_verdict(ledger(s, d)),
    "audit_summary": lambda s, d: Q.audit_summary(audit_events(s, d)),
    # --- H14 / A ---
    "insight_list": lambda s, d: R.insight_list(_L(s, d)),
    "export_users": lambda s, d: A.export_users(users(s, d)),
    "export_ledger": lambda s, d: A.export_ledger(_L(s, d)),
    "evolve": lambda s, d: A.evolve(users(s, d).drop("role"), {"role": "user"}),
}


def run(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    df = QUERIES[name](spark, sf_dir)
    return present(df.drop("tx_month") if name not in KEEP_MONTH else df)


KEEP_MONTH: set[str] = set()


# ---------------------------------------------------------------- oracle SQL
def _with(*ctes: str) -> str:
    parts = {"ledger": LEDGER_SQL, "users": USERS_SQL, "households": HOUSEHOLDS_SQL, "raw": RAW_SQL}
    return "with " + ", ".join(f"{c} as ({parts[c]})" for c in ctes) + "\n"


LEDGER_COLS = ("tx_id, user_id, t_type, category, cast(amount as double) amount, "
               "strftime(tx_date, '%Y-%m-%d') tx_date, note")
INC = "coalesce(sum(case when t_type = 'income' then amount end), 0)"
EXP = "coalesce(sum(case when t_type = 'expense' then amount end), 0)"
MONTH = "strftime(tx_date, '%Y-%m')"
WEEK = "date_trunc('week', tx_date)"
MONTHLY_IO = f"""m as (select user_id, {MONTH} as month, {INC} income, {EXP} expense
                 from ledger where tx_date is not null group by 1, 2)"""
MONTHLY_T = f"""m as (select user_id, {MONTH} as month, sum(amount) total
                 from ledger where tx_date is not null group by 1, 2)"""
C4 = """c4 as (select user_id, category, sum(amount) total from ledger
                where t_type = 'expense' and category is not null group by 1, 2),
        c4s as (select *, cast(total as double) / cast(sum(total) over (partition by user_id) as double) share from c4)"""
SUMMARY = f"""s as (select user_id, {INC} income, {EXP} expense from ledger group by 1)"""
RATE = "case when income > 0 then cast(income - expense as double) / cast(income as double) * 100 else 0.0 end"
FIT = """f as (select user_id, count(*) n, sum(x) sx, sum(x * x) sxx, sum(y) sy, sum(x * y) sxy,
                max(month) last_month, arg_max(y, month) y_last from x group by 1)"""


def _dbl(*cols):
    return ", ".join(f"cast({c} as double)" for c in cols)


def _slope_sql():
    n, sx, sxx, sy, sxy = (f"cast({c} as double)" for c in ("n", "sx", "sxx", "sy", "sxy"))
    return f"(({n} * {sxy} - {sx} * {sy}) / ({n} * {sxx} - {sx} * {sx}))"


def _predict_sql(x):
    n, sx, sy = (f"cast({c} as double)" for c in ("n", "sx", "sy"))
    return f"(({sy} / {n} + {_slope_sql()} * (cast({x} as double) - {sx} / {n})) / 100)"


def _matrix_cols():
    return ", ".join(f"cast(coalesce(sum(case when category = '{c}' then amount end), 0) as double) \"{c}\""
                     for c in EXPENSE_CATS)


def _period_sql(lo, hi):
    return f"(tx_date >= date '{lo}' and tx_date < date '{hi}')"


ORACLE_SQL = {
    "monthly_in_out": _with("ledger") + f"""
        select user_id, {MONTH} as month, cast({INC} as double) income, cast({EXP} as double) expense
        from ledger where tx_date is not null group by 1, 2""",
    "summary_stats": _with("ledger") + f"""{', ' + SUMMARY}
        select user_id, cast(income as double) income, cast(expense as double) expense,
               cast(income - expense as double) savings, {RATE} savings_rate from s""",
    "summarize": _with("ledger") + f"""{', ' + SUMMARY}
        select user_id, cast(round(income, 2) as double) total_income, cast(round(expense, 2) as double) total_expense,
               cast(round(income - expense, 2) as double) savings from s""",
    "dashboard_totals": _with("ledger") + f"""
        select user_id, cast({INC} as double) income, cast({EXP} as double) expense, count(*) tx_count,
               cast({INC} - {EXP} as double) savings from ledger group by 1""",
    "expenses_by_category": _with("ledger") + f""", {C4}
        select user_id, category, cast(total as double) total, share from c4s""",
    "top_category": _with("ledger") + f""", {C4},
        r as (select *, row_number() over (partition by user_id order by total desc, category) rn from c4s)
        select user_id, category, cast(total as double) total, share * 100 pct from r where rn = 1""",
    "monthly_averages": _with("ledger") + f""", {MONTHLY_IO},
        a as (select user_id, cast(sum(income) as double) / cast(count(*) as double) avg_income,
                     cast(sum(expense) as double) / cast(count(*) as double) avg_expense from m group by 1)
        select *, case when avg_income > 0 then (avg_income - avg_expense) / avg_income * 100 else 0.0 end savings_rate
        from a""",
    "monthly_total": _with("ledger") + f""", {MONTHLY_T}
        select user_id, month, cast(total as double) total from m""",
    "weekly_total": _with("ledger") + f"""
        select user_id, strftime({WEEK}, '%Y-%m-%d') as week, cast(sum(amount) as double) total
        from ledger where tx_date is not null group by 1, 2""",
    "monthly_expense": _with("ledger") + """
        select user_id, year(tx_date) as year, month(tx_date) as month, cast(sum(amount) as double) total
        from ledger where t_type = 'expense' and tx_date is not null group by 1, 2, 3""",
    "category_matrix": _with("ledger") + f"""
        select user_id, {MONTH} as month, {_matrix_cols()}
        from ledger where t_type = 'expense' and tx_date is not null group by 1, 2""",
    "last_month_matrix": _with("ledger") + f""",
        m as (select user_id, {MONTH} as month, {_matrix_cols()}
              from ledger where t_type = 'expense' and tx_date is not null group by 1, 2)
        select * exclude (_last) from (select *, max(month) over (partition by user_id) _last from m)
        where month = _last""",
    "category_share": _with("ledger") + """,
        c as (select user_id, category, count(*) n from ledger where category is not null group by 1, 2)
        select *, cast(n as double) / cast(sum(n) over (partition by user_id) as double) share from c""",
    "mini_metrics": _with("ledger") + f""", {C4},
        r as (select *, row_number() over (partition by user_id order by total desc, category) rn from c4s),
        t as (select user_id, max(case when rn = 1 then category end) top_category,
                     max(case when rn = 1 then total end) top_total,
                     max(case when rn = 2 then category end) second_category,
                     max(case when rn = 2 then total end) second_total from r where rn <= 2 group by 1),
        a as (select user_id, sum(amount) total_amount,
                     cast(sum(amount) as double) / cast(count(amount) as double) avg_amount from ledger group by 1)
        select a.user_id, cast(total_amount as double) total_amount, avg_amount, top_category,
               cast(top_total as double) top_total, second_category, cast(second_total as double) second_total
        from a left join t on a.user_id = t.user_id""",
    "coverage": _with("ledger") + """
        select user_id, strftime(min(tx_date), '%Y-%m-%d') min_date, strftime(max(tx_date), '%Y-%m-%d') max_date,
               count(*) n_rows, count(distinct category) n_categories from ledger group by 1""",
    "categories": _with("ledger") + "select distinct user_id, category from ledger",
    "system_overview": _with("ledger", "users", "households") + """,
        latest as (select user_id from ledger order by tx_date desc, tx_id desc limit 50)
        select (select count(*) from users) total_users,
               (select count(*) from users where role = 'admin') admins,
               (select count(*) from households) households,
               (select count(*) from ledger) transactions,
               (select count(*) from latest) recent_activity,
               cast((select count(*) from ledger) as double)
                 / cast(greatest((select count(*) from users), 1) as double) tx_per_user,
               (select count(*) from users where user_id in (select user_id from latest)) active_users""",
    "mean_amount": _with("ledger") + """
        select user_id, cast(sum(amount) as double) / cast(count(amount) as double) mean_amount, count(*) n_rows
        from ledger group by 1""",
    "null_audit": _with("ledger") + """,
        a as (select """ + ", ".join(
        f"cast(sum(case when {c} is null then 1 else 0 end) as bigint) null_{c}"
        for c in ("tx_id", "user_id", "t_type", "category", "amount", "tx_date", "note")) + """ from ledger)
        select *, null_tx_id + null_user_id + null_t_type + null_category + null_amount + null_tx_date + null_note
               null_total from a""",
    "savings_stats": _with("ledger") + f""", {MONTHLY_IO}
        select user_id, cast(sum(income - expense) as double) current_savings,
               cast(sum(income - expense) as double) / cast(count(*) as double) avg_monthly_savings,
               count(*) n_months from m group by 1""",
    "goal_progress": _with("ledger") + f""", {SUMMARY}
        select user_id, cast(income - expense as double) savings,
               cast(income - expense as double) / 5000.0 * 100 progress_pct,
               greatest(0.0, least(1.0, cast(income - expense as double) / 5000.0)) progress from s""",
    "whole_ledger_summary": _with("ledger") + f""",
        s as (select {INC} income, {EXP} expense from ledger)
        select cast(income as double) income, cast(expense as double) expense,
               cast(income - expense as double) savings, {RATE} savings_rate from s""",
    "household_summary": _with("ledger", "users", "households") + f""",
        e as (select l.*, u.household_id from ledger l join users u on l.user_id = u.user_id),
        s as (select household_id, {INC} income, {EXP} expense from e group by 1)
        select household_id, cast(income as double) income, cast(expense as double) expense,
               cast(income - expense as double) savings, {RATE} savings_rate from s""",
    # ---- ordered
    "savings_over_time": _with("ledger") + f""", {MONTHLY_IO}
        select user_id, month, cast(income as double) income, cast(expense as double) expense,
               cast(income - expense as double) savings,
               cast(sum(income - expense) over (partition by user_id order by month
                    rows between unbounded preceding and current row) as double) cumulative_savings from m""",
    "trend": _with("ledger") + f""", {MONTHLY_T},
        r as (select *, row_number() over (partition by user_id order by month desc) rn from m),
        g as (select user_id, count(*) n_months, max(case when rn = 1 then month end) last_month,
                     max(case when rn = 1 then total end) v1, max(case when rn = 2 then total end) v2,
                     max(case when rn = 3 then total end) v3 from r where rn <= 3 group by 1)
        select user_id, n_months, last_month, cast(v1 as double) last_total,
               case when n_months = 1 then 'single'
                    when v2 < v1 and (v3 is null or v3 < v2) then 'up'
                    when v2 > v1 and (v3 is null or v3 > v2) then 'down' else 'mixed' end trend from g""",
    "trend_expense": _with("ledger") + f""",
        m as (select user_id, {MONTH} as month, sum(amount) total from ledger
              where t_type = 'expense' and tx_date is not null group by 1, 2),
        r as (select *, row_number() over (partition by user_id order by month desc) rn from m),
        g as (select user_id, count(*) n_months, max(case when rn = 1 then month end) last_month,
                     max(case when rn = 1 then total end) v1, max(case when rn = 2 then total end) v2,
                     max(case when rn = 3 then total end) v3 from r where rn <= 3 group by 1)
        select user_id, n_months, last_month, cast(v1 as double) last_total,
               case when n_months = 1 then 'single'
                    when v2 < v1 and (v3 is null or v3 < v2) then 'up'
                    when v2 > v1 and (v3 is null or v3 > v2) then 'down' else 'mixed' end trend from g""",
    "weekly_alert": _with("ledger") + f""",
        w as (select user_id, {WEEK} as week, sum(amount) total from ledger where tx_date is not null group by 1, 2),
        r as (select *, row_number() over (partition by user_id order by week desc) rn from w),
        g as (select user_id, count(*) n_weeks, max(case when rn = 1 then week end) last_week,
                     max(case when rn = 1 then total end) last_total,
                     cast(sum(case when rn > 1 then total end) as double)
                       / cast(count(case when rn > 1 then 1 end) as double) mean_prev from r group by 1)
        select user_id, n_weeks, strftime(last_week, '%Y-%m-%d') as last_week, cast(last_total as double) last_total,
               mean_prev, case when n_weeks > 1 then cast(last_total as double) > mean_prev * 1.3 end alert from g""",
    "last_month_total": _with("ledger") + f""", {MONTHLY_T},
        r as (select *, row_number() over (partition by user_id order by month desc) rn from m)
        select user_id, month, cast(total as double) total from r where rn = 1""",
    "recent": _with("ledger") + f""",
        r as (select *, row_number() over (partition by user_id order by tx_date desc, tx_id desc) pos from ledger)
        select {LEDGER_COLS}, pos from r where pos <= 10""",
    "month_index": _with("ledger") + f""", {MONTHLY_T}
        select user_id, month, cast(total as double) total,
               row_number() over (partition by user_id order by month) - 1 idx from m""",
    "ordered": _with("ledger") + f"select {LEDGER_COLS} from ledger",
    "latest": _with("ledger") + f"select {LEDGER_COLS} from ledger order by tx_date desc, tx_id desc limit 50",
    "latest_events": """select event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') ts, user_id, event_type, value, props
        from events order by events.ts desc, event_id desc limit 20""",
    "top_categories": _with("ledger") + f""", {C4},
        r as (select *, row_number() over (partition by user_id order by total desc, category) rank from c4s)
        select user_id, rank, category, cast(total as double) total from r where rank <= 3""",
    "forecast_next": _with("ledger") + f""", {MONTHLY_T},
        x as (select user_id, month, cast(row_number() over (partition by user_id order by month) - 1 as bigint) x,
                     cast(total * 100 as bigint) y from m), {FIT}
        select user_id, n, last_month, cast(y_last as double) / 100 last_total,
               case when n = 1 then cast(y_last as double) / 100 else {_predict_sql('n')} end forecast_next_month
        from f""",
    "forecast_next_ledger": _with("ledger") + f""",
        m as (select {MONTH} as month, sum(amount) total from ledger where tx_date is not null group by 1),
        x as (select month, cast(row_number() over (order by month) - 1 as bigint) x,
                     cast(total * 100 as bigint) y from m),
        f as (select count(*) n, sum(x) sx, sum(x * x) sxx, sum(y) sy, sum(x * y) sxy,
                     max(month) last_month, arg_max(y, month) y_last from x)
        select n, last_month, cast(y_last as double) / 100 last_total,
               case when n = 1 then cast(y_last as double) / 100 else {_predict_sql('n')} end forecast_next_month
        from f""",
    "project": _with("ledger") + f""", {MONTHLY_IO},
        l as (select user_id, 'income' t_type, month, income v from m
              union all select user_id, 'expense' t_type, month, expense v from m),
        x as (select *, cast(row_number() over (partition by user_id, t_type order by month) - 1 as bigint) x,
                     cast(v * 100 as bigint) y from l),
        f as (select user_id, t_type, count(*) n, sum(x) sx, sum(x * x) sxx, sum(y) sy, sum(x * y) sxy,
                     max(month) last_month from x group by 1, 2 having count(*) > 1 and max(v) <> 0),
        j as (select unnest(generate_series(1, 6)) j)
        select l.user_id, l.t_type, l.month, cast(l.v as double) value, false is_forecast
        from l join f on l.user_id = f.user_id and l.t_type = f.t_type
        union all
        select user_id, t_type, strftime(cast(last_month || '-01' as date) + to_months(cast(j as integer)), '%Y-%m') as month,
               {_predict_sql('n + j - 1')} value, true is_forecast from f, j""",
    # ---- joins
    "enrich": _with("ledger", "users", "households") + f"""
        select {LEDGER_COLS.replace('user_id', 'l.user_id')}, username, role, u.household_id, h.name household_name
        from ledger l join users u on l.user_id = u.user_id left join households h on u.household_id = h.household_id""",
    "active_users": _with("ledger", "users") + """
        select * from users where user_id in
          (select user_id from (select user_id from ledger order by tx_date desc, tx_id desc limit 50))""",
    "compare_periods": _with("ledger") + f"""
        select user_id, category,
          cast(coalesce(sum(case when {_period_sql('2001-08-01', '2001-09-01')} then amount end), 0) as double) period1_total,
          cast(coalesce(sum(case when {_period_sql('2001-07-01', '2001-08-01')} then amount end), 0) as double) period2_total
        from ledger where t_type = 'expense' and category is not null
          and ({_period_sql('2001-08-01', '2001-09-01')} or {_period_sql('2001-07-01', '2001-08-01')})
        group by 1, 2""",
    "compare_years": _with("ledger") + f"""
        select user_id, category,
          cast(coalesce(sum(case when {_period_sql('2001-01-01', '2002-01-01')} then amount end), 0) as double) period1_total,
          cast(coalesce(sum(case when {_period_sql('2000-01-01', '2001-01-01')} then amount end), 0) as double) period2_total
        from ledger where t_type = 'expense' and category is not null
          and ({_period_sql('2001-01-01', '2002-01-01')} or {_period_sql('2000-01-01', '2001-01-01')})
        group by 1, 2""",
    "drop_known": _with("ledger") + f""",
        r as (select * from ledger where tx_date >= {AS_OF_SQL} - interval 90 day),
        n as (select user_id, t_type, amount, cast(tx_date + interval 1 day as date) tx_date, category, note from r
              union all select user_id, t_type, amount, tx_date, category, note from r)
        select distinct user_id, t_type, cast(amount as double) amount, strftime(tx_date, '%Y-%m-%d') tx_date,
               category, note
        from n where not exists (select 1 from ledger s where s.user_id = n.user_id and s.t_type = n.t_type
              and s.amount = n.amount and s.tx_date = n.tx_date and s.category = n.category
              and s.note is not distinct from n.note)""",
    "household_members": _with("users", "households") + """
        select h.household_id, h.name, count(u.user_id) members
        from households h left join users u on h.household_id = u.household_id group by 1, 2""",
    "erase_households": _with("ledger", "users", "households") + f"""
        select {LEDGER_COLS} from ledger where user_id not in (select user_id from users where household_id in
          (select household_id from households where name in ('NATION_3', 'NATION_7')))""",
    "uniqueness_violations": _with("users") + "select username, count(*) n from users group by 1 having count(*) > 1",
    "shared_households": _with("users") + "select household_id, count(*) n from users group by 1 having count(*) > 1",
    "orphan_rows": _with("ledger", "users") + f"""
        select {LEDGER_COLS} from ledger l where not exists
          (select 1 from users u where u.user_id = l.user_id and u.role = 'user')""",
    "homeless_users": _with("users") + """
        select * from users where household_id in
          (select n_nationkey from nation where n_name in ('NATION_3', 'NATION_7'))""",
    "keyword_series_found": _with("ledger") + f"""
        select user_id, {MONTH} as month, cast(sum(amount) as double) total from ledger
        where tx_date is not null and (lower(concat_ws(' ', category, note)) like '%promo%'
              or lower(concat_ws(' ', category, note)) like '%urgent%') group by 1, 2""",
    "orphan_users": _with("users", "households") + """
        select * from users u where household_id is not null
          and not exists (select 1 from households h where h.household_id = u.household_id)""",
    "erase_users": _with("ledger", "users") + f"""
        select {LEDGER_COLS} from ledger where user_id not in (select user_id from users where username in
          ('Customer#000000001', 'Customer#000000002', 'Customer#000000100'))""",
    "ledger_for_users": _with("ledger", "users") + f"""
        select {LEDGER_COLS} from ledger where user_id in (select user_id from users where household_id = 1)""",
    "users": _with("users") + "select * from users",
    "households": _with("households") + "select * from households",
    "orphans": _with("ledger", "users") + f"""
        select {LEDGER_COLS} from ledger l where not exists (select 1 from users u where u.user_id = l.user_id)""",
    # ---- filters
    "of_type": _with("ledger") + f"select {LEDGER_COLS} from ledger where t_type = 'expense'",
    "validate": _with("raw") + """,
        v as (select *, lower(trim(type)) t_type, try_cast(trim(amount) as decimal(18,2)) amount_num,
                     nullif(trim(category), '') category_clean,
                     try_strptime(trim(date), '%Y-%m-%d') ts_ok, nullif(trim(note), '') note_clean from raw),
        c as (select *, cast(ts_ok as date) tx_date, coalesce(t_type in ('income', 'expense'), false) type_ok,
                     coalesce(amount_num > 0, false) amount_ok, category_clean is not null category_ok,
                     ts_ok is not null date_ok from v)
        select id, user_id, date, type, amount, category, note, t_type, cast(amount_num as double) amount_num,
               category_clean, strftime(tx_date, '%Y-%m-%d') tx_date, note_clean, type_ok, amount_ok, category_ok,
               date_ok, type_ok and amount_ok and category_ok and date_ok valid,
               concat_ws(',', case when not type_ok then 'type' end, case when not amount_ok then 'amount' end,
                         case when not category_ok then 'category' end, case when not date_ok then 'date' end) reasons
        from c""",
    "lenient_date": _with("raw") + """
        select id, date, strftime(cast(try_strptime(trim(date), '%Y-%m-%d') as date), '%Y-%m-%d') tx_date from raw""",
    "time_range": _with("ledger") + f"select {LEDGER_COLS} from ledger where tx_date >= {AS_OF_SQL} - interval 90 day",
    "this_year": _with("ledger") + f"""select {LEDGER_COLS} from ledger
        where tx_date >= date '2001-01-01' and tx_date < date '2002-01-01'""",
    "period": _with("ledger") + f"select {LEDGER_COLS} from ledger where {_period_sql('2001-07-01', '2001-08-01')}",
    "multi_filter": _with("ledger") + f"""select {LEDGER_COLS} from ledger
        where coalesce(category, '') in ('PROMO', 'STANDARD') and tx_date between date '2000-01-01' and date '2000-12-31'
          and coalesce(t_type, '') in ('expense')""",
    "browse": _with("ledger") + f"select {LEDGER_COLS} from ledger where t_type = 'expense' and category = 'PROMO'",
    "search_users": _with("users") + "select * from users where contains(lower(username), 'customer#00000001')",
    "search_households": _with("users", "households") + """
        select h.household_id, h.name, count(u.user_id) members from households h
        left join users u on h.household_id = u.household_id
        where contains(lower(h.name), 'nation_1') group by 1, 2""",
    "fill_category": _with("ledger") + f"select {LEDGER_COLS.replace('category,', 'coalesce(category, \'Uncategorized\') category,')} from ledger",
    "labelled_notes": _with("ledger") + f"select {LEDGER_COLS} from ledger where note is not null and category is not null",
    "audit_view": _with("ledger") + """
        select tx_id, user_id, t_type, category, '$' || cast(amount as varchar) amount_text,
               strftime(tx_date, '%Y-%m-%d') tx_date,
               case when length(note) > 50 then substring(note, 1, 50) || '...' else note end note_short from ledger""",
    "validate_accounts": _with("users") + """
        select *, coalesce(regexp_full_match(username, '^[A-Za-z0-9_]{3,20}$'), false) username_ok from users""",
    "validate_households": _with("households") + """
        select *, coalesce(length(trim(name)) between 1 and 30, false) name_ok from households""",
    "coerce_role": _with("users") + """
        select user_id, username,
               case when lower(trim(role)) in ('admin', 'user') then lower(trim(role)) else 'user' end role,
               household_id from users""",
    "keyword_series": _with("ledger") + f"""
        select user_id, {MONTH} as month, cast(sum(amount) as double) total from ledger
        where regexp_matches(lower(concat_ws(' ', category, note)), 'electricity|utility|bill') and tx_date is not null
        group by 1, 2""",
    "set_role": _with("users") + """
        select user_id, username,
               case when username in ('Customer#000000001', 'Customer#000000002', 'Customer#000000100')
                         and role != 'admin' then 'admin' else role end role, household_id from users""",
    # ---- quality
    "imbalance": _with("ledger") + """,
        c as (select user_id, category, count(*) n from ledger where category is not null group by 1, 2),
        s as (select *, cast(n as double) / cast(sum(n) over (partition by user_id) as double) share from c)
        select user_id, max(share) max_share, max(share) > 0.8 imbalanced from s group by 1""",
    "underrepresented": _with("ledger") + """,
        c as (select user_id, category, count(*) n from ledger where category is not null group by 1, 2),
        s as (select *, cast(n as double) / cast(sum(n) over (partition by user_id) as double) share from c)
        select user_id, min(share) min_share, count(*) n_categories, min(share) < 0.05 underrepresented
        from s group by 1""",
    "missing_verdict": _with("ledger") + """,
        a as (select cast(sum((tx_id is null)::int + (user_id is null)::int + (t_type is null)::int
                    + (category is null)::int + (amount is null)::int + (tx_date is null)::int
                    + (note is null)::int) as bigint) null_total from ledger)
        select null_total, null_total > 0 has_missing from a""",
    "audit_summary": """
        select event_type, user_id, count(*) n_events, strftime(min(ts), '%Y-%m-%d %H:%M:%S') first_ts,
               strftime(max(ts), '%Y-%m-%d %H:%M:%S') last_ts,
               date_diff('day', cast(min(ts) as date), cast(max(ts) as date)) retention_days
        from events group by 1, 2""",
    "insight_list": _with("ledger") + f""", {SUMMARY}, {MONTHLY_T},
        r as (select *, row_number() over (partition by user_id order by month desc) rn from m),
        g as (select user_id, count(*) n_months, max(case when rn = 1 then month end) last_month,
                     max(case when rn = 1 then total end) v1, max(case when rn = 2 then total end) v2,
                     max(case when rn = 3 then total end) v3 from r where rn <= 3 group by 1),
        t as (select user_id, case when n_months = 1 then 'single'
                    when v2 < v1 and (v3 is null or v3 < v2) then 'up'
                    when v2 > v1 and (v3 is null or v3 > v2) then 'down' else 'mixed' end trend,
                    last_month, v1 from g)
        select s.user_id, case when expense > income then '⚠ You spent more than you earned.'
                               else '✅ You saved money overall.' end verdict,
               case trend when 'up' then '📈 Spending has increased over the last months.'
                          when 'down' then '📉 Spending has decreased over the last months.'
                          when 'mixed' then '➡️ Spending shows mixed patterns recently.'
                          when 'single' then 'Only one month of data: ' || last_month || ' total spending was $'
                                             || cast(v1 as varchar) || '.'
                          else 'Not enough data for trend detection.' end trend_message
        from s left join t on s.user_id = t.user_id""",
    "export_users": _with("users") + "select user_id id, username, role, household_id from users",
    "export_ledger": _with("ledger") + """
        select tx_id id, user_id, t_type type, category, cast(amount as double) amount,
               strftime(tx_date, '%Y-%m-%d') date, note from ledger""",
    "evolve": _with("users") + "select user_id, username, household_id, coalesce(null, 'user') role from users",
}


# ---- models, text, governance, sources and sinks
from tallyspark.plans.model_queries import MODEL_QUERIES, model_oracle_sql  # noqa: E402

QUERIES.update(MODEL_QUERIES)
ORACLE_SQL.update(model_oracle_sql(_with, LEDGER_COLS))

# ---- streaming (drained sinks)
from tallyspark.plans.stream_queries import STREAM_QUERIES, stream_oracle_sql  # noqa: E402

QUERIES.update(STREAM_QUERIES)
ORACLE_SQL.update(stream_oracle_sql(_with, ORACLE_SQL))

# ---- what is kept at rest
from tallyspark.plans.stored_queries import STORED_QUERIES, stored_oracle_sql  # noqa: E402

QUERIES.update(STORED_QUERIES)
ORACLE_SQL.update(stored_oracle_sql(_with, LEDGER_COLS, ORACLE_SQL))
