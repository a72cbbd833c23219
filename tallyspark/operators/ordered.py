"""Ordered computations (E1-E6), sorts and top-k (F1, F2, F4, F5), forecasts (H1, H2).

Series work runs over the (key, month) / (key, week) rollups, never over raw
rows: a key has at most one row per observed period, so a window partitioned
by the key stays small however many transactions a hot user has.  Per-key
top-n over raw rows uses ``row_number() <= n``, which Spark plans with a
partial WindowGroupLimit before the shuffle (n rows per key per map task).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions.columns import keys, ratio
from tallyspark.operators.rollups import monthly_in_out, monthly_total, weekly_total
from tallyspark.schema import EXPENSE, INCOME, TREND_MONTHS, WEEKLY_ALERT_FACTOR


def _w(k: list[str]) -> Window:
    return Window.partitionBy(*k) if k else Window.partitionBy()


def savings_over_time(df: DataFrame, by: Sequence[str] | None = None) -> DataFrame:
    """Monthly savings and running total over observed months."""
    k = keys(by)
    m = monthly_in_out(df, by).withColumn("savings", F.col(INCOME) - F.col(EXPENSE))
    w = _w(k).orderBy("month").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return m.withColumn("cumulative_savings", F.sum("savings").over(w))


def _last_n(series: DataFrame, k: list[str], period: str, n: int) -> DataFrame:
    w = _w(k).orderBy(F.col(period).desc())
    return series.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= n)


def trend(df: DataFrame, by: Sequence[str] | None = None,
          types: Sequence[str] | None = None) -> DataFrame:
    """Direction of the last three observed monthly totals.

    ``up`` when every step rises, ``down`` when every step falls, else
    ``mixed``; one observed month gives ``single``.
    """
    k = keys(by)
    last = _last_n(monthly_total(df, by, types), k, "month", TREND_MONTHS)
    g = last.groupBy(*k).agg(
        F.count(F.lit(1)).alias("n_months"),
        F.max(F.when(F.col("rn") == 1, F.col("month"))).alias("last_month"),
        F.max(F.when(F.col("rn") == 1, F.col("total"))).alias("v1"),
        F.max(F.when(F.col("rn") == 2, F.col("total"))).alias("v2"),
        F.max(F.when(F.col("rn") == 3, F.col("total"))).alias("v3"))
    rising = (F.col("v2") < F.col("v1")) & (F.col("v3").isNull() | (F.col("v3") < F.col("v2")))
    falling = (F.col("v2") > F.col("v1")) & (F.col("v3").isNull() | (F.col("v3") > F.col("v2")))
    t = (F.when(F.col("n_months") == 1, F.lit("single"))
         .when(rising, F.lit("up")).when(falling, F.lit("down")).otherwise(F.lit("mixed")))
    return g.select(*k, "n_months", "last_month", F.col("v1").alias("last_total"), t.alias("trend"))


def weekly_alert(df: DataFrame, by: Sequence[str] | None = None, factor: float = WEEKLY_ALERT_FACTOR,
                 types: Sequence[str] | None = None) -> DataFrame:
    """Last observed week above ``factor`` x the mean of the earlier weeks.

    ``alert`` is null when only one week is observed.
    """
    k = keys(by)
    w = _w(k).orderBy(F.col("week").desc())
    s = weekly_total(df, by, types).withColumn("rn", F.row_number().over(w))
    g = s.groupBy(*k).agg(
        F.count(F.lit(1)).alias("n_weeks"),
        F.max(F.when(F.col("rn") == 1, F.col("week"))).alias("last_week"),
        F.max(F.when(F.col("rn") == 1, F.col("total"))).alias("last_total"),
        ratio(F.sum(F.when(F.col("rn") > 1, F.col("total"))),
              F.count(F.when(F.col("rn") > 1, F.lit(1)))).alias("mean_prev"))
    alert = (F.when(F.col("n_weeks") > 1,
                    F.col("last_total").cast("double") > F.col("mean_prev") * F.lit(factor)))
    return g.withColumn("alert", alert)


def last_month_total(df: DataFrame, by: Sequence[str] | None = None,
                     types: Sequence[str] | None = None) -> DataFrame:
    """Total of the last observed month."""
    k = keys(by)
    return _last_n(monthly_total(df, by, types), k, "month", 1).drop("rn")


def recent(df: DataFrame, by: Sequence[str] | None = None, n: int = 10) -> DataFrame:
    """E5: the ``n`` latest rows per key by (date, id), newest first (``pos`` 1..n)."""
    k = keys(by)
    w = _w(k).orderBy(F.col("tx_date").desc(), F.col("tx_id").desc())
    return df.withColumn("pos", F.row_number().over(w)).filter(F.col("pos") <= n)


def month_index(df: DataFrame, by: Sequence[str] | None = None,
                types: Sequence[str] | None = None) -> DataFrame:
    """0-based position of each observed month (the regression x)."""
    k = keys(by)
    w = _w(k).orderBy("month")
    return monthly_total(df, by, types).withColumn("idx", F.row_number().over(w) - 1)


def ordered(df: DataFrame, by: Sequence[str] | None = None) -> DataFrame:
    """ledger order, date then id (a range-partitioned global sort)."""
    return df.orderBy(*keys(by), "tx_date", "tx_id")


def latest(df: DataFrame, n: int = 50) -> DataFrame:
    """the ``n`` latest rows overall (planned as TakeOrderedAndProject)."""
    return df.orderBy(F.col("tx_date").desc(), F.col("tx_id").desc()).limit(n)


def latest_events(events: DataFrame, n: int = 20) -> DataFrame:
    """the ``n`` latest audit events."""
    return events.orderBy(F.col("ts").desc(), F.col("event_id").desc()).limit(n)


def transparency_sample(df: DataFrame, by: Sequence[str] | None = None, n: int = 3,
                        seed: int = 42) -> DataFrame:
    """a reproducible sample of up to ``n`` rows per key (smallest id hash)."""
    k = keys(by)
    w = _w(k).orderBy(F.xxhash64("tx_id", F.lit(seed)), F.col("tx_id"))
    return df.withColumn("pos", F.row_number().over(w)).filter(F.col("pos") <= n)


# ---- H1 / H2: least squares on the month index, closed form ----

def _exact_sum(c: F.Column) -> F.Column:
    """Sum of integers as decimal(38,0): a whole-ledger fit passes the range of a bigint."""
    return F.sum(c.cast("decimal(38,0)"))


def _exact_product_sum() -> F.Column:
    return _exact_sum(F.col("x").cast("decimal(9,0)") * F.col("y").cast("decimal(28,0)"))


def _cents_exact(c: str) -> F.Column:
    return (F.col(c) * 100).cast("decimal(28,0)")


def _fit(series: DataFrame, k: list[str], value: str) -> DataFrame:
    """Per key: n, sums of x, x^2, y, xy with y in whole cents (exact)."""
    w = _w(k).orderBy("month")
    s = (series.withColumn("x", (F.row_number().over(w) - 1).cast("bigint"))
         .withColumn("y", _cents_exact(value)))
    return s.groupBy(*k).agg(
        F.count(F.lit(1)).alias("n"), F.sum("x").alias("sx"), F.sum(F.col("x") * F.col("x")).alias("sxx"),
        _exact_sum(F.col("y")).alias("sy"), _exact_product_sum().alias("sxy"),
        F.max("month").alias("last_month"),
        F.max_by("y", "month").alias("y_last"))


def _slope() -> F.Column:
    n, sx, sxx, sy, sxy = (F.col(c).cast("double") for c in ("n", "sx", "sxx", "sy", "sxy"))
    return (n * sxy - sx * sy) / (n * sxx - sx * sx)


def _predict(x: F.Column) -> F.Column:
    """Fitted value at ``x`` in currency units: mean(y) + slope * (x - mean(x))."""
    n, sx, sy = (F.col(c).cast("double") for c in ("n", "sx", "sy"))
    return (sy / n + _slope() * (x.cast("double") - sx / n)) / 100


def forecast_next(df: DataFrame, by: Sequence[str] | None = None,
                  types: Sequence[str] | None = None) -> DataFrame:
    """H1: next-month total by a degree-1 fit over observed months; one month -> itself."""
    k = keys(by)
    f = _fit(monthly_total(df, by, types), k, "total")
    fc = F.when(F.col("n") == 1, F.col("y_last").cast("double") / 100).otherwise(_predict(F.col("n")))
    return f.select(*k, "n", "last_month", (F.col("y_last").cast("double") / 100).alias("last_total"),
                    fc.alias("forecast_next_month"))


def project(df: DataFrame, by: Sequence[str] | None = None, periods: int = 6) -> DataFrame:
    """H2: history plus ``periods`` projected months of income and expense.

    Each type is fitted over the key's zero-filled month x type matrix; a type
    is returned only when the key has more than one month and some amount of
    that type (a type the key never had is left out).  History and fit
    come from one window pass over the (key, month) rows, so both
    branches of the union share its exchange.
    """
    k = keys(by)
    w = _w(k)
    m = monthly_in_out(df, by).select(
        *k, "month", INCOME, EXPENSE, (F.row_number().over(w.orderBy("month")) - 1).cast("bigint").alias("x"),
        F.count(F.lit(1)).over(w).alias("n_all"), F.max(F.col(INCOME) != 0).over(w).alias("has_income"),
        F.max(F.col(EXPENSE) != 0).over(w).alias("has_expense")).filter(F.col("n_all") > 1)
    kt = k + ["t_type"]
    s = m.select(*k, "month", "x", F.explode(F.array(
        F.struct(F.lit(INCOME).alias("t_type"), F.col(INCOME).alias("v"), F.col("has_income").alias("held")),
        F.struct(F.lit(EXPENSE).alias("t_type"), F.col(EXPENSE).alias("v"), F.col("has_expense").alias("held")))).alias("p")) \
        .select(*k, "month", "x", "p.*").filter("held").withColumn("y", _cents_exact("v"))
    hist = s.select(*kt, "month", F.col("v").cast("double").alias("value"), F.lit(False).alias("is_forecast"))
    fit = s.groupBy(*kt).agg(
        F.count(F.lit(1)).alias("n"), F.sum("x").alias("sx"), F.sum(F.col("x") * F.col("x")).alias("sxx"),
        _exact_sum(F.col("y")).alias("sy"), _exact_product_sum().alias("sxy"), F.max("month").alias("last_month"))
    fut = (fit.withColumn("j", F.explode(F.sequence(F.lit(1), F.lit(periods))))
           .select(*kt,
                   F.date_format(F.add_months(F.to_date(F.concat(F.col("last_month"), F.lit("-01"))), F.col("j")),
                                 "yyyy-MM").alias("month"),
                   _predict(F.col("n") + F.col("j") - 1).alias("value"),
                   F.lit(True).alias("is_forecast")))
    return hist.unionByName(fut)
