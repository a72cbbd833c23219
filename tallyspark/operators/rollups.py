"""Aggregations (C1-C21): totals, monthly/weekly rollups, shares, coverage.

Every aggregate is a hash aggregate on ``by`` (+ a period key); Spark's
partial aggregation combines map side, so a user holding a third of all
rows costs one pre-aggregated row per map task, not a hot reducer.
Windows run only over already aggregated (key, category/month) rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions.columns import keys, month_label, ratio, week_start
from tallyspark.schema import EXPENSE, INCOME, SAVINGS_TARGET


def _type_sum(t: str) -> F.Column:
    return F.coalesce(F.sum(F.when(F.col("t_type") == t, F.col("amount"))), F.lit(0).cast("decimal(28,2)"))


def _savings_rate(income: str = "income", savings: str = "savings") -> F.Column:
    return (F.when(F.col(income) > 0, ratio(F.col(savings), F.col(income)) * 100)
            .otherwise(F.lit(0.0)))


def summary_stats(df: DataFrame, by: Sequence[str] | None = None) -> DataFrame:
    """Income, expense, savings, savings_rate % (0 when income <= 0)."""
    k = keys(by)
    return (df.groupBy(*k)
            .agg(_type_sum(INCOME).alias("income"), _type_sum(EXPENSE).alias("expense"))
            .withColumn("savings", F.col("income") - F.col("expense"))
            .withColumn("savings_rate", _savings_rate()))


def summary_by_group(df: DataFrame, users: DataFrame, group: str = "household_id") -> DataFrame:
    """C1 per group of users (households): exact sums per user first, so the join sees users, never ledger rows.

    Rows of users that are not in ``users`` belong to no group; users without a group form the null group.
    The rollup is already dealt by user, so the join moves the users only and never sends facts to all tasks.
    """
    per_user = df.groupBy("user_id").agg(_type_sum(INCOME).alias("income"), _type_sum(EXPENSE).alias("expense"))
    return (per_user.join(users.select("user_id", group).hint("shuffle_hash"), "user_id").groupBy(group)
            .agg(F.sum("income").cast("decimal(28,2)").alias("income"), F.sum("expense").cast("decimal(28,2)").alias("expense"))
            .withColumn("savings", F.col("income") - F.col("expense"))
            .withColumn("savings_rate", _savings_rate()))


def summarize(df: DataFrame, by: Sequence[str] | None = None) -> DataFrame:
    """total_income, total_expense, savings rounded to cents."""
    s = summary_stats(df, by)
    return s.select(*keys(by),
                    F.round("income", 2).alias("total_income"),
                    F.round("expense", 2).alias("total_expense"),
                    F.round("savings", 2).alias("savings"))


def dashboard_totals(df: DataFrame, by: Sequence[str] | None = None) -> DataFrame:
    """Income, expense, savings and transaction count."""
    k = keys(by)
    return (df.groupBy(*k)
            .agg(_type_sum(INCOME).alias("income"), _type_sum(EXPENSE).alias("expense"),
                 F.count(F.lit(1)).alias("tx_count"))
            .withColumn("savings", F.col("income") - F.col("expense")))


def expenses_by_category(df: DataFrame, by: Sequence[str] | None = None) -> DataFrame:
    """C4: expense total per category and its share of the key's expenses."""
    k = keys(by)
    tot = (df.filter((F.col("t_type") == EXPENSE) & F.col("category").isNotNull())
           .groupBy(*k, "category").agg(F.sum("amount").alias("total")))
    w = Window.partitionBy(*k)
    return tot.withColumn("share", ratio(F.col("total"), F.sum("total").over(w)))


def top_category(df: DataFrame, by: Sequence[str] | None = None) -> DataFrame:
    """Largest expense category, its total and % of all expenses; ties by name."""
    k = keys(by)
    c4 = expenses_by_category(df, by)
    w = Window.partitionBy(*k).orderBy(F.col("total").desc(), F.col("category"))
    return (c4.withColumn("rn", F.row_number().over(w)).filter("rn = 1")
            .select(*k, "category", "total", (F.col("share") * 100).alias("pct")))


def _zero_sum(cond: F.Column) -> F.Column:
    return F.coalesce(F.sum(F.when(cond, F.col("amount"))), F.lit(0).cast("decimal(28,2)"))


def monthly_in_out(df: DataFrame, by: Sequence[str] | None = None) -> DataFrame:
    """Month x type totals, zero-filled (only observed months).

    A pivot with a fixed value list written as conditional sums: one hash
    aggregate (``pivot`` would add a second aggregation phase and shuffle).
    """
    k = keys(by)
    return (df.filter(F.col("tx_date").isNotNull())
            .groupBy(*k, month_label().alias("month"))
            .agg(_zero_sum(F.col("t_type") == INCOME).alias(INCOME),
                 _zero_sum(F.col("t_type") == EXPENSE).alias(EXPENSE)))


def monthly_averages(df: DataFrame, by: Sequence[str] | None = None) -> DataFrame:
    """Mean monthly income and expense, savings rate of the means."""
    k = keys(by)
    m = monthly_in_out(df, by)
    return (m.groupBy(*k)
            .agg(ratio(F.sum(INCOME), F.count(F.lit(1))).alias("avg_income"),
                 ratio(F.sum(EXPENSE), F.count(F.lit(1))).alias("avg_expense"))
            .withColumn("savings_rate",
                        F.when(F.col("avg_income") > 0,
                               (F.col("avg_income") - F.col("avg_expense")) / F.col("avg_income") * 100)
                        .otherwise(F.lit(0.0))))


def _typed(df: DataFrame, types: Sequence[str] | None) -> DataFrame:
    return df if not types else df.filter(F.col("t_type").isin(list(types)))


def monthly_total(df: DataFrame, by: Sequence[str] | None = None,
                  types: Sequence[str] | None = None) -> DataFrame:
    """Total per observed month, both types together unless ``types`` given."""
    k = keys(by)
    return (_typed(df, types).filter(F.col("tx_date").isNotNull())
            .groupBy(*k, month_label().alias("month")).agg(F.sum("amount").alias("total")))


def weekly_total(df: DataFrame, by: Sequence[str] | None = None,
                 types: Sequence[str] | None = None) -> DataFrame:
    """Total per observed Monday-based week."""
    k = keys(by)
    return (_typed(df, types).filter(F.col("tx_date").isNotNull())
            .groupBy(*k, week_start().alias("week")).agg(F.sum("amount").alias("total")))


def monthly_expense(df: DataFrame, by: Sequence[str] | None = None) -> DataFrame:
    """Expense per (year, month)."""
    k = keys(by)
    return (df.filter((F.col("t_type") == EXPENSE) & F.col("tx_date").isNotNull())
            .groupBy(*k, F.year("tx_date").alias("year"), F.month("tx_date").alias("month"))
            .agg(F.sum("amount").alias("total")))


def expense_categories(df: DataFrame) -> list[str]:
    """Distinct expense categories (the pivot value list; a small dimension)."""
    rows = (df.filter((F.col("t_type") == EXPENSE) & F.col("category").isNotNull())
            .select("category").distinct().orderBy("category").collect())
    return [r[0] for r in rows]


def category_matrix(df: DataFrame, cats: Sequence[str], by: Sequence[str] | None = None) -> DataFrame:
    """C11: expense month x category matrix, zero-filled, over a given category list (conditional sums)."""
    k = keys(by)
    cats = list(cats)
    return (df.filter((F.col("t_type") == EXPENSE) & F.col("tx_date").isNotNull())
            .groupBy(*k, month_label().alias("month"))
            .agg(*[_zero_sum(F.col("category") == c).alias(c) for c in cats]))


def last_month_matrix(df: DataFrame, cats: Sequence[str], by: Sequence[str] | None = None) -> DataFrame:
    """The C11 row of each key's last month that has expenses.

    The last month is found first, so the wide rows are made of that month alone, one per key.
    """
    k = keys(by)
    rows = df.filter((F.col("t_type") == EXPENSE) & F.col("tx_date").isNotNull())
    last = rows.groupBy(*k).agg(F.max("tx_date").alias("_last")).select(*[F.col(f"`{c}`").alias(f"_key{i}") for i, c in enumerate(k)], "_last")
    same = F.lit(True)
    for i, c in enumerate(k):
        same = same & F.col(f"`{c}`").eqNullSafe(F.col(f"_key{i}"))
    in_last = month_label() == month_label("_last")
    return category_matrix(rows.join(last, same & in_last, "left_semi"), cats, by)


def category_share(df: DataFrame, by: Sequence[str] | None = None) -> DataFrame:
    """Row-count share per category (null categories left out)."""
    k = keys(by)
    c = df.filter(F.col("category").isNotNull()).groupBy(*k, "category").agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("share", ratio(F.col("n"), F.sum("n").over(Window.partitionBy(*k))))


def mini_metrics(df: DataFrame, by: Sequence[str] | None = None) -> DataFrame:
    """C14: total and mean amount of the (filtered) rows, with top two expense categories."""
    k = keys(by)
    whole = not k
    if whole:  # one key for the whole ledger: a constant column keeps it an equi-join
        df, k = df.withColumn("_all", F.lit(0)), ["_all"]
    tot = df.groupBy(*k).agg(F.sum("amount").alias("total_amount"),
                             ratio(F.sum("amount"), F.count("amount")).alias("avg_amount"))
    top = top_categories(df, k, 2)
    top2 = top.groupBy(*k).agg(
        F.max(F.when(F.col("rank") == 1, F.col("category"))).alias("top_category"),
        F.max(F.when(F.col("rank") == 1, F.col("total"))).alias("top_total"),
        F.max(F.when(F.col("rank") == 2, F.col("category"))).alias("second_category"),
        F.max(F.when(F.col("rank") == 2, F.col("total"))).alias("second_total"))
    out = tot.join(top2, on=k, how="left")
    return out.drop("_all") if whole else out


def top_categories(df: DataFrame, by: Sequence[str] | None = None, k: int = 3) -> DataFrame:
    """top ``k`` expense categories per key by total (ties by name)."""
    kk = keys(by)
    c4 = expenses_by_category(df, by)
    w = Window.partitionBy(*kk).orderBy(F.col("total").desc(), F.col("category"))
    return (c4.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
            .select(*kk, "rank", "category", "total"))


def coverage(df: DataFrame, by: Sequence[str] | None = None) -> DataFrame:
    """First and last date, row count, distinct categories."""
    k = keys(by)
    return df.groupBy(*k).agg(F.min("tx_date").alias("min_date"), F.max("tx_date").alias("max_date"),
                              F.count(F.lit(1)).alias("n_rows"),
                              F.countDistinct("category").alias("n_categories"))


def categories(df: DataFrame, by: Sequence[str] | None = None) -> DataFrame:
    """Distinct categories per key."""
    return df.select(*keys(by), "category").distinct()


def system_overview(users: DataFrame, households: DataFrame, ledger: DataFrame,
                    n_recent: int = 50) -> DataFrame:
    """C17: one row of system counts, each an uncorrelated scalar subquery."""
    spark = users.sparkSession
    n_users = users.select(F.count(F.lit(1))).scalar()
    latest = ledger.orderBy(F.col("tx_date").desc(), F.col("tx_id").desc()).limit(n_recent)
    active = users.join(latest.select("user_id"), "user_id", "left_semi")
    n_tx = ledger.select(F.count(F.lit(1))).scalar()
    return spark.range(1).select(
        n_users.alias("total_users"),
        users.select(F.count(F.when(F.col("role") == "admin", 1))).scalar().alias("admins"),
        households.select(F.count(F.lit(1))).scalar().alias("households"),
        n_tx.alias("transactions"),
        latest.select(F.count(F.lit(1))).scalar().alias("recent_activity"),
        ratio(n_tx, F.greatest(n_users, F.lit(1))).alias("tx_per_user"),
        active.select(F.count(F.lit(1))).scalar().alias("active_users"),
    )


def mean_amount(df: DataFrame, by: Sequence[str] | None = None) -> DataFrame:
    """Mean transaction amount."""
    k = keys(by)
    return df.groupBy(*k).agg(ratio(F.sum("amount"), F.count("amount")).alias("mean_amount"),
                              F.count(F.lit(1)).alias("n_rows"))


def null_audit(df: DataFrame) -> DataFrame:
    """Null cells per column and in total, one pass."""
    parts = [F.sum(F.col(f"`{c}`").isNull().cast("long")).alias(f"null_{c}") for c in df.columns]
    out = df.agg(*parts)
    total = sum((F.col(f"null_{c}") for c in df.columns), F.lit(0).cast("long"))
    return out.withColumn("null_total", total)


def savings_stats(df: DataFrame, by: Sequence[str] | None = None) -> DataFrame:
    """C20: current cumulative savings and mean monthly savings over observed months."""
    k = keys(by)
    m = monthly_in_out(df, by).withColumn("savings", F.col(INCOME) - F.col(EXPENSE))
    return m.groupBy(*k).agg(F.sum("savings").alias("current_savings"),
                             ratio(F.sum("savings"), F.count(F.lit(1))).alias("avg_monthly_savings"),
                             F.count(F.lit(1)).alias("n_months"))


def goal_progress(df: DataFrame, by: Sequence[str] | None = None,
                  target: float = SAVINGS_TARGET) -> DataFrame:
    """Savings as % of target and the progress value clamped to [0, 1]."""
    k = keys(by)
    s = summary_stats(df, by)
    t = F.lit(float(target))
    frac = F.col("savings").cast("double") / t
    return s.select(*k, "savings",
                    (frac * 100).alias("progress_pct"),
                    (F.greatest(F.lit(0.0), F.least(F.lit(1.0), frac)) if target > 0 else F.lit(0.0))
                    .alias("progress"))
