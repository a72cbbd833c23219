"""Projections, filters and validation.

All rules are column predicates so Catalyst pushes them to the scan where the
column is stored; date bounds are plain comparisons on ``tx_date`` so a ledger
written partitioned by ``tx_month`` prunes partitions too (see ``sources.files``).
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.columns import blank_to_null, keys, money, month_label, month_start, strict_date
from tallyspark.schema import (AUDIT_NOTE_MAX, DEFAULT_ROLE, HOUSEHOLD_NAME_MAX, ROLES, TX_TYPES,
                               UNCATEGORIZED_FILL, UNCATEGORIZED_RESOLVED, USERNAME_PATTERN, UTILITY_WORDS)


def of_type(df: DataFrame, t: str) -> DataFrame:
    """B1: keep one transaction type."""
    return df.filter(F.col("t_type") == t)


def validate(raw: DataFrame) -> DataFrame:
    """Parse and check raw text rows.

    Adds the cleaned columns (t_type, amount, category, tx_date, note), one
    boolean per rule and ``valid``; ``reasons`` lists the failed rules.  A null
    field fails its rule, so every verdict is true or false.
    """
    t = F.lower(F.trim(F.col("type")))
    amt = F.expr("try_cast(trim(amount) as decimal(18,2))")
    cat = blank_to_null("category")
    d = strict_date("date")
    out = raw.select(
        "*",
        t.alias("t_type"), amt.alias("amount_num"), cat.alias("category_clean"), d.alias("tx_date"),
        blank_to_null("note").alias("note_clean"),
    ).select(
        "*",
        F.coalesce(F.col("t_type").isin(TX_TYPES), F.lit(False)).alias("type_ok"),
        F.coalesce(F.col("amount_num") > 0, F.lit(False)).alias("amount_ok"),
        F.col("category_clean").isNotNull().alias("category_ok"),
        F.col("tx_date").isNotNull().alias("date_ok"),
    )
    rules = ["type_ok", "amount_ok", "category_ok", "date_ok"]
    reasons = F.array_compact(F.array(*[F.when(~F.col(r), F.lit(r.replace("_ok", ""))) for r in rules]))
    return out.withColumn("valid", F.col("type_ok") & F.col("amount_ok") & F.col("category_ok") & F.col("date_ok")) \
              .withColumn("reasons", reasons)


def lenient_date(df: DataFrame, col: str = "date", out: str = "tx_date") -> DataFrame:
    """Text date to date, bad values to null (never an error)."""
    return df.withColumn(out, strict_date(col))


RANGE_DAYS = {"last_3_months": 90, "last_6_months": 180}


def time_range(df: DataFrame, r: str | None, as_of: _dt.date) -> DataFrame:
    """Last 90 days, last 180 days, this year, or everything (None)."""
    a = F.lit(as_of)
    if r is None or r == "all":
        return df
    if r in RANGE_DAYS:
        return _between(df, F.date_sub(a, RANGE_DAYS[r]), None)
    if r == "this_year":
        return _between(df, F.trunc(a, "year"), F.add_months(F.trunc(a, "year"), 12))
    raise ValueError(f"unknown time range {r!r}")


def _between(df: DataFrame, lo: Column, hi: Column | None) -> DataFrame:
    """``lo <= tx_date < hi``; on a stored ledger also a ``tx_month`` bound (partition pruning)."""
    cond = F.col("tx_date") >= lo
    if hi is not None:
        cond = cond & (F.col("tx_date") < hi)
    if "tx_month" in df.columns:
        cond = cond & (F.col("tx_month") >= month_label(lo))
        if hi is not None:
            cond = cond & (F.col("tx_month") <= month_label(F.date_sub(hi, 1)))
    return df.filter(cond)


def _norm_period(p: str) -> str:
    return p.strip().lower().replace(" ", "_")


def period_predicate(p: str, as_of: _dt.date) -> Column:
    """Predicate for a named period; labels like ``This Month`` are normalised."""
    lo, hi = period_bounds(p, as_of)
    d = F.col("tx_date")
    return (d >= lo) & (d < hi)


def period_bounds(p: str, as_of: _dt.date) -> tuple[Column, Column]:
    p = _norm_period(p)
    a = F.lit(as_of)
    m0, y0 = month_start(a), F.trunc(a, "year")
    bounds = {"this_month": (m0, F.add_months(m0, 1)), "last_month": (F.add_months(m0, -1), m0),
              "this_year": (y0, F.add_months(y0, 12)), "last_year": (F.add_months(y0, -12), y0)}
    if p not in bounds:
        raise ValueError(f"unknown period {p!r}")
    return bounds[p]


def period_months(p: str, as_of: _dt.date, col: str = "tx_month") -> Column:
    """The ``tx_month`` bound of a named period, for partition pruning on a stored ledger."""
    lo, hi = period_bounds(p, as_of)
    return F.col(col).between(month_label(lo), month_label(F.date_sub(hi, 1)))


def period(df: DataFrame, p: str, as_of: _dt.date) -> DataFrame:
    """Rows of this/last month (January wraps) or this/last year."""
    lo, hi = period_bounds(p, as_of)
    return _between(df, lo, hi)


def multi_filter(df: DataFrame, categories: Sequence[str] | None = None,
                 types: Sequence[str] | None = None,
                 date_range: tuple[_dt.date, _dt.date] | None = None) -> DataFrame:
    """Category IN, type IN, inclusive date range; empty = no filter; null matches ''."""
    if categories:
        df = df.filter(F.coalesce(F.col("category"), F.lit("")).isin(list(categories)))
    if date_range:
        lo, hi = date_range
        df = df.filter(F.col("tx_date").between(F.lit(lo), F.lit(hi)))
        if "tx_month" in df.columns:
            df = df.filter(F.col("tx_month").between(f"{lo:%Y-%m}", f"{hi:%Y-%m}"))
    if types:
        df = df.filter(F.coalesce(F.col("t_type"), F.lit("")).isin(list(types)))
    return df


def browse(df: DataFrame, t_type: str | None = None, category: str | None = None,
           sort_by: str = "tx_date") -> DataFrame:
    """Optional type and category filter, descending sort on one column."""
    if t_type:
        df = df.filter(F.col("t_type") == t_type)
    if category:
        df = df.filter(F.col("category") == category)
    return df.orderBy(F.col(sort_by).desc())


def search_users(users: DataFrame, q: str) -> DataFrame:
    """Case-insensitive substring match on usernames."""
    return users.filter(F.lower("username").contains(q.lower()))


def search_households(households: DataFrame, users: DataFrame, q: str) -> DataFrame:
    """Households whose name contains ``q`` (any case), with member counts."""
    from tallyspark.operators.relate import household_members
    return household_members(households.filter(F.lower("name").contains(q.lower())), users)


def fill_category(df: DataFrame) -> DataFrame:
    """Missing category -> ``Uncategorized`` (the column is added if absent)."""
    if "category" not in df.columns:
        return df.withColumn("category", F.lit(UNCATEGORIZED_FILL))
    return df.withColumn("category", F.coalesce("category", F.lit(UNCATEGORIZED_FILL)))


def labelled_notes(df: DataFrame) -> DataFrame:
    """Rows usable for text training: note and category present."""
    return df.dropna(subset=["note", "category"])


def resolve_category(df: DataFrame, predicted: str = "predicted") -> DataFrame:
    """Typed category, else the suggested one, else ``uncategorized``."""
    return df.withColumn("category", F.coalesce(blank_to_null("category"), F.col(predicted),
                                                F.lit(UNCATEGORIZED_RESOLVED)))


def audit_view(df: DataFrame) -> DataFrame:
    """Note cut to 50 characters plus ``...``, amount as ``$0.00``."""
    note = F.when(F.length("note") > AUDIT_NOTE_MAX,
                  F.concat(F.substring("note", 1, AUDIT_NOTE_MAX), F.lit("..."))).otherwise(F.col("note"))
    return df.select("tx_id", "user_id", "t_type", "category",
                     F.concat(F.lit("$"), money("amount").cast("string")).alias("amount_text"),
                     "tx_date", note.alias("note_short"))


def display_format(df: DataFrame, by: Sequence[str] | None = None) -> DataFrame:
    """``$1,234.50`` money and ``12.3%`` savings rate per key."""
    from tallyspark.functions.columns import money_text, pct_text
    from tallyspark.operators.rollups import summary_stats
    s = summary_stats(df, by)
    return s.select(*keys(by), money_text("income").alias("income_text"),
                    money_text("expense").alias("expense_text"),
                    money_text("savings").alias("savings_text"),
                    pct_text("savings_rate").alias("savings_rate_text"))


def validate_accounts(users: DataFrame, households: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Username pattern and household name length as row checks."""
    u = users.withColumn("username_ok", F.coalesce(F.col("username").rlike(USERNAME_PATTERN), F.lit(False)))
    h = households.withColumn("name_ok", F.coalesce(
        F.length(F.trim("name")).between(1, HOUSEHOLD_NAME_MAX), F.lit(False)))
    return u, h


def coerce_role(users: DataFrame) -> DataFrame:
    """Roles outside admin/user become ``user``."""
    r = F.lower(F.trim("role"))
    return users.withColumn("role", F.when(r.isin(ROLES), r).otherwise(F.lit(DEFAULT_ROLE)))


def keyword_series(df: DataFrame, words: Sequence[str] = UTILITY_WORDS,
                   by: Sequence[str] | None = None) -> DataFrame:
    """Rows whose category or note mentions a keyword, totalled per month."""
    k = keys(by)
    pat = "|".join(words)
    text = F.lower(F.concat_ws(" ", F.col("category"), F.col("note")))
    return (df.filter(text.rlike(pat) & F.col("tx_date").isNotNull())
            .groupBy(*k, month_label().alias("month")).agg(F.sum("amount").alias("total")))


def set_role(users: DataFrame, usernames: Sequence[str], role: str) -> DataFrame:
    """Change the role of the named non-admin users."""
    hit = F.col("username").isin(list(usernames)) & (F.col("role") != "admin")
    return users.withColumn("role", F.when(hit, F.lit(role)).otherwise(F.col("role")))
