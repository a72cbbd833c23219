"""Joins (D1-D8): lookups, membership, period comparison, duplicates, erasure, orphans.

No side is forced to be broadcast by its row count: the planner and adaptive
execution choose by bytes.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.columns import keys, month_label
from tallyspark.operators.filters import period_months, period_predicate
from tallyspark.schema import EXPENSE


def enrich(ledger: DataFrame, users: DataFrame, households: DataFrame) -> DataFrame:
    """Ledger rows with username, role, household id and name.

    Which side is broadcast is left to the planner and adaptive execution, which go by bytes.
    """
    u = users.select("user_id", "username", "role", "household_id")
    h = households.select("household_id", F.col("name").alias("household_name"))
    uh = u.join(h, "household_id", "left")
    return ledger.join(uh, "user_id", "inner")


def ledger_for_users(ledger: DataFrame, users: DataFrame) -> DataFrame:
    """A2: the ledger scoped to some users, in ledger order (date, id).

    A left-semi join; on a stored ledger sorted by user inside its files the
    user filter also skips row groups.
    """
    return ledger.join(users.select("user_id"), "user_id", "left_semi").orderBy("user_id", "tx_date", "tx_id")


def active_users(users: DataFrame, ledger: DataFrame, n: int = 50) -> DataFrame:
    """Users owning at least one of the ``n`` latest ledger rows."""
    latest = ledger.orderBy(F.col("tx_date").desc(), F.col("tx_id").desc()).limit(n)
    return users.join(F.broadcast(latest.select("user_id")), "user_id", "left_semi")


def compare_periods(df: DataFrame, p1: str, p2: str, as_of: _dt.date,
                    by: Sequence[str] | None = None) -> DataFrame:
    """D3: expense per category in two named periods; 0 where a period lacks it.

    One pass with conditional sums; the group set is the union of both
    periods' categories (a full outer join of the two rollups).  On a stored
    ledger only the months of the two periods are read.
    """
    k = keys(by)
    in1, in2 = period_predicate(p1, as_of), period_predicate(p2, as_of)
    zero = F.lit(0).cast("decimal(28,2)")
    if "tx_month" in df.columns:
        df = df.filter(period_months(p1, as_of) | period_months(p2, as_of))
    return (df.filter((F.col("t_type") == EXPENSE) & F.col("category").isNotNull() & (in1 | in2))
            .groupBy(*k, "category")
            .agg(F.coalesce(F.sum(F.when(in1, F.col("amount"))), zero).alias("period1_total"),
                 F.coalesce(F.sum(F.when(in2, F.col("amount"))), zero).alias("period2_total")))


DUP_COLS = ["user_id", "t_type", "amount", "tx_date", "category", "note"]


def drop_known(new: DataFrame, ledger: DataFrame) -> DataFrame:
    """New rows that repeat neither each other nor a stored row.

    Equality is on (user, type, amount, date, category, note) with the note
    compared null-safely.  On a stored ledger only the months of the new rows
    are read (their names, at most one per month of the batch, are fetched first).
    """
    batch = new.dropDuplicates(DUP_COLS)
    if "tx_month" in ledger.columns:
        months = [r[0] for r in new.select(month_label("tx_date").alias("m")).distinct().collect() if r[0] is not None]
        ledger = ledger.filter(F.col("tx_month").isin(months))
    stored = ledger.select(*[F.col(c).alias(f"_s_{c}") for c in DUP_COLS])
    cond = [F.col(c).eqNullSafe(F.col(f"_s_{c}")) if c == "note" else (F.col(c) == F.col(f"_s_{c}"))
            for c in DUP_COLS]
    return batch.join(stored, cond, "left_anti")


def household_members(households: DataFrame, users: DataFrame) -> DataFrame:
    """Member count per household, 0 kept (users aggregated before the join)."""
    counts = (users.filter(F.col("household_id").isNotNull())
              .groupBy("household_id").agg(F.count(F.lit(1)).alias("members")))
    return (households.join(counts, "household_id", "left")
            .select("household_id", "name", F.coalesce("members", F.lit(0).cast("long")).alias("members")))


def erase_users(ledger: DataFrame, users: DataFrame, usernames: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Remove users by name and, cascading, their transactions."""
    gone = users.filter(F.col("username").isin(list(usernames))).select("user_id")
    return (ledger.join(gone, "user_id", "left_anti"), users.join(gone, "user_id", "left_anti"))


def erase_households(ledger: DataFrame, users: DataFrame, households: DataFrame,
                     names: Sequence[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Remove households by name, their users and those users' transactions."""
    gone_h = households.filter(F.col("name").isin(list(names))).select("household_id")
    gone_u = users.join(gone_h, "household_id", "left_semi").select("user_id")
    return (ledger.join(gone_u, "user_id", "left_anti"),
            users.join(gone_u, "user_id", "left_anti"),
            households.join(gone_h, "household_id", "left_anti"))


def uniqueness_violations(df: DataFrame, col: str) -> DataFrame:
    """Values of ``col`` held by more than one row."""
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def orphans(child: DataFrame, parent: DataFrame, key: str, parent_key: str | None = None) -> DataFrame:
    """Child rows whose non-null key has no parent row."""
    pk = parent_key or key
    p = parent.select(F.col(pk).alias("_pk"))
    return child.filter(F.col(key).isNotNull()).join(p, F.col(key) == F.col("_pk"), "left_anti")
