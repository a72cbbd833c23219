"""Column expressions shared by the operators (all built-in, JVM side)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.schema import MONEY


def keys(by: Sequence[str] | None) -> list[str]:
    """Normalise a ``by`` argument; ``None`` means per user, ``[]`` the whole ledger."""
    return ["user_id"] if by is None else list(by)


def money(c: Column | str) -> Column:
    return F.col(c).cast(MONEY) if isinstance(c, str) else c.cast(MONEY)


def cents(c: Column | str) -> Column:
    """Exact integer cents of a decimal amount (never via double)."""
    c = F.col(c) if isinstance(c, str) else c
    return (c * 100).cast("bigint")


def ratio(num: Column, den: Column) -> Column:
    """``num / den`` as double, both sides cast first so engines agree bit for bit."""
    return num.cast("double") / den.cast("double")


def month_start(d: Column | str = "tx_date") -> Column:
    return F.trunc(F.col(d) if isinstance(d, str) else d, "MM")


def month_label(d: Column | str = "tx_date") -> Column:
    """``yyyy-MM`` label of a date (pandas ``Period('M')`` as text)."""
    return F.date_format(F.col(d) if isinstance(d, str) else d, "yyyy-MM")


def week_start(d: Column | str = "tx_date") -> Column:
    """Monday of the ISO week (pandas ``Period('W')`` runs Monday to Sunday)."""
    return F.date_trunc("week", F.col(d) if isinstance(d, str) else d).cast("date")


def strict_date(s: Column | str) -> Column:
    """``%Y-%m-%d`` as strptime reads it (one-digit month/day allowed); null if bad."""
    s = F.col(s) if isinstance(s, str) else s
    return F.try_to_date(F.trim(s), "yyyy-M-d")


def blank_to_null(s: Column | str) -> Column:
    s = F.col(s) if isinstance(s, str) else s
    return F.nullif(F.trim(s), F.lit(""))


def money_text(c: Column | str) -> Column:
    """``$1,234.50``: thousands separator, two decimals."""
    c = F.col(c) if isinstance(c, str) else c
    return F.concat(F.lit("$"), F.format_number(c.cast("double"), 2))


def pct_text(c: Column | str) -> Column:
    """``12.3%``."""
    c = F.col(c) if isinstance(c, str) else c
    return F.format_string("%.1f%%", c.cast("double"))


def present(df: DataFrame) -> DataFrame:
    """Presentation form used at the result boundary.

    Money decimals become doubles (exact sums cast once), dates and timestamps
    ISO text, small integers bigint.  The DuckDB oracle applies the same casts.
    """
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        dt = f.dataType
        if isinstance(dt, T.DecimalType) or isinstance(dt, T.FloatType):
            c = c.cast("double")
        elif isinstance(dt, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(dt, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(dt, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("bigint")
        cols.append(c.alias(f.name))
    return df.select(*cols)
