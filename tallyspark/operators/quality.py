"""Data quality and governance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.columns import keys
from tallyspark.operators.rollups import category_share, null_audit
from tallyspark.schema import DOMINANCE_SHARE, SENSITIVE_NAME_PARTS, UNDERREPRESENTED_SHARE


def imbalance(df: DataFrame, by: Sequence[str] | None = None, threshold: float = DOMINANCE_SHARE) -> DataFrame:
    """Largest category share above ``threshold``."""
    k = keys(by)
    return (category_share(df, by).groupBy(*k).agg(F.max("share").alias("max_share"))
            .withColumn("imbalanced", F.col("max_share") > F.lit(threshold)))


def underrepresented(df: DataFrame, by: Sequence[str] | None = None,
                     threshold: float = UNDERREPRESENTED_SHARE) -> DataFrame:
    """Smallest category share below ``threshold``."""
    k = keys(by)
    return (category_share(df, by).groupBy(*k).agg(F.min("share").alias("min_share"),
                                                    F.count(F.lit(1)).alias("n_categories"))
            .withColumn("underrepresented", F.col("min_share") < F.lit(threshold)))


def missing_verdict(df: DataFrame) -> DataFrame:
    """Total null cells and whether any exist."""
    a = null_audit(df)
    return a.select("null_total", (F.col("null_total") > 0).alias("has_missing"))


def sensitive_columns(df: DataFrame) -> DataFrame:
    """I4: columns whose name contains ``name`` or ``account``, with how many rows hold a value.

    Names come from the schema; the exposure counts are one aggregate pass.
    """
    hits = [c for c in df.columns if any(p in c.lower() for p in SENSITIVE_NAME_PARTS)]
    if not hits:
        return df.sparkSession.createDataFrame([], "column_name string, non_null long")
    counts = df.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in hits])
    return counts.unpivot([], hits, "column_name", "non_null")


def masked(df: DataFrame, col: str = "note") -> DataFrame:
    """Text masked before it is logged (upper X, lower x, digits n)."""
    return df.withColumn(col, F.mask(F.col(col)))


def audit_summary(events: DataFrame) -> DataFrame:
    """Per event type and user: count, first, last and days between."""
    return (events.groupBy("event_type", "user_id")
            .agg(F.count(F.lit(1)).alias("n_events"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
            .withColumn("retention_days", F.datediff(F.col("last_ts").cast("date"), F.col("first_ts").cast("date"))))


def encrypt_fields(df: DataFrame, key: str, cols: Sequence[str] = ("note", "amount")) -> DataFrame:
    """AES-GCM encrypt columns to base64 text with one key from the caller.

    The key is a literal of the plan; for data at rest use ``envelope.KeyRing``, whose keys stand in no plan.
    """
    k = F.lit(key)
    out = df
    for c in cols:
        out = out.withColumn(c, F.base64(F.aes_encrypt(F.col(c).cast("string").cast("binary"), k)))
    return out


def decrypt_fields(df: DataFrame, key: str, cols: Sequence[str] = ("note", "amount")) -> DataFrame:
    """Decrypt; a value that does not decrypt is returned unchanged."""
    k = F.lit(key)
    out = df
    for c in cols:
        dec = F.try_aes_decrypt(F.expr(f"try_to_binary(`{c}`, 'base64')"), k).cast("string")
        out = out.withColumn(c, F.coalesce(dec, F.col(c)))
    return out


def encryption_coverage(df: DataFrame, key: str, col: str = "note", by: Sequence[str] | None = None) -> DataFrame:
    """I8: share of non-null values of ``col`` that decrypt with ``key``."""
    k = keys(by)
    ok = F.try_aes_decrypt(F.expr(f"try_to_binary(`{col}`, 'base64')"), F.lit(key)).isNotNull()
    return (df.filter(F.col(col).isNotNull()).groupBy(*k)
            .agg(F.avg(ok.cast("double")).alias("encrypted_share"), F.count(F.lit(1)).alias("n")))
