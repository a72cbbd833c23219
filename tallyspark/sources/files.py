"""Sources and sinks (A1-A11): CSV/JSON ledgers, exports, appends, schema evolution.

Files are read with explicit schemas (no inference pass over the data) and
columns are matched by name, so files with different column orders load into
one frame.  The ledger at rest is parquet partitioned by ``tx_month``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.functions.columns import blank_to_null, month_label, strict_date
from tallyspark.schema import LEDGER_SCHEMA, MONEY

# Column names a ledger file may use, mapped to the ledger's own names.
LEDGER_ALIASES = {"id": "tx_id", "type": "t_type", "date": "tx_date"}


def _as_ledger(df: DataFrame, default_user: int | None = None) -> DataFrame:
    """Rename known aliases and cast text columns to the ledger types, by name."""
    for a, b in LEDGER_ALIASES.items():
        if a in df.columns and b not in df.columns:
            df = df.withColumnRenamed(a, b)
    cols = []
    for f in LEDGER_SCHEMA.fields:
        if f.name not in df.columns:
            if f.name == "user_id" and default_user is not None:
                cols.append(F.lit(default_user).cast("long").alias("user_id"))
            elif f.name == "tx_id":
                cols.append(F.sha2(F.to_json(F.struct(*[F.col(c) for c in df.columns])), 256).alias("tx_id"))
            else:
                cols.append(F.lit(None).cast(f.dataType).alias(f.name))
            continue
        c = F.col(f.name)
        if isinstance(f.dataType, T.DateType):
            c = strict_date(c.cast("string"))
        elif isinstance(f.dataType, T.DecimalType):
            c = F.expr(f"try_cast(trim(cast(`{f.name}` as string)) as decimal(18,2))")
        elif isinstance(f.dataType, T.LongType):
            t = f"trim(cast(`{f.name}` as string))"
            c = F.expr(f"coalesce(try_cast({t} as bigint), try_cast(try_cast({t} as double) as bigint))")
        elif f.name == "note":
            c = blank_to_null(c)
        else:
            c = c.cast("string")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def read_ledger_csv(spark: SparkSession, paths: str | Sequence[str], user_id: int | None = None) -> DataFrame:
    """A1: ledger CSV files with a header, any column order, CRLF or LF.

    Every path is read as text columns by its own header, then aligned by name
    (``unionByName(allowMissingColumns=True)``) and cast.  Files below one path
    must agree in their header: with ``enforceSchema`` off, Spark raises an
    error where one differs instead of taking columns by position; give such
    files as paths of their own.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    frames = [spark.read.option("header", True).option("inferSchema", False).option("enforceSchema", False).csv(p)
              for p in paths]
    df = frames[0]
    for f in frames[1:]:
        df = df.unionByName(f, allowMissingColumns=True)
    return _as_ledger(df, user_id)


RECORD_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in [*LEDGER_SCHEMA.names, *LEDGER_ALIASES]])
JSON_SCHEMA = T.StructType([*RECORD_SCHEMA.fields, T.StructField("transactions", T.ArrayType(RECORD_SCHEMA))])


def read_ledger_json(spark: SparkSession, path: str, user_id: int | None = None) -> DataFrame:
    """A3: JSON lines, each a record or a ``{"transactions": [...]}`` payload, in any mixture.

    One pass with one explicit schema.  A record's own user wins over
    ``user_id``; a record without an id gets the hash of its content.
    """
    raw = spark.read.schema(JSON_SCHEMA).json(path)
    record = F.struct(*RECORD_SCHEMA.names)
    raw = raw.select(F.explode(F.coalesce("transactions", F.array(record))).alias("t"))
    named = [F.coalesce(F.col(f"t.{b}"), F.col(f"t.{a}")).alias(b) for a, b in LEDGER_ALIASES.items()]
    rest = [F.col(f"t.{c}") for c in LEDGER_SCHEMA.names if c not in LEDGER_ALIASES.values()]
    rows = raw.select(*named, *rest, F.sha2(F.to_json("t"), 256).alias("_hash"))
    rows = rows.withColumn("tx_id", F.coalesce("tx_id", "_hash"))
    if user_id is not None:
        rows = rows.withColumn("user_id", F.coalesce("user_id", F.lit(str(user_id))))
    return _as_ledger(rows.drop("_hash"))


def export_users(users: DataFrame) -> DataFrame:
    """The user export: id, username, role, household id (never a password hash)."""
    return users.select(F.col("user_id").alias("id"), "username", "role", "household_id")


def export_ledger(ledger: DataFrame) -> DataFrame:
    """The ledger export with the reference's column names."""
    return ledger.select(F.col("tx_id").alias("id"), "user_id", F.col("t_type").alias("type"), "category",
                         "amount", F.col("tx_date").alias("date"), "note")


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> bool:
    """A5: CSV with a header; an empty frame writes nothing and returns False."""
    if df.isEmpty():
        return False
    df.write.mode(mode).option("header", True).csv(path)
    return True


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> bool:
    """JSON lines with ISO dates; an empty frame writes nothing and returns False."""
    if df.isEmpty():
        return False
    df.write.mode(mode).option("dateFormat", "yyyy-MM-dd").json(path)
    return True


def append_ledger(df: DataFrame, path: str) -> None:
    """Append rows to the parquet ledger partitioned by ``tx_month``."""
    (df.withColumn("tx_month", month_label("tx_date"))
       .write.mode("append").partitionBy("tx_month").parquet(path))


def store_ledger(df: DataFrame, path: str) -> None:
    """Write the ledger as a fact table partitioned by ``tx_month``.

    ``rebalance(tx_month)`` lets AQE size the write tasks (a large month is
    split, small ones are combined), and rows are sorted by user and date
    inside each file so parquet statistics skip row groups for user- or
    date-scoped reads.
    """
    (df.withColumn("tx_month", month_label("tx_date"))
       .hint("rebalance", "tx_month")
       .sortWithinPartitions("tx_month", "user_id", "tx_date")
       .write.mode("overwrite").option("compression", "zstd").partitionBy("tx_month").parquet(path))


def read_ledger_parquet(spark: SparkSession, path: str) -> DataFrame:
    """The stored ledger; filters on ``tx_month`` prune partitions.

    The schema is read from the files: a folder without committed data files
    (a build that never finished) fails here instead of reading as empty.
    """
    return spark.read.parquet(path)


def overwrite_partitions(df: DataFrame, path: str) -> None:
    """Rewrite only the ``tx_month`` partitions present in ``df`` (D6 on files)."""
    (df.withColumn("tx_month", month_label("tx_date")) if "tx_month" not in df.columns else df) \
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic") \
        .partitionBy("tx_month").parquet(path)


def evolve(df: DataFrame, defaults: Mapping[str, object], drop: Sequence[str] = ()) -> DataFrame:
    """A10: add columns with a default to old rows (null -> default), drop others."""
    for c, v in defaults.items():
        df = df.withColumn(c, F.coalesce(F.col(c), F.lit(v)) if c in df.columns else F.lit(v))
    return df.drop(*drop) if drop else df


def append_events(events: DataFrame, path: str) -> None:
    """Append audit events (event, user, ISO timestamp) as parquet."""
    events.write.mode("append").parquet(path)


def ledger_money(df: DataFrame) -> DataFrame:
    """Cast a float amount column to the money type."""
    return df.withColumn("amount", F.col("amount").cast(MONEY))
