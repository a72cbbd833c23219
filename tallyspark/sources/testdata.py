"""Ledger, users, households, audit and notes views over the driver tables.

The driver ships TPC-H-like tables.  The ledger is derived from them:
every order is an income row of its customer, every line item an expense row
of the ordering customer, categorised by part type and noted by part name.
The same text is used as the DuckDB oracle CTE (``LEDGER_SQL``) so both engines
see bit-equal rows.
"""

from __future__ import annotations

import hashlib
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.schema import MONEY
from tallyspark.session import checkpoint_dir


# DataFrames over immutable inputs, per session: the file listing and footer
# read happen once, not once per query.  Keys include size and time of every file.
_FRAMES: dict[tuple, DataFrame] = {}


def _hadoop(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


_IDS: dict[tuple, tuple] = {}


def _file_id(spark: SparkSession, path: str) -> str:
    """Digest of path, length and modification time of every file below ``path``, on any file system.

    The files are listed once per session while the folder's own status stays the same
    (it changes when files come, go or are renamed); later calls cost one status request.
    """
    p, fs = _hadoop(spark, path)
    if not fs.exists(p):
        return ""
    status = fs.getFileStatus(p)
    now = (status.getModificationTime(), status.getLen())
    key = (spark.sparkContext.applicationId, path)
    if _IDS.get(key, (None,))[0] == now:
        return _IDS[key][1]
    files, it = [], fs.listFiles(p, True)
    while it.hasNext():
        f = it.next()
        files.append(f"{f.getPath()}:{f.getLen()}:{f.getModificationTime()}")
    _IDS[key] = (now, hashlib.sha1("\n".join(sorted(files)).encode()).hexdigest())
    return _IDS[key][1]


_LOCK = threading.RLock()  # one builder per process; re-entrant: a build reads its source tables


def _remember(spark: SparkSession, key: tuple, make) -> DataFrame:
    k = (id(spark), spark.sparkContext.applicationId) + key
    df = _FRAMES.get(k)
    if df is None:
        with _LOCK:
            df = _FRAMES.get(k)
            if df is None:
                df = _FRAMES[k] = make()
    return df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    path = f"{sf_dir}/{name}.parquet"
    return _remember(spark, ("table", path, _file_id(spark, path)), lambda: spark.read.parquet(path))


def ledger_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fact table as a view: one row per order (income) and per line item (expense).

    lineitem x orders is a key/foreign-key join on the order key, with a hash
    table of each partition's orders, so that the line items are neither sorted
    nor spilled; lineitem x part, on the part key, is left to the planner
    (sort-merge at scale, broadcast when the parts turn out small).
    """
    orders = table(spark, sf_dir, "orders")
    income = orders.select(
        F.concat_ws("-", F.lit("O"), F.col("o_orderkey").cast("string")).alias("tx_id"),
        F.col("o_custkey").alias("user_id"),
        F.lit("income").alias("t_type"),
        F.col("o_orderpriority").alias("category"),
        F.col("o_totalprice").cast(MONEY).alias("amount"),
        F.col("o_orderdate").cast("date").alias("tx_date"),
        F.lit(None).cast("string").alias("note"),
    )
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_shipdate")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_name")
    price = F.col("l_extendedprice").cast(MONEY)
    expense = (
        li.join(orders.select("o_orderkey", "o_custkey").hint("shuffle_hash"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(part, F.col("l_partkey") == F.col("p_partkey"))
        .select(
            F.concat_ws("-", F.lit("L"), F.col("l_orderkey").cast("string"),
                        F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string"),
                        F.col("l_suppkey").cast("string"), price.cast("string")).alias("tx_id"),
            F.col("o_custkey").alias("user_id"),
            F.lit("expense").alias("t_type"),
            F.col("p_type").alias("category"),
            price.alias("amount"),
            F.col("l_shipdate").cast("date").alias("tx_date"),
            F.col("p_name").alias("note"),
        )
    )
    return income.unionByName(expense)


LEDGER_COLUMNS = ["tx_id", "user_id", "t_type", "category", "amount", "tx_date", "note"]
_SOURCES = ("orders", "lineitem", "part")
LEDGER_FORMAT = 2  # bump when the ledger definition changes: stored copies are keyed by it


def source_key(spark: SparkSession, sf_dir: str, sources: tuple[str, ...] = _SOURCES) -> str:
    """Identity of the source tables: path, length and modification time of every file."""
    parts = [sf_dir, f"v{LEDGER_FORMAT}"] + [f"{t}:{_file_id(spark, f'{sf_dir}/{t}.parquet')}" for t in sources]
    return hashlib.sha1("|".join(parts).encode()).hexdigest()[:16]


def stored_ledger_path(spark: SparkSession, sf_dir: str) -> str:
    """Folder of the stored copies; every build writes to its own ``build-*`` folder below it."""
    return f"{checkpoint_dir(spark).rstrip('/')}/tally-ledger-{source_key(spark, sf_dir)}"


def finished_build(spark: SparkSession, path: str) -> str | None:
    """The first finished build below ``path`` (one whose job committed its ``_SUCCESS`` marker), else None."""
    p, fs = _hadoop(spark, f"{path}/build-*/_SUCCESS")
    done = sorted(f.getPath().getParent().toString() for f in fs.globStatus(p) or [])
    return done[0] if done else None


def ledger(spark: SparkSession, sf_dir: str, with_month: bool = False) -> DataFrame:
    """The stored ledger: built once from ``ledger_view`` into the shared folder, then read.

    The three-way join runs once; every operator after it scans one narrow
    table, partitioned by ``tx_month`` and sorted by user and date inside the
    files, so date filters prune partitions/row groups.  ``with_month`` keeps
    the partition column for callers that filter on it.  A build that never
    finished is ignored, and two builders at once do not touch each other's
    files.
    """
    from tallyspark.sources.files import read_ledger_parquet, store_ledger
    path = stored_ledger_path(spark, sf_dir)

    def load() -> DataFrame:
        if finished_build(spark, path) is None:
            store_ledger(ledger_view(spark, sf_dir), f"{path}/build-{uuid.uuid4().hex[:12]}")
        return read_ledger_parquet(spark, finished_build(spark, path))

    df = _remember(spark, ("ledger", path), load)
    return df if with_month else df.select(*LEDGER_COLUMNS)


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users from customers; every hundredth customer is an admin."""
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("user_id"),
        F.col("c_name").alias("username"),
        F.when(F.col("c_custkey") % 100 == 0, F.lit("admin")).otherwise(F.lit("user")).alias("role"),
        F.col("c_nationkey").cast("long").alias("household_id"),
    )


def households(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").cast("long").alias("household_id"),
        F.col("n_name").alias("name"),
    )


def audit_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit log stand-in: (event_id, ts, user_id, event_type, value, props)."""
    return table(spark, sf_dir, "events")


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled notes for the text models: document text as note, language as category."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("tx_id"),
        F.col("doc_id").alias("user_id"),
        F.col("text").alias("note"),
        F.col("lang").alias("category"),
    )


# DuckDB twin of ``ledger`` (identical text runs in Spark SQL too).
LEDGER_SQL = """
select concat_ws('-','O',cast(o_orderkey as string)) tx_id, o_custkey user_id, 'income' t_type,
       o_orderpriority category, cast(o_totalprice as decimal(18,2)) amount,
       cast(o_orderdate as date) tx_date, cast(null as string) note from orders
union all
select concat_ws('-','L',cast(l_orderkey as string),cast(l_linenumber as string),cast(l_partkey as string),
                 cast(l_suppkey as string),cast(cast(l_extendedprice as decimal(18,2)) as string)),
       o_custkey, 'expense', p_type, cast(l_extendedprice as decimal(18,2)), cast(l_shipdate as date), p_name
from lineitem join orders on l_orderkey=o_orderkey join part on l_partkey=p_partkey
"""

USERS_SQL = """
select c_custkey user_id, c_name username,
       case when c_custkey % 100 = 0 then 'admin' else 'user' end role,
       cast(c_nationkey as bigint) household_id
from customer
"""

HOUSEHOLDS_SQL = "select cast(n_nationkey as bigint) household_id, n_name name from nation"
