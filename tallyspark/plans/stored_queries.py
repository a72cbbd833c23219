"""Registered queries of what is kept at rest: versioned ledger, mixed CSV folder, indexed streams, model store.

Each writes what Spark derives from the driver tables to the shared folder and reads it back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.ml import budget as H10
from tallyspark.ml import category as H8
from tallyspark.ml import expense as H3
from tallyspark.ml.budget_sparse import assign_sparse, category_totals, fit_budget_sparse, last_month_totals
from tallyspark.ml.store import ModelStore
from tallyspark.operators.relate import DUP_COLS
from tallyspark.operators.rollups import category_matrix
from tallyspark.plans.model_queries import _fitted, _scratch, _split
from tallyspark.plans.stream_queries import _dirs, _ledger_stream
from tallyspark.schema import LEDGER_SCHEMA
from tallyspark.sources import files as A
from tallyspark.sources.evolving import EvolvingTable
from tallyspark.sources.headers import read_ledger_folder
from tallyspark.sources.testdata import households, ledger, source_key, users
from tallyspark.sources.versioned import VersionedLedger
from tallyspark.streaming import jobs as J
from tallyspark.streaming.alerts_state import rocksdb, stream_alerts_state
from tallyspark.streaming.dedupe_index import DedupeIndex
from tallyspark.streaming.monthly import MonthlyTotals

ERASED_HOUSEHOLDS = ["NATION_3", "NATION_7"]
CSV_ORDERS = [["date", "type", "amount", "category", "note", "id", "user_id"],
              ["type", "category", "amount", "date", "note", "user_id", "id"],
              ["id", "user_id", "type", "category", "amount", "date", "note"],
              ["note", "id", "date", "amount", "user_id", "category", "type"]]


def _stored(spark: SparkSession, d: str) -> VersionedLedger:
    """The ledger in two appends, each sent twice."""
    table, L = VersionedLedger(spark, _scratch(spark, "versioned")), ledger(spark, d)
    for kind in ("income", "expense", "income", "expense"):
        table.append(L.filter(F.col("t_type") == kind), batch=f"import-{kind}")
    return table


def _erased_users(spark: SparkSession, d: str) -> DataFrame:
    gone = households(spark, d).filter(F.col("name").isin(ERASED_HOUSEHOLDS)).select("household_id")
    return users(spark, d).join(gone, "household_id", "left_semi")


def q_versioned_append(spark: SparkSession, d: str) -> DataFrame:
    """Appends by batch id; the repeated ones change nothing."""
    return _stored(spark, d).read()


def q_versioned_erase(spark: SparkSession, d: str) -> DataFrame:
    """Two households' users erased from the stored ledger, old files deleted."""
    table = _stored(spark, d)
    table.erase(_erased_users(spark, d))
    table.vacuum()
    return table.read()


def q_versioned_history(spark: SparkSession, d: str) -> DataFrame:
    """Every version stays whole: its operation and its number of rows."""
    table = _stored(spark, d)
    table.erase(_erased_users(spark, d))
    out = table.history().select("version", "operation", "batch")
    counts = None
    for v in table.files.numbers():
        n = table.read(v).agg(F.count(F.lit(1)).alias("n_rows")).withColumn("version", F.lit(v).cast("long"))
        counts = n if counts is None else counts.unionByName(n)
    return out.join(counts, "version")


def q_csv_folder(spark: SparkSession, d: str) -> DataFrame:
    """A1: one folder with four column orders, matched by name."""
    path, rows = _scratch(spark, "csv-folder"), A.export_ledger(ledger(spark, d))
    for i, order in enumerate(CSV_ORDERS):
        rows.filter(F.pmod(F.xxhash64("id"), F.lit(len(CSV_ORDERS))) == i).select(*order) \
            .write.mode("append").option("header", True).csv(path)
    return read_ledger_folder(spark, path)[0]


def q_evolve_at_rest(spark: SparkSession, d: str) -> DataFrame:
    """A10: users of some households written before the role column, the others after; one column dropped."""
    table, u = EvolvingTable(spark, _scratch(spark, "evolving")), users(spark, d)
    table.create({"user_id": "long", "username": "string", "household_id": "long"})
    table.append(u.filter("household_id < 12"))
    table.add_column("role", "string", default="user")
    table.append(u.filter("household_id >= 12"))
    table.drop_column("household_id")
    return table.read()


# ---- streams
def q_stream_dedupe_index(spark: SparkSession, d: str) -> DataFrame:
    """J2 with D4: the ledger, then all of it again under other ids in later batches."""
    _, ck, out = _dirs(spark, "dedupe-index")
    sink = DedupeIndex(out, buckets=8)
    n_files = len(ledger(spark, d).inputFiles())        # every copy comes in two batches
    for copy in ("first", "again"):
        sdf = _ledger_stream(spark, d, max_files_per_trigger=max(1, -(-n_files // 2))).drop("event_ts")
        start = 0
        if copy == "again":
            sdf = sdf.withColumn("tx_id", F.concat(F.lit("R-"), F.col("tx_id")))
            start = sink.log(spark).agg(F.max("batch")).first()[0] + 1
        J.run_available(sdf, f"{ck}/{copy}", lambda batch, n, start=start: sink.write(batch, start + n))
    return sink.read(spark, LEDGER_SCHEMA).select(*DUP_COLS)


def q_stream_alerts_state(spark: SparkSession, d: str) -> DataFrame:
    """J6 as a stateful processor."""
    _, ck, out = _dirs(spark, "alerts-state")
    with rocksdb(spark):
        J.run_available(stream_alerts_state(_ledger_stream(spark, d)), ck, J.write_batches(out),
                        output_mode="update")
    return J.read_latest(spark, out, ["user_id"])


def q_stream_monthly(spark: SparkSession, d: str) -> DataFrame:
    """J5 with C8: the stored rollup after three micro-batches."""
    src, ck, out = _dirs(spark, "monthly")
    L = ledger(spark, d)        # each third in as many files as the ledger's scan has tasks
    L.repartition(3 * L.rdd.getNumPartitions(), "tx_id").write.parquet(src)
    n_files = len(spark.read.parquet(src).inputFiles())
    totals = MonthlyTotals(out, buckets=4)
    sdf = J.read_ledger_stream(spark, src, LEDGER_SCHEMA, max_files_per_trigger=max(1, -(-n_files // 3)))
    J.run_available(sdf.drop("event_ts"), ck, totals.write)
    return totals.read(spark)


# ---- any number of categories
def q_category_totals(spark: SparkSession, d: str) -> DataFrame:
    """C11 in sparse form."""
    return category_totals(ledger(spark, d))


def q_last_month_totals(spark: SparkSession, d: str) -> DataFrame:
    """C12 in sparse form."""
    return last_month_totals(ledger(spark, d))


def q_budget_clusters_notes(spark: SparkSession, d: str) -> DataFrame:
    """H10 over free text: the notes as categories, fitted on the training part, every month assigned."""
    train, L = _split(spark, d)[0], ledger(spark, d)
    by_note = [x.withColumn("category", F.col("note")) for x in (train, L)]
    return assign_sparse(fit_budget_sparse(by_note[0], n_starts=3), category_totals(by_note[1], by=[]))


# ---- models
def _through_store(spark: SparkSession, d: str, kind: str):
    store = ModelStore(spark, _scratch(spark, "models"))
    store.save(kind, _fitted(spark, d, kind, "train"), training_key=source_key(spark, d))
    return store.load(kind, training_key=source_key(spark, d))


def q_stored_category(spark: SparkSession, d: str) -> DataFrame:
    """A9 with H8: predictions of the classifier as loaded from the store."""
    return H8.predict_category(_through_store(spark, d, "category"), ledger(spark, d).filter(F.col("t_type") == "expense")) \
        .select("tx_id", "user_id", "category", "predicted")


def q_stored_expense(spark: SparkSession, d: str) -> DataFrame:
    """A9 with H3: predictions of the expense forest as loaded from the store."""
    return H3.predict_expense(_through_store(spark, d, "expense"), H3.expense_rows(_split(spark, d)[1])) \
        .select("year", "month", "label", "prediction")


def q_stored_budget(spark: SparkSession, d: str) -> DataFrame:
    """A9 with H10: clusters of every month by the model as loaded from the store."""
    m = _through_store(spark, d, "budget")
    return H10.assign_clusters(m, category_matrix(ledger(spark, d), m.categories, by=[])).select("month", "cluster", "advice")


STORED_QUERIES = {
    "versioned_append": q_versioned_append,
    "versioned_erase": q_versioned_erase,
    "versioned_history": q_versioned_history,
    "csv_folder": q_csv_folder,
    "evolve_at_rest": q_evolve_at_rest,
    "stream_dedupe_index": q_stream_dedupe_index,
    "stream_alerts_state": q_stream_alerts_state,
    "stream_monthly": q_stream_monthly,
    "category_totals": q_category_totals,
    "last_month_totals": q_last_month_totals,
    "budget_clusters_notes": q_budget_clusters_notes,
    "stored_category": q_stored_category,
    "stored_expense": q_stored_expense,
    "stored_budget": q_stored_budget,
}


def stored_oracle_sql(with_, ledger_cols: str, oracle: dict[str, str]) -> dict[str, str]:
    kept = """user_id not in (select user_id from users where household_id in
                (select household_id from households where name in ('NATION_3', 'NATION_7')))"""
    return {
        "versioned_append": with_("ledger") + f"select {ledger_cols} from ledger",
        "versioned_erase": oracle["erase_households"],
        "versioned_history": with_("ledger", "users", "households") + f"""
            select 1 as version, 'append' operation, 'import-income' batch, count(*) n_rows from ledger where t_type = 'income'
            union all select 2, 'append', 'import-expense', count(*) from ledger
            union all select 3, 'erase', null, count(*) from ledger where {kept}""",
        "csv_folder": with_("ledger") + f"select {ledger_cols} from ledger",
        "category_totals": with_("ledger") + """
            select user_id, strftime(tx_date, '%Y-%m') as month, category, cast(sum(amount) as double) total from ledger
            where t_type = 'expense' and category is not null and tx_date is not null group by 1, 2, 3""",
        "last_month_totals": with_("ledger") + """,
            t as (select user_id, strftime(tx_date, '%Y-%m') as month, category, cast(sum(amount) as double) total from ledger
                  where t_type = 'expense' and category is not null and tx_date is not null group by 1, 2, 3)
            select * from t where month = (select max(u.month) from t u where u.user_id = t.user_id)""",
        "evolve_at_rest": with_("users") + """
            select user_id, username, case when household_id < 12 then 'user' else role end role from users""",
        "stream_dedupe_index": oracle["stream_dedupe_sink"],
        "stream_alerts_state": oracle["stream_alerts"],
        "stream_monthly": oracle["monthly_total"],
    }
