"""Registered streaming queries (J1-J6): replay tables as files, drain, read the sink.

Each query streams the files of the stored ledger, or rows derived from the driver tables
that it stages as parquet files in the shared checkpoint folder, runs the streaming job with an ``availableNow``
trigger (checkpointed, so a rerun resumes instead of repeating), and returns
the drained sink.  After the drain the sink must equal the batch answer of
the same operator, which is what the SQL twins state.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.operators import filters as B
from tallyspark.operators.relate import DUP_COLS
from tallyspark.schema import LEDGER_SCHEMA
from tallyspark.session import checkpoint_dir
from tallyspark.sources.testdata import finished_build, ledger, stored_ledger_path
from tallyspark.streaming import jobs as J

AS_OF = "2001-08-01"


def _dirs(spark: SparkSession, name: str) -> tuple[str, str, str]:
    base = f"{checkpoint_dir(spark).rstrip('/')}/tally-stream-{name}-{uuid.uuid4().hex[:12]}"
    return f"{base}/in", f"{base}/ckpt", f"{base}/out"


def _ledger_stream(spark, d, **options) -> DataFrame:
    """The stored ledger's own files as a stream: every row once, without a copy of them."""
    ledger(spark, d)
    stored = finished_build(spark, stored_ledger_path(spark, d))
    return J.read_ledger_stream(spark, stored, LEDGER_SCHEMA, **options).select(*LEDGER_SCHEMA.fieldNames(), "event_ts")


def q_stream_validate(spark: SparkSession, d: str) -> DataFrame:
    from tallyspark.plans.registry import raw_transactions
    src, ck, out = _dirs(spark, "validate")
    raw_transactions(spark, d).write.parquet(src)
    sdf = J.stream_validate(J.read_raw_stream(spark, src))
    J.run_available(sdf, ck, J.write_split(f"{out}/good", f"{out}/quarantine"))
    good = spark.read.parquet(f"{out}/good").drop("batch") \
        .withColumn("valid", F.lit(True)).withColumn("reasons", F.lit(""))
    bad = spark.read.parquet(f"{out}/quarantine").drop("batch")
    return good.unionByName(bad)


def q_stream_dedupe(spark: SparkSession, d: str) -> DataFrame:
    src, ck, out = _dirs(spark, "dedupe")
    L = ledger(spark, d)
    again = B.time_range(L, "last_3_months", F.lit(AS_OF).cast("date")) \
        .withColumn("tx_id", F.concat(F.lit("R-"), F.col("tx_id")))
    L.unionByName(again).write.parquet(src)
    sdf = J.stream_dedupe(J.read_ledger_stream(spark, src, LEDGER_SCHEMA))
    J.run_available(sdf, ck, J.write_batches(out))
    return spark.read.parquet(out).select(*DUP_COLS)


def q_stream_dedupe_sink(spark: SparkSession, d: str) -> DataFrame:
    """J2 at the sink (``dedupe_writer``): repeats removed with map-side combining per batch."""
    src, ck, out = _dirs(spark, "dedupe-sink")
    L = ledger(spark, d)
    again = B.time_range(L, "last_3_months", F.lit(AS_OF).cast("date")) \
        .withColumn("tx_id", F.concat(F.lit("R-"), F.col("tx_id")))
    L.write.parquet(src)
    n_first = len(spark.read.parquet(src).inputFiles())   # the repeats arrive in a later batch
    again.write.mode("append").parquet(src)
    sdf = J.read_ledger_stream(spark, src, LEDGER_SCHEMA, max_files_per_trigger=n_first)
    J.run_available(sdf.drop("event_ts"), ck, J.dedupe_writer(out, delay_days=120))
    return spark.read.parquet(out).select(*DUP_COLS)


def q_stream_weekly(spark: SparkSession, d: str) -> DataFrame:
    _, ck, out = _dirs(spark, "weekly")
    sdf = J.stream_weekly(_ledger_stream(spark, d))
    J.run_available(sdf, ck, J.write_batches(out), output_mode="update")
    return J.read_latest(spark, out, ["user_id", "week"])


def q_stream_alerts(spark: SparkSession, d: str) -> DataFrame:
    _, ck, out = _dirs(spark, "alerts")
    sdf = J.stream_alerts(_ledger_stream(spark, d))
    J.run_available(sdf, ck, J.write_batches(out), output_mode="update")
    return J.read_latest(spark, out, ["user_id"])


def q_stream_categorise(spark: SparkSession, d: str) -> DataFrame:
    from tallyspark.plans.model_queries import _fitted
    src, ck, out = _dirs(spark, "categorise")
    L = ledger(spark, d)
    model = _fitted(spark, d, "category", "train")
    L.withColumn("category", F.when(F.col("t_type") == "expense", F.lit(" ")).otherwise(F.col("category"))) \
        .write.parquet(src)
    sdf = J.stream_categorise(J.read_ledger_stream(spark, src, LEDGER_SCHEMA), model)
    J.run_available(sdf, ck, J.write_batches(out))
    return spark.read.parquet(out).select("tx_id", "user_id", "t_type", "category", "note")


def q_stream_flag(spark: SparkSession, d: str) -> DataFrame:
    from tallyspark.plans.model_queries import _fitted
    _, ck, out = _dirs(spark, "flag")
    model = _fitted(spark, d, "anomaly", "train")
    flags = J.stream_flag(_ledger_stream(spark, d), model).select("tx_id", "user_id", "amount", "score", "anomaly")
    J.run_available(flags, ck, J.write_batches(out, compression="zstd"))     # the sink holds the flags by transaction, not the ledger again
    return spark.read.parquet(out).select("tx_id", "user_id", "amount", "score", "anomaly")


STREAM_QUERIES = {
    "stream_validate": q_stream_validate,
    "stream_dedupe": q_stream_dedupe,
    "stream_dedupe_sink": q_stream_dedupe_sink,
    "stream_weekly": q_stream_weekly,
    "stream_alerts": q_stream_alerts,
    "stream_categorise": q_stream_categorise,
    "stream_flag": q_stream_flag,
}


def stream_oracle_sql(with_, oracle: dict[str, str]) -> dict[str, str]:
    """SQL twins: the drained sinks equal the batch answers."""
    return {
        "stream_validate": with_("raw") + """,
            v as (select *, lower(trim(type)) t_type, try_cast(trim(amount) as decimal(18,2)) amount_num,
                         nullif(trim(category), '') category_clean,
                         try_strptime(trim(date), '%Y-%m-%d') ts_ok, nullif(trim(note), '') note_clean from raw),
            c as (select *, coalesce(t_type in ('income', 'expense'), false) type_ok, coalesce(amount_num > 0, false) amount_ok,
                         category_clean is not null category_ok, ts_ok is not null date_ok from v)
            select id tx_id, try_cast(trim(user_id) as bigint) user_id, t_type, cast(amount_num as double) amount,
                   category_clean category, strftime(cast(ts_ok as date), '%Y-%m-%d') tx_date, note_clean note,
                   type_ok and amount_ok and category_ok and date_ok valid,
                   concat_ws(',', case when not type_ok then 'type' end, case when not amount_ok then 'amount' end,
                             case when not category_ok then 'category' end,
                             case when not date_ok then 'date' end) reasons
            from c""",
        "stream_dedupe": with_("ledger") + """
            select distinct user_id, t_type, cast(amount as double) amount, strftime(tx_date, '%Y-%m-%d') tx_date,
                   category, note from ledger""",
        "stream_dedupe_sink": with_("ledger") + """
            select distinct user_id, t_type, cast(amount as double) amount, strftime(tx_date, '%Y-%m-%d') tx_date,
                   category, note from ledger""",
        "stream_weekly": oracle["weekly_total"],
        "stream_alerts": with_("ledger") + """,
            w as (select user_id, date_trunc('week', tx_date) as week, sum(amount) total from ledger
                  where tx_date is not null group by 1, 2),
            r as (select *, row_number() over (partition by user_id order by week desc) rn from w),
            g as (select user_id, count(*) n_weeks, max(case when rn = 1 then week end) last_week,
                         max(case when rn = 1 then total end) last_total,
                         cast(sum(case when rn > 1 then total end) as double)
                           / cast(count(case when rn > 1 then 1 end) as double) mean_prev from r group by 1),
            b as (select user_id, sum(case when t_type = 'income' then amount when t_type = 'expense' then -amount
                                      else 0 end) balance from ledger group by 1)
            select g.user_id, cast(b.balance as double) balance, n_weeks,
                   strftime(last_week, '%Y-%m-%d') as last_week, cast(last_total as double) last_total, mean_prev,
                   case when n_weeks > 1 then cast(last_total as double) > mean_prev * 1.3 end alert
            from g join b on g.user_id = b.user_id""",
    }
