"""The insert path as Structured Streaming.

Rows arrive as files of raw text transactions.  Every stage is a streaming
DataFrame operator; sinks are ``foreachBatch`` writers that write batch
``N`` to its own folder with overwrite, so a batch replayed after a failure
replaces its own output (exactly-once together with the checkpoint).

* J1 ``stream_validate``   B2-B6 rules; ``write_split`` sends good rows on and
  bad rows with reasons to a quarantine folder.
* J2 ``stream_dedupe``     repeats on (user, type, amount, date, category,
  note) dropped within the lateness limit (``dropDuplicatesWithinWatermark``);
  ``dedupe_writer`` does the same at the sink with map-side combining, for
  inputs where one copy group can hold a large share of the rows.
* J3 ``stream_categorise`` model suggestion when the category is blank.
* J4 ``stream_flag``       anomaly score and flag per arriving expense.
* J5 ``stream_weekly``     Monday-aligned tumbling weekly totals, watermarked.
* J6 ``stream_alerts``     per-user running balance and weekly alert kept in
  state (``applyInPandasWithState``); weeks older than the watermark are
  folded into a sum and a count, so state per user stays a few numbers.
  Users are kept in ``USER_GROUPS`` books, one state value each, as a call of
  Python for every user costs far more than its rows; a book's users are worked
  on together in numpy.
  Rows are summed per (user, week) inside their task before the shuffle, so a
  user with a large share of a batch sends a few rows.  The balance holds every
  row, late and undated ones too; a row whose week closed before the current
  watermark no longer changes the weekly figures (Spark's own operators, J5,
  use the previous batch's watermark: one batch later).  A null amount counts
  as nothing.
"""

from __future__ import annotations

import datetime as dt
import sys
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tallyspark.functions.columns import keys, week_start
from tallyspark.operators.filters import validate
from tallyspark.operators.relate import DUP_COLS
from tallyspark.schema import EXPENSE, INCOME, RAW_TX_SCHEMA, UNCATEGORIZED_RESOLVED, WEEKLY_ALERT_FACTOR

# workers and the Python process beside the driver (alerts_state) get these functions by value
cloudpickle.register_pickle_by_value(sys.modules[__name__])

WEEK_MS = 7 * 24 * 3600 * 1000
DAY_MS = 24 * 3600 * 1000
EPOCH = dt.date(1970, 1, 1)


# ------------------------------------------------------------------ sources
def read_raw_stream(spark: SparkSession, path: str, fmt: str = "parquet",
                    max_files_per_trigger: int | None = None,
                    schema: T.StructType = RAW_TX_SCHEMA) -> DataFrame:
    r = spark.readStream.schema(schema).format(fmt)
    if fmt == "csv":
        r = r.option("header", True)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.load(path)


def read_ledger_stream(spark: SparkSession, path: str, schema: T.StructType,
                       max_files_per_trigger: int | None = None) -> DataFrame:
    """Typed ledger rows from parquet files, with ``event_ts`` (the transaction date).

    ``event_ts`` is the UTC midnight of the date (from days since the epoch),
    so windows, watermarks and week labels follow the calendar date whatever
    the session time zone.
    """
    r = spark.readStream.schema(schema)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.parquet(path).withColumn(
        "event_ts", F.timestamp_seconds(F.unix_date("tx_date").cast("long") * 86400))


# ------------------------------------------------------------------ J1
def stream_validate(raw: DataFrame) -> DataFrame:
    """Raw text stream -> typed ledger columns plus ``valid`` and ``reasons``."""
    v = validate(raw)
    return v.select(
        F.col("id").alias("tx_id"),
        F.expr("try_cast(trim(user_id) as bigint)").alias("user_id"),
        "t_type", F.col("amount_num").alias("amount"), F.col("category_clean").alias("category"),
        "tx_date", F.col("note_clean").alias("note"), "valid", F.array_join("reasons", ",").alias("reasons"),
    )


def write_split(good_path: str, quarantine_path: str):
    """``foreachBatch`` writer: valid rows to ``good_path``, the rest to ``quarantine_path``.

    Batch ``N`` goes to ``.../batch=N`` with overwrite: idempotent on replay.
    """
    def _write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()     # two writers: the batch is read and validated once
        try:
            batch.filter("valid").drop("valid", "reasons") \
                .write.mode("overwrite").parquet(f"{good_path}/batch={batch_id}")
            batch.filter("valid is null or not valid").write.mode("overwrite").parquet(f"{quarantine_path}/batch={batch_id}")
        finally:
            batch.unpersist()
    return _write


# ------------------------------------------------------------------ J2
def stream_dedupe(sdf: DataFrame, delay: str = "30 days", cols: Sequence[str] = tuple(DUP_COLS)) -> DataFrame:
    """Drop repeats of ``cols`` arriving within ``delay`` of each other (event time)."""
    return sdf.withWatermark("event_ts", delay).dropDuplicatesWithinWatermark(list(cols))


def dedupe_writer(path: str, delay_days: int = 30, cols: Sequence[str] = tuple(DUP_COLS)):
    """J2 at the sink: ``foreachBatch`` writer that stores only rows not seen before.

    Copies inside a batch are removed with ``dropDuplicates`` (map-side combine:
    a copy group holding a third of the rows costs one row per task before the
    shuffle); rows already stored by earlier batches within ``delay_days`` of
    the batch's dates are removed by a null-safe anti-join (D4).  Batch ``N``
    is written to ``batch=N`` with overwrite and compared only with batches
    ``< N``, so a replayed batch gives the same output.
    """
    from pyspark.errors import AnalysisException
    from tallyspark.operators.relate import drop_known

    def _write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates(list(cols))
        try:
            seen = spark.read.parquet(path).filter(F.col("batch") < batch_id)
        except AnalysisException:   # nothing stored yet
            seen = None
        if seen is not None:
            lo = fresh.agg(F.min("tx_date")).first()[0]
            if lo is not None:
                seen = seen.filter(F.col("tx_date") >= F.date_sub(F.lit(lo), delay_days))
            fresh = drop_known(fresh, seen.drop("batch"))
        fresh.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
    return _write


# ------------------------------------------------------------------ J3 / J4
def stream_categorise(sdf: DataFrame, model) -> DataFrame:
    """Blank categories take the classifier's suggestion for the note."""
    from tallyspark.ml.category import predict_category
    blank = F.nullif(F.trim(F.col("category")), F.lit(""))
    tmp = sdf.withColumn("_typed", blank).withColumn("note", F.coalesce(F.col("note"), F.lit("")))
    out = predict_category(model, tmp.drop("category").withColumnRenamed("_typed", "category"))
    return out.withColumn("category", F.coalesce(F.col("category"),
                                                 F.when(F.col("note") != "", F.col("predicted")),
                                                 F.lit(UNCATEGORIZED_RESOLVED))) \
              .withColumn("note", F.nullif(F.col("note"), F.lit(""))).drop("predicted", "probability")


def stream_flag(sdf: DataFrame, model) -> DataFrame:
    """Anomaly score and flag for each arriving expense, by transaction id."""
    from tallyspark.ml.anomaly import score_anomalies
    return score_anomalies(model, sdf)


# ------------------------------------------------------------------ J5
def stream_weekly(sdf: DataFrame, delay: str = "30 days", by: Sequence[str] | None = None) -> DataFrame:
    """Tumbling Monday-to-Sunday totals (epoch starts on a Thursday: offset 4 days)."""
    k = keys(by)
    return (sdf.withWatermark("event_ts", delay)
            .groupBy(*k, F.window("event_ts", "1 week", "1 week", "4 days").alias("w"))
            .agg(F.sum("amount").alias("total"))
            .select(*k, F.date_from_unix_date((F.unix_seconds(F.col("w.start")) / 86400).cast("int")).alias("week"),
                    "total"))


def write_batches(path: str, **options):
    """``foreachBatch`` writer keeping every batch's update under ``batch=N`` (idempotent)."""
    def _write(batch: DataFrame, batch_id: int) -> None:
        batch.write.options(**options).mode("overwrite").parquet(f"{path}/batch={batch_id}")
    return _write


def read_latest(spark: SparkSession, path: str, key: Sequence[str]) -> DataFrame:
    """Compact an update-mode sink: the last written row per key."""
    df = spark.read.parquet(path)
    rest = [c for c in df.columns if c not in key and c != "batch"]
    last = df.groupBy(*key).agg(F.max_by(F.struct(*rest), "batch").alias("_last"))
    return last.select(*key, *[F.col(f"_last.{c}").alias(c) for c in rest]).select(*[c for c in df.columns if c != "batch"])


# ------------------------------------------------------------------ J6
USER_GROUPS = 1 << 14       # books of users; a batch rewrites the books that it has rows of
NO_WEEK = -(1 << 40)
ALERT_STATE = T.StructType([T.StructField("book", T.BinaryType())])
ALERT_OUTPUT = T.StructType([
    T.StructField("user_id", T.LongType()),
    T.StructField("balance", T.DoubleType()),
    T.StructField("n_weeks", T.LongType()),
    T.StructField("last_week", T.DateType()),
    T.StructField("last_total", T.DoubleType()),
    T.StructField("mean_prev", T.DoubleType()),
    T.StructField("alert", T.BooleanType()),
])


WEEK_SUMS = "user_id long, week_day long, signed long, cents long, event_us long"


def _sum_weeks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums per (user, week) of every Arrow batch, with the latest event time."""
    for b in batches:
        t = pa.Table.from_batches([b]).group_by(["user_id", "week_day"]).aggregate(
            [("signed", "sum"), ("cents", "sum"), ("event_us", "max")])
        t = t.rename_columns([c.removesuffix("_sum").removesuffix("_max") for c in t.column_names])
        yield from t.select(["user_id", "week_day", "signed", "cents", "event_us"]).to_batches()


def week_sums(pdf: pd.DataFrame, watermark_ms: int) -> Iterator[tuple[int, int]]:
    """(week, cents) of the dated rows; weeks that closed before the watermark stay as they are (J5 too).

    A user has a few rows, so plain numbers are several times faster here than pandas grouping.
    """
    for w, c in zip(pdf["week_day"].tolist(), pdf["cents"].tolist()):
        if w == w and w is not None and not (watermark_ms and 0 < watermark_ms >= w * DAY_MS + WEEK_MS):
            yield int(w), int(c)


def alert_row(user_id, balance: int, n_prev: int, prev_cents: int, last_day: int, last_cents: int, factor: float) -> pd.DataFrame:
    """One output row of J6; amounts in cents, ``n_prev`` weeks before the last one."""
    last_total = last_cents / 100.0
    mean_prev = (prev_cents / 100.0) / float(n_prev) if n_prev else None
    row = (user_id, balance / 100.0, n_prev + 1, EPOCH + dt.timedelta(days=last_day), last_total, mean_prev,
           (last_total > mean_prev * factor) if n_prev else None)
    return pd.DataFrame([row], columns=ALERT_OUTPUT.names)


@dataclass
class Book:
    """Totals and open weeks of several users."""
    users: np.ndarray           # ascending
    totals: np.ndarray          # (users, 3): balance, sum and number of folded weeks
    owner: np.ndarray           # of every open week, in order of owner and day: the user's place
    day: np.ndarray
    cents: np.ndarray

    @classmethod
    def unpack(cls, raw: bytes | None) -> Book:
        if raw is None:
            return cls(*[np.zeros(n, dtype=np.int64) for n in (0, (0, 3), 0, 0, 0)])
        x = np.frombuffer(zlib.decompress(raw), dtype=np.int64)
        n, w = int(x[0]), int(x[1])
        parts = np.split(x[2:], np.cumsum([n, 3 * n, w, w]))
        return cls(parts[0], parts[1].reshape(n, 3), *parts[2:])

    def pack(self) -> bytes:
        head = np.array([len(self.users), len(self.day)])
        return zlib.compress(np.concatenate([head, self.users, self.totals.ravel(), self.owner, self.day, self.cents]).astype(np.int64).tobytes(), 1)

    def add(self, users: np.ndarray, signed: np.ndarray, day: np.ndarray, cents: np.ndarray, watermark_ms: int) -> Book:
        """With more rows; the balance holds every row, weeks that closed before the watermark stay as they are (J5 too)."""
        known, place = np.unique(np.concatenate([self.users, users]), return_inverse=True)
        old, new = place[:len(self.users)], place[len(self.users):]
        totals = np.zeros((len(known), 3), dtype=np.int64)
        totals[old] = self.totals
        np.add.at(totals[:, 0], new, signed)
        dated = day != NO_WEEK
        if watermark_ms > 0:
            dated &= day * DAY_MS + WEEK_MS > watermark_ms
        owner, day = np.concatenate([old[self.owner], new[dated]]), np.concatenate([self.day, day[dated]])
        cents = np.concatenate([self.cents, cents[dated]])
        order = np.lexsort((day, owner))
        owner, day, cents = owner[order], day[order], cents[order]
        first = np.flatnonzero(np.diff(owner, prepend=-1) | np.diff(day, prepend=NO_WEEK))
        return Book(known, totals, owner[first], day[first], np.add.reduceat(cents, first) if len(first) else cents).folded(watermark_ms)

    def newest(self) -> np.ndarray:
        return np.diff(self.owner, append=-1) != 0

    def folded(self, until_ms: int) -> Book:
        """Weeks that ended at ``until_ms`` or before go to the totals, except every user's newest."""
        closed = ~self.newest() & (self.day * DAY_MS + WEEK_MS <= until_ms) if until_ms > 0 else np.zeros(len(self.day), dtype=bool)
        totals = self.totals.copy()
        np.add.at(totals[:, 1], self.owner[closed], self.cents[closed])
        np.add.at(totals[:, 2], self.owner[closed], 1)
        return Book(self.users, totals, self.owner[~closed], self.day[~closed], self.cents[~closed])

    def first_end(self) -> int:
        """End of the first open week that is not its user's newest, in ms; 0 without one."""
        closing = self.day[~self.newest()]
        return int(closing.min()) * DAY_MS + WEEK_MS if len(closing) else 0

    def rows(self, users: np.ndarray, factor: float, nobody: bool) -> pd.DataFrame:
        """Output of J6 for these users, as far as they have weeks; ``nobody``: for the rows without a user."""
        last = np.flatnonzero(self.newest())
        last = last[np.isin(self.users[self.owner[last]], users)]
        at = self.owner[last]
        sums = np.zeros(len(self.users), dtype=np.int64)
        np.add.at(sums, self.owner, self.cents)
        n_prev = self.totals[at, 2] + np.bincount(self.owner, minlength=len(self.users))[at] - 1
        last_total = self.cents[last] / 100.0
        mean = np.where(n_prev > 0, (self.totals[at, 1] + sums[at] - self.cents[last]) / 100.0 / np.maximum(n_prev, 1), np.nan)
        alert = np.where(n_prev > 0, last_total > mean * factor, None)
        return pd.DataFrame({"user_id": [None] * len(at) if nobody else self.users[at], "balance": self.totals[at, 0] / 100.0, "n_weeks": n_prev + 1,
                             "last_week": self.day[last].astype("datetime64[D]").astype(object), "last_total": last_total, "mean_prev": mean,
                             "alert": alert}, columns=ALERT_OUTPUT.names)


def booked(rows: DataFrame, books: int) -> DataFrame:
    """Week sums with the book of their user; those without a user have a book of their own, the one beyond the last."""
    return rows.withColumn("book", F.coalesce(F.when(F.col("user_id").isNotNull(), F.pmod(F.xxhash64("user_id"), F.lit(books))), F.lit(books)).cast("long")) \
        .withColumn("user_id", F.coalesce("user_id", F.lit(0).cast("long"))).withColumn("week_day", F.coalesce("week_day", F.lit(NO_WEEK)))


def batch_columns(batches: Iterator[pd.DataFrame]) -> list[np.ndarray]:
    """Users, signed and plain cents and weeks of a book's rows in this batch."""
    parts = [[pdf[c].to_numpy(dtype=np.int64) for c in ("user_id", "signed", "week_day", "cents")] for pdf in batches]
    return [np.concatenate(p) for p in zip(*parts)]


def _alerts_fn(factor: float, books: int):
    def update(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        users, signed, day, cents = batch_columns(batches)
        book = Book.unpack(bytes(state.get[0]) if state.exists else None).add(users, signed, day, cents, state.getCurrentWatermarkMs())
        state.update((book.pack(),))
        yield book.rows(users, factor, key[0] == books)
    return update


def stream_alerts(sdf: DataFrame, delay: str = "30 days", factor: float = WEEKLY_ALERT_FACTOR, books: int = USER_GROUPS) -> DataFrame:
    """Per user running balance (income - expense) and the weekly alert, in update mode."""
    cents = F.coalesce((F.col("amount") * 100).cast("bigint"), F.lit(0).cast("bigint"))
    sign = F.when(F.col("t_type") == INCOME, 1).when(F.col("t_type") == EXPENSE, -1).otherwise(0)
    rows = sdf.select(
        "user_id", F.unix_date(week_start("tx_date")).cast("bigint").alias("week_day"),
        (cents * sign).alias("signed"), cents.alias("cents"), F.unix_micros("event_ts").alias("event_us"))
    rows = booked(rows.mapInArrow(_sum_weeks, WEEK_SUMS), books) \
        .withColumn("event_ts", F.timestamp_micros("event_us")).drop("event_us").withWatermark("event_ts", delay)
    return rows.groupBy("book").applyInPandasWithState(
        _alerts_fn(factor, books), ALERT_OUTPUT, ALERT_STATE, "update", GroupStateTimeout.NoTimeout)


# ------------------------------------------------------------------ running
def run_available(sdf: DataFrame, checkpoint: str, writer, output_mode: str = "append",
                  timeout_s: int | None = None) -> None:
    """Process everything available now, then stop (replay / batch-style runs).

    Waits without a limit unless the caller gives one.
    """
    q = (sdf.writeStream.outputMode(output_mode).option("checkpointLocation", checkpoint)
         .foreachBatch(writer).trigger(availableNow=True).start())
    if timeout_s is None:
        q.awaitTermination()
    else:
        q.awaitTermination(timeout_s)
    if q.isActive:
        q.stop()
        raise TimeoutError("stream did not drain in time")
    if q.exception():
        raise q.exception()
