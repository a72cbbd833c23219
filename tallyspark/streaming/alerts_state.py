"""J6 as a stateful processor: balance and weekly alert per user in typed state with event-time timers.

State of a user (RocksDB): balance, sum and number of folded weeks, newest week and the open weeks with their sums.
Every access of state is a request to the JVM and every key a call of Python, so users are kept in
``jobs.USER_GROUPS`` books, one value and one timer each, as in ``jobs.stream_alerts`` (``BookedAlerts``): a batch costs a
book one read, one write and at most one timer.  Without books (``books=None``, ``WeeklyAlerts``) that is the cost of
a user; it pays where a micro-batch has rows of few of very many users, as only their values are written.

The timer stands at the end of the first open week that is not a user's newest.  When the watermark passes it, all weeks
that closed by then are folded into the totals and the next timer is set, also for users that send nothing any more,
so the state holds the weeks inside the lateness limit and the newest one, however long the stream runs.
The newest week stays open until a newer one comes, as its total is reported.

Rows are summed per (user, week) in their task before the shuffle, as in
``jobs.stream_alerts``, and the results are the same: the balance holds every row, late and
undated ones too; a row whose week closed before the current watermark no longer
changes the weekly figures; a null amount counts as nothing; a user with undated rows only
has state but no output.  Spark's state TTL runs on processing time only and would make a
replay depend on the clock, so event-time timers do that work here.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import json
import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tallyspark.functions.columns import week_start
from tallyspark.schema import EXPENSE, INCOME, WEEKLY_ALERT_FACTOR
from tallyspark.streaming.jobs import (ALERT_OUTPUT, DAY_MS, USER_GROUPS, WEEK_MS, WEEK_SUMS, Book, _sum_weeks, alert_row, batch_columns, booked,
                                       week_sums)

STATE = T.StructType([T.StructField(c, T.LongType()) for c in ("balance", "folded", "folded_weeks", "newest", "timer")]
                     + [T.StructField("weeks", T.StringType())])     # JSON {monday epoch day: cents} of open weeks
BOOK_STATE = T.StructType([T.StructField("timer", T.LongType()), T.StructField("book", T.BinaryType())])
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
NO_WEEK = -(1 << 62)

# Spark first runs the processor in a Python process beside the driver, which does not get the packages
# sent to the executors: the class travels by value
cloudpickle.register_pickle_by_value(sys.modules[__name__])


class WeeklyAlerts(StatefulProcessor):
    def __init__(self, factor: float):
        self.factor = factor

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("alerts", STATE)

    def _load(self):
        """(balance, folded, folded weeks, newest week, end of the timer, {open week: cents}), in one request."""
        found = self.state.get()
        if found is None:
            return [0, 0, 0, NO_WEEK, 0], {}
        return list(found[:5]), {int(k): v for k, v in json.loads(found[5]).items()}

    def _keep(self, totals: list, weeks: dict, watermark: int) -> None:
        """Store the state; a timer stands at the end of the first open week that can still be folded."""
        closing = [d for d in weeks if d != totals[3]]
        end = min(closing) * DAY_MS + WEEK_MS if closing else 0
        if end and end != totals[4]:
            if totals[4] > watermark:           # of an earlier first week, or one that is not first any more
                self.handle.deleteTimer(totals[4])
            self.handle.registerTimer(end)
            totals[4] = end
        self.state.update((*totals, json.dumps(weeks)))

    @staticmethod
    def _fold(totals: list, weeks: dict, until_ms: int) -> None:
        """Weeks that ended at ``until_ms`` or before leave the map, except the newest."""
        for day in [d for d in weeks if d != totals[3] and d * DAY_MS + WEEK_MS <= until_ms]:
            totals[1] += weeks.pop(day)
            totals[2] += 1

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        totals, weeks = self._load()
        watermark = timerValues.getCurrentWatermarkInMs()
        for pdf in rows:
            totals[0] += int(pdf["signed"].sum())
            for day, cents in week_sums(pdf, watermark):
                weeks[day] = weeks.get(day, 0) + cents
                totals[3] = max(totals[3], day)
        if watermark > 0:
            self._fold(totals, weeks, watermark)
        self._keep(totals, weeks, watermark)
        if totals[3] != NO_WEEK:
            last = weeks[totals[3]]
            yield alert_row(key[0], totals[0], totals[2] + len(weeks) - 1, totals[1] + sum(weeks.values()) - last, totals[3], last, self.factor)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        totals, weeks = self._load()
        watermark = timerValues.getCurrentWatermarkInMs()
        self._fold(totals, weeks, max(watermark, expiredTimerInfo.getExpiryTimeInMs()))
        self._keep(totals, weeks, watermark)
        yield from ()

    def close(self) -> None:
        pass


class BookedAlerts(StatefulProcessor):
    """``WeeklyAlerts`` for the users of a book together."""

    def __init__(self, factor: float, books: int):
        self.factor, self.books = factor, books

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("book", BOOK_STATE)

    def _load(self) -> tuple[int, Book]:
        found = self.state.get()
        return (0, Book.unpack(None)) if found is None else (found[0], Book.unpack(bytes(found[1])))

    def _keep(self, timer: int, book: Book, watermark: int) -> None:
        """Store the book; a timer stands at the end of the first open week that can still be folded."""
        end = book.first_end()
        if end and end != timer:
            if timer > watermark:           # of an earlier first week, or one that is not first any more
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(end)
            timer = end
        self.state.update((timer, book.pack()))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        timer, book = self._load()
        watermark = timerValues.getCurrentWatermarkInMs()
        users, signed, day, cents = batch_columns(rows)
        book = book.add(users, signed, day, cents, watermark)
        self._keep(timer, book, watermark)
        yield book.rows(users, self.factor, key[0] == self.books)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        timer, book = self._load()
        watermark = timerValues.getCurrentWatermarkInMs()
        self._keep(timer, book.folded(max(watermark, expiredTimerInfo.getExpiryTimeInMs())), watermark)
        yield from ()

    def close(self) -> None:
        pass


def stream_alerts_state(sdf: DataFrame, delay: str = "30 days", factor: float = WEEKLY_ALERT_FACTOR, books: int | None = USER_GROUPS) -> DataFrame:
    """Per user running balance (income - expense) and the weekly alert, in update mode."""
    cents = F.coalesce((F.col("amount") * 100).cast("bigint"), F.lit(0).cast("bigint"))
    sign = F.when(F.col("t_type") == INCOME, 1).when(F.col("t_type") == EXPENSE, -1).otherwise(0)
    rows = sdf.select("user_id", F.unix_date(week_start("tx_date")).cast("bigint").alias("week_day"),
                      (cents * sign).alias("signed"), cents.alias("cents"), F.unix_micros("event_ts").alias("event_us"))
    rows = rows.mapInArrow(_sum_weeks, WEEK_SUMS) \
        .withColumn("event_ts", F.timestamp_micros("event_us")).withWatermark("event_ts", delay)
    # the watermark is taken from the rows, but late rows must reach the balance: without the time column none is dropped
    rows = rows.select("user_id", "week_day", "signed", "cents")
    if books is None:
        keyed, processor = rows.groupBy("user_id"), WeeklyAlerts(factor)
    else:
        keyed, processor = booked(rows, books).groupBy("book"), BookedAlerts(factor, books)
    return keyed.transformWithStateInPandas(statefulProcessor=processor, outputStructType=ALERT_OUTPUT, outputMode="Update", timeMode="EventTime")


@contextmanager
def rocksdb(spark: SparkSession):
    """Queries started inside keep their state in RocksDB, which the processor's column families need."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)
