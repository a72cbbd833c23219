"""Streaming replay: multi-batch runs with repeats and late rows equal the batch answers."""

import datetime as dt
import uuid

from pyspark.sql import functions as F

from conftest import collect
from tallyspark.operators import ordered as E
from tallyspark.operators import rollups as C
from tallyspark.schema import LEDGER_SCHEMA
from tallyspark.session import checkpoint_dir
from tallyspark.streaming import jobs as J


def _dirs(spark):
    b = f"{checkpoint_dir(spark)}/t-{uuid.uuid4().hex[:8]}"
    return f"{b}/in", f"{b}/ck", f"{b}/out"


def _weeks(make_ledger):
    rows = []
    start = dt.date(2024, 1, 1)
    for d in range(56):
        day = start + dt.timedelta(days=d)
        rows.append((f"e{d}", 1 + d % 3, "expense", "A", 10 + d, day.isoformat()))
        if d % 7 == 0:
            rows.append((f"i{d}", 1 + d % 3, "income", "S", 100, day.isoformat()))
    return make_ledger(rows)


def _stage_in_order(L, src, parts=4):
    # one file per slice of time, written one after another so files arrive in time order
    days = sorted(r[0] for r in L.select("tx_date").distinct().collect())
    step = len(days) // parts + 1
    for i in range(0, len(days), step):
        lo, hi = days[i], days[min(i + step, len(days)) - 1]
        L.filter(F.col("tx_date").between(lo, hi)).coalesce(1).write.mode("append").parquet(src)


def test_weekly_stream_multi_batch_equals_batch(spark, make_ledger):
    L = _weeks(make_ledger)
    src, ck, out = _dirs(spark)
    _stage_in_order(L, src)
    sdf = J.stream_weekly(J.read_ledger_stream(spark, src, LEDGER_SCHEMA, max_files_per_trigger=1), delay="10 days")
    J.run_available(sdf, ck, J.write_batches(out), output_mode="update")
    got = sorted((r["user_id"], r["week"], r["total"]) for r in collect(J.read_latest(spark, out, ["user_id", "week"])))
    want = sorted((r["user_id"], r["week"], r["total"]) for r in collect(C.weekly_total(L)))
    assert got == want
    assert spark.read.parquet(out).select("batch").distinct().count() >= 2


def test_alert_state_multi_batch_equals_batch(spark, make_ledger):
    L = _weeks(make_ledger)
    src, ck, out = _dirs(spark)
    _stage_in_order(L, src)
    sdf = J.stream_alerts(J.read_ledger_stream(spark, src, LEDGER_SCHEMA, max_files_per_trigger=1), delay="8 days")
    J.run_available(sdf, ck, J.write_batches(out), output_mode="update")
    got = {r["user_id"]: r for r in collect(J.read_latest(spark, out, ["user_id"]))}
    want = {r["user_id"]: r for r in collect(E.weekly_alert(L))}
    bal = {r["user_id"]: float(r["savings"]) for r in collect(C.summary_stats(L))}
    assert set(got) == set(want)
    for u, w in want.items():
        g = got[u]
        assert g["n_weeks"] == w["n_weeks"] and g["last_week"] == w["last_week"]
        assert g["last_total"] == float(w["last_total"]) and g["mean_prev"] == w["mean_prev"]
        assert g["alert"] == w["alert"] and g["balance"] == bal[u]


def test_dedupe_drops_repeats_within_watermark(spark, make_ledger):
    L = _weeks(make_ledger)
    src, ck, out = _dirs(spark)
    # one file per write, written in order: the repeats arrive in the second batch
    L.coalesce(1).write.parquet(src)
    L.withColumn("tx_id", F.concat(F.lit("R"), "tx_id")).coalesce(1).write.mode("append").parquet(src)
    sdf = J.stream_dedupe(J.read_ledger_stream(spark, src, LEDGER_SCHEMA, max_files_per_trigger=1))
    J.run_available(sdf, ck, J.write_batches(out))
    assert spark.read.parquet(out).count() == L.count()


def test_validate_stream_splits_quarantine(spark):
    from tallyspark.schema import RAW_TX_SCHEMA
    rows = [("1", "5", "2024-01-05", "expense", "10", "Food", None),
            ("2", "5", "2024-13-05", "expense", "10", "Food", None),
            ("3", "5", "2024-01-05", "gift", "-3", "Food", None)]
    src, ck, out = _dirs(spark)
    spark.createDataFrame(rows, RAW_TX_SCHEMA).write.parquet(src)
    J.run_available(J.stream_validate(J.read_raw_stream(spark, src)), ck,
                    J.write_split(f"{out}/good", f"{out}/bad"))
    assert [r["tx_id"] for r in spark.read.parquet(f"{out}/good").collect()] == ["1"]
    bad = {r["tx_id"]: r["reasons"] for r in spark.read.parquet(f"{out}/bad").collect()}
    assert bad == {"2": "date", "3": "type,amount"}


def test_restart_resumes_from_checkpoint(spark, make_ledger):
    L = _weeks(make_ledger)
    src, ck, out = _dirs(spark)
    L.filter("tx_date < date'2024-02-01'").write.parquet(src)
    sdf = lambda: J.stream_weekly(J.read_ledger_stream(spark, src, LEDGER_SCHEMA), delay="10 days")
    J.run_available(sdf(), ck, J.write_batches(out), output_mode="update")
    L.filter("tx_date >= date'2024-02-01'").write.mode("append").parquet(src)
    J.run_available(sdf(), ck, J.write_batches(out), output_mode="update")
    got = sorted((r["user_id"], r["week"], r["total"]) for r in collect(J.read_latest(spark, out, ["user_id", "week"])))
    want = sorted((r["user_id"], r["week"], r["total"]) for r in collect(C.weekly_total(L)))
    assert got == want


def test_dedupe_writer_removes_hot_copies_and_stored_repeats(spark, make_ledger):
    L = _weeks(make_ledger)
    src, ck, out = _dirs(spark)
    hot = L.limit(1)
    L.write.parquet(src)
    for i in range(3):   # a copy group much larger than anything else, over several batches
        hot.select("*", F.explode(F.sequence(F.lit(1), F.lit(300))).alias("_c")).drop("_c") \
            .withColumn("tx_id", F.concat(F.lit(f"H{i}-"), F.monotonically_increasing_id().cast("string"))) \
            .write.mode("append").parquet(src)
    sdf = J.read_ledger_stream(spark, src, LEDGER_SCHEMA, max_files_per_trigger=2)
    J.run_available(sdf, ck, J.dedupe_writer(out))
    got = spark.read.parquet(out)
    assert got.count() == L.dropDuplicates(J.DUP_COLS).count()
    assert got.select(*J.DUP_COLS).distinct().count() == got.count()


def test_late_rows_beyond_the_watermark_are_dropped(spark, make_ledger):
    # Spark drops a row as late once the watermark of the *previous* batch has passed its window,
    # so the late row arrives two batches after the data that moved the watermark.
    early = make_ledger([(f"a{d}", 1, "expense", "A", 10, f"2024-01-{d:02d}") for d in range(1, 29)])
    more = make_ledger([("ok", 1, "expense", "A", 5, "2024-01-27"),          # within the limit
                        ("new", 1, "expense", "A", 7, "2024-02-05")])
    late = make_ledger([("late", 1, "expense", "A", 999, "2024-01-02")])     # its week closed long ago
    kept = early.unionByName(more)

    def stage():
        src, ck, out = _dirs(spark)
        for part in (early, more, late):
            part.coalesce(1).write.mode("append").parquet(src)
        return J.read_ledger_stream(spark, src, LEDGER_SCHEMA, max_files_per_trigger=1), ck, out

    sdf, ck, out = stage()
    J.run_available(J.stream_weekly(sdf, delay="8 days"), ck, J.write_batches(out), output_mode="update")
    got = sorted((r["week"], r["total"]) for r in collect(J.read_latest(spark, out, ["user_id", "week"])))
    want = sorted((r["week"], r["total"]) for r in collect(C.weekly_total(kept)))
    assert got == want
    sdf, ck, out = stage()
    J.run_available(J.stream_alerts(sdf, delay="8 days"), ck, J.write_batches(out), output_mode="update")
    a = collect(J.read_latest(spark, out, ["user_id"]))[0]
    w = collect(E.weekly_alert(kept))[0]
    assert a["n_weeks"] == w["n_weeks"] and a["mean_prev"] == w["mean_prev"]
    assert a["last_total"] == float(w["last_total"])
    whole = kept.unionByName(late)      # the balance holds late rows too
    assert a["balance"] == -float(collect(whole.agg(F.sum("amount").alias("s")))[0]["s"])


def test_alert_balance_holds_undated_rows_and_tolerates_null_amounts(spark, make_ledger):
    src, ck, out = _dirs(spark)
    parts = [make_ledger([("a", 1, "income", "S", 100, "2024-01-03"), ("b", 1, "expense", "A", None, "2024-01-04")]),
             make_ledger([("c", 1, "expense", "A", 30, "2024-03-20"), ("d", 1, "income", "S", 7, None)]),
             make_ledger([("e", 1, "income", "S", 5, None), ("f", 1, "income", "S", 50, "2024-01-05")])]
    for p in parts:
        p.coalesce(1).write.mode("append").parquet(src)
    sdf = J.stream_alerts(J.read_ledger_stream(spark, src, LEDGER_SCHEMA, max_files_per_trigger=1), delay="8 days")
    J.run_available(sdf, ck, J.write_batches(out), output_mode="update")
    a = collect(J.read_latest(spark, out, ["user_id"]))[0]
    assert a["balance"] == 100 - 30 + 7 + 5 + 50
    assert a["n_weeks"] == 2 and a["last_total"] == 30.0


def test_weekly_stream_labels_do_not_depend_on_session_time_zone(spark, make_ledger):
    L = _weeks(make_ledger)
    src, ck, out = _dirs(spark)
    L.coalesce(1).write.parquet(src)
    spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
    try:
        sdf = J.stream_weekly(J.read_ledger_stream(spark, src, LEDGER_SCHEMA))
        J.run_available(sdf, ck, J.write_batches(out), output_mode="update")
        got = sorted((r["user_id"], r["week"], r["total"])
                     for r in collect(J.read_latest(spark, out, ["user_id", "week"])))
        want = sorted((r["user_id"], r["week"], r["total"]) for r in collect(C.weekly_total(L)))
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got == want and all(w.weekday() == 0 for _, w, _ in got)


def test_alert_state_does_not_depend_on_session_time_zone(spark, make_ledger):
    L = _weeks(make_ledger)
    src, ck, out = _dirs(spark)
    _stage_in_order(L, src)
    spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
    try:
        sdf = J.stream_alerts(J.read_ledger_stream(spark, src, LEDGER_SCHEMA, max_files_per_trigger=1), delay="8 days")
        J.run_available(sdf, ck, J.write_batches(out), output_mode="update")
        got = {r["user_id"]: r for r in collect(J.read_latest(spark, out, ["user_id"]))}
        want = {r["user_id"]: r for r in collect(E.weekly_alert(L))}
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert set(got) == set(want)
    for u, w in want.items():
        assert got[u]["last_week"] == w["last_week"] and got[u]["n_weeks"] == w["n_weeks"]
        assert got[u]["mean_prev"] == w["mean_prev"] and got[u]["alert"] == w["alert"]
