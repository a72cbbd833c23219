"""Versioned ledger, duplicate index, stateful alerts, monthly rollup, mixed headers, model store."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspark.operators import rollups as C
from tallyspark.operators.filters import validate
from tallyspark.operators.relate import DUP_COLS
from tallyspark.operators.envelope import MASTER_KEY_FILE, KeyRing
from tallyspark.schema import LEDGER_SCHEMA, RAW_TX_SCHEMA
from tallyspark.session import ship_package
from tallyspark.sources.evolving import EvolvingTable
from tallyspark.sources.headers import read_ledger_folder
from tallyspark.sources.versioned import VersionedLedger
from tallyspark.sources.versions import VersionConflict, VersionFiles
from tallyspark.streaming import jobs as J
from tallyspark.streaming.alerts_state import rocksdb, stream_alerts_state
from tallyspark.streaming.dedupe_index import DedupeIndex, make_filter, may_hold
from tallyspark.streaming.monthly import MonthlyTotals


def rows_of(df):
    return sorted(map(str, (tuple(r) for r in df.collect())))


def random_rows(n, seed, users=9, days=400):
    rnd = random.Random(seed)
    start = dt.date(2024, 1, 1)
    return [(f"t{seed}-{i}", rnd.randrange(users), rnd.choice(["income", "expense"]), rnd.choice(["a", "b", None]),
             rnd.choice([1, 2.5, 99.99, None]), str(start + dt.timedelta(days=rnd.randrange(days))) if rnd.random() > 0.05 else None,
             rnd.choice(["x", None])) for i in range(n)]


# ---- versions
def test_one_writer_wins_a_version(spark, tmp_path):
    files = VersionFiles(spark, str(tmp_path))
    assert files.current() == 0 and files.pointer(0) == {}
    files.publish(1, {"who": "first"})
    with pytest.raises(VersionConflict):
        files.publish(1, {"who": "second"})
    assert files.pointer(1) == {"who": "first"} and files.numbers() == [1]
    assert [p for p in (tmp_path / "versions").iterdir() if p.name.endswith(".tmp")] == []


def test_ledger_versions(spark, make_ledger, tmp_path):
    t = VersionedLedger(spark, str(tmp_path / "v"))
    assert t.version() == 0 and t.read().count() == 0
    one = make_ledger([("1", 1, "income", "a", 5, "2024-01-02"), ("2", 2, "expense", "a", 6, "2024-01-03"),
                       ("3", 2, "expense", None, 7, "2024-02-03"), ("4", 3, "expense", "b", 8, None)])
    two = make_ledger([("5", 1, "income", "a", 5, "2024-03-02"), ("5", 1, "income", "a", 5, "2024-03-02")])
    assert t.append(one, "b1") == 1 and t.append(two, "b2") == 2
    assert t.append(two, "b2") == 2 and t.append(one, "b1") == 2            # repeated batches change nothing
    assert rows_of(t.read()) == rows_of(one.unionByName(two))
    before = t.read()
    assert t.erase(spark.createDataFrame([(2,), (None,), (77,)], "user_id long")) == 3
    assert rows_of(before) == rows_of(one.unionByName(two))                 # a reader of the old version is not disturbed
    left = one.unionByName(two).filter("user_id != 2")
    assert rows_of(t.read()) == rows_of(left) and rows_of(t.read(2)) == rows_of(one.unionByName(two))
    months = {r[0] for r in t.manifest().select("tx_month").collect()}
    assert "2024-02" not in months and "2024-03" in months                  # the emptied month is gone
    # files without the user's rows were not rewritten
    kept = {r[0] for r in t.manifest(2).select("path").collect()} & {r[0] for r in t.manifest(3).select("path").collect()}
    assert len(kept) >= 2
    assert t.erase(spark.createDataFrame([(2,)], "user_id long")) == 3      # nothing left to erase
    assert t.erase(spark.createDataFrame([], "user_id long")) == 3
    assert t.append(one.limit(0), "empty") == 4 and rows_of(t.read()) == rows_of(left)
    assert t.vacuum() >= 2 and rows_of(t.read()) == rows_of(left)
    on_disk = spark.read.parquet(str(tmp_path / "v" / "data"))
    assert on_disk.filter("user_id = 2").count() == 0                       # erased rows are gone from the disk
    assert [tuple(r) for r in t.history().orderBy("version").select("operation", "batch").collect()] == [
        ("append", "b1"), ("append", "b2"), ("erase", None), ("append", "empty")]


def test_two_writers_both_commit(spark, make_ledger, tmp_path):
    t = VersionedLedger(spark, str(tmp_path / "v"))
    a, b = (make_ledger([(x, 1, "income", "a", 5, "2024-01-02")]) for x in "ab")
    other, publish = VersionedLedger(spark, str(tmp_path / "v")), t.files.publish

    def late(number, value):        # another writer commits between this one's look and its rename
        t.files.publish = publish
        other.append(b, "b")
        publish(number, value)

    t.files.publish = late
    assert t.append(a, "a") == 2 and rows_of(t.read()) == rows_of(a.unionByName(b))


def test_pruned_reading(spark, make_ledger, tmp_path):
    t = VersionedLedger(spark, str(tmp_path / "v"))
    t.append(make_ledger([("1", 1, "income", "a", 5, "2024-01-02"), ("2", 2, "expense", "a", 6, "2024-02-03")]), "b")
    plan = t.read(with_month=True).filter("tx_month = '2024-02'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(tx_month" in plan


# ---- J1: nothing is lost
def test_null_fields_are_quarantined(spark, tmp_path):
    good = ("1", "7", "2024-01-02", "income", "5", "a", "n")
    raw = spark.createDataFrame([good] + [tuple(None if j == i else v for j, v in enumerate(good)) for i in range(7)]
                                + [(None,) * 7], RAW_TX_SCHEMA)
    v = validate(raw)
    assert v.filter("valid is null").count() == 0
    J.write_split(f"{tmp_path}/good", f"{tmp_path}/bad")(J.stream_validate(raw), 0)
    n_good, n_bad = (spark.read.parquet(f"{tmp_path}/{x}").count() for x in ("good", "bad"))
    assert n_good + n_bad == 9 and n_bad == 5       # null date, type, amount, category, and all null


# ---- J2: duplicate index
def test_bloom_filter():
    keys = np.random.default_rng(1).integers(-(1 << 63), (1 << 63) - 1, 30_000)      # keys are hashes
    raw = make_filter(keys[:10_000])
    assert may_hold(raw, keys[:10_000]).all() and not may_hold(raw, keys[10_000:]).any()
    assert not may_hold(make_filter(keys[:0]), keys).any()


def test_duplicate_index_equals_batch_answer(spark, make_ledger, tmp_path):
    rnd = random.Random(3)
    base = [r for r in random_rows(300, 1, days=90) if None not in (r[3], r[4], r[5])]
    batches = [base[i::4] + rnd.sample(base, 20) for i in range(4)]
    sink = DedupeIndex(str(tmp_path / "d"), buckets=4)
    for n, b in enumerate(batches):
        sink.write(make_ledger(b), n)
    want = make_ledger(base).select(*DUP_COLS).distinct()
    assert rows_of(sink.read(spark, LEDGER_SCHEMA).select(*DUP_COLS)) == rows_of(want)
    sink.write(make_ledger(batches[3]), 3)          # replayed after a failure
    assert rows_of(sink.read(spark, LEDGER_SCHEMA).select(*DUP_COLS)) == rows_of(want)
    sink.write(make_ledger([]), 4)
    assert sink.read(spark, LEDGER_SCHEMA).count() == want.count()


def test_duplicate_index_opens_only_files_with_its_keys(spark, make_ledger, tmp_path):
    sink = DedupeIndex(str(tmp_path / "d"), buckets=2)
    for n in range(6):      # the same month every time, all rows new
        sink.write(make_ledger([(f"{n}-{i}", n, "income", "a", i + 1, "2024-01-02", f"{n}") for i in range(40)]), n)
    log = {r["batch"]: r for r in sink.log(spark).collect()}
    assert [log[n]["opened"] for n in range(6)] == [0] * 6 and log[5]["looked"] >= 10
    sink.write(make_ledger([("again", 2, "income", "a", 5, "2024-01-02", "2")]), 6)
    assert {r["batch"]: r["opened"] for r in sink.log(spark).collect()}[6] == 1
    assert sink.read(spark, LEDGER_SCHEMA).count() == 240


# ---- J6: stateful processor
def test_alert_processor_equals_state_function(spark, make_ledger, tmp_path):
    ship_package(spark)
    rnd = random.Random(5)
    rows = sorted(random_rows(240, 2, users=4, days=500), key=lambda r: r[5] or "")
    parts = [rows[i:i + 60] for i in range(0, 240, 60)]
    parts[3] += [(f"late{i}", i % 4, "expense", "a", 3, "2024-01-05") for i in range(6)]
    rnd.shuffle(parts[2])
    src = str(tmp_path / "in")
    out = {}
    for name, make in (("old", J.stream_alerts), ("new", stream_alerts_state)):
        where = f"{src}-{name}"
        for n, p in enumerate(parts):
            make_ledger(p).coalesce(1).write.mode("append").parquet(where)
            if n in (1, 3):         # the stream is stopped and started again in the middle
                with rocksdb(spark):
                    sdf = J.read_ledger_stream(spark, where, LEDGER_SCHEMA, max_files_per_trigger=1)
                    J.run_available(make(sdf), f"{tmp_path}/ck-{name}", J.write_batches(f"{tmp_path}/out-{name}"), output_mode="update")
        out[name] = rows_of(J.read_latest(spark, f"{tmp_path}/out-{name}", ["user_id"])
                            .select("user_id", "balance", "n_weeks", "last_week", "last_total", "mean_prev", "alert"))
    assert out["old"] == out["new"] and len(out["new"]) == 4


# ---- J5: monthly rollup
@pytest.mark.parametrize("seed", [0, 1])
def test_monthly_rollup_equals_batch_in_any_order(spark, make_ledger, tmp_path, seed):
    rows = random_rows(200, 7, days=200)
    parts = [rows[i::4] for i in range(4)]
    random.Random(seed).shuffle(parts)
    t = MonthlyTotals(str(tmp_path / "m"), buckets=2)
    assert t.read(spark).count() == 0
    for n, p in enumerate(parts):
        t.write(make_ledger(p), n)
        t.write(make_ledger(p), n)          # replayed
    t.write(make_ledger([]), 4)
    want = C.monthly_total(make_ledger(rows)).select("user_id", "month", F.col("total").cast("double"))
    assert rows_of(t.read(spark).select("user_id", "month", F.col("total").cast("double"))) == rows_of(want)


# ---- A1: mixed headers
def test_folder_with_differing_headers(spark, tmp_path):
    folder = tmp_path / "csv"
    folder.mkdir()
    (folder / "a.csv").write_bytes(b"date,type,amount,category,note\r\n2024-01-05,income,10.50,Pay,\r\n2024-01-06,expense,3,Food,\"a, b\"\r\n")
    (folder / "b.csv").write_text("type,category,amount,date,note\nexpense,food,1.25,2025-04-26,x\n")
    (folder / "c.csv").write_text("id,user_id,type,category,amount,date,note\n7,3,income,Rent,9,2024-02-01,\n8,3,income,Rent,9\n")
    (folder / "d.csv").write_text("﻿Note,ID,Date,Amount,User_ID,Category,Type\nn,9,2024-03-01,4,5.0,c,expense\n")
    (folder / "dup.csv").write_text("date,date,amount\n2024-01-01,2024-01-01,4\n")
    (folder / "none.csv").write_text("colour,size\nred,4\n")
    (folder / "empty.csv").write_text("")
    (folder / "head.csv").write_text("date,type,amount\n")
    got, bad = read_ledger_folder(spark, str(folder), user_id=1)
    rows = {(r["user_id"], r["t_type"], r["category"], str(r["amount"]), str(r["tx_date"]), r["note"]) for r in got.collect()}
    assert rows == {(1, "income", "Pay", "10.50", "2024-01-05", None), (1, "expense", "Food", "3.00", "2024-01-06", "a, b"),
                    (1, "expense", "food", "1.25", "2025-04-26", "x"), (3, "income", "Rent", "9.00", "2024-02-01", None),
                    (5, "expense", "c", "4.00", "2024-03-01", "n")}
    assert got.select("user_id").count() == 5 and got.count() == 5      # few columns asked for: the same rows
    reasons = sorted((r["path"].rsplit("/", 1)[1], r["reason"]) for r in bad.collect())
    assert reasons == [("c.csv", "fields do not fit the header"), ("dup.csv", "repeated column in header"),
                       ("none.csv", "no ledger column in header")]


# ---- A9: model store
def test_models_survive_the_store(spark, make_ledger, tmp_path):
    from tallyspark.ml import anomaly, budget, category, expense
    from tallyspark.ml.store import ModelNotFound, ModelStore
    ship_package(spark)
    notes = {"food": ["bread and milk", "milk and eggs", "fresh bread"], "rent": ["flat rent", "house rent due", "rent for flat"]}
    led = make_ledger([(f"{c}{i}{m}", 1, "expense", c, 10 + 7 * i + m, f"2024-{m:02d}-05", t)
                       for c, ts in notes.items() for i, t in enumerate(ts) for m in range(1, 7)])
    models = {"category": category.fit_category(led, max_iter=50), "expense": expense.fit_expense(led, n_trees=5),
              "budget": budget.fit_budget(led, ["food", "rent"], n_starts=1), "anomaly": anomaly.fit_anomaly(led, n_trees=10)}
    apply = {"category": lambda m, x: category.predict_category(m, x).select("tx_id", "predicted", F.col("probability").cast("string")),
             "expense": lambda m, x: expense.predict_expense(m, expense.expense_rows(x)),
             "budget": lambda m, x: budget.assign_clusters(m, C.category_matrix(x, ["food", "rent"], by=[])).select("month", "cluster", "advice"),
             "anomaly": lambda m, x: anomaly.score_anomalies(m, x).select("tx_id", "score", "anomaly")}
    store = ModelStore(spark, str(tmp_path / "models"))
    later = ModelStore(spark.newSession(), str(tmp_path / "models"))
    for name, m in models.items():
        assert store.save(name, m, training_key="k1") == 1
        assert rows_of(apply[name](later.load(name, training_key="k1"), led)) == rows_of(apply[name](m, led))
    assert store.save("expense", models["expense"], training_key="k2") == 2
    assert store.versions("expense").count() == 2
    for kw in ({"training_key": "k3"}, {"version": 9}):
        with pytest.raises(ModelNotFound):
            store.load("expense", **kw)
    with pytest.raises(ModelNotFound):
        store.load("nothing")


# ---- I7, I8: wrapped keys
def test_envelope_encryption(spark, make_ledger, tmp_path):
    one, two = bytes(range(32)), bytes(range(1, 33))
    led = make_ledger([(str(i), i % 3, "expense", "a", 5 + i, "2024-01-02", None if i == 3 else f"note {i}") for i in range(6)])
    ring = KeyRing(spark, str(tmp_path / "keys"), {"m1": one})
    plain = rows_of(led.select("tx_id", "note", F.col("amount").cast("string")))
    ring.encrypt(led.filter("tx_id < '3'")).write.parquet(str(tmp_path / "rows"))
    assert ring.rotate() == 2
    ring.encrypt(led.filter("tx_id >= '3'")).write.mode("append").parquet(str(tmp_path / "rows"))
    rows = spark.read.parquet(str(tmp_path / "rows"))
    assert {r["key_id"] for r in rows.collect()} == {1, 2} and "note 1" not in str(rows.collect())
    assert rows_of(ring.decrypt(rows).select("tx_id", "note", "amount")) == plain
    # the data keys move under another master key: the rows stay as they are and still open, also without the old one
    both = KeyRing(spark, str(tmp_path / "keys"), {"m1": one, "m2": two})
    assert both.rewrap() == 2 and both.rewrap() == 0
    new = KeyRing(spark, str(tmp_path / "keys"), {"m2": two})
    assert rows_of(new.decrypt(rows).select("tx_id", "note", "amount")) == plain
    with pytest.raises(Exception):      # a wrong master key opens nothing
        KeyRing(spark, str(tmp_path / "keys"), {"m2": one}).table()
    # no key in any plan
    secrets = [bytes(r["data_key"]) for r in new.table().collect()]
    opened = new.decrypt(rows)
    plan = opened._jdf.queryExecution().toString()
    for k in [*secrets, two]:
        assert k.hex() not in plan.lower() and __import__("base64").b64encode(k).decode() not in plan and str(list(k))[1:30] not in plan
    # coverage: plain text, foreign key ids and nulls
    mixed = rows.unionByName(led.limit(2).withColumn("key_id", F.lit(1)).withColumn("amount", F.col("amount").cast("string"))
                             .withColumn("key_id", F.lit(9)).select(rows.columns))
    got = new.coverage(mixed, by=[]).first()
    assert (got["encrypted_share"], got["n"]) == (5 / 7, 7)
    assert new.decrypt(mixed).filter("key_id = 9 and note is not null").count() == 0


def test_master_keys_come_from_configuration(spark, tmp_path):
    import base64
    import json
    with pytest.raises(RuntimeError):
        KeyRing(spark, str(tmp_path / "k"))
    (tmp_path / "m.json").write_text(json.dumps({"m": base64.b64encode(bytes(32)).decode()}))
    spark.conf.set(MASTER_KEY_FILE, str(tmp_path / "m.json"))
    try:
        assert KeyRing(spark, str(tmp_path / "k")).current() == 1
    finally:
        spark.conf.unset(MASTER_KEY_FILE)


# ---- A10: columns change, files stay
def test_schema_evolution_at_rest(spark, tmp_path):
    t = EvolvingTable(spark, str(tmp_path / "t"))
    t.create({"id": "long", "name": "string"})
    assert t.read().count() == 0 and t.read().columns == ["id", "name"]
    t.append(spark.createDataFrame([(1, "a"), (2, None)], "id long, name string"))
    t.add_column("role", "string", default="user")
    t.append(spark.createDataFrame([("admin", 3, "x"), (None, 4, "y")], "role string, id int, other string"))
    assert rows_of(t.read()) == rows_of(spark.createDataFrame(
        [(1, "a", "user"), (2, None, "user"), (3, None, "admin"), (4, None, None)], "id long, name string, role string"))
    files = sorted(p for p in (tmp_path / "t" / "data").rglob("*.parquet"))
    t.drop_column("name")
    t.add_column("name", "int", default="7")        # a new column of the old name: the old values do not come back
    t.append(spark.createDataFrame([(5, "r", 9)], "id long, role string, name int"))
    assert rows_of(t.read()) == rows_of(spark.createDataFrame(
        [(1, "user", 7), (2, "user", 7), (3, "admin", 7), (4, None, 7), (5, "r", 9)], "id long, role string, name int"))
    assert set(files) <= set((tmp_path / "t" / "data").rglob("*.parquet"))      # nothing was rewritten
    assert t.read(1).columns == ["id", "name"] and t.read(1).count() == 5
    for bad in (lambda: t.add_column("ROLE", "string"), lambda: t.drop_column("none")):
        with pytest.raises(ValueError):
            bad()


# ---- C11, C12, H10: any number of categories
def test_sparse_clusters_equal_dense_ones(spark, make_ledger):
    from tallyspark.ml import budget, budget_sparse
    rnd = random.Random(4)
    cats = [f"c{i}" for i in range(7)]
    level = [{"c0": 900, "c1": 20}, {"c2": 300, "c3": 310, "c4": 290}, {"c5": 15, "c1": 25}]         # three kinds of months
    rows = [(f"{m}-{c}", 1, "expense", c, level[m % 3].get(c, 0) + rnd.randrange(5) if c != "c6" else 3,
             f"20{20 + m // 12}-{m % 12 + 1:02d}-05") for m in range(30) for c in cats if c == "c6" or c in level[m % 3] or rnd.random() < 0.3]
    led = make_ledger(rows + [("n", 1, "expense", None, 9, "2020-01-05"), ("i", 1, "income", "c1", 9, "2020-01-05")])
    dense, sparse = budget.fit_budget(led, cats), budget_sparse.fit_budget_sparse(led)
    ours = np.array(sorted((np.array(sparse.kmeans.clusterCenters()).sum(axis=1)).tolist()))
    means = np.array(dense.means) / np.array(dense.stds)        # the dense centres are centred, the sparse ones are not
    theirs = np.array(sorted(((np.array(dense.kmeans.clusterCenters()) + means).sum(axis=1)).tolist()))
    assert np.allclose(ours, theirs, rtol=1e-6) and sorted(sparse.meanings) == sorted(dense.meanings)
    a = {r["month"]: r["cluster"] for r in budget.assign_clusters(dense, C.category_matrix(led, cats, by=[])).collect()}
    b = {r["month"]: r["cluster"] for r in budget_sparse.assign_sparse(sparse, budget_sparse.category_totals(led, by=[])).collect()}
    pairs = {(a[m], b[m]) for m in a}
    assert a.keys() == b.keys() and len(pairs) == len(set(a.values())) == len(set(b.values()))      # same groups, other numbers
    unknown = make_ledger([("x", 2, "expense", "never seen", 5, "2024-01-05")])
    assert budget_sparse.assign_sparse(sparse, budget_sparse.category_totals(unknown, by=[])).count() == 1
    assert budget_sparse.fit_budget_sparse(led.limit(0)) is None


def test_hundred_thousand_categories(spark):
    from tallyspark.ml import budget_sparse
    led = spark.range(300_000).select(F.col("id").cast("string").alias("tx_id"), F.lit(1).cast("long").alias("user_id"),
                                      F.lit("expense").alias("t_type"), F.concat(F.lit("note "), F.col("id") % 100_000).alias("category"),
                                      (F.col("id") % 97 + 1).cast("decimal(18,2)").alias("amount"),
                                      F.expr("date_add(date'2020-01-01', cast(id % 700 as int))").alias("tx_date"), F.lit(None).cast("string").alias("note"))
    m = budget_sparse.fit_budget_sparse(led, n_starts=1)
    assert m.size == 100_000
    got = budget_sparse.assign_sparse(m, budget_sparse.category_totals(led, by=[]))
    assert got.count() == 23 and got.filter("cluster is null or advice is null").count() == 0
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 20_000       # no category list in the plan


def test_alert_processor_makes_few_state_requests():
    """One read, one write and one timer for a user's batch, however many weeks it holds."""
    import pandas as pd
    from tallyspark.streaming.alerts_state import WeeklyAlerts

    class Handle:
        def __init__(self):
            self.value, self.calls = None, []

        def getValueState(self, *_):
            return self

        def get(self):
            self.calls.append("get")
            return self.value

        def update(self, v):
            self.calls.append("update")
            self.value = v

        def registerTimer(self, at):
            self.calls.append(("timer", at))

        def deleteTimer(self, at):
            self.calls.append(("delete", at))

    class At:
        def __init__(self, ms):
            self.ms = ms

        def getCurrentWatermarkInMs(self):
            return self.ms

        def getExpiryTimeInMs(self):
            return self.ms

    week = 7 * 86_400_000
    h, p = Handle(), WeeklyAlerts(1.3)
    p.init(h)
    pdf = pd.DataFrame({"week_day": [4.0 + 7 * i for i in range(200)] + [None], "signed": [-100] * 201, "cents": [100] * 201})
    out = list(p.handleInputRows((1,), iter([pdf]), At(0)))[0].iloc[0]
    assert out["n_weeks"] == 200 and out["balance"] == -201.0 and out["mean_prev"] == 1.0 and not out["alert"]
    end = 4 * 86_400_000 + week
    assert h.calls == ["get", ("timer", end), "update"]
    list(p.handleExpiredTimer((1,), At(end + 150 * week), At(end)))     # all weeks closed by the watermark, next timer set
    assert h.value[2] == 151 and h.calls[3:] == ["get", ("timer", end + 151 * week), "update"]
    late = pd.DataFrame({"week_day": [4.0], "signed": [-50], "cents": [50]})
    out = list(p.handleInputRows((1,), iter([late]), At(end + 150 * week)))[0].iloc[0]
    assert out["balance"] == -201.5 and out["n_weeks"] == 200 and out["mean_prev"] == 1.0


def test_staged_streams_are_not_written_by_one_task(spark, monkeypatch):
    """The replayed files follow the ledger's scan, in three micro-batches or so."""
    from conftest import SF_SMALL
    from tallyspark.plans import stored_queries as S
    asked = []
    monkeypatch.setattr(S.J, "run_available", lambda sdf, *a, **k: asked.append(sdf))
    seen = []
    real = S.J.read_ledger_stream
    monkeypatch.setattr(S.J, "read_ledger_stream", lambda sp, path, schema, max_files_per_trigger=None: (
        seen.append((len(sp.read.parquet(path).inputFiles()), max_files_per_trigger)), real(sp, path, schema, max_files_per_trigger))[1])
    for q in (S.q_stream_monthly, S.q_stream_dedupe_index):
        try:
            q(spark, SF_SMALL)
        except Exception:       # nothing was drained: the sink is empty
            pass
    parts = S.ledger(spark, SF_SMALL).rdd.getNumPartitions()
    assert len(asked) == 2 and seen[0] == (3 * parts, parts) and seen[1][0] >= parts


def test_coverage_counts_like_a_filter_on_the_field(spark, tmp_path):
    from tallyspark.operators.envelope import KeyRing
    ring = KeyRing(spark, str(tmp_path / "ring"), {"m": b"k" * 32})
    rows = spark.createDataFrame([(1, "a"), (1, None), (2, None), (3, "b"), (3, "c")], "user_id long, note string")
    got = ring.coverage(ring.encrypt(rows, ["note"]))
    assert sorted(map(tuple, got.collect())) == [(1, 1.0, 1), (3, 1.0, 2)]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter isnotnull(base64" not in plan and not any("Filter" in x and "encode" in x for x in plan.split("\n"))


def test_erase_rewrites_files_without_a_shuffle(spark, make_ledger, tmp_path, monkeypatch):
    """what is left of a month's files is written where it is read, in its order."""
    t = VersionedLedger(spark, str(tmp_path / "v"))
    rows = make_ledger([(str(i), i % 7, "expense", "a", i, f"2024-{1 + i % 3:02d}-02" if i % 10 else None) for i in range(200)])
    t.append(rows, "b")
    monkeypatch.setattr(VersionedLedger, "_write", lambda self, left: pytest.fail("rows of an erasure were shuffled"))
    before = spark.conf.get("spark.sql.maxConcurrentOutputFileWriters")
    assert t.erase(spark.createDataFrame([(2,), (5,), (5,)], "user_id long")) == 2
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == before
    assert rows_of(t.read()) == rows_of(rows.filter("user_id not in (2, 5)"))
    m = t.manifest()
    assert {r[0] for r in m.select("tx_month").collect()} == {"2024-01", "2024-02", "2024-03", None}
    assert m.filter("low_user > 6 or high_user < 0").count() == 0
    monkeypatch.undo()
    monkeypatch.setattr("tallyspark.sources.versioned.MAX_BROADCAST", 0)        # more users than go to every task
    assert t.erase(spark.createDataFrame([(3,)], "user_id long")) == 3
    assert rows_of(t.read()) == rows_of(rows.filter("user_id not in (2, 3, 5)"))


def test_books_of_users_equal_single_users_with_few_requests():
    """many users cost one read, one write and one timer, and their rows are those of users kept alone."""
    import pandas as pd
    from tallyspark.streaming.alerts_state import BookedAlerts, WeeklyAlerts

    class Handle:
        def __init__(self):
            self.value, self.calls = None, []

        def getValueState(self, *_):
            return self

        def get(self):
            self.calls.append("get")
            return self.value

        def update(self, v):
            self.calls.append("update")
            self.value = v

        def registerTimer(self, at):
            self.calls.append(("timer", at))

        def deleteTimer(self, at):
            self.calls.append(("delete", at))

    class At:
        def __init__(self, ms):
            self.ms = ms

        def getCurrentWatermarkInMs(self):
            return self.ms

        def getExpiryTimeInMs(self):
            return self.ms

    rnd, week = random.Random(3), 7 * 86_400_000
    alone, book, handle = {}, BookedAlerts(1.3, 8), Handle()
    book.init(handle)
    for batch in range(5):
        at = At(max(0, batch - 1) * 20 * week)
        rows = [(rnd.randrange(300), rnd.randrange(-500, 500), rnd.choice([4 + 7 * rnd.randrange(100), J.NO_WEEK]), rnd.randrange(500)) for _ in range(900)]
        pdf = pd.DataFrame(rows, columns=["user_id", "signed", "week_day", "cents"])
        before = len(handle.calls)
        got = pd.concat(book.handleInputRows((2,), iter([pdf[:400], pdf[400:]]), at))
        calls = [c if isinstance(c, str) else c[0] for c in handle.calls[before:]]
        assert calls[0] == "get" and calls[-1] == "update" and len(calls) <= 4
        want = []
        for u, part in pdf.groupby("user_id"):
            if u not in alone:
                alone[u] = WeeklyAlerts(1.3)
                alone[u].init(Handle())
            part = part.assign(week_day=part["week_day"].where(part["week_day"] != J.NO_WEEK))
            want += alone[u].handleInputRows((u,), iter([part]), at)
        if batch == 3:
            list(book.handleExpiredTimer((2,), at, At(at.ms + 5 * week)))
        plain = lambda df: sorted(tuple(None if x is None or x != x else x for x in r) for r in df.itertuples(index=False))
        assert plain(got) == plain(pd.concat(want))
    nobody = list(book.handleInputRows((8,), iter([pdf]), At(0)))[0]
    assert nobody["user_id"].isna().all()


def test_ledger_streams_read_the_stored_files(spark, monkeypatch):
    """the stored ledger is streamed as it is, not copied first."""
    import numpy as np
    from conftest import SF_SMALL
    from tallyspark.ml.anomaly import IsolationForestModel
    from tallyspark.plans import stored_queries as S
    from tallyspark.plans import stream_queries as Q
    from tallyspark.sources.testdata import finished_build, ledger, stored_ledger_path
    L, read = ledger(spark, SF_SMALL), []
    real = J.read_ledger_stream
    monkeypatch.setattr(J, "read_ledger_stream", lambda sp, path, *a, **k: (read.append(path), real(sp, path, *a, **k))[1])
    monkeypatch.setattr(J, "run_available", lambda *a, **k: None)
    monkeypatch.setattr("tallyspark.plans.model_queries._fitted", lambda *a: IsolationForestModel(np.array([1.0]), np.array([1.0, 2.0]), 1, 2, 0.0))
    for q in (Q.q_stream_alerts, Q.q_stream_weekly, S.q_stream_alerts_state, Q.q_stream_flag):
        try:
            q(spark, SF_SMALL)
        except Exception:       # nothing was drained: there is no sink
            pass
    assert read == [finished_build(spark, stored_ledger_path(spark, SF_SMALL))] * 4
    monkeypatch.undo()
    kept = []
    J.run_available(Q._ledger_stream(spark, SF_SMALL), f"{S._scratch(spark, 'ck')}", lambda b, n: kept.append(b.drop("event_ts").exceptAll(L).count() + b.count()))
    assert kept == [L.count()]


def test_duplicate_index_deals_rows_once(spark, make_ledger):
    """one shuffle by month and bucket serves the fold of copies, the comparison with stored rows and the files."""
    from pyspark.sql import functions as F
    from tallyspark.operators.relate import DUP_COLS, drop_known
    from tallyspark.streaming.dedupe_index import _fold, _new_rows
    ship_package(spark)
    stored = make_ledger(random_rows(80, 1, users=3) + [("n", 1, "income", None, 5, "2024-01-02", "x"), ("m", 2, "income", "a", 5, "2024-01-02", None)])
    rows = [(f"r{i}", *r[1:]) for i, r in enumerate(random_rows(80, 1, users=3)[:50] + random_rows(60, 2, users=3) * 2)]
    rows += [(f"n{i}", 1, "income", None, 5, "2024-01-02", "x") for i in range(3)] + [(f"m{i}", 2, "income", "a", 5, "2024-01-02", None) for i in range(3)]
    rows += [(f"d{i}", 2, "income", "a", None, None, None) for i in range(3)]
    batch = make_ledger(rows).coalesce(2).mapInArrow(_fold, LEDGER_SCHEMA)
    got = _new_rows(batch, stored, 4)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "Join" not in plan
    assert rows_of(got.select(*DUP_COLS)) == rows_of(drop_known(make_ledger(rows), stored).select(*DUP_COLS))
    assert {r[0] for r in got.select("tx_id").collect()} <= {r[0] for r in rows} and got.filter("tx_month is null or bucket is null").count() == 0
    alone = _new_rows(batch, None, 4)
    assert alone._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1
    assert rows_of(alone.select(*DUP_COLS)) == rows_of(make_ledger(rows).select(*DUP_COLS).distinct())
    hot = make_ledger([(str(i), 1, "income", "a", 5, "2024-01-02", None) for i in range(500)]).coalesce(1).mapInArrow(_fold, LEDGER_SCHEMA)
    assert hot.count() == 1 and hot.agg(F.min("tx_id")).first()[0] == "0"


def test_sinks_write_few_bytes(spark, monkeypatch):
    """the sink of flags holds the flags alone; cipher text and the stored ledger are written with zstd."""
    import numpy as np
    from conftest import SF_SMALL
    from tallyspark.ml.anomaly import IsolationForestModel
    from tallyspark.plans import model_queries as M
    from tallyspark.plans import stream_queries as Q
    from tallyspark.sources.testdata import finished_build, ledger, stored_ledger_path
    monkeypatch.setattr(M, "_fitted", lambda *a: IsolationForestModel(np.array([1.0]), np.array([1.0, 2.0]), 1, 2, 0.0))
    sunk = []
    real = J.run_available
    monkeypatch.setattr(J, "run_available", lambda sdf, *a, **k: (sunk.append(sdf.columns), real(sdf, *a, **k))[1])
    got = Q.q_stream_flag(spark, SF_SMALL)
    assert sunk == [["tx_id", "user_id", "amount", "score", "anomaly"]] and got.count() == ledger(spark, SF_SMALL).filter("t_type = 'expense'").count()
    made = []
    scratch = M._scratch
    monkeypatch.setattr(M, "_scratch", lambda sp, name: (made.append(scratch(sp, name)), made[-1])[1])
    M.q_encryption_roundtrip(spark, SF_SMALL)
    for path in (made[-1], finished_build(spark, stored_ledger_path(spark, SF_SMALL))):
        assert all(f.endswith(".zstd.parquet") for f in spark.read.parquet(path).inputFiles())


def test_rows_without_a_user_stay_apart(spark, make_ledger, tmp_path):
    """they are nobody's, also where they share a task with many users."""
    ship_package(spark)
    rows = [(str(i), None if i % 3 == 0 else i % 20, "expense", "a", 1 + i, f"2024-01-{1 + i % 28:02d}") for i in range(120)]
    from pyspark.sql import functions as F
    led = make_ledger([(r[0], -1 if r[1] is None else r[1], *r[2:]) for r in rows])
    led.withColumn("user_id", F.when(F.col("user_id") >= 0, F.col("user_id"))).coalesce(1).write.parquet(f"{tmp_path}/in")
    with rocksdb(spark):
        sdf = J.read_ledger_stream(spark, f"{tmp_path}/in", LEDGER_SCHEMA)
        J.run_available(stream_alerts_state(sdf), f"{tmp_path}/ck", J.write_batches(f"{tmp_path}/out"), output_mode="update")
    got = {r["user_id"]: r["balance"] for r in J.read_latest(spark, f"{tmp_path}/out", ["user_id"]).collect()}
    want = {}
    for r in rows:
        want[r[1]] = want.get(r[1], 0.0) - r[4]
    assert got == want
