"""Sources and sinks: mixed CSV layouts, JSON payloads, exports, appends, evolution, encryption."""

import json

from pyspark.sql import functions as F

from conftest import D, M, collect
from tallyspark.operators import quality as Q
from tallyspark.sources import files as A


def test_csv_any_column_order_and_crlf(spark, tmp_path):
    a = tmp_path / "a.csv"
    a.write_bytes(b"date,type,amount,category,note\r\n2024-01-05,income,3500,Salary,Monthly pay\r\n"
                  b"2024-01-07,expense,120.5,Food,\r\n")
    b = tmp_path / "b.csv"
    b.write_text("type,category,amount,date,note\nexpense,food,10.25,2025-04-26,lunch\n")
    df = A.read_ledger_csv(spark, [str(a), str(b)], user_id=7)
    rows = collect(df, ["tx_date"])
    assert [r["amount"] for r in rows] == [M(3500), M(120.5), M(10.25)]
    assert [r["tx_date"] for r in rows] == [D("2024-01-05"), D("2024-01-07"), D("2025-04-26")]
    assert rows[1]["note"] is None and rows[0]["user_id"] == 7 and rows[2]["category"] == "food"
    assert len({r["tx_id"] for r in rows}) == 3


def test_csv_export_with_ids_and_float_household(spark, tmp_path):
    p = tmp_path / "u.csv"
    p.write_text("id,user_id,type,category,amount,date,note\n3,2.0,expense,Rent,90000.0,2025-10-01,\n")
    r = collect(A.read_ledger_csv(spark, str(p)))[0]
    assert r["tx_id"] == "3" and r["user_id"] == 2 and r["amount"] == M(90000)


def test_json_payload_and_lines(spark, tmp_path):
    p = tmp_path / "payload.json"
    p.write_text(json.dumps({"transactions": [
        {"date": "2024-01-05", "type": "expense", "amount": 12.5, "category": "Food", "note": "pizza"},
        {"date": "2024-01-06", "type": "income", "amount": 100, "category": "Salary"}]}))
    rows = collect(A.read_ledger_json(spark, str(p), user_id=1), ["tx_date"])
    assert [r["amount"] for r in rows] == [M(12.5), M(100)] and rows[1]["note"] is None


def test_write_empty_frame_writes_nothing(spark, tmp_path, make_ledger):
    L = make_ledger([("1", 1, "income", "S", 1, "2024-01-01")])
    assert A.write_csv(L.filter("1 = 0"), str(tmp_path / "e")) is False
    assert not (tmp_path / "e").exists()
    assert A.write_json(A.export_ledger(L), str(tmp_path / "j")) is True
    back = collect(A.read_ledger_json(spark, str(tmp_path / "j")))
    assert back[0]["tx_date"] == D("2024-01-01") and back[0]["tx_id"] == "1"


def test_append_partitioned_and_pruned(spark, tmp_path, make_ledger):
    L = make_ledger([("1", 1, "income", "S", 1, "2024-01-01"), ("2", 1, "expense", "R", 2, "2024-02-01")])
    path = str(tmp_path / "ledger")
    A.append_ledger(L, path)
    A.append_ledger(L.withColumn("tx_id", F.lit("3")).limit(1), path)
    q = A.read_ledger_parquet(spark, path).filter(F.col("tx_month") == "2024-01")
    assert q.count() == 2
    plan = q._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "tx_month" in plan


def test_evolve_adds_default(spark):
    users = spark.createDataFrame([(1, "ann")], "user_id long, username string")
    r = collect(A.evolve(users, {"role": "user"}))[0]
    assert r["role"] == "user"


def test_encrypt_roundtrip_and_bad_tokens(make_ledger):
    L = make_ledger([("1", 1, "expense", "A", 5, "2024-01-01", "secret note")])
    key = "k" * 16
    enc = Q.encrypt_fields(L, key)
    e = collect(enc)[0]
    assert e["note"] != "secret note"
    dec = collect(Q.decrypt_fields(enc, key))[0]
    assert dec["note"] == "secret note" and dec["amount"] == "5.00"
    plain = collect(Q.decrypt_fields(L.select("tx_id", "note", F.col("amount").cast("string")), key))[0]
    assert plain["note"] == "secret note"   # not a token: returned unchanged
    cov = collect(Q.encryption_coverage(enc, key))[0]
    assert cov["encrypted_share"] == 1.0


def test_sensitive_columns_and_mask(spark, make_ledger):
    users = spark.createDataFrame([(1, "ann", "1234"), (2, "bob", None)],
                                  "user_id long, username string, account_no string")
    r = {x["column_name"]: x["non_null"] for x in collect(Q.sensitive_columns(users))}
    assert r == {"username": 2, "account_no": 1}
    assert collect(Q.sensitive_columns(users.select("user_id"))) == []
    L = make_ledger([("1", 1, "expense", "A", 5, "2024-01-01", "Card 42")])
    assert collect(Q.masked(L))[0]["note"] == "Xxxx nn"


def test_files_of_one_folder_with_different_headers_raise(spark, tmp_path):
    import pytest
    (tmp_path / "a.csv").write_text("date,type,amount,category,note\n2024-01-05,income,10,sal,n\n")
    (tmp_path / "b.csv").write_text("type,category,amount,date,note\nincome,sal,10,2024-01-05,n\n")
    with pytest.raises(Exception, match="(?i)header"):
        A.read_ledger_csv(spark, str(tmp_path), user_id=1).collect()
    both = A.read_ledger_csv(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")], user_id=1)
    assert {(r["t_type"], r["category"], str(r["tx_date"])) for r in both.collect()} == {("income", "sal", "2024-01-05")}


def test_json_lines_and_payloads_in_one_file(spark, tmp_path):
    (tmp_path / "m.json").write_text(
        '{"date": "2024-01-05", "type": "income", "amount": 10.5, "category": "sal", "note": "a"}\n'
        '{"transactions": [{"date": "2024-01-06", "type": "expense", "amount": "3", "user_id": 9}, '
        '{"id": "x", "date": "bad", "type": "expense"}]}\n'
        '{"transactions": []}\n')
    rows = A.read_ledger_json(spark, str(tmp_path), user_id=4).collect()
    got = sorted((r["user_id"], r["t_type"], str(r["amount"]), str(r["tx_date"])) for r in rows)
    assert got == [(4, "expense", "None", "None"), (4, "income", "10.50", "2024-01-05"), (9, "expense", "3.00", "2024-01-06")]
    assert {r["tx_id"] for r in rows if r["amount"] is None} == {"x"} and all(r["tx_id"] for r in rows)


def test_unfinished_ledger_build_is_ignored_and_a_changed_source_is_seen(spark, tmp_path):
    import os
    import shutil
    from tallyspark.sources import testdata as TD
    for t in ("orders", "lineitem", "part"):
        shutil.copyfile(f"/root/testdata/sf0.001/{t}.parquet", tmp_path / f"{t}.parquet")
    d = str(tmp_path)
    path = TD.stored_ledger_path(spark, d)
    whole = TD.ledger_view(spark, d)
    A.store_ledger(whole.filter("tx_date < date'2000-01-01'"), f"{path}/build-0")   # half the rows, no marker
    os.remove(path.removeprefix("file:") + "/build-0/_SUCCESS")
    assert TD.finished_build(spark, path) is None
    assert TD.ledger(spark, d).count() == whole.count()
    assert TD.finished_build(spark, path) is not None
    os.utime(tmp_path / "part.parquet", (1, 1))
    assert TD.stored_ledger_path(spark, d) != path
