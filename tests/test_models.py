"""Property tests for the models (they have no exact SQL twin)."""

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from conftest import SF_SMALL, collect
from tallyspark.ml import anomaly as A
from tallyspark.ml import budget as Bu
from tallyspark.ml import category as Ca
from tallyspark.ml import expense as Ex
from tallyspark.sources.testdata import ledger


def _spike(make_ledger, n=200, big=100.0):
    rows = [(f"t{i:04d}", 1, "expense", "Food", 10 + (i % 17) * 0.5, "2024-01-05") for i in range(n)]
    rows.append(("spike", 1, "expense", "Food", (10 + 8) * big, "2024-01-06"))
    return make_ledger(rows)


def test_isolation_forest_flags_the_spike_and_about_five_percent(make_ledger):
    L = _spike(make_ledger)
    m = A.fit_anomaly(L)
    assert m.psi == 201  # n < 256: every tree sees every row
    s = collect(A.score_anomalies(m, L))
    flagged = [r for r in s if r["anomaly"]]
    assert "spike" in {r["tx_id"] for r in flagged}
    # contamination 5%: ties can push the count up, never below the quantile count
    assert 0 < len(flagged) <= 0.05 * len(s) + 20
    top = max(s, key=lambda r: -r["score"])
    assert top["tx_id"] == "spike"


def test_isolation_forest_is_seed_stable_and_monotone_outside(make_ledger):
    L = _spike(make_ledger)
    m1, m2 = A.fit_anomaly(L), A.fit_anomaly(L)
    assert np.array_equal(m1.breaks, m2.breaks) and m1.offset == m2.offset
    spark = L.sparkSession
    probe = spark.createDataFrame([(x,) for x in [18.5, 100.0, 5000.0, 1e6]], "amount double")
    sc = [r[0] for r in probe.select(m1.score_column(spark, F.col("amount"))).collect()]
    edge = [r[0] for r in spark.createDataFrame([(1800.0,)], "amount double")
            .select(m1.score_column(spark, F.col("amount"))).collect()][0]
    assert sc[3] <= edge + 1e-12   # beyond the training range scores at least as anomalous as its edge


def test_isolation_forest_sampling_bounded_on_large_input(spark):
    L = ledger(spark, SF_SMALL)
    x = L.filter("t_type = 'expense'").select("tx_id", "amount")
    n = x.count()
    sample = A.tree_samples(x, n, "tx_id", "amount")
    per_tree = sample.groupBy("tree").count().agg(F.min("count"), F.max("count"), F.count("*")).first()
    assert per_tree[2] == A.N_TREES and per_tree[1] <= 256 and per_tree[0] >= 200


def test_isolation_forest_model_roundtrip(make_ledger, tmp_path):
    L = _spike(make_ledger)
    m = A.fit_anomaly(L)
    m.save(L.sparkSession, str(tmp_path / "m"))
    m2 = A.IsolationForestModel.load(L.sparkSession, str(tmp_path / "m"))
    assert np.allclose(m.breaks, m2.breaks) and np.allclose(m.levels, m2.levels) and m.offset == m2.offset


def test_classifier_probabilities_and_top3(make_ledger):
    rows = []
    for i in range(40):
        rows.append((f"f{i}", 1, "expense", "Food", 5, "2024-01-05", f"pizza lunch at cafe {i}"))
        rows.append((f"r{i}", 1, "expense", "Rent", 500, "2024-01-05", f"monthly flat rent payment {i}"))
        rows.append((f"t{i}", 1, "expense", "Travel", 50, "2024-01-05", f"train ticket to city {i}"))
    L = make_ledger(rows)
    m = Ca.fit_category(L, max_iter=100)
    test = make_ledger([("q1", 1, "expense", "Food", 5, "2024-02-01", "pizza at the cafe"),
                        ("q2", 1, "expense", "Rent", 5, "2024-02-01", "rent for the flat")])
    p = collect(Ca.predict_category(m, test).select("tx_id", "predicted", vector_to_array("probability").alias("p")),
                ["tx_id"])
    assert [r["predicted"] for r in p] == ["Food", "Rent"]
    for r in p:
        assert abs(sum(r["p"]) - 1.0) < 1e-9
    acc = collect(Ca.evaluate_category(m, test))[0]
    assert acc["accuracy"] == 1.0
    top = collect(Ca.suggest_categories(m, test), ["tx_id", "rank"])
    assert [t["rank"] for t in top] == [1, 2, 3, 1, 2, 3] and top[0]["category"] == "Food"
    resolved = collect(Ca.resolve_with_model(m, test.withColumn("category", F.lit(" "))), ["tx_id"])
    assert [r["category"] for r in resolved] == ["Food", "Rent"]


def test_expense_forest_fits_training_months(make_ledger):
    rows = [(f"{y}{mo}", 1, "expense", "A", 100 * mo, f"{y}-{mo:02d}-10") for y in (2022, 2023) for mo in range(1, 13)]
    L = make_ledger(rows)
    m = Ex.fit_expense(L, n_trees=20)
    ev = collect(Ex.evaluate_expense(m, L))[0]
    assert ev["n_months"] == 24 and ev["mae"] < 200
    empty = collect(Ex.evaluate_expense(m, L.filter("1 = 0")))[0]
    assert np.isnan(empty["mae"])


def test_budget_clusters_and_advice(make_ledger):
    rows = []
    for mo in range(1, 13):
        heavy = mo % 3 == 0
        rows.append((f"a{mo}", 1, "expense", "Rent", 900 if heavy else 300, f"2024-{mo:02d}-03"))
        rows.append((f"b{mo}", 1, "expense", "Food", 100 + mo, f"2024-{mo:02d}-04"))
        rows.append((f"c{mo}", 1, "expense", "Fun", 50 if mo != 7 else 2000, f"2024-{mo:02d}-05"))
    L = make_ledger(rows)
    m = Bu.fit_budget(L, ["Food", "Fun", "Rent"])
    assert len(m.meanings) == 3 and set(m.meanings) == {Bu.ADVICE_HEAVY, Bu.ADVICE_BALANCED, Bu.ADVICE_IRREGULAR}
    cl = collect(Bu.assign_clusters(m, __import__("tallyspark.operators.rollups", fromlist=["x"])
                                    .category_matrix(L, ["Food", "Fun", "Rent"], by=[])))
    assert {r["cluster"] for r in cl} <= {0, 1, 2}
    adv = collect(Bu.budget_advice(m, L))[0]
    assert adv["n_rows"] == 36 and len(adv["recommendations"]) == 1 and adv["month"] == "2024-12"
    few = make_ledger([("x", 2, "expense", "Food", 3, "2024-01-01")])
    adv2 = collect(Bu.budget_advice(m, few))[0]
    assert adv2["recommendations"][-1] == "Your average transaction so far is $3.00."
    # a last month without any category the model knows, and no model at all
    other = make_ledger([(f"y{i}", 3, "expense", None if i % 2 else "Boats", 4, "2024-05-01") for i in range(12)])
    adv3 = collect(Bu.budget_advice(m, other))[0]
    assert adv3["recommendations"] == [Bu.ADVICE_FALLBACK_1, Bu.ADVICE_FALLBACK_2, "Your average transaction is $4.00."]
    assert adv3["unseen_categories"] == 2
    assert collect(Bu.budget_advice(None, other))[0]["recommendations"] == [Bu.ADVICE_NO_MODEL]
    assert collect(Bu.budget_advice(None, few))[0]["recommendations"][0] == Bu.ADVICE_FEW_1


def test_exact_percentile_matches_numpy():
    rng = np.random.default_rng(3)
    for _ in range(20):
        vals = np.sort(rng.choice(50, size=rng.integers(1, 20), replace=False).astype(float))
        cnts = rng.integers(1, 9, size=len(vals))
        full = np.repeat(vals, cnts)
        for q in (0.0, 0.05, 0.5, 0.97, 1.0):
            assert abs(A.exact_percentile(vals, cnts, q) - np.percentile(full, 100 * q)) < 1e-9


def test_insight_messages_long_form(make_ledger):
    from tallyspark.plans.report import MSG_OVERSPENT, insight_messages
    L = _spike(make_ledger)
    m = A.fit_anomaly(L)
    an = A.detect_anomalies(m, L)
    adv = L.sparkSession.createDataFrame([(1, ["tip one", "tip two"])], "user_id long, recommendations array<string>")
    rows = collect(insight_messages(L, anomalies=an, advice=adv), ["section", "sort_key"])
    assert rows[0]["section"] == 0 and rows[0]["message"] == MSG_OVERSPENT
    spike = [r["message"] for r in rows if r["section"] == 1 and "1800.00" in r["message"]]
    assert spike == ["⚠️ On 2024-01-06, unusual spending detected: $1800.00 in Food."]
    assert [r["message"] for r in rows if r["section"] == 3] == ["tip one", "tip two"]
    assert [r["section"] for r in rows].count(2) == 1


def test_classifier_caches_counts_alone(spark, make_ledger, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame
    from tallyspark.ml import category
    kept, real = [], DataFrame.cache
    monkeypatch.setattr(DataFrame, "cache", lambda self: (kept.append(self.columns), real(self))[1])
    category.fit_category(make_ledger([("1", 1, "expense", "a", 1, "2024-01-01", "red car"), ("2", 1, "expense", "b", 1, "2024-01-01", "blue bus")]), max_iter=2)
    assert kept == [["category", "_tf"]]
