"""Budget clusters and advice.

Training rows are the month x category expense matrix (one row per month of
the training ledger).  Columns are standardised with the population mean and
standard deviation (a constant column divides by 1), then k-means with k = 3
(fewer when there are fewer months) is run from 10 seeds and the lowest-cost
fit is kept.

Advice scores each key's last month with expenses: its category vector is
standardised with the training statistics, assigned to the nearest centre,
and the centre's meaning picks the text.  Meanings are fixed by a rule on
the centres in money units: the centre with the largest single-category
share means "heavy in one category", of the others the one with the
largest total means "irregular big expenses", the remaining one "balanced".
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.columns import keys, ratio
from tallyspark.operators.filters import fill_category
from tallyspark.operators.rollups import category_matrix, last_month_matrix
from tallyspark.schema import ADVICE_MIN_ROWS, EXPENSE

# ---- Fixed values: reference settings and advice texts ----
K = 3
N_STARTS = 10
SEED = 42
ADVICE_HEAVY = "💡 You spend heavily in one category. Set a cap for it to free up savings."
ADVICE_BALANCED = "✅ Your spending is balanced across categories. Maintain at least 20% savings."
ADVICE_IRREGULAR = "⚠ You have irregular big expenses. Build an emergency fund to stay safe."
ADVICE_FEW_1 = "Track a few more transactions for tailored budget advice."
ADVICE_FEW_2 = "Tip: Categorize your expenses to see where your money goes."
ADVICE_FEW_AVG = "Your average transaction so far is ${avg}."
ADVICE_NO_EXPENSE = "📌 No expenses recorded yet. Try setting a starter budget for essentials and savings."
ADVICE_NO_MODEL = "⚠ No trained model found. Train the model before requesting recommendations."
ADVICE_FALLBACK_1 = "No specific recommendations at this time. Keep tracking your spending!"
ADVICE_FALLBACK_2 = "Tip: Review your top expense categories for potential savings."
ADVICE_FALLBACK_AVG = "Your average transaction is ${avg}."


@dataclass
class BudgetModel:
    categories: list[str]
    means: list[float]
    stds: list[float]
    kmeans: KMeansModel
    meanings: list[str]   # advice text per cluster id


def _std_cols(cats: Sequence[str], means: Sequence[float], stds: Sequence[float]) -> list[F.Column]:
    return [((F.col(f"`{c}`").cast("double") - F.lit(m)) / F.lit(s)).alias(f"_z{i}")
            for i, (c, m, s) in enumerate(zip(cats, means, stds))]


def fit_budget(df: DataFrame, cats: Sequence[str], k: int = K, n_starts: int = N_STARTS,
               seed: int = SEED) -> BudgetModel | None:
    """K-means over the standardised month x category matrix of the whole input."""
    cats = list(cats)
    m = category_matrix(df, cats, by=[]).cache()
    stats = m.agg(*[F.avg(F.col(f"`{c}`").cast("double")).alias(f"m{i}") for i, c in enumerate(cats)],
                  *[F.stddev_pop(F.col(f"`{c}`").cast("double")).alias(f"s{i}") for i, c in enumerate(cats)],
                  F.count(F.lit(1)).alias("n")).first()
    n = stats["n"]
    if n == 0:
        m.unpersist()
        return None
    means = [float(stats[f"m{i}"]) for i in range(len(cats))]
    stds = [float(stats[f"s{i}"]) or 1.0 for i in range(len(cats))]
    z = VectorAssembler(inputCols=[f"_z{i}" for i in range(len(cats))], outputCol="features") \
        .transform(m.select(*_std_cols(cats, means, stds))).cache()
    kk = max(1, min(k, n))
    best = None
    for s in range(n_starts):
        model = KMeans(k=kk, seed=seed + s, maxIter=300, tol=1e-4, initMode="k-means||").fit(z)
        cost = model.summary.trainingCost
        if best is None or cost < best[0]:
            best = (cost, model)
    z.unpersist()
    m.unpersist()
    km = best[1]
    centres = np.array([c for c in km.clusterCenters()]) * np.array(stds) + np.array(means)
    return BudgetModel(cats, means, stds, km, _meanings(centres))


def _meanings(centres: np.ndarray) -> list[str]:
    k = len(centres)
    totals = np.clip(centres, 0, None).sum(axis=1)
    share = np.where(totals > 0, np.clip(centres, 0, None).max(axis=1) / np.where(totals > 0, totals, 1), 0)
    out = [ADVICE_BALANCED] * k
    heavy = int(np.argmax(share))
    out[heavy] = ADVICE_HEAVY
    rest = [i for i in range(k) if i != heavy]
    if len(rest) == 2:
        out[max(rest, key=lambda i: totals[i])] = ADVICE_IRREGULAR
    return out


def assign_clusters(model: BudgetModel, matrix: DataFrame) -> DataFrame:
    """Cluster id and advice text for each row of a category matrix."""
    cats = model.categories
    filled = matrix.select("*", *[F.lit(0.0).alias(c) for c in cats if c not in matrix.columns])
    z = filled.select("*", *_std_cols(cats, model.means, model.stds))
    feats = VectorAssembler(inputCols=[f"_z{i}" for i in range(len(cats))], outputCol="features").transform(z)
    out = model.kmeans.transform(feats)
    text = F.element_at(F.array(*[F.lit(t) for t in model.meanings]), F.col("prediction") + 1)
    return out.withColumn("advice", text).drop("features", *[f"_z{i}" for i in range(len(cats))]) \
        .withColumnRenamed("prediction", "cluster")


def _with_average(text: str) -> F.Column:
    """``text`` with ``{avg}`` replaced by the mean amount (0.00 without any amount)."""
    before, after = text.split("{avg}")
    return F.concat(F.lit(before), F.format_string("%.2f", F.coalesce("avg_amount", F.lit(0.0))), F.lit(after))


def budget_advice(model: BudgetModel | None, df: DataFrame, by: Sequence[str] | None = None) -> DataFrame:
    """Advice per key; missing categories count as ``Uncategorized``.

    Fewer than 10 rows: starter tips with the mean amount.  Without a model
    (None): the text that says so.  Keys without expenses get the
    starter-budget text; a last month without an amount in any category the
    model knows gets the fallback tips; otherwise the cluster text of that
    month.  Categories the model never saw are counted in
    ``unseen_categories`` and left out of the vector.
    """
    k = keys(by)
    df = fill_category(df)
    counts = df.groupBy(*k).agg(F.count(F.lit(1)).alias("n_rows"),
                                ratio(F.sum("amount"), F.count("amount")).alias("avg_amount"))
    few = F.array(F.lit(ADVICE_FEW_1), F.lit(ADVICE_FEW_2), _with_average(ADVICE_FEW_AVG))
    if model is None:
        recs = F.when(F.col("n_rows") < ADVICE_MIN_ROWS, few).otherwise(F.array(F.lit(ADVICE_NO_MODEL)))
        return counts.select(*k, "n_rows", F.lit(None).cast("string").alias("month"),
                             F.lit(None).cast("int").alias("cluster"), recs.alias("recommendations"),
                             F.lit(0).cast("long").alias("unseen_categories"))
    last = last_month_matrix(df, model.categories, by)
    known = F.lit(False)
    for c in model.categories:
        known = known | (F.col(f"`{c}`") != 0)
    assigned = assign_clusters(model, last).select(*k, "month", "cluster", "advice", known.alias("known"))
    seen = F.array(*[F.lit(c) for c in model.categories])
    unseen = (df.filter((F.col("t_type") == EXPENSE) & F.col("category").isNotNull()
                        & ~F.array_contains(seen, F.col("category")))
              .groupBy(*k).agg(F.countDistinct("category").alias("unseen_categories")))
    j = counts.join(assigned, on=k, how="left").join(unseen, on=k, how="left")
    fallback = F.array(F.lit(ADVICE_FALLBACK_1), F.lit(ADVICE_FALLBACK_2), _with_average(ADVICE_FALLBACK_AVG))
    recs = (F.when(F.col("n_rows") < ADVICE_MIN_ROWS, few)
            .when(F.col("advice").isNull(), F.array(F.lit(ADVICE_NO_EXPENSE)))
            .when(~F.col("known"), fallback)
            .otherwise(F.array(F.col("advice"))))
    return j.select(*k, "n_rows", "month", "cluster", recs.alias("recommendations"),
                    F.coalesce("unseen_categories", F.lit(0).cast("long")).alias("unseen_categories"))
