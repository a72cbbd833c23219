"""Budget clusters over any number of categories (C11, C12, H10): sparse month vectors.

``budget.py`` has one column per category, which ends at a few thousand.  Here a month is one row
with the categories that occur in it; a category is a row of a table, never a column.

The clustering is that of ``budget.py``: months x categories, standardised per category with the
population standard deviation (a constant column divides by 1), k-means with k = 3 from 10 seeds, lowest
cost.  Centring moves all months and centres alike and changes no distance, so the vectors are
only divided by the deviations and stay sparse.  Means and deviations come from one aggregation: zeros
that are not stored count through the number of months.

The driver holds the model (k dense centres, bounded by the number of categories); the category
table stays in Spark and is joined, so assignment never lists the categories in a plan.

Defined cases: null categories are left out, as are categories unknown to the model at assignment (a
month of unknown categories only has an empty vector and its nearest centre); no months give no model.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.columns import keys, month_label
from tallyspark.ml.budget import K, N_STARTS, SEED, _meanings
from tallyspark.schema import EXPENSE
from tallyspark.session import checkpoint_dir


@dataclass
class SparseBudgetModel:
    columns: DataFrame          # category, i, std
    size: int
    kmeans: KMeansModel
    meanings: list[str]


def category_totals(df: DataFrame, by: Sequence[str] | None = None) -> DataFrame:
    """C11 in sparse form: (keys, month, category, total), one row per category that occurs in the month."""
    return (df.filter((F.col("t_type") == EXPENSE) & F.col("category").isNotNull() & F.col("tx_date").isNotNull())
            .groupBy(*keys(by), month_label("tx_date").alias("month"), "category").agg(F.sum("amount").alias("total")))


def last_month_totals(df: DataFrame, by: Sequence[str] | None = None) -> DataFrame:
    """C12 in sparse form: the totals of each key's last month with expenses."""
    t = category_totals(df, by)
    k = keys(by)
    last = t.groupBy(*k).agg(F.max("month").alias("month"))
    return t.join(last, [*k, "month"], "left_semi")


def _vectors(totals: DataFrame, columns: DataFrame, size: int, row: Sequence[str]) -> DataFrame:
    """(row columns, features): totals divided by the deviations, as sparse vectors."""
    known = totals.join(columns, "category", "left").withColumn("z", F.col("total").cast("double") / F.col("std"))
    entry = F.when(F.col("i").isNotNull() & F.col("z").isNotNull(), F.struct("i", "z"))
    entries = known.groupBy(*row).agg(F.array_sort(F.collect_list(entry)).alias("entries"))    # nulls are not collected
    make = F.udf(lambda e: SparseVector(size, [x["i"] for x in e], [x["z"] for x in e]), VectorUDT())
    return entries.select(*row, make("entries").alias("features"))


def fit_budget_sparse(df: DataFrame, k: int = K, n_starts: int = N_STARTS, seed: int = SEED) -> SparseBudgetModel | None:
    """K-means over the months of the whole input; None when there are none."""
    checkpoint_dir(df.sparkSession)
    totals = category_totals(df, by=[]).persist()
    try:
        n = totals.select("month").distinct().count()
        if n == 0:
            return None
        x = F.col("total").cast("double")
        stats = totals.groupBy("category").agg(F.sum(x).alias("s"), F.sum(x * x).alias("q"),
                                               F.count("total").alias("held"), F.min(x).alias("low"), F.max(x).alias("high"))
        mean = F.col("s") / n
        constant = (F.col("low") == F.col("high")) & (F.col("held") == n)
        std = F.when(constant, 0.0).otherwise(F.sqrt(F.greatest(F.col("q") / n - mean * mean, F.lit(0.0))))
        numbered = stats.select("category", F.when(std > 0, std).otherwise(1.0).alias("std"), mean.alias("mean")) \
            .orderBy("category").rdd.zipWithIndex().map(lambda r: (r[0][0], int(r[1]), r[0][1], r[0][2])) \
            .toDF("category string, i int, std double, mean double").checkpoint()       # the model's own table
        size = numbered.count()
        z = _vectors(totals, numbered.select("category", "i", "std"), size, ["month"]).persist()
        best = None
        for s in range(n_starts):
            model = KMeans(k=max(1, min(k, n)), seed=seed + s, maxIter=300, tol=1e-4, initMode="k-means||").fit(z)
            if best is None or model.summary.trainingCost < best[0]:
                best = (model.summary.trainingCost, model)
        z.unpersist()
        stds = np.ones(size)
        for r in numbered.select("i", "std").toLocalIterator():     # model-sized: one number per category
            stds[r["i"]] = r["std"]
        centres = np.array(best[1].clusterCenters()) * stds
        return SparseBudgetModel(numbered.select("category", "i", "std"), size, best[1], _meanings(centres))
    finally:
        totals.unpersist()


def assign_sparse(model: SparseBudgetModel, totals: DataFrame, row: Sequence[str] = ("month",)) -> DataFrame:
    """(row columns, cluster, advice) for every row that ``totals`` (category, total) describes."""
    out = model.kmeans.transform(_vectors(totals, model.columns, model.size, list(row)))
    text = F.element_at(F.array(*[F.lit(t) for t in model.meanings]), F.col("prediction") + 1)
    return out.select(*row, F.col("prediction").alias("cluster"), text.alias("advice"))
