"""Monthly expense predictor (H3, H4): random forest on (year, month).

The training rows are the (year, month) expense rollup, so the forest sees at
most one row per calendar month whatever the ledger size; the rollup itself
is the distributed part.  Settings follow the reference: 200 trees, seed 42,
bootstrap, every feature at every split, trees grown as deep as Spark allows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel, Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.operators.rollups import monthly_expense

N_TREES = 200
SEED = 42


def expense_rows(df: DataFrame, by: Sequence[str] | None = None) -> DataFrame:
    m = monthly_expense(df, by if by is not None else [])
    return m.select(*(by or []), F.col("year").cast("double").alias("year"),
                    F.col("month").cast("double").alias("month"),
                    F.col("total").cast("double").alias("label"))


def fit_expense(df: DataFrame, n_trees: int = N_TREES, seed: int = SEED) -> PipelineModel:
    """H3: fit on the whole input's monthly expense."""
    rows = expense_rows(df)
    rf = RandomForestRegressor(featuresCol="features", labelCol="label", numTrees=n_trees, seed=seed,
                               maxDepth=30, maxBins=64, minInstancesPerNode=1, subsamplingRate=1.0,
                               bootstrap=True, featureSubsetStrategy="all")
    asm = VectorAssembler(inputCols=["year", "month"], outputCol="features")
    return Pipeline(stages=[asm, rf]).fit(rows)


def predict_expense(model: PipelineModel, months: DataFrame) -> DataFrame:
    """H3: predicted expense for rows with ``year`` and ``month`` columns."""
    m = months.select("*", F.col("year").cast("double").alias("_y"), F.col("month").cast("double").alias("_m"))
    m = m.drop("year", "month").withColumnRenamed("_y", "year").withColumnRenamed("_m", "month")
    return model.transform(m).drop("features")


def evaluate_expense(model: PipelineModel, df: DataFrame) -> DataFrame:
    """H4: mean absolute error over the held-out months (NaN when there are none)."""
    p = predict_expense(model, expense_rows(df))
    return p.agg(F.coalesce(F.avg(F.abs(F.col("prediction") - F.col("label"))), F.lit(float("nan"))).alias("mae"),
                 F.count(F.lit(1)).alias("n_months"))
