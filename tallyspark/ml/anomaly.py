"""Isolation-forest anomaly flags on expense amounts (H5, H6, H7).

Spark ML has no isolation forest.  With one feature every isolation tree is
a partition of the real line into intervals with a path length each, so the
forest is built and applied as Spark jobs:

1. sampling (distributed): every tree gets up to ``psi = min(256, n)`` rows.
   A row is a candidate for a tree with probability ``q = 2 psi / n``
   decided by hashing (row id, seed, tree); the ``psi`` candidates with the
   smallest second hash form the tree's sample, a uniform sample without
   replacement.  A row-level hash filter first keeps only rows that can be a
   candidate of some tree, so the explode touches about ``300 * 2 psi`` rows
   whatever the ledger size.
2. growing (``groupBy(tree).applyInPandas``): each task grows one tree from
   its <= 256 values and emits the leaf intervals ``(lo, hi]`` with path
   length ``depth + c(leaf size)``.
3. combining (Spark): per tree the path length changes at each leaf border;
   summing those changes per border gives the forest's mean path length as a
   step function with at most ``300 * 255`` steps (model-sized, not data-sized).
4. scoring (pandas UDF, Arrow batches): binary search in the broadcast step
   table; ``score = -2 ** (-E[h] / c(psi))``.  The cut is the 5th percentile
   of the training scores (exact, linear interpolation), read from a
   ``groupBy(score).count()`` table that is model-sized because scores take
   at most one value per step; rows scoring below the cut are anomalies.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tallyspark.schema import EXPENSE

# ---- Fixed values of the reference model ----
N_TREES = 300
MAX_SAMPLES = 256
CONTAMINATION = 0.05
SEED = 42
EULER_GAMMA = 0.5772156649015329
_SCALE = 9007199254740992  # 2**53: hash -> uniform [0, 1)


def average_path_length(n) -> np.ndarray:
    """c(n): mean path length of an unsuccessful search in a binary search tree of n points."""
    n = np.asarray(n, dtype=float)
    out = np.zeros_like(n)
    out[n == 2] = 1.0
    m = n > 2
    out[m] = 2.0 * (np.log(n[m] - 1.0) + EULER_GAMMA) - 2.0 * (n[m] - 1.0) / n[m]
    return out


@dataclass
class IsolationForestModel:
    breaks: np.ndarray      # sorted leaf borders
    levels: np.ndarray      # sum of path lengths left of, between and right of the borders
    n_trees: int
    psi: int
    offset: float           # score cut (5th percentile of training scores)

    @property
    def c_psi(self) -> float:
        return float(average_path_length([self.psi])[0])

    def score_column(self, spark: SparkSession, value: F.Column) -> F.Column:
        bc = spark.sparkContext.broadcast((self.breaks, self.levels, self.n_trees, self.c_psi))

        @pandas_udf("double")
        def _score(x: pd.Series) -> pd.Series:
            breaks, levels, t, c = bc.value
            idx = np.searchsorted(breaks, x.to_numpy(dtype=float), side="left")
            return pd.Series(-np.power(2.0, -(levels[idx] / t) / c))

        return _score(value.cast("double"))

    # ---- A9: persistence as a small parquet table ----
    def save(self, spark: SparkSession, path: str) -> None:
        meta = [(-1, float(self.n_trees), float(self.psi), float(self.offset))]
        rows = meta + [(i, float(b), 0.0, 0.0) for i, b in enumerate(self.breaks)]
        lv = [(-2 - i, float(v), 0.0, 0.0) for i, v in enumerate(self.levels)]
        spark.createDataFrame(rows + lv, "i long, a double, b double, c double") \
            .coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "IsolationForestModel":
        pdf = spark.read.parquet(path).toPandas().sort_values("i")
        meta = pdf[pdf.i == -1].iloc[0]
        breaks = pdf[pdf.i >= 0].sort_values("i").a.to_numpy()
        levels = pdf[pdf.i <= -2].sort_values("i", ascending=False).a.to_numpy()
        return cls(breaks, levels, int(meta.a), int(meta.b), float(meta.c))


def _uniform(*cols) -> F.Column:
    return F.pmod(F.xxhash64(*cols), F.lit(_SCALE)) / F.lit(float(_SCALE))


def tree_samples(x: DataFrame, n: int, id_col: str, value_col: str,
                 n_trees: int = N_TREES, max_samples: int = MAX_SAMPLES, seed: int = SEED) -> DataFrame:
    """(tree, value) rows: up to ``psi`` sampled rows per tree, without replacement."""
    psi = min(max_samples, n)
    q = min(1.0, 2.0 * psi / n)
    r = min(1.0, n_trees * q)
    cond = q / r
    rows = x.filter(_uniform(F.col(id_col), F.lit(seed)) < r) if r < 1.0 else x
    trees = F.filter(F.sequence(F.lit(0), F.lit(n_trees - 1)),
                     lambda t: _uniform(F.col(id_col), F.lit(seed), t) < F.lit(cond))
    cand = rows.select(F.col(id_col).alias("_id"), F.col(value_col).cast("double").alias("value"),
                       F.explode(trees).alias("tree"))
    w = Window.partitionBy("tree").orderBy(F.xxhash64("_id", F.lit(seed + 1), "tree"), "_id")
    return cand.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= psi).select("tree", "value")


def _grow_fn(seed: int, psi: int):
    max_depth = int(math.ceil(math.log2(max(psi, 2))))

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        vals = np.sort(pdf["value"].to_numpy(dtype=float))
        rng = np.random.default_rng([seed, tree])
        out = []
        stack = [(vals, -np.inf, np.inf, 0)]
        while stack:
            v, lo, hi, d = stack.pop()
            if d >= max_depth or len(v) <= 1 or v[0] == v[-1]:
                out.append((tree, lo, hi, d + float(average_path_length([len(v)])[0])))
                continue
            s = rng.uniform(v[0], v[-1])
            k = int(np.searchsorted(v, s, side="right"))
            stack.append((v[:k], lo, s, d + 1))
            stack.append((v[k:], s, hi, d + 1))
        return pd.DataFrame(out, columns=["tree", "lo", "hi", "path"])

    return grow


def fit_anomaly(df: DataFrame, id_col: str = "tx_id", value_col: str = "amount",
                n_trees: int = N_TREES, max_samples: int = MAX_SAMPLES,
                contamination: float = CONTAMINATION, seed: int = SEED) -> IsolationForestModel | None:
    """H5: fit on the expense rows of ``df``; None when there are none."""
    spark = df.sparkSession
    x = df.filter((F.col("t_type") == EXPENSE) & F.col(value_col).isNotNull()).select(id_col, value_col)
    n = x.count()
    if n == 0:
        return None
    psi = min(max_samples, n)
    sample = tree_samples(x, n, id_col, value_col, n_trees, max_samples, seed)
    leaves = sample.groupBy("tree").applyInPandas(_grow_fn(seed, psi),
                                                  "tree int, lo double, hi double, path double")
    leaves = leaves.cache()
    w = Window.partitionBy("tree").orderBy("lo")
    steps = (leaves.withColumn("delta", F.col("path") - F.lag("path").over(w))
             .filter(F.col("lo") > float("-inf"))
             .groupBy("lo").agg(F.sum("delta").alias("delta")).orderBy("lo").toPandas())
    base = leaves.filter(F.col("lo") == float("-inf")).agg(F.sum("path")).first()[0]
    leaves.unpersist()
    breaks = steps["lo"].to_numpy(dtype=float)
    levels = np.concatenate([[base], base + np.cumsum(steps["delta"].to_numpy(dtype=float))])
    model = IsolationForestModel(breaks, levels, n_trees, psi, 0.0)
    scored = x.select(model.score_column(spark, F.col(value_col)).alias("score"))
    # scores take at most len(breaks) + 1 values: count per value, then the exact
    # linearly interpolated percentile from the (model-sized) count table
    counts = scored.groupBy("score").count().toPandas().sort_values("score")
    model.offset = exact_percentile(counts["score"].to_numpy(), counts["count"].to_numpy(), contamination)
    return model


def exact_percentile(values: np.ndarray, counts: np.ndarray, q: float) -> float:
    """Percentile with linear interpolation (numpy's default) of a sorted value/count table."""
    n = int(counts.sum())
    pos = q * (n - 1)
    lo, hi = int(math.floor(pos)), int(math.ceil(pos))
    cum = np.cumsum(counts)
    v_lo = float(values[np.searchsorted(cum, lo + 1)])
    v_hi = float(values[np.searchsorted(cum, hi + 1)])
    return v_lo + (v_hi - v_lo) * (pos - lo)


def score_anomalies(model: IsolationForestModel, df: DataFrame, value_col: str = "amount") -> DataFrame:
    """Expense rows with their ``score`` and ``anomaly`` flag."""
    spark = df.sparkSession
    e = df.filter((F.col("t_type") == EXPENSE) & F.col(value_col).isNotNull())
    s = e.withColumn("score", model.score_column(spark, F.col(value_col)))
    return s.withColumn("anomaly", F.col("score") < F.lit(model.offset))


def detect_anomalies(model: IsolationForestModel, df: DataFrame, value_col: str = "amount") -> DataFrame:
    """H6: the expense rows flagged as anomalies."""
    return score_anomalies(model, df, value_col).filter("anomaly").drop("anomaly")


def anomaly_messages(anomalies: DataFrame) -> DataFrame:
    """H7: ``On <date>, unusual spending detected: $<amount> in <category>.`` per flagged row."""
    from tallyspark.plans.report import MSG_ANOMALY
    head, rest = MSG_ANOMALY.split("{date}")
    mid, rest = rest.split("{amount}")
    mid2, tail = rest.split("{category}")
    msg = F.concat(F.lit(head), F.date_format("tx_date", "yyyy-MM-dd"), F.lit(mid),
                   F.col("amount").cast("decimal(18,2)").cast("string"), F.lit(mid2),
                   F.coalesce(F.col("category"), F.lit("None")), F.lit(tail))
    return anomalies.select("tx_id", "user_id", msg.alias("message"))
