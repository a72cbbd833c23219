"""Monthly totals over the insert stream, kept incrementally (J5 with C8).

The stored rollup has one row per (user, month), in files by month and user bucket::

    rollup/batch=<n>/tx_month=<yyyy-MM>/bucket=<k>/part-*.parquet     user_id, cents, n (amounts)
    live/batch=<n>/part-*.parquet                                     tx_month, bucket, at (batch that holds it)

A micro-batch is summed per (user, month) with map-side combine; only the (month, bucket)
groups it touches are read, merged and written again, into folders of its own; ``live``
then names, for every group, the batch whose files hold it.  Late rows of any age change
their month like others.  Batch ``n`` starts from ``live`` of the last batch below it and overwrites
its own folders, so a replayed batch gives the same rollup, and a reader, who takes
the newest ``live``, sees whole batches only.

Defined cases: as C8: rows without a date belong to no month; a month without any amount
is observed, with a null total; a null user is a key like any other; an empty batch
changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.functions.columns import month_label
from tallyspark.sources.versions import VersionFiles

BUCKETS = 16
ROLLUP = "user_id long, cents decimal(38,0), n long"
LIVE = "tx_month string, bucket int, at long"


class MonthlyTotals:
    """The rollup stored below ``path``."""

    def __init__(self, path: str, buckets: int = BUCKETS):
        self.path, self.buckets = path.rstrip("/"), buckets

    def _done(self, spark: SparkSession, below: int | None = None) -> int | None:
        """The newest finished batch (below a number)."""
        files = VersionFiles(spark, self.path)
        if not files.fs.exists(files.path("live")):
            return None
        names = [s.getPath() for s in files.fs.listStatus(files.path("live"))]
        found = [int(p.getName().removeprefix("batch=")) for p in names
                 if p.getName().startswith("batch=") and files.fs.exists(files.hadoop_path(p, "_SUCCESS"))]
        return max((b for b in found if below is None or b < below), default=None)

    def _live(self, spark: SparkSession, batch: int | None) -> DataFrame:
        if batch is None:
            return spark.createDataFrame([], LIVE)
        return spark.read.schema(LIVE).parquet(f"{self.path}/live/batch={batch}")

    def _rows(self, spark: SparkSession, groups: list) -> DataFrame:
        """Rollup rows of the given (month, bucket, batch) groups."""
        schema = f"{ROLLUP}, tx_month string, bucket int"
        if not groups:
            return spark.createDataFrame([], schema)
        at = [f"{self.path}/rollup/batch={g['at']}/tx_month={g['tx_month']}/bucket={g['bucket']}" for g in groups]
        return spark.read.schema(schema).option("basePath", f"{self.path}/rollup").parquet(*at) \
            .select("user_id", "cents", "n", "tx_month", "bucket")

    def write(self, batch: DataFrame, batch_id: int) -> None:
        """``foreachBatch`` writer."""
        spark = batch.sparkSession
        cents = F.coalesce((F.col("amount") * 100).cast("decimal(38,0)"), F.lit(0).cast("decimal(38,0)"))
        bucket = F.pmod(F.xxhash64("user_id"), F.lit(self.buckets)).cast("int").alias("bucket")
        delta = batch.filter("tx_date is not null") \
            .select("user_id", "amount", cents.alias("cents"), month_label("tx_date").alias("tx_month"), bucket) \
            .groupBy("user_id", "tx_month", "bucket") \
            .agg(F.sum("cents").cast("decimal(38,0)").alias("cents"), F.count("amount").alias("n")).persist()
        try:
            touched = delta.select("tx_month", "bucket").distinct()
            before = self._live(spark, self._done(spark, batch_id))
            old = before.join(touched, ["tx_month", "bucket"], "left_semi").collect()       # group names, not rows
            merged = self._rows(spark, old).unionByName(delta.select("user_id", "cents", "n", "tx_month", "bucket")) \
                .groupBy("user_id", "tx_month", "bucket") \
                .agg(F.sum("cents").cast("decimal(38,0)").alias("cents"), F.sum("n").alias("n"))
            merged.repartition("tx_month", "bucket").write.mode("overwrite").partitionBy("tx_month", "bucket") \
                .parquet(f"{self.path}/rollup/batch={batch_id}")
            live = before.join(touched, ["tx_month", "bucket"], "left_anti") \
                .unionByName(touched.withColumn("at", F.lit(batch_id).cast("long")))
            live.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/live/batch={batch_id}")
        finally:
            delta.unpersist()

    def read(self, spark: SparkSession) -> DataFrame:
        """(user_id, month, total): the rollup after the newest finished batch."""
        rows = self._rows(spark, self._live(spark, self._done(spark)).collect())
        total = (F.col("cents").cast("decimal(36,0)") * F.lit("0.01").cast("decimal(2,2)")).cast("decimal(38,2)")
        return rows.select("user_id", F.col("tx_month").alias("month"), F.when(F.col("n") > 0, total).alias("total"))
