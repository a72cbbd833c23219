"""Duplicate index (J2 with D4): a stream's repeats removed without reading the stored history.

Stored rows lie in files by batch, month and key bucket; every file has one index row
with a Bloom filter over its keys::

    rows/batch=<n>/tx_month=<yyyy-MM>/bucket=<k>/part-*.parquet
    index/batch=<n>/tx_month=<yyyy-MM>/part-*.parquet       path, bucket, n, bits
    log/batch=<n>/                                           files stored, looked at, opened

A micro-batch reads the index rows of its own months only, tests its keys against the filters
of its own buckets and opens just the files whose filter lets one of its keys through.  Then
its rows, copies folded first in the tasks that read them, and the stored rows of those files are dealt
once by month and bucket; in there the exact comparison (D4) drops repeats of stored rows and of
each other and the rest is written.  A key opens a file that does not hold it with probability
below ``FALSE_HITS``, so what a batch opens follows the batch and its repeats, not the
history (index rows of its months are still looked at).

Batch ``n`` writes folders named after itself with overwrite and compares only with
batches below ``n``: a batch replayed after a failure gives the same output.

Defined cases: a row that holds null in the user, type, amount, date or category equals no
other row across batches (SQL equality) but repeats within a batch fold into one, as in ``drop_known``; the
note is compared null-safely; a micro-batch is read twice, for its keys and for its rows; rows without a date go to their own month folder; an empty
batch writes empty folders.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.functions.columns import month_label
from tallyspark.operators.relate import DUP_COLS

BUCKETS = 64
FALSE_HITS = 1e-6           # of a filter for a key that its file does not hold (a batch asks with thousands of keys)
BITS_PER_KEY, HASHES = 32, 16
FILE_ROWS = 500_000         # rows of one file, so that a filter stays near 2 MB
NO_MONTH = "none"

INDEX = "path string, bucket int, n long, bits binary"


def _places(keys: np.ndarray, size: int) -> np.ndarray:
    """(keys, HASHES) bit places in a filter of ``size`` bits: double hashing of a 64-bit key."""
    k = keys.astype(np.int64).view(np.uint64)
    low, high = k & np.uint64(0xFFFFFFFF), (k >> np.uint64(32)) | np.uint64(1)
    return ((low[:, None] + np.arange(HASHES, dtype=np.uint64) * high[:, None]) % np.uint64(size)).astype(np.int64)


def make_filter(keys: np.ndarray) -> bytes:
    size = max(64, -(-len(keys) * BITS_PER_KEY // 8) * 8)
    bits = np.zeros(size, dtype=np.uint8)
    bits[_places(keys, size).ravel()] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def may_hold(raw: bytes, keys: np.ndarray) -> np.ndarray:
    """For every key: may the file of this filter hold it?"""
    bits = np.frombuffer(raw, dtype=np.uint8)
    at = _places(keys, len(bits) * 8)
    return ((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=1)


def _keyed(rows: DataFrame, buckets: int) -> DataFrame:
    """Rows with their key's hash, bucket and month."""
    key = F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in DUP_COLS])
    return rows.withColumn("key", key).withColumn("bucket", F.pmod(F.col("key"), F.lit(buckets)).cast("int")) \
        .withColumn("tx_month", F.coalesce(month_label("tx_date"), F.lit(NO_MONTH)))


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    row = (pdf["path"].iloc[0], int(pdf["bucket"].iloc[0]), len(pdf), make_filter(pdf["key"].to_numpy()), pdf["tx_month"].iloc[0])
    return pd.DataFrame([row], columns=["path", "bucket", "n", "bits", "tx_month"], dtype=object)


def _probe(keys: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
    """Files of one month and bucket that may hold a key of the batch."""
    k = keys["key"].to_numpy()
    found = [p for p, raw in zip(index["path"], index["bits"]) if len(k) and may_hold(raw, k).any()]
    return pd.DataFrame({"path": found}, dtype=object)


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Copies inside an Arrow batch are folded, so that a group that holds a large share of the rows sends a few."""
    for b in batches:
        t = pa.Table.from_batches([b])
        first = t.select(DUP_COLS).append_column("at", pa.array(np.arange(b.num_rows))).group_by(DUP_COLS).aggregate([("at", "min")])["at_min"]
        yield from (t if len(first) == b.num_rows else t.take(first)).combine_chunks().to_batches()


def _new_rows(rows: DataFrame, seen: DataFrame | None, buckets: int) -> DataFrame:
    """D4 after one shuffle by month and bucket: ``rows`` that repeat neither each other nor a row of ``seen``."""
    rest = [c for c in rows.columns if c not in DUP_COLS]
    both = rows.select(*DUP_COLS, F.struct(*rest).alias("rest") if rest else F.lit(True).alias("rest"))
    if seen is not None:        # a row with null in another column than the note equals no stored row
        known = seen.select(*DUP_COLS).dropna(subset=[c for c in DUP_COLS if c != "note"])
        both = both.unionByName(known.select("*", F.lit(None).cast(both.schema["rest"].dataType).alias("rest")))
    dealt = _keyed(both.withColumn("stored", F.col("rest").isNull()), buckets).drop("key").repartition("tx_month", "bucket")
    one = dealt.groupBy(*DUP_COLS, "tx_month", "bucket").agg(F.max("stored").alias("stored"), F.first("rest", ignorenulls=True).alias("rest"))
    return one.filter(~F.col("stored")).select(*[F.col(f"rest.{c}") if c in rest else F.col(c) for c in rows.columns], "tx_month", "bucket")


class DedupeIndex:
    """Sink that stores only rows not stored before, with an index of what it holds, below ``path``."""

    def __init__(self, path: str, buckets: int = BUCKETS):
        self.path, self.buckets = path.rstrip("/"), buckets

    def _exists(self, spark: SparkSession, path: str) -> bool:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)

    def _batches(self, spark: SparkSession, batch_id: int) -> DataFrame | None:
        """Index rows of earlier batches."""
        if batch_id == 0 or not self._exists(spark, f"{self.path}/index"):
            return None
        df = spark.read.schema(f"{INDEX}, batch long, tx_month string").parquet(f"{self.path}/index")
        return df.filter(F.col("batch") < batch_id)

    def write(self, batch: DataFrame, batch_id: int) -> None:
        """``foreachBatch`` writer."""
        spark = batch.sparkSession
        columns = [c for c in batch.columns]
        keys = _keyed(batch, self.buckets).select("tx_month", "bucket", "key")
        index = self._batches(spark, batch_id)
        looked, opened = 0, []
        if index is not None:
            months = [r[0] for r in keys.select("tx_month").distinct().collect()]       # of one micro-batch
            index = index.filter(F.col("tx_month").isin(months))
            looked = index.count()
            probe = keys.groupBy("tx_month", "bucket").cogroup(index.select("tx_month", "bucket", "path", "bits").groupBy("tx_month", "bucket")) \
                .applyInPandas(lambda k, i: _probe(k, i), "path string")
            opened = sorted({r["path"] for r in probe.collect()})
        seen = None
        if opened:
            seen = spark.read.schema(batch.schema).option("basePath", f"{self.path}/rows") \
                .parquet(*[f"{self.path}/rows/{p}" for p in opened])
        # rows of a bucket go to one file per batch, larger ones to several
        _new_rows(batch.mapInArrow(_fold, batch.schema).select(*columns), seen, self.buckets).write.mode("overwrite") \
            .option("maxRecordsPerFile", FILE_ROWS).option("compression", "zstd") \
            .partitionBy("tx_month", "bucket").parquet(f"{self.path}/rows/batch={batch_id}")
        self._index(spark, batch_id, batch)
        spark.createDataFrame([(batch_id, looked, len(opened))], "batch long, looked long, opened long") \
            .coalesce(1).write.mode("overwrite").parquet(f"{self.path}/log/batch={batch_id}")

    def _index(self, spark: SparkSession, batch_id: int, batch: DataFrame) -> None:
        """One index row per file that the batch has written."""
        folder = f"{self.path}/rows/batch={batch_id}"
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in batch.schema.fields)
        rows = spark.read.schema(f"{schema}, tx_month string, bucket int").parquet(folder)
        name = F.expr("substring(_metadata.file_path, locate('/batch=', _metadata.file_path) + 1)")
        keyed = _keyed(rows.select(*batch.columns, name.alias("path"), F.col("bucket").alias("own")), self.buckets)
        keyed.select("path", "bucket", "key", "tx_month").groupBy("path").applyInPandas(_build, f"{INDEX}, tx_month string") \
            .write.mode("overwrite").partitionBy("tx_month").parquet(f"{self.path}/index/batch={batch_id}")

    def read(self, spark: SparkSession, schema) -> DataFrame:
        """The stored rows."""
        return spark.read.schema(schema).parquet(f"{self.path}/rows").select(*schema.fieldNames())

    def log(self, spark: SparkSession) -> DataFrame:
        """(batch, looked, opened): index rows looked at and files opened by every batch."""
        return spark.read.schema("batch long, looked long, opened long").parquet(f"{self.path}/log") \
            .select("batch", "looked", "opened")
