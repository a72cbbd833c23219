"""The stored ledger as a versioned table: repeat-safe appends, real erasure, whole snapshots.

Layout below one root folder of any Hadoop file system::

    data/commit=<id>/tx_month=<yyyy-MM>/part-*.parquet     rows, written once, never changed
    manifest/<id>/part-*.parquet                           one row per live file of a version
    versions/<number>.json                                 pointer: version, manifest, batch, operation

A version becomes visible with one rename of its pointer file that fails if the
number is taken, so a reader sees the version before or the one after, never half of a
change, and of two writers at once one commits and the other starts again on top.
Files left by a writer that died belong to no manifest and are never read.

* ``append`` records the caller's batch id; a batch already committed changes nothing.
* ``erase`` finds the files that hold the users' rows (by the user range in the manifest,
  then by a scan of the user column alone), rewrites only those without the rows, each
  month's rows where they are read (no shuffle, no sort; a file keeps its order), and
  drops files and months that end up empty.
* ``read`` takes the files of one version; filters on ``tx_month`` prune them.
* ``vacuum`` deletes data files that only dropped versions refer to: after it, erased
  rows are gone from the disk too.

The driver handles file names and version numbers, never rows.

Defined cases: an empty append commits a version without new files; null dates are kept
(their month is null); erasing nobody, or users without rows, commits nothing; null user
ids are never erased; extra columns of an appended frame are ignored, missing ones are null.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.functions.columns import month_label
from tallyspark.schema import LEDGER_SCHEMA
from tallyspark.sources.versions import VersionConflict, VersionFiles

DATA_SCHEMA = T.StructType([*(T.StructField(f.name, f.dataType) for f in LEDGER_SCHEMA.fields),
                            T.StructField("tx_month", T.StringType())])
MANIFEST = "path string, tx_month string, n_rows long, low_user long, high_user long"
MAX_RECORDS = 2_000_000     # rows of one file: what an erasure of one row rewrites at most
MAX_BROADCAST = 1_000_000   # users of one erasure that are sent to every task (16 bytes each); more are shuffled
OPEN_WRITERS = "spark.sql.maxConcurrentOutputFileWriters"


def _data_path():
    """The path of a row's data file, counted from the root."""
    return F.expr("substring(_metadata.file_path, locate('/data/commit=', _metadata.file_path) + 1)")


class VersionedLedger:
    """A ledger of immutable files and numbered snapshots below ``root``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.files = VersionFiles(spark, root)

    def version(self) -> int:
        """The current version (0: nothing published)."""
        return self.files.current()

    def history(self) -> DataFrame:
        """(version, operation, batch, n_new, n_dropped): one row per published version."""
        return self.files.table("version long, operation string, batch string, n_new long, n_dropped long")

    # ------------------------------------------------------------ reading
    def manifest(self, version: int | None = None) -> DataFrame:
        """(path, tx_month, n_rows, low_user, high_user) of the files of a version; paths count from the root."""
        name = self.files.pointer(self.version() if version is None else version).get("manifest")
        if name is None:
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).parquet(f"{self.root}/manifest/{name}")

    def _load(self, paths: list[str]) -> DataFrame:
        if not paths:
            return self.spark.createDataFrame([], DATA_SCHEMA)
        return self.spark.read.schema(DATA_SCHEMA).option("basePath", f"{self.root}/data") \
            .parquet(*[f"{self.root}/{p}" for p in paths])

    def read(self, version: int | None = None, with_month: bool = False) -> DataFrame:
        """The rows of one version (default: the current one)."""
        paths = sorted(r["path"] for r in self.manifest(version).select("path").collect())
        df = self._load(paths).select(*DATA_SCHEMA.names)
        return df if with_month else df.drop("tx_month")

    # ------------------------------------------------------------ writing
    def _write(self, rows: DataFrame) -> list[str]:
        """Write rows as a new commit folder; returns its files (from the root)."""
        rows = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in LEDGER_SCHEMA.fields]) \
            .withColumn("tx_month", month_label("tx_date"))
        return self._save(rows.hint("rebalance", "tx_month").sortWithinPartitions("tx_month", "user_id", "tx_date"))

    def _save(self, rows: DataFrame) -> list[str]:
        commit = f"data/commit={uuid.uuid4().hex[:16]}"
        rows.write.option("maxRecordsPerFile", MAX_RECORDS).partitionBy("tx_month").parquet(f"{self.root}/{commit}")
        return self.files.files(commit)

    def _rewrite(self, rows: DataFrame) -> list[str]:
        """Write rows read from data files as they come: a task has few months, and one open file for each of them."""
        before = self.spark.conf.get(OPEN_WRITERS)
        self.spark.conf.set(OPEN_WRITERS, 100)      # further months of a task are sorted
        try:
            return self._save(rows)
        finally:
            self.spark.conf.set(OPEN_WRITERS, before)

    def _describe(self, paths: list[str]) -> DataFrame:
        """Manifest rows of data files: a scan of the user column alone."""
        if not paths:
            return self.spark.createDataFrame([], MANIFEST)
        rows = self._load(paths).select(_data_path().alias("path"), "tx_month", "user_id")
        return rows.groupBy("path", "tx_month").agg(F.count(F.lit(1)).alias("n_rows"), F.min("user_id").alias("low_user"),
                                                    F.max("user_id").alias("high_user"))

    def _commit(self, base: int, kept: DataFrame, new: DataFrame, operation: str, batch: str | None, n_dropped: int) -> int:
        name = uuid.uuid4().hex[:16]
        kept.unionByName(new).coalesce(8).write.parquet(f"{self.root}/manifest/{name}")
        self.files.publish(base + 1, {"version": base + 1, "manifest": name, "operation": operation, "batch": batch,
                                      "n_new": new.count(), "n_dropped": n_dropped})
        return base + 1

    def has_batch(self, batch: str) -> bool:
        return not self.history().filter(F.col("batch") == batch).isEmpty()

    def append(self, rows: DataFrame, batch: str) -> int:
        """Add rows under a batch id; a batch that was committed before changes nothing.  Returns the version."""
        missing = [f for f in LEDGER_SCHEMA.fields if f.name not in rows.columns]
        if missing:
            rows = rows.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in missing])
        if self.has_batch(batch):
            return self.version()
        new = self._describe(self._write(rows))
        while True:
            base = self.version()
            try:
                return self._commit(base, self.manifest(base), new, "append", batch, 0)
            except VersionConflict:         # somebody else came first: look again, then add to the newer version
                if self.has_batch(batch):
                    return self.version()

    def erase(self, users: DataFrame, batch: str | None = None) -> int:
        """Remove all rows of the users (column user_id).  Returns the version, the old one if nothing had to go."""
        gone = users.select(F.col("user_id").cast("long").alias("user_id")).filter("user_id is not null").distinct()
        while True:
            base = self.version()
            files = self.manifest(base)
            low, high, n_gone = gone.agg(F.min("user_id"), F.max("user_id"), F.count("user_id")).first()
            few = n_gone <= MAX_BROADCAST
            out = F.broadcast(gone) if few else gone
            near = files.filter((F.col("low_user") <= F.lit(high)) & (F.col("high_user") >= F.lit(low)))
            near_paths = [r["path"] for r in near.select("path").collect()]
            touched = []
            if near_paths:
                held = self._load(near_paths).select(_data_path().alias("path"), "user_id").join(out, "user_id", "left_semi")
                touched = sorted(r["path"] for r in held.select("path").distinct().collect())
            if not touched:
                return base
            left = self._load(touched).join(out, "user_id", "left_anti")
            new_files = self._rewrite(left.select(*DATA_SCHEMA.names)) if few else self._write(left)
            dropped = self.spark.createDataFrame([(p,) for p in touched], "path string")
            kept = files.join(dropped, "path", "left_anti")
            try:
                return self._commit(base, kept, self._describe(new_files), "erase", batch, len(touched))
            except VersionConflict:         # the newer version may hold more of their rows
                continue

    def vacuum(self, keep: int = 1) -> int:
        """Delete data files and manifests that only versions before the last ``keep`` refer to; returns files deleted.

        Run it when no reader uses an older version and no writer is at work: files of
        uncommitted writers are deleted as well.
        """
        live: set[str] = set()
        manifests = set()
        for v in self.files.numbers()[-max(1, keep):]:
            live |= {r["path"] for r in self.manifest(v).select("path").collect()}
            manifests.add(self.files.pointer(v)["manifest"])
        n = sum(self.files.delete(p) for p in self.files.files("data") if p not in live)
        for name in {p.split("/")[1] for p in self.files.files("manifest")} - manifests:
            self.files.delete(f"manifest/{name}")
        return n
