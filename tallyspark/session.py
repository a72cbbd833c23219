"""Session construction and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

# Settings every tallyspark job relies on. ANSI mode stays on (Spark 4
# default): bad input is handled with try_* functions, never by silent casts.
SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "tallyspark") -> SparkSession:
    """Get or create a session with the settings above.

    On a cluster ``master`` stays None and the launcher's settings win; in
    tests pass ``local[N]``.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
        builder = builder.config("spark.driver.memory", os.environ.get("TALLY_DRIVER_MEMORY", "16g"))
    for k, v in SESSION_CONF.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and materialised tables.

    Read from ``spark.checkpoint.dir``.  A session without one gets a fresh
    scratch folder only where driver and executors are one process (``local``
    masters); on a cluster, where each worker has its own disk, it is an error.
    """
    sc = spark.sparkContext
    d = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not d:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir is not set: a folder shared by all workers is needed")
        d = tempfile.mkdtemp(prefix="tallyspark-ckpt-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(d)
    return d


def ship_package(spark: SparkSession) -> None:
    """Send this package to every Python worker, once per Spark application.

    Python functions are pickled by reference to their module, so a worker has
    to be able to import it; the zip travels through Spark's own file server
    and a driver-local temporary file is enough.
    """
    sc = spark.sparkContext
    if getattr(sc, "_tallyspark_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="tallyspark-pkg-"), "tallyspark_pkg.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, files in os.walk(root):
            for f in sorted(files):
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.join("tallyspark", os.path.relpath(full, root)))
    sc.addPyFile(path)
    sc._tallyspark_shipped = True
