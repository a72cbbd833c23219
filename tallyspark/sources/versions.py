"""Numbered versions of anything stored below a folder: pointer files that one writer wins.

``versions/<number>.json`` holds a small JSON object.  It is written under a temporary
name and renamed in one step that fails if the number is taken, so a reader sees the whole
object or none, and of two writers at once one commits.  Works on every Hadoop file system
whose rename is atomic.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


class VersionConflict(RuntimeError):
    """Another writer has published the same version number."""


class VersionFiles:
    """The pointer files below ``root``; versions count from 1, and 0 means that nothing is published."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.hadoop_path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self.hadoop_path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, *parts: str):
        return self.fs.makeQualified(self.hadoop_path("/".join([self.root, *parts])))

    def numbers(self) -> list[int]:
        """Published numbers, ascending."""
        folder = self.path("versions")
        if not self.fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self.fs.listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def current(self) -> int:
        return (self.numbers() or [0])[-1]

    def pointer(self, number: int) -> dict:
        """The object of a published version, {} for version 0."""
        if number == 0:
            return {}
        return json.loads(self.spark.read.text(f"{self.root}/versions/{number:012d}.json", wholetext=True).first()[0])

    def table(self, schema: str) -> DataFrame:
        """All published objects as rows."""
        if not self.numbers():
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).json(f"{self.root}/versions/*.json")

    def publish(self, number: int, value: dict) -> None:
        """Publish ``value`` as version ``number``; raises VersionConflict if that number exists."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        temporary = self.path("versions", f".{uuid.uuid4().hex}.tmp")
        out = self.fs.create(temporary, False)
        out.write(bytearray(json.dumps(value).encode()))
        out.close()
        option = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        options = self.spark.sparkContext._gateway.new_array(option, 1)
        options[0] = option.NONE
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(temporary.toUri(), conf) \
                .rename(temporary, self.path("versions", f"{number:012d}.json"), options)
        except Py4JJavaError as e:
            self.fs.delete(temporary, False)
            if "FileAlreadyExists" in str(e.java_exception):
                raise VersionConflict(str(number)) from e
            raise

    def files(self, folder: str, suffix: str = ".parquet") -> list[str]:
        """Data files below a folder, counted from the root."""
        at = self.path(folder)
        if not self.fs.exists(at):
            return []
        base, found, it = self.path("").toString().rstrip("/") + "/", [], self.fs.listFiles(at, True)
        while it.hasNext():
            p = it.next().getPath()
            if p.getName().endswith(suffix):
                found.append(p.toString().removeprefix(base))
        return found

    def delete(self, name: str) -> bool:
        return bool(self.fs.delete(self.path(name), True))
