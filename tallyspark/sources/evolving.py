"""A table whose columns change while its files stay (A10).

    <root>/data/written=<schema number>/part-*.parquet      rows, written under the schema of that number
    <root>/versions/<n>.json                                schema n: its columns, their physical names and defaults

Every change of columns publishes a new schema number; files keep the number they were written under.  Reading
puts old and new files into one frame by name: a column that was added after a file was written has its
default there (and only there: a null in a newer file stays null), a dropped column is not shown, and nothing is
rewritten.  A column that is dropped and added again is a new one: its old values do not come back.

Defined cases: an appended frame may lack columns (null) and have others (ignored); a table without rows gives
an empty frame with the current columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.sources.versions import VersionFiles

WRITTEN = "written"


class EvolvingTable:
    """Rows and schema history below ``root``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.files = spark, root.rstrip("/"), VersionFiles(spark, root)

    def create(self, columns: dict[str, str]) -> int:
        """Publish the first schema (name to type); returns its number."""
        self.files.publish(1, {"columns": [{"name": c, "type": t, "physical": c, "since": 1, "default": None}
                                           for c, t in columns.items()]})
        return 1

    def columns(self, number: int | None = None) -> list[dict]:
        return self.files.pointer(self.files.current() if number is None else number).get("columns", [])

    def _change(self, columns: list[dict], base: int) -> int:
        self.files.publish(base + 1, {"columns": columns})
        return base + 1

    def add_column(self, name: str, kind: str, default: str | None = None) -> int:
        """A new column; rows written before have ``default`` (text, cast to the type)."""
        base = self.files.current()
        now = self.columns(base)
        if any(c["name"].lower() == name.lower() for c in now):
            raise ValueError(f"column {name} exists")
        new = {"name": name, "type": kind, "physical": f"{name}__{base + 1}", "since": base + 1, "default": default}
        return self._change([*now, new], base)

    def drop_column(self, name: str) -> int:
        base = self.files.current()
        left = [c for c in self.columns(base) if c["name"] != name]
        if len(left) == len(self.columns(base)):
            raise ValueError(f"no column {name}")
        return self._change(left, base)

    def append(self, rows: DataFrame) -> None:
        """Write rows under the current schema, by name."""
        number = self.files.current()
        cols = [(F.col(f"`{c['name']}`") if c["name"] in rows.columns else F.lit(None)).cast(c["type"]).alias(c["physical"])
                for c in self.columns(number)]
        rows.select(*cols).write.mode("append").parquet(f"{self.root}/data/{WRITTEN}={number}")

    def read(self, number: int | None = None) -> DataFrame:
        """All rows under the current (or an earlier) schema; filters and column choice reach the files."""
        columns = self.columns(number)
        physical = T.StructType([T.StructField(c["physical"], T._parse_datatype_string(c["type"])) for c in columns]
                                + [T.StructField(WRITTEN, T.IntegerType())])
        if not self.files.fs.exists(self.files.path("data")):
            rows = self.spark.createDataFrame([], physical)
        else:
            rows = self.spark.read.schema(physical).parquet(f"{self.root}/data")
        return rows.select(*[self._value(c).alias(c["name"]) for c in columns])

    @staticmethod
    def _value(c: dict) -> F.Column:
        value = F.col(f"`{c['physical']}`")
        if c["since"] == 1 or c["default"] is None:
            return value
        return F.when(F.col(WRITTEN) < c["since"], F.lit(c["default"]).cast(c["type"])).otherwise(value)
