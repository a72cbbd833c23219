"""A folder of ledger CSV files whose headers differ (A1).

One scan finds every file's first line; files are grouped by header and each group is read with the
schema that its header names, so columns are matched by name whatever their order.  Rows
that do not fit their header, and files whose header cannot be used, go to a quarantine
frame with their file and reason instead of shifting columns or failing the read.
"""

from __future__ import annotations

import csv
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.schema import LEDGER_SCHEMA
from tallyspark.sources.files import LEDGER_ALIASES, _as_ledger

_CORRUPT = "_corrupt_row"
QUARANTINE = "path string, reason string, row string"


def file_headers(spark: SparkSession, path: str) -> DataFrame:
    """(path, header): the first line of every non-empty file below ``path``, found where its first block is read."""
    lines = spark.read.option("recursiveFileLookup", True).text(path) \
        .select(F.col("_metadata.file_path").alias("path"), "value", F.monotonically_increasing_id().alias("nth"),
                F.col("_metadata.file_block_start").alias("start"))
    return lines.filter("start = 0").groupBy("path").agg(F.min_by("value", "nth").alias("header"))


def header_columns(header: str) -> list[str]:
    """Column names of a header line: quotes, a byte-order mark, CR and surrounding blanks are dropped."""
    row = next(csv.reader([header.lstrip("﻿").rstrip("\r\n")]), [])
    return [c.strip().lower() for c in row]


def header_problem(columns: list[str]) -> str | None:
    known = set(LEDGER_SCHEMA.names) | set(LEDGER_ALIASES)
    named = [LEDGER_ALIASES.get(c, c) for c in columns]
    if len(set(named)) < len(named):
        return "repeated column in header"
    if "" in columns:
        return "unnamed column in header"
    if not set(columns) & known:
        return "no ledger column in header"
    return None


def read_ledger_folder(spark: SparkSession, path: str, user_id: int | None = None) -> tuple[DataFrame, DataFrame]:
    """A1: (ledger rows, quarantined rows) of all CSV files below ``path``, each read by its own header.

    Header names are compared without case.  Columns that the ledger does not know are
    ignored, missing ones are null (``user_id`` then comes from the argument; a row without
    an id column gets the hash of its content).  Quarantine rows are (path, reason, row): rows
    with more or fewer fields than their header, and the header of every file that repeats a column,
    leaves one unnamed or names no ledger column (its rows are not read).  Empty files and
    files with a header only give no rows.
    """
    groups: dict[tuple[str, ...], list[str]] = {}
    refused: list[tuple[str, str, str]] = []
    for r in file_headers(spark, path).orderBy("path").collect():        # one name and header per file, never rows
        columns = header_columns(r["header"] or "")
        problem = header_problem(columns)
        if problem:
            refused.append((r["path"], problem, r["header"]))
        else:
            groups.setdefault(tuple(columns), []).append(r["path"])
    ledger = spark.createDataFrame([], LEDGER_SCHEMA)
    bad = spark.createDataFrame(refused, QUARANTINE)
    for columns, paths in groups.items():
        schema = T.StructType([*(T.StructField(c, T.StringType()) for c in columns), T.StructField(_CORRUPT, T.StringType())])
        # every field of a row is parsed, also where few columns are asked for: else a short row would pass as whole
        rows = spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE") \
            .option("columnPruning", False).option("columnNameOfCorruptRecord", _CORRUPT).csv([unquote(p) for p in paths])
        # Spark refuses a query of the corrupt column alone, so nothing (an empty piece) of the first column goes along
        none = F.substring(F.coalesce(F.col(f"`{columns[0]}`"), F.lit("")), 1, 0)
        misfit = F.concat(F.col(_CORRUPT), none)
        ledger = ledger.unionByName(_as_ledger(rows.filter(misfit.isNull()).drop(_CORRUPT), user_id))
        bad = bad.unionByName(rows.filter(misfit.isNotNull())
                              .select(F.col("_metadata.file_path").alias("path"), F.lit("fields do not fit the header").alias("reason"),
                                      misfit.alias("row")))
    return ledger, bad
