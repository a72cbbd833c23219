"""Helpers shared by the operators: shared folder, table reading, folds, and word codes in numpy.

Texts are turned into arrays of word codes without one Python object per
word: a batch of texts becomes one code-point array, words are runs of a
character class, and a word's code is a 64-bit polynomial hash of its code
points, mixed.  Everything runs inside Spark tasks on bounded batches.
"""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.session import checkpoint_dir, ship_package

BATCH_CHARS = 100_000       # code points handled at once in a task (a longer text is one batch by itself)
FOLDS = 5                   # crc32(id as text) mod FOLDS = 0 is held out


# ---------------------------------------------------------------- Spark side
def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared folder, removed when the driver's Python ends."""
    ship_package(spark)
    path = f"{checkpoint_dir(spark).rstrip('/')}/tally-llm/{name}-{uuid.uuid4().hex[:12]}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)
    except Exception:  # the session may be gone already; its owner clears the shared folder then
        pass


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fold(key: Column) -> Column:
    """crc32 of the key as text, modulo FOLDS (null for a null key)."""
    return F.crc32(key.cast("string").cast("binary")) % FOLDS


def held_out(key: Column) -> Column:
    return F.coalesce(fold(key) == 0, F.lit(False))


# ---------------------------------------------------------------- numpy side
_K = np.uint64(0x9E3779B97F4A7C15)
_P = 0xD6E8FEB86659FD93                 # odd, so it has an inverse modulo 2**64
_P_INV = pow(_P, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}
_ALNUM: list[np.ndarray] = []


def _powers(base: int, n: int) -> np.ndarray:
    p = _POWERS.get(base)
    if p is None or len(p) < n:
        a = np.full(max(n, 1 << 16), np.uint64(base), dtype=np.uint64)
        a[0] = 1
        p = _POWERS[base] = np.multiply.accumulate(a)
    return p[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (xor-shift and multiply)."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x81DADEF4BC2DD44D)
    h ^= h >> np.uint64(33)
    return h


def alnum_table() -> np.ndarray:
    """For every code point: is it a letter or a digit (built once per worker)."""
    if not _ALNUM:
        _ALNUM.append(np.fromiter((chr(i).isalnum() for i in range(0x110000)), dtype=bool, count=0x110000))
    return _ALNUM[0]


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, a newline after each; offsets of the texts (n + 1)."""
    raw = ("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass")
    off = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=off[1:])
    return np.frombuffer(raw, dtype=np.uint32), off


def word_codes(texts: list[str], kind: str) -> tuple[np.ndarray, np.ndarray]:
    """64-bit codes of the words of all texts, and the word offsets of the texts (n + 1).

    kind "space": words are runs of anything but U+0020 and U+0009-U+000D,
    A-Z lower-cased; kind "alnum": runs of letters and digits, lower-cased.
    """
    if kind == "alnum":
        texts = [t.lower() for t in texts]
    cp, off = code_points(texts)
    if kind == "alnum":
        inside = alnum_table()[cp]
        low = cp
    else:
        inside = (cp != 32) & ((cp < 9) | (cp > 13))
        low = cp + (((cp >= 65) & (cp <= 90)).astype(np.uint32) << np.uint32(5))
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1      # the last code point is a newline, outside
    if inside[0]:
        edge = np.concatenate([[0], edge])
    starts, ends = edge[0::2], edge[1::2]
    v = (low.astype(np.uint64) + np.uint64(1)) * _K
    v ^= v >> np.uint64(29)
    v *= _powers(_P, len(v))
    total = np.empty(len(v) + 1, dtype=np.uint64)
    total[0] = 0
    np.cumsum(v, out=total[1:])
    inv = _powers(_P_INV, len(v))
    codes = (total[ends] - total[starts]) * inv[starts]
    codes = mix(codes + (ends - starts).astype(np.uint64) * _K)
    return codes, np.searchsorted(starts, off)


def text_batches(ids: list, texts: list, limit: int = BATCH_CHARS) -> Iterator[tuple[list, list[str]]]:
    """Groups of (ids, texts) of at most ``limit`` code points, or one longer text; null text is empty."""
    a, b, n = [], [], 0
    for i, t in zip(ids, texts):
        t = t or ""
        if a and n + len(t) > limit:
            yield a, b
            a, b, n = [], [], 0
        a.append(i)
        b.append(t)
        n += len(t) + 1
    if a:
        yield a, b


def arrow_texts(batches: Iterator[pa.RecordBatch], limit: int = BATCH_CHARS) -> Iterator[tuple[list, list[str]]]:
    """Bounded (ids, texts) groups from Arrow batches of two columns (id, text)."""
    for b in batches:
        yield from text_batches(b.column(0).to_pylist(), b.column(1).to_pylist(), limit)


def add_columns(df: DataFrame, text_col: str, make, fields: dict[str, str], rows: int = 2000) -> DataFrame:
    """``df`` with further columns computed from its text column, ``rows`` rows at a time; other columns pass through.

    ``make`` turns a list of texts (null as "") into one Arrow array per new column.
    """
    at = df.columns.index(text_col)

    def run(batches):
        for b in batches:
            for s in range(0, b.num_rows, rows):
                piece = b.slice(s, rows)
                new = make([t or "" for t in piece.column(at).to_pylist()])
                yield pa.RecordBatch.from_arrays([*piece.columns, *new], names=[*piece.schema.names, *fields])

    schema = df.schema
    for name, kind in fields.items():
        schema = T.StructType([*schema.fields, T.StructField(name, T._parse_datatype_string(kind))])
    return df.mapInArrow(run, schema)
