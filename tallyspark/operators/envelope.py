"""Field encryption with wrapped data keys.

Values are encrypted with data keys (AES-GCM, Spark's built-in functions).  A data key is kept only
wrapped by a master key; the master keys come from configuration, by default the file that
``spark.tallyspark.masterKeyFile`` names (JSON: master id to base64 key), which is read by the driver alone::

    <root>/versions/<n>.json     key_id, master_id, wrapped (base64): the n-th key record

Every encrypted row carries the id of its data key.  ``rotate`` makes a new data key for the rows to come
and leaves the old rows as they are; ``rewrap`` puts the data keys under another master key and
touches no rows at all.  Keys reach the executors as the rows of a small joined table: no plan string,
and so no explain output or event log, holds one.

Defined cases: null values stay null; rows whose key id is unknown or null, and values that are no
cipher text of their key, decrypt to null; amounts are encrypted in their text form.
"""

from __future__ import annotations

import base64
import json
import os
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.functions.columns import keys, ratio
from tallyspark.sources.versions import VersionConflict, VersionFiles

MASTER_KEY_FILE = "spark.tallyspark.masterKeyFile"
KEY_BYTES, NONCE_BYTES, TAG_BITS = 32, 12, 128
MAX_KEYS = 10_000           # data keys of one ring; they are joined as a broadcast table of 50 bytes a row


def master_keys(spark: SparkSession) -> dict[str, bytes]:
    """Master keys by id, from the file that the configuration names."""
    path = spark.conf.get(MASTER_KEY_FILE, None)
    if not path:
        raise RuntimeError(f"{MASTER_KEY_FILE} is not set: a file of master keys is needed")
    with open(path, encoding="utf-8") as f:
        return {k: base64.b64decode(v) for k, v in json.load(f).items()}


class KeyRing:
    """Data keys below ``root``, wrapped by the given master keys (the last one wraps new keys)."""

    def __init__(self, spark: SparkSession, root: str, masters: Mapping[str, bytes] | None = None):
        self.spark, self.files = spark, VersionFiles(spark, root)
        self._masters = dict(masters if masters is not None else master_keys(spark))

    # ---- wrapping: in the driver's JVM, never in a query
    def _cipher(self, mode: str, master: bytes, nonce: bytes, value: bytes) -> bytes:
        jvm = self.spark._jvm
        cipher = jvm.javax.crypto.Cipher.getInstance("AES/GCM/NoPadding")
        key = jvm.javax.crypto.spec.SecretKeySpec(bytearray(master), "AES")
        cipher.init(getattr(jvm.javax.crypto.Cipher, mode), key, jvm.javax.crypto.spec.GCMParameterSpec(TAG_BITS, bytearray(nonce)))
        return bytes(cipher.doFinal(bytearray(value)))

    def _wrap(self, master_id: str, key: bytes) -> str:
        nonce = os.urandom(NONCE_BYTES)
        return base64.b64encode(nonce + self._cipher("ENCRYPT_MODE", self._masters[master_id], nonce, key)).decode()

    def _unwrap(self, record: dict) -> bytes:
        raw = base64.b64decode(record["wrapped"])
        return self._cipher("DECRYPT_MODE", self._masters[record["master_id"]], raw[:NONCE_BYTES], raw[NONCE_BYTES:])

    # ---- records
    def _records(self) -> dict[int, dict]:
        """The newest record of every key id."""
        return {r["key_id"]: r for r in map(self.files.pointer, self.files.numbers())}

    def _add(self, key_id: int, master_id: str, key: bytes) -> None:
        while True:
            try:
                self.files.publish(self.files.current() + 1, {"key_id": key_id, "master_id": master_id, "wrapped": self._wrap(master_id, key)})
                return
            except VersionConflict:
                continue

    def current(self) -> int:
        """The id of the newest data key; the first call makes it."""
        return max(self._records(), default=0) or self.rotate()

    def rotate(self) -> int:
        """A new data key for the rows to come; returns its id."""
        key_id = max(self._records(), default=0) + 1
        if key_id > MAX_KEYS:
            raise ValueError(f"more than {MAX_KEYS} data keys in one ring")
        self._add(key_id, list(self._masters)[-1], os.urandom(KEY_BYTES))
        return key_id

    def rewrap(self) -> int:
        """Put every data key under the last master key; returns how many were moved.  No row is touched."""
        target, moved = list(self._masters)[-1], 0
        for key_id, record in self._records().items():
            if record["master_id"] != target:
                self._add(key_id, target, self._unwrap(record))
                moved += 1
        return moved

    def table(self) -> DataFrame:
        """(key_id, data_key): the unwrapped keys as rows of an RDD, which plans name without its content."""
        rows = [(i, bytearray(self._unwrap(r))) for i, r in self._records().items()]
        return self.spark.createDataFrame(self.spark.sparkContext.parallelize(rows, 1), "key_id int, data_key binary")

    # ---- rows
    def encrypt(self, df: DataFrame, fields: Sequence[str] = ("note", "amount")) -> DataFrame:
        """``df`` with the fields encrypted (base64 text) by the current data key, and the column key_id."""
        fresh = F.lit(self.current()).alias("key_id")
        joined = df.drop("key_id").select("*", fresh).join(F.broadcast(self.table()), "key_id")
        return joined.select(*[self._sealed(c) if c in fields else F.col(c) for c in df.columns if c != "key_id"], "key_id")

    @staticmethod
    def _sealed(c: str) -> F.Column:
        return F.base64(F.aes_encrypt(F.col(c).cast("string").cast("binary"), F.col("data_key"))).alias(c)

    def decrypt(self, df: DataFrame, fields: Sequence[str] = ("note", "amount")) -> DataFrame:
        """The fields as text again; the column key_id stays."""
        joined = df.join(F.broadcast(self.table()), "key_id", "left")
        return joined.select(*[self._opened(c).alias(c) if c in fields else F.col(c) for c in df.columns])

    @staticmethod
    def _opened(c: str) -> F.Column:
        return F.try_aes_decrypt(F.try_to_binary(F.col(c), F.lit("base64")), F.col("data_key")).cast("string")

    def coverage(self, df: DataFrame, field: str = "note", by: Sequence[str] | None = None) -> DataFrame:
        """I8: share of the non-null values of a field that decrypt with their row's key, per key column."""
        # nulls are left out by the counts: a filter on the field would be pushed below its encryption and encrypt it twice
        joined = df.join(F.broadcast(self.table()), "key_id", "left")
        opened = F.sum(F.when(self._opened(field).isNotNull(), 1).otherwise(0))
        n = F.count(field)
        return joined.groupBy(*keys(by)).agg(ratio(opened, n).alias("encrypted_share"), n.alias("n")).filter("n > 0")
