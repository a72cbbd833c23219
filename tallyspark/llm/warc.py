"""WARC: a deterministic sharded writer and a reader.

Method
  * Payload digests are computed by Spark.  Of records with equal payloads (equal
    SHA-1 and length) of ``min_bytes`` or more, the one with the largest id is
    the response and the others become revisit records that refer to it; the
    group's largest id is an aggregate, joined back on the narrow (id, digest)
    table, so a payload shared by a third of all rows is one aggregate row.
  * Records are range-sorted by id; every task writes the files of its range
    and rolls to the next file once ``roll_bytes`` compressed bytes are
    reached.  Each record is its own gzip member with regenerated headers:
    record id (name-based UUID of the id), block and payload digests, lengths.
    Nothing depends on the clock, so the same input and settings give the same
    bytes, on retries as well.
  * A file is written under a temporary name in the shared folder and renamed when
    complete; a repeated task replaces a file by equal bytes.  The tasks'
    manifest rows (file, records, bytes, SHA-256) are written last, as one Spark
    table whose ``_SUCCESS`` commits the archive.  The reader opens only files
    the manifest lists, checks their digests, and streams them record by record.

Defined cases: null html is an empty payload; null url gives ``about:blank``; a null
id gives a response without page id and a digest-based record id; a repeated id
has a record per row (rows that repeat the response's id and payload are
responses too); an empty table gives an empty manifest; extra columns are
ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm.common import scratch_path

MIN_REVISIT_BYTES = 1000
ROLL_BYTES = 64 << 20
WARC_DATE = "2000-01-01T00:00:00Z"          # fixed, so archives are reproducible
_NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:tallyspark:page")
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"

MANIFEST = "file string, records long, bytes long, sha256 string"
RECORD = ("page_id long, url string, record_type string, payload binary, payload_bytes long, "
          "payload_digest string, refers_to long")


# ---------------------------------------------------------------- record format
def _sha1(b: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(b).digest()).decode("ascii")


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, str(page_id) if page_id is not None else 'none ' + digest)}>"


def _target(url: str | None) -> str:
    return quote(url, safe=":/?#[]@!$&'()*+,;=%-._~") if url else "about:blank"


def encode_record(page_id: int | None, url: str | None, payload: bytes, digest_hex: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record as a gzip member."""
    head = HTTP_HEAD % len(payload)
    block = head if refers_to is not None else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
             f"WARC-Record-ID: {record_id(page_id, digest_hex)}", f"WARC-Date: {WARC_DATE}",
             f"WARC-Target-URI: {_target(url)}",
             "WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(digest_hex)).decode("ascii"),
             f"WARC-Block-Digest: {_sha1(block)}"]
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                  f"WARC-Refers-To: {record_id(refers_to, digest_hex)}", f"X-Refers-To-Page-ID: {refers_to}"]
    lines += [f"X-Payload-Length: {len(payload)}", "Content-Type: application/http; msgtype=response",
              f"Content-Length: {len(block)}"]
    raw = "\r\n".join(lines).encode("utf-8") + b"\r\n\r\n" + block + b"\r\n\r\n"
    return gzip.compress(raw, compresslevel=4, mtime=0)


def read_records(stream):
    """Records of an uncompressed WARC stream, one at a time: (headers, block).  Raises on a broken record."""
    while True:
        line = stream.readline()
        if not line:
            return
        if line.strip() == b"":
            continue
        if not line.startswith(b"WARC/1."):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        head = {}
        while (line := stream.readline()).strip():
            k, _, v = line.decode("utf-8").partition(":")
            head[k.strip().lower()] = v.strip()
        n = int(head["content-length"])
        block = stream.read(n)
        if len(block) != n or _sha1(block) != head["warc-block-digest"]:
            raise ValueError(f"damaged record {head.get('warc-record-id')}")
        yield head, block


# ---------------------------------------------------------------- writing
@dataclass
class Archive:
    path: str

    def manifest(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest")


def _open(path: str):
    """The file system of the shared folder and the path in it."""
    if path.startswith("file:") or "://" not in path:
        return pafs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(path)


def _writer(root: str, roll_bytes: int):
    manifest = pa.schema([("file", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string())])

    def run(batches):
        system, base = _open(root)
        shard, task = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        system.create_dir(f"{base}/data", recursive=True)
        system.create_dir(f"{base}/tmp", recursive=True)
        done, out, seq, size, count, sha, tmp = [], None, 0, 0, 0, None, ""

        def close():
            out.close()
            name = f"shard-{shard:06d}-{seq:05d}.warc.gz"
            system.move(tmp, f"{base}/data/{name}")
            return name, count, size, sha.hexdigest()

        last, targets = None, {}        # of the current id: what its payloads refer to, by digest
        for b in batches:
            cols = [b.column(i).to_pylist() for i in range(b.num_columns)]
            for page_id, kind, url, html, digest, refers_to in zip(*cols):
                if page_id != last:
                    last, targets = page_id, {}
                if kind == 0:           # sorts before the page's records
                    targets[digest] = refers_to
                    continue
                ref = targets.get(digest)
                payload = (html or "").encode("utf-8")
                member = encode_record(page_id, url, payload, digest, ref)
                if out is None:
                    tmp = f"{base}/tmp/{shard:06d}-{seq:05d}-{task}-{uuid.uuid4().hex[:8]}"
                    out, size, count, sha = system.open_output_stream(tmp, compression=None), 0, 0, hashlib.sha256()
                out.write(member)
                sha.update(member)
                size, count = size + len(member), count + 1
                if size >= roll_bytes:
                    done.append(close())
                    out, seq = None, seq + 1
        if out is not None:
            done.append(close())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], schema=manifest)
    return run


def write_warc(pages: DataFrame, path: str | None = None, id_col: str = "page_id", url_col: str = "url",
               html_col: str = "html", min_bytes: int = MIN_REVISIT_BYTES, roll_bytes: int = ROLL_BYTES,
               shards: int | None = None) -> Archive:
    """Write a WARC record per row of ``pages`` below ``path`` (default: a fresh shared folder)."""
    spark = pages.sparkSession
    path = path or scratch_path(spark, "warc")
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    p = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    raw = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    p = p.withColumn("digest", F.sha1(raw)).withColumn("n", F.octet_length(raw))
    big = p.filter((F.col("n") >= min_bytes) & F.col("id").isNotNull()).select("id", "digest", "n")
    groups = big.groupBy("digest", "n").agg(F.max("id").alias("first"), F.count(F.lit(1)).alias("k")).filter("k > 1")
    refer = big.join(groups, ["digest", "n"]).filter("id != first").select("id", "digest", F.col("first").alias("refers_to")).distinct()
    rows = p.select("id", F.lit(1).alias("kind"), "url", "html", "digest", F.lit(None).cast("long").alias("refers_to"))
    marks = refer.select("id", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("url"),
                         F.lit(None).cast("string").alias("html"), "digest", "refers_to")
    written = rows.unionByName(marks).repartitionByRange(shards, "id") \
        .sortWithinPartitions("id", "kind", "digest", "url").mapInArrow(_writer(path, roll_bytes), MANIFEST)
    written.write.parquet(f"{path}/manifest")        # its _SUCCESS commits the archive
    return Archive(path)


# ---------------------------------------------------------------- reading
class _Hashed(io.RawIOBase):
    """A stream that hashes what is read through it."""

    def __init__(self, stream):
        self.stream, self.sha = stream, hashlib.sha256()

    def readable(self):
        return True

    def readinto(self, buf):
        data = self.stream.read(len(buf))
        self.sha.update(data)
        buf[:len(data)] = data
        return len(data)


def _reader(root: str, payloads: bool):
    kinds = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()),
                       ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                       ("refers_to", pa.int64())])

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds.types)], schema=kinds)

    def run(batches):
        system, base = _open(root)
        for b in batches:
            for name, digest in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rows, held = [], 0
                with system.open_input_stream(f"{base}/data/{name}", compression=None) as f:
                    hashed = _Hashed(f)
                    with io.BufferedReader(gzip.GzipFile(fileobj=io.BufferedReader(hashed, 1 << 20)), 1 << 20) as stream:
                        for head, block in read_records(stream):
                            payload = block.partition(b"\r\n\r\n")[2]
                            sha = base64.b32decode(head["warc-payload-digest"].removeprefix("sha1:")).hex()
                            response = head["warc-type"] == "response"
                            if response and hashlib.sha1(payload).hexdigest() != sha:
                                raise ValueError(f"wrong payload digest in {name}")
                            ids = [int(head[k]) if k in head else None for k in ("x-page-id", "x-refers-to-page-id")]
                            rows.append((ids[0], head["warc-target-uri"], head["warc-type"],
                                         payload if payloads and response else None,
                                         len(payload) if response else int(head["x-payload-length"]), sha, ids[1]))
                            held += len(payload) if payloads else 200
                            if held > 4 << 20:
                                yield batch(rows)
                                rows, held = [], 0
                if hashed.sha.hexdigest() != digest:
                    raise ValueError(f"{name} is not the file of the manifest")
                if rows:
                    yield batch(rows)
    return run


def read_warc(spark: SparkSession, archive: Archive, payloads: bool = True) -> DataFrame:
    """The records of an archive; ``payloads=False`` leaves the payload column null (digests are still checked)."""
    files = archive.manifest(spark).select("file", "sha256")
    n = max(1, min(files.count(), 100_000))
    return files.repartition(n).mapInArrow(_reader(archive.path, payloads), RECORD)
