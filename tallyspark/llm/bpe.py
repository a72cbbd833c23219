"""BPE encoding and decoding with content-defined chunk reuse.

Method
  * A rolling hash over 16 bytes cuts texts into chunks of about ``CHUNK`` bytes
    at places that depend on content only, so equal passages give equal chunks.
  * Chunk digests are counted over all documents (pre-aggregated in tasks).  The
    digests that occur more than once go into a bitmap of fixed size
    (``BITMAP_BITS``), which is broadcast; a false hit costs time, never a result.
  * Documents without a shared chunk are encoded in place.  Of the others the
    shared chunks are encoded once per digest and joined back (a chunk that a
    third of all documents hold is salted), the runs between them in place.
  * A chunk's encoding holds for the part between its first and last sure
    boundary, a visible ASCII character followed by a space or newline, where the
    tokenizer always splits, whatever stands around it.  So chunk joins are
    repaired by re-encoding from the last sure boundary on the left to the
    first on the right (through further chunks if one has none): beyond them both
    encodings agree exactly.
  * Decoding concatenates the tokens' bytes.

The merges run in tiktoken's ranks of the same vocabulary; texts holding
characters outside ``SAME_SPLIT`` (where Unicode tables of the two libraries could
differ) are encoded whole by the tokenizers library.  The special token's text
is the special token, as in that library.

Defined cases: null and empty text have no tokens; rows with a null id are
encoded in place like any other; equal rows give equal rows; very long texts
are encoded whole (chunk by chunk where chunks are shared); extra columns are
ignored; every row has its row in the result.
"""

from __future__ import annotations

import base64
import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import arrow_texts, stored

CHUNK = 1024                # mean chunk length in bytes, a power of two
BITMAP_BITS = 1 << 24       # 2 MB broadcast
HOT = 2000                  # documents of one chunk per salt
VOCABULARY = "byte_bpe_50k"
SPECIAL, SPECIAL_ID = "<|endoftext|>", 50256

_SURE = re.compile(rb"[!-~](?=[ \n])")
_ENCODER: dict = {}
_GEAR = np.random.default_rng(20240229).integers(0, 1 << 64, 256, dtype=np.uint64)


# ---------------------------------------------------------------- tokenizer
def _ranks() -> dict[bytes, int]:
    import public_tokenizers as P
    with open(P.path(f"{VOCABULARY}.tiktoken"), "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _encoder():
    if "fast" not in _ENCODER:
        import public_tokenizers as P
        import tiktoken
        _ENCODER["fast"] = tiktoken.Encoding("byte_bpe", pat_str=P.PATTERN, mergeable_ranks=_ranks(), special_tokens={})
    return _ENCODER["fast"]


def _token_bytes() -> list[bytes]:
    """The bytes of every token; a worker that only decodes needs no more."""
    if "bytes" not in _ENCODER:
        table = [b""] * (SPECIAL_ID + 1)
        for token, i in _ranks().items():
            table[i] = token
        table[SPECIAL_ID] = SPECIAL.encode()
        _ENCODER["bytes"] = table
    return _ENCODER["bytes"]


def _reference():
    if "exact" not in _ENCODER:
        import public_tokenizers as P
        from tokenizers import Tokenizer
        t = Tokenizer.from_file(P.path(f"{VOCABULARY}.json"))
        t.no_truncation()
        t.no_padding()
        _ENCODER["exact"] = t
    return _ENCODER["exact"]


# characters whose classes are the same in all Unicode versions in question: Latin to Arabic, CJK, kana, hangul syllables
SAME_SPLIT = re.compile("[\x00-ɏΑ-ΡΣ-ϿА-я‐-‧ぁ-ゖァ-ヺ"
                        "一-龥가-힣]*")


def encode_text(text: str) -> np.ndarray:
    """Token ids of one text (uint32)."""
    enc = _encoder()
    if not SAME_SPLIT.fullmatch(text):
        return np.array(_reference().encode(text, add_special_tokens=False).ids, dtype="<u4")
    if SPECIAL not in text:
        return np.array(enc.encode_ordinary(text), dtype="<u4")
    ids: list[int] = []
    for i, part in enumerate(text.split(SPECIAL)):
        if i:
            ids.append(SPECIAL_ID)
        ids += enc.encode_ordinary(part)
    return np.array(ids, dtype="<u4")


def decode_ids(ids: np.ndarray) -> str:
    table = _token_bytes()
    return b"".join([table[i] for i in ids.tolist()]).decode("utf-8", "replace")


# ---------------------------------------------------------------- chunks
def chunks(raw: bytes) -> list[tuple[int, int]]:
    """Content-defined (start, end) of a text's bytes: cuts where the rolling hash of 16 bytes has its low bits clear."""
    if len(raw) <= 16:
        return [(0, len(raw))] if raw else []
    h = _GEAR[np.frombuffer(raw, dtype=np.uint8)]
    for k in (1, 2, 4, 8):                   # h[i] = sum over j < 16 of gear(byte i - j) << j
        h[k:] = h[k:] + (h[:-k] << np.uint64(k))
    mask = np.uint64((CHUNK - 1) << 40)
    cuts = np.flatnonzero((h[15:] & mask) == 0) + 16
    ends = [int(c) for c in cuts if c < len(raw)] + [len(raw)]
    return list(zip([0] + ends[:-1], ends))


def _digest(raw: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "little", signed=True)


def _key(raw: bytes) -> bytes:
    return hashlib.blake2b(raw, digest_size=16).digest()


def split_sure(raw: bytes) -> tuple[bytes, bytes | None, bytes]:
    """Head, core and tail of a piece, cut at its first and last sure boundary; without one all is head, core None."""
    first = _SURE.search(raw)
    if first is None:
        return raw, None, b""
    a = first.end()
    b = max(raw.rfind(b" "), raw.rfind(b"\n"))
    while not _SURE.match(raw, b - 1):        # the last visible character before a space or newline
        b = max(raw.rfind(b" ", 0, b), raw.rfind(b"\n", 0, b))
    return raw[:a], raw[a:b], raw[b:]


def join_pieces(pieces) -> np.ndarray:
    """Ids of a text from (head, core ids or None, tail) of its pieces: joins are re-encoded between sure boundaries."""
    out, open_ = [], b""
    for head, core, tail in pieces:
        open_ += head
        if core is not None:
            out += [encode_text(open_.decode("utf-8")), core]
            open_ = tail
    out.append(encode_text(open_.decode("utf-8")))
    return np.concatenate(out)


# ---------------------------------------------------------------- Spark jobs
def _digest_batches(batches):
    """(key, n): chunk digests with their counts, pre-aggregated."""
    schema = pa.schema([("key", pa.int64()), ("n", pa.int64())])

    def emit(parts):
        k, n = np.unique(np.concatenate(parts), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(k), pa.array(n.astype(np.int64))], schema=schema)

    parts, held = [], 0
    for _, texts in arrow_texts(batches):
        keys = [_digest(raw[a:b]) for raw in (t.encode("utf-8") for t in texts) for a, b in chunks(raw)]
        parts.append(np.array(keys, dtype=np.int64))
        held += len(keys)
        if held > 500_000:
            yield emit(parts)
            parts, held = [], 0
    if held:
        yield emit(parts)


def _shared(bitmap: np.ndarray, raw: bytes) -> tuple[list[tuple[int, int]], np.ndarray]:
    at = chunks(raw)
    d = np.array([_digest(raw[a:b]) for a, b in at], dtype=np.int64).view(np.uint64) & np.uint64(BITMAP_BITS - 1)
    return at, (bitmap[(d >> np.uint64(3)).astype(np.int64)] >> (d & np.uint64(7)).astype(np.uint8)) & 1 > 0


def _whole_batches(bc):
    """Documents without a shared chunk, encoded in place."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())])

    def run(batches):
        for ids, texts in arrow_texts(batches):
            keep, out = [], []
            for i, t in zip(ids, texts):
                if i is None or not _shared(bc.value, t.encode("utf-8"))[1].any():
                    keep.append(i)
                    out.append(encode_text(t).tobytes())
            if keep:
                yield pa.RecordBatch.from_arrays([pa.array(keep, pa.int64()), pa.array(out, pa.binary())], schema=schema)
    return run


PIECE = "doc_id long, row long, seq int, key binary, head binary, core binary, tail binary"
_PIECE = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("seq", pa.int32()), ("key", pa.binary()),
                    ("head", pa.binary()), ("core", pa.binary()), ("tail", pa.binary())])


def _encoded(raw: bytes) -> tuple[bytes, bytes | None, bytes]:
    head, core, tail = split_sure(raw)
    return head, None if core is None else encode_text(core.decode("utf-8")).astype("<u2").tobytes(), tail


def _piece_batches(bc):
    """Pieces of the documents with shared chunks: a reference per shared chunk, the runs between encoded in place.

    The first time a task meets a shared chunk its bytes go along as a row without document.
    """
    def run(batches):
        part, number, met = TaskContext.get().partitionId(), 0, set()
        for ids, texts in arrow_texts(batches):
            rows = []
            for i, t in zip(ids, texts):
                raw = t.encode("utf-8")
                at, shared = _shared(bc.value, raw)
                if i is None or not shared.any():
                    continue
                row, number, seq, start = part << 40 | number, number + 1, 0, 0
                for (a, b), s in zip(at, shared):
                    if not s:
                        continue
                    if a > start:
                        rows.append((i, row, seq, None, *_encoded(raw[start:a])))
                        seq += 1
                    key = _key(raw[a:b])
                    rows.append((i, row, seq, key, None, None, None))
                    seq, start = seq + 1, b
                    if key not in met:
                        if len(met) > 200_000:
                            met.clear()
                        met.add(key)
                        rows.append((None, None, None, key, raw[a:b], None, None))
                if start < len(raw):
                    rows.append((i, row, seq, None, *_encoded(raw[start:])))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _PIECE.types)], schema=_PIECE)
    return run


def _chunk_batches(batches):
    """(key, raw) to (key, head, core, tail): every distinct shared chunk is encoded once."""
    schema = pa.schema([("key", pa.binary()), ("head", pa.binary()), ("core", pa.binary()), ("tail", pa.binary())])
    for b in batches:
        if b.num_rows:
            parts = list(zip(*(_encoded(r) for r in b.column(1).to_pylist())))
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.binary()), *(pa.array(p, pa.binary()) for p in parts)],
                                             schema=schema)


def _assemble_batches(batches):
    """Pieces sorted by (document, row, number) to whole encodings."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())])
    held, pieces = None, []

    def done():
        return held[0], join_pieces((h, None if c is None else np.frombuffer(c, dtype="<u2").astype("<u4"), t)
                                    for h, c, t in pieces).tobytes()

    for b in batches:
        keep = []
        for doc, row, head, core, tail in zip(*(b.column(c).to_pylist() for c in ("doc_id", "row", "head", "core", "tail"))):
            if (doc, row) != held:
                if held is not None:
                    keep.append(done())
                held, pieces = (doc, row), []
            pieces.append((head, core, tail))
        if keep:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*keep), schema.types)], schema=schema)
    if held is not None:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*[done()]), schema.types)], schema=schema)


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids) for every row of ``docs``; ids are little-endian unsigned 32-bit integers, end to end."""
    spark = docs.sparkSession
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    counts = d.mapInArrow(_digest_batches, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).filter("n > 1")
    place = F.col("key").bitwiseAND(F.lit(BITMAP_BITS - 1))
    words = counts.groupBy(F.shiftright(place, 5).cast("int").alias("word")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(31)).cast("int"))).alias("bits")).toPandas()
    bitmap = np.zeros(BITMAP_BITS // 32, dtype="<u4")          # at most that many rows come to the driver
    bitmap[words["word"].to_numpy(dtype=np.int64)] = words["bits"].to_numpy(dtype=np.int64).astype(np.uint32)
    bc = spark.sparkContext.broadcast(bitmap.view(np.uint8))

    whole = d.mapInArrow(_whole_batches(bc), "doc_id long, ids binary")
    pieces = stored(d.mapInArrow(_piece_batches(bc), PIECE), "pieces")
    raw = pieces.filter("doc_id is null").groupBy("key").agg(F.first("head").alias("raw"))
    table = raw.mapInArrow(_chunk_batches, "key binary, head binary, core binary, tail binary")
    refs = pieces.filter("doc_id is not null and key is not null").select("doc_id", "row", "seq", "key")
    salts = refs.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / HOT).cast("int").alias("salts"))
    table = table.join(salts, "key").withColumn("salt", F.explode(F.sequence(F.lit(1), "salts")))
    refs = refs.join(salts, "key") .withColumn("salt", F.pmod(F.xxhash64("row"), F.col("salts")).cast("int") + 1) \
        .drop("salts").join(table.drop("salts"), ["key", "salt"]).select("doc_id", "row", "seq", "head", "core", "tail")
    own = pieces.filter("doc_id is not null and key is null").select("doc_id", "row", "seq", "head", "core", "tail")
    joined = own.unionByName(refs).repartition("doc_id", "row").sortWithinPartitions("doc_id", "row", "seq") \
        .mapInArrow(_assemble_batches, "doc_id long, ids binary")
    return whole.unionByName(joined)


def _decode_batches(batches):
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("text", pa.string())])
    for b in batches:
        for s in range(0, b.num_rows, 200):
            c = b.slice(s, 200)
            text = [decode_ids(np.frombuffer(i, dtype="<u4")) for i in c.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([c.column(0).cast(pa.int64()), c.column(1).cast(pa.binary()),
                                              pa.array(text, pa.string())], schema=schema)


def decode(encoded: DataFrame) -> DataFrame:
    """(doc_id, ids, text) of encodings (doc_id, ids)."""
    return encoded.select("doc_id", "ids").mapInArrow(_decode_batches, "doc_id long, ids binary, text string")
