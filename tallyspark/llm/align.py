"""Cross-tokenizer alignment by merge-path partitioning.

Every text, with a space in front, is encoded by two public tokenizers (A: byte-level
BPE, B: piece BPE with byte fallback); both token sequences cover the same bytes.

Method
  * The ends of the A tokens and of the B tokens are two sorted lists.  Merging them
    walks a path of len(A) + len(B) steps.  Every ``WORK`` steps a diagonal cuts the
    path; a binary search on the diagonal finds how many ends of either list lie before
    it.  The pieces between two diagonals are independent and cost the same, however
    the lists interleave and however long a text is (short texts of a batch share a
    path, a long one has many pieces).
  * A piece emits its overlaps: the end of an A token meets the first B token that ends
    there or later, and the other way round; a common end emits one overlap.
  * Where a diagonal separates the two halves of a common end, the pieces are stitched:
    the left piece learns that its last A token closes a group, the right one drops the
    repeated overlap.  Groups are numbered through all pieces of a text.
  * The number of documents of each linked id pair is summed over the corpus
    (pre-aggregated in tasks) and joined back to the documents' distinct pairs.  Up to
    ``BROADCAST_PAIRS`` id pairs are broadcast (12 bytes each), more are joined by shuffle.

Encoding.  No token of either tokenizer runs from a visible character into a space or
newline, from a Latin letter into one of ``.,;:!?``, or from a newline into a word or mark
(A's split pattern; no such pair of characters lies in any piece of B).  So texts are
encoded in segments between such places, and each distinct segment once per worker.
A's merges run in tiktoken's ranks of the same vocabulary; segments with characters
outside ``bpe.SAME_SPLIT`` go to the tokenizers library.

Defined cases: texts that are null, empty, or whose joined bytes differ from
space + text have no tokens (all numbers 0, groups ''); equal rows each have their row
and count as documents of their own; a null id is kept; empty tables give empty
results; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.llm.bpe import SAME_SPLIT, VOCABULARY, _encoder, _ranks
from tallyspark.llm.common import arrow_texts, stored

PIECES = "piece_bpe_32k"
WORK = 1 << 15              # merge steps of one piece
BATCH = 400_000             # characters handled at once in a task (a longer text is one batch by itself)
CACHED_SEGMENTS = 150_000   # segments of either generation whose encodings a worker keeps
BROADCAST_PAIRS = 4_000_000
FLUSH = 2_000_000           # pairs held in a task before they are counted

_LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
_SEGMENT = re.compile(f" ?[{_LETTERS}]+(?=[ \\n.,;:!?]|\\Z)"          # a word before a space, newline or mark
                      "|[.,;:!?]+(?=[ \\n]|\\Z)"                     # marks before a space or newline
                      f"|\\n(?=[{_LETTERS}.,;:!?])"                   # a newline before a word or mark
                      "|\\s*+\\S(?:[^ \\n]*\\S)?(?=[ \\n]|\\Z)"       # anything else up to a visible character before those
                      "|(?s:.+)")
_STATE: dict = {}


# ---------------------------------------------------------------- encoding
class Encoder:
    """Encoding by both tokenizers, segment by segment; a segment's ids are kept as 16-bit integers."""

    def __init__(self):
        import public_tokenizers as P
        import sentencepiece
        from tokenizers import Tokenizer
        self.fast = _encoder()
        self.exact = Tokenizer.from_file(P.path(f"{VOCABULARY}.json"))
        self.exact.no_truncation()
        self.exact.no_padding()
        self.exact.encode_special_tokens = True         # their strings in a text are ordinary text
        self.sp = sentencepiece.SentencePieceProcessor(model_file=P.path(f"{PIECES}.model"))
        self.space = self.sp.piece_to_id("▁")
        ranks = _ranks()
        self.a_bytes = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.a_bytes[i] = token
        self.b_bytes = [self._piece(i) for i in range(self.sp.get_piece_size())]
        self.a_length = np.array([len(t) for t in self.a_bytes], dtype=np.int64)
        self.b_length = np.array([len(t) for t in self.b_bytes], dtype=np.int64)
        # decimal ids with what may follow them in the groups' text
        self.a_text = [f"{i}{c}" for c in ",|" for i in range(len(self.a_bytes))]
        self.b_text = [f"{i}{c}" for c in ",;" for i in range(len(self.b_bytes))]
        self.segments: dict[str, tuple[bytes, bytes | None]] = {}       # met lately
        self.older: dict[str, tuple[bytes, bytes | None]] = {}          # met before; what is met again moves up

    def _piece(self, i: int) -> bytes:
        if self.sp.is_byte(i):
            return bytes([int(self.sp.id_to_piece(i)[3:-1], 16)])
        return self.sp.id_to_piece(i).replace("▁", " ").encode()

    def add(self, segments: list[str]) -> None:
        """Encode the segments: A ids and B ids of each, None for B's if its pieces do not give the segment's bytes."""
        # B always puts a space in front: where the segment has none, a newline, which no piece joins, keeps it apart
        spaced = [s[0] == " " for s in segments]
        all_b = self.sp.encode([s[1:] if own else "\n" + s for s, own in zip(segments, spaced)], num_threads=1)
        for s, own, b in zip(segments, spaced, all_b):
            a = self.fast.encode_ordinary(s) if SAME_SPLIT.fullmatch(s) else self.exact.encode(s, add_special_tokens=False).ids
            b = (b or [self.space]) if own else b[2:]
            same = b"".join([self.b_bytes[i] for i in b]) == s.encode()
            self.segments[s] = array("H", a).tobytes(), array("H", b).tobytes() if same else None

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """(A ids, B ids) of a space and the text; None if it is empty or the joined bytes differ."""
        if not text:
            return None
        segments = _SEGMENT.findall(" " + text)
        found = list(map(self.segments.get, segments))
        if None in found:
            new = []
            for s in {s for s, f in zip(segments, found) if f is None}:
                old = self.older.get(s)
                if old is None:
                    new.append(s)
                else:
                    self.segments[s] = old
            self.add(new)
            found = list(map(self.segments.__getitem__, segments))
            for s in new:
                if len(s) > 64:
                    del self.segments[s]
            if len(self.segments) > CACHED_SEGMENTS:
                self.older, self.segments = self.segments, {}
        b = list(map(itemgetter(1), found))
        if None in b:
            return None
        a = b"".join(map(itemgetter(0), found))
        return np.frombuffer(a, dtype=np.uint16).astype(np.int64), np.frombuffer(b"".join(b), dtype=np.uint16).astype(np.int64)


def encoder() -> Encoder:
    if "encoder" not in _STATE:
        _STATE["encoder"] = Encoder()
    return _STATE["encoder"]


# ---------------------------------------------------------------- merge path
def diagonals(a: np.ndarray, b: np.ndarray, work: int) -> tuple[np.ndarray, np.ndarray]:
    """Splits (i, j) of the merge of two sorted lists after 0, work, 2 work, ... steps and at its end (ties: a first)."""
    d = np.append(np.arange(0, len(a) + len(b), work), len(a) + len(b))
    low, high = np.maximum(0, d - len(b)), np.minimum(d, len(a))
    while True:
        open_ = low < high
        if not open_.any():
            return low, d - low
        mid = (low + high) // 2
        left = np.zeros(len(d), dtype=bool)
        m, r = mid[open_], (d - 1 - mid)[open_]
        left[open_] = a[m] <= b[r]                  # a[m] comes before b[r], so more than m ends of a lie before
        low = np.where(open_ & left, mid + 1, low)
        high = np.where(open_ & ~left, mid, high)


def merge_piece(a: np.ndarray, b: np.ndarray):
    """One piece: per end of ``a`` the number of the b token it meets, and the other way round; common ends of either.

    Numbers count from the piece's start; len(b) or len(a) stands for the next piece's first token.
    """
    to_b = np.searchsorted(b, a, side="left")
    to_a = np.searchsorted(a, b, side="left")
    a_close = np.zeros(len(a), dtype=bool)
    b_close = np.zeros(len(b), dtype=bool)
    if len(a) and len(b):
        a_close = b[np.minimum(to_b, len(b) - 1)] == a
        b_close = a[np.minimum(to_a, len(a) - 1)] == b
    return to_b, to_a, a_close, b_close


def overlaps(a: np.ndarray, b: np.ndarray, work: int = WORK):
    """Overlaps and groups of two lists of ends with the same last end.

    Returns (links' a numbers, links' b numbers, group number per a token, per b token).
    """
    i, j = diagonals(a, b, work)
    link_a, link_b = [], []
    a_close, b_close = np.zeros(len(a), dtype=bool), np.zeros(len(b), dtype=bool)
    for i0, i1, j0, j1 in zip(i[:-1], i[1:], j[:-1], j[1:]):
        to_b, to_a, ca, cb = merge_piece(a[i0:i1], b[j0:j1])
        a_close[i0:i1], b_close[j0:j1] = ca, cb
        if i0 and j0 < j1 and a[i0 - 1] == b[j0]:     # stitched: a common end cut in two
            a_close[i0 - 1] = b_close[j0] = True
        own = np.flatnonzero(~b_close[j0:j1])           # a common end's overlap comes from its a token
        link_a += [np.arange(i0, i1), i0 + to_a[own]]
        link_b += [j0 + to_b, j0 + own]
    group_a, group_b = np.cumsum(a_close) - a_close, np.cumsum(b_close) - b_close
    return np.concatenate(link_a or [a[:0]]), np.concatenate(link_b or [b[:0]]), group_a, group_b


# ---------------------------------------------------------------- documents
def groups_text(enc: Encoder, ids_a, ids_b, group_a, group_b) -> str:
    """``a1,a2|b1;a3|b2,b3``: decimal ids of every group in order."""
    n_a, n_b = np.bincount(group_a), np.bincount(group_b)
    before_a, before_b = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
    at_a = np.arange(len(ids_a)) + before_b[group_a]
    at_b = np.arange(len(ids_b)) + (before_a + n_a)[group_b]
    last_a = np.append(group_a[1:] != group_a[:-1], True)
    last_b = np.append(group_b[1:] != group_b[:-1], True)
    order = np.empty(len(ids_a) + len(ids_b), dtype=np.int64)
    order[at_a] = ids_a + last_a * len(enc.a_bytes)
    order[at_b] = len(enc.a_text) + ids_b + last_b * len(enc.b_bytes)
    if "text" not in _STATE:
        _STATE["text"] = enc.a_text + enc.b_text
    return "".join(itemgetter(*order.tolist())(_STATE["text"]))[:-1]


def pack(values: np.ndarray, times: np.ndarray) -> bytes:
    """Ascending 32-bit values as differences and their multiplicities, byte plane by byte plane (compresses well)."""
    both = np.concatenate([np.diff(values, prepend=0), times]).astype("<u4")
    return np.ascontiguousarray(both.view(np.uint8).reshape(-1, 4).T).tobytes()


def unpack(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = np.ascontiguousarray(np.frombuffer(raw, dtype=np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)
    half = len(both) // 2
    return np.cumsum(both[:half]), both[half:]


def align_texts(texts: list[str], with_groups: bool = False) -> list[tuple]:
    """(n_a, n_b, n_groups, n_links, sha256 of the groups, packed links, groups) of every text."""
    enc = encoder()
    out: list[tuple] = [(0, 0, 0, 0, "", b"", "" if with_groups else None)] * len(texts)
    found = [(t, ids) for t, ids in enumerate(map(enc.encode, texts)) if ids is not None]
    if not found:
        return out
    ids_a, ids_b = (np.concatenate([ids[k] for _, ids in found]) for k in (0, 1))
    off_a, off_b = (np.cumsum([0] + [len(ids[k]) for _, ids in found]) for k in (0, 1))
    link_a, link_b, group_a, group_b = overlaps(np.cumsum(enc.a_length[ids_a]), np.cumsum(enc.b_length[ids_b]))
    doc = np.searchsorted(off_a, link_a, side="right") - 1
    key = np.sort(doc << 31 | ids_a[link_a] << 15 | ids_b[link_b])
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    times = np.diff(np.append(first, len(key)))
    key = key[first]
    cut = np.searchsorted(key, np.arange(len(found) + 1) << 31)
    n_links = np.bincount(doc, minlength=len(found))
    for d, (t, _) in enumerate(found):
        a, b = slice(off_a[d], off_a[d + 1]), slice(off_b[d], off_b[d + 1])
        base = group_a[a][0]
        text = groups_text(enc, ids_a[a], ids_b[b], group_a[a] - base, group_b[b] - base)
        links = slice(cut[d], cut[d + 1])
        out[t] = (int(off_a[d + 1] - off_a[d]), int(off_b[d + 1] - off_b[d]), int(group_a[a][-1] - base + 1), int(n_links[d]),
                  hashlib.sha256(text.encode()).hexdigest(), pack(key[links] & 0x7FFFFFFF, times[links]),
                  text if with_groups else None)
    return out


ALIGNED = "doc_id long, row long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links binary, groups string"
_ALIGNED = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), *((c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")),
                      ("groups_sha256", pa.string()), ("links", pa.binary()), ("groups", pa.string())])


def _align_batches(with_groups: bool):
    def run(batches):
        row = TaskContext.get().partitionId() << 40
        for ids, texts in arrow_texts(batches, BATCH):
            cells = [ids, list(range(row, row + len(ids))), *zip(*align_texts(texts, with_groups))]
            row += len(ids)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, _ALIGNED.types)], schema=_ALIGNED)
    return run


def _pair_batches(batches):
    """(pair, n): documents that hold each id pair linked, pre-aggregated."""
    schema = pa.schema([("pair", pa.int64()), ("n", pa.int64())])
    held, size, known, n = [], 0, np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

    def fold(known, n, held):
        both = np.concatenate([known, *held])
        weight = np.concatenate([n, np.ones(len(both) - len(known), dtype=np.int64)])
        u, at = np.unique(both, return_inverse=True)
        return u, np.bincount(at, weight, minlength=len(u)).astype(np.int64)

    for b in batches:
        for raw in b.column(0).to_pylist():
            held.append(unpack(raw)[0])
            size += len(held[-1])
            if size > FLUSH:
                known, n = fold(known, n, held)
                held, size = [], 0
                if len(known) > FLUSH:
                    yield pa.RecordBatch.from_arrays([pa.array(known), pa.array(n)], schema=schema)
                    known, n = known[:0], n[:0]
    known, n = fold(known, n, held)
    if len(known):
        yield pa.RecordBatch.from_arrays([pa.array(known), pa.array(n)], schema=schema)


def _lookup_batches(bc):
    """Adds n_best and count_sum from the broadcast pair counts."""
    schema = pa.schema([*_ALIGNED, ("n_best", pa.int64()), ("count_sum", pa.int64())])

    def run(batches):
        pairs, n, best = bc.value
        for b in batches:
            n_best, total = [], []
            for raw in b.column("links").to_pylist():
                values, times = unpack(raw)
                at = np.searchsorted(pairs, values)
                n_best.append(int(times[best[at]].sum()))
                total.append(int((times * n[at]).sum()))
            yield pa.RecordBatch.from_arrays([*(b.column(c).cast(t) for c, t in zip(_ALIGNED.names, _ALIGNED.types)),
                                              pa.array(n_best, pa.int64()), pa.array(total, pa.int64())], schema=schema)
    return run


def _link_rows(batches):
    """(row, pair, times) of the documents' distinct pairs."""
    schema = pa.schema([("row", pa.int64()), ("pair", pa.int64()), ("times", pa.int64())])
    for b in batches:
        for row, raw in zip(b.column("row").to_pylist(), b.column("links").to_pylist()):
            values, times = unpack(raw)
            for s in range(0, len(values), 1 << 20):
                v = values[s:s + (1 << 20)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), row)), pa.array(v), pa.array(times[s:s + (1 << 20)])],
                                                 schema=schema)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, n): in how many documents an id pair (A id << 15 | B id) is linked."""
    return aligned.select("links").mapInArrow(_pair_batches, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def align(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_groups: bool = False,
          broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """Per row: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 and, if asked for, groups.

    n_best counts the links whose pair is linked in as many documents as any pair of
    its A id; count_sum adds the pairs' document counts over the links.
    """
    spark = docs.sparkSession
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    aligned = stored(d.mapInArrow(_align_batches(with_groups), ALIGNED), "aligned")
    counts = stored(pair_counts(aligned), "pairs")
    if counts.count() <= broadcast_pairs:
        t = counts.orderBy("pair").toPandas()
        pairs, n = t["pair"].to_numpy(dtype=np.int64), t["n"].to_numpy(dtype=np.int64)
        top = np.zeros(1 << 16, dtype=np.int64)
        np.maximum.at(top, pairs >> 15, n)
        bc = spark.sparkContext.broadcast((pairs, n.astype(np.int32) if n.max(initial=0) < 1 << 31 else n, n == top[pairs >> 15]))
        out = aligned.mapInArrow(_lookup_batches(bc), f"{ALIGNED}, n_best long, count_sum long")
    else:
        best = F.col("n") == F.max("n").over(Window.partitionBy(F.shiftright("pair", 15)))
        rows = aligned.select("row", "links").mapInArrow(_link_rows, "row long, pair long, times long")
        sums = rows.join(counts.withColumn("best", best), "pair").groupBy("row").agg(
            F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"),
            F.sum(F.col("times") * F.col("n")).alias("count_sum"))
        zero = F.lit(0).cast("long")
        out = aligned.join(sums, "row", "left").withColumn("n_best", F.coalesce("n_best", zero)) \
            .withColumn("count_sum", F.coalesce("count_sum", zero))
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256",
                      *(["groups"] if with_groups else []))
