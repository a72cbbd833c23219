"""MinHash near-duplicate detection with HyperMinHash registers.

Method
  1. Sketch (one scan).  A document's set is its distinct 5-word shingles
     (64-bit codes).  Every shingle falls into one of ``REGISTERS`` buckets by
     its hash; a bucket keeps the smallest remaining hash, stored as
     leading-zero count (6 bits) plus ``MANTISSA`` mantissa bits.  Empty
     buckets are filled by further rounds of hashing of the same set, so the
     chance that two documents agree in a register is their Jaccard similarity.
     Documents with equal sets are collapsed by a 128-bit fingerprint; every
     distinct set has a number of its own, and all links are between sets.
  2. Banding of the compressed registers: ``BANDS`` bands of ``ROWS``
     registers.  Every member of a band's group is paired with the group's
     hub only (its most copied text), never with all others.
  3. Register agreement, corrected for chance collisions, estimates the
     Jaccard similarity; pairs ``MARGIN`` standard errors below the threshold go.
  4. The rest is confirmed on the full sets: 100 * |A and B| >= threshold * |A or B|.
  5. Components of the confirmed links.  A band group that still holds several
     components is compared again.  First a text leaves when too many of its
     shingles occur in no other text of such groups: the others cannot add up to
     the threshold, with any partner.  The rest is compared in blocks of about
     ``BLOCK`` members per side, only across components: pairs estimated similar
     are confirmed, and the components joined.  So no group is cut off, no group
     goes to one task, and members that are already linked cost nothing more.

A link at the threshold is missed with probability below 1e-7 by banding
(0.85: 5e-11) and about 3e-5 by the estimate; nothing else is approximate.

Defined cases: null or wordless text has an empty set and is linked with
nothing; fewer than five words: the whole sequence is one shingle; rows with a
null id take no part; equal rows (same id, same text) are one document; rows of one
id with different texts are searched each by its own text, and a component takes the
smallest id of all its rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.llm.common import add_columns, arrow_texts, mix, stored, text_batches, word_codes
from tallyspark.llm.components import components

SHINGLE = 5
REGISTERS = 128
BANDS, ROWS = 32, 4
MANTISSA = 10
MARGIN = 4.0
BLOCK = 256


# ---------------------------------------------------------------- sketches
def shingles(texts: list[str], k: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle codes of every text."""
    codes, off = word_codes(texts, "space")
    rolled = np.zeros(max(0, len(codes) - k + 1), dtype=np.uint64)
    for i in range(k):
        rolled = mix(rolled + codes[i:i + len(rolled)] * np.uint64(2 * i + 3) + np.uint64(i + 1))
    out = []
    for s, e in zip(off[:-1], off[1:]):
        if e - s >= k:
            out.append(np.unique(rolled[s:e - k + 1]))
        elif e > s:      # short text: one shingle of the whole sequence, told apart by its length
            h = np.zeros(1, dtype=np.uint64)
            for i in range(int(e - s)):
                h = mix(h + codes[s + i:s + i + 1] * np.uint64(2 * i + 3) + np.uint64(101 + int(e - s)))
            out.append(h)
        else:
            out.append(rolled[:0])
    return out


def registers(codes: np.ndarray, m: int = REGISTERS) -> np.ndarray:
    """HyperMinHash registers (uint16: leading zeros << MANTISSA | mantissa) of a non-empty set."""
    low = np.full(m, np.uint64(0xFFFFFFFFFFFFFFFF))
    n, done = len(codes), 0
    shift = np.uint64(64 - m.bit_length() + 1)
    while True:
        rounds = max(1, -(-8 * m // n)) if done or n < 8 * m else 1
        seeds = (np.arange(done, done + rounds, dtype=np.uint64) + np.uint64(1)) * np.uint64(0xA0761D6478BD642F)
        h = mix((codes[None, :] ^ seeds[:, None]) + seeds[:, None])
        bucket = (h >> shift).ravel()
        rest = (h << np.uint64(m.bit_length() - 1)) >> np.uint64(12)          # 52 bits
        order = np.minimum(np.arange(done, done + rounds, dtype=np.uint64), np.uint64(4095))
        np.minimum.at(low, bucket, ((order[:, None] << np.uint64(52)) | rest).ravel())
        done += rounds
        if not (low == np.uint64(0xFFFFFFFFFFFFFFFF)).any():
            break
    value = low & np.uint64((1 << 52) - 1)
    # position of the leading one: frexp is exact for 52-bit integers
    bits = np.frexp(value.astype(np.float64))[1]
    zeros = np.minimum(52 - bits, 50).astype(np.uint64)
    mantissa = (value << (np.uint64(13) + zeros)) >> np.uint64(64 - MANTISSA)     # the bits after the leading one
    return ((zeros << np.uint64(MANTISSA)) | mantissa).astype(np.uint16)


def _sketch_batches(batches):
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("fp", pa.binary()), ("regs", pa.binary())])
    for ids, texts in arrow_texts(batches):
        n, fp, regs = [], [], []
        for s in shingles(texts):
            n.append(len(s))
            fp.append(_fingerprint(s.tobytes()) if len(s) else None)
            regs.append(registers(s).tobytes() if len(s) else None)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()),
                                          pa.array(fp, pa.binary()), pa.array(regs, pa.binary())], schema=schema)


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, fp, regs) per row: set size, fingerprint and registers (null for an empty set)."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")) \
        .mapInArrow(_sketch_batches, "doc_id long, n long, fp binary, regs binary")


def _set_batches(batches):
    schema = pa.schema([("rep", pa.int64()), ("fp", pa.binary()), ("codes", pa.binary())])
    for ids, texts in arrow_texts(batches):
        codes = [s.tobytes() for s in shingles(texts)]
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([_fingerprint(c) for c in codes]),
                                          pa.array(codes, pa.binary())], schema=schema)


def _fingerprint(codes: bytes) -> bytes:
    return hashlib.blake2b(codes, digest_size=16).digest()


# ---------------------------------------------------------------- estimation
def collision_rate(n: np.ndarray, m: int = REGISTERS) -> np.ndarray:
    """Chance that unrelated registers of sets with about ``n`` elements agree.

    Two independent minima share leading-zero count and mantissa with
    probability 2 ** -MANTISSA times that of sharing the count; for equal loads
    the latter is about one third (geometric), whatever the load.
    """
    return np.full(np.shape(n), 2.0 ** -MANTISSA / 3.0)


def estimate_bound(threshold: float, m: int = REGISTERS) -> int:
    """Least number of agreeing registers at which a pair is worth confirming."""
    c = float(collision_rate(np.array([1.0]))[0])
    expected = threshold + (1 - threshold) * c      # inverse of (f - c) / (1 - c)
    return max(1, int(math.floor(m * (expected - MARGIN * math.sqrt(expected * (1 - expected) / m)))))


def _agree(column_a: str, column_b: str, bound: int):
    def run(batches):
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            x = np.frombuffer(b"".join(b.column(column_a).to_pylist()), dtype=np.uint16).reshape(n, -1)
            y = np.frombuffer(b"".join(b.column(column_b).to_pylist()), dtype=np.uint16).reshape(n, -1)
            keep = (x == y).sum(1) >= bound
            t = b.select(["a", "b"]).filter(pa.array(keep))
            if t.num_rows:
                yield t
    return run


def _confirm(percent: int):
    def run(batches):
        for b in batches:
            keep = []
            for i in range(b.num_rows):     # one pair at a time: the sets stay in their Arrow buffers
                x, y = (np.frombuffer(b.column(c)[i].as_buffer(), dtype=np.uint64) for c in ("ca", "cb"))
                if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                    keep.append(False)
                    continue
                common = len(x) + len(y) - len(np.union1d(x, y))
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            t = b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
            if t.num_rows:
                yield t
    return run


# ---------------------------------------------------------------- band groups
def _band_batches(batches):
    schema = pa.schema([("band", pa.int64()), ("rep", pa.int64()), ("copies", pa.int64())])
    for b in batches:
        n = b.num_rows
        if not n:
            continue
        r = np.frombuffer(b"".join(b.column("regs").to_pylist()), dtype=np.uint16).reshape(n, -1)
        keys = _band_keys(r)
        rep, copies = b.column("rep").to_numpy(zero_copy_only=False), b.column("copies").to_numpy(zero_copy_only=False)
        yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(rep, BANDS)),
                                          pa.array(np.repeat(copies, BANDS))], schema=schema)


def _band_keys(r: np.ndarray) -> np.ndarray:
    """64-bit band keys, (rows, BANDS): the band's registers and its number, mixed."""
    q = np.ascontiguousarray(r[:, :BANDS * ROWS]).view(np.uint64).reshape(len(r), BANDS)   # 4 x 16 bits
    return mix(q + (np.arange(BANDS, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))


def _cross_batches(bound: int, percent: int):
    """Rows are (side A block, side B block) pairs; emits the (a, b) estimated similar in other components.

    A pair has at most the smaller side's shared shingles in common; where that
    cannot reach the threshold it is left out (exact).  A pair is reported by its
    first common band group only.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        for t in batches:
            for i in range(t.num_rows):
                row = {c: t.column(c)[i].as_py() for c in t.schema.names}
                xa, xb = (np.frombuffer(b"".join(row[c]), dtype=np.uint16).reshape(len(row[c]), -1)
                          for c in ("ra", "rb"))
                ia, ib = np.array(row["ia"]), np.array(row["ib"])
                ca, cb = np.array(row["ca"]), np.array(row["cb"])
                agree = np.zeros((len(ia), len(ib)), dtype=np.int16)
                for j in range(xa.shape[1]):
                    agree += xa[:, j, None] == xb[None, :, j]
                na, sa, nb, sb = (np.array(row[c]) for c in ("na", "sa", "nb", "sb"))
                common = np.minimum(sa[:, None], sb[None, :])
                ok = (agree >= bound) & (ca[:, None] != cb[None, :])
                ok &= 100 * common >= percent * (na[:, None] + nb[None, :] - common)
                p, q = np.nonzero(ok)
                if not len(p):
                    continue
                first = (_band_keys(xa[p]) == _band_keys(xb[q])).argmax(1)
                here = _band_keys(xa[p])[np.arange(len(p)), first].view(np.int64) == row["band"]
                p, q = p[here], q[here]
                if len(p):
                    yield pa.RecordBatch.from_arrays([pa.array(np.maximum(ia[p], ib[q])),
                                                      pa.array(np.minimum(ia[p], ib[q]))], schema=schema)
    return run


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80) -> DataFrame:
    """(doc_id, fp, group, n_shingles, component_id, kept) per row of ``docs`` with an id.

    fp is the fingerprint of the text's set and group the number of its component (null without words): rows of
    one id may lie in several groups, whose component_id then is the same.

    component_id is the smallest id reachable over links of similarity
    ``percent`` / 100 or more; kept marks the one document of each component.
    """
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")) \
        .filter(F.col("doc_id").isNotNull())
    bound = estimate_bound(percent / 100)
    sk = stored(sketches(src), "sketches")
    reps = sk.filter("n > 0").groupBy("fp").agg(F.min("doc_id").alias("doc"), F.count(F.lit(1)).alias("copies"),
                                                F.first("regs").alias("regs"))
    reps = stored(reps.withColumn("rep", F.monotonically_increasing_id()), "reps")      # written once: the numbers stay

    # band groups of two or more; the hub is the most copied text, then the smallest id
    bands = reps.select("rep", "copies", "regs").mapInArrow(_band_batches, "band long, rep long, copies long")
    order = F.struct(F.col("copies"), (-F.col("rep")).alias("low"))
    groups = bands.groupBy("band").agg(F.count(F.lit(1)).alias("size"), F.max(order).alias("hub")) \
        .filter("size > 1").select("band", "size", (-F.col("hub.low")).alias("hub"))
    members = stored(bands.join(groups, "band").select("band", "size", "hub", "rep"), "bands")

    regs = reps.select("rep", "regs")
    star = members.filter("rep != hub").select(F.greatest("rep", "hub").alias("a"), F.least("rep", "hub").alias("b"))
    star = _similar(star.distinct(), regs, bound)

    # full sets, only for texts that share a band with another one
    wanted = reps.join(members.select("rep").distinct(), "rep", "left_semi").select("rep", "fp", "doc")
    texts = src.join(wanted, src["doc_id"] == wanted["doc"], "left_semi")
    sets = texts.mapInArrow(_set_batches, "doc long, fp binary, codes binary").join(wanted, ["doc", "fp"])
    sets = stored(sets.dropDuplicates(["rep"]).select("rep", "codes"), "sets")
    links = stored(_confirmed(star, sets, percent), "links")
    label = components(links)

    # groups that still hold several components: compare across them, in blocks
    comp = F.coalesce(F.col("component"), F.col("rep"))
    m = members.join(label.withColumnRenamed("node", "rep"), "rep", "left").select("band", "rep", comp.alias("comp"))
    m = stored(m.join(_divided(m).filter("size > 2").select("band"), "band"), "divided")    # two are hub and member
    m = m.join(_linkable(sets.join(m.select("rep").distinct(), "rep", "left_semi"), percent), "rep")
    rest = m.join(_divided(m), "band").join(regs, "rep")
    more = stored(_confirmed(_across(rest, bound, percent), sets, percent), "links")
    found = label.select(F.col("node").alias("a"), F.col("component").alias("b"))    # stands for its links: a few rounds less
    label = components(found.unionByName(more))

    # a component is named by the smallest id of its rows
    named = reps.join(label.withColumnRenamed("node", "rep"), "rep", "left") \
        .select("fp", "doc", F.coalesce("component", "rep").alias("comp"))
    low = named.groupBy("comp").agg(F.min("doc").alias("component_id"))
    named = named.join(low, "comp").select("fp", F.col("comp").alias("group"), "component_id")
    cid = F.coalesce(F.col("component_id"), F.col("doc_id"))
    return sk.join(named, "fp", "left").select("doc_id", "fp", "group", F.col("n").alias("n_shingles"), cid.alias("component_id"),
                                               (F.col("doc_id") == cid).alias("kept"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) per row of ``docs`` with an id."""
    return classes(docs, id_col, text_col, percent).drop("fp", "group")


def fingerprint_rows(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the column fp: the fingerprint that ``classes`` names; null without words."""
    def make(texts):
        out = []
        for _, some in text_batches(texts, texts):
            out += [_fingerprint(s.tobytes()) if len(s) else None for s in shingles(some)]
        return [pa.array(out, pa.binary())]
    return add_columns(docs, text_col, make, {"fp": "binary"})


def _divided(m: DataFrame) -> DataFrame:
    """(band, main, n_main, size) of the groups that hold several components."""
    c = m.groupBy("band", "comp").agg(F.count(F.lit(1)).alias("k")).groupBy("band").agg(
        F.max(F.struct("k", "comp")).alias("top"), F.sum("k").alias("size"), F.count(F.lit(1)).alias("comps"))
    return c.filter("comps > 1").select("band", F.col("top.comp").alias("main"), F.col("top.k").alias("n_main"), "size")


def _code_rows(batches):
    schema = pa.schema([("rep", pa.int64()), ("code", pa.int64())])
    for b in batches:
        for s in range(0, b.num_rows, 500):
            t = b.slice(s, 500)
            codes = [np.frombuffer(c, dtype=np.int64) for c in t.column("codes").to_pylist()]
            reps = np.repeat(t.column("rep").to_numpy(zero_copy_only=False), [len(c) for c in codes])
            yield pa.RecordBatch.from_arrays([pa.array(reps), pa.array(np.concatenate(codes))], schema=schema)


def _linkable(sets: DataFrame, percent: int) -> DataFrame:
    """(rep, n, shared) of the sets whose shingles shared with any other of these sets reach the threshold."""
    shared = sets.select("rep", "codes").mapInArrow(_code_rows, "rep long, code long").groupBy("code").agg(
        F.count(F.lit(1)).alias("k"), F.min("rep").alias("rep")).filter("k = 1")
    alone = shared.groupBy("rep").agg(F.count(F.lit(1)).alias("alone"))
    n = (F.octet_length("codes") / 8).cast("long")
    x = sets.select("rep", n.alias("n")).join(alone, "rep", "left")
    x = x.select("rep", "n", (F.col("n") - F.coalesce(F.col("alone"), F.lit(0))).alias("shared"))
    return x.filter(100 * F.col("shared") >= percent * F.col("n"))


def _similar(pairs: DataFrame, regs: DataFrame, bound: int) -> DataFrame:
    """Pairs (a, b) whose registers agree in ``bound`` places or more."""
    x = pairs.join(regs.select(F.col("rep").alias("a"), F.col("regs").alias("ra")), "a") \
        .join(regs.select(F.col("rep").alias("b"), F.col("regs").alias("rb")), "b")
    return x.select("a", "b", "ra", "rb").mapInArrow(_agree("ra", "rb", bound), "a long, b long")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    x = pairs.join(sets.select(F.col("rep").alias("a"), F.col("codes").alias("ca")), "a") \
        .join(sets.select(F.col("rep").alias("b"), F.col("codes").alias("cb")), "b")
    return x.select("a", "b", "ca", "cb").mapInArrow(_confirm(percent), "a long, b long")


def _across(rest: DataFrame, bound: int, percent: int) -> DataFrame:
    """Pairs of group members in different components that look similar, found block against block.

    A group has a main component and others.  Members of either part are dealt
    by hash to blocks of about BLOCK; blocks of the others meet each other and
    the blocks of the main part, whose members need not meet among themselves.
    """
    main = F.col("comp") == F.col("main")
    blocks_of = lambda n: F.greatest(F.lit(1), F.ceil(n / BLOCK)).cast("long")
    x = rest.select("band", "rep", "comp", "regs", "n", "shared", main.alias("in_main"),
                    blocks_of(F.col("n_main")).alias("nm"), blocks_of(F.col("size") - F.col("n_main")).alias("no"))
    x = x.withColumn("block", F.pmod(F.xxhash64("rep", "band"), F.when(F.col("in_main"), F.col("nm")).otherwise(F.col("no"))))
    blocks = x.groupBy("band", "in_main", "block", "nm", "no").agg(
        F.collect_list("rep").alias("i"), F.collect_list("comp").alias("c"), F.collect_list("regs").alias("r"),
        F.collect_list("n").alias("n"), F.collect_list("shared").alias("s"))
    zero = F.lit(0).cast("long")
    met = F.concat(
        F.transform(F.sequence(F.col("block"), F.col("no") - 1), lambda t: F.struct(F.lit(False).alias("in_main"), t.alias("block"))),
        F.transform(F.sequence(zero, F.col("nm") - 1), lambda t: F.struct(F.lit(True).alias("in_main"), t.alias("block"))))
    one = blocks.filter("not in_main").select("band", F.col("block").alias("of"), F.explode(met).alias("t"),
                                              F.col("i").alias("ia"), F.col("c").alias("ca"), F.col("r").alias("ra"),
                                              F.col("n").alias("na"), F.col("s").alias("sa")) \
        .select("band", "of", "t.in_main", "t.block", "ia", "ca", "ra", "na", "sa")
    last = F.when(F.col("in_main"), F.col("no") - 1).otherwise(F.col("block"))
    two = blocks.select("band", F.explode(F.sequence(zero, last)).alias("of"), "in_main", "block",
                        F.col("i").alias("ib"), F.col("c").alias("cb"), F.col("r").alias("rb"),
                        F.col("n").alias("nb"), F.col("s").alias("sb"))
    return one.join(two, ["band", "of", "in_main", "block"]) \
        .select("band", "ia", "ca", "ra", "na", "sa", "ib", "cb", "rb", "nb", "sb") \
        .mapInArrow(_cross_batches(bound, percent), "a long, b long").distinct()
