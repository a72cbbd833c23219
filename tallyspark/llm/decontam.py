"""Benchmark decontamination by latent semantic retrieval.

Method, for the benchmark in blocks of ``BLOCK_ITEMS`` pieces of items (a stated query set):
  1. One scan turns texts into ids of benchmark words (-1: any other word),
     stored in the shared folder; all later passes read this small table.
  2. Document frequencies over all passages of ``PASSAGE`` words.  Steps 2 to 4 see an item
     as pieces of at most ``PIECE`` words, step 5 as a whole.  Each piece is
     represented by its rarest half, ``MIN_TERMS`` terms at least; a term weighs
     idf / sqrt(df), so that every term has a like share in the decomposition.
  3. Distributed randomised SVD of the TF-IDF matrix of all passages, with the
     items themselves as heavy rows so that the latent space spans them: two
     passes of partial products, summed by Spark (terms x dimensions, bounded by
     the benchmark), QR and a small eigenproblem on the driver.
  4. Cosine search: windows of ``WINDOW`` words, half a window apart, of every
     document are compared with all items in the latent space; the window's
     norm is its full TF-IDF norm, so one shared rare word is no match.
  5. Candidates with cosine ``MIN_COSINE`` or more, and windows that hold ``MIN_SHARE``
     of a piece's own terms, however frequent these are and whatever stands beside
     them, are checked by the longest common subsequence of words around the window:
     contaminated from ``LCS_SURE`` of the item's words, or from ``LCS_LIKELY`` if the
     answer, the item's last sentence, is found by ``ANSWER`` of its words.

Model and item vectors are broadcast: their size is bounded by the block of items.

Defined cases: null or empty texts and items match nothing; an item without
words is never found; equal items are reported each; a null doc_id takes no
part; repeated rows give one result; long texts are searched whole; an empty
benchmark or corpus gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import arrow_texts, stored, word_codes

BLOCK_ITEMS = 256
PASSAGE = 64
WINDOW = 32
MIN_TERMS = 8
EXTRA_DIMS = 16             # latent dimensions beyond the number of items
ITEM_WEIGHT = 100.0
MIN_COSINE = 0.3
MIN_SHARE = 0.3             # two windows and a half hold any 64 words, so one has a third of their terms
LCS_SURE, LCS_LIKELY, ANSWER = 0.75, 0.6, 0.75
PIECE = 2 * WINDOW          # longer items are retrieved by pieces of at most this many words

RESULT = "doc_id long, item_id long, cosine double, lcs double, answer double, start_word int, end_word int"


# ---------------------------------------------------------------- items and ids
def items_of(benchmark: DataFrame, id_col: str, text_col: str) -> list[tuple[int, np.ndarray, int]]:
    """(item id, word codes, first word of the answer); the benchmark is a bounded table."""
    rows = benchmark.select(F.col(id_col).cast("long"), F.col(text_col)).filter(F.col(id_col).isNotNull()).collect()
    out = []
    for i, t in sorted((r[0], r[1] or "") for r in rows):
        sentences = [s for s in re.split(r"(?<=[.!?])\s+", t) if word_codes([s], "alnum")[0].size]
        codes = word_codes([t], "alnum")[0]
        if not len(codes):
            continue
        answer = len(codes) - (word_codes([sentences[-1]], "alnum")[0].size if sentences else 0)
        answer = answer if 0 < answer <= len(codes) - 3 else max(0, len(codes) - max(3, len(codes) // 3))
        out.append((i, codes, answer))
    return out


def pieces_of(items: list) -> list[tuple[int, int, int]]:
    """(number of the item, first word, end) of equal pieces of at most PIECE words."""
    out = []
    for k, (_, codes, _) in enumerate(items):
        edges = np.linspace(0, len(codes), -(-len(codes) // PIECE) + 1).astype(int).tolist()
        out += [(k, b, e) for b, e in zip(edges[:-1], edges[1:])]
    return out


def _id_batches(bc):
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches):
        vocabulary = bc.value
        for ids, texts in arrow_texts(batches):
            codes, off = word_codes(texts, "alnum")
            at = np.minimum(np.searchsorted(vocabulary, codes), len(vocabulary) - 1)
            terms = np.where(vocabulary[at] == codes, at, -1).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(terms))],
                schema=schema)
    return run


def _flat(batch) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all documents end to end, and their offsets."""
    col = batch.column(batch.schema.get_field_index("ids"))
    off = col.offsets.to_numpy().astype(np.int64)
    return col.values.to_numpy()[off[0]:off[-1]], off - off[0]


def _slots(off: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, int]:
    """Number of the block of ``size`` words that each position lies in; blocks do not cross documents."""
    n = np.diff(off)
    blocks = np.concatenate([[0], np.cumsum(-(-n // size))])
    doc = np.repeat(np.arange(len(n)), n)[at] if len(at) > len(n) else np.searchsorted(off, at, side="right") - 1
    return blocks[doc] + (at - off[doc]) // size, int(blocks[-1])


# ---------------------------------------------------------------- distributed passes
def _df_batches(m: int):
    schema = pa.schema([("term", pa.int32()), ("df", pa.int64())])

    def run(batches):
        total, passages = np.zeros(m, dtype=np.int64), 0
        for b in batches:
            t, off = _flat(b)
            at = np.flatnonzero(t >= 0)
            slot, n = _slots(off, at, PASSAGE)
            passages += n
            step = max(1, 4_000_000 // m)               # passages marked at once: a term counts once in each
            cut = np.searchsorted(slot, np.arange(0, n + step, step))
            for s, e in zip(cut[:-1], cut[1:]):
                if s < e:
                    low = int(slot[s])
                    seen = np.zeros((int(slot[e - 1]) - low + 1, m), dtype=bool)
                    seen[slot[s:e] - low, t[at[s:e]]] = True
                    total += seen.sum(axis=0)
        keep = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(keep, -1).astype(np.int32)),
                                          pa.array(np.append(total[keep], passages))], schema=schema)
    return run


def _product_batches(bc, gram: bool):
    """Partial sums over passages: A^T (A omega), or the Gram matrix of A omega; one binary row per task."""
    def run(batches):
        weight, index, omega = bc.value
        k = omega.shape[1]
        w_omega = (weight[:, None] * omega).astype(np.float32)
        out = np.zeros((k if gram else len(weight), k))
        for b in batches:
            t, off = _flat(b)
            at = np.flatnonzero(t >= 0)
            term = index[t[at]]
            used = term >= 0
            at, term = at[used], term[used]
            if not len(at):
                continue
            for s in range(0, len(at), 50_000):
                a, x = at[s:s + 50_000], term[s:s + 50_000]
                slot, _ = _slots(off, a, PASSAGE)       # a passage cut here is two rows: A's rows only split
                first = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]]))
                z = np.add.reduceat(w_omega[x], first, axis=0)
                if gram:
                    out += z.T @ z
                    continue
                row = np.cumsum(np.concatenate([[0], (slot[1:] != slot[:-1]).astype(np.int64)]))
                order = np.argsort(x, kind="stable")
                xs = x[order]
                head = np.flatnonzero(np.concatenate([[True], xs[1:] != xs[:-1]]))
                out[xs[head]] += weight[xs[head], None] * np.add.reduceat(z[row[order]], head, axis=0)
        yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], schema=pa.schema([("part", pa.binary())]))
    return run


def _sum_batches(batches):
    total = None
    for b in batches:
        for p in b.column(0).to_pylist():
            p = np.frombuffer(p)
            total = p.copy() if total is None else total + p
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], schema=pa.schema([("part", pa.binary())]))


def _summed(parts: DataFrame, shape: tuple[int, int]) -> np.ndarray:
    """Sum of matrices of model size: the square root of their number in tasks, those sums on the driver."""
    tasks = max(2, math.isqrt(parts.rdd.getNumPartitions()))
    rows = parts.repartition(tasks).mapInArrow(_sum_batches, "part binary").collect()
    return sum((np.frombuffer(r[0]).reshape(shape) for r in rows), np.zeros(shape))


def latent_space(ids: DataFrame, weight: np.ndarray, index: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Right singular vectors (terms, dimensions) of passages and heavy item rows, by randomised SVD."""
    sc = ids.sparkSession.sparkContext
    m = len(weight)
    k = min(m, len(rows) + EXTRA_DIMS)
    heavy = ITEM_WEIGHT * rows
    omega = np.random.default_rng(7).normal(size=(m, k))
    y = _summed(ids.mapInArrow(_product_batches(sc.broadcast((weight, index, omega)), False), "part binary"), (m, k))
    y += heavy.T @ (heavy @ omega)
    q, _ = np.linalg.qr(y)
    g = _summed(ids.mapInArrow(_product_batches(sc.broadcast((weight, index, q)), True), "part binary"), (k, k))
    hq = heavy @ q
    values, u = np.linalg.eigh(g + hq.T @ hq)
    return q @ u[:, ::-1]


# ---------------------------------------------------------------- search and checks
def lcs(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, bit-parallel over ``a``."""
    mask: dict[int, int] = {}
    for i, x in enumerate(a):
        mask[x] = mask.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for x in b:
        u = v & mask.get(x, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - bin(v).count("1")


def check(item: list[int], answer: int, words: list[int]) -> tuple[float, float]:
    """Best share of the item's words, and of its answer's words, in order in a stretch of 1.25 times its length."""
    n = len(item)
    size, step = n + max(2, n // 4), max(1, n // 8)
    best = (0.0, 0.0)
    for s in range(0, max(1, len(words) - size + step), step):
        part = words[s:s + size]
        share = lcs(item, part) / n
        if share > best[0]:
            tail = item[answer:]
            best = (share, lcs(tail, part) / max(1, len(tail)))
    return best


def _search_batches(bc):
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("cosine", pa.float64()), ("lcs", pa.float64()),
                        ("answer", pa.float64()), ("start_word", pa.int32()), ("end_word", pa.int32())])
    half = WINDOW // 2

    def run(batches):
        weight, index, similarity, (own_off, own_piece, own_share), of, items = bc.value
        for b in batches:
            t, off = _flat(b)
            names = b.column(0).to_pylist()
            at = np.flatnonzero(t >= 0)
            term = index[t[at]]
            at, term = at[term >= 0], term[term >= 0]
            if not len(at):
                continue
            found: dict[tuple[int, int], list[tuple[float, int]]] = {}
            doc = np.searchsorted(off, at, side="right") - 1
            block = (at - off[doc]) // half + (off[doc] + doc * WINDOW) // half + doc      # increasing, apart between documents
            first = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
            for s in range(0, len(first), 2_000):
                f = first[s:s + 2_001]                  # one more: a window is a half block and the next one
                last = first[s + 2_001] if s + 2_001 < len(first) else len(at)
                dot = np.add.reduceat(similarity[term[f[0]:last]], f - f[0], axis=0)
                norm = np.add.reduceat(weight[term[f[0]:last]] ** 2, f - f[0])
                next_to = (block[f[1:]] == block[f[:-1]] + 1) & (doc[f[1:]] == doc[f[:-1]])
                pair_dot = dot.copy()
                pair_dot[:-1][next_to] += dot[1:][next_to]
                pair_norm = norm.copy()
                pair_norm[:-1][next_to] += norm[1:][next_to]
                row, x = np.divmod(np.unique(np.repeat(np.arange(len(f)), np.diff(np.append(f, last))) * len(weight)
                                             + term[f[0]:last]), len(weight))
                k = own_off[x + 1] - own_off[x]
                i = own_piece[np.repeat(own_off[x] - np.cumsum(k) + k, k) + np.arange(k.sum())]
                share = np.bincount(np.repeat(row, k) * len(of) + i, own_share[i], len(f) * len(of)).reshape(dot.shape)
                pair_share = share.copy()
                pair_share[:-1][next_to] += share[1:][next_to]
                for d_, n_, s_ in ((dot, norm, share), (pair_dot, pair_norm, pair_share)):
                    cos = d_ / np.sqrt(np.maximum(n_, 1e-30))[:, None]
                    for r, i in zip(*np.nonzero((cos >= MIN_COSINE) | (s_ >= MIN_SHARE))):
                        found.setdefault((int(doc[f[r]]), of[i]), []).append((float(cos[r, i]), int(at[f[r]])))
            rows = []
            for (d, i), hits in found.items():
                item_id, words, answer = items[i]
                n = len(words)
                best, done, after = None, -1, -1
                apart = n // 8 if n > PIECE else 0      # hits of a long item closer than this are checked in one
                for _, p in sorted(hits, key=lambda h: h[1]):
                    a, e = max(off[d], p - n - WINDOW), min(off[d + 1], p + n + 2 * WINDOW + apart)
                    if e <= done or p < after:
                        continue
                    done, after = e, p + apart
                    share, tail = check(words, answer, t[a:e].tolist())
                    if best is None or share > best[0]:
                        best = (share, tail, int(a - off[d]), int(e - off[d]))
                if best[0] >= LCS_SURE or best[0] >= LCS_LIKELY and best[1] >= ANSWER:
                    rows.append((names[d], item_id, max(c for c, _ in hits), *best))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(zip(*rows), schema.types)], schema=schema)
    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per contaminated document and item: (doc_id, item_id, cosine, lcs, answer, start_word, end_word)."""
    spark = docs.sparkSession
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")) \
        .filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    out = spark.createDataFrame([], RESULT)
    items = items_of(benchmark, item_col, item_text_col)
    pieces = pieces_of(items)
    for s in range(0, len(pieces), BLOCK_ITEMS):
        block = pieces[s:s + BLOCK_ITEMS]
        first = block[0][0]
        out = out.unionByName(_block(d, items[first:block[-1][0] + 1], [(k - first, b, e) for k, b, e in block]))
    return out.groupBy("doc_id", "item_id").agg(F.max(F.struct("lcs", "answer", "cosine", "start_word", "end_word")).alias("x")) \
        .select("doc_id", "item_id", "x.cosine", "x.lcs", "x.answer", "x.start_word", "x.end_word")


def _block(d: DataFrame, items: list[tuple[int, np.ndarray, int]], pieces: list[tuple[int, int, int]]) -> DataFrame:
    spark = d.sparkSession
    sc = spark.sparkContext
    vocabulary = np.unique(np.concatenate([c for _, c, _ in items]))
    m = len(vocabulary)
    ids = stored(d.mapInArrow(_id_batches(sc.broadcast(vocabulary)), "doc_id long, ids array<int>"), "benchmark-ids")
    counts = ids.mapInArrow(_df_batches(m), "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).toPandas()
    df = np.ones(m)
    known = counts[counts["term"] >= 0]
    df[known["term"].to_numpy()] = np.maximum(1, known["df"].to_numpy())
    passages = max(1, int(counts.loc[counts["term"] < 0, "df"].sum()))

    words = [np.searchsorted(vocabulary, c) for _, c, _ in items]
    parts = [words[k][b:e] for k, b, e in pieces]
    chosen = []
    for w in parts:
        w = np.unique(w)
        chosen.append(w[np.argsort(df[w], kind="stable")][:max(MIN_TERMS, len(w) // 2)])
    terms = np.unique(np.concatenate(chosen))
    index = np.full(m, -1, dtype=np.int64)
    index[terms] = np.arange(len(terms))
    weight = np.log1p(passages / df[terms]) / np.sqrt(df[terms])
    weight /= weight.max()
    rows = np.zeros((len(parts), len(terms)))
    for i, w in enumerate(parts):
        t = index[w]
        np.add.at(rows[i], t[t >= 0], weight[t[t >= 0]])
    space = latent_space(ids, weight, index, rows)
    latent = rows @ space
    latent /= np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-30)
    similarity = ((weight[:, None] * space) @ latent.T).astype(np.float32)
    # pieces that chose each term, and what one term is of a piece's own terms
    sizes = np.array([len(c) for c in chosen])
    term, piece = index[np.concatenate(chosen)], np.repeat(np.arange(len(parts)), sizes)
    order = np.argsort(term, kind="stable")
    own = (np.searchsorted(term[order], np.arange(len(terms) + 1)), piece[order], 1.0 / sizes)
    listed = [(i, w.tolist(), a) for (i, _, a), w in zip(items, words)]
    model = (weight.astype(np.float32), index, similarity, own, [k for k, _, _ in pieces], listed)
    return ids.mapInArrow(_search_batches(sc.broadcast(model)), RESULT)
