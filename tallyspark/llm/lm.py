"""Masked pseudo-likelihood scoring with a bidirectional window network trained in numpy.

Method
  * Vocabulary from the whole corpus: words are counted in tasks and summed by
    Spark; the ``FREQUENT`` most frequent words are tokens of their own, all others
    fall into ``VOCABULARY - FREQUENT`` hash buckets, inside which a word has the
    probability of one over the bucket's number of different words.
  * Network: embeddings of the ``CONTEXT`` words on either side, a tanh layer, and a
    two-level softmax (class, then token in its class), so every conditional
    probability is normalised exactly.
  * Training: every position of every document is masked in turn and predicted from
    both sides, once.  Round r trains on the documents with hash mod ``ROUNDS``
    = r, each task by mini-batch AdaGrad over all of its documents, starting from the
    current parameters; a round ends with the average of the tasks' parameters,
    weighted by their tokens and summed in a few tasks first.
  * Scoring: every token of every text is masked in turn and predicted from both
    sides; a document's score is the sum of the log-probabilities.

Defined cases: null or wordless text has no tokens, log-likelihood 0 and a null
mean; an empty corpus gives the untrained network; repeated rows teach and are
scored each; a null id is kept; long texts are scored whole, in pieces; extra
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import arrow_texts, stored, word_codes

CLASSES, PER_CLASS = 32, 32
VOCABULARY = CLASSES * PER_CLASS
FREQUENT = 768
CONTEXT = 2
DIMS, HIDDEN = 12, 24
ROUNDS = 4
BATCH = 4096
RATE = 0.1
PAD = VOCABULARY            # beyond the ends of a text


# ---------------------------------------------------------------- vocabulary
def _count_batches(batches):
    schema = pa.schema([("word", pa.int64()), ("n", pa.int64())])

    def emit(parts):
        w, n = np.unique(np.concatenate(parts), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), pa.array(n.astype(np.int64))], schema=schema)

    parts, held = [], 0
    for _, texts in arrow_texts(batches):
        c = word_codes(texts, "alnum")[0]
        parts.append(c)
        held += len(c)
        if held > 2_000_000:
            yield emit(parts)
            parts, held = [], 0
    if held:
        yield emit(parts)


def vocabulary(docs: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sorted codes of the frequent words, their ids, log number of different words per token)."""
    counts = stored(docs.mapInArrow(_count_batches, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")
    top = counts.orderBy(F.desc("n"), "word").limit(FREQUENT).toPandas()
    codes = top["word"].to_numpy(dtype=np.int64).view(np.uint64)
    order = np.argsort(codes)
    buckets = VOCABULARY - FREQUENT
    b = F.pmod("word", F.lit(buckets))
    kinds = counts.groupBy(b.alias("b")).agg(F.count(F.lit(1)).alias("k")).toPandas()
    log_kinds = np.zeros(VOCABULARY)
    log_kinds[FREQUENT + kinds["b"].to_numpy(dtype=np.int64)] = np.log(kinds["k"].to_numpy(dtype=np.float64))
    return codes[order], order.astype(np.int64), log_kinds


def tokens(codes: np.ndarray, vocab) -> np.ndarray:
    known, ids, _ = vocab
    out = FREQUENT + np.mod(codes.view(np.int64), VOCABULARY - FREQUENT)
    if len(known):
        at = np.minimum(np.searchsorted(known, codes), len(known) - 1)
        hit = known[at] == codes
        out[hit] = ids[at[hit]]
    return out


def contexts(ids: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Tokens at the CONTEXT places before and after every position; PAD beyond the text."""
    doc = np.repeat(np.arange(len(off) - 1), np.diff(off))
    at = np.arange(len(ids))
    cols = []
    for d in [*range(-CONTEXT, 0), *range(1, CONTEXT + 1)]:
        p = at + d
        inside = (p >= off[doc]) & (p < off[doc + 1])
        cols.append(np.where(inside, ids[np.clip(p, 0, max(0, len(ids) - 1))], PAD))
    return np.stack(cols, axis=1) if len(ids) else np.zeros((0, 2 * CONTEXT), dtype=np.int64)


# ---------------------------------------------------------------- network
SHAPES = {"embed": (VOCABULARY + 1, DIMS), "w": (2 * CONTEXT * DIMS, HIDDEN), "b": (HIDDEN,), "wc": (HIDDEN, CLASSES),
          "bc": (CLASSES,), "wt": (CLASSES, HIDDEN, PER_CLASS), "bt": (CLASSES, PER_CLASS)}


def initial(seed: int = 11) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    return {k: (rng.normal(size=s) * (0.1 if len(s) > 1 and k[0] != "b" else 0.0)).astype(np.float32) for k, s in SHAPES.items()}


def pack(p: dict[str, np.ndarray]) -> bytes:
    return b"".join(p[k].astype(np.float32).tobytes() for k in SHAPES)


def unpack(raw: bytes) -> dict[str, np.ndarray]:
    flat, out, at = np.frombuffer(raw, dtype=np.float32), {}, 0
    for k, s in SHAPES.items():
        n = int(np.prod(s))
        out[k] = flat[at:at + n].reshape(s).copy()
        at += n
    return out


def _softmax(z: np.ndarray) -> np.ndarray:
    z -= z.max(axis=1, keepdims=True)
    np.exp(z, out=z)
    z /= z.sum(axis=1, keepdims=True)
    return z


def forward(p, ctx: np.ndarray, y: np.ndarray, gradient: bool = False):
    """Log-probabilities of the targets, and with ``gradient`` the mean gradient of their negative sum."""
    n = len(y)
    x = p["embed"][ctx].reshape(n, -1)
    h = np.tanh(x @ p["w"] + p["b"])
    # tokens are dealt to classes so that frequent ones are spread
    cls, sub = y % CLASSES, y // CLASSES
    pc = _softmax(h @ p["wc"] + p["bc"])
    logp = np.log(np.maximum(pc[np.arange(n), cls], 1e-30))
    order = np.argsort(cls, kind="stable")
    edges = np.searchsorted(cls[order], np.arange(CLASSES + 1))
    g = {k: np.zeros_like(v) for k, v in p.items()} if gradient else None
    dh = np.zeros_like(h) if gradient else None
    for c in range(CLASSES):
        r = order[edges[c]:edges[c + 1]]
        if not len(r):
            continue
        hr = h[r]
        pt = _softmax(hr @ p["wt"][c] + p["bt"][c])
        logp[r] += np.log(np.maximum(pt[np.arange(len(r)), sub[r]], 1e-30))
        if gradient:
            pt[np.arange(len(r)), sub[r]] -= 1
            pt /= n
            g["wt"][c], g["bt"][c] = hr.T @ pt, pt.sum(0)
            dh[r] += pt @ p["wt"][c].T
    if not gradient:
        return logp
    pc[np.arange(n), cls] -= 1
    pc /= n
    g["wc"], g["bc"] = h.T @ pc, pc.sum(0)
    dz = (dh + pc @ p["wc"].T) * (1 - h * h)
    g["w"], g["b"] = x.T @ dz, dz.sum(0)
    dx = (dz @ p["w"].T).reshape(-1, DIMS)
    flat = ctx.ravel()
    g["embed"] = np.stack([np.bincount(flat, dx[:, j], VOCABULARY + 1) for j in range(DIMS)], axis=1).astype(np.float32)
    return logp, g


def step(p, square, ctx, y) -> None:
    """One AdaGrad step in place."""
    _, g = forward(p, ctx, y, gradient=True)
    for k in p:
        square[k] += g[k] * g[k]
        p[k] -= RATE * g[k] / np.sqrt(square[k] + 1e-8)


# ---------------------------------------------------------------- Spark jobs
def _train_batches(bc):
    schema = pa.schema([("n", pa.float64()), ("part", pa.binary())])

    def run(batches):
        vocab, raw = bc.value
        p = unpack(raw)
        square = {k: np.full_like(v, 1e-4) for k, v in p.items()}
        held, n = [], 0

        def learn() -> int:
            """Steps over all held positions, dealt in turn so that every mini-batch spans the held documents."""
            ctx, y = held[0] if len(held) == 1 else (np.concatenate(c) for c in zip(*held))
            k = -(-len(y) // BATCH)
            for j in range(k):
                step(p, square, ctx[j::k], y[j::k])
            held.clear()
            return len(y)

        for _, texts in arrow_texts(batches):
            codes, off = word_codes(texts, "alnum")
            ids = tokens(codes, vocab)
            held.append((contexts(ids, off), ids))
            if sum(len(y) for _, y in held) >= BATCH:
                n += learn()
        if held:
            n += learn()
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([float(n)]), pa.array([pack(p)], pa.binary())], schema=schema)
    return run


def _average_batches(batches):
    total, flat = 0.0, None
    for b in batches:
        for n, part in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            x = n * np.frombuffer(part, dtype=np.float32).astype(np.float64)
            total, flat = total + n, x if flat is None else flat + x
    if flat is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total]), pa.array([(flat / total).astype(np.float32).tobytes()], pa.binary())],
                                         schema=pa.schema([("n", pa.float64()), ("part", pa.binary())]))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text"):
    """(vocabulary, packed parameters) learned from all texts."""
    sc = docs.sparkSession.sparkContext
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).filter(F.col("text").isNotNull())
    vocab, raw = vocabulary(d), pack(initial())
    for r in range(ROUNDS):
        part = d.filter(F.pmod(F.xxhash64("text"), F.lit(ROUNDS)) == r)
        parts = part.mapInArrow(_train_batches(sc.broadcast((vocab, raw))), "n double, part binary")
        few = parts.repartition(8).mapInArrow(_average_batches, "n double, part binary").collect()
        if few:
            total = sum(x["n"] for x in few)
            raw = sum(x["n"] / total * np.frombuffer(x["part"], dtype=np.float32).astype(np.float64)
                      for x in few).astype(np.float32).tobytes()
    return vocab, raw


def _score_batches(bc):
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("log_likelihood", pa.float64())])

    def run(batches):
        vocab, raw = bc.value
        p, kinds = unpack(raw), vocab[2]
        for names, texts in arrow_texts(batches):
            codes, off = word_codes(texts, "alnum")
            ids = tokens(codes, vocab)
            ctx = contexts(ids, off)
            logp = np.concatenate([forward(p, ctx[s:s + BATCH], ids[s:s + BATCH]) for s in range(0, len(ids), BATCH)]
                                  or [np.zeros(0)]).astype(np.float64) - kinds[ids]
            total = np.concatenate([[0.0], np.cumsum(logp)])
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(np.diff(off).astype(np.int64)),
                                              pa.array(total[off[1:]] - total[off[:-1]])], schema=schema)
    return run


def score(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, log_likelihood, mean_log_likelihood) per row."""
    bc = docs.sparkSession.sparkContext.broadcast(model)
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    s = d.mapInArrow(_score_batches(bc), "doc_id long, n_tokens long, log_likelihood double")
    mean = F.when(F.col("n_tokens") > 0, F.col("log_likelihood") / F.col("n_tokens"))
    return s.withColumn("mean_log_likelihood", mean)
