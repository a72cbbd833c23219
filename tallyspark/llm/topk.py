"""Exact top-k inner-product search with MaxScore.

Vectors are turned into integer impacts floor(scale * x).  A query term is a
dimension with its weight; the term's postings in a shard are the rows whose
impact has the weight's sign, ordered by impact, and the largest impact bounds
what the term can add.

Method: rows are packed into shards of ``SHARD_ROWS``, queries into blocks of
``QUERY_ROWS``, and every shard meets every block once (a stated query set
against all rows, in blocks).  In a cell each query sorts its terms by bound;
terms whose bounds together stay below the threshold (the k-th best score so
far, first taken from the strongest postings) are non-essential.  Rows of the
essential terms' postings are scored on those terms and probed in the others, a
few terms at a time, only while their partial score plus the remaining bounds
can still reach the threshold.  Cells return k rows per query, merged by rank.

Defined cases: vectors that are null, empty or hold null or non-finite
components, and rows with a null id, take no part; shorter vectors count as
zero in the missing dimensions; rows of one id, equal or not, are rows of their
own, and if the id is a query the k best answers to all its rows are kept (an id
never answers itself); fewer rows than k give all of them; ties go to the
smaller id.  Impacts and scores are exact in 64 bits while |score| < 2 ** 53.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.llm.common import stored

SHARD_ROWS = 8192
QUERY_ROWS = 8192
STEP = 8                # terms probed between two prunings

PACK = "block long, ids binary, rows int, dims int, data binary"
HITS = "query_id long, vec_id long, score long"


def impacts(vectors: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """(vec_id, v): the rows that take part, impacts as array of long."""
    x = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))
    big = F.lit(float("inf"))
    bad = F.exists("v", lambda t: t.isNull() | F.isnan(t) | (F.abs(t) == big))
    x = x.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & ~bad)
    v = F.transform("v", lambda t: F.floor(F.lit(float(scale)) * t).cast("long"))
    return x.select("vec_id", v.alias("v"))


def _pack(limit: float):
    """Rows (vec_id, v, block) to packed rows: one per block value in sequence, of at most ``limit`` vectors."""
    schema = pa.schema([("block", pa.int64()), ("ids", pa.binary()), ("rows", pa.int32()), ("dims", pa.int32()),
                        ("data", pa.binary())])

    def emit(ids, rows, block):
        d = max(len(r) for r in rows)
        m = np.zeros((len(rows), d), dtype=np.int64)
        for i, r in enumerate(rows):
            m[i, :len(r)] = r
        small = m.astype(np.int16) if np.abs(m).max() < 1 << 15 else m
        data = small.tobytes()
        return pa.RecordBatch.from_arrays(
            [pa.array([block], pa.int64()), pa.array([np.array(ids, dtype=np.int64).tobytes()], pa.binary()),
             pa.array([len(rows)], pa.int32()), pa.array([d], pa.int32()), pa.array([data], pa.binary())], schema=schema)

    def run(batches):
        ids, rows, held = [], [], None
        for b in batches:
            for i, r, block in zip(*(b.column(c).to_pylist() for c in range(3))):
                if ids and (len(ids) >= limit or block != held):
                    yield emit(ids, rows, held)
                    ids, rows = [], []
                held = block
                ids.append(i)
                rows.append(r)
        if ids:
            yield emit(ids, rows, held)
    return run


def _matrix(data: bytes, rows: int, dims: int) -> np.ndarray:
    kind = np.int16 if len(data) == 2 * rows * dims else np.int64
    return np.frombuffer(data, dtype=kind).reshape(rows, dims).astype(np.float64)


def search_shard(ids: np.ndarray, x: np.ndarray, qids: np.ndarray, q: np.ndarray, k: int):
    """Top k of the shard for every query, by MaxScore: yields (query, ids, scores)."""
    d = max(x.shape[1], q.shape[1])
    x, q = (np.pad(m, ((0, 0), (0, d - m.shape[1]))) for m in (x, q))
    cols = np.ascontiguousarray(x.T)
    order = np.argsort(cols, axis=1, kind="stable")              # postings by impact, both signs
    top, low = cols.max(axis=1), cols.min(axis=1)
    first_pos = np.array([np.searchsorted(cols[t][order[t]], 0, side="right") for t in range(d)])
    last_neg = np.array([np.searchsorted(cols[t][order[t]], 0, side="left") for t in range(d)])
    for qid, w in zip(qids, q):
        bound = np.maximum(np.maximum(w * top, w * low), 0.0)
        terms = np.argsort(-bound, kind="stable")
        rest = np.concatenate([np.cumsum(bound[terms][::-1])[::-1], [0.0]])    # rest[i]: bounds of terms i..
        n = 2 * k + 1
        strong = [order[t][-n:] if w[t] > 0 else order[t][:n] for t in terms[:4]]
        seed = np.unique(np.concatenate(strong))
        seed = seed[ids[seed] != qid]
        threshold = -np.inf
        if len(seed) >= k:
            s = x[seed] @ w
            threshold = np.partition(s, len(s) - k)[len(s) - k]
        # essential: the leading terms without which the others' bounds stay below the threshold
        essential = int(np.searchsorted(-rest, -threshold, side="right")) if np.isfinite(threshold) and threshold > 0 else 0
        if essential:
            seen = np.zeros(len(ids), dtype=bool)
            for t in terms[:essential]:
                if seen.all():
                    break
                seen[order[t][first_pos[t]:] if w[t] > 0 else order[t][:last_neg[t]]] = True
            cand = np.flatnonzero(seen)
        else:
            essential, cand = min(d, STEP), np.arange(len(ids))
        cand = cand[ids[cand] != qid]
        score = w[terms[:essential]] @ cols[np.ix_(terms[:essential], cand)] if len(cand) < len(ids) // 2 \
            else (w[terms[:essential]] @ cols[terms[:essential]])[cand]
        at = essential
        while True:
            if len(cand) > k:
                alive = score + rest[min(at, d)] >= threshold
                cand, score = cand[alive], score[alive]
            if at >= d:
                break
            probe = terms[at:at + STEP]
            score = score + w[probe] @ cols[np.ix_(probe, cand)]
            at += STEP
        best = np.lexsort((ids[cand], -score))[:k]
        yield qid, ids[cand[best]], score[best].astype(np.int64)


def _cells(k: int):
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                r = {c: b.column(c)[i].as_py() for c in b.schema.names}
                ids, qids = np.frombuffer(r["ids"], dtype=np.int64), np.frombuffer(r["qids"], dtype=np.int64)
                x, q = _matrix(r["data"], r["rows"], r["dims"]), _matrix(r["qdata"], r["qrows"], r["qdims"])
                out = [(np.full(len(v), qid, dtype=np.int64), v, s) for qid, v, s in search_shard(ids, x, qids, q, k)]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], schema=schema)
    return run


def top_k(vectors: DataFrame, queries: Column, k: int = 20, scale: int = 64, id_col: str = "vec_id",
          vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest inner products of every row for which ``queries`` holds.

    ``queries`` is a condition on the column vec_id; candidates are all other rows.
    """
    rows = stored(impacts(vectors, id_col, vec_col, scale), "impacts")
    shards = rows.withColumn("block", F.lit(0).cast("long")).mapInArrow(_pack(SHARD_ROWS), PACK).drop("block")
    asked = rows.filter(queries)
    n = max(1, -(-asked.count() // QUERY_ROWS))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(n))).repartition(n, "block") \
        .sortWithinPartitions("block").mapInArrow(_pack(float("inf")), PACK)
    # every shard meets every query block; the shards' salt spreads the cells of a block over all tasks
    salts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left = shards.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))) \
        .withColumn("salt", F.pmod(F.xxhash64("ids"), F.lit(salts)).cast("int"))
    right = asked.select("block", *[F.col(c).alias(f"q{c}") for c in ("ids", "rows", "dims", "data")],
                         F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    cells = left.join(right, ["block", "salt"])
    hits = cells.mapInArrow(_cells(k), HITS)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k) \
        .select("query_id", "rank", "vec_id", "score")
