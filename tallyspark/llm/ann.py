"""Approximate nearest neighbours by collision-counting hashing.

Method
  * Every hash function is one random projection.  A shard of rows keeps, per
    projection, its projected values in a sorted array.
  * A query's window in each array is centred on the query's own projection;
    virtual rehashing widens it step by step (radius R, factor ``GROWTH``), and only
    the newly covered ends of the arrays are counted.
  * A row whose projections fall into ``threshold`` or more of the ``PROJECTIONS``
    windows is verified: its exact distance is computed, once.
  * A query ends in a shard when its k-th best verified distance is at most R (or
    its windows cover the shard).  Nothing is capped: windows grow until that holds.

The window's half width is ``WIDTH * R``, so a row at distance R or less collides in
each projection with probability erf(WIDTH / sqrt 2) or more, and the threshold is
the largest count that such a row misses with probability ``MISS`` at most.  So each
true neighbour is found with probability 1 - MISS or more, whatever the data.

Rows are packed into shards of ``SHARD_ROWS``, queries into blocks of
``QUERY_ROWS``; every shard meets every block once (a stated query set against all
rows, in blocks).  The shards of a block are dealt over tasks; within a task the
best distances found so far are carried from shard to shard, so later shards stop
at smaller radii.  Tasks return k rows per query, merged by rank.

Defined cases: vectors that are null, empty, zero or hold null or non-finite
components, and rows with a null id, take no part; shorter vectors count as zero in
the missing dimensions; rows of one id, equal or not, are rows of their own, and if the
id is a query the k nearest answers to all its rows are kept (an id is never its own
neighbour); fewer rows than k give all of them; ties go to the smaller id; extra
columns are ignored, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.llm.common import stored

PROJECTIONS = 64
WIDTH = 1.5             # half width of a window, in units of the radius
MISS = 1e-4             # chance that a true neighbour stays below the collision threshold
GROWTH = 1.25           # factor of the radius from one rehashing to the next
SHARD_ROWS = 8192
QUERY_ROWS = 2048
SEED = 20240613
HUGE = 1e150            # beyond it squares overflow: such shards and queries are compared in full

PACK = "block long, kind int, rows int, dims int, ids binary, data binary"
HITS = "query_id long, vec_id long, score double"


def threshold(projections: int = PROJECTIONS, width: float = WIDTH, miss: float = MISS) -> int:
    """Largest count that a row within the radius reaches with probability 1 - miss or more."""
    p = math.erf(width / math.sqrt(2))
    below = 0.0
    for count in range(projections + 1):
        below += math.comb(projections, count) * p ** count * (1 - p) ** (projections - count)
        if below > miss:
            return count        # fewer than ``count`` collisions: probability at most miss
    return projections


def valid(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, v): the rows that take part, components as double."""
    x = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))
    bad = F.exists("v", lambda t: t.isNull() | F.isnan(t) | (F.abs(t) == F.lit(float("inf"))))
    some = F.exists("v", lambda t: t != 0)
    return x.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ~bad & some)


def _pack(kind: int, limit: int):
    """Rows (vec_id, v, block) to packed rows of at most ``limit`` vectors, one block number each."""
    schema = pa.schema([("block", pa.int64()), ("kind", pa.int32()), ("rows", pa.int32()), ("dims", pa.int32()),
                        ("ids", pa.binary()), ("data", pa.binary())])

    def emit(ids, rows, block):
        m = np.zeros((len(rows), max(len(r) for r in rows)))
        for i, r in enumerate(rows):
            m[i, :len(r)] = r
        cells = [block], [kind], [len(rows)], [m.shape[1]], [np.array(ids, dtype=np.int64).tobytes()], [m.tobytes()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, schema.types)], schema=schema)

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


# ---------------------------------------------------------------- one shard
def _projector(dims: int) -> np.ndarray:
    """(dims, PROJECTIONS) standard normal directions; a prefix of the same rows for fewer dimensions."""
    return np.random.default_rng(SEED).standard_normal((dims, PROJECTIONS))


class Shard:
    """Rows with their sorted projection arrays."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids, self.n, self.dims = ids, len(ids), x.shape[1]
        self.columns = np.ascontiguousarray(x.T)
        self.large = bool(np.abs(x).max(initial=0.0) > HUGE)
        self.projector = _projector(self.dims)
        h = (self.projector.T @ self.columns) if not self.large else np.zeros((PROJECTIONS, self.n))
        self.order = np.argsort(h, axis=1, kind="stable").astype(np.int32)
        self.values = np.take_along_axis(h, self.order, axis=1)
        self.slack = 1e-9 * float(np.abs(h).max(initial=0.0))       # rounding of equal vectors' projections

    def distances(self, rows: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Exact distances: squares summed dimension by dimension, in order."""
        d = min(self.dims, len(q))
        total = np.zeros(len(rows))
        for t in range(d):          # one at a time: the order of the additions never depends on how many rows there are
            total += (self.columns[t, rows] - q[t]) ** 2
        for t in range(d, self.dims):
            total += self.columns[t, rows] ** 2
        for t in range(d, len(q)):
            total += q[t] ** 2
        return np.sqrt(total)

    def search(self, qid: int, q: np.ndarray, k: int, least: int, ids: np.ndarray, dist: np.ndarray):
        """The best k of (ids, dist) and this shard's rows, nearest first."""
        if self.large or np.abs(q).max() > HUGE:
            return _best(self.ids, self.distances(np.arange(self.n), q), qid, k, ids, dist)
        d = min(self.dims, len(q))
        centre = q[:d] @ self.projector[:d]
        counts = np.zeros(self.n, dtype=np.int32)
        seen = np.zeros(self.n, dtype=bool)
        probe = np.linspace(0, self.n - 1, min(self.n, 16)).astype(np.int64)
        near = self.distances(probe, q)
        radius = float(near.min()) / 4 or float(near.max()) / 64
        low = high = None
        while True:
            if len(ids) >= k:
                radius = min(radius, float(dist[k - 1]))
            reach = WIDTH * radius + self.slack
            lo = np.array([np.searchsorted(v, c - reach, "left") for v, c in zip(self.values, centre)])
            hi = np.array([np.searchsorted(v, c + reach, "right") for v, c in zip(self.values, centre)])
            if low is None:
                parts = [o[a:b] for o, a, b in zip(self.order, lo, hi)]
            else:       # only the ends that the wider window adds
                parts = [o[a:b] for o, a, b in zip(self.order, lo, low)] + [o[a:b] for o, a, b in zip(self.order, high, hi)]
            counts += np.bincount(np.concatenate(parts), minlength=self.n).astype(np.int32)
            low, high = lo, hi
            fresh = np.flatnonzero((counts >= least) & ~seen)
            if len(fresh):
                seen[fresh] = True
                ids, dist = _best(self.ids[fresh], self.distances(fresh, q), qid, k, ids, dist)
            if (len(ids) >= k and dist[k - 1] <= radius) or (not lo.any() and (hi == self.n).all()):
                return ids, dist
            radius = max(radius * GROWTH, self.slack)


def _best(new_ids, new_dist, qid, k, ids, dist):
    keep = new_ids != qid
    ids, dist = np.concatenate([ids, new_ids[keep]]), np.concatenate([dist, new_dist[keep]])
    order = np.lexsort((ids, dist))[:k]
    return ids[order], dist[order]


def _search_batches(k: int, least: int):
    """Packed rows sorted by (block, salt, kind): a query block, then its shards, the best distances carried along."""
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def done(qids, best):
        n = [len(i) for i, _ in best]
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(qids, n)), pa.array(np.concatenate([i for i, _ in best])),
                                           pa.array(np.concatenate([d for _, d in best]))], schema=schema)

    def run(batches):
        held, qids, q, best = None, None, None, None
        for b in batches:
            for i in range(b.num_rows):
                r = {c: b.column(c)[i].as_py() for c in b.schema.names}
                ids = np.frombuffer(r["ids"], dtype=np.int64)
                x = np.frombuffer(r["data"], dtype=np.float64).reshape(r["rows"], r["dims"])
                if (r["block"], r["salt"]) != held or r["kind"] == 0:
                    if qids is not None:
                        yield done(qids, best)
                    held, qids = (r["block"], r["salt"]), None
                if r["kind"] == 0:
                    qids, q = ids, x
                    best = [(np.zeros(0, dtype=np.int64), np.zeros(0)) for _ in qids]
                elif qids is not None:
                    shard = Shard(ids, x)
                    best = [shard.search(int(t), v, k, least, *found) for t, v, found in zip(qids, q, best)]
        if qids is not None:
            yield done(qids, best)
    return run


# ---------------------------------------------------------------- Spark jobs
def neighbours(vectors: DataFrame, queries: Column, k: int = 10, id_col: str = "vec_id",
               vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows found for every row for which ``queries`` holds.

    ``queries`` is a condition on the column vec_id; candidates are all other rows.
    """
    spark = vectors.sparkSession
    rows = stored(valid(vectors, id_col, vec_col), "vectors")
    packed = stored(rows.withColumn("block", F.lit(0).cast("long")).mapInArrow(_pack(1, SHARD_ROWS), PACK), "shards")
    asked = rows.filter(queries)
    blocks = max(1, -(-asked.count() // QUERY_ROWS))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks))).repartition(blocks, "block") \
        .sortWithinPartitions("block").mapInArrow(_pack(0, 1 << 30), PACK)
    # the shards of a block are dealt over as many tasks as there are, and each gets its own copy of the block's queries
    tasks = max(1, min(packed.count(), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    every = F.explode(F.sequence(F.lit(0), F.lit(tasks - 1)))
    asked = asked.withColumn("salt", every)
    shards = packed.withColumn("salt", F.pmod(F.xxhash64("ids"), F.lit(tasks)).cast("int")).drop("block") \
        .withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    cells = asked.unionByName(shards).repartition("block", "salt").sortWithinPartitions("block", "salt", "kind", "ids")
    hits = cells.mapInArrow(_search_batches(k, threshold()), HITS)
    w = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return hits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k) \
        .select("query_id", "rank", "vec_id", "score")
