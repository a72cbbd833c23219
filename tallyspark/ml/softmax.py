"""Category classifier with a counted vocabulary and a solver that converges (H8, H9).

The model of ``category.py`` (word 1- and 2-gram TF-IDF, L2-normalised rows, multinomial logistic
regression with an L2 penalty of C = 1 and a free intercept) without its two short cuts:

* The vocabulary is counted, not hashed: terms ranked by their number of occurrences, then by text.  The model is a
  table (term, idf, one weight per class) of ``max_terms`` rows at most, which goes to the tasks when rows are judged.
* The objective, mean log loss + ||W||^2 / (2 n), is minimised as it stands by L-BFGS whose first step is scaled by
  the diagonal of the curvature bound (penalty + mean squared feature / 4): rare terms, whose curvature is almost the
  penalty alone, then need no small steps.  It ends when the gradient's largest entry is at most ``tol``.

Rows are counted where they are read and kept in blocks (one row of Spark holds the numbers of many notes as bytes),
so that no (note, term) pair is shuffled; what is shuffled are the distinct terms of every block, and the gradients.
Every step is one Spark job over the stored blocks: as many tasks as there are cores sum loss and gradient of their rows
in numpy, Spark groups and adds them per block of terms.  The driver holds the terms and weights, ``max_terms`` x classes
numbers at most, and ``MEMORY`` pairs of earlier steps.

Defined cases: rows without note or category do not train; a note without known terms is judged by the intercepts;
one class only gives that class; no training rows give None; equal rows count each; ties of classes go to the first in
alphabetical order.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import RegexTokenizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.ml.category import TOKEN_PATTERN
from tallyspark.operators.filters import labelled_notes
from tallyspark.session import checkpoint_dir, ship_package

MAX_TERMS = 1 << 20         # bound of the model: terms beyond it (the rarest) are left out
MEMORY = 10
MAX_STEPS = 200
PIECE = 1 << 20             # numbers (words; terms x classes) that a task handles at once
TOL = 1e-5

# many notes: category, terms and counts of each; its distinct terms with their notes and occurrences
COUNTED = "n long, cats array<string>, y binary, ends binary, code binary, tf binary, terms array<string>, df array<long>, total array<long>"
WEIGHED = "y binary, ends binary, i binary, v binary"
# a row is a block of some MB: writers and readers must not wait for a hundred of them
BLOCK_FILES = {"parquet.block.size": 16 << 20, "parquet.block.size.row.check.min": 1, "parquet.page.size.row.check.min": 1}
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


@dataclass
class SoftmaxModel:
    terms: DataFrame            # term, idf, w (one weight per class)
    bias: list[float]
    labels: list[str]
    steps: int
    gradient: float             # largest entry at the end
    objective: float


def _stored(df: DataFrame, name: str, **options) -> DataFrame:
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/tally-softmax-{name}-{uuid.uuid4().hex[:12]}"
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def _few_blocks(spark: SparkSession):
    """Jobs started inside hand two blocks at a time to Python."""
    before = spark.conf.get(BATCH)
    spark.conf.set(BATCH, "2")
    try:
        yield
    finally:
        spark.conf.set(BATCH, before)


def tokenised(rows: DataFrame) -> DataFrame:
    """``rows`` with the words of the note."""
    return RegexTokenizer(inputCol="note", outputCol="words", pattern=TOKEN_PATTERN, gaps=False, toLowercase=True, minTokenLength=1).transform(rows)


def _pieces(words: pa.Array):
    """(low, high) of rows with about ``PIECE`` words."""
    ends = np.cumsum(pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False))
    low = 0
    while low < len(words):
        high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + PIECE, side="right")))
        yield low, high
        low = high


def count_terms(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Word 1- and 2-grams of rows (lists of words): (row, code, count) in order, and the term of every code."""
    lengths = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False)
    coded = words.flatten().dictionary_encode()
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    single, code = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(lengths)), lengths)
    inside = row[1:] == row[:-1]
    pairs, pair = np.unique(code[:-1][inside] * max(1, len(single)) + code[1:][inside], return_inverse=True)
    first, second = (single.take(pa.array(x)) for x in np.divmod(pairs, max(1, len(single))))
    terms = pa.concat_arrays([single, pc.binary_join_element_wise(first, second, " ")])     # no word holds a space
    size = max(1, len(terms))
    key, tf = np.unique(np.concatenate([row * size + code, row[1:][inside] * size + len(single) + pair]), return_counts=True)
    return key // size, key % size, tf, terms


def _lists(values: pa.Array) -> pa.Array:
    """One list that holds all values."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _count_batches(batches):
    schema = pa.schema([("n", pa.int64()), ("cats", pa.list_(pa.string())), *[(c, pa.binary()) for c in ("y", "ends", "code", "tf")],
                        ("terms", pa.list_(pa.string())), ("df", pa.list_(pa.int64())), ("total", pa.list_(pa.int64()))])
    for b in batches:
        words, category = b.column("words"), b.column("category")
        for low, high in _pieces(words):
            row, code, tf, terms = count_terms(words[low:high])
            cats = category[low:high].dictionary_encode()
            ends = np.searchsorted(row, np.arange(high - low + 1))
            df, total = np.bincount(code, minlength=len(terms)), np.bincount(code, tf, len(terms)).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array([high - low]), _lists(cats.dictionary.cast(pa.string())),
                 *[pa.array([x.astype(np.int32).tobytes()], pa.binary()) for x in (cats.indices.to_numpy(zero_copy_only=False), ends, code, tf)],
                 _lists(terms.cast(pa.string())), _lists(pa.array(df, pa.int64())), _lists(pa.array(total, pa.int64()))], schema=schema)


def _weigh_batches(bc):
    """Counted blocks to weighed ones: terms outside the vocabulary leave, every row gets length 1."""
    schema = pa.schema([(c, pa.binary()) for c in ("y", "ends", "i", "v")])

    def run(batches):
        vocabulary, idf, labels = bc.value
        for b in batches:
            for r in range(b.num_rows):
                y, ends, code, tf = (np.frombuffer(b.column(c)[r].as_py(), np.int32) for c in ("y", "ends", "code", "tf"))
                number = pc.index_in(b.column("cats")[r].values, value_set=labels).to_numpy(zero_copy_only=False).astype(np.int32)
                i, v, row = _vectors(np.repeat(np.arange(len(y)), np.diff(ends)), code, tf, b.column("terms")[r].values, vocabulary, idf, len(y))[:3]
                out = (number[y], np.searchsorted(row, np.arange(len(y) + 1)).astype(np.int32), i.astype(np.int32), v)
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in out], schema=schema)
    return run


def _vectors(row, code, tf, terms: pa.Array, vocabulary: pa.Array, idf: np.ndarray, n: int):
    """(term number, value, row) of the known terms of ``n`` rows, every row of length 1."""
    known = pc.fill_null(pc.index_in(terms, value_set=vocabulary), -1).to_numpy(zero_copy_only=False)[code]
    row, tf, known = row[known >= 0], tf[known >= 0], known[known >= 0]
    x = tf * idf[known]
    norm = np.sqrt(np.bincount(row, x * x, n))
    return known, x / norm[row], row


def _blocks_of_terms(total: np.ndarray, rest: np.ndarray | None):
    """Sums (k, terms) as rows (b, g) per block of ``_block(k)`` terms that holds any; b = -1: ``rest``."""
    schema = pa.schema([("b", pa.int32()), ("g", pa.binary())])
    size = _block(len(total))
    found = [(n, part) for n in range(-(-total.shape[1] // size)) if (part := total[:, n * size:(n + 1) * size]).any()]
    for n, part in ([(-1, rest)] if rest is not None else []) + found:
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int32()), pa.array([part.tobytes()], pa.binary())], schema=schema)


def _square_batches(size: int):
    """Weighed blocks to sums of squares per term."""
    def run(batches):
        total = np.zeros((1, size))
        for b in batches:
            for r in range(b.num_rows):
                i, v = np.frombuffer(b.column("i")[r].as_buffer(), np.int32), np.frombuffer(b.column("v")[r].as_buffer())
                total[0] += np.bincount(i, v * v, size)
        yield from _blocks_of_terms(total, None)
    return run


def _gradient_batches(bc, k: int):
    """Weighed blocks to sums per block of ``_block(k)`` terms (b >= 0: gradient; -1: intercepts, then loss)."""
    def run(batches):
        w, bias = bc.value
        total, rest = np.zeros_like(w), np.zeros((2, k))
        for b in batches:
            for r in range(b.num_rows):
                labels, ends, terms = (np.frombuffer(b.column(c)[r].as_buffer(), np.int32) for c in ("y", "ends", "i"))
                values = np.frombuffer(b.column("v")[r].as_buffer())
                low = 0
                while low < len(labels):        # rows in pieces, so that rows x classes and terms of a piece stay a few MB
                    high = max(low + 1, min(int(np.searchsorted(ends, ends[low] + 2 * PIECE, side="right")) - 1, low + PIECE // k))
                    y, idx, val = labels[low:high], terms[ends[low]:ends[high]].astype(np.int64), values[ends[low]:ends[high]]
                    row, rows = np.repeat(np.arange(high - low), np.diff(ends[low:high + 1])), np.arange(high - low)
                    low = high
                    each = np.empty(len(val))
                    z = np.empty((k, len(y)))
                    for j in range(k):
                        np.multiply(np.take(w[j], idx, out=each, mode="clip"), val, out=each)
                        z[j] = np.bincount(row, each, len(y)) + bias[j]
                    z -= z.max(axis=0)
                    p = np.exp(z, out=z)
                    p /= p.sum(axis=0)
                    rest[1, 0] -= np.log(p[y, rows]).sum()
                    p[y, rows] -= 1
                    rest[0] += p.sum(axis=1)
                    _add_products(total, idx, val, p, row, each)
        yield from _blocks_of_terms(total, rest)
    return run


def _add_products(total: np.ndarray, idx: np.ndarray, val: np.ndarray, p: np.ndarray, row: np.ndarray, each: np.ndarray) -> None:
    """Add value times residual of every (row, term) to the sums (k, terms)."""
    found = None
    if total.shape[1] > 4 * len(idx):       # few of the terms occur
        found, idx = np.unique(idx, return_inverse=True)
    for j in range(len(total)):
        np.multiply(np.take(p[j], row, out=each, mode="clip"), val, out=each)
        if found is None:
            total[j] += np.bincount(idx, each, total.shape[1])
        else:
            total[j, found] += np.bincount(idx, each, len(found))


def _block(k: int) -> int:
    return max(1, PIECE // 16 // k)


def _sums(place: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
    """(n, k) sums of the rows of ``x`` by place; places are in ascending order."""
    if x.shape[1] <= 16:
        return np.column_stack([np.bincount(place, x[:, j], n) for j in range(x.shape[1])])
    out = np.zeros((n, x.shape[1]))
    if len(place):
        starts = np.flatnonzero(np.diff(place, prepend=-1))
        out[place[starts]] = np.add.reduceat(x, starts, axis=0)
    return out


def _add_blocks(parts: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(g.as_buffer()) for g in parts.column("g"))
    return pa.table({"b": parts.column("b").slice(0, 1), "g": pa.array([total.tobytes()], pa.binary())})


def _per_core(rows: DataFrame) -> DataFrame:
    """Every task sends sums over all terms, so there are as many as cores, whatever the rows."""
    return rows.coalesce(rows.sparkSession.sparkContext.defaultParallelism)


def _sum_blocks(rows: DataFrame, partial, size: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums (k, size) over the blocks and the rest (2, k): one job; they come back, as many numbers as the model has."""
    with _few_blocks(rows.sparkSession):
        got = _per_core(rows).mapInArrow(partial, "b int, g binary").groupBy("b").applyInArrow(_add_blocks, "b int, g binary").toArrow()
    total, rest, step = np.zeros((k, size)), np.zeros((2, k)), _block(k)
    for b, g in zip(got["b"].to_pylist(), got["g"]):
        if b < 0:
            rest = np.frombuffer(g.as_buffer()).reshape(2, k)
        else:
            total[:, b * step:(b + 1) * step] = np.frombuffer(g.as_buffer()).reshape(k, -1)
    return total, rest


def _evaluate(rows: DataFrame, w: np.ndarray, bias: np.ndarray, n: int):
    """Objective and gradients."""
    bc = rows.sparkSession.sparkContext.broadcast((w, bias))
    gw, rest = _sum_blocks(rows, _gradient_batches(bc, len(w)), w.shape[1], len(w))
    bc.destroy()
    return rest[1, 0] / n + (w * w).sum() / (2 * n), gw / n + w / n, rest[0] / n


def minimise(value, start: np.ndarray, scale: np.ndarray, tol: float = TOL, max_steps: int = MAX_STEPS):
    """L-BFGS with a diagonal first guess (1 / scale): (x, steps, largest gradient entry, objective)."""
    x = start
    f, g = value(x)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    step = 0
    spare = np.empty_like(x)        # as long as the model: new memory for every term of the sum costs more than the sum
    while step < max_steps and np.abs(g).max(initial=0.0) > tol:
        step += 1
        d, alphas = -g, []
        for s, y in reversed(pairs):
            a = (s @ d) / (s @ y)
            alphas.append(a)
            d -= np.multiply(y, a, out=spare)
        d /= scale
        for (s, y), a in zip(pairs, reversed(alphas)):
            d += np.multiply(s, a - (y @ d) / (s @ y), out=spare)
        slope, t = g @ d, 1.0
        while True:         # Armijo; the problem is convex, so the curvature condition holds for accepted steps
            f_new, g_new = value(x + t * d)
            if f_new <= f + 1e-4 * t * slope or t < 1e-8:
                break
            t /= 2
        s, y = t * d, g_new - g
        if s @ y > 1e-16:
            pairs = [*pairs, (s, y)][-MEMORY:]
        x, f, g = x + s, f_new, g_new
    return x, step, float(np.abs(g).max(initial=0.0)), f


def _vocabulary(counted: DataFrame, max_terms: int) -> pa.Table:
    """(term, df): the first ``max_terms`` by occurrences, then by text, in that order."""
    terms = counted.select(F.explode(F.arrays_zip("terms", "df", "total")).alias("t")).select("t.*")
    terms = _stored(terms.groupBy(F.col("terms").alias("term")).agg(F.sum("df").alias("df"), F.sum("total").alias("total")), "terms")
    least, left = 0, max_terms
    for total, n in sorted(((r[0], r[1]) for r in terms.groupBy("total").count().collect()), reverse=True):    # distinct totals: far fewer than terms
        least, left = total, left - n
        if left <= 0:
            break
    return terms.filter(F.col("total") >= least).orderBy(F.desc("total"), "term").limit(max_terms).select("term", "df").toArrow()


def fit_softmax(df: DataFrame, max_terms: int = MAX_TERMS, tol: float = TOL) -> SoftmaxModel | None:
    """H8: fit on rows with both note and category."""
    spark = df.sparkSession
    ship_package(spark)
    counted = _stored(tokenised(labelled_notes(df).select("note", "category")).select("words", "category").mapInArrow(_count_batches, COUNTED),
                      "counted", **BLOCK_FILES)
    labels = sorted((r[0] for r in counted.select(F.explode("cats")).distinct().collect()), key=str.encode)     # classes: a few
    n, k = counted.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0], len(labels)
    if n == 0:
        return None
    top = _vocabulary(counted, max_terms)
    size = top.num_rows
    vocabulary = pa.concat_arrays(top["term"].chunks) if size else pa.array([], pa.string())
    idf = np.log((n + 1.0) / (top["df"].to_numpy() + 1.0)) + 1.0
    bc = spark.sparkContext.broadcast((vocabulary, idf, pa.array(labels, pa.string())))
    with _few_blocks(spark):
        rows = _stored(counted.select("cats", "y", "ends", "code", "tf", "terms").mapInArrow(_weigh_batches(bc), WEIGHED), "weighed", **BLOCK_FILES)
    bc.destroy()
    square = _sum_blocks(rows, _square_batches(size), size, 1)[0][0]
    scale = np.concatenate([np.tile(1 / n + square / (4 * n), k), np.full(k, 0.25)])

    def value(x):
        f, gw, gb = _evaluate(rows, x[:-k].reshape(k, size), x[-k:], n)
        return f, np.concatenate([gw.ravel(), gb])

    x, steps, gradient, objective = minimise(value, np.zeros((size + 1) * k), scale, tol)
    table = pa.table({"term": vocabulary, "idf": pa.array(idf, pa.float64()),       # an Arrow table: rows of numpy numbers are refused where
                      "w": pa.ListArray.from_arrays(np.arange(size + 1, dtype=np.int32) * k, x[:-k].reshape(k, size).T.ravel())})      # sessions convert row by row
    terms = _stored(spark.createDataFrame(table, "term string, idf double, w array<double>"), "model")
    return SoftmaxModel(terms, x[-k:].tolist(), labels, steps, gradient, objective)


def predict_softmax(model: SoftmaxModel, df: DataFrame) -> DataFrame:
    """Rows with a note, with ``predicted`` and its ``probability``; rows are judged where they are read."""
    spark, k = df.sparkSession, len(model.labels)
    ship_package(spark)
    table = model.terms.toArrow().combine_chunks()      # of max_terms rows at most
    columns = [pa.concat_arrays(table[c].chunks) if table.num_rows else pa.array([], table.schema.field(c).type) for c in ("term", "idf", "w")]
    weights = columns[2].flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
    bc = spark.sparkContext.broadcast((columns[0], columns[1].to_numpy(zero_copy_only=False), weights, np.array(model.bias)))

    @F.arrow_udf("struct<best int, probability double>")
    def judged(words: pa.Array) -> pa.Array:
        vocabulary, idf, w, bias = bc.value
        best, share = [], []
        for low, high in _pieces(words):
            row, code, tf, terms = count_terms(words[low:high])
            i, v, row = _vectors(row, code, tf, terms, vocabulary, idf, high - low)
            z = _sums(row, v[:, None] * w[i], high - low) + bias
            best.append(z.argmax(axis=1))
            share.append(1.0 / np.exp(z - z.max(axis=1, keepdims=True)).sum(axis=1))
        return pa.StructArray.from_arrays([pa.array(np.concatenate(best) if best else [], pa.int32()),
                                           pa.array(np.concatenate(share) if share else [], pa.float64())], ["best", "probability"])

    keep = [F.col(f"`{c}`").alias(f"column{n}") for n, c in enumerate(df.columns)]
    rows = tokenised(df.filter(F.col("note").isNotNull()).select(*keep, F.col("note").alias("note")))
    scored = rows.select(*[f"column{n}" for n in range(len(keep))], judged("words").alias("judged"))
    return scored.select(*[F.col(f"column{n}").alias(c) for n, c in enumerate(df.columns)],
                         F.element_at(F.array(*[F.lit(c) for c in model.labels]), F.col("judged.best") + 1).alias("predicted"),
                         F.col("judged.probability").alias("probability"))


def evaluate_softmax(model: SoftmaxModel, df: DataFrame) -> DataFrame:
    """H9: accuracy on labelled rows (0 when none), as a one-row frame."""
    p = predict_softmax(model, labelled_notes(df))
    return p.agg(F.coalesce(F.avg((F.col("predicted") == F.col("category")).cast("double")), F.lit(0.0)).alias("accuracy"),
                 F.count(F.lit(1)).alias("n_test"))
