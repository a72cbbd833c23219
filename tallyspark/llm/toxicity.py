"""Toxicity: a weighted lexicon matched by Aho-Corasick on folded text.

Method
  * Folding: lower case, homoglyphs to Latin letters (look-alike Cyrillic and Greek
    letters, full-width forms, diacritics dropped), and, inside words that mix
    letters with digits or signs, digit substitutions (1 for i, 0 for o ...); i, l
    and their look-alikes share one letter.  What is no letter becomes a space.
  * Lexicon: word beginnings and whole words, learned with their log-odds weights
    from a bounded sample of ``FIT_DOCS`` labelled documents (smallest hash of
    the id first).  An entry needs a precision of ``MIN_PRECISION`` and
    ``MIN_DOCS`` toxic documents that no stronger entry explains: entries are
    chosen in rounds, the most frequent first, and documents that hold a chosen
    entry no longer count, so words that merely stand beside a toxic one, or
    come from a group of copies, do not enter.
  * Exception phrases: an entry together with the word before or after it, seen
    ``MIN_EXCEPTION`` times or more in clean documents only, cancels the match.
  * Score: the weights found, normalised by the length in words, go through a
    logistic curve fitted on the same sample.

Defined cases: null text counts as empty; a text without matches scores by the
curve at zero; labels other than 0 and 1, null ids and documents without label
teach nothing; an id labelled twice takes its largest label; no usable labels
give an empty lexicon and the score 0; long texts are matched whole; extra
columns are ignored; every row of the input has its row in the result.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import arrow_texts, fold, held_out, stored

FIT_DOCS = 20_000
MIN_DOCS = 5
MIN_PRECISION = 0.9
MIN_EXCEPTION = 5
PREFIX = range(4, 11)

# ---- Fixed values: letters that look like Latin ones, and digits written for letters ----
HOMOGLYPHS = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "у": "y", "і": "i", "ѕ": "s", "ј": "j", "к": "k",
    "м": "m", "т": "t", "в": "b", "н": "h", "ԁ": "d", "ɡ": "g", "α": "a", "ε": "e", "ο": "o", "ρ": "p", "ν": "v",
    "ι": "i", "κ": "k", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ł": "l", "ø": "o",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "i"}
SAME = {"l": "i"}

_MIXED = re.compile(r"[a-z0-9@$!|]*(?:[a-z][0134578@$!|]+[a-z]|(?<![a-z0-9@$!|])[0134578@$][a-z])[a-z0-9@$!|]*")
_TABLE: dict[int, str] = {}


class _Fold(dict):
    """Code point to folded letter or space, filled as characters appear (Unicode has a bounded number)."""

    def __missing__(self, cp: int) -> str:
        c = chr(cp)
        c = HOMOGLYPHS.get(c, c)
        base = unicodedata.normalize("NFKD", c)[:1] if not c.isascii() else c
        base = HOMOGLYPHS.get(base, base)
        out = SAME.get(base, base) if base.isalpha() else " "
        self[cp] = out
        return out


_FOLD = _Fold()
_UNDIGIT = str.maketrans(DIGITS)


def fold_text(text: str) -> str:
    """Folded text: words of letters, single characters in between are spaces; one space at either end."""
    low = text.lower()
    if not low.isascii():
        low = "".join(HOMOGLYPHS.get(c, c) for c in low) if any(c in HOMOGLYPHS for c in set(low)) else low
    low = _MIXED.sub(lambda m: m[0].rstrip("!|$@").translate(_UNDIGIT) + " ", low)
    return " " + low.translate(_FOLD) + " "


# ---------------------------------------------------------------- lexicon
@dataclass
class Lexicon:
    """entries: pattern -> weight, a pattern starts with a space, and ends with one if it is a whole word."""
    entries: dict[str, float] = field(default_factory=dict)
    exceptions: frozenset = frozenset()        # (word before or "", entry, word after or "")
    bias: float = 0.0
    slope: float = 0.0
    known: bool = False

    def automaton(self):
        a = ahocorasick.Automaton()
        for p in self.entries:
            a.add_word(p, p)
        if self.entries:
            a.make_automaton()
        return a


def matches(folded: str, automaton) -> list[tuple[int, str]]:
    """(start, entry), the longest entry at each word start."""
    best: dict[int, str] = {}
    for end, p in automaton.iter(folded):
        start = end - len(p) + 1
        if len(p) > len(best.get(start, "")):
            best[start] = p
    return sorted(best.items())


def context(folded: str, start: int) -> tuple[str, str]:
    """The words before and after the word that starts after position ``start``."""
    left = folded[:start].rstrip(" ") if start < 200 else folded[start - 200:start].rstrip(" ")
    end = folded.find(" ", start + 1)
    right = folded[end:end + 200].lstrip(" ")
    return left[left.rfind(" ") + 1:], right[:right.find(" ")] if " " in right else right


def value(folded: str, automaton, lex: Lexicon) -> float:
    """Weights found, exceptions left out, by the square root of the length in words."""
    if not lex.entries:
        return 0.0
    total = 0.0
    for start, p in matches(folded, automaton):
        if lex.exceptions:
            before, after = context(folded, start)
            if (before, p, "") in lex.exceptions or ("", p, after) in lex.exceptions:
                continue
        total += lex.entries[p]
    return total / math.sqrt(1 + len(folded.split())) if total else 0.0


def _features(folded: str) -> set[str]:
    out = set()
    for w in set(folded.split()):
        out.add(f" {w} ")
        for n in PREFIX:
            if n <= len(w):
                out.add(f" {w[:n]}")
    return out


def _count_batches(only: frozenset | None, explained: Lexicon):
    """(feature, n): documents without a match of ``explained``, by the features they hold (those in ``only``)."""
    schema = pa.schema([("feature", pa.string()), ("n", pa.int64())])

    def run(batches):
        a, n = explained.automaton(), Counter()
        for _, texts in arrow_texts(batches):
            for t in texts:
                f = fold_text(t)
                if explained.entries and next(a.iter(f), None):
                    continue
                f = _features(f)
                n.update(f if only is None else f & only)
            if len(n) > 500_000:
                yield pa.RecordBatch.from_arrays([pa.array(list(n)), pa.array(list(n.values()))], schema=schema)
                n = Counter()
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(list(n)), pa.array(list(n.values()))], schema=schema)
    return run


def _strongest(left: dict[str, int]) -> list[str]:
    """Entries with at least half the largest count, none the beginning of another.

    Of beginnings that hold for nearly the same documents the longest stands for all.
    """
    floor, chosen = max(left.values()) / 2, []
    for p in sorted((p for p in left if left[p] >= floor), key=lambda p: (-left[p], len(p), p)):
        if any(p.startswith(q) or q.startswith(p) for q in chosen):
            continue
        longer = [q for q in left if q.startswith(p) and q[-1] != " " and left[q] >= 0.97 * left[p]]
        best = max(longer, key=lambda q: (len(q), q), default=p)
        if not any(best.startswith(q) or q.startswith(best) for q in chosen):
            chosen.append(best)
    return chosen


def _phrase_batches(lex: Lexicon):
    schema = pa.schema([("label", pa.int32()), ("before", pa.string()), ("entry", pa.string()), ("after", pa.string())])

    def run(batches):
        a = lex.automaton()
        for labels, texts in arrow_texts(batches):
            rows = []
            for label, t in zip(labels, texts):
                f = fold_text(t)
                for start, p in matches(f, a):
                    before, after = context(f, start)
                    rows += [(label, before, p, ""), (label, "", p, after)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
    return run


def _value_batches(lex: Lexicon, names, types):
    schema = pa.schema(list(zip(names, types)))

    def run(batches):
        a = lex.automaton()
        for ids, texts in arrow_texts(batches):
            yield pa.RecordBatch.from_arrays([pa.array(ids, types[0]),
                                              pa.array([value(fold_text(t), a, lex) for t in texts], types[1])],
                                             schema=schema)
    return run


def fit(docs: DataFrame, labels: DataFrame, fit_docs: int = FIT_DOCS, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "toxic") -> Lexicon:
    """Learn lexicon, exceptions and curve from labelled documents outside the held-out fold."""
    lab = labels.select(F.col(id_col).alias("lab_id"), F.col(label_col).cast("int").alias("label")) \
        .filter(F.col("lab_id").isNotNull() & F.col("label").isin(0, 1) & (fold(F.col("lab_id")) != 0)) \
        .groupBy("lab_id").agg(F.max("label").alias("label")) \
        .orderBy(F.xxhash64("lab_id"), "lab_id").limit(fit_docs)
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    # the sample has at most fit_docs narrow rows, so it may be broadcast
    sample = stored(d.join(F.broadcast(lab), d["id"] == lab["lab_id"]).select("label", "text"), "toxic-sample")
    sizes = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)
    if not n_toxic or not n_clean:
        return Lexicon()

    def counted(label: int, only, lex: Lexicon):
        c = sample.filter(F.col("label") == label).mapInArrow(_count_batches(only, lex), "feature string, n long")
        return c.groupBy("feature").agg(F.sum("n").alias("n"))

    toxic = {r["feature"]: r["n"] for r in counted(1, None, Lexicon()).filter(F.col("n") >= MIN_DOCS).collect()}
    clean = {r["feature"]: r["n"] for r in counted(0, frozenset(toxic), Lexicon()).collect()}
    rate = lambda n, total: (n + 0.5) / (total + 1)
    weight = {p: math.log(rate(t, n_toxic) / rate(clean.get(p, 0), n_clean)) for p, t in toxic.items()}
    good = frozenset(p for p, t in toxic.items() if t / (t + clean.get(p, 0)) >= MIN_PRECISION and weight[p] > 1)
    lex, left = Lexicon(known=True), {p: toxic[p] for p in good}
    while left:
        chosen = _strongest(left)
        lex.entries.update({p: round(weight[p], 6) for p in chosen})
        left = {r["feature"]: r["n"] for r in counted(1, good, lex).filter(F.col("n") >= MIN_DOCS).collect()}
    if any(clean.get(p, 0) for p in lex.entries):
        ph = sample.mapInArrow(_phrase_batches(lex), "label int, before string, entry string, after string") \
            .groupBy("before", "entry", "after").agg(F.sum("label").alias("toxic"), F.count(F.lit(1)).alias("n")) \
            .filter((F.col("toxic") == 0) & (F.col("n") >= MIN_EXCEPTION)).collect()
        lex.exceptions = frozenset((r["before"], r["entry"], r["after"]) for r in ph)
    rows = sample.mapInArrow(_value_batches(lex, ("label", "value"), (pa.int32(), pa.float64())),
                             "label int, value double").toPandas()
    lex.bias, lex.slope = _logistic(rows["value"].to_numpy(), rows["label"].to_numpy())
    return lex


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Bias and slope by Newton steps with a small ridge; both classes weigh alike."""
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    z = np.column_stack([np.ones_like(x), x])
    beta = np.zeros(2)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        grad = z.T @ (weight * (y - p)) - 1e-4 * beta
        hess = (z * (weight * p * (1 - p))[:, None]).T @ z + 1e-4 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        beta += step
        if np.abs(step).max() < 1e-10:
            break
    return float(beta[0]), float(beta[1])


def _score_batches(lex: Lexicon):
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches):
        a = lex.automaton()
        for ids, texts in arrow_texts(batches):
            v = np.array([value(fold_text(t), a, lex) for t in texts])
            s = 1 / (1 + np.exp(-np.clip(lex.bias + lex.slope * v, -500, 500))) if lex.known else np.zeros(len(v))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(s)], schema=schema)
    return run


def score(docs: DataFrame, lex: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``."""
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    s = d.mapInArrow(_score_batches(lex), "doc_id long, score double")
    return s.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                    (F.col("score") >= 0.5).cast("int").alias("predicted"))
