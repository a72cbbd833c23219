"""Language identification of mixed-language text.

Method
  * Script ranges narrow the candidates: every letter belongs to a script by code
    point range, and a language is a candidate for a word if it was learned with
    at least ``SCRIPT_SHARE`` of its letters in the word's script.
  * Per-word scores: naive Bayes over the word's letter 1- to 3-grams (word ends
    included), hashed to ``BUCKETS`` buckets, as log-probabilities per learned
    language.  Counts cover all texts given for learning; they are summed in
    tasks, then by Spark, and the model is a bounded table.
  * Viterbi over the words of a document with ``SWITCH`` as the price of changing
    language labels spans.  All documents of a batch advance together, one word
    a step.  Documents where no other language gains half the price over any run
    of words have the constant path as their optimum, which is found without steps.
  * The language with most letters in its spans is the prediction; the score is
    its share of the letters.

Defined cases: null text, or text without letters: ``und`` with score 0; words in a
script that no learned language uses are labelled ``und``; nothing learned: always
``und``; languages tie by name; long texts are labelled whole; rows without text or
language teach nothing; every row of the input has its row in the result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import BATCH_CHARS, add_columns, arrow_texts, code_points, mix, text_batches

BUCKETS = 1 << 15
SWITCH = 12.0
SCRIPT_SHARE = 0.01
VITERBI_WORDS = 1_000_000
UNKNOWN = "und"

# ---- Fixed values: first code point of script ranges (Unicode blocks, coarse) and the script there ----
SCRIPT_STARTS = [
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"),
    (0x0600, "arabic"), (0x0700, "other"), (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "indic"),
    (0x0E00, "thai"), (0x0E80, "lao"), (0x0F00, "other"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "other"),
    (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"), (0x3100, "han"), (0xAC00, "hangul"),
    (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "latin"), (0xFB1D, "hebrew"), (0xFB50, "arabic"), (0xFF00, "latin"),
    (0xFF66, "kana"), (0xFFA0, "hangul"), (0x10000, "other"), (0x20000, "han"),
]
SCRIPTS = sorted({s for _, s in SCRIPT_STARTS})
_STARTS = np.array([a for a, _ in SCRIPT_STARTS])
_SCRIPT = np.array([SCRIPTS.index(s) for _, s in SCRIPT_STARTS], dtype=np.int8)
_LETTER: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000))
    return _LETTER[0]


# ---------------------------------------------------------------- features
def _pieces(texts: list[str], limit: int = BATCH_CHARS):
    """Lower-cased texts in pieces of about ``limit`` characters, cut between words: (text number, piece)."""
    for k, t in enumerate(texts):
        t = t.lower()
        start = 0
        while len(t) - start > limit:
            end = start + limit
            while end < len(t) and t[end].isalpha():
                end += 1
            yield k, t[start:end]
            start = end
        yield k, t[start:]


def word_features(texts: list[str]):
    """(text of each word, letters in it, script, letter offsets, buckets of the letters' n-grams (letters, 3))."""
    pieces = list(_pieces(texts))
    owner = np.array([k for k, _ in pieces])
    cp, off = code_points([p for _, p in pieces])
    inside = _letters()[cp]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside[0]:
        edge = np.concatenate([[0], edge])
    starts, ends = edge[0::2], edge[1::2]
    c = np.where(inside, cp, 0).astype(np.uint64)
    at = np.flatnonzero(inside)
    before = np.where(at > 0, c[at - 1], np.uint64(0))
    after = c[at + 1]                              # a newline ends every piece
    own = c[at]
    mask = np.uint64(BUCKETS - 1)
    grams = np.empty((len(at), 3), dtype=np.int64)
    grams[:, 0] = mix(own * np.uint64(3)) & mask
    grams[:, 1] = mix((before << np.uint64(21) | own) * np.uint64(3) + np.uint64(1)) & mask
    grams[:, 2] = mix(((before << np.uint64(21) | own) << np.uint64(21) | after) * np.uint64(3) + np.uint64(2)) & mask
    doc = owner[np.searchsorted(off, starts, side="right") - 1]
    script = _SCRIPT[np.searchsorted(_STARTS, cp[starts], side="right") - 1]
    return doc, ends - starts, script, np.searchsorted(at, starts), grams


# ---------------------------------------------------------------- learning
def _count_batches(batches):
    """(lang, bucket, n): n-gram counts; buckets from BUCKETS on count letters by script."""
    schema = pa.schema([("lang", pa.string()), ("bucket", pa.int32()), ("n", pa.int64())])
    total: dict[str, np.ndarray] = {}
    for langs, texts in arrow_texts(batches):
        doc, size, script, offsets, grams = word_features(texts)
        if not len(doc):
            continue
        names = np.array(langs, dtype=object)[doc]
        for lang in set(langs):
            words = names == lang
            letters = np.repeat(words, size)
            t = total.setdefault(lang, np.zeros(BUCKETS + len(SCRIPTS), dtype=np.int64))
            t[:BUCKETS] += np.bincount(grams[letters].ravel(), minlength=BUCKETS)
            t[BUCKETS:] += np.bincount(script[words], weights=size[words], minlength=len(SCRIPTS)).astype(np.int64)
    for lang, t in total.items():
        at = np.flatnonzero(t)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at.astype(np.int32)), pa.array(t[at])],
                                         schema=schema)


@dataclass
class Model:
    langs: list[str]
    logp: np.ndarray            # (BUCKETS, languages) float32
    allowed: np.ndarray         # (scripts, languages) bool


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learn from all rows with text and language."""
    d = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).dropna()
    c = d.mapInArrow(_count_batches, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(
        F.sum("n").alias("n")).toPandas()               # at most (BUCKETS + scripts) rows a language
    langs = sorted(set(c["lang"]))
    counts = np.zeros((BUCKETS + len(SCRIPTS), len(langs)))
    counts[c["bucket"], c["lang"].map({x: i for i, x in enumerate(langs)}).astype(int)] = c["n"]
    grams, letters = counts[:BUCKETS], counts[BUCKETS:]
    p = (grams + 0.1) / (grams.sum(0) + 0.1 * BUCKETS)
    allowed = letters > SCRIPT_SHARE * letters.sum(0)
    return Model(langs, np.log(p).astype(np.float32), allowed)


# ---------------------------------------------------------------- labelling
def word_scores(model: Model, texts: list[str]):
    """(text of each word, letters, scores (words, languages)); an excluded language scores -1e4."""
    doc, size, script, offsets, grams = word_features(texts)
    if not len(doc) or not model.langs:
        return doc, size, np.zeros((len(doc), len(model.langs)), dtype=np.float32)
    per_letter = model.logp[grams[:, 0]]
    per_letter += model.logp[grams[:, 1]]
    per_letter += model.logp[grams[:, 2]]
    e = np.add.reduceat(per_letter, offsets, axis=0) / np.float32(2)     # overlapping n-grams count half
    ok = model.allowed[script]
    e -= e.max(axis=1, keepdims=True)
    e[~ok] = -1e4
    return doc, size, e


def viterbi(scores: np.ndarray, lengths: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Best language of every word for sequences laid end to end; all sequences advance together."""
    n, k = scores.shape
    path = np.empty(n, dtype=np.int8)
    starts = np.concatenate([[0], np.cumsum(lengths)])[:-1]
    todo = []
    # constant paths: no other language gains more than half of ``switch`` over the best one in any run of
    # words, so a path of m other runs gains at most m / 2 prices and pays m - 1 of them at least
    for i in np.flatnonzero(lengths):
        e = scores[starts[i]:starts[i] + lengths[i]]
        best = int(e.sum(0, dtype=np.float64).argmax())
        gain = np.cumsum(e - e[:, best:best + 1], axis=0, dtype=np.float64)
        low = np.minimum(np.minimum.accumulate(np.vstack([np.zeros((1, k)), gain[:-1]]), axis=0), 0)
        if (gain - low).max() <= switch / 2:
            path[starts[i]:starts[i] + lengths[i]] = best
        else:
            todo.append(i)
    if not todo:
        return path
    todo = np.array(todo)
    todo = todo[np.argsort(-lengths[todo], kind="stable")]          # longest first: the active ones are a prefix
    s, m = starts[todo], lengths[todo]
    active = np.searchsorted(-m, -np.arange(m[0]), side="left")     # sequences with more than t words
    v = scores[s].astype(np.float64)
    back = np.empty((int(m.sum()), k), dtype=np.int8)               # by sequence, from its second word on
    b = np.concatenate([[0], np.cumsum(m)])[:-1]
    stay = np.arange(k, dtype=np.int8)
    for t in range(1, int(m[0])):
        a = active[t]
        w = v[:a]
        top = w.argmax(1)
        lead = w[np.arange(a), top] - switch
        change = lead[:, None] > w
        back[b[:a] + t] = np.where(change, top[:, None].astype(np.int8), stay)
        v[:a] = np.where(change, lead[:, None], w) + scores[s[:a] + t]
    now = v.argmax(1).astype(np.int8)
    for t in range(int(m[0]) - 1, -1, -1):
        a = active[t]
        path[s[:a] + t] = now[:a]
        if t:
            now[:a] = back[b[:a] + t, now[:a]]
    return path


def _decide(model: Model, switch: float, n: int, parts) -> tuple[list[str], np.ndarray]:
    """Prediction and score of ``n`` texts from the word scores of their parts."""
    k = len(model.langs)
    score = np.concatenate([p[2] for p in parts]) if parts else np.zeros((0, k), dtype=np.float32)
    size = np.concatenate([p[1] for p in parts]) if parts else np.zeros(0, dtype=np.int64)
    doc = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, dtype=np.int64)
    lengths = np.bincount(doc, minlength=n)
    letters = np.zeros((n, k + 1))
    if len(doc) and k:
        path = viterbi(score, lengths, switch).astype(np.int64)
        path[score.max(1) <= -1e4] = k                          # no learned language uses the script
        np.add.at(letters, (doc, path), size)
    total = letters.sum(1)
    best = letters[:, :k].argmax(1) if k else np.zeros(n, dtype=int)
    known = letters[np.arange(n), best] > 0
    names = [model.langs[b] if ok else UNKNOWN for b, ok in zip(best, known)]
    return names, np.where(known, letters[np.arange(n), best] / np.maximum(total, 1), 0.0)


def _predict_batches(model: Model, switch: float):
    schema = pa.schema([("row", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def result(ids, parts):
        names, share = _decide(model, switch, len(ids), parts)
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(names, pa.string()), pa.array(share)],
                                          schema=schema)

    def run(batches):
        ids, parts, words = [], [], 0
        for more, texts in arrow_texts(batches):
            doc, size, e = word_scores(model, texts)
            parts.append((doc + len(ids), size, e))
            ids += more
            words += len(doc)
            if words >= VITERBI_WORDS:
                yield result(ids, parts)
                ids, parts, words = [], [], 0
        if ids:
            yield result(ids, parts)
    return run


def label_rows(docs: DataFrame, model: Model, text_col: str = "text", switch: float = SWITCH) -> DataFrame:
    """``docs`` with the columns lang_pred and lang_score."""
    def make(texts):
        parts, n = [], 0
        for _, some in text_batches(texts, texts):
            doc, size, e = word_scores(model, some)
            parts.append((doc + n, size, e))
            n += len(some)
        names, share = _decide(model, switch, len(texts), parts)
        return [pa.array(names, pa.string()), pa.array(share)]
    return add_columns(docs, text_col, make, {"lang_pred": "string", "lang_score": "double"})


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text",
            switch: float = SWITCH) -> DataFrame:
    """(doc_id, lang_pred, score) for every row of ``docs``."""
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return d.mapInArrow(_predict_batches(model, switch), "doc_id long, lang_pred string, score double")


def spans(text: str | None, model: Model, switch: float = SWITCH) -> list[tuple[int, int, str]]:
    """(first word, end word, language) of the spans of one text; words are runs of letters."""
    doc, _, e = word_scores(model, [text or ""])
    if not len(doc) or not model.langs:
        return []
    path = viterbi(e, np.array([len(doc)]), switch)
    cut = np.concatenate([[0], np.flatnonzero(path[1:] != path[:-1]) + 1, [len(path)]])
    return [(int(a), int(b), model.langs[path[a]]) for a, b in zip(cut[:-1], cut[1:])]
