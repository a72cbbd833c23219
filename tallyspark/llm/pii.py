"""Personal data: exact base patterns, and a skip-chain conditional random field that adds spans.

Base spans (leftmost, non-overlapping per kind; failing matches are dropped and not
retried): email, ip (parts at most 255), card (13 to 19 digits passing Luhn), phone
(9 to 15 digits).

Method
  * Nodes are the white-space tokens that hold a digit or ``@``, with one token of
    context on either side; all other tokens are outside any entity and cut the
    chain.  Neighbouring tokens of digits that together read as one card number
    (Luhn) are one node.  Node features are the shape (digits and letters collapsed to
    classes with counts), the neighbours' shapes and a few cues.
  * Weights: multinomial logistic regression of the base labels on hashed
    features, label transitions, and the agreement of repeated tokens, fitted on a
    bounded sample of ``FIT_DOCS`` documents that hold base spans (smallest hash
    of the id first).  Card-like nodes without a base span are left out: the base
    pattern swallowed them, which says nothing against them.
  * Skip chain: a token that repeats, or is similar to an earlier one (same
    characters but for punctuation and case), shares a potential with its previous
    occurrence, wherever that is.  Loopy sum-product message passing over chain
    and skip links, ``ROUNDS`` rounds over all links of a document at once, gives
    the marginals, so labels become consistent across the document.
  * Runs of tokens labelled alike with probability ``MIN_PROBABILITY`` or more and
    a plausible form (``FORMS``) become added spans where no base span overlaps:
    for example a phone number and a card number that stand side by side, which
    the base patterns swallow as one failing match.

Defined cases: null and empty text have no spans; a fit without base spans gives a
model that adds nothing; long texts are searched whole; rows with null ids and
repeated rows have their rows in the result; extra columns are ignored.
"""

from __future__ import annotations

import pickle
import re
import zlib
from bisect import bisect_right
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import add_columns, arrow_texts

KINDS = ["email", "ip", "card", "phone"]
LABELS = ["other", *KINDS]
UNKNOWN = -1
FIT_DOCS = 2_000
FEATURES = 1 << 12
ROUNDS = 8
MIN_PROBABILITY = 0.5
CARD_LENGTHS = [16, 15, 14, 13, 19, 18, 17]     # by how common they are
# what an added span may look like: a model's guess outside these forms is not added
FORMS = {"email": re.compile(r"\S+@\S+\.\S+"), "ip": re.compile(r"[0-9]{1,3}([.:-][0-9]{1,3}){3}"),
         "card": re.compile(r"[0-9](\s{0,2}-?[0-9]){12,18}"), "phone": re.compile(r"\+?[0-9(]([ ().-]*[0-9]){8,14}")}

_ANY = re.compile(r"[0-9@]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TOKEN = re.compile(r"\S+")
_CARD_TOKEN = re.compile(r"[0-9]+(-[0-9]+)*")


# ---------------------------------------------------------------- base patterns
def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        if i % 2:
            n = n * 2 - 9 if n > 4 else n * 2
        total += n
    return total % 10 == 0


def _digits(s: str) -> str:
    return re.sub("[^0-9]", "", s)


def _emails(text: str) -> list[tuple[int, int]]:
    """[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+, found from its ``@``: linear in the text."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            end = m.end()
        else:
            end = max(end, at + 1)      # what a failed ``@`` ends cannot belong to a later local part
        at = text.find("@", max(at + 1, end if m else at + 1))
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind as listed, then start."""
    if not _ANY.search(text):
        return []
    out = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        d = _digits(m[0])
        if 13 <= len(d) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_digits(m[0])) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


# ---------------------------------------------------------------- nodes and features
def _shape(token: str) -> str:
    s = re.sub("[0-9]+", lambda m: f"9{len(m[0])}" if len(m[0]) < 20 else "9+", token)
    return re.sub(r"[^\W0-9_]+", "a", s)[:40]


def _core(token: str) -> tuple[int, int]:
    """The token without outer punctuation (an opening ``(`` and ``+`` stay)."""
    a, b = 0, len(token)
    while a < b and not (token[a].isalnum() or token[a] in "+("):
        a += 1
    while b > a and not (token[b - 1].isalnum() or token[b - 1] == ")"):
        b -= 1
    return a, b


@dataclass
class Graph:
    spans: list[tuple[int, int]]
    features: list[list[int]]
    chain: list[tuple[int, int]]
    skip: list[tuple[int, int]]
    card: list[bool]            # does the node read as a card number, whatever the base patterns say?


def graph(text: str) -> Graph:
    """Nodes, features and links of one text."""
    tokens: list[tuple[int, int]] = []
    pos = 0
    while (m := _ANY.search(text, pos)) is not None:
        a = m.start()
        while a > pos and not text[a - 1].isspace():
            a -= 1
        b = _TOKEN.match(text, m.start()).end()
        left = a
        while left > 0 and text[left - 1].isspace():
            left -= 1
        first = left
        while first > 0 and not text[first - 1].isspace():
            first -= 1
        if first < left and (not tokens or tokens[-1][0] < first):
            tokens.append((first, left))
        if not tokens or tokens[-1][0] < a:
            tokens.append((a, b))
        nxt = _TOKEN.search(text, b)
        if nxt:
            tokens.append((nxt.start(), nxt.end()))
        pos = b
    words = [text[a:b] for a, b in tokens]
    near = [bool(text[x[1]:y[0]].isspace() and len(text[x[1]:y[0]]) <= 2) for x, y in zip(tokens[:-1], tokens[1:])]
    # tokens that read as one card number are one node, with the shape of its digits however they are spaced
    runs = card_runs([w[slice(*_core(w))] for w in words], near)
    starts, inner = {a: b for a, b in runs}, {i for a, b in runs for i in range(a + 1, b + 1)}
    firsts = [i for i in range(len(tokens)) if i not in inner]
    card = [i in starts for i in firsts]
    near = [near[starts.get(i, i)] for i in firsts[:-1]]
    tokens = [(tokens[i][0], tokens[starts.get(i, i)][1]) for i in firsts]
    words = [text[a:b] for a, b in tokens]
    shapes = [_shape(_digits(w) if c else w[slice(*_core(w))]) for w, c in zip(words, card)]
    features, last, skip = [], {}, []
    for i, w in enumerate(words):
        before = shapes[i - 1] if i and near[i - 1] else "^"
        after = shapes[i + 1] if i + 1 < len(words) and near[i] else "$"
        names = [f"s{shapes[i]}", f"b{before}|{shapes[i]}", f"a{shapes[i]}|{after}", f"n{min(20, len(_digits(w)))}",
                 f"@{'@' in w}{'.' in w[w.find('@'):]}", f"p{w[:1] if not w[:1].isalnum() else ''}", f"l{card[i]}", "1"]
        features.append([zlib.crc32(n.encode("utf-8", "replace")) % FEATURES for n in names])
        form = re.sub(r"\W+", "", w).lower()
        if len(form) >= 4:
            if form in last:
                skip.append((last[form], i))
            last[form] = i
    return Graph(tokens, features, [(i, i + 1) for i, n in enumerate(near) if n], skip, card)


def base_labels(g: Graph, spans: list[tuple[str, int, int]]) -> np.ndarray:
    """Labels to learn from.  A node that reads as a card number where no base span lies is left open: the base
    pattern has swallowed it in a longer failing match, which is no evidence against it."""
    out = np.zeros(len(g.spans), dtype=np.int64)
    ends = [y for _, y in g.spans]          # tokens are in order and apart
    for kind, a, b in spans:
        i = bisect_right(ends, a)
        while i < len(ends) and g.spans[i][0] < b:
            out[i] = LABELS.index(kind)
            i += 1
    out[np.array(g.card, dtype=bool) & (out == 0)] = UNKNOWN
    return out


def card_runs(words: list[str], near: list[bool]) -> list[tuple[int, int]]:
    """(first, last) token of the stretches that read as one card number: 13 to 19 digits passing Luhn.

    Stretches are sought from the left in runs of neighbouring tokens of digits and hyphens, none overlapping
    another; of several from one token the first length in ``CARD_LENGTHS`` counts.  A stretch has at most 19
    tokens, so this is linear in the text.
    """
    digits = [_digits(w) if _CARD_TOKEN.fullmatch(w) else "" for w in words]
    out, i = [], 0
    while i < len(words):
        if not digits[i]:
            i += 1
            continue
        found, number, j = [], "", i
        while j < len(words) and digits[j] and (j == i or near[j - 1]) and len(number) + len(digits[j]) <= 19:
            number += digits[j]
            if len(number) >= 13 and luhn(number):
                found.append((CARD_LENGTHS.index(len(number)), j))
            j += 1
        if found:
            out.append((i, min(found)[1]))
            i = out[-1][1]
        i += 1
    return out


# ---------------------------------------------------------------- model
@dataclass
class Model:
    unary: np.ndarray           # (FEATURES, labels)
    chain: np.ndarray           # (labels, labels) log potentials
    skip: np.ndarray            # (labels, labels) log potentials
    known: bool = True


def train(examples: list[tuple[Graph, np.ndarray]], steps: int = 300) -> Model:
    """Piecewise training: regression for the nodes, smoothed log-odds of label pairs for either kind of link."""
    k = len(LABELS)
    if not any((y > 0).any() for _, y in examples):
        return Model(np.zeros((FEATURES, k)), np.zeros((k, k)), np.zeros((k, k)), known=False)
    x = np.array([f for g, _ in examples for f in g.features])
    y = np.concatenate([y for _, y in examples])
    x, y = x[y != UNKNOWN], y[y != UNKNOWN]
    w, sq = np.zeros((FEATURES, k)), np.full((FEATURES, k), 1e-8)
    target = np.eye(k)[y]
    for _ in range(steps):                                  # full-batch AdaGrad with a small ridge
        z = w[x].sum(1)
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        err = (p - target) / len(x)
        grad = np.column_stack([np.bincount(x.ravel(), np.repeat(err[:, j], x.shape[1]), FEATURES) for j in range(k)])
        grad += 1e-6 * w
        sq += grad ** 2
        w -= 0.5 * grad / np.sqrt(sq)

    def pairs(name):
        c = np.ones((k, k)) * 0.5
        for g, lab in examples:
            for i, j in getattr(g, name):
                if lab[i] != UNKNOWN and lab[j] != UNKNOWN:
                    c[lab[i], lab[j]] += 1
        # pointwise mutual information, half of it: the node features know part of it already; that a
        # pair was not seen in the sample says little, so the lower bound is near zero
        return np.clip(0.5 * np.log(c / c.sum() / (c.sum(1, keepdims=True) / c.sum()) / (c.sum(0) / c.sum())), -0.5, 2)

    skip = pairs("skip")
    skip = (skip + skip.T) / 2
    return Model(w, pairs("chain"), skip)


def marginals(g: Graph, model: Model) -> np.ndarray:
    """Label marginals by loopy sum-product over chain and skip links."""
    k = len(LABELS)
    z = np.array([model.unary[f].sum(0) for f in g.features]) if g.features else np.zeros((0, k))
    links = g.chain + g.skip
    if not links:
        p = np.exp(z - z.max(1, keepdims=True)) if len(z) else z
        return p / p.sum(1, keepdims=True) if len(z) else z
    src = np.array([a for a, _ in links] + [b for _, b in links])
    dst = np.array([b for _, b in links] + [a for a, _ in links])
    n = len(links)
    pot = np.empty((2 * n, k, k))
    c = len(g.chain)
    pot[:c], pot[c:n] = model.chain, model.skip
    pot[n:n + c], pot[n + c:] = model.chain.T, model.skip.T
    back = np.concatenate([np.arange(n, 2 * n), np.arange(n)])
    msg = np.zeros((2 * n, k))
    for _ in range(ROUNDS):
        belief = z.copy()
        np.add.at(belief, dst, msg)
        out = belief[src] - msg[back]
        t = out[:, :, None] + pot
        top = t.max(1)
        new = top + np.log(np.exp(t - top[:, None, :]).sum(1))
        new -= new.max(1, keepdims=True)
        msg = 0.5 * msg + 0.5 * new
    belief = z.copy()
    np.add.at(belief, dst, msg)
    p = np.exp(belief - belief.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def added_spans(text: str, base: list[tuple[str, int, int]], model: Model) -> list[tuple[str, int, int]]:
    if not model.known or not _ANY.search(text):
        return []
    g = graph(text)
    p = marginals(g, model)
    lab = np.where(p.max(1) >= MIN_PROBABILITY, p.argmax(1), 0) if len(p) else np.zeros(0, dtype=int)
    linked = {i for i, _ in g.chain}
    out, i = [], 0
    taken = sorted((a, b) for _, a, b in base)
    starts = [a for a, _ in taken]
    longest = max((b - a for a, b in taken), default=0)

    def free(a: int, b: int) -> bool:
        """No base span overlaps [a, b)."""
        k = bisect_right(starts, b - 1)
        while k and starts[k - 1] > a - longest:
            k -= 1
            if taken[k][1] > a:
                return False
        return True

    while i < len(lab):
        j = i
        while j + 1 < len(lab) and lab[j + 1] == lab[i] and j in linked and LABELS[lab[i]] == "phone":
            j += 1
        if lab[i]:
            kind = LABELS[lab[i]]
            first, last = text[slice(*g.spans[i])], text[slice(*g.spans[j])]
            a, b = g.spans[i][0] + _core(first)[0], g.spans[j][0] + _core(last)[1]
            span = text[a:b]
            if FORMS[kind].fullmatch(span) and (kind != "card" or luhn(_digits(span))) and free(a, b):
                out.append((kind, a, b))
        i = j + 1
    return out


# ---------------------------------------------------------------- Spark jobs
def _holding_batches(batches):
    """Ids of the documents with base spans."""
    for ids, texts in arrow_texts(batches):
        keep = [i for i, t in zip(ids, texts) if i is not None and base_spans(t)]
        if keep:
            yield pa.RecordBatch.from_arrays([pa.array(keep, pa.int64())], schema=pa.schema([("doc_id", pa.int64())]))


def _example_batches(batches):
    """Pickled (graph, base labels): what training needs of a document, not its text."""
    for _, texts in arrow_texts(batches):
        out = []
        for t in texts:
            g = graph(t)
            out.append(pickle.dumps((g.features, g.chain, g.skip, base_labels(g, base_spans(t)))))
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], schema=pa.schema([("example", pa.binary())]))


def fit(docs: DataFrame, fit_docs: int = FIT_DOCS, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Train on at most ``fit_docs`` documents with base spans, chosen by hash of the id."""
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")) \
        .filter(F.col("text").rlike("[0-9@]"))
    few = d.mapInArrow(_holding_batches, "doc_id long").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_docs)
    # at most fit_docs ids, so they may be broadcast
    rows = d.join(F.broadcast(few), "doc_id", "left_semi").mapInArrow(_example_batches, "example binary").collect()
    return train([(Graph([], *x[:3], []), x[3]) for x in (pickle.loads(r) for r in sorted(r[0] for r in rows))])


def _found_batches(model: Model):
    schema = pa.schema([("doc_id", pa.int64()), ("base", pa.string()), ("spans", pa.string()),
                        *((f"n_{k}", pa.int64()) for k in KINDS), ("masked", pa.string())])

    def run(batches):
        for ids, texts in arrow_texts(batches):
            cols = [[] for _ in schema.names]
            for i, t in zip(ids, texts):
                base = base_spans(t)
                spans = sorted(base + added_spans(t, base, model), key=lambda s: (KINDS.index(s[0]), s[1]))
                row = [i, _joined(base), _joined(spans), *(sum(s[0] == k for s in base) for k in KINDS),
                       mask(t, spans) if spans else None]
                for c, v in zip(cols, row):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, schema.types)], schema=schema)
    return run


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def mask(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with every span replaced by its kind in angle brackets; overlapping spans by the first one's kind."""
    out, end = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= end:
            out += [text[end:a], f"<{kind.upper()}>"]
        end = max(end, b)
    return "".join(out) + text[end:]


def find(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, base, spans, n_<kind> of the base spans, masked) per row; masked is null where nothing was found."""
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return d.mapInArrow(_found_batches(model), "doc_id long, base string, spans string, "
                        + ", ".join(f"n_{k} long" for k in KINDS) + ", masked string")


def mask_rows(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with all spans of the text masked; a null text stays null."""
    def make(texts):
        out = []
        for t in texts:
            base = base_spans(t)
            spans = base + added_spans(t, base, model)
            out.append(mask(t, spans) if spans else t)
        return [pa.array(out, pa.string())]
    masked = add_columns(docs, text_col, make, {"_masked": "string"})
    return masked.withColumn(text_col, F.when(F.col(text_col).isNotNull(), F.col("_masked"))).drop("_masked")
