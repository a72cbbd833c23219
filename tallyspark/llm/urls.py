"""URL filter: rules first, then naive Bayes over segmented host and path tokens.

Method
  * Host and path are cut out by Spark expressions; rules (host, path) apply to
    the host and its subdomains and to paths that start with the rule's path; the
    longest rule wins.
  * Host word segmentation: every distinct host label is split into words by a
    unigram Viterbi.  Word counts come from the visible text of all pages; only
    substrings of host labels are joined, so neither side is broadcast.
  * Multinomial naive Bayes over segmented host words and path tokens, hashed to
    ``BUCKETS`` buckets; it learns from every page that a rule decides and judges
    the pages that no rule fits, with equal class priors (how often rules block
    says nothing about other pages).  The model is a bounded table.

Distinct hosts are segmented once, so a host with a third of all pages is one
row; the join back has one row per host on one side and is split by adaptive
execution.

Defined cases: null url or one without ``://``: empty host and path, no rule; no
pages decided by rules, or by rules of one verdict only, or an equal score: allow; labels without known words
stay whole; repeated rows are judged each; extra columns are ignored.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tallyspark.llm.common import stored

BUCKETS = 1 << 16
MAX_WORD = 63           # letters of a dictionary word: the longest host label
UNKNOWN_LETTER = 12.0   # cost of a letter outside dictionary words
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

Rule = tuple[str, str]      # ("allow" or "block", "host/path")


def parsed(url: Column) -> tuple[Column, Column]:
    """Host and path of a url."""
    at = F.instr(url, "://")
    rest = F.coalesce(F.when(at > 0, url.substr(at + 3, F.length(url))), F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(rest.substr(F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def ruled(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, both null if none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        h, _, p = text.partition("/")
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit("/" + p))
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


# ---------------------------------------------------------------- segmentation
def best_split(label: str, cost: dict[str, float]) -> list[str]:
    """Words of ``label`` of least total cost; a letter outside any word costs UNKNOWN_LETTER."""
    n = len(label)
    best, back = [0.0] + [math.inf] * n, [0] * (n + 1)
    for end in range(1, n + 1):
        for start in range(max(0, end - MAX_WORD), end):
            c = cost.get(label[start:end])
            if c is None:
                if end - start > 1:
                    continue
                c = UNKNOWN_LETTER
            if best[start] + c < best[end]:
                best[end], back[end] = best[start] + c, start
    words, end = [], n
    while end:
        words.append(label[back[end]:end])
        end = back[end]
    return words[::-1]


def _split_batches(batches):
    schema = pa.schema([("label", pa.string()), ("words", pa.list_(pa.string()))])
    for b in batches:
        labels, known = b.column(0).to_pylist(), b.column(1).to_pylist()
        out = []
        for label, entries in zip(labels, known):
            cost = {e["word"]: e["cost"] for e in entries or []}
            out.append([w for part in re.findall("[a-z]+|[^a-z]+", label) for w in
                        (best_split(part, cost) if part.isalpha() else [part])])
        yield pa.RecordBatch.from_arrays([pa.array(labels), pa.array(out, pa.list_(pa.string()))], schema=schema)


def word_counts(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """(word, n) of the visible text of all pages, words of 2 to MAX_WORD letters a-z."""
    text = F.lower(F.regexp_replace(F.coalesce(F.col(html_col), F.lit("")), "<[^>]*>", " "))
    words = pages.select(F.explode(F.split(text, "[^a-z]+")).alias("word"))
    return words.filter(F.length("word").between(2, MAX_WORD)).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def segment(labels: DataFrame, counts: DataFrame) -> DataFrame:
    """(label, words) for distinct host labels, split by the unigram model of ``counts``."""
    counts = stored(counts, "words")
    total = counts.agg(F.sum("n")).first()[0] or 1
    starts = F.sequence(F.lit(1), F.length("label"))
    sizes = F.sequence(F.lit(2), F.greatest(F.lit(2), F.least(F.length("label"), F.lit(MAX_WORD))))
    parts = F.flatten(F.transform(starts, lambda s: F.transform(sizes, lambda n: F.substring(F.col("label"), s, n))))
    subs = labels.select("label", F.explode(F.array_distinct(parts)).alias("word")).filter(F.length("word") >= 2)
    known = subs.join(counts, "word").groupBy("label").agg(
        F.collect_list(F.struct("word", (-F.log(F.col("n") / F.lit(float(total)))).alias("cost"))).alias("known"))
    return labels.join(known, "label", "left").select("label", "known") \
        .mapInArrow(_split_batches, "label string, words array<string>")


# ---------------------------------------------------------------- naive Bayes
def path_tokens(path: Column) -> Column:
    """Lower-case runs of letters, and ``#`` for a run of digits."""
    digits = F.regexp_replace(F.lower(path), "[0-9]+", " # ")
    return F.filter(F.split(digits, "[^\\p{L}#]+"), lambda t: t != "")


def _bucket(kind: str, token: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(kind), token), F.lit(BUCKETS)).cast("int")


def judge(pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url",
          html_col: str = "html") -> DataFrame:
    """(page_id, host, path, rule, verdict, score) per row; score is the log-odds for block, null where a rule decides."""
    host, path = parsed(F.col("url"))
    p = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"))
    p = p.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = ruled(F.col("host"), F.col("path"), rules)
    p = p.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("by_rule"))

    hosts = p.select("host").distinct()
    parts = hosts.select("host", F.posexplode(F.split("host", "[.]")).alias("at", "label")).filter("label != ''")
    words = segment(parts.select("label").distinct(), word_counts(pages, html_col))
    split = parts.join(words, "label").groupBy("host").agg(F.sort_array(F.collect_list(F.struct("at", "words"))).alias("w"))
    host_words = stored(split.select("host", F.flatten("w.words").alias("words")), "hosts")
    tokens = F.concat(F.transform(F.coalesce("words", F.array().cast("array<string>")), lambda t: _bucket("host", t)),
                      F.transform(path_tokens(F.col("path")), lambda t: _bucket("path", t)))
    x = p.join(host_words, "host", "left").withColumn("buckets", tokens)

    learn = x.filter(F.col("by_rule").isNotNull())
    counts = learn.select("by_rule", F.explode("buckets").alias("b")).groupBy("by_rule", "b").agg(
        F.count(F.lit(1)).alias("n")).toPandas()            # at most 2 * BUCKETS rows
    weights = bayes_weights(counts)
    bc = pages.sparkSession.sparkContext.broadcast(weights)

    @pandas_udf("double")
    def log_odds(buckets: pd.Series) -> pd.Series:
        return buckets.map(lambda b: float(bc.value[np.asarray(b, dtype=np.int64)].sum()) if len(b) else 0.0)

    score = F.when(F.col("by_rule").isNull(), log_odds("buckets"))
    by_method = F.when(F.col("score") > 0, F.lit("block")).otherwise(F.lit("allow"))
    return x.withColumn("score", score).select("page_id", "host", "path", "rule",
                                               F.coalesce("by_rule", by_method).alias("verdict"), "score")


def bayes_weights(counts: pd.DataFrame) -> np.ndarray:
    """Log-odds for block of every bucket (add-one smoothing); zeros unless both verdicts occur."""
    log = {}
    for kind in ("allow", "block"):
        rows = counts[counts["by_rule"] == kind]
        if not len(rows):
            return np.zeros(BUCKETS)
        c = np.zeros(BUCKETS)
        c[rows["b"].to_numpy(dtype=np.int64)] = rows["n"].to_numpy()
        log[kind] = np.log((c + 1) / (c.sum() + BUCKETS))
    return log["block"] - log["allow"]
