"""Note keywords.

Text is ``category: note`` for rows with a note; keywords are the alphabetic
tokens (letters only, any script) in lower case, without English stop words,
distinct per key.  The result is long (one row per key and keyword): a
distinct aggregation with map-side combine, so a key with a third of all
notes is still spread over every task until its keywords are unique.
Lemmatising and named entities are not built (see README).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import RegexTokenizer, StopWordsRemover
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.columns import keys
from tallyspark.schema import ENGLISH_STOP_WORDS

ALPHA_TOKEN = r"\p{L}+"


def note_text(df: DataFrame) -> DataFrame:
    return df.filter(F.col("note").isNotNull() & (F.col("note") != "")) \
        .withColumn("_text", F.concat_ws(": ", F.col("category"), F.col("note")))


def note_keywords(df: DataFrame, by: Sequence[str] | None = None,
                  stop_words: Sequence[str] = ENGLISH_STOP_WORDS) -> DataFrame:
    """Distinct keywords per key."""
    k = keys(by)
    t = note_text(df).select(*k, "_text")
    tok = RegexTokenizer(inputCol="_text", outputCol="_tok", pattern=ALPHA_TOKEN, gaps=False,
                         toLowercase=True, minTokenLength=1).transform(t)
    sw = StopWordsRemover(inputCol="_tok", outputCol="_kw",
                          stopWords=list(stop_words)).transform(tok)
    return sw.select(*k, F.explode("_kw").alias("keyword")).distinct()

