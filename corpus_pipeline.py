"""Corpus pipeline: language ID, near-duplicate removal, decontamination, personal data, encoding.

Every stage takes (spark, docs, sf_dir), works on all documents its predecessor
kept and returns a DataFrame; ``run`` writes each result as Parquet to the
shared folder and reads it back, which cuts the lineage, and returns the last.

Defined cases, in every stage: rows with a null id pass, in all stages but the last as whole rows; rows of
one id with different texts are judged each by its own text, of equal rows near-duplicate removal keeps one;
null or wordless text is rejected by the language stage; extra columns are kept, whatever their names (inside
a stage the table's columns have names of their own); empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyspark.llm import bpe, decontam, langid, neardup, pii
from tallyspark.llm.common import stored, table

ARROW_ROWS = 1000
MIN_LANGUAGE_SHARE = 0.4        # of a document's letters; less is a jumble of languages


def _narrow(spark: SparkSession) -> None:
    """Small Arrow batches: a stage holds a few MB of text at a time, in the executor and in its Python workers."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)


def _renamed(docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` under names that no stage uses, but for the text; and doc_id as long."""
    return docs.select(*[F.col(f"`{c}`").alias(_name(docs, c)) for c in docs.columns], F.col("doc_id").cast("long").alias("doc_id"))


def _name(docs: DataFrame, c: str) -> str:
    return c if c == "text" else f"column{docs.columns.index(c)}"


def _restored(rows: DataFrame, docs: DataFrame, **changed: Column) -> DataFrame:
    """The columns of ``docs`` again, some of them replaced."""
    return rows.select(*[changed.get(c, F.col(_name(docs, c))).alias(c) for c in docs.columns])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognised main language go; a missing ``lang`` is filled with the prediction."""
    _narrow(spark)
    model = langid.fit(docs)
    rows = langid.label_rows(_renamed(docs), model)
    rows = rows.filter((F.col("lang_pred") != langid.UNKNOWN) & (F.col("lang_score") >= MIN_LANGUAGE_SHARE))
    return _restored(rows, docs, lang=F.coalesce(_name(docs, "lang"), "lang_pred"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8 or more) stays.

    The decision is made on (id, fingerprint of the text's set): of a group the row with the smallest id, of
    its texts the smallest fingerprint.  Rows without an id are in no group and stay; so do texts without words.
    """
    _narrow(spark)
    found = stored(neardup.classes(docs, percent=80), "classes")
    first = F.min(F.struct("doc_id", "fp")).alias("x")
    kept = found.filter("fp is not null").groupBy("group").agg(first).select("x.doc_id", "x.fp", F.lit(True).alias("chosen"))
    rows = _renamed(docs)
    alone = rows.filter("doc_id is null")
    names = alone.columns
    rows = neardup.fingerprint_rows(rows.filter("doc_id is not null")).join(kept, ["doc_id", "fp"], "left")
    # repeated rows of one id and text: one stays; rows without words are told apart by a number of their own
    own = F.when(F.col("fp").isNull(), F.monotonically_increasing_id())
    one = Window.partitionBy("doc_id", "fp", "own").orderBy(F.xxhash64(*names))
    rows = rows.filter("fp is null or chosen").withColumn("own", own).withColumn("nth", F.row_number().over(one))
    return _restored(rows.filter("nth = 1").select(names).unionByName(alone), docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark items go."""
    _narrow(spark)
    found = decontam.contaminated(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return _restored(_renamed(docs).join(found, "doc_id", "left_anti"), docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind in angle brackets; ``n_chars`` follows."""
    _narrow(spark)
    rows = pii.mask_rows(_renamed(docs), pii.fit(docs))
    return _restored(rows, docs, text=F.col("text"), n_chars=F.length("text").cast(docs.schema["n_chars"].dataType))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, ids_sha256): the token ids, little-endian unsigned 32-bit."""
    _narrow(spark)
    encoded = bpe.encode(docs)
    return encoded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids",
                          F.sha2("ids", 256).alias("ids_sha256"))


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("decontamination", decontamination),
          ("personal_data", personal_data), ("encoding", encoding)]

# Viterbi labelling, sketches, the latent space, the random field and the merges have no SQL form;
# tests/llm checks the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
