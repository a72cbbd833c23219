"""Registered queries for models, text, sinks and sources (H3-H13, E7, F5, I4-I8, A*).

Models train on one part of the data, ledger rows before ``AS_OF``; evaluations
use the rest, all other queries the whole ledger;
for the document-language model, documents without a ``labels`` row train and
labelled ones test.  Sink/source queries write what Spark derived from the
tables to the shared checkpoint folder and read it back.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tallyspark.ml import anomaly as H5
from tallyspark.ml import budget as H10
from tallyspark.ml import category as H8
from tallyspark.ml import expense as H3
from tallyspark.ml import softmax as H8b
from tallyspark.operators import ordered as E
from tallyspark.operators import quality as Q
from tallyspark.operators import text as T
from tallyspark.operators.envelope import KeyRing
from tallyspark.operators.filters import display_format
from tallyspark.operators.rollups import expense_categories
from tallyspark.plans.report import insight_report
from tallyspark.schema import ENGLISH_STOP_WORDS
from tallyspark.session import checkpoint_dir
from tallyspark.sources import files as A
from tallyspark.sources.testdata import audit_events, ledger, notes, source_key, table

AS_OF = "2001-08-01"


def _split(spark, d):
    L = ledger(spark, d)
    return L.filter(F.col("tx_date") < F.lit(AS_OF).cast("date")), L.filter(F.col("tx_date") >= F.lit(AS_OF).cast("date"))


_MODELS: dict[tuple, object] = {}


def _fitted(spark: SparkSession, d: str, kind: str, part: str):
    """A model fitted once per session, data folder and training part (``train`` or ``all``).

    Fitted models are small driver-side objects; several registered queries
    apply the same model, as the reference keeps one loaded model per agent.
    """
    key = (id(spark), spark.sparkContext.applicationId, source_key(spark, d), kind, part)
    if key not in _MODELS:
        data = _split(spark, d)[0] if part == "train" else ledger(spark, d)
        fit = {"category": H8.fit_category, "softmax": H8b.fit_softmax, "anomaly": H5.fit_anomaly,
               "budget": lambda df: H10.fit_budget(df, expense_categories(df)), "expense": H3.fit_expense}[kind]
        _MODELS[key] = fit(data)
    return _MODELS[key]


def _scratch(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/tally-{name}-{uuid.uuid4().hex[:12]}"


# ---- text models
def q_predict_category(spark, d):
    L = ledger(spark, d)
    m = _fitted(spark, d, "category", "train")
    return H8.predict_category(m, L.filter(F.col("t_type") == "expense")).select(
        "tx_id", "user_id", "category", "predicted")


def q_evaluate_category(spark, d):
    _, test = _split(spark, d)
    return H8.evaluate_category(_fitted(spark, d, "category", "train"), test)


def q_suggest_categories(spark, d):
    L = ledger(spark, d)
    return H8.suggest_categories(_fitted(spark, d, "category", "train"), L.filter(F.col("t_type") == "expense"))


def q_resolve_category(spark, d):
    L = ledger(spark, d)
    m = _fitted(spark, d, "category", "train")
    blanked = L.withColumn("category", F.when(F.col("t_type") == "expense", F.lit(" "))
                              .otherwise(F.col("category")))
    return H8.resolve_with_model(m, blanked)


def q_document_language(spark, d):
    docs = notes(spark, d)
    lab = table(spark, d, "labels").select(F.col("doc_id").alias("user_id"))
    train = docs.join(lab, "user_id", "left_anti")
    test = docs.join(lab, "user_id", "left_semi")
    return H8.evaluate_category(H8.fit_category(train), test)


def q_predict_category_counted(spark, d):
    """H8 with a counted vocabulary: every expense of the ledger."""
    return H8b.predict_softmax(_fitted(spark, d, "softmax", "train"), ledger(spark, d).filter(F.col("t_type") == "expense")) \
        .select("tx_id", "user_id", "category", "predicted")


def q_evaluate_category_counted(spark, d):
    return H8b.evaluate_softmax(_fitted(spark, d, "softmax", "train"), _split(spark, d)[1])


def q_document_language_counted(spark, d):
    docs = notes(spark, d)
    lab = table(spark, d, "labels").select(F.col("doc_id").alias("user_id"))
    model = H8b.fit_softmax(docs.join(lab, "user_id", "left_anti"))
    return H8b.evaluate_softmax(model, docs.join(lab, "user_id", "left_semi"))


# ---- expense forest
def q_predict_expense(spark, d):
    _, test = _split(spark, d)
    m = _fitted(spark, d, "expense", "train")
    return H3.predict_expense(m, H3.expense_rows(test)).select("year", "month", "label", "prediction")


def q_evaluate_expense(spark, d):
    _, test = _split(spark, d)
    return H3.evaluate_expense(_fitted(spark, d, "expense", "train"), test)


# ---- anomalies
def q_detect_anomalies(spark, d):
    L = ledger(spark, d)
    m = _fitted(spark, d, "anomaly", "train")
    return H5.detect_anomalies(m, L).select("tx_id", "user_id", "tx_date", "category", "amount", "score")


def q_anomaly_messages(spark, d):
    L = ledger(spark, d)
    m = _fitted(spark, d, "anomaly", "all")
    return H5.anomaly_messages(H5.detect_anomalies(m, L))


def q_model_roundtrip(spark, d):
    """A fitted forest saved to and loaded from the shared folder flags the same rows."""
    L = ledger(spark, d)
    m = _fitted(spark, d, "anomaly", "all")
    path = _scratch(spark, "iforest")
    m.save(spark, path)
    m2 = H5.IsolationForestModel.load(spark, path)
    return H5.detect_anomalies(m2, L).select("tx_id", "score")


# ---- budget
def q_budget_clusters(spark, d):
    m = _fitted(spark, d, "budget", "train")
    from tallyspark.operators.rollups import category_matrix
    return H10.assign_clusters(m, category_matrix(ledger(spark, d), m.categories, by=[])).select("month", "cluster", "advice")


def q_budget_advice(spark, d):
    m = _fitted(spark, d, "budget", "train")
    return H10.budget_advice(m, ledger(spark, d)).withColumn("recommendations",
                                                             F.array_join("recommendations", " | "))


def q_insight_report(spark, d):
    L = ledger(spark, d)
    an = H5.detect_anomalies(_fitted(spark, d, "anomaly", "all"), L)
    adv = H10.budget_advice(_fitted(spark, d, "budget", "all"), L).select(
        "user_id", F.array_join("recommendations", " | ").alias("advice"))
    return insight_report(L, anomalies=an, advice=adv)


def q_insight_messages(spark, d):
    L = ledger(spark, d)
    an = H5.detect_anomalies(_fitted(spark, d, "anomaly", "all"), L)
    adv = H10.budget_advice(_fitted(spark, d, "budget", "all"), L).select("user_id", "recommendations")
    from tallyspark.plans.report import insight_messages
    return insight_messages(L, anomalies=an, advice=adv)


# ---- text, sampling, governance
def q_note_keywords(spark, d):
    return T.note_keywords(ledger(spark, d))


def q_document_keywords(spark, d):
    return T.note_keywords(notes(spark, d), by=["category"])


def q_transparency_sample(spark, d):
    return E.transparency_sample(ledger(spark, d))


def q_display_format(spark, d):
    return display_format(ledger(spark, d))


def q_sensitive_columns(spark, d):
    from tallyspark.sources.testdata import users
    return Q.sensitive_columns(users(spark, d))


def q_masked(spark, d):
    return Q.masked(ledger(spark, d)).select("tx_id", "note")


def _key_ring(spark) -> KeyRing:
    """A ring under two master keys made for this run (real ones come from configuration)."""
    return KeyRing(spark, _scratch(spark, "keys"), {"first": os.urandom(32), "second": os.urandom(32)})


def q_encryption_roundtrip(spark, d):
    """Notes and amounts encrypted at rest, income under one data key, expense under the next; all come back."""
    L = ledger(spark, d).select("tx_id", "t_type", "note", F.col("amount").cast("string").alias("amount"))
    ring, path = _key_ring(spark), _scratch(spark, "encrypted")
    for kind in ("income", "expense"):
        # base64 text holds six bits a byte: a codec that codes by frequency leaves a quarter of it away
        ring.encrypt(L.filter(F.col("t_type") == kind)).write.mode("append").option("compression", "zstd").parquet(path)
        ring.rotate()
    return ring.decrypt(spark.read.parquet(path)).select("tx_id", "note", "amount")


def q_encryption_coverage(spark, d):
    """I8: share of notes that decrypt, after encrypting the expense half of the ledger."""
    L, ring = ledger(spark, d), _key_ring(spark)
    sealed = ring.encrypt(L.filter(F.col("t_type") == "expense"), ["note"])
    plain = L.filter(F.col("t_type") == "income").withColumn("note", F.col("category")).withColumn("key_id", F.lit(ring.current()))
    return ring.coverage(sealed.unionByName(plain))


# ---- sources / sinks round trips
def q_csv_roundtrip(spark, d):
    path = _scratch(spark, "csv")
    A.write_csv(A.export_ledger(ledger(spark, d)), path)
    return A.read_ledger_csv(spark, path)


def q_json_roundtrip(spark, d):
    path = _scratch(spark, "json")
    A.write_json(A.export_ledger(ledger(spark, d)), path)
    return A.read_ledger_json(spark, path)


def q_append_ledger(spark, d):
    path = _scratch(spark, "ledger")
    L = ledger(spark, d)
    A.append_ledger(L.filter(F.col("t_type") == "income"), path)
    A.append_ledger(L.filter(F.col("t_type") == "expense"), path)
    return A.read_ledger_parquet(spark, path).drop("tx_month")


def q_append_events(spark, d):
    path = _scratch(spark, "events")
    e = audit_events(spark, d)
    A.append_events(e.filter(F.col("event_type") == "click"), path)
    A.append_events(e.filter(F.col("event_type") != "click"), path)
    return spark.read.parquet(path)


MODEL_QUERIES = {
    "predict_category": q_predict_category,
    "evaluate_category": q_evaluate_category,
    "suggest_categories": q_suggest_categories,
    "resolve_category": q_resolve_category,
    "document_language": q_document_language,
    "predict_category_counted": q_predict_category_counted,
    "evaluate_category_counted": q_evaluate_category_counted,
    "document_language_counted": q_document_language_counted,
    "predict_expense": q_predict_expense,
    "evaluate_expense": q_evaluate_expense,
    "detect_anomalies": q_detect_anomalies,
    "anomaly_messages": q_anomaly_messages,
    "model_roundtrip": q_model_roundtrip,
    "budget_clusters": q_budget_clusters,
    "budget_advice": q_budget_advice,
    "insight_report": q_insight_report,
    "insight_messages": q_insight_messages,
    "note_keywords": q_note_keywords,
    "document_keywords": q_document_keywords,
    "transparency_sample": q_transparency_sample,
    "display_format": q_display_format,
    "sensitive_columns": q_sensitive_columns,
    "masked": q_masked,
    "encryption_roundtrip": q_encryption_roundtrip,
    "encryption_coverage": q_encryption_coverage,
    "csv_roundtrip": q_csv_roundtrip,
    "json_roundtrip": q_json_roundtrip,
    "append_ledger": q_append_ledger,
    "append_events": q_append_events,
}


def _stop_sql() -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in ENGLISH_STOP_WORDS)


def model_oracle_sql(with_, ledger_cols: str) -> dict[str, str]:
    stop = _stop_sql()
    return {
        "note_keywords": with_("ledger") + f"""
            select distinct user_id, keyword from (
              select user_id, unnest(regexp_extract_all(lower(concat_ws(': ', category, note)), '\\p{{L}}+')) keyword
              from ledger where note is not null and note != '') t
            where keyword not in ({stop})""",
        "document_keywords": f"""
            select distinct category, keyword from (
              select lang category, unnest(regexp_extract_all(lower(concat_ws(': ', lang, text)), '\\p{{L}}+')) keyword
              from documents where text is not null and text != '') t
            where keyword not in ({stop})""",
        "csv_roundtrip": with_("ledger") + f"select {ledger_cols} from ledger",
        "json_roundtrip": with_("ledger") + f"select {ledger_cols} from ledger",
        "append_ledger": with_("ledger") + f"select {ledger_cols} from ledger",
        "append_events": """select event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') ts, user_id, event_type, value, props
                            from events""",
        "encryption_roundtrip": with_("ledger") + "select tx_id, note, cast(amount as varchar) amount from ledger",
        "sensitive_columns": with_("users") + "select 'username' as column_name, count(username) non_null from users",
        "masked": with_("ledger") + """
            select tx_id, regexp_replace(regexp_replace(regexp_replace(note, '[A-Z]', 'X', 'g'),
                                                        '[a-z]', 'x', 'g'), '[0-9]', 'n', 'g') note
            from ledger""",
        # expense notes are encrypted, income rows carry their (plain) category: the share that
        # decrypts is the expense share of each user's rows
        "encryption_coverage": with_("ledger") + """
            select user_id, avg(case when t_type = 'expense' then 1.0 else 0.0 end) encrypted_share, count(*) n
            from ledger where (case when t_type = 'expense' then note else category end) is not null
            group by user_id""",
    }
