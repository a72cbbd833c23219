"""Category classifier from note text.

Word 1- and 2-gram TF-IDF with L2 normalisation and multinomial logistic
regression, built from Spark ML stages.  The scikit-learn flavour of the
reference is kept where it changes results:

* tokens are ``(?U)\\b\\w\\w+\\b`` in lower case, bigrams joined by a space;
* idf is ``ln((n+1)/(df+1)) + 1`` (Spark's idf plus one), applied to raw term
  counts, then each row is L2-normalised;
* the L2 penalty with C = 1 is ``regParam = 1/n`` without standardisation.

Terms are hashed into a fixed feature space instead of a driver-side
vocabulary, so the model size does not grow with the corpus.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import (IDF, ElementwiseProduct, HashingTF, IndexToString, NGram, Normalizer,
                                RegexTokenizer, SQLTransformer, StringIndexer)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.operators.filters import labelled_notes

TOKEN_PATTERN = r"(?U)\b\w\w+\b"
NUM_FEATURES = 1 << 16


def _featurizer() -> list:
    return [
        RegexTokenizer(inputCol="note", outputCol="_tokens", pattern=TOKEN_PATTERN, gaps=False,
                       toLowercase=True, minTokenLength=1),
        NGram(n=2, inputCol="_tokens", outputCol="_bigrams"),
        SQLTransformer(statement="SELECT *, concat(_tokens, _bigrams) AS _terms FROM __THIS__"),
        HashingTF(inputCol="_terms", outputCol="_tf", numFeatures=NUM_FEATURES),
    ]


def fit_category(df: DataFrame, max_iter: int = 1000) -> PipelineModel:
    """H8: fit on rows with both note and category."""
    train = labelled_notes(df).select("note", "category")
    feats = Pipeline(stages=_featurizer()).fit(train)
    # kept for the iterations: the counts alone, not the texts, words and word pairs they were made from
    tf = feats.transform(train).select("category", "_tf").cache()
    n = tf.count()
    idf = IDF(inputCol="_tf", outputCol="_idf").fit(tf)
    scale = DenseVector(idf.idf.toArray() + 1.0)
    weigh = ElementwiseProduct(scalingVec=scale, inputCol="_tf", outputCol="_tfidf")
    norm = Normalizer(p=2.0, inputCol="_tfidf", outputCol="features")
    indexer = StringIndexer(inputCol="category", outputCol="label", stringOrderType="alphabetAsc").fit(tf)
    prepared = norm.transform(weigh.transform(indexer.transform(tf)))
    lr = LogisticRegression(family="multinomial", regParam=1.0 / max(n, 1), elasticNetParam=0.0,
                            standardization=False, maxIter=max_iter, tol=1e-4).fit(prepared)
    to_label = IndexToString(inputCol="prediction", outputCol="predicted", labels=indexer.labels)
    tf.unpersist()
    return PipelineModel(stages=list(feats.stages) + [weigh, norm, indexer, lr, to_label])


def _strip(out: DataFrame, keep: Sequence[str]) -> DataFrame:
    internal = ("features", "rawPrediction", "prediction", "probability", "label")
    return out.drop(*[c for c in out.columns
                      if (c.startswith("_") or c in internal) and c not in keep])


def predict_category(model: PipelineModel, df: DataFrame) -> DataFrame:
    """H8: ``predicted`` category and class ``probability`` for rows with a note."""
    rows = df.filter(F.col("note").isNotNull())
    if "category" not in rows.columns:
        rows = rows.withColumn("category", F.lit(None).cast("string"))
    # StringIndexer would reject unseen labels: keep them, they only matter for evaluation.
    idx = [s for s in model.stages if hasattr(s, "labels") and s.__class__.__name__ == "StringIndexerModel"][0]
    idx.setHandleInvalid("keep")
    out = model.transform(rows)
    return _strip(out, ["probability"])


def evaluate_category(model: PipelineModel, df: DataFrame) -> DataFrame:
    """H9: accuracy on labelled rows (0 when none), as a one-row frame."""
    p = predict_category(model, labelled_notes(df))
    return p.agg(F.coalesce(F.avg((F.col("predicted") == F.col("category")).cast("double")), F.lit(0.0))
                 .alias("accuracy"), F.count(F.lit(1)).alias("n_test"))


def suggest_categories(model: PipelineModel, df: DataFrame, n: int = 3, key: str = "tx_id") -> DataFrame:
    """The ``n`` most probable categories per row, with their probabilities."""
    labels = [s for s in model.stages if s.__class__.__name__ == "StringIndexerModel"][0].labels
    p = predict_category(model, df)
    pairs = F.transform(vector_to_array("probability"), lambda x, i: F.struct((-x).alias("low"), i.alias("cls")))
    top = p.select(key, F.posexplode(F.slice(F.array_sort(pairs), 1, n)).alias("pos", "t"))
    lab = F.element_at(F.array(*[F.lit(x) for x in labels]), F.col("t.cls") + 1)
    return top.select(key, (F.col("pos") + 1).alias("rank"), lab.alias("category"), (-F.col("t.low")).alias("probability"))


def resolve_with_model(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Typed category, else the model's suggestion for the note, else ``uncategorized``.

    Predicted in place, without a join, so repeated ids stay single rows.
    """
    from tallyspark.operators.filters import resolve_category
    has_note = F.col("note").isNotNull()
    rows = df.withColumns({"typed_category": F.col("category"), "category": F.lit(None).cast("string"),
                           "has_note": has_note, "note": F.coalesce("note", F.lit(""))})
    p = predict_category(model, rows).withColumns({
        "category": F.col("typed_category"), "predicted": F.when(F.col("has_note"), F.col("predicted")),
        "note": F.when(F.col("has_note"), F.col("note"))})
    return resolve_category(p).select(df.columns)
