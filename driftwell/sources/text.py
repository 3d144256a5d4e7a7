"""TF-IDF vectors from documents."""

from __future__ import annotations

from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MAX_FEATURES = 500

# A token, and a short list of English function words of our own; pass ``stop_words`` to use a published one.
TOKEN = r"[\p{L}\p{N}_]{2,}"
STOP_WORDS = """
about above after again all also am an and any are as at be because been before being below between both but by
can could did do does doing down during each few for from further had has have having he her here hers him his how
if in into is it its itself just may me might more most must my no nor not now of off on once only or other our out
over own same she should so some such than that the their them then there these they this those through to too
under until up upon us very was we were what when where which while who whom why will with would you your yours
""".split()


def words(docs: DataFrame, *, row_id: str = "row_id", text: str = "text", stop_words: list[str] | None = None) -> DataFrame:
    """(row_id, term): every lower-cased word of two or more characters."""
    stop = STOP_WORDS if stop_words is None else stop_words
    found = docs.select(
        F.col(row_id).alias("row_id"),
        F.explode(F.regexp_extract_all(F.lower(F.col(text)), F.lit(TOKEN), F.lit(0))).alias("term"),
    )
    return found.filter(~F.col("term").isin(list(stop))) if stop else found


def frequent_terms(docs: DataFrame, *, max_features: int = MAX_FEATURES, **options) -> DataFrame:
    """(term): the most frequent words, ties in term order. Words are added up per task, so that no occurrence is shuffled."""
    counted = words(docs, **options).groupBy("term").agg(F.count("*").alias("total"))
    return counted.orderBy(F.desc("total"), "term").limit(max_features).select("term")


def tokens(docs: DataFrame, *, terms: DataFrame | None = None, **options) -> DataFrame:
    """(row_id, term, tf): the words of each document with their counts; with ``terms``, a list as long as a
    vocabulary, only those, left out before anything is shuffled."""
    found = words(docs, **options)
    if terms is not None:
        found = found.join(F.broadcast(terms), "term", "left_semi")
    return found.groupBy("row_id", "term").agg(F.count("*").alias("tf"))


def vocabulary(counts: DataFrame, n_docs: int, *, max_features: int = MAX_FEATURES) -> DataFrame:
    """(term, pos, idf): the most frequent terms, ties and positions in term order, with
    idf = ln((1 + n) / (1 + df)) + 1."""
    top = (
        counts.groupBy("term")
        .agg(F.sum("tf").alias("total"), F.count("*").alias("df"))
        .orderBy(F.desc("total"), "term")
        .limit(max_features)
    )
    pos = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("term")) - 1  # at most max_features rows
    idf = F.log((F.lit(1.0) + n_docs) / (F.lit(1.0) + F.col("df"))) + 1
    return top.select("term", pos.cast("int").alias("pos"), idf.alias("idf"))


def tfidf_entries(counts: DataFrame, vocab: DataFrame) -> DataFrame:
    """(row_id, pos, term, weight): unit-length weights of the terms in the vocabulary."""
    raw = counts.join(F.broadcast(vocab), "term").withColumn("_raw", F.col("tf") * F.col("idf"))
    norms = raw.groupBy("row_id").agg(F.sqrt(F.sum(F.col("_raw") * F.col("_raw"))).alias("_norm"))
    return raw.join(norms, "row_id").select("row_id", "pos", "term", (F.col("_raw") / F.col("_norm")).alias("weight"))


def tfidf_vectors(
    train: DataFrame,
    docs: DataFrame,
    *,
    row_id: str = "row_id",
    text: str = "text",
    max_features: int = MAX_FEATURES,
    stop_words: list[str] | None = None,
    keep: list[str] | None = None,
) -> DataFrame:
    """(row_id, keep..., v) for every document, the vocabulary coming from ``train``; a
    document without known terms is all zeros.

    Only the vocabulary, at most ``max_features`` terms, passes through the driver; the
    documents are then vectorised where they lie, without a shuffle.
    """
    options = {"row_id": row_id, "text": text, "stop_words": stop_words}
    counts = tokens(train, terms=frequent_terms(train, max_features=max_features, **options), **options)
    known = vocabulary(counts, train.count(), max_features=max_features).orderBy("pos").collect()
    listed = docs.select(
        F.col(row_id).alias("row_id"),
        *(keep or []),
        F.regexp_extract_all(F.lower(F.col(text)), F.lit(TOKEN), F.lit(0)).alias("words"),
    )
    counted = CountVectorizerModel.from_vocabulary(
        [r["term"] for r in known], inputCol="words", outputCol="tf"
    ).transform(listed)
    scale = ElementwiseProduct(scalingVec=Vectors.dense([r["idf"] for r in known]), inputCol="tf", outputCol="raw")
    unit = Normalizer(p=2.0, inputCol="raw", outputCol="unit")
    return unit.transform(scale.transform(counted)).select(
        "row_id", *(keep or []), vector_to_array("unit", "float32").alias("v")
    )
