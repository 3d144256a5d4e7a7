"""The training-data pipeline: five stages over ``documents``, each written and read again.

1. language: documents without a recognisable language go.
2. near_duplicates: one document of each group linked by n-gram Jaccard stays, the one with the smallest doc_id.
   A row is a document: rows without a doc_id (the last of all) and rows that share one are judged by themselves.
3. substrings: words of long spans that an earlier document has too are cut out of the text.
4. decontamination: documents that hold a benchmark item go.
5. encode: token counts and digests of the byte-level BPE ids, and of the text decoded from them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwell.llm import bpe, decontamination, jaccard, language, substrings
from driftwell.llm.shared import table
from driftwell.session import cut_lineage, ensure_checkpoint_dir

KEY, ROW = "doc_id", "__row"


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.known_language(docs)


def numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with a number of each row, in order of doc_id, nulls last: doc_id itself where it names every row."""
    odd = docs.groupBy(KEY).count().filter(f"count > 1 OR {KEY} IS NULL")
    if odd.limit(1).count() == 0:
        return docs.withColumn(ROW, F.col(KEY).cast("long"))
    # ties by text and place, so that no key fills one task of the sort
    order = docs.withColumn("__place", F.monotonically_increasing_id()).orderBy(F.asc_nulls_last(KEY), F.xxhash64("text"), "__place")
    return cut_lineage(order.drop("__place").withColumn(ROW, F.monotonically_increasing_id()))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = numbered(docs)
    groups = jaccard.jaccard_components(rows, ROW)
    kept = cut_lineage(groups.filter(F.col(ROW) == F.col("component_id")).select(ROW))
    return rows.join(kept, ROW, "left_semi").select(*docs.columns)


def repeated_substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = substrings.without_repeats(numbered(docs), ROW).select(*docs.columns)
    return cut.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else cut


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.encoded(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("language", known_language),
    ("near_duplicates", near_duplicates),
    ("substrings", repeated_substrings),
    ("decontamination", decontaminated),
    ("encode", encoded),
]

#: A kernel classifier and the tokenizer's merges have no SQL form; the tests hold run() against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the result of each is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
