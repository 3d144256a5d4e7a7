"""Source and feature-view queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from driftwell.operators import views as V
from driftwell.session import cut_lineage, ensure_checkpoint_dir
from driftwell.sources.delimited import clean_rows, read_delimited, read_vectors
from driftwell.sources.series import assemble_series
from driftwell.sources.text import STOP_WORDS, frequent_terms, tfidf_entries, tfidf_vectors, tokens, vocabulary
from queries import query
from queries.common import as_output, rounded, table
from queries.profile import COVERED, covered_documents
from queries.resample import line_items

START, DAYS = "2024-01-01", 30


def fresh_folder(spark, name: str) -> str:
    """A new folder under the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


# ---- scans and rows


@query(
    "csv_scan_clean",
    """SELECT c_custkey, c_acctbal, c_mktsegment, 'nation ' || c_nationkey AS nation FROM customer
    WHERE c_custkey % 7 <> 0 AND c_custkey % 11 <> 0""",
)
def csv_scan_clean(spark, sf):
    """Customers written as a headerless file with blanks and '?' marks, read back and cleaned."""
    path = fresh_folder(spark, "scan")
    segment = F.when(F.col("c_custkey") % 7 == 0, "?").otherwise(F.concat(F.col("c_mktsegment"), F.lit("  ")))
    balance = F.when(F.col("c_custkey") % 11 == 0, "").otherwise(F.col("c_acctbal").cast("string"))
    line = F.concat_ws(", ", F.col("c_custkey").cast("string"), balance, segment, F.concat(F.lit("nation "), F.col("c_nationkey").cast("string")))
    table(spark, sf, "customer").select(line.alias("value")).write.text(path)
    schema = "c_custkey bigint, c_acctbal double, c_mktsegment string, nation string"
    return clean_rows(read_delimited(spark, path, schema))


@query("vector_scan", "SELECT vec_id AS row_id, label, len(embedding)::INT AS width, round(list_sum(embedding::DOUBLE[]), 6) AS total FROM embeddings")
def vector_scan(spark, sf):
    rows = read_vectors(spark, f"{sf}/embeddings.parquet", row_id="vec_id", vector="embedding", label="label")
    total = F.aggregate(F.col("v").cast("array<double>"), F.lit(0.0), lambda a, x: a + x)
    return rows.select("row_id", "label", F.size("v").alias("width"), rounded(total).alias("total"))


@query("trim_strings", "SELECT part_key, trim(name) AS name FROM (SELECT p_partkey AS part_key, '  ' || p_name || ' ' AS name FROM part)")
def trim_strings(spark, sf):
    padded = table(spark, sf, "part").select(
        F.col("p_partkey").alias("part_key"), F.concat(F.lit("  "), "p_name", F.lit(" ")).alias("name")
    )
    return V.trim_columns(padded, ["name"])


@query("drop_incomplete_rows", f"WITH {COVERED} SELECT * FROM covered WHERE quality IS NOT NULL AND toxic IS NOT NULL AND lang IS NOT NULL AND source IS NOT NULL")
def drop_incomplete_rows(spark, sf):
    return V.drop_incomplete(covered_documents(spark, sf))


@query("class_filter", "SELECT vec_id, label FROM embeddings WHERE label IN (0, 1)")
def class_filter(spark, sf):
    return V.keep_classes(table(spark, sf, "embeddings").select("vec_id", "label"), "label", [0, 1])


@query("subgroup_complement", f"WITH {COVERED} SELECT coalesce(quality = 1, FALSE)::INT AS inside, count(*) AS n FROM covered GROUP BY 1")
def subgroup_complement(spark, sf):
    """Rows without a label stay on the outside of the subgroup."""
    inside = V.in_subgroup("quality", 1).cast("int").alias("inside")
    return covered_documents(spark, sf).groupBy(inside).agg(F.count("*").alias("n"))


@query("numeric_selection", "SELECT s_suppkey, s_nationkey, s_acctbal FROM supplier")
def numeric_selection(spark, sf):
    rows = table(spark, sf, "supplier")
    return rows.select(*V.numeric_columns(rows))


@query("label_dropped", "SELECT p_partkey, p_name, p_brand, p_size, p_retailprice FROM part")
def label_dropped(spark, sf):
    return table(spark, sf, "part").drop("p_type")


SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query(
    "one_hot",
    """WITH long AS (SELECT c_custkey, 0 AS pos, c_acctbal::FLOAT::DOUBLE AS value FROM customer
      UNION ALL SELECT c_custkey, 1, c_nationkey::DOUBLE FROM customer
      UNION ALL SELECT c_custkey, 1 + s.k, (c_mktsegment = s.seg)::INT::DOUBLE FROM customer,
        (SELECT seg, row_number() OVER (ORDER BY seg) AS k FROM (SELECT DISTINCT c_mktsegment AS seg FROM customer)) s)
    SELECT c_custkey AS row_id, pos::INT AS pos, round(value, 6) AS value FROM long""",
)
def one_hot(spark, sf):
    rows = table(spark, sf, "customer")
    known = V.learn_categories(rows, ["c_mktsegment"])
    encoded = V.one_hot(rows, "c_custkey", ["c_acctbal", "c_nationkey"], known)
    return encoded.select("row_id", F.posexplode("v").alias("pos", "value")).select(
        "row_id", "pos", rounded(F.col("value").cast("double")).alias("value")
    )


# ---- vectors


@query(
    "variance_filter",
    """SELECT pos::INT AS pos, round(var_pop(x), 6) AS variance
    FROM (SELECT unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS pos FROM embeddings) GROUP BY 1 HAVING var_pop(x) > 1e-8""",
)
def variance_filter(spark, sf):
    rows = table(spark, sf, "embeddings").select(F.col("embedding").alias("v"))
    return as_output(V.feature_variances(rows).filter(F.col("variance") > V.VARIANCE_FLOOR))


FIRST_SQL = ", ".join(f"embedding[{i + 1}]::DOUBLE AS f{i}" for i in range(V.FIRST_FEATURES))


@query("feature_slice", f"SELECT vec_id AS row_id, {FIRST_SQL} FROM embeddings")
def feature_slice(spark, sf):
    rows = table(spark, sf, "embeddings").select(F.col("vec_id").alias("row_id"), F.col("embedding").cast("array<double>").alias("v"))
    return V.as_columns(V.first_features(rows), V.FIRST_FEATURES)


# ---- text

STOP_SQL = ", ".join(f"'{w}'" for w in STOP_WORDS)


def tfidf_sql(train: str, docs: str) -> str:
    """CTEs ending in ``entries(row_id, pos, term, weight)``."""

    def words(source: str) -> str:
        return f"""(SELECT row_id, term, count(*) AS tf FROM
          (SELECT row_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS term FROM {source})
          WHERE term NOT IN ({STOP_SQL}) GROUP BY 1, 2)"""

    return f"""train_words AS {words(train)}, doc_words AS {words(docs)},
    top AS (SELECT term, count(*) AS df FROM train_words GROUP BY 1 ORDER BY sum(tf) DESC, term LIMIT 500),
    vocab AS (SELECT term, row_number() OVER (ORDER BY term) - 1 AS pos,
      ln((1.0::DOUBLE + (SELECT count(*) FROM {train})) / (1.0::DOUBLE + df)) + 1 AS idf FROM top),
    raw AS (SELECT row_id, pos, term, tf * idf AS w FROM doc_words JOIN vocab USING (term)),
    entries AS (SELECT row_id, pos, term, w / sqrt(sum(w * w) OVER (PARTITION BY row_id)) AS weight FROM raw)"""


def documents(spark, sf):
    return table(spark, sf, "documents").withColumnRenamed("doc_id", "row_id")


ALL_DOCS = "docs AS (SELECT doc_id AS row_id, text, lang, source FROM documents)"


@query("tfidf_vectors", f"WITH {ALL_DOCS}, {tfidf_sql('docs', 'docs')} SELECT row_id, pos::INT AS pos, term, round(weight, 6) AS weight FROM entries")
def tfidf_entries_query(spark, sf):
    docs = documents(spark, sf)
    counts = tokens(docs, terms=cut_lineage(frequent_terms(docs)))
    return as_output(tfidf_entries(counts, vocabulary(counts, docs.count())))


@query(
    "tfidf_held_out",
    f"""WITH {ALL_DOCS}, known AS (SELECT * FROM docs WHERE lang = 'en'), others AS (SELECT * FROM docs WHERE lang <> 'en'),
    {tfidf_sql('known', 'others')} SELECT row_id, pos::INT AS pos, round(weight::FLOAT::DOUBLE, 6) AS value FROM entries""",
)
def tfidf_held_out(spark, sf):
    """Other languages over the vocabulary of the English documents, as dense vectors."""
    docs = documents(spark, sf)
    vectors = tfidf_vectors(docs.filter("lang = 'en'"), docs.filter("lang <> 'en'"))
    entries = vectors.select("row_id", F.posexplode("v").alias("pos", "value")).filter("value <> 0")
    return as_output(entries.withColumn("value", F.col("value").cast("double")))


@query(
    "reference_variance_filter",
    f"""WITH docs AS (SELECT doc_id AS row_id, text, lang FROM documents WHERE lang IN ('en', 'de')), {tfidf_sql('docs', 'docs')},
    lens AS (SELECT count(*) AS n, count(*) FILTER (lang = 'en') AS m FROM docs),
    moments AS (SELECT pos, sum(x) AS s, sum(x * x) AS ss, coalesce(sum(x) FILTER (lang = 'en'), 0) AS rs, coalesce(sum(x * x) FILTER (lang = 'en'), 0) AS rss
      FROM (SELECT row_id, pos, weight::FLOAT::DOUBLE AS x FROM entries) JOIN docs USING (row_id) GROUP BY 1),
    v AS (SELECT pos, ss / n - (s / n) ^ 2 AS var_all, rss / m - (rs / m) ^ 2 AS var_ref FROM moments, lens)
    SELECT (row_number() OVER (ORDER BY pos) - 1)::INT AS pos, round(var_ref, 6) AS variance FROM v WHERE var_all > 1e-8 AND var_ref > 1e-8""",
)
def reference_variance_filter(spark, sf):
    """Features that vary in all documents and within the English reference."""
    docs = documents(spark, sf).filter(F.col("lang").isin("en", "de"))
    weighted = cut_lineage(tfidf_vectors(docs, docs, keep=["lang"]))
    varying = V.keep_positions(weighted, V.varying_positions(weighted))
    reference = varying.filter("lang = 'en'")
    kept = V.keep_positions(reference, V.varying_positions(reference))
    return as_output(V.feature_variances(kept))


# ---- series

SERIES_SQL = f"""daily AS (SELECT user_id, event_type, datediff('day', DATE '{START}', ts::DATE) AS d, avg(value) AS m FROM events GROUP BY 1, 2, 3),
  entities AS (SELECT user_id, event_type, user_id::VARCHAR || '|' || event_type AS row_id, count(*) AS n_filled FROM daily WHERE d BETWEEN 0 AND {DAYS - 1} GROUP BY 1, 2),
  series AS (SELECT e.*, t.d, coalesce(y.m, 0)::FLOAT::DOUBLE AS x
    FROM entities e CROSS JOIN range({DAYS}) t(d) LEFT JOIN daily y ON y.user_id = e.user_id AND y.event_type = e.event_type AND y.d = t.d)"""


def event_series(spark, sf):
    return assemble_series(
        table(spark, sf, "events"), ["user_id", "event_type"], time="ts", value="value", start=START, length=DAYS
    )


@query("series_assembly", f"WITH {SERIES_SQL} SELECT row_id, event_type, n_filled::INT AS n_filled, d::INT AS day, round(x, 6) AS value FROM series")
def series_assembly(spark, sf):
    long = event_series(spark, sf).select("row_id", "event_type", "n_filled", F.posexplode("v").alias("day", "value"))
    return as_output(long.withColumn("value", F.col("value").cast("double")))


@query(
    "pca_distances",
    """WITH x AS (SELECT c_custkey AS row_id, [c_acctbal::FLOAT::DOUBLE, c_nationkey::DOUBLE, (c_mktsegment = 'AUTOMOBILE')::INT::DOUBLE,
      (c_mktsegment = 'BUILDING')::INT::DOUBLE, (c_mktsegment = 'FURNITURE')::INT::DOUBLE, (c_mktsegment = 'HOUSEHOLD')::INT::DOUBLE,
      (c_mktsegment = 'MACHINERY')::INT::DOUBLE] AS v FROM customer)
    SELECT a.row_id, round(avg(list_distance(a.v, b.v)), 4) AS mean_distance FROM x a, x b GROUP BY 1""",
)
def pca_distances(spark, sf):
    """Mean distance to all customers after a full-width projection, which keeps distances."""
    from driftwell.operators.pairs import mean_distances

    rows = table(spark, sf, "customer")
    encoded = V.one_hot(rows, "c_custkey", ["c_acctbal", "c_nationkey"], V.learn_categories(rows, ["c_mktsegment"]))
    _, projected = V.pca_views(encoded, encoded, 16)
    return as_output(mean_distances(projected, projected), 4)
