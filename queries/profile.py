"""Table profile queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftwell.operators import profile as P
from driftwell.operators import report as R
from driftwell.operators.columns import ks_by_column
from driftwell.operators.ordered import exact_percentiles
from queries import query
from queries.common import as_output, table
from queries.metrics import box_sql

MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
FLAGS = ["l_returnflag", "l_linestatus"]


def each(template: str, columns: list[str]) -> str:
    return " UNION ALL ".join(template.format(c=c) for c in columns)


def covered_documents(spark, sf):
    """Documents with their labels; those without labels have nulls."""
    docs = table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")
    return docs.join(table(spark, sf, "labels"), "doc_id", "left")


COVERED = "covered AS (SELECT doc_id, lang, source, n_chars, quality, toxic FROM documents LEFT JOIN labels USING (doc_id))"
COVERED_COLUMNS = ["doc_id", "lang", "source", "n_chars", "quality", "toxic"]


@query("table_shape", "SELECT count(*) AS n_rows, 11::INT AS n_columns FROM lineitem")
def table_shape(spark, sf):
    return P.shape(table(spark, sf, "lineitem"))


@query(
    "column_types",
    f"""WITH {COVERED} SELECT * FROM ({each("SELECT '{c}' AS \"column\", count({c}) AS non_null FROM covered", COVERED_COLUMNS)})
    JOIN (VALUES ('doc_id', 'bigint'), ('lang', 'string'), ('source', 'string'), ('n_chars', 'bigint'),
      ('quality', 'int'), ('toxic', 'int')) t("column", type) USING ("column")""",
)
def column_types(spark, sf):
    return P.column_types(covered_documents(spark, sf))


@query("head_rows", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 10")
def head_rows(spark, sf):
    return P.head(table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), ["o_orderkey"])


@query(
    "null_profile",
    f"WITH {COVERED} SELECT * FROM ({each("SELECT '{c}' AS \"column\", count(*) - count({c}) AS n_null FROM covered", COVERED_COLUMNS)}) WHERE n_null > 0",
)
def null_profile(spark, sf):
    return P.null_counts(covered_documents(spark, sf))


@query(
    "null_percentage",
    f"""WITH {COVERED} SELECT round(sum({" + ".join(f"({c} IS NULL)::INT" for c in COVERED_COLUMNS)}) / count(*)::DOUBLE * 100, 6)
    AS null_percentage FROM covered""",
)
def null_percentage(spark, sf):
    return as_output(P.null_percentage(covered_documents(spark, sf)))


@query(
    "describe_numeric",
    each(
        """SELECT '{c}' AS "column", count({c}) AS count, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std,
        min({c}) AS min, round(quantile_cont({c}, 0.25), 6) AS q1, round(quantile_cont({c}, 0.5), 6) AS median,
        round(quantile_cont({c}, 0.75), 6) AS q3, max({c}) AS max FROM lineitem""",
        MEASURES,
    ),
)
def describe_numeric(spark, sf):
    return as_output(P.describe(table(spark, sf, "lineitem"), MEASURES))


@query(
    "histogram50",
    each(
        """SELECT '{c}' AS "column",
        least(floor(({c} - lo) / (hi - lo) * 50) + 1, 50)::INT AS bin, count(*) AS n, round(max(md), 6) AS median
        FROM lineitem, (SELECT min({c}) AS lo, max({c}) AS hi, quantile_cont({c}, 0.5) AS md FROM lineitem) GROUP BY 1, 2""",
        MEASURES,
    ),
)
def histogram50(spark, sf):
    return as_output(P.histogram(table(spark, sf, "lineitem"), MEASURES))


CUSTOMER_KINDS = ["c_mktsegment", "c_nationkey"]


@query(
    "value_counts_top10",
    f"""WITH c AS ({each('SELECT {q}{{c}}{q} AS "column", {{c}}::VARCHAR AS value, count(*) AS n FROM customer GROUP BY 2'.format(q="'"), CUSTOMER_KINDS)}),
    r AS (SELECT *, sum(n) OVER (PARTITION BY "column") AS total, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS k FROM c)
    SELECT "column", value, n, round(n::DOUBLE / total * 100, 2) AS percentage FROM r WHERE k <= 10""",
)
def value_counts_top10(spark, sf):
    return as_output(P.top_values(table(spark, sf, "customer"), CUSTOMER_KINDS))


@query(
    "distinct_counts",
    each("SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS n_distinct FROM lineitem", [*FLAGS, "l_quantity", "l_shipdate"]),
)
def distinct_counts(spark, sf):
    return P.distinct_values(table(spark, sf, "lineitem"), [*FLAGS, "l_quantity", "l_shipdate"])


@query(
    "crosstab_row_pct",
    """SELECT l_returnflag, l_linestatus, round(count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY l_returnflag) * 100, 6) AS percentage
    FROM lineitem GROUP BY 1, 2""",
)
def crosstab_row_pct(spark, sf):
    return as_output(P.row_percentages(table(spark, sf, "lineitem"), "l_returnflag", "l_linestatus"))


@query("box_by_group", f"WITH {box_sql('lineitem', 'l_returnflag', 'l_extendedprice')}")
def box_by_group(spark, sf):
    return as_output(R.box_statistics(table(spark, sf, "lineitem"), ["l_returnflag"], "l_extendedprice"))


@query(
    "subgroup_candidates",
    """SELECT 'returned' AS candidate, round(avg((l_returnflag = 'R')::INT::DOUBLE) * 100, 6) AS percentage FROM lineitem
    UNION ALL SELECT 'open', round(avg((l_linestatus = 'O')::INT::DOUBLE) * 100, 6) FROM lineitem""",
)
def subgroup_candidates(spark, sf):
    tests = {"returned": F.col("l_returnflag") == "R", "open": F.col("l_linestatus") == "O"}
    return as_output(P.share_percentage(table(spark, sf, "lineitem"), tests))


# ---- epoch seconds: many distinct values in a narrow band far from zero


def event_seconds(spark, sf):
    seconds = F.unix_seconds(F.col("ts").cast("timestamp")).cast("double")
    return table(spark, sf, "events").select(F.col("event_id").alias("row_id"), "event_type", seconds.alias("seconds"))


SECONDS_SQL = "secs AS (SELECT event_type, floor(epoch(ts))::DOUBLE AS seconds FROM events)"


@query(
    "event_time_percentiles",
    f"""WITH {SECONDS_SQL} SELECT event_type, round(quantile_cont(seconds, 0.05), 6) AS p05, round(quantile_cont(seconds, 0.5), 6) AS p50,
    round(quantile_cont(seconds, 0.95), 6) AS p95 FROM secs GROUP BY 1""",
)
def event_time_percentiles(spark, sf):
    return as_output(exact_percentiles(event_seconds(spark, sf), ["event_type"], "seconds", {"p05": 0.05, "p50": 0.5, "p95": 0.95}))


@query(
    "event_time_ks",
    f"""WITH {SECONDS_SQL}, counts AS (SELECT seconds, count(*) FILTER (event_type = 'error') AS r,
      count(*) FILTER (event_type <> 'error') AS t FROM secs GROUP BY 1)
    SELECT 'seconds' AS "column", round(max(gap), 6) AS statistic FROM (
      SELECT abs(sum(r) OVER w / sum(r) OVER () - sum(t) OVER w / sum(t) OVER ()) AS gap FROM counts WINDOW w AS (ORDER BY seconds))""",
)
def event_time_ks(spark, sf):
    rows = event_seconds(spark, sf)
    errors = F.col("event_type") == "error"
    return as_output(ks_by_column(rows.filter(errors), rows.filter(~errors), ["seconds"]).select("column", "statistic"))
