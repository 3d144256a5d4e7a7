"""Every query with an SQL form against DuckDB, on the smallest tables."""

from __future__ import annotations

import os
from pathlib import Path

import pytest
from oracle_check import check, connect

import __spark_entry__ as entry

SF_DIR = entry.SMOKE_DIR

pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


# one query per operator family; DRIFTWELL_ALL=1 runs every one
FAMILIES = (
    "detection_metrics threshold_without_calibration bootstrap_auc_interval calibration_report score_box_stats "
    "null_profile describe_numeric histogram50 value_counts_top10 crosstab_row_pct dense_row_numbers hash_split "
    "subgroup_weights mixture_weights calibration_weights csv_scan_clean one_hot variance_filter tfidf_held_out "
    "series_assembly ks_by_column js_by_column drifted_share knn_kl_score distance_score mmd_permutation_pvalue "
    "scores_json_roundtrip pending_work merge_previous_scores"
).split()
NAMES = sorted(entry.oracle_sql()) if os.environ.get("DRIFTWELL_ALL") else FAMILIES


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, con, name):
    problem, *_ = check(spark, con, name, entry.queries()[name], entry.oracle_sql()[name], SF_DIR)
    assert problem == ""


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_form_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(entry.HEADLINE) <= set(entry.queries())
