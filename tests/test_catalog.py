"""Registered queries against their SQL on the smallest scale."""

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent / "tools"))

from compare import TABLES, rows_of  # noqa: E402

import __spark_entry__ as contract  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"
# One query per family; tools/compare.py runs all of them.
CHECKED = [
    "scan_csv_semicolon", "normalize_key", "split_mixture", "name_lookup", "group_mean_median_count", "build_master",
    "rule_match", "rule_match_table", "alert_explanation", "health_report", "score_entities", "score_mixtures",
    "component_pairs", "batch_route", "top_terms", "stratified_split", "roc_curve", "evaluation_tables",
    "token_count_features", "feature_table", "row_attribution_topk", "scan_json_metrics",
]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, duck, name):
    df = contract.queries()[name](spark, SF_DIR)
    result = duck.execute(contract.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(columns, result.fetchall())


def test_entry_gives_rows(spark):
    assert contract.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())
