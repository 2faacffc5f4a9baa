"""Queries against their SQL on the smallest tables, and the entry points."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
CHECKED = ["review_stats", "city_avg_stars", "city_avg_stars_all", "partition_profile", "set_operations", "transaction_baskets", "item_cf", "cf_cold_start", "blend_piecewise", "bloom_fpr", "fm_estimate", "reservoir_sample", "bfr_assign", "review_counts_json", "city_csv", "candidates_report", "similar_pairs", "user_features", "community_report", "community_numbers", "betweenness_report"]


def shown(x):
    return round(x, 5) + 0.0 if isinstance(x, float) else x if isinstance(x, int | bool | None.__class__) else str(x)


@pytest.fixture(scope="module")
def duck():
    if not Path(DATA).exists():
        pytest.skip("no stored tables")
    made = duckdb.connect()
    for file in Path(DATA).glob("*.parquet"):
        made.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return made


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    expected = duck.sql(entry.oracle_sql()[name])
    places = [expected.columns.index(c) for c in columns]
    got = sorted((tuple(shown(r[c]) for c in columns) for r in df.collect()), key=repr)
    assert got == sorted((tuple(shown(r[i]) for i in places) for r in expected.fetchall()), key=repr)


def test_entry_points(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    if Path(DATA).exists():
        assert entry.entry(spark).count() > 0
