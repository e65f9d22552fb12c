"""Registered queries against their SQL twins at the smallest scale.

Set SPARKWARDEN_ALL=1 to run every query; by default a cross-section runs.  ``check.py`` does the
same at any scale.
"""

import os

import duckdb
import pytest

import __spark_entry__ as entry
import check

SF = "/root/testdata/sf0.001"
SAMPLE = ("rank_files_by_finding", "mask_secrets", "path_filters", "graph_neighbourhood_edges", "call_paths", "impact_context", "rank_files",
          "route_findings", "cwe_prefilter", "upsert_snapshot", "hybrid_search", "cve_list_page", "top_products", "band_match", "innermost_container",
          "oracle_labels", "text_context_topk", "score_functions", "stream_trend", "stream_sync", "stream_dedup")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in check.TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", list(entry.oracle_sql()) if os.environ.get("SPARKWARDEN_ALL") else SAMPLE)
def test_query(spark, con, name):
    df = entry.queries()[name](spark, SF)
    cur = con.execute(entry.oracle_sql()[name])
    got = check.rows_of(df.columns, [tuple(r) for r in df.collect()])
    assert got == check.rows_of([d[0] for d in cur.description], cur.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
