"""Some registered queries against their SQL, on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
TABLES = "documents benchmark pages embeddings events labels conversations".split()


def rows_of(frame):
    frame = frame[sorted(frame.columns)]
    return sorted((tuple(round(v, 6) if isinstance(v, float) else None if v is None or v != v else v for v in r) for r in frame.itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", ["content_hash_documents", "dedupe_self_join", "chemical_strip", "candidate_union", "similarity_check", "site_overview", "create_jobs", "url_policy", "block_replace", "prune", "crawl_summary"])
def test_query_equals_sql(spark, name):
    base = duckdb.connect()
    for t in TABLES:
        base.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = base.sql(__spark_entry__.oracle_sql()[name]).df()
    assert rows_of(__spark_entry__.queries()[name](spark, SF).toPandas()) == rows_of(want)


def test_every_oracle_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
