"""Every query on hostile tables, against its SQL or a count; and against SQL on the driver's tables."""

from __future__ import annotations

import os
import random
from collections import Counter

import duckdb
import pytest

from chunkweave.llm.queries import QUERIES
from tests.llm.conftest import EXTRA_VALUES, edge_documents, edge_pages, fill
from tests.oracle import compare, duck

FOLDER = "/root/testdata/sf0.001"
WITH_SQL = sorted(name for name, (_, sql) in QUERIES.items() if sql)
PER_DOCUMENT = ["op1_quality_rules", "op3_bpe", "op6_ngram_join", "op7_language_id", "op8_secret_scans", "op10_token_counts", "op11_simhash"]


def tables_of(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in ("documents", "embeddings", "pages", "labels", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet/*.parquet')")
    return con


@pytest.mark.parametrize("name", WITH_SQL)
def test_sql_on_hostile_rows(spark, edges, name):
    query, sql = QUERIES[name]
    assert compare(spark, tables_of(edges), name, query, sql, edges).startswith("ok")


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")
@pytest.mark.parametrize("name", [n for n in WITH_SQL if n != "op6_ngram_join"])
def test_sql_on_given_tables(spark, name):
    query, sql = QUERIES[name]
    result = compare(spark, duck(FOLDER), name, query, sql, FOLDER)
    assert result.startswith("ok"), result


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, empty, name):
    assert QUERIES[name][0](spark, empty).collect() == []


@pytest.mark.parametrize("name", PER_DOCUMENT)
def test_repeated_rows_and_missing_ids(spark, repeated, name):
    rows = QUERIES[name][0](spark, repeated).collect()
    expected = Counter(r.doc_id for r in spark.read.parquet(f"{repeated}/documents.parquet").collect())
    assert Counter(r.doc_id for r in rows) == expected
    by_id: dict = {}
    for row in rows:
        if row.doc_id is not None:
            assert by_id.setdefault(row.doc_id, row) == row


@pytest.mark.parametrize("name", ["op2_exact_topk", "op4_url_filters", "op5_license_scans", "op9_mixing"])
def test_other_queries_on_repeated_rows(spark, repeated, name):
    assert QUERIES[name][0](spark, repeated).count() > 0


def test_search_and_clusters_of_repeated_rows_equal_sql(spark, tmp_path):
    """Rows given twice and different vectors under one id: every row counts."""
    rng = random.Random(7)
    rows = [(i, [rng.gauss(0, 1) for _ in range(64)], 0, *EXTRA_VALUES) for i in range(0, 600, 5)]
    rows += rows[:25] + [(5 * i, [rng.gauss(0, 1) for _ in range(64)], 1, *EXTRA_VALUES) for i in range(40)] + [rows[3]] * 60
    folder = fill(spark, tmp_path, edge_documents()[:2], rows, edge_pages()[:2], [])
    for name in ("op2_exact_topk", "op12_zone_clusters"):
        query, sql = QUERIES[name]
        result = compare(spark, tables_of(folder), name, query, sql, folder)
        assert result.startswith("ok"), result
