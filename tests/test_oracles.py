"""Registered queries against their SQL on the smallest data set (all of them: ``python -m tests.oracle``)."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry
from tests.oracle import compare, duck

FOLDER = "/root/testdata/sf0.001"
CHOSEN = [
    "source_scan", "ext_counts", "line_chunks", "chunk_ids", "chunk_ids_ranged", "token_counts", "cache_reuse", "to_embed",
    "reuse_counts", "incremental_embed", "quantize_half", "topk_exact", "topk_grid", "topk_by_packet", "text_query",
    "md_sections", "code_segments", "java_segments", "brace_sections", "micro_split", "pack_lines", "routed_chunks",
    "multi_view", "chunk_limits", "dispatched_segments", "segment_keys", "enrich_defaults", "chunk_warnings",
    "version_order", "resolve_versions", "prune_plan", "publish_outcome", "model_choice", "tree_hash", "drift_report",
]

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(CHOSEN) <= set(entry.oracle_sql())


def test_entry(spark):
    frame = entry.entry(spark)
    assert frame.columns == ["query_id", "rank", "chunk_id", "score"] and frame.count() > 0


@pytest.mark.parametrize("name", CHOSEN)
def test_query_equals_sql(spark, con, name):
    result = compare(spark, con, name, entry.queries()[name], entry.oracle_sql()[name], FOLDER)
    assert result.startswith("ok"), result
