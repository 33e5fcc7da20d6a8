"""The pipeline's stages against what each of them promises, on a small folder."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from chunkweave.llm.common import stored, tokenizer_path
from tests.llm.conftest import EXTRA

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    found = [docs]
    for name, stage in corpus_pipeline.STAGES:
        found.append(stored(stage(spark, found[-1], FOLDER), name))
    return found


def test_stages_keep_the_columns_and_clean_documents(steps):
    raw, recognised, single, masked, mixed, encoded = steps
    for frame in (recognised, single, masked, mixed):
        assert frame.schema == raw.schema
    assert recognised.count() == raw.filter("text rlike '\\\\p{L}'").count()
    ids = [{r.doc_id for r in f.select("doc_id").collect()} for f in steps]
    assert all(later <= earlier for earlier, later in zip(ids, ids[1:], strict=False))
    assert ids[3] == ids[2] and len(ids[4]) > len(ids[3]) * 0.6


def words5(text: str) -> set:
    w = text.split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())  # as the operator defines short texts


def test_one_document_of_each_group_stays(steps):
    before, after = ({r.doc_id: r.text for r in f.collect()} for f in steps[1:3])
    sets = {i: words5(t) for i, t in before.items()}

    def alike(i, j):
        return len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) > 0

    kept = set(after)
    assert not any(alike(i, j) for i in kept for j in kept if i < j)
    for gone in set(before) - kept:
        assert any(alike(gone, j) and j != gone for j in before)


def test_texts_change_only_where_secrets_were(spark, steps):
    before, after = ({r.doc_id: r for r in f.collect()} for f in steps[2:4])
    scans = corpus_pipeline.secret_scans
    found = {r.doc_id for r in scans.digests(scans.scan_secrets(steps[2])).filter("spans <> ''").collect()}
    assert {i for i in before if before[i].text != after[i].text} == found
    assert all("[SECRET]" in after[i].text and after[i].n_chars == len(after[i].text) for i in found)
    again = scans.digests(scans.scan_secrets(steps[3]))
    assert again.filter("n_assign + n_access + n_hex > 0").count() == 0


def test_ids_equal_the_library(steps):
    library = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    texts = {r.doc_id: r.text for r in steps[4].collect()}
    rows = steps[5].collect()
    assert {r.doc_id for r in rows} == set(texts)
    for row in rows:
        assert row.round_trip and row.ids == library.encode(texts[row.doc_id], add_special_tokens=False).ids


def test_run_equals_the_stages(spark, steps):
    assert entry.queries()["pipeline"](spark, FOLDER).select("doc_id", "n_tokens").orderBy("doc_id").collect() == (
        steps[-1].select("doc_id", "n_tokens").orderBy("doc_id").collect()
    )


@pytest.mark.parametrize("which", ["edges", "repeated", "empty"])
def test_hostile_tables(spark, request, which):
    folder = request.getfixturevalue(which)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    assert set(EXTRA.replace("`", "").replace(",", "").split()[::2]) <= set(columns)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, folder), name)
        assert docs.columns == columns
    assert stored(corpus_pipeline.STAGES[-1][1](spark, docs, folder), "bpe").count() == docs.count()


def test_language_stage_with_columns_named_as_its_own(spark, steps):
    docs = steps[0].withColumn("_judged", F.lit(1)).withColumn("_judged_", F.lit("x"))
    found = corpus_pipeline.STAGES[0][1](spark, docs, FOLDER)
    assert found.columns == docs.columns and found.where("_judged = 1 AND _judged_ = 'x'").count() == steps[1].count()
