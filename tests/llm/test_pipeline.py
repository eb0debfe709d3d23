from __future__ import annotations

import os

import pytest

import corpus_pipeline
from tests.llm.test_decontamination import brute as hits
from tests.llm.test_near_duplicates import brute as groups
from textquarry.llm.common import saved, table

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_each_stage_on_what_the_one_before_kept(spark):
    docs, seen = table(spark, SF, "documents"), []
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs, _ = saved(stage(spark, docs, SF), "test")
        seen.append((name, before, docs.collect()))
        assert name == corpus_pipeline.STAGES[-1][0] or docs.columns == columns
    (_, all_docs, good), (_, _, unique), (_, _, clean), (_, _, private), (_, _, last) = seen
    labels = {r.doc_id: r.quality for r in table(spark, SF, "labels").collect()}
    kept = {r.doc_id for r in good}
    assert sum(labels[d] == (d in kept) for d in labels) >= 0.9 * len(labels)
    leads = {d for d, c, _ in groups([(r.doc_id, r.text) for r in good]) if d == c}
    assert {r.doc_id for r in unique} == leads
    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    assert {r.doc_id for r in clean} == {r[0] for r in hits([(r.doc_id, r.text) for r in unique], items) if not r[5]}
    assert {r.doc_id for r in private} == {r.doc_id for r in clean} and all(r.n_chars == len(r.text) for r in private)
    assert {r.doc_id for r in last} == {r.doc_id for r in private} and all(r.n_tokens == len(r.ids) for r in last)
    assert len(all_docs) > len(good) > len(unique)


def test_odd_rows_through_all_stages(spark, odd, none, tmp_path):
    """Nulls, empty and very long texts, repeated rows and clashing names, and an empty table."""
    for name, docs in (("odd", odd), ("none", none)):
        folder = f"file://{tmp_path}/{name}"
        docs.write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(1, 1, 0), (2, 1, 0), (9, 1, 0), (12, 0, 0), (None, None, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        spark.createDataFrame([(1, "no such words in any of these texts at all, ever"), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
        rows = corpus_pipeline.run(spark, folder).collect()
        assert {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"} <= set(corpus_pipeline.run(spark, folder).columns if name == "none" else rows[0].asDict())
        ids = [r.doc_id for r in rows]
        assert (not ids) if name == "none" else (1 in ids and 2 not in ids and 11 not in ids and all(r.n_tokens == len(r.ids) for r in rows))
