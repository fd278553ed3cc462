"""The pipeline's stages against what their operators say alone."""

from __future__ import annotations

import corpus_pipeline
from corvane.llm import decontamination, mixing, quality_lm, secrets
from corvane.llm.common import table

from tests.llm.test_near_copies import plain


def test_stages(spark, sf, tmp_path):
    docs, at = table(spark, sf, "documents"), str(tmp_path)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality classifier", "near-dedup", "decontamination", "secret scan", "mixing"]
    steps = [docs.collect()]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(f"{at}/{i}")
        new = spark.read.parquet(f"{at}/{i}")
        assert new.columns[:5] == docs.columns if i == 4 else new.columns == docs.columns
        if i == 0:
            want = {r.doc_id for r in quality_lm.classify(docs, table(spark, sf, "labels")).where("kept").collect()}
            assert {r.doc_id for r in new.collect()} == want
        elif i == 1:
            rows = sorted((r.doc_id, r.text) for r in steps[-1])
            want = sorted(rows[i][0] for i in set(plain([t for _, t in rows])))  # five words, Jaccard similarity of 0.8 or more
            assert sorted(r.doc_id for r in new.collect()) == want
        elif i == 2:
            gone = {r.doc_id for r in decontamination.leaks(docs, table(spark, sf, "benchmark")).collect()}
            assert {r.doc_id for r in new.collect()} == {r.doc_id for r in steps[-1]} - gone and gone
        elif i == 3:
            limit = secrets.discovery_limit(docs)
            assert {r.doc_id: r.text for r in new.collect()} == {r.doc_id: secrets.blanked(r.text, limit) for r in steps[-1]}
        else:
            want = sum(len(r.shards) for r in mixing.decide(docs).collect())
            assert new.count() == want
        docs = new
        steps.append(docs.collect())
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, sf).collect()) == sorted(r.doc_id for r in steps[-1])
