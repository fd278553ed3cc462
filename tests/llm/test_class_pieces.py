"""The class model over pieces: odd texts as columns, words and texts that go on in the next batch, and how little is shuffled."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pytest

from corvane.llm import class_lm
from corvane.llm.common import table

ODD = [None, "", "  \t\n", "One TWO\x0bthree\x0cfour\rfive", "\x1ca\x1db c\x85d e f", " İstanbul ÄRGER a\u0000B ", "x" * 5000 + " Y", "\n\nend\n"]


def test_words_of_odd_texts():
    words, sizes = class_lm.words_in(pa.array(["before", *ODD]).slice(1))
    plain = [[w.encode() for w in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if w] for t in ODD]
    assert sizes.tolist() == [len(ws) for ws in plain] and words.to_pylist() == [w for ws in plain for w in ws]
    assert plain == [class_lm.tokens(t) for t in ODD]


def test_words_and_texts_across_batches(spark, sf, monkeypatch):
    """Batches of three rows, slices of one text and partitions of any number change no result."""
    monkeypatch.setattr(class_lm, "CLUSTER_SHARE", 3e-3)
    monkeypatch.setattr(class_lm, "LOCAL_SHARE", 1e-3)
    docs = table(spark, sf, "documents").orderBy("doc_id").limit(40)
    docs = spark.createDataFrame([*((r.doc_id, r.text) for r in docs.collect()), *((1000 + i, t) for i, t in enumerate(ODD)), (None, "no id here")], "doc_id long, text string")
    whole = sorted(class_lm.class_scores(docs, classes=4, rounds=1).collect(), key=str)
    monkeypatch.setattr(class_lm, "SLICE", 1)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        pieces = sorted(class_lm.class_scores(docs.repartition(3), classes=4, rounds=1).collect(), key=str)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert len(whole) == docs.count()
    for a, b in zip(whole, pieces, strict=True):
        assert a[:5] == b[:5] and a.base_score == pytest.approx(b.base_score, rel=1e-9) and a.score == pytest.approx(b.score, rel=1e-9)


def test_texts_are_put_together_by_one_sort(spark):
    """One shuffle by text and a sort, instead of aggregates of lists before and after the shuffle."""
    docs = spark.createDataFrame([(i, f"the cat number{i} runs to number{i + 1} now") for i in range(30)], "doc_id long, text string")
    found = class_lm.score(docs, class_lm.fit(docs, 4, 1))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not re.findall(r"\w*Aggregate\(", plan) and plan.count("Exchange hashpartitioning(row#") == 1


def test_contexts_have_a_row_a_word(spark):
    docs = spark.createDataFrame([(i, "a b a c b a") for i in range(50)], "doc_id long, text string").coalesce(1)
    rows = class_lm.contexts(docs.select("text"), {b"c": 1}, np.array([2, 0]), 2).collect()
    assert {bytes(r.word): (len(r.near), len(r.next)) for r in rows} == {b"a": (300, 50), b"b": (200, 100)} and len(rows) == 2
