"""The pipeline's near-duplicate stage against plain Jaccard similarity of five-word shingles."""

from __future__ import annotations

import random

import corpus_pipeline
import pytest
from corvane.llm import near_copies
from pyspark.sql import functions as F


def plain(texts):
    """Place of the first text of each group, per text."""
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if len(a & b) >= 0.8 * len(a | b):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return [find(i) for i in range(len(sets))]


def family(rng, n, edits):
    """A chain of texts, each with some words of one before it replaced."""
    vocabulary = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(3000)]
    out = [rng.choices(vocabulary, k=rng.randint(60, 300))]
    for _ in range(n - 1):
        words = list(rng.choice(out[-3:]))
        for _ in range(rng.randint(0, edits)):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        out.append(words)
    return [" ".join(w) for w in out]


@pytest.mark.parametrize("slice_", [1024, 4])
def test_groups(spark, monkeypatch, slice_):
    monkeypatch.setattr(near_copies, "SLICE", slice_)
    rng = random.Random(slice_)
    texts = [t for _ in range(12) for t in family(rng, 15, 8)] + [None, "", " ", "one two", "ONE two", "one two three"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    kept = sorted(r.doc_id for r in corpus_pipeline.dedup_stage(spark, docs, "").collect())
    want = sorted(set(plain(texts)))
    assert kept == want and len(want) < len(texts) - 20


def test_whole_table(spark, sf):
    rows = sorted(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in near_copies.one_of_each(docs).collect()) == [rows[i].doc_id for i in sorted(set(plain([r.text for r in rows])))]


def test_repeated_and_missing_ids(spark):
    a, b = "the cat sat on the mat and was good", "le chat est sur la table et il est bon"
    rows = [(1, a, "x"), (1, a, "x"), (1, b, "x"), (None, b, "x"), (None, "only here", "x"), (None, "only here", "x"), (2, a, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, k1 string").select("*", *[F.lit("x").alias(c) for c in ("k2", "node", "root", "band", "value")])
    kept = near_copies.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text) for r in kept.collect()) == sorted([(1, a), (1, b), (0, "only here")])
    assert near_copies.one_of_each(docs.limit(0)).collect() == []
