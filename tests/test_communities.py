"""Communities by modularity: planted groups are found, and no partition by labels is better."""

from __future__ import annotations

import random

import pytest

from corvane.operators import graph


def rings(n, size):
    """n cliques in a ring, one link between neighbours."""
    inner = [(g * size + i, g * size + j) for g in range(n) for i in range(size) for j in range(i)]
    return inner + [(g * size, (g + 1) % n * size + 1) for g in range(n)]


def drawn(seed, groups=4, size=12):
    draw = random.Random(seed)
    return [(a, b) for a in range(groups * size) for b in range(a) if draw.random() < (0.5 if a // size == b // size else 0.04)]


@pytest.mark.parametrize("edges", [rings(6, 5), drawn(1)])
def test_no_less_than_labels(spark, edges):
    df = spark.createDataFrame(edges, "source long, target long")
    found = graph.louvain(df)
    rows = {r.node: r.community for r in found.collect()}
    assert set(rows) == {x for e in edges for x in e} and all(rows[c] == c <= n for n, c in rows.items())
    q = lambda m: graph.modularity(df, m).first().modularity
    assert q(found) >= q(graph.communities(df)) - 1e-9
    assert q(found) >= q(spark.createDataFrame([(n, n // (5 if len(rows) == 30 else 12)) for n in rows], "node long, community long")) - 1e-9


def test_pairs_and_loops(spark):
    df = spark.createDataFrame([("a", "b"), ("b", "a"), ("a", "b"), ("c", "c"), ("d", "e")], "source string, target string")
    assert {r.node: r.community for r in graph.louvain(df).collect()} == {"a": "a", "b": "a", "c": "c", "d": "d", "e": "d"}
    assert graph.louvain(df.limit(0)).collect() == []


def test_rounds_write_rows_of_nodes_only(spark, monkeypatch):
    """Links are made once and dealt once a level; nodes too many to send to every task give the same communities."""
    df = spark.createDataFrame(drawn(2) + [(99, 99)], "source long, target long")
    made = spark.sparkContext.accumulator(0)

    def counted(frames):
        for frame in frames:
            made.add(len(frame))
            yield frame

    written, plain = [], graph.materialise
    monkeypatch.setattr(graph, "materialise", lambda rows, label: written.append((label, plain(rows, label))) or written[-1][1])
    found = sorted(map(tuple, graph.louvain(df.mapInPandas(counted, df.schema)).collect()))
    assert made.value == df.count()
    sizes = [rows.count() for label, rows in written if label in ("louvain-votes", "louvain-state")]
    assert len(sizes) > 4 and max(sizes) == len(found) == 49
    monkeypatch.setattr(graph, "BROADCAST_NODES", 0)
    assert sorted(map(tuple, graph.louvain(df).collect())) == found
