"""Every registered query against its SQL twin, and properties of the operators."""

from __future__ import annotations

import math

import duckdb
import pytest
from pyspark.sql import functions as F

from corvane import plans
from corvane.functions import text
from corvane.operators import analytics, chunking, context, delta, graph, metrics, retrieval, vectors

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    return str(v)


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_twin(spark, sf, duck, name):
    df, sql = plans.QUERIES[name](spark, sf), duck.sql(plans.SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(sql.columns)
    order = [sql.columns.index(c) for c in columns]
    assert sorted([plain(r[c]) for c in columns] for r in df.collect()) == sorted([plain(r[i]) for i in order] for r in sql.fetchall())


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.SQL)))
def test_runs(spark, sf, name):
    assert plans.QUERIES[name](spark, sf).count() > 0


def test_stems():
    pairs = "caresses:caress ponies:poni cats:cat agreed:agre plastered:plaster motoring:motor conflated:conflat hopping:hop filing:file happy:happi relational:relat rational:ration formalize:formal electrical:electr adjustment:adjust adoption:adopt probate:probat controll:control generalizations:gener"
    for pair in pairs.split():
        word, stem = pair.split(":")
        assert text.porter(word) == stem


def test_graduated_stages(spark):
    def chunks(texts):
        return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, content string")

    filler = ["nothing here"] * 20
    stage = lambda texts, terms: {r.stage for r in retrieval.graduated(chunks(texts + filler), terms, 50).collect()}
    assert stage(["alpha beta gamma"] * 12, ["alpha", "beta", "gamma"]) == {1}
    assert stage(["alpha beta"] * 12, ["alpha", "beta", "gamma"]) == {2}
    assert stage(["alpha beta"] * 6 + ["gamma delta"] * 6, ["alpha", "beta", "gamma", "delta"]) == {3}
    assert stage(["alpha"] * 3 + ["beta"] * 3, ["alpha", "beta", "gamma", "delta"]) == {4}
    assert stage(["alpha"] * 3, ["alpha"]) == {1}


def test_metrics(spark):
    ranked = spark.createDataFrame([("t", i, f) for i, f in enumerate(["x", "a", "a", "b"], 1)], "task_id string, rank int, file_path string")
    expected = spark.createDataFrame([("t", "a"), ("t", "b"), ("u", "z")], "task_id string, file_path string")
    got = {r.task_id: r for r in metrics.per_task(ranked, expected).collect()}
    assert math.isclose(got["t"]["map"], 7 / 12) and got["t"].mrr == 0.5 and got["t"].recall == 1 and math.isclose(got["t"].precision, 2 / 3)
    assert got["u"].recall == got["u"].ndcg == got["u"]["map"] == 0


def test_weights(spark):
    rows = spark.createDataFrame([(0.8, 0.5), (0.1, 0.5), (0.5, 0.2), (0.5, 0.5)], "a double, c double")
    assert [r[0] for r in rows.select(vectors.weights(F.col("a"), F.col("c"))).collect()] == [0.85, 0.35, 0.40, 0.50]
    gate = spark.createDataFrame([(5, 5, 0.8, 0.6), (5, 5, 0.1, 0.6), (2, 5, 0.1, 0.1)], "n int, m int, a double, c double")
    assert [r[0] for r in gate.select(vectors.fuse_wanted(*map(F.col, "nmac"))).collect()] == [False, True, False]


def test_packing(spark):
    rows = spark.createDataFrame([(1, 1.0, 60), (2, 0.9, 60), (3, 0.8, 40), (4, 0.2, 1)], "id long, score double, token_count long")
    assert {r.id for r in context.pack(rows, 100).collect()} == {1, 3}
    assert context.pack(rows, 0).count() == 0 and context.pack(rows.limit(0), 100).count() == 0


def test_merge_and_split(spark):
    pieces = spark.createDataFrame([("f", 1, 10), ("f", 2, 45), ("f", 3, 60), ("f", 4, 5)], "file_path string, start_line long, token_count long")
    assert [r.token_count for r in chunking.merge_small(pieces).orderBy("group").collect()] == [55, 65]
    body = "\n".join(["one two three"] * 10)
    parts = chunking.split_lines(spark.createDataFrame([(1, body)], "id long, content string"), 9).orderBy("part").collect()
    assert "\n".join(p.content for p in parts) == body and len(parts) == 4


def test_delta(spark):
    lines = spark.createDataFrame([("M\ta.py",), ("R100\told.py\tnew.py",), ("C50\tx\ty",), ("D\tgone.py",)], "value string")
    assert {(r.path, r.status, r.old_path) for r in delta.parse_name_status(lines).collect()} == {("a.py", "M", None), ("new.py", "R", "old.py"), ("gone.py", "D", None)}
    assert delta.use_delta(1, 4) and not delta.use_delta(2, 4)


def test_communities(spark):
    ring = [(i, j) for base in (0, 10) for i in range(base, base + 5) for j in range(i + 1, base + 5)] + [(0, 10)]
    edges = spark.createDataFrame(ring, "source long, target long")
    found = graph.communities(edges, 6)
    assert found.count() == 10 and graph.modularity(edges, found).first()[0] > 0.3


def test_verified(spark):
    rows = spark.createDataFrame([(0.6, 0.5), (0.6, 0.0), (0.6, 0.2), (0.95, 1.0)], "c double, r double")
    assert [round(r[0], 2) for r in rows.select(analytics.verified(F.col("c"), F.col("r"))).collect()] == [0.7, 0.45, 0.6, 1.0]
