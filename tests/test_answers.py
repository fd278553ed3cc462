"""Answers over an indexed tree: stems, identifiers, names, structure, strategies; stored vectors and caches."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from corvane.api import Engine
from corvane.functions import render, text
from corvane.operators import delta, hierarchy, retrieval, vectors
from corvane.plans import strategies
from corvane.sources import files
from corvane.sources.store import Cache, Store, load_vectors, save_vectors
from tests.test_index import TREE, write


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    return Engine(spark, write(tmp_path_factory.mktemp("tree"), TREE))


def paths(df):
    return {r.file_path for r in df.collect()}


def test_stems_and_identifiers(spark):
    row = spark.range(1).select(text.analysed(F.lit("Checking Déjà getUserName")).alias("a"), text.analysed(text.expanded(F.lit("getUserName x"))).alias("b")).first()
    assert row.a == ["check", "deja", "getusernam"] and {"get", "user", "name"} <= set(row.b)


def test_answer(engine):
    found = engine.bundle("How are passwords checked?")
    assert "utils.py" in paths(found.chunks)
    whole = engine.bundle("How does the auth service login work?")
    assert "services/auth.py" in paths(whole.chunks)
    kept = paths(whole.chunks)
    assert all(r.source in kept and set(r.targets) <= kept for r in whole.structure.collect())
    assert "AuthService" in {r.name for r in whole.types.collect()}
    meta = whole.metadata.first()
    assert meta.included == whole.chunks.count() and meta.included_files == len(kept) and meta.tokens <= meta.budget
    assert engine.bundle("zzzz qqqq").chunks.count() == 0


def test_index_and_scan_agree(engine):
    chunks = engine.index.chunks
    for terms in (["user"], ["user", "name", "check"], ["nothing"]):
        stored = retrieval.TextIndex.build(chunks, retrieval.FIELDS)
        rows = lambda df: sorted((r.id, round(r.score, 6)) for r in df.collect())
        assert rows(retrieval.or_search(stored, terms, 100)) == rows(retrieval.or_search(chunks, terms, 100, retrieval.FIELDS))


def test_fused_answer(engine):
    assert engine.query("login service", embedder="hash").count() > 0


def test_answer_over_a_table(spark):
    """Files that are a table already; the best chunk is the one the question names."""
    from corvane.plans import code

    engine = Engine.of(spark, code.files(spark, "/root/testdata/sf0.001", "go").where("path IN ('g1/m1.go', 'g2/m2.go')"))
    best = engine.query("Where does T77.Get read its value?", 2048).orderBy(F.desc("score"), "id").first()
    assert best.file_path == "g1/m1.go" and "T77" in best.content


def test_symbol_phrases():
    assert retrieval.symbol_phrases("How does the user session start?", text.SYMBOL_NOISE) == ["the_user", "user_session", "session_start", "session"]


def test_strategies(engine):
    tasks = [{"task_id": "t", "question": "How are passwords checked?", "expected_files": ["utils.py"]}]
    names = [n for n in strategies.STRATEGIES if n != "query_fusion"]  # its answer is tested above
    rows = {r.strategy: r for r in strategies.run_all(engine, tasks, names).collect()}
    assert set(rows) == set(names) and rows["raw_files"].recall == 1 and rows["query"].recall == 1


def test_modules_and_profile(engine):
    rows = engine.modules().collect()
    assert sum(r.file_count for r in rows) == engine.index.files.count() and all(0 <= r.cohesion <= 1 for r in rows)
    shown = render.profile_markdown(engine.profile("tree"))
    assert "## Languages" in shown and "python" in shown and "## Modules" in shown
    assert "## Api surface" in render.comparison_markdown("x", "y", [{"dimension": "api_surface", "a": 1, "b": 0, "trade_off": "only a"}])
    assert {r.alternatives[0] for r in engine.decisions().collect()} <= {"Decorators", "Static imports", "Direct calls", "Active record", "Conditional branches", "Custom implementation"}


def test_outline_levels(spark, engine):
    """Several levels, both separators, a gap (the chain ends there), repeats, a null name, another file's names."""
    names = [("f", "A"), ("f", "A"), ("f", "A::B"), ("f", "A::B.c"), ("f", "X.y.z"), ("f", "X"), ("f", None), ("g", "A::B.c"), ("g", "A::B")]
    rows = hierarchy.outline_levels(spark.createDataFrame(names, "file_path string, qname string")).collect()
    assert sorted((r.file_path, r.qname, r.parent, r.top, r.depth) for r in rows) == [
        ("f", "A", None, "A", 0), ("f", "A::B", "A", "A", 1), ("f", "A::B.c", "A::B", "A", 2), ("f", "X", None, "X", 0), ("f", "X.y.z", None, "X.y.z", 0),
        ("g", "A::B", None, "A::B", 0), ("g", "A::B.c", "A::B", "A::B", 1),
    ]
    assert tuple(engine.outline_head("no such file").first()) == ("no such file", "unknown", 0, 0)
    assert engine.outline_head("utils.py").first().language == "python"


def test_failing_strategy(engine, monkeypatch):
    def broken(engine, question, expected):
        raise ValueError("no way")

    monkeypatch.setitem(strategies.STRATEGIES, "broken", broken)
    rows = {r["strategy"]: r for r in strategies.run_task(engine, {"task_id": "t", "question": "q", "expected_files": ["utils.py"]}, ["broken", "raw_files"])}
    assert rows["broken"]["error"] == "ValueError: no way" and rows["broken"]["recall"] is None and rows["raw_files"]["error"] is None


def test_drawings():
    assert hierarchy.draw_outline([{"qname": "A.m", "kind": "method", "start_line": 2}, {"qname": "A", "kind": "class", "start_line": 1}]) == "class A:1\n  method m:2"
    assert hierarchy.draw_tree([{"path": "b.py", "is_dir": False}, {"path": "a", "is_dir": True}, {"path": "a/c.py", "is_dir": False}]) == "├── a/\n│   └── c.py\n└── b.py"


def test_stored_vectors(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    rows = vectors.embed(spark.createDataFrame([(1, "a"), (2, "b")], "id long, content string"), F.col("content"))
    with pytest.raises(ValueError):
        save_vectors(store, rows.limit(0), "hash", "content", "1")
    with pytest.raises(KeyError):
        load_vectors(store)
    save_vectors(store, rows, "hash", "content", "1")
    assert load_vectors(store, embedder="hash", dim=64).count() == 2
    with pytest.raises(ValueError):
        load_vectors(store, embedder="other")


def test_cache(spark, tmp_path):
    cache = Cache(spark, str(tmp_path))
    a = cache.put("repo", "c1", {"files": spark.range(3)})
    b = cache.put("repo", "c2", {"files": spark.range(4)})
    assert cache.find("repo") == [b, a] and cache.find("other") == [] and cache.info() == {"entries": 2, "rows": 7}
    assert cache.get(a, "files").count() == 3 and not cache.stale(a, 1)
    cache.invalidate(a)
    with pytest.raises(KeyError):
        cache.get(a, "files")
    with pytest.raises(ValueError):
        cache.get("../x", "files")
    assert cache.clean(0) == 1 and cache.info()["entries"] == 0


def test_delta_run(spark):
    old = spark.createDataFrame([(i, "a") for i in range(20)], "k long, v string")
    new = old.where("k <> 3").withColumn("v", F.when(F.col("k") == 5, "b").otherwise(F.col("v")))
    run = delta.timed_run(old, new, "k", "v")
    assert run["correct"] and run["speedup"] > 0


def test_delta_tasks(spark, tmp_path):
    (tmp_path / "t.json").write_text('{"task_id": "a", "source": "s", "base_commit": "1", "delta_commit": "2"}\n')
    assert files.load_delta_tasks(spark, str(tmp_path / "t.json")).first().delta_commit == "2"
