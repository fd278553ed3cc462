"""The stored index after deltas equals a rebuild in all tables; manifests commit once, roll back and clean up."""

from __future__ import annotations

import os

import pytest

from corvane.api import Engine
from corvane.operators import delta, retrieval
from corvane.plans.segments import Segments
from corvane.sources.catalog import Catalog, Conflict
from tests.test_index import TREE, write

TABLES = ("files", "symbols", "imports", "edges", "chunks", "lengths")


def tree(spark, files):
    kinds = {"py": "python", "ts": "typescript", "rs": "rust", "go": "go", "java": "java", "kt": "kotlin", "swift": "swift", "cs": "csharp"}
    rows = [(p, kinds[p.rsplit(".")[-1]], len(c), c) for p, c in files.items() if p.rsplit(".")[-1] in kinds and c]
    return spark.createDataFrame(rows, "path string, language string, size_bytes long, content string")


def same(a: Segments, b: Segments):
    for name in TABLES:
        assert not delta.difference(a.table(name), b.table(name)).take(1), name
    assert (a.catalog.head()["chunks"], a.catalog.head()["tokens"]) == (b.catalog.head()["chunks"], b.catalog.head()["tokens"])
    for terms in (["user"], ["check", "login"], [("auth", "servic")]):
        rows = lambda x: sorted((r.id, r.score) for r in retrieval.or_search(x.text_index(), terms, 100).collect())  # noqa: B023, E731
        assert rows(a) == rows(b), terms


def test_deltas_equal_a_rebuild(spark, tmp_path):
    now = dict(TREE)
    kept = Segments(spark, str(tmp_path / "kept"))
    assert kept.acquire(tree(spark, now)) == "full" and kept.acquire(tree(spark, now)) == "hit"
    before = kept.catalog.head()
    # modified, deleted, and added so that the import of a file that stays means another file
    now["utils.py"] += "\n\ndef more(user):\n    return user\n"
    del now["web/helper.ts"]
    now["web/helper/index.ts"] = "export function helper() {\n  return 2;\n}\n"
    changes = {(r.path, r.status) for r in kept.changes(tree(spark, now)).collect()}
    assert changes == {("utils.py", "M"), ("web/helper.ts", "D"), ("web/helper/index.ts", "A")}
    assert kept.acquire(tree(spark, now)) == "delta"
    head = kept.catalog.head()
    assert ("web/app.ts", "web/helper/index.ts") in {(r.source, r.target) for r in kept.table("edges").collect()}
    assert len(head["segments"]) == 2 and head["segments"][0] == before["segments"][0]
    written = {name: spark.read.parquet(kept._at(head["segments"][1], name)).count() for name in TABLES}
    assert written["files"] == 2 and written["edges"] <= 2 and written["chunks"] < 8  # what changed, and the import of app.ts
    fresh = Segments(spark, str(tmp_path / "fresh"))
    fresh.rebuild(tree(spark, now))
    same(kept, fresh)
    # a second delta deletes what the first added; small segments merge
    del now["web/helper/index.ts"]
    now["web/helper.ts"] = TREE["web/helper.ts"]
    now["new.py"] = "from utils import more\n"
    assert kept.acquire(tree(spark, now)) == "delta"
    fresh.rebuild(tree(spark, now))
    same(kept, fresh)
    assert len(kept.catalog.head()["segments"]) <= 3
    # what an older manifest names is still read, until it is cleaned away
    assert kept.table("files", kept.catalog.get(before["number"])).count() == len([p for p in TREE if p in {r.path for r in tree(spark, TREE).collect()}])
    kept.catalog.rollback(before["number"])
    assert kept.acquire(tree(spark, TREE)) == "hit"
    assert kept.catalog.clean(keep=1) > 0
    assert kept.table("files").count() == tree(spark, TREE).count()
    # most files changed: built anew
    assert kept.acquire(tree(spark, {"only.py": "x = 1\n"})) == "full"


def test_one_of_two_commits_wins(spark, tmp_path):
    a, b = Catalog(spark, str(tmp_path)), Catalog(spark, str(tmp_path))
    assert a.head() is None
    first = a.commit({"segments": [], "n": 1}, None)
    with pytest.raises(Conflict):
        b.commit({"segments": [], "n": 2}, None)
    assert b.commit({"segments": [], "n": 3}, first) == first + 1
    with pytest.raises(Conflict):
        a.commit({"segments": [], "n": 4}, first)
    assert a.head()["n"] == 3 and a.get(first)["n"] == 1
    # a manifest that was cut off names nothing, and its number is passed over
    (tmp_path / "manifests" / f"{first + 2:012d}.json").write_text("half a line")
    assert a.head()["n"] == 3
    with pytest.raises(Conflict):
        a.commit({"segments": []}, first + 1)
    os.utime(tmp_path / "manifests" / f"{first + 2:012d}.json", (1, 1))
    assert a.commit({"segments": [], "n": 5}, first + 1) == first + 3 and a.head()["n"] == 5
    with pytest.raises(KeyError):
        a.get(99)
    number = a.rollback(first)
    assert a.head()["number"] == number and a.head()["n"] == 1


def test_engine_over_a_stored_index(spark, tmp_path):
    root, stored = write(tmp_path / "tree", TREE), str(tmp_path / "stored")
    engine = Engine.acquire(spark, root, stored)
    assert engine.way == "full"
    whole = Engine(spark, root)
    ask = lambda e: [(r.id, r.score) for r in e.query("How does the auth service login work?").collect()]
    assert ask(engine) == ask(whole)
    (tmp_path / "tree" / "utils.py").write_text(TREE["utils.py"] + "\n\ndef strengthen(password):\n    return password\n")
    again = Engine.acquire(spark, root, stored)
    assert again.way == "delta" and "utils.py" in {r.file_path for r in again.query("strengthen").collect()}
    opened = Engine.open(spark, stored)
    assert ask(opened) == ask(again) == ask(Engine(spark, root))
    with pytest.raises(KeyError):
        Engine.open(spark, str(tmp_path / "none"))
