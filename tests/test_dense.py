"""Vectors searched in blocks against plain cosines; an embedder under which like texts are near; renamed files."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from corvane.operators import delta, vectors


def test_blocks_against_plain_cosines(spark):
    draw = np.random.default_rng(5)
    rows = [(i, draw.normal(0, 1, 8).round(2).tolist()) for i in range(300)] + [(300 + i, [1.0] + [0.0] * 7) for i in range(40)]
    rows += [(900, [0.0] * 8), (901, None), (902, [1.0, 2.0]), (None, [1.0] * 8)]
    df = spark.createDataFrame(rows, "id long, embedding array<double>").repartition(5)
    queries = [[1.0] + [0.0] * 7, draw.normal(0, 1, 8).tolist(), [0.0] * 8]
    got = {}
    for r in vectors.search_blocks(df, queries, 12).collect():
        got.setdefault(r["query"], []).append((round(-r.score, 9), r.id))
    for q, w in enumerate(queries):
        cos = [(round(-float(np.dot(v, w) / np.linalg.norm(v) / max(np.linalg.norm(w), 1e-12)), 9), i) for i, v in rows if i is not None and v and len(v) == 8 and any(v)]
        assert sorted(got.get(q, [])) == sorted(x for x in cos if x[0] < 0)[:12]


def test_like_texts_are_near(spark):
    texts = ["def open_session(user): return login(user, password)", "class PasswordHasher: salt and hash of passwords", "parse the grammar into syntax trees", "def login(user, password): check(password)", "matrix product of two vectors", "the the the of of and"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, content string")
    embedder = vectors.WordEmbedder(df)
    hits = [r.id for r in vectors.search_texts(df, "user login password", 6, embedder).orderBy(F.desc("score")).collect()]
    assert set(hits[:2]) == {0, 3}
    stored = vectors.embed(df, F.col("content"), embedder)
    assert [r.id for r in vectors.search_texts(df, "syntax trees", 1, embedder, stored).collect()] == [2]
    assert all(abs(sum(x * x for x in r.embedding) - 1) < 1e-9 for r in stored.collect())


def test_renames(spark):
    body = lambda n, tail="": "".join(f"line {n} {i}\n" if i % 3 else "}\n" for i in range(12)) + tail
    old = {"a.py": body(1), "b.py": body(2), "c.py": body(3), "d.py": body(4), "keep.py": "x\n", "same1.py": body(9), "same2.py": body(9)}
    new = {"x.py": body(1), "y.py": body(2, "more\n"), "z.py": "nothing alike\n" * 5, "keep.py": "y\n", "s1.py": body(9), "s2.py": body(9, "t\n"), "e.py": ""}
    frame = lambda d: spark.createDataFrame(list(d.items()), "path string, content string")
    changes = delta.snapshot_delta(frame(old), frame(new), "path", "content")
    got = {(r.path, r.status, r.old_path) for r in delta.with_renames(changes, frame(old), frame(new)).collect()}
    assert got == {("x.py", "R", "a.py"), ("y.py", "R", "b.py"), ("s1.py", "R", "same1.py"), ("s2.py", "R", "same2.py"), ("c.py", "D", None), ("d.py", "D", None), ("z.py", "A", None), ("e.py", "A", None), ("keep.py", "M", None)}
    shares = {(r.old_path, r.path): round(r.share, 3) for r in delta.similar_files(frame({"a": body(1), "b": body(2)}), frame(new)).collect()}
    assert shares[("a", "x.py")] == 1.0 and all(v >= 0.5 for v in shares.values())


def test_renames_among_files_of_common_lines(spark):
    """Every pair is alike; the choice is that of all pairs in order, and as few rows as kinds of lines are compared."""
    import random

    draw = random.Random(3)
    common = [f"common {i}" for i in range(30)]

    def some(n, seed):
        own = random.Random(seed)
        return {f"{seed}{i:02d}": "\n".join(common + [f"own {own.randrange(8)}" for _ in range(own.randrange(12))]) for i in range(n)}

    old, new = some(14, "old"), some(12, "new")
    moved = dict(zip(draw.sample(sorted(old), 5), (f"new{i}" for i in range(50, 55)), strict=True))
    new |= {to: old[at] for at, to in moved.items()} | {"new60": old["old00"], "new61": old["old00"]}
    frame = lambda d: spark.createDataFrame(list(d.items()), "path string, content string")
    from collections import Counter

    count = lambda x: Counter(x.split("\n"))
    pairs = [((count(x) & count(y)).total() / max(count(x).total(), count(y).total()), a, b) for a, x in old.items() for b, y in new.items()]
    expected, left = set(), {*old, *new}
    for share, a, b in sorted(pairs, key=lambda p: (-p[0], p[1], p[2])):
        if share >= 0.5 and {a, b} <= left:
            expected.add((a, b))
            left -= {a, b}
    changes = delta.snapshot_delta(frame(old), frame(new), "path", "content")
    got = delta.with_renames(changes, frame(old), frame(new)).collect()
    assert {(r.old_path, r.path) for r in got if r.status == "R"} == expected
    assert {(r.path, r.status) for r in got if r.status != "R"} == {(x, "D" if x in old else "A") for x in left}
    shares = {(r.old_path, r.path): r.share for r in delta.similar_files(frame(old), frame(new), 0.7).collect()}
    assert shares == {(a, b): share for share, a, b in pairs if share >= 0.7}
    rows = delta._kinds(frame({f"a{i}": "\n".join(common) + f"\n{i}" for i in range(20)}), frame({"b": "\n".join(common)}))
    assert rows.count() == 41
