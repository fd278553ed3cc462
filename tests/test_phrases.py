"""Phrases from positions in the stored index, against a scan and against plain Python; stages of a long question."""

from __future__ import annotations

import random
import time

from corvane.api import Engine
from corvane.functions import text
from corvane.operators import retrieval
from tests.test_index import write

FIELDS = {"content": 3.0, "symbol_name": 1.5}


def corpus(spark, n=60):
    draw = random.Random(4)
    words = lambda k: " ".join(draw.choice("abcd") for _ in range(k))
    rows = [(i, words(draw.randint(0, 12)), words(draw.randint(0, 3)) if i % 5 else None) for i in range(n)]
    return rows, spark.createDataFrame(rows, "id long, content string, symbol_name string").repartition(4)


def test_phrases_against_plain_counts(spark):
    rows, df = corpus(spark)
    index = retrieval.TextIndex.build(df, FIELDS)
    for phrase in (["a", "b"], ["a", "a"], ["a", "b", "a"], ["c"], ["x", "a"]):
        count = lambda t: sum((t or "").split()[i : i + len(phrase)] == phrase for i in range(len((t or "").split())))  # noqa: B023, E731
        want = {i: 3.0 * count(c) + 1.5 * count(s) for i, c, s in rows}
        assert {r.id: r.n for r in index.phrase(phrase).collect()} == {i: n for i, n in want.items() if n}
    assert index.total == len(rows)


def test_stored_and_scanned_phrases_score_alike(spark):
    _, df = corpus(spark)
    index = retrieval.TextIndex.build(df, FIELDS)
    round_ = lambda rows: sorted((r.id, round(r.score, 6)) for r in rows.collect())
    for terms in (["a", ("b", "c")], [("a", "b", "c"), ("d", "a")], ["a", "b"], [("x", "y")]):
        assert round_(retrieval.or_search(index, terms, 100)) == round_(retrieval.or_search(df, terms, 100, FIELDS))
        staged = lambda source: sorted((r.id, round(r.score, 5), r.stage) for r in retrieval.graduated(source, terms, 100, 3).collect())  # noqa: B023, E731
        assert staged(index) == staged(retrieval.TextIndex.build(df.repartition(2), FIELDS))


def test_a_long_question_is_no_longer_to_plan(spark):
    df = spark.createDataFrame([(i, " ".join(f"w{(i * 7 + j) % 23}" for j in range(9))) for i in range(50)], "id long, content string")
    index = retrieval.TextIndex.build(df)
    retrieval.graduated(index, ["w1", "w2"], 10).collect()
    start = time.time()
    rows = retrieval.graduated(index, [f"w{i}" for i in range(20)], 10)
    planned = time.time() - start
    assert len(rows.collect()) == 10 and planned < 5


def test_underscore_and_dot_ask_for_phrases(spark, tmp_path):
    tree = {"one.py": "def parse_header(x):\n    return x\n", "two.py": "def header_or_parse(x):\n    return 1\n\n\ndef parse(header):\n    return header.x\n"}
    engine = Engine(spark, write(tmp_path, tree))
    assert ("pars", "header") in engine._asked("where is parse_header used")["stems"]
    found = [r.file_path for r in engine.query("parse_header").collect()]
    assert found[0] == "one.py"
    assert [r.file_path for r in engine.symbols("parse_header").collect()] == ["one.py"]
    assert {r.symbol_name for r in engine.symbols("parse", kind="function").collect()} == {"parse_header", "header_or_parse", "parse"}
    assert engine.symbols("  ").count() == 0
    assert text.SEARCH_STOP
