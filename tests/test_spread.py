"""Work on trees is spread over tasks, and patterns and texts are gone through once."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from corvane.functions import text
from corvane.plans import code, index
from corvane.sources import declarations, parsing, statements
from corvane.sources.store import tasks


def test_trees_are_made_in_all_tasks(spark, sf):
    assert code.files(spark, sf, "go").rdd.getNumPartitions() >= tasks(spark) >= 2 * spark.sparkContext.defaultParallelism


def test_a_pattern_is_looked_for_once(spark, sf):
    plan = declarations.symbols(statements.read(code.files(spark, sf, "rust")))._jdf.queryExecution().optimizedPlan().toString()
    rule = next(pattern for _, pattern, _ in declarations.RULES["rust"] if "macro_rules" in pattern)
    assert 1 <= plan.count(rule) <= 2


@pytest.mark.parametrize("most", [3, 500])
def test_chunks_against_plain_walk(spark, most):
    """Long and short declarations are cut where a walk over their lines cuts them; texts are not sent whole to every task."""
    line = lambda n, i: f"\tx{i} := " + " + ".join(f"v{j}" for j in range(n)) + "\n"
    items = [[(i * 7 + k) % 23 for k in range(i * 9 % 40)] for i in range(30)]
    content = "package p\n" + "".join(f"func f{i}() {{\n" + "".join(line(n, k) for k, n in enumerate(ns)) + "}\n" for i, ns in enumerate(items))
    files = spark.createDataFrame([("a.go", "go", content)], "path string, language string, content string")
    symbols, imports = parsing.parse(files)
    chunks = index.chunks_of(files, symbols, imports, most)
    got = {(r.symbol_name, r.start_line, r.end_line, r.content) for r in chunks.collect() if r.symbol_name}
    lines, expected = content.split("\n"), set()
    for s in symbols.collect():
        begin, words = s.start_line, 0
        for at in range(s.start_line, s.end_line + 1):
            n = len((lines[at - 1].strip(" ") or " ").split()) + (lines[at - 1][:1] == "\t")
            if words + n > most and words:
                expected.add((s.name, begin, at - 1, "\n".join(lines[begin - 1 : at - 1])))
                begin, words = at, 0
            words += n
        expected.add((s.name, begin, s.end_line, "\n".join(lines[begin - 1 : s.end_line])))
    assert got == expected
    assert "split(content" not in "".join(x for x in chunks._jdf.queryExecution().executedPlan().toString().split("\n") if "Broadcast" in x)


def test_stems_of_lists(spark):
    rows = spark.createDataFrame([(["Running", "runs", None],), ([],), (None,), (["élan", "runs"],)], "t array<string>")
    stem = lambda w: None if w is None else text.porter(text.folded(w))
    assert [r[0] for r in rows.select(text.folded_stems(F.col("t"))).collect()] == [[stem("Running"), "run", None], [], None, [stem("élan"), "run"]]
