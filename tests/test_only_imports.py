"""Imports read alone are those of the whole reading, wherever in a text they stand."""

from __future__ import annotations

import random

import pytest

from corvane.plans.code import TREES
from corvane.sources import parsing, statements

PIECES = {
    "typescript": ["import a, { b as c } from './x'\n", "import {\n  d,\n  e\n}\nfrom\n'y'\n", "export { q } from \"z\";", "const r = require('w').on(1)\n", "function f() { return g(require( 'v' ), /[{]/) }\n", "class K { x = require('u') }\n", "import('t')\n", "// import n from 'n'\n", "`import m from 'm'", "export * from 's'", "}", "{"],
    "go": ["import (\n\ta \"x/y\"\n\t_ \"z\"\n)\n", "import \"w\"\n", "func f() { import \"v\" }\n", "// import \"n\"\n", "type T struct { a int }\n", "`import`", ")", "{"],
    "rust": ["use a::{b, c::{self, D}};\n", "pub use crate::x as y;\n", "fn f() { use z::W; }\n", "mod m { use q; }\n", "impl A { fn g() { let reuse = 1; } }\n", "/* use n; */", "r#\"use m;\"#", "}", "{"],
    "java": ["import a.B;\n", "import static c.D.e;\n", "class X { int import_ = 1; }\n", "// import n;\n", "\"import m;\"", "}", "{"],
    "kotlin": ["import a.B as C\n", "import d.E\n", "fun f() { val x = 1 }\n", "/* import n */", "\"\"\"import m\"\"\"", "class K {", "}"],
    "csharp": ["using A.B;\n", "global using static C;\n", "using X = D.E;\n", "namespace N;\n", "namespace M {\n", "class K { void F() { using (var x = g()) { } using var y = h(); } }\n", "// using n;\n", "}"],
    "swift": ["import A\n", "@testable import B\n", "func f() { let important = 1 }\n", "// import n\n", "\"import m\"", "struct S {", "}"],
}


@pytest.mark.parametrize("language", sorted(PIECES))
def test_imports_alone(spark, language):
    draw = random.Random(language)
    texts = ["".join(draw.choice(PIECES[language]) for _ in range(draw.randrange(1, 14))) for _ in range(400)]
    tree = TREES[language]
    texts += [tree.head + tree.item * 3 + tree.foot, tree.item * 3 + tree.head, tree.item * 3, "", None]
    df = spark.createDataFrame([(f"f{i}", language, x) for i, x in enumerate(texts)], "path string, language string, content string")
    rows = lambda x: sorted(map(repr, x.collect()))
    assert rows(parsing.imports_of(df)) == rows(parsing.parse(df)[1])


def test_no_more_than_needed_is_read():
    head = "import a from 'b'\n"
    body = "const x = 1\n" * 50
    assert len(statements.statements(head + body, "typescript", True)) == 1 and statements.statements(body, "typescript", True) == []
    assert len(statements.statements(head + body + head, "typescript", True)) == 52


def test_python_too(spark):
    df = spark.createDataFrame([("a.py", "python", "import x\ndef f():\n  import y\n"), ("b.go", "go", 'import "z/w"\n')], "path string, language string, content string")
    assert sorted((r.file_path, r.module) for r in parsing.imports_of(df).collect()) == [("a.py", "x"), ("b.go", "z/w")]


def test_edges_of_imports_alone(spark, sf):
    from corvane.plans import code, index

    tree = code.files(spark, sf, *TREES)
    edges = lambda x: sorted(map(repr, index.edges_of(parsing.resolve(x, tree)).collect()))
    assert edges(parsing.imports_of(tree)) == edges(parsing.parse(tree)[1])
