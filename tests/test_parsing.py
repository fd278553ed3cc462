"""Declarations and imports of nine languages, imports and the files they mean; chunks with their imports."""

from __future__ import annotations

import random

import pytest

from corvane.operators import chunking
from corvane.plans import index
from corvane.sources import parsing, statements

#: language: text, symbols (qualified name, kind, first and last line, visibility), imports (module, names, alias, line)
CASES = {
    "typescript": (
        "/* class Ghost {\n   run() {\n*/\nimport Def, {\n  a,\n  b as c\n} from './x';\nimport * as ns from 'y';\nimport { one as uno } from 'z';\nexport class App {\n  // start() {\n  constructor(\n    private x: number,\n    y = 'a // b',\n  ) {\n    go();\n  }\n  start(port: number): void {\n    helper();\n  }\n}\nconst r = /[{]\"/, s = `a ${b} {`\n@Dec({ a: 1 })\nclass D {}\nconst fs = require('fs')\n",
        [("App", "class", 10, 21, "public"), ("App.constructor", "method", 12, 17, "public"), ("App.start", "method", 18, 20, "public"), ("r", "constant", 22, 22, "private"), ("s", "constant", 22, 22, "private"), ("D", "class", 23, 24, "private"), ("fs", "constant", 25, 25, "private")],
        [("./x", ["Def", "a", "b"], "c", 4), ("y", ["*"], "ns", 8), ("z", ["one"], "uno", 9), ("fs", [], None, 25)],
    ),
    "rust": (
        "use std::{io, fmt::{self, Debug}};\nuse crate::shape::{\n    Point,\n    Line,\n};\nuse a::b as c;\nuse x::*;\nuse solo;\n/// fn doc()\npub fn long(\n    a: u32,\n    b: &'a str,\n) -> u32 {\n    a\n}\nfn next() {}\nimpl<T> Into<Vec<T>> for Pagination<T> { fn into(self) {} }\n",
        [("long", "function", 10, 15, "public"), ("next", "function", 16, 16, "private"), ("impl_Pagination<T>::into", "method", 17, 17, "private")],
        [("std", ["io"], None, 1), ("std::fmt", ["self", "Debug"], None, 1), ("crate::shape", ["Point", "Line"], None, 2), ("a", ["b"], "c", 6), ("x", ["*"], None, 7), ("solo", [], None, 8)],
    ),
    "go": ("package main\n\nimport (\n\tx \"fmt\"\n\t\"net/http\"\n)\n\nfunc (s *Server[T]) Start(\n\ta int,\n\tb int,\n) error {\n\treturn nil\n}\nvar _ = json.Marshal\ntype F func(int) error\n", [("Server.Start", "method", 8, 13, "public"), ("F", "type", 15, 15, "public")], [("fmt", [], "x", 4), ("net/http", [], None, 5)]),
    "java": ("import J.Util;\nimport java.util.*;\nimport static java.lang.Math.max;\n/**\n * class Old {\n */\npublic class App {\n    public void run(\n        int a,\n        String b) {\n        call(a,\n            b);\n    }\n    class In { @Override\n      protected void x() {} }\n}\n", [("App", "class", 7, 16, "public"), ("App.run", "method", 8, 13, "public"), ("App.In", "class", 14, 15, "internal"), ("App.In.x", "method", 14, 15, "internal")], [("J.Util", [], None, 1), ("java.util.*", [], None, 2), ("java.lang.Math", ["max"], None, 3)]),
    "kotlin": ("import k.N as M\nimport k.*\nclass A(\n    val x: Int,\n    val y: Int,\n) {\n    fun go() {\n    }\n    companion object {\n    }\n}\nfun <T> List<T>.second(): T = this[1]\n", [("A", "class", 3, 11, "public"), ("A.go", "method", 7, 8, "public"), ("A.Companion", "class", 9, 10, "public"), ("List.second", "method", 12, 12, "public")], [("k.N", [], "M", 1), ("k.*", [], None, 2)]),
    "csharp": ("using Foo = Bar.Baz;\nusing System;\nnamespace A.B;\npublic class P\n{\n    public void Run(\n        int x,\n        int y)\n    {\n        Go();\n    }\n}\n", [("A.B.P", "class", 4, 12, "public"), ("A.B.P.Run", "method", 6, 11, "public")], [("Bar.Baz", [], "Foo", 1), ("System", [], None, 2)]),
    "swift": ("import UIKit\nstruct V {\n    func draw(\n        a: Int,\n        b: Int\n    ) -> Int {\n        1\n    }\n}\nenum E {\n  case one, two(Int)\n}\n", [("V", "type", 2, 9, "internal"), ("V.draw", "method", 3, 8, "internal"), ("E", "enum", 10, 12, "internal"), ("E.one", "constant", 11, 11, "internal"), ("E.two", "constant", 11, 11, "internal")], [("UIKit", [], None, 1)]),
}


def test_languages(spark):
    """What each language declares and imports: comments, strings, nested and grouped declarations, several on a line."""
    files = spark.createDataFrame([(name, name, case[0]) for name, case in CASES.items()], "path string, language string, content string")
    symbols, imports = (df.collect() for df in parsing.parse(files))
    for name, (_, wanted, asked) in CASES.items():
        found = [(s.qualified_name, s.kind, s.start_line, s.end_line, s.visibility) for s in symbols if s.file_path == name]
        assert sorted(found, key=lambda s: (s[2], s[0])) == sorted(wanted, key=lambda s: (s[2], s[0])), name
        seen = [(i.module, i.names, i.alias, i.line) for i in imports if i.file_path == name]
        assert sorted(seen, key=lambda i: (i[3], i[0])) == sorted(asked, key=lambda i: (i[3], i[0])), name


def test_signatures_and_owners(spark):
    text = "func (r *router) AddRoute(path string, h Handler) {\n\tr.routes[path] = h\n}\n"
    row = parsing.parse(spark.createDataFrame([("h.go", "go", text)], "path string, language string, content string"))[0].first()
    assert row.signature == "func (r *router) AddRoute(path string, h Handler)" and row.parent == "router"


@pytest.mark.parametrize("language", statements.LANGUAGES)
def test_any_text_is_read(language):
    """Text that is no program: never an error, statements in order, inside the text."""
    draw = random.Random(language)
    pieces = ["{", "}", "(", ")", "[", "]", '"', "'", "`", "\n", ";", ",", "class A", "import", "use a::", "enum E", "//", "/*", "*/", "\\", "x", " = ", "=>", "@", "#", "/", "fn f", '"""', "type", "const (", "é"]
    for _ in range(300):
        text = "".join(draw.choice(pieces) for _ in range(draw.randint(0, 40)))
        lines = [(a, b) for *_, a, b in statements.statements(text, language)]
        assert all(1 <= a <= b <= text.count("\n") + 1 for a, b in lines), text
    assert statements.statements("", language) == []
    assert len(statements.statements("x = [\n" * 20_000, language)) >= 1  # deep


def test_open_brackets_end(spark):
    text = "class A {\n    void run(\n" + "        int a,\n" * 200
    symbols, _ = parsing.parse(spark.createDataFrame([("f", "java", text)], "path string, language string, content string"))
    assert {r.qualified_name for r in symbols.collect()} >= {"A"}


def test_broken_python():
    text = "import os\nfrom a import b\n\nclass A(B):\n    def ok(self):\n        return 1\n    def bad(self:\n        return\n    @dec\n    def fine(self):\n        return 2\n\ndef broken(:\n    pass\n\n@d\ndef good(x):\n    return x\n"
    found, imports = parsing.parse_python("f.py", text)
    assert [s[2:6] for s in found] == [("A", "class", 4, 11), ("A.ok", "method", 5, 6), ("A.fine", "method", 9, 11), ("good", "function", 16, 18)]
    assert [i[1] for i in imports] == ["os", "a"]


#: importing file, language, module, names, relative; the file that is meant
MEANT = [
    ("cmd/main.go", "go", "myapp/pkg/models", [], False, "pkg/models/a_user.go"), ("cmd/main.go", "go", "fmt", [], False, None),
    ("src/app.ts", "typescript", "./lib/util.js", ["x"], True, "src/lib/util.ts"), ("src/app.ts", "typescript", "@/lib/util", [], False, "src/lib/util.ts"), ("src/app.ts", "typescript", "./lib", [], True, "src/lib/index.ts"),
    ("src/app.ts", "typescript", "react", [], False, None), ("src/main.rs", "rust", "crate::models", ["User"], True, "src/models.rs"), ("src/main.rs", "rust", "crate", ["net"], True, "src/net/mod.rs"), ("src/main.rs", "rust", "std::io", ["Read"], False, None),
    ("app/Main.java", "java", "com.example.models.User", [], False, "java/com/example/models/User.java"), ("app/Main.kt", "kotlin", "com.example.models.User", [], False, "java/com/example/models/User.java"),
    ("P.cs", "csharp", "MyApp.Models", [], False, "MyApp/Models/User.cs"), ("P.cs", "csharp", "System.Models", [], False, None), ("App.swift", "swift", "services", [], False, "Sources/Services/A.swift"), ("App.swift", "swift", "Foundation", [], False, None),
    ("pkg/a/b.py", "python", "..c", ["d"], True, "pkg/c/d.py"), ("main.py", "python", "pkg.c", ["d"], False, "pkg/c/d.py"), ("pkg/c/d.py", "python", "pkg.c.d", [], False, None),
]


def test_imports_meet_files(spark):
    known = {m[5] for m in MEANT if m[5]} | {m[0] for m in MEANT} | {"pkg/models/z_user.go", "deep/x/src/lib/util.ts", "lib/react/react.go"}
    suffix = {"go": "go", "ts": "typescript", "rs": "rust", "java": "java", "kt": "kotlin", "cs": "csharp", "swift": "swift", "py": "python"}
    files = spark.createDataFrame([(p, suffix[p.rsplit(".")[-1]], "") for p in known], "path string, language string, content string")
    imports = spark.createDataFrame([(p, m, n, None, i, r) for i, (p, _, m, n, r, _) in enumerate(MEANT)], parsing.IMPORTS)
    got = {r.line: r.resolved_path for r in parsing.resolve(imports, files).collect()}
    assert got == {i: m[5] for i, m in enumerate(MEANT)}


def test_keys_hold_one_row(spark):
    """Files that share their last names make one row a key, so a common name multiplies nothing."""
    files = spark.createDataFrame([(f"p{i}/x/__init__.py", "python", "") for i in range(300)], "path string, language string, content string")
    keys = parsing.path_keys(files)
    assert keys.where("key = 'f:x/__init__.py'").collect()[0].path == "p0/x/__init__.py" and keys.count() == 302


def test_small_pieces_join(spark):
    word = lambda n: " ".join(["w"] * n)
    rows = [("f", 1, 1, word(10), "py"), ("f", 5, 6, word(45), "py"), ("f", 9, 9, word(60), "py"), ("f", 12, 12, word(1), "py"), ("g", 3, 3, "x", "py")]
    pieces = spark.createDataFrame([(*r, len(r[3].split())) for r in rows], "file_path string, start_line int, end_line int, content string, language string, token_count long")
    got = {(r.file_path, r.start_line, r.end_line, len(r.content.split())) for r in chunking.merge_texts(pieces).collect()}
    assert got == {("f", 1, 6, 55), ("f", 9, 12, 61), ("g", 3, 3, 1)}


def test_chunks_hold_their_imports(spark):
    text = "import sys\nimport numpy as np\nfrom a.b import first, second\n\n\ndef one():\n    return np.zeros(3) + first\n\n\ndef two():\n    return 1\n"
    files = spark.createDataFrame([("m.py", "python", text)], "path string, language string, content string")
    chunks = {r.symbol_name: r for r in index.build(files).chunks.collect()}
    assert chunks["one"].imports_context == "import numpy as np\nfrom a.b import first, second"
    assert chunks["two"].imports_context == "" and chunks["one"].token_count > len(chunks["one"].content.split()) * 1.3
    assert chunks[None].start_line == 1 and len(chunks) == 3
