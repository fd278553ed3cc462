"""From files to answers, on small trees written by the tests."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from corvane.api import Engine, compare
from corvane.functions import render
from corvane.operators import graph
from corvane.sources import files as sources
from corvane.sources import parsing
from corvane.sources.store import Store, cache_key

TREE = {
    "main.py": "from __future__ import annotations\nfrom models import User\nfrom services.auth import AuthService\nfrom utils import check\n\n\ndef run(name: str, retries: int = 3) -> User:\n    service = AuthService()\n    return service.login(name)\n",
    "models.py": "class Role:\n    ADMIN = 1\n\n\nclass User:\n    def __init__(self, name):\n        self.name = name\n\n    def _hidden(self):\n        return 1\n",
    "utils.py": "import hashlib\n\n\ndef check(password):\n    return hashlib.sha256(password).hexdigest()\n",
    "services/__init__.py": "",
    "services/auth.py": "from typing import TYPE_CHECKING\nfrom utils import check\nif TYPE_CHECKING:\n    from models import User\n\n\nclass AuthService:\n    def login(self, name):\n        return check(name)\n\n    def logout(self):\n        return None\n",
    "web/app.ts": "import { helper } from './helper';\nexport class App {\n  start(port: number): void {\n    helper();\n  }\n}\nexport function boot() {\n  return 1;\n}\n",
    "web/helper.ts": "export const LIMIT = 5;\nexport function helper() {\n  return LIMIT;\n}\n",
    "lib/geo.rs": "use crate::shape::Point;\npub struct Box {\n    w: u32,\n}\nimpl Box {\n    pub fn area(&self) -> u32 {\n        self.w\n    }\n}\nfn hidden() {}\n",
    "lib/shape.rs": "pub struct Point;\n",
    "go/server.go": "package main\n\nimport (\n\t\"fmt\"\n)\n\ntype Server struct {\n\tname string\n}\n\nfunc (s *Server) Start() {\n\tfmt.Println(s.name)\n}\n\nfunc helper() {}\n",
    "J/App.java": "import J.Util;\npublic class App {\n    private int count;\n    public static void main(String[] args) {\n        return;\n    }\n}\n",
    "J/Util.java": "public interface Util {\n    void go(int x);\n}\n",
    "k/M.kt": "import k.N\nclass M {\n    fun go(x: Int): Int {\n        return x\n    }\n}\nfun String.shout() = this\n",
    "s/V.swift": "import Foundation\npublic struct V {\n    let x: Int\n    public func draw() {\n    }\n}\nextension V {\n    func more() {\n    }\n}\n",
    "c/P.cs": "using System;\npublic class P {\n    public int Count { get; set; }\n    public void Run(int x) {\n    }\n}\n",
    "node_modules/x.js": "function ignored() {}\n",
    "notes.md": "no source\n",
}
PATTERNS = {
    "chain.py": "class Middleware:\n    def set_next(self, x): ...\n    def handle(self, r): ...\n\nclass LoggingMiddleware(Middleware):\n    def handle(self, r): ...\n",
    "sort.py": "class SortStrategy:\n    def sort(self, d): ...\n\nclass BubbleSort:\n    def sort(self, d): ...\n\nclass QuickSort:\n    def sort(self, d): ...\n\nclass Sorter:\n    def run(self, d): ...\n",
    "plain.py": "class DataProcessor:\n    def work(self): ...\n\nclass RouteHandler:\n    def work(self): ...\n",
}


def write(root, tree):
    for path, body in tree.items():
        p = root / path
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(body)
    return str(root)


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    return Engine(spark, write(tmp_path_factory.mktemp("tree"), TREE))


def test_discover(engine):
    assert {r.path for r in engine.index.files.collect()} == set(TREE) - {"node_modules/x.js", "notes.md", "services/__init__.py"}


def test_symbols(engine):
    got = {(r.file_path, r.qualified_name, r.kind, r.start_line, r.end_line, r.visibility) for r in engine.index.symbols.collect()}
    want = {
        ("main.py", "run", "function", 7, 9, "public"), ("models.py", "User", "class", 5, 10, "public"), ("models.py", "User.__init__", "method", 6, 7, "public"),
        ("models.py", "User._hidden", "method", 9, 10, "private"), ("services/auth.py", "AuthService.login", "method", 8, 9, "public"),
        ("web/app.ts", "App", "class", 2, 6, "public"), ("web/app.ts", "App.start", "method", 3, 5, "public"), ("web/app.ts", "boot", "function", 7, 9, "public"), ("web/helper.ts", "LIMIT", "constant", 1, 1, "public"),
        ("lib/geo.rs", "Box", "type", 2, 4, "public"), ("lib/geo.rs", "impl_Box::area", "method", 6, 8, "public"), ("lib/geo.rs", "hidden", "function", 10, 10, "private"),
        ("go/server.go", "Server", "type", 7, 9, "public"), ("go/server.go", "Server.Start", "method", 11, 13, "public"), ("go/server.go", "helper", "function", 15, 15, "private"),
        ("J/App.java", "App", "class", 2, 7, "public"), ("J/App.java", "App.main", "method", 4, 6, "public"), ("J/App.java", "App.count", "variable", 3, 3, "private"),
        ("k/M.kt", "M.go", "method", 3, 5, "public"), ("k/M.kt", "String.shout", "method", 7, 7, "public"), ("s/V.swift", "V.draw", "method", 4, 5, "public"), ("s/V.swift", "V.more", "method", 8, 9, "internal"),
        ("c/P.cs", "P.Run", "method", 4, 5, "public"), ("c/P.cs", "P.Count", "variable", 3, 3, "public"),
    }
    assert want <= got, want - got


def test_edges(engine):
    got = {(r.source, r.target) for r in engine.index.edges.collect()}
    assert got == {("main.py", "models.py"), ("main.py", "services/auth.py"), ("main.py", "utils.py"), ("services/auth.py", "utils.py"), ("services/auth.py", "models.py"), ("web/app.ts", "web/helper.ts"), ("lib/geo.rs", "lib/shape.rs"), ("J/App.java", "J/Util.java")}


def test_chunks_cover_every_line(engine):
    lines = {(r.file_path, i) for r in engine.index.chunks.collect() for i in range(r.start_line, r.end_line + 1)}
    for path, body in TREE.items():
        if path.startswith("node_modules") or path.endswith(".md"):
            continue
        assert all((path, i) in lines for i, x in enumerate(body.split("\n"), 1) if x.strip())
    ids = [r.symbol_id for r in engine.index.chunks.collect()]
    assert len(ids) == len(set(ids))


def test_page_rank(spark):
    edges = spark.createDataFrame([("main", "models"), ("main", "auth"), ("main", "utils"), ("auth", "utils"), ("auth", "models")], "source string, target string")
    nodes = spark.createDataFrame([(x,) for x in ("main", "models", "auth", "utils", "init")], "node string")
    got = {r.node: r["rank"] for r in graph.page_rank(edges, nodes, rounds=20).collect()}
    want = {"main": 0.144075, "init": 0.144075, "auth": 0.184896, "models": 0.263477, "utils": 0.263477}
    assert all(abs(got[k] - v) < 1e-4 for k, v in want.items())


def test_query(engine):
    rows = engine.query("how does AuthService login work", 500).collect()
    assert rows[0].file_path == "services/auth.py" and [r.score for r in rows] == sorted((r.score for r in rows), reverse=True)
    assert engine.query("how does the").count() == 0
    text = engine.ask("login", form="xml")
    assert text.startswith("<context") and "services/auth.py" in text and "login" in engine.ask("login", form="json")
    with pytest.raises(ValueError):
        render.render("x", engine.query("login"), "pdf")


def test_analytics(spark, engine, tmp_path):
    other = Engine(spark, write(tmp_path, PATTERNS))
    got = {r.pattern: (r.n, r.confidence) for r in other.patterns().collect()}
    assert got["middleware_chain"] == (2, 0.60) and got["strategy"] == (4, 0.85)
    faces = {r.name: r for r in engine.interfaces().collect()}
    assert [(p.name, p.type, p.default, p.required) for p in faces["run"].parameters] == [("name", "str", None, True), ("retries", "int", "3", False)] and faces["run"].returns == "User"
    assert {r.dimension for r in compare(engine, other).collect()} >= {"api_surface"}
    assert {r.language: r.files for r in engine.languages().collect()}["python"] == 4
    assert sum(r.file_count for r in engine.modules().collect()) == engine.index.files.count()
    assert {r.path for r in engine.tree(1).collect()} >= {"services", "main.py"}
    assert {(r.qname, r.parent) for r in engine.outline("models.py").collect()} >= {("User.__init__", "User"), ("User", None)}
    assert engine.symbols("login").count() == 1 and engine.symbol("utils.py::check#function").count() == 1


def test_store(spark, engine, tmp_path):
    store = engine.save(str(tmp_path / "s"))
    assert store.get("edges").count() == engine.index.edges.count()
    store.put("edges", engine.index.edges.limit(0))
    assert store.get("edges").count() == 0 and len(cache_key("repo", "abc", spark)) == 64
    with pytest.raises(KeyError):
        Store(spark, str(tmp_path / "none")).get("x")


def test_guards(spark):
    assert sources.check_url("https://example.com/a.git")
    for bad in ("git@host:a", "ssh://a", "file:///a", "ftp://a"):
        with pytest.raises(ValueError):
            sources.check_url(bad)
    with pytest.raises(ValueError):
        sources.check_branch("--upload-pack=x")
    assert parsing.parse_python("x.py", "def (") == ([], [])


def test_tasks(spark, tmp_path):
    (tmp_path / "t.json").write_text('{"task_id": "a", "question": " ", "expected_files": ["x.py"]}\n{"task_id": "b", "question": "q", "expected_files": []}\n')
    tasks = sources.load_tasks(spark, str(tmp_path / "t.json"))
    found = {(r.task_id, r.problem) for r in sources.check_tasks(tasks, spark.createDataFrame([("y.py",)], "path string")).collect()}
    assert found == {("a", "blank question"), ("a", "missing file x.py"), ("b", "no expected files")}
