"""Files to symbols and imports, and imports to the files they mean.

Python is read with the standard library's syntax tree (a file that has none, block
by block); eight other languages as statements (``statements``), whose heads a table
of patterns a language sorts into declarations and imports (``declarations``).
Files are read once for each of the two ways, into written tables.

An import has candidate keys in order of preference: ends of paths, or folders for
languages whose imports name a package.  Every file has a key for each end of its
path; of the files that share a key the best is chosen first, so that candidates meet
at most one row a key, and no pair leaves the join that is no match.
"""

from __future__ import annotations

import ast
import posixpath
import re
import textwrap
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.sources import declarations, statements
from corvane.sources.store import materialise

SYMBOLS = "file_path string, name string, qualified_name string, kind string, start_line int, end_line int, visibility string, signature string, docstring string, decorators array<string>, parent string"
IMPORTS = "file_path string, module string, names array<string>, alias string, line int, is_relative boolean"
_FIELDS = "what string, " + SYMBOLS + ", module string, names array<string>, alias string, line int, is_relative boolean"

def _parsed(lines: list[str], first: int) -> list[ast.stmt]:
    try:
        return ast.parse("\n" * first + textwrap.dedent("\n".join(lines))).body
    except (SyntaxError, ValueError, RecursionError):
        return []


def readable(text: str) -> list[ast.stmt]:
    """What can be read of a file with errors: its blocks one by one, and of a class that cannot be read the methods that can."""
    lines, out = text.split("\n"), []
    blocks = lambda own: [i for i, x in enumerate(own) if x[:1].strip() and not re.match(r"[)\]}#]|else|elif|except|finally", x) and not (i and own[i - 1].startswith("@"))] + [len(own)]
    places = blocks(lines)
    for a, b in zip(places, places[1:], strict=False):
        found = _parsed(lines[a:b], a)
        head = next((i for i in range(a, b) if lines[i].startswith("class ")), None)
        if not found and head is not None and (named := _parsed([lines[head].split("#")[0].rstrip(), "    pass"], head)):
            inner = textwrap.dedent("\n".join(x if x.strip() else "" for x in lines[head + 1 : b])).split("\n")
            steps = blocks(inner)
            body = [x for c, d in zip(steps, steps[1:], strict=False) for x in _parsed(inner[c:d], head + 1 + c)]
            named[0].body = body or named[0].body
            named[0].end_lineno = max([head + 1, *(x.end_lineno for x in body)])
            found = named
        out += found
    return out


def parse_python(path: str, text: str) -> tuple[list[tuple], list[tuple]]:
    """Top-level classes and functions, methods of the classes, imports (also inside top-level if bodies)."""
    try:
        body = ast.parse(text).body
    except (SyntaxError, ValueError, RecursionError):
        body = readable(text)
    out, imports = [], []

    def level(name: str) -> str:
        return "public" if name.startswith("__") and name.endswith("__") or not name.startswith("_") else "private"

    def symbol(node, kind: str, parent: str | None = None) -> None:
        start = min([node.lineno, *(d.lineno for d in node.decorator_list)]) if node.decorator_list else node.lineno
        if isinstance(node, ast.ClassDef):
            sig = f"class {node.name}" + (f"({', '.join(map(ast.unparse, node.bases))})" if node.bases else "")
        else:
            sig = f"{'async ' * isinstance(node, ast.AsyncFunctionDef)}def {node.name}({ast.unparse(node.args)})" + (f" -> {ast.unparse(node.returns)}" if node.returns else "")
        out.append((path, node.name, f"{parent}.{node.name}" if parent else node.name, kind, start, node.end_lineno, level(node.name), sig, ast.get_docstring(node), [ast.unparse(d) for d in node.decorator_list], parent))

    def walk(body) -> None:
        for node in body:
            if isinstance(node, ast.ClassDef):
                symbol(node, "class")
                for x in node.body:
                    if isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef)):
                        symbol(x, "method", node.name)
            elif isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
                symbol(node, "function")
            elif isinstance(node, ast.Import):
                imports.extend((path, a.name, [], a.asname, node.lineno, False) for a in node.names)
            elif isinstance(node, ast.ImportFrom):
                imports.append((path, "." * node.level + (node.module or ""), [a.name for a in node.names], node.names[0].asname if len(node.names) == 1 else None, node.lineno, node.level > 0))
            elif isinstance(node, ast.If):
                walk(node.body)
                walk(node.orelse)

    walk(body)
    return out, imports


def _python(files: DataFrame) -> DataFrame:
    """Symbols and imports (``what``) of the Python files."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.strip().split()[0] for x in _FIELDS.split(", ")]
        for frame in frames:
            rows = []
            for path, text in frame.itertuples(index=False):
                found, imports = parse_python(path, text or "")
                rows += [("symbol", *s, None, None, None, None, None) for s in found]
                rows += [("import", i[0], *[None] * 10, *i[1:]) for i in imports]
            yield pd.DataFrame(rows, columns=names).astype(object)

    return files.where("language = 'python'").select("path", "content").mapInPandas(run, _FIELDS)


def _fields(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def parse(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(symbols, imports) of files (path, language, content)."""
    both = materialise(_python(files), "parsed")
    read = materialise(statements.read(files), "statements")
    symbols = both.where("what = 'symbol'").select(*_fields(SYMBOLS)).unionByName(declarations.symbols(read))
    return symbols, both.where("what = 'import'").select(*_fields(IMPORTS)).unionByName(declarations.imports(read))


def imports_of(files: DataFrame) -> DataFrame:
    """The imports of files alone, as of ``parse``: a text is read as statements up to the last one that can be an import, wherever that stands."""
    read = materialise(statements.read(files, only_imports=True), "statements")
    return _python(files).where("what = 'import'").select(*_fields(IMPORTS)).unionByName(declarations.imports(read))


#: Beginnings of TypeScript module names and the folders they stand for.
ALIASES = {"@/": "src/", "~/": "src/"}
#: Modules of the platform, which no file of a project is.
PLATFORM = {
    "csharp": ("System", "Microsoft", "NUnit", "Xunit", "MSTest"),
    "swift": tuple("Foundation UIKit SwiftUI AppKit Combine CoreData CoreGraphics CoreLocation Dispatch Darwin Glibc XCTest os MapKit AVFoundation WebKit StoreKit Security Network".split()),
}


def keys_of(files: DataFrame) -> DataFrame:
    """path, key: every end of a path (``f:``) and every folder a package can be named by (``go:``, ``csharp:``, ``swift:``)."""
    parts, folders = F.split("path", "/"), F.slice(F.split("path", "/"), 1, F.size(F.split("path", "/")) - 1)
    ends = lambda mark, xs: F.transform(F.sequence(F.lit(1), F.size(xs)), lambda i: F.concat(F.lit(mark), F.array_join(F.slice(xs, i, F.size(xs)), "/")))
    some = lambda mark, xs: F.when(F.size(xs) > 0, ends(mark, xs)).otherwise(F.array().cast("array<string>"))
    stem = F.regexp_replace(F.element_at(parts, -1), r"\.[^.]*$", "")
    packages = (
        F.when(F.col("language") == "go", some("go:", folders)).when(F.col("language") == "csharp", some("csharp:", folders))
        .when(F.col("language") == "swift", F.transform(F.concat(folders, F.array(stem)), lambda x: F.concat(F.lit("swift:"), F.lower(x)))).otherwise(F.array().cast("array<string>"))
    )
    return files.select("path", "language").select("path", F.explode(F.array_distinct(F.concat(ends("f:", parts), packages))).alias("key"))


def path_keys(files: DataFrame) -> DataFrame:
    """key, path: of the files that share a key the best one, the shortest path, then the first.  One row a key."""
    return keys_of(files).groupBy("key").agg(F.min(F.struct(F.length("path").alias("n"), "path"))["path"].alias("path"))


def _asked(imports: DataFrame, files: DataFrame) -> DataFrame:
    """imports with language, asked (names, never null) and scope: what an import is resolved by."""
    scope = F.when(F.col("is_relative"), F.col("file_path")).otherwise("")
    rows = imports.join(files.select(F.col("path").alias("file_path"), "language"), "file_path")
    return rows.withColumns({"scope": scope, "asked": F.coalesce("names", F.array().cast("array<string>"))})


_ASKED = ["language", "module", "asked", "scope"]


def _wanted(rows: DataFrame, aliases: dict[str, str]) -> DataFrame:
    """The candidate keys of each different question among the rows, by preference n."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = [(language, module, list(names), path, n, key) for language, module, names, path in frame.itertuples(index=False) for n, key in enumerate(candidates(path, language, module, names, aliases))]
            yield pd.DataFrame(out, columns=[*_ASKED, "n", "key"])

    return rows.select(*_ASKED).distinct().mapInPandas(run, "language string, module string, asked array<string>, scope string, n int, key string")


def asking(imports: DataFrame, files: DataFrame, keys: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """file_path of the imports that ask for one of the keys."""
    rows = _asked(imports, files)
    hit = _wanted(rows, ALIASES if aliases is None else aliases).join(keys, "key", "left_semi").select(*_ASKED).distinct()
    return rows.join(hit, _ASKED, "left_semi").select("file_path").distinct()


def resolve(imports: DataFrame, files: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """imports with resolved_path: the known file an import means, null if none (or the importing file itself).

    What is asked for is resolved once, however many files ask for it.
    """
    rows = materialise(_asked(imports, files), "imports")
    best = _wanted(rows, ALIASES if aliases is None else aliases).join(path_keys(files), "key").groupBy(*_ASKED).agg(F.min_by("path", "n").alias("resolved_path"))
    out = rows.join(best, _ASKED, "left").select(*imports.columns, "resolved_path")
    return out.withColumn("resolved_path", F.when(F.col("resolved_path") != F.col("file_path"), F.col("resolved_path")))


def candidates(path: str, language: str, module: str, names, aliases: dict[str, str] = ALIASES) -> list[str]:
    """Keys of files an import could mean, best first; ``path`` is the importing file of a relative import."""
    folder, names = posixpath.dirname(path), [n for n in (names if names is not None else []) if n]
    if language == "python":
        level = len(module) - len(module.lstrip("."))
        parts = [p for p in module.lstrip(".").split(".") if p]
        base = ""
        if level:
            base = folder
            for _ in range(level - 1):
                base = posixpath.dirname(base)
        tails = [[*parts, n] for n in names] + [parts[:k] for k in range(len(parts), 0, -1)] if not level else [*([*parts, n] for n in names), parts]
        return ["f:" + posixpath.join(base, *t) + end for t in tails if t for end in (".py", "/__init__.py")]
    if language in ("typescript", "javascript"):
        alias = next((a for a in aliases if module.startswith(a)), None)
        if module.startswith("."):
            base = posixpath.normpath(posixpath.join(folder, module))
        elif alias or "/" in module and not module.startswith("@"):
            base = aliases[alias] + module[len(alias) :] if alias else module
        else:
            return []
        base = re.sub(r"\.[cm]?jsx?$", "", base)
        return ["f:" + base + end for end in (".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.tsx", "/index.js", "/index.jsx")]
    if language == "rust":
        parts = module.split("::")
        if parts[0] not in ("crate", "self", "super"):
            return []
        while parts and parts[0] in ("crate", "self", "super"):
            parts = parts[1:]
        tails = [[*parts, n] for n in names if n not in ("*", "self")] + [parts[:k] for k in range(len(parts), 0, -1)]
        return ["f:" + "/".join(t) + end for t in tails for end in (".rs", "/mod.rs", "/lib.rs")]
    if language in ("java", "kotlin"):
        parts = module.split(".")
        return ["f:" + "/".join(parts[k:]) + end for k in range(len(parts)) for end in ((".java",) if language == "java" else (".kt", ".java"))]
    if language == "csharp":
        parts = module.split(".")
        if parts[0] in PLATFORM["csharp"]:
            return []
        return [key for k in range(len(parts)) for key in ("csharp:" + "/".join(parts[k:]), "f:" + "/".join(parts[k:]) + ".cs")]
    if language == "go":
        parts = module.split("/")
        return ["go:" + "/".join(parts[k:]) for k in range(len(parts))] if len(parts) > 1 else []
    if language == "swift":
        return [] if module.split(".")[0] in PLATFORM["swift"] else ["swift:" + module.split(".")[0].lower()]
    return []
