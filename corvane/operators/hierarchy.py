"""Hierarchies as flat rows with parents; nesting and drawing are left to the reader."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def file_tree(files: DataFrame, max_depth: int = 5, path: str = "path") -> DataFrame:
    """path, parent, depth, is_dir, n_files: folders down to max_depth, and the files above that depth."""
    parts = F.split(path, "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(F.array_join(F.slice(parts, 1, n), "/").alias("path"), n.alias("depth"), (n < F.size(parts)).alias("is_dir")))
    rows = files.select(F.explode(prefixes).alias("x")).select("x.*")
    rows = rows.where(F.col("depth") <= max_depth)
    out = rows.groupBy("path", "depth", "is_dir").agg(F.count("*").alias("n_files"))
    return out.select("path", F.when(F.col("depth") > 1, F.regexp_replace("path", "/[^/]*$", "")).alias("parent"), "depth", "is_dir", "n_files")


def parent_name(qname):
    """What stands before the last ``::`` or ``.`` of a qualified name (empty: none)."""
    return F.regexp_extract(qname, r"^(.*)(::|\.)[^.:]*$", 1)


def outline_parents(symbols: DataFrame) -> DataFrame:
    """file_path, qname and the qualified name of the parent in the same file, null at the top."""
    parents = symbols.select("file_path", F.col("qname").alias("parent")).distinct()
    named = symbols.withColumn("__parent", parent_name("qname"))
    return named.join(parents, (named["file_path"] == parents["file_path"]) & (named["__parent"] == parents["parent"]), "left").select(named["file_path"], "qname", "parent")


def outline_levels(symbols: DataFrame) -> DataFrame:
    """file_path, qname, parent, top, depth of every name of a file: its parent, the outermost name above it without a gap (itself at the top), and how many are above.

    A name's ancestors are the beginnings of it; all of them meet the names of their file in one join, so no level waits for another.
    """
    names = symbols.select("file_path", "qname").where("qname IS NOT NULL").distinct()
    parts = F.split("qname", r"(?=::|\.)")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct((F.size(parts) - n).alias("up"), F.array_join(F.slice(parts, 1, n), "").alias("name")))
    asked = names.select("file_path", "qname", F.explode(above).alias("x")).select("file_path", "qname", "x.up", "x.name")
    found = asked.join(names.select("file_path", F.col("qname").alias("name"), F.lit(True).alias("there")), ["file_path", "name"], "left")
    line = F.array_sort(F.collect_list(F.struct("up", "name", F.col("there").isNotNull().alias("there"))))  # the parts of one name
    gap = F.array_min(F.transform(F.filter("line", lambda x: ~x["there"]), lambda x: x["up"]))
    depth = F.coalesce(gap, F.size("line")) - 1
    rows = found.groupBy("file_path", "qname").agg(line.alias("line")).withColumn("depth", depth)
    return rows.select("file_path", "qname", F.when(F.col("depth") > 0, F.element_at("line", 2)["name"]).alias("parent"), F.element_at("line", F.col("depth") + 1)["name"].alias("top"), "depth")


def root_order(tree: DataFrame) -> DataFrame:
    """place, path, is_dir of the top level: folders first, then by path."""
    top = tree.where("depth = 1").select("path", "is_dir")
    return top.select(F.row_number().over(Window.partitionBy().orderBy(F.desc("is_dir"), "path")).alias("place"), "path", "is_dir")  # the entries of one folder


def draw_outline(rows: list[dict]) -> str:
    """Lines of an outline from (qname, kind, start_line) rows, indented by the parts of the name."""
    out = []
    for r in sorted(rows, key=lambda r: (r["start_line"], r["qname"])):
        depth = len(re.findall(r"::|\.", r["qname"]))
        out.append(f"{'  ' * depth}{r['kind']} {re.split(r'::|[.]', r['qname'])[-1]}:{r['start_line']}")
    return "\n".join(out)


def draw_tree(rows: list[dict]) -> str:
    """Lines of a tree from (path, depth, is_dir) rows of file_tree, folders first."""
    by: dict[str, list[dict]] = {}
    for r in rows:
        by.setdefault(r["path"].rpartition("/")[0], []).append(r)

    def walk(path: str, lead: str) -> list[str]:
        out = []
        own = sorted(by.get(path, []), key=lambda r: (not r["is_dir"], r["path"]))
        for i, r in enumerate(own):
            last = i == len(own) - 1
            out.append(f"{lead}{'└── ' if last else '├── '}{r['path'].rpartition('/')[2]}{'/' * r['is_dir']}")
            out += walk(r["path"], lead + ("    " if last else "│   "))
        return out

    return "\n".join(walk("", ""))
