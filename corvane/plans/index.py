"""From files to an index: symbols, imports, edges, chunks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions.text import estimated_tokens, import_line
from corvane.operators import chunking, lookups
from corvane.sources import parsing


@dataclass
class Index:
    files: DataFrame
    symbols: DataFrame
    imports: DataFrame
    edges: DataFrame
    chunks: DataFrame


def edges_of(imports: DataFrame) -> DataFrame:
    """source, target, kind, location of resolved imports; the last line of several between two files."""
    rows = imports.where("resolved_path IS NOT NULL").groupBy(F.col("file_path").alias("source"), F.col("resolved_path").alias("target")).agg(F.max("line").alias("line"))
    return rows.select("source", "target", F.lit("imports").alias("kind"), F.concat_ws(":", "source", F.col("line").cast("string")).alias("location"))


def import_context(chunks: DataFrame, imports: DataFrame) -> DataFrame:
    """chunks with imports_context: the imports of their file that their text uses, a line each, in order of place."""
    listed = F.struct("line", "module", F.coalesce("names", F.array().cast("array<string>")).alias("names"), "alias")
    held = imports.groupBy("file_path").agg(F.array_sort(F.collect_list(listed)).alias("imports"))
    single = lambda x: F.size(x["names"]) == 1
    named = lambda x: F.transform(x["names"], lambda n: F.struct(n.alias("name"), F.when(single(x), x["alias"]).alias("alias")))
    used = F.filter("imports", lambda x: lookups.import_is_relevant(F.col("content"), x["alias"], x["names"], x["module"]))
    lines = F.transform(used, lambda x: import_line(x["module"], named(x), x["alias"]))
    return chunks.join(held, "file_path", "left").withColumn("imports_context", F.coalesce(F.array_join(lines, "\n"), F.lit(""))).drop("imports")


def chunks_of(files: DataFrame, symbols: DataFrame, imports: DataFrame, most: int = chunking.MAX_TOKENS) -> DataFrame:
    """A chunk per symbol and per run of lines no symbol covers; long ones are split at lines, small runs of lines join, blank ones are dropped.

    Tokens are those of a chunk with the imports it uses.
    """
    lines = files.select(F.col("path").alias("file_path"), "language", F.split("content", "\n").alias("lines"))
    spans = symbols.select("file_path", F.col("name").alias("symbol_name"), "qualified_name", "kind", "visibility", "signature", "docstring", "start_line", "end_line")
    gaps = chunking.uncovered(symbols.select("file_path", "start_line", "end_line"), lines.select("file_path", F.size("lines").alias("lines")))
    null = F.lit(None).cast("string")
    rest = gaps.select("file_path", null.alias("symbol_name"), null.alias("qualified_name"), null.alias("kind"), null.alias("visibility"), null.alias("signature"), null.alias("docstring"), F.col("first_line").cast("int").alias("start_line"), F.col("last_line").cast("int").alias("end_line"))
    # named spans and the rest go their own ways, so that no text is cut twice; all of a file stays in its task
    own = _cut(spans, lines, most).withColumn("token_count", F.lit(None).cast("long"))
    loose = chunking.merge_texts(_cut(rest, lines, most).withColumn("token_count", estimated_tokens(F.col("content"))))
    for c in own.columns:
        if c not in loose.columns:
            loose = loose.withColumn(c, F.lit(None).cast(own.schema[c].dataType))
    return _identified(own, imports).unionByName(_identified(loose, imports))


def _cut(spans: DataFrame, lines: DataFrame, most: int) -> DataFrame:
    """A row a span with its content, several where it has too many tokens; blank ones are dropped."""
    # a file's spans come to its row, where each takes its own lines; the lines of a file move once, not once a symbol
    fields = [c for c in spans.columns if c != "file_path"]
    held = spans.groupBy("file_path").agg(F.collect_list(F.struct(*fields)).alias("spans")).join(lines.hint("merge"), "file_path")  # texts pack well on disk, so their size there says nothing: never sent whole
    cut = F.transform("spans", lambda s: F.struct(*[s[c].alias(c) for c in fields], F.slice("lines", s["start_line"], s["end_line"] - s["start_line"] + 1).alias("own")))
    rows = held.select("file_path", "language", F.explode(cut).alias("s")).select("file_path", *[f"s.{c}" for c in fields], "language", "s.own")
    # what cannot have too many words by its length is one piece; its words are not counted
    short = F.aggregate("own", F.lit(0), lambda n, x: n + F.length(x) + 2) <= 2 * most
    cost = F.transform("own", lambda x: F.size(F.split(F.trim(x), r"\s+")).cast("long"))
    rows = rows.withColumn("group", chunking.groups_by_budget(F.when(short, F.array().cast("array<long>")).otherwise(cost), most))
    rows = rows.withColumn("group", F.when(F.size("group") == 0, F.array_repeat(F.lit(0), F.size("own"))).otherwise(F.col("group")))
    rows = rows.select("*", F.explode(F.array_distinct("group")).alias("part"))
    place = F.array_position("group", F.col("part"))
    taken = F.size(F.filter("group", lambda g: g == F.col("part")))
    rows = rows.withColumns({"content": F.array_join(F.slice("own", place.cast("int"), taken), "\n"), "start_line": (F.col("start_line") + place - 1).cast("int")})
    return rows.withColumn("end_line", F.col("start_line") + taken - 1).where(F.col("content").rlike(r"\S")).drop("own", "group", "part")


def _identified(rows: DataFrame, imports: DataFrame) -> DataFrame:
    """rows with the imports they use, their tokens, id and symbol_id."""
    rows = import_context(rows, imports)
    whole = F.when(F.col("imports_context") != "", F.concat_ws("\n", "imports_context", "content")).otherwise(F.col("content"))
    rows = rows.withColumns({
        "id": F.concat_ws(":", "file_path", F.coalesce("symbol_name", F.lit("_module")), F.col("start_line").cast("string")),
        "symbol_id": chunking.symbol_id(F.col("file_path"), F.col("qualified_name"), F.col("kind")), "token_count": estimated_tokens(whole),
    })
    return chunking.disambiguate(rows, ["file_path", "symbol_id"])


def build(files: DataFrame) -> Index:
    symbols, imports = parsing.parse(files)
    imports = parsing.resolve(imports, files)
    return Index(files, symbols, imports, edges_of(imports), chunks_of(files, symbols, imports))
