"""Projections, filters and point lookups over chunks and symbols."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_BATCH = 50
# Extension to language, folders that are left out.
LANGUAGES = {
    ".py": "python", ".ts": "typescript", ".tsx": "typescript", ".js": "javascript", ".jsx": "javascript", ".go": "go", ".rs": "rust",
    ".java": "java", ".kt": "kotlin", ".kts": "kotlin", ".cs": "csharp", ".swift": "swift",
}
IGNORES = "node_modules/ .git/ __pycache__/ .venv/ venv/ vendor/ .mypy_cache/ .pytest_cache/ .ruff_cache/ dist/ build/ .eggs/ *.egg-info/ target/ bin/ obj/ .build/".split()


def language_of(path: Column) -> Column:
    """Language by extension, null if unknown."""
    table = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.element_at(table, F.lower(F.regexp_extract(path, r"\.[^./]+$", 0)))


def ignored(path: Column, patterns: list[str] = IGNORES) -> Column:
    """A pattern with a final slash names a path segment, another the whole path or its last part."""
    parts = F.split(path, "/")
    folders = [p.rstrip("/") for p in patterns if p.endswith("/")]
    names = [p for p in patterns if not p.endswith("/")]
    hit = F.arrays_overlap(parts, F.array(*map(F.lit, folders))) if folders else F.lit(False)
    return hit | path.isin(names) | F.element_at(parts, -1).isin(names) if names else hit


def by_ids(chunks: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return chunks.join(ids.select(key).distinct(), key, "left_semi")


def with_path_keyword(chunks: DataFrame, keyword: str, limit: int) -> DataFrame:
    """Chunks whose path holds the keyword literally, first by id."""
    return chunks.where(F.contains(F.lower("file_path"), F.lit(keyword.lower()))).orderBy("id").limit(limit)


def symbol_search(symbols: DataFrame, phrase: list[str], kind: str | None, limit: int, filter_first: bool = True, language: str | None = None) -> DataFrame:
    """Rows where the phrase's tokens stand side by side in the tokens of ``text``; by id."""
    found = symbols.where(F.contains(F.concat(F.lit(" "), F.array_join(F.col("tokens"), " "), F.lit(" ")), F.lit(f" {' '.join(phrase)} ")))
    return narrowed(found, kind, limit, filter_first, language)


def narrowed(found: DataFrame, kind: str | None, limit: int, filter_first: bool = True, language: str | None = None) -> DataFrame:
    """The first rows by id, of a kind and language where one is asked for."""
    if language is not None:
        found = found.where(F.col("language") == language)
    if kind is None:
        return found.orderBy("id").limit(limit)
    if filter_first:
        return found.where(F.col("kind") == kind).orderBy("id").limit(limit)
    return found.orderBy("id").limit(limit).where(F.col("kind") == kind)


PUBLIC = "symbol_id symbol_name qualified_name kind file_path start_line end_line language signature visibility docstring".split()


def public_record(chunks: DataFrame) -> DataFrame:
    """The fields of a symbol that callers see, as far as the table has them."""
    return chunks.select(*[c for c in PUBLIC if c in chunks.columns])


def surrogate_scan(rows: DataFrame, ids: list | None = None, files: list[str] | None = None) -> DataFrame:
    """Surrogates of some chunks or files, or all in order of the chunk."""
    if ids is not None:
        rows = rows.where(F.col("id").isin(ids))
    if files is not None:
        rows = rows.where(F.col("file_path").isin(files))
    return rows if ids is not None or files is not None else rows.orderBy("id")


def chunk_order(chunks: DataFrame) -> DataFrame:
    """chunks with their place in their file, by the first line."""
    return chunks.withColumn("place", F.row_number().over(Window.partitionBy("file_path").orderBy("start_line", "id")))


def batch(chunks: DataFrame, ids: list) -> DataFrame:
    """pos, id and the chunk's columns: in the order asked, repeats kept, null for misses."""
    if len(ids) > MAX_BATCH:
        raise ValueError(f"at most {MAX_BATCH} ids")
    asked = chunks.sparkSession.createDataFrame([(i, x) for i, x in enumerate(ids)], "pos int, id long")
    return asked.join(chunks, "id", "left")


def with_defaults(chunks: DataFrame) -> DataFrame:
    """symbol_id, kind and visibility with their defaults."""
    return chunks.select(
        "id",
        F.coalesce("symbol_id", F.col("id").cast("string")).alias("symbol_id"),
        F.coalesce("kind", F.lit("variable")).alias("kind"),
        F.coalesce("visibility", F.lit("public")).alias("visibility"),
    )


def is_test_path(path: Column) -> Column:
    return path.startswith("test") | F.contains(path, F.lit("/test"))


def import_is_relevant(content: Column, alias: Column, names: Column, module: Column) -> Column:
    """The alias or any imported name stands in the content; without names, the last part of the module."""
    named = F.when(F.size(names) > 0, F.exists(names, lambda s: F.contains(content, s))).otherwise(F.contains(content, F.substring_index(module, ".", -1)))
    return F.coalesce(F.contains(content, alias), F.lit(False)) | named


def interfaces(symbols: DataFrame) -> DataFrame:
    """Public top-level functions, classes and interfaces, without private names (double underscores stay)."""
    name = F.col("name")
    private = name.startswith("_") & ~(name.startswith("__") & name.endswith("__"))
    return symbols.where((F.col("visibility") == "public") & F.col("kind").isin("function", "class", "interface") & F.col("parent").isNull() & ~private)


def exports(symbols: DataFrame) -> DataFrame:
    return symbols.where((F.col("visibility") == "public") & F.col("parent").isNull() & F.col("kind").isin("function", "class", "interface"))


def type_like(symbols: DataFrame) -> DataFrame:
    return symbols.where(F.col("kind").isin("class", "type", "interface"))


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Last writer wins by key."""
    both = old.withColumn("__seq", F.lit(0)).unionByName(new.withColumn("__seq", F.lit(1)))
    latest = Window.partitionBy(key).orderBy(F.desc("__seq"))
    return both.withColumn("__n", F.row_number().over(latest)).where("__n = 1").drop("__seq", "__n")


def rename(rows: DataFrame, renames: DataFrame, column: str = "file_path") -> DataFrame:
    """Paths replaced by (old_path, new_path) where one is given; ids stay."""
    out = rows.join(renames, rows[column] == renames["old_path"], "left")
    return out.withColumn(column, F.coalesce("new_path", column)).drop("old_path", "new_path")


def replace_files(rows: DataFrame, fresh: DataFrame, files: DataFrame | None = None, column: str = "file_path") -> DataFrame:
    """rows with those of some files (those of ``fresh`` unless named) replaced by the fresh ones; rows without a file stay."""
    gone = (fresh if files is None else files).select(column).distinct()
    return rows.join(gone, column, "left_anti").select(rows.columns).unionByName(fresh)
