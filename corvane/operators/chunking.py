"""Chunking: symbols and what they leave over become token-bounded chunks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_TOKENS, MIN_TOKENS = 500, 50


def symbol_id(path: Column, qualified: Column, kind: Column) -> Column:
    """path::name#kind; file-level code is path::_module#module."""
    return F.concat(path, F.lit("::"), F.coalesce(qualified, F.lit("_module")), F.lit("#"), F.when(qualified.isNull(), "module").otherwise(kind))


def disambiguate(rows: DataFrame, keys: list[str]) -> DataFrame:
    """@2, @3 and so on after repeated ids, in order of the first line."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy("start_line"))
    return rows.withColumn("__n", n).withColumn("symbol_id", F.when(F.col("__n") > 1, F.concat_ws("@", "symbol_id", F.col("__n").cast("string"))).otherwise(F.col("symbol_id"))).drop("__n")


def uncovered(spans: DataFrame, files: DataFrame) -> DataFrame:
    """file_path, first_line, last_line: line ranges that no span covers, the tail included."""
    before = Window.partitionBy("file_path").orderBy("start_line", "end_line").rowsBetween(Window.unboundedPreceding, -1)
    gaps = spans.select("file_path", "start_line", F.coalesce(F.max("end_line").over(before), F.lit(0)).alias("m")).where("start_line > m + 1")
    gaps = gaps.select("file_path", (F.col("m") + 1).cast("long").alias("first_line"), (F.col("start_line") - 1).cast("long").alias("last_line"))
    ends = files.join(spans.groupBy("file_path").agg(F.max("end_line").alias("m")), "file_path", "left")
    tail = ends.where(F.coalesce("m", F.lit(0)) < F.col("lines")).select("file_path", (F.coalesce("m", F.lit(0)) + 1).cast("long").alias("first_line"), F.col("lines").cast("long").alias("last_line"))
    return gaps.unionByName(tail)


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _groups(costs: pd.Series, most: pd.Series) -> pd.Series:
    def numbered(values, limit: int) -> list[int]:
        out, total, group = [], 0, 0
        for x in values.tolist():
            if total + x > limit and total > 0:
                total, group = 0, group + 1
            total += x
            out.append(group)
        return out

    return pd.Series([numbered(c, m) for c, m in zip(costs, most, strict=True)])


def groups_by_budget(costs: Column, most: int = MAX_TOKENS) -> Column:
    """Group number of each element of an array of costs: a new group begins where the running sum would pass the limit (one walk)."""
    return _groups(costs, F.lit(most))


def split_lines(chunks: DataFrame, most: int = MAX_TOKENS) -> DataFrame:
    """id, part, content, first (line of the chunk), token_count: a chunk of too many tokens in runs of whole lines."""
    from corvane.functions.text import estimated_tokens, words

    lines = F.split("content", "\n")
    cost = F.transform(lines, lambda x: F.size(words(x)).cast("long"))
    rows = chunks.select("id", lines.alias("lines"), groups_by_budget(cost, most).alias("groups"))
    rows = rows.select("id", F.posexplode(F.arrays_zip("lines", "groups")).alias("i", "x"))
    parts = rows.groupBy("id", F.col("x.groups").alias("part")).agg(F.min("i").alias("first"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "x.lines"))), lambda y: y["lines"]), "\n").alias("content"))
    return parts.select("id", "part", (F.col("first") + 1).cast("long").alias("first"), "content", estimated_tokens(F.col("content")).alias("token_count"))


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _joined(costs: pd.Series, least: pd.Series) -> pd.Series:
    def numbered(values, limit: int) -> list[int]:
        out, total, group = [], 0, 0
        for x in values.tolist():
            out.append(group)
            total += x
            if total >= limit:
                total, group = 0, group + 1
        return [min(g, group - 1) for g in out] if group else out

    return pd.Series([numbered(c, m) for c, m in zip(costs, least, strict=True)])


def _pieces(chunks: DataFrame, least: int, *fields: str) -> DataFrame:
    """file_path, group, p (start_line, token_count, fields): the pieces of each file in groups of at least ``least`` tokens.

    A piece joins the next ones until they have enough; a rest that has not joins the group before.  One walk a file.
    """
    held = chunks.groupBy("file_path").agg(F.array_sort(F.collect_list(F.struct("start_line", F.coalesce(F.col("token_count").cast("long"), F.lit(0)).alias("token_count"), *fields))).alias("pieces"))
    groups = _joined(F.transform("pieces", lambda p: p["token_count"]), F.lit(least))
    return held.withColumn("groups", groups).select("file_path", F.explode(F.arrays_zip("pieces", "groups")).alias("x")).select("file_path", F.col("x.groups").alias("group"), F.col("x.pieces").alias("p"))


def merge_small(chunks: DataFrame, least: int = MIN_TOKENS) -> DataFrame:
    """file_path, group, token_count: file-level pieces under ``least`` tokens join the next piece, the last one the piece before.

    chunks: file_path, start_line, token_count of file-level pieces.
    """
    return _pieces(chunks, least).groupBy("file_path", "group").agg(F.sum("p.token_count").alias("token_count"))


def merge_texts(chunks: DataFrame, least: int = MIN_TOKENS) -> DataFrame:
    """file_path, language, start_line, end_line, content: file-level pieces (with token_count) joined as in ``merge_small``."""
    own = _pieces(chunks, least, "end_line", "content", "language").groupBy("file_path", "group")
    texts = F.transform(F.array_sort(F.collect_list(F.struct("p.start_line", "p.content"))), lambda x: x["content"])
    return own.agg(F.first("p.language").alias("language"), F.min("p.start_line").alias("start_line"), F.max("p.end_line").alias("end_line"), F.array_join(texts, "\n").alias("content")).drop("group")
