"""Ways to answer a benchmark task over an engine, run and measured side by side."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.api import Engine
from corvane.functions import text
from corvane.operators import metrics, retrieval, vectors

#: engine, question, expected files -> file_path, rank, tokens
Strategy = Callable[[Engine, str, list[str]], DataFrame]
STRATEGIES: dict[str, Strategy] = {}
MEASURES = ["recall", "precision", "f1", "mrr", "ndcg", "map"]


def strategy(f: Strategy) -> Strategy:
    STRATEGIES[f.__name__] = f
    return f


def _ranked(rows: DataFrame) -> DataFrame:
    """file_path, rank, tokens of chunks (file_path, score, token_count): files by their best score, then by path."""
    files = rows.groupBy("file_path").agg(F.max("score").alias("score"), F.sum("token_count").cast("long").alias("tokens"))
    return files.select("file_path", F.row_number().over(Window.orderBy(F.desc("score"), "file_path")).alias("rank"), "tokens")  # the files of one answer


@strategy
def raw_files(engine: Engine, question: str, expected: list[str]) -> DataFrame:
    """The expected files, whole."""
    return _ranked(engine.index.chunks.where(F.col("file_path").isin(expected)).withColumn("score", F.lit(1.0)))


@strategy
def raw_grepped(engine: Engine, question: str, expected: list[str]) -> DataFrame:
    """Files that hold a keyword of the question, whole."""
    words = engine.spark.range(1).select(text.keywords(F.lit(question))).first()[0]
    if not words:
        return _ranked(engine.index.chunks.limit(0).withColumn("score", F.lit(1.0)))
    hits = retrieval.grep(engine.index.chunks, words).join(engine.index.chunks.select("id", "file_path"), "id").groupBy("file_path").agg(F.min("first").alias("first"))
    return _ranked(engine.index.chunks.join(hits, "file_path").withColumn("score", -F.col("first").cast("double")))


@strategy
def query(engine: Engine, question: str, expected: list[str]) -> DataFrame:
    return _ranked(engine.query(question))


@strategy
def query_fusion(engine: Engine, question: str, expected: list[str]) -> DataFrame:
    """The same with dense hits fused in."""
    return _ranked(engine.query(question, embedder="hash"))


@strategy
def query_vector(engine: Engine, question: str, expected: list[str]) -> DataFrame:
    """The chunks nearest to the question."""
    return _ranked(engine.index.chunks.join(vectors.search_texts(engine.index.chunks, question, 30), "id"))


@strategy
def surrogate_vector(engine: Engine, question: str, expected: list[str]) -> DataFrame:
    """The chunks whose descriptions are nearest to the question."""
    described = engine.index.chunks.select("id", vectors.surrogate(engine.index.chunks).alias("content"))
    return _ranked(engine.index.chunks.join(vectors.search_texts(described, question, 30), "id"))


@strategy
def symbol_lookup(engine: Engine, question: str, expected: list[str]) -> DataFrame:
    """Chunks of symbols the question names."""
    found = retrieval.symbol_seeds(engine.index.chunks, retrieval.symbol_phrases(question, text.SYMBOL_NOISE), 1.0)
    return _ranked(engine.index.chunks.join(found, "id"))


def run_task(engine: Engine, task: dict, names: list[str] | None = None) -> list[dict]:
    """One row a strategy: task_id, strategy, tokens, wall_ms and the metrics; a strategy that fails has its error and no measures."""
    spark, out = engine.spark, []
    wanted = spark.createDataFrame([(task["task_id"], f) for f in task["expected_files"]], "task_id string, file_path string")
    for name in names or list(STRATEGIES):
        start = time.perf_counter()
        try:
            rows = STRATEGIES[name](engine, task["question"], task["expected_files"]).withColumn("task_id", F.lit(task["task_id"])).collect()  # the files of one answer
        except Exception as e:  # noqa: BLE001  one way to answer must not end the others
            out.append(dict.fromkeys(MEASURES) | {"task_id": task["task_id"], "strategy": name, "error": f"{type(e).__name__}: {e}", "tokens": None, "wall_ms": 1000 * (time.perf_counter() - start)})
            continue
        found = spark.createDataFrame([(r["task_id"], r["file_path"], r["rank"]) for r in rows], "task_id string, file_path string, rank int")
        measured = metrics.per_task(found, wanted).first().asDict()
        out.append(measured | {"strategy": name, "error": None, "tokens": sum(r["tokens"] or 0 for r in rows), "wall_ms": 1000 * (time.perf_counter() - start)})
    return out


def run_all(engine: Engine, tasks: list[dict], names: list[str] | None = None) -> DataFrame:
    """All tasks by all strategies, with the tokens saved against whole files."""
    rows = [r for task in tasks for r in run_task(engine, task, names)]
    columns = ["task_id", "strategy", "error", "tokens", "wall_ms", *MEASURES]
    results = engine.spark.createDataFrame([tuple(r[c] for c in columns) for r in rows], "task_id string, strategy string, error string, tokens long, wall_ms double, " + ", ".join(f"{c} double" for c in MEASURES))
    return metrics.backfill_savings(results, "raw_files")
