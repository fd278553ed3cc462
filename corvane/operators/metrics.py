"""Retrieval-quality metrics, gates and benchmark tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Default gates.
GATES = {"recall": 0.60, "precision": 0.20, "f1": 0.30, "mrr": 0.55}
LATENCY_MS, MIN_SPEEDUP, TOLERANCE = 5000, 1.5, 0.05


def first_seen(ranked: DataFrame, task: str = "task_id", item: str = "file_path", rank: str = "rank") -> DataFrame:
    """Repeats after the first go and places close up."""
    first = ranked.groupBy(task, item).agg(F.min(rank).alias("__first"))
    return first.withColumn(rank, F.row_number().over(Window.partitionBy(task).orderBy("__first"))).drop("__first")


def per_task(ranked: DataFrame, expected: DataFrame, k: int = 10, task: str = "task_id", item: str = "file_path") -> DataFrame:
    """recall, precision, f1, mrr, ndcg (at k) and map of each task with results or expectations.

    ranked: task, item, rank (from 1; repeats are ignored); expected: task, item (distinct).
    """
    results = first_seen(ranked, task, item).join(expected.withColumn("hit", F.lit(1)), [task, item], "left")
    results = results.withColumn("hit", F.coalesce("hit", F.lit(0)))
    so_far = F.sum("hit").over(Window.partitionBy(task).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    results = results.withColumn("so_far", so_far)
    found = results.groupBy(task).agg(
        F.count("*").alias("n"),
        F.sum("hit").alias("hits"),
        F.min(F.when(F.col("hit") == 1, F.col("rank"))).alias("first"),
        F.sum(F.when((F.col("hit") == 1) & (F.col("rank") <= k), 1 / F.log2(F.col("rank") + 1.0)).otherwise(0.0)).alias("dcg"),
        F.sum(F.when(F.col("hit") == 1, F.col("so_far") / F.col("rank")).otherwise(0.0)).alias("gains"),
    )
    wanted = expected.groupBy(task).agg(F.count("*").alias("m"))
    both = found.join(wanted, task, "full").na.fill(0, ["n", "hits", "m"])
    ideal = F.aggregate(F.transform(F.sequence(F.lit(1), F.greatest(F.least(F.col("m"), F.lit(k)), F.lit(1)).cast("int")), lambda i: 1 / F.log2(i + 1.0)), F.lit(0.0), lambda a, x: a + x)
    ratio = lambda a, c: F.when(c > 0, a / c).otherwise(0.0)
    out = both.select(
        task, ratio(F.col("hits"), F.col("m")).alias("recall"), ratio(F.col("hits"), F.col("n")).alias("precision"),
        F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("mrr"), F.when(F.col("m") > 0, F.coalesce("dcg", F.lit(0.0)) / ideal).otherwise(0.0).alias("ndcg"),
        ratio(F.coalesce("gains", F.lit(0.0)), F.col("m")).alias("map"),
    )
    return out.withColumn("f1", f1(F.col("recall"), F.col("precision")))


def f1(recall: Column, precision: Column) -> Column:
    return F.when(recall + precision > 0, 2 * recall * precision / (recall + precision)).otherwise(0.0)


def savings(returned: Column, raw: Column) -> Column:
    return F.when(raw > 0, F.round((1 - returned / raw) * 100, 1)).otherwise(0.0)


def backfill_savings(results: DataFrame, raw_strategy: str) -> DataFrame:
    """savings of each result against the raw strategy's tokens on the same task."""
    raw = F.max(F.when(F.col("strategy") == raw_strategy, F.col("tokens"))).over(Window.partitionBy("task_id"))
    return results.withColumn("raw", F.coalesce(raw, F.lit(0))).withColumn("savings", savings(F.col("tokens"), F.col("raw"))).drop("raw")


def derived(results: DataFrame) -> DataFrame:
    """results (tokens_in, tokens_out, seeds, files) with efficiency, expanded and seed_share; 0 where nothing can be divided by."""
    ratio = lambda a, b: F.when(F.col(b) > 0, F.round(F.col(a) / F.col(b), 4)).otherwise(0.0)
    return results.withColumns({"efficiency": ratio("tokens_out", "tokens_in"), "expanded": F.greatest(F.col("files") - F.col("seeds"), F.lit(0)), "seed_share": ratio("seeds", "files")})


def delta_lines(runs: DataFrame) -> DataFrame:
    """task_id and line of a report about delta runs (task_id, delta_ms, full_ms, correct): whole milliseconds and the speedup."""
    ms = lambda c: F.floor(c).cast("string")
    speed = F.floor(F.col("full_ms") / F.greatest("delta_ms", F.lit(1.0)) * 10)
    text = F.concat(ms(F.col("delta_ms")), F.lit(" ms / "), ms(F.col("full_ms")), F.lit(" ms, x"), F.floor(speed / 10).cast("string"), F.lit("."), (speed % 10).cast("string"))
    return runs.select("task_id", F.concat(text, F.when(F.col("correct"), ", correct").otherwise(", differs")).alias("line"))


def long_form(results: DataFrame, metrics: list[str], value: str = "value") -> DataFrame:
    return results.unpivot([c for c in ("task_id", "strategy") if c in results.columns], metrics, "metric", value)


def wins(results: DataFrame, metrics: list[str]) -> DataFrame:
    """metric, strategy, wins: tasks on which a strategy is best; the first by name wins ties."""
    best = long_form(results, metrics).groupBy("task_id", "metric").agg(F.min_by("strategy", F.struct(-F.col("value"), "strategy")).alias("strategy"))
    return best.groupBy("metric", "strategy").agg(F.count("*").alias("wins"))


def against_baseline(now: DataFrame, base: DataFrame, metrics: list[str], tolerance: float = TOLERANCE) -> DataFrame:
    """strategy, task_id, metric, delta, regressed for what both have."""
    both = long_form(now, metrics, "now").join(long_form(base, metrics, "was"), ["task_id", "strategy", "metric"])
    return both.select("strategy", "task_id", "metric", F.round(F.col("now") - F.col("was"), 4).alias("delta"), (F.col("now") < F.col("was") - tolerance).alias("regressed"))


def gate(results: DataFrame, limits: dict[str, float] | None = None, exempt: list | None = None, overrides: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """task_id, strategy, metric, value, threshold of every metric below its threshold."""
    limits = limits or GATES
    rows = long_form(results.where(~F.col("task_id").isin(exempt)) if exempt else results, list(limits))
    threshold = F.lit(None).cast("double")
    for strategy, own in {None: limits, **(overrides or {})}.items():
        for metric, value in own.items():
            here = F.col("metric") == metric if strategy is None else (F.col("metric") == metric) & (F.col("strategy") == strategy)
            threshold = F.when(here, F.lit(float(value))).otherwise(threshold)
    return rows.withColumn("threshold", threshold).where("value < threshold")


def delta_gate(runs: DataFrame, least: float = MIN_SPEEDUP) -> DataFrame:
    """task_id, reason of runs that are wrong or not fast enough."""
    wrong = runs.where(~F.col("correct")).select("task_id", F.lit("incorrect").alias("reason"))
    return wrong.unionByName(runs.where(F.col("speedup") < least).select("task_id", F.lit("slow").alias("reason")))


def slow(results: DataFrame, limit: int = LATENCY_MS) -> DataFrame:
    return results.where(F.col("wall_ms") > limit)
