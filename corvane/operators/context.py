"""Context assembly: seeds, expansion, scoring, file cut and packing under a token budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Tuned constants.
IMPORT_DECAY, IMPORTER_DECAY, PATH_MATCH = 0.65, 0.20, 1.3
PRIORITY = {"import": 1.0, "import_match": 1.5, "importer": 0.5, "importer_match": 0.75}
MIN_EXPANSION, SCORE_FLOOR, FILE_CUT = 0.05, 0.30, 0.15
MAX_EXPANSION, MAX_FILES, PER_FILE, TEST_PENALTY, TYPE_COVERAGE = 5, 8, 3, 0.6, 0.5
WEIGHTS = {"relevance": 0.80, "structural": 0.08, "type_coverage": 0.04, "cohesion": 0.08}


def first_per_file(rows: DataFrame, file: str, order: list[Column], n: int = PER_FILE) -> DataFrame:
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(file).orderBy(*order))).where(F.col("__n") <= n).drop("__n")


def priorities(edges: DataFrame, seeds: DataFrame, matched: Column | None = None) -> DataFrame:
    """file, priority: best of the ways in which a seed (file, score) reaches a file that is no seed.

    matched: whether the reached path holds a query term (column ``file``).
    """
    strong = seeds.where(F.col("score") >= MIN_EXPANSION).select(F.col("file").alias("seed"))
    matched = F.lit(False) if matched is None else matched
    out = edges.join(strong, edges["source"] == strong["seed"], "left_semi").select(F.col("target").alias("file"), F.lit(True).alias("imported"))
    back = edges.join(strong, edges["target"] == strong["seed"], "left_semi").select(F.col("source").alias("file"), F.lit(False).alias("imported"))
    p = F.when(F.col("imported"), F.when(matched, PRIORITY["import_match"]).otherwise(PRIORITY["import"])).otherwise(F.when(matched, PRIORITY["importer_match"]).otherwise(PRIORITY["importer"]))
    rows = out.unionByName(back).select("file", p.alias("priority")).groupBy("file").agg(F.max("priority").alias("priority"))
    return rows.join(seeds.select("file"), "file", "left_anti")


def neighbour_boost(edges: DataFrame, seeds: DataFrame, matched: Column | None = None) -> DataFrame:
    """file, boost: best decayed score of a seed that imports the file, or that the file imports."""
    s = seeds.select(F.col("file").alias("seed"), "score")
    factor = F.lit(1.0) if matched is None else F.when(matched, PATH_MATCH).otherwise(1.0)
    out = edges.join(s, edges["source"] == s["seed"]).select(F.col("target").alias("file"), (F.col("score") * IMPORT_DECAY).alias("x"), F.lit(True).alias("imported"))
    back = edges.join(s, edges["target"] == s["seed"]).select(F.col("source").alias("file"), (F.col("score") * IMPORTER_DECAY).alias("x"), F.lit(False).alias("imported"))
    x = F.when(F.col("imported"), F.col("x") * factor).otherwise(F.col("x"))
    return out.unionByName(back).withColumn("x", x).groupBy("file").agg(F.max("x").alias("boost"))


def final_score(relevance: Column, structural: Column, types: Column, cohesion: Column, is_test: Column) -> Column:
    parts = {"relevance": relevance, "structural": structural, "type_coverage": types, "cohesion": cohesion}
    return sum((w * parts[k] for k, w in WEIGHTS.items()), F.lit(0.0)) * F.when(is_test, TEST_PENALTY).otherwise(1.0)


def file_cut(scored: DataFrame, file: str = "file_path", score: str = "score") -> DataFrame:
    """file, total of the files that stay: the best few, none below a share of the best.

    How many: four where the best is over five times the median, five where over three times, else eight; all of fewer than three.
    """
    totals = scored.groupBy(file).agg(F.round(F.sum(score), 6).alias("total"))
    order, every = Window.orderBy(F.desc("total"), file), Window.partitionBy()  # a row per candidate file
    placed = totals.select("*", F.row_number().over(order).alias("place"), F.count("*").over(every).alias("n"), F.max("total").over(every).alias("top"))
    placed = placed.withColumn("median", F.max(F.when(F.col("place") == F.floor(F.col("n") / 2) + 1, F.col("total"))).over(every))
    ratio = F.when(F.col("median") > 0, F.col("top") / F.col("median"))
    most = F.when(F.col("n") < 3, F.col("n")).when(ratio > 5, 4).when(ratio > 3, 5).otherwise(MAX_FILES)
    return placed.where((F.col("place") <= most) & (F.col("total") >= FILE_CUT * F.col("top"))).select(file, "total")


def pack(scored: DataFrame, budget: int, floor: float = SCORE_FLOOR, key: str = "id") -> DataFrame:
    """id, score, token_count of the chunks taken: best first, those that would overflow are skipped, the end is a share of the best score.

    The candidates of one question are few (files x chunks a file); they are folded in one row.
    """
    item = F.struct((-F.col("score")).alias("neg"), F.col(key).alias("id"), F.col("token_count").cast("long").alias("tokens"))
    one = scored.agg(F.array_sort(F.collect_list(item)).alias("items")).withColumn("top", -F.get("items", F.lit(0))["neg"])
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast(f"array<struct<neg:double,id:{dict(scored.dtypes)[key]},tokens:bigint>>").alias("kept"))

    def step(acc: Column, x: Column) -> Column:
        fits = (-x["neg"] >= floor * F.col("top")) & (acc["used"] + x["tokens"] <= budget)
        return F.struct(F.when(fits, acc["used"] + x["tokens"]).otherwise(acc["used"]).alias("used"), F.when(fits, F.concat(acc["kept"], F.array(x))).otherwise(acc["kept"]).alias("kept"))

    kept = one.where(F.size("items") > 0).select(F.explode(F.aggregate("items", start, step, lambda a: a["kept"])).alias("x"))
    return kept.select(F.col("x.id").alias(key), (-F.col("x.neg")).alias("score"), F.col("x.tokens").alias("token_count"))


def second_hop(edges: DataFrame, seeds: DataFrame, architecture: bool, room: int) -> DataFrame:
    """node: for a question about architecture, files two imports away, as many as there is room for; else none."""
    from corvane.operators import graph

    found = graph.two_hop(edges, seeds)
    return found.orderBy("node").limit(room) if architecture and room > 0 else found.limit(0)


def structure(edges: DataFrame, symbols: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The import graph among the files (node) of an answer, and the types they define."""
    from corvane.operators import graph, lookups

    types = lookups.type_like(symbols.join(files.select(F.col("node").alias("file_path")), "file_path", "left_semi"))
    return graph.subgraph(edges, files), types


def metadata(candidates: DataFrame, included: DataFrame, expanded: int, budget: int, question: str) -> DataFrame:
    """One row: how many chunks and files were looked at and taken, the tokens taken, the budget and the weights."""
    looked = candidates.agg(F.count("*").alias("candidates"), F.count_distinct("file_path").alias("candidate_files"))
    taken = included.agg(F.count("*").alias("included"), F.count_distinct("file_path").alias("included_files"), F.coalesce(F.sum("token_count"), F.lit(0)).cast("long").alias("tokens"))
    weights = F.create_map(*[F.lit(x) for kv in WEIGHTS.items() for x in kv])
    return looked.join(taken).select("*", F.lit(expanded).alias("expanded_files"), F.lit(budget).alias("budget"), F.lit(question).alias("question"), weights.alias("weights"))


def effective_budget(total: Column, budget: int) -> Column:
    """All tokens if they fit, the budget from three times of it on, a straight line between."""
    b = F.lit(budget)
    return F.when(total <= b, total).when(total >= 3 * b, b).otherwise(F.floor(total - (total - b) * ((total - b) / (2 * b)))).cast("long")


def relevance(lexical: Column, boost: Column) -> Column:
    """The lexical score, else the neighbour's boost, else zero; a lexical score of zero counts as none."""
    return F.coalesce(F.nullif(lexical, F.lit(0.0)), boost, F.lit(0.0))


def normalised(hits: DataFrame, score: str = "score") -> DataFrame:
    """hits with the score over the best one (unchanged where that is not positive); the best is one broadcast row."""
    best = hits.agg(F.max(score).alias("__best"))
    return hits.join(F.broadcast(best)).withColumn(score, F.when(F.col("__best") > 0, F.col(score) / F.col("__best")).otherwise(F.col(score))).drop("__best")
