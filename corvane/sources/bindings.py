"""The driver's tables seen as the engine's concepts, each beside the same view in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.functions.text import estimated_tokens


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as chunks: id, content, language, file_path, start_line, end_line, token_count."""
    path = F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string"))
    return read(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), F.col("text").alias("content"), F.col("lang").alias("language"), path.alias("file_path"), "source",
        F.lit(1).alias("start_line"), (F.size(F.split("text", "\n"))).alias("end_line"), estimated_tokens(F.col("text")).alias("token_count"),
    )


WORDS_SQL = r"len(list_filter(regexp_split_to_array(trim(text), '\s+'), lambda w: w <> ''))"
CHUNKS_SQL = rf"""chunks AS (
    SELECT doc_id AS id, text AS content, lang AS language, source || '/' || lang || '/' || doc_id AS file_path, source, 1 AS start_line,
           CAST(len(string_split(text, chr(10))) AS INTEGER) AS end_line, CAST(floor({WORDS_SQL} * 13 / 10) AS BIGINT) AS token_count FROM documents)"""


def user_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense graph: who acted right after whom on the same day and type of event; distinct, no loops."""
    near = Window.partitionBy("event_type", F.to_date("ts")).orderBy("ts", "event_id")
    rows = read(spark, sf_dir, "events").select(F.lag("user_id").over(near).alias("source"), F.col("user_id").alias("target"))
    return rows.where("source IS NOT NULL AND source <> target").distinct()


USER_EDGES_SQL = """edges AS (
    SELECT DISTINCT source, target FROM (
        SELECT lag(user_id) OVER (PARTITION BY event_type, CAST(ts AS DATE) ORDER BY ts, event_id) AS source, user_id AS target FROM events)
    WHERE source IS NOT NULL AND source <> target)"""


def page_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sparse graph with dangling nodes: host of a page to the targets of its links."""
    host = F.regexp_extract("url", "://([^/]+)", 1)
    links = F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1))
    return read(spark, sf_dir, "pages").select(host.alias("source"), links.alias("target")).where("source <> target").distinct()


PAGE_EDGES_SQL = """edges AS (
    SELECT DISTINCT source, target FROM (
        SELECT regexp_extract(url, '://([^/]+)', 1) AS source, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS target FROM pages)
    WHERE source <> target)"""


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as classes and methods: the class is the conversation, its turns are methods named by role and turn."""
    rows = read(spark, sf_dir, "conversations")
    return rows.select(
        F.format_string("conv/%d.py", F.floor(F.col("conv_id") / 10)).alias("file_path"), F.format_string("C%d", "conv_id").alias("parent"),
        F.concat(F.col("role"), F.lit("_"), F.col("turn").cast("string")).alias("name"), F.lit("method").alias("kind"),
        F.when(F.col("role") == "system", "private").otherwise("public").alias("visibility"), F.col("turn").cast("int").alias("start_line"), F.col("text").alias("signature"),
    )


SYMBOLS_SQL = """symbols AS (
    SELECT 'conv/' || CAST(floor(conv_id / 10) AS BIGINT) || '.py' AS file_path, 'C' || conv_id AS parent, role || '_' || turn AS name, 'method' AS kind,
           CASE WHEN role = 'system' THEN 'private' ELSE 'public' END AS visibility, CAST(turn AS INTEGER) AS start_line, text AS signature FROM conversations)"""


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as results of strategies (return flag) on tasks (supplier modulo 25): recall, precision, tokens."""
    rows = read(spark, sf_dir, "lineitem")
    return rows.groupBy(F.col("l_returnflag").alias("strategy"), (F.col("l_suppkey") % 25).alias("task_id")).agg(
        F.round(F.avg("l_discount") * 10, 4).alias("recall"), F.round(F.avg("l_tax") * 10, 4).alias("precision"), F.sum("l_quantity").cast("long").alias("tokens"),
    )


RESULTS_SQL = """results AS (
    SELECT l_returnflag AS strategy, l_suppkey % 25 AS task_id, round(avg(l_discount) * 10, 4) AS recall, round(avg(l_tax) * 10, 4) AS precision,
           CAST(sum(l_quantity) AS BIGINT) AS tokens FROM lineitem GROUP BY 1, 2)"""


def ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranked files per task: documents of a source (the task) by size, and whether each is expected (labelled good)."""
    docs, good = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels").where("quality = 1").select("doc_id", F.lit(True).alias("good"))
    order = Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id")
    rows = docs.select("source", "doc_id", "n_chars").withColumn("rank", F.row_number().over(order)).join(good, "doc_id", "left")
    return rows.select(F.col("source").alias("task_id"), "doc_id", "rank", F.coalesce("good", F.lit(False)).alias("expected"))


RANKED_SQL = """ranked AS (
    SELECT source AS task_id, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank, coalesce(l.quality = 1, false) AS expected
    FROM documents LEFT JOIN labels l USING (doc_id))"""
