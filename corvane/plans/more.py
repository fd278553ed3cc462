"""Queries over counts, orders, surrogates, structure, decisions and reports."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from corvane.functions import text
from corvane.operators import analytics, context, delta, hierarchy, lookups, metrics, retrieval, vectors
from corvane.plans.architecture import PATTERNS_SQL, _code
from corvane.plans.index import Index, build
from corvane.plans.registry import SQL, query, read
from corvane.plans.retrieval import CLEAN_SQL, DENSE_SQL, _query_vector
from corvane.sources import bindings as b
from corvane.sources.bindings import CHUNKS_SQL, SYMBOLS_SQL, USER_EDGES_SQL
from corvane.sources.store import Cache, shared_folder

# counts


@query("SELECT count(*) AS n FROM documents")
def a5_chunk_count(spark, sf_dir):
    return b.chunks(spark, sf_dir).agg(F.count("*").alias("n"))


@query("SELECT count(*) > 0 AS has_data FROM documents")
def b17_has_data(spark, sf_dir):
    return retrieval.has_data(b.chunks(spark, sf_dir))


def _cached(spark, sf_dir) -> Cache:
    """A cache with two states of the documents and one of the labels, the second state the latest."""
    cache = Cache(spark, f"{shared_folder(spark)}/cache-{uuid.uuid4().hex}")
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    cache.put("documents", "first", {"files": docs.where("lang IS NOT NULL")})
    cache.put("labels", "first", {"labels": read(spark, sf_dir, "labels")})
    cache.put("documents", "second", {"files": docs, "sources": docs.select("source").distinct()})
    return cache


@query("SELECT CAST(3 AS BIGINT) AS entries, CAST((SELECT count(*) + count(lang) + (count(DISTINCT source) + max(CASE WHEN source IS NULL THEN 1 ELSE 0 END)) FROM documents) + (SELECT count(*) FROM labels) AS BIGINT) AS rows")
def a21_cache_info(spark, sf_dir):
    return spark.createDataFrame([tuple(_cached(spark, sf_dir).info().values())], "entries long, rows long")


@query("SELECT place, key FROM (VALUES (CAST(0 AS BIGINT), sha256('documents@second')), (1, sha256('documents@first'))) AS t(place, key)")
def j20_identity(spark, sf_dir):
    """The stored states of a source, the latest first."""
    return spark.createDataFrame(list(enumerate(_cached(spark, sf_dir).find("documents"))), "place long, key string")


# words


@query(f"SELECT item_id, array_to_string({CLEAN_SQL}, ' AND ') AS asked FROM benchmark")
def b5_and_join(spark, sf_dir):
    return read(spark, sf_dir, "benchmark").select("item_id", retrieval.and_join(text.search_terms(F.col("text"))).alias("asked"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'import m' || o_orderstatus || CASE WHEN o_orderkey % 2 = 0 THEN ' as x' ELSE '' END
ELSE 'from m' || o_orderstatus || ' import a' || CASE WHEN o_orderkey % 3 = 2 THEN ', b as y' ELSE '' END END AS line FROM orders""")
def p7_import_line(spark, sf_dir):
    k = F.col("o_orderkey")
    name = lambda n, alias: F.struct(F.lit(n).alias("name"), F.lit(alias).cast("string").alias("alias"))
    names = F.when(k % 3 == 0, F.array().cast("array<struct<name:string,alias:string>>")).when(k % 3 == 1, F.array(name("a", None))).otherwise(F.array(name("a", None), name("b", "y")))
    return read(spark, sf_dir, "orders").select(k, text.import_line(F.concat(F.lit("m"), "o_orderstatus"), names, F.when(k % 2 == 0, "x")).alias("line"))


# parsing: parts as Python modules of up to 50 classes, each importing from the next module

MODULES_SQL = "x AS (SELECT p_partkey AS k, p_partkey // 50 AS f, row_number() OVER (PARTITION BY p_partkey // 50 ORDER BY p_partkey) AS i FROM part), m AS (SELECT DISTINCT f FROM x)"


def _indexed(spark, sf_dir) -> Index:
    k = F.col("p_partkey").cast("string")
    body = F.concat(F.lit("class C"), k, F.lit(":\n    def m(self):\n        return "), F.col("p_size").cast("string"))
    rows = read(spark, sf_dir, "part").select(F.expr("p_partkey DIV 50").alias("f"), "p_partkey", body.alias("body"))
    texts = rows.groupBy("f").agg(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "body"))), lambda x: x["body"]).alias("bodies"))
    head = F.concat(F.lit("from m"), (F.col("f") + 1).cast("string"), F.lit(" import C1\n"))
    return build(texts.select(F.concat(F.lit("m"), F.col("f").cast("string"), F.lit(".py")).alias("path"), F.lit("python").alias("language"), F.concat(head, F.array_join("bodies", "\n"), F.lit("\n")).alias("content")))


@query(f"""WITH {MODULES_SQL} SELECT 'm' || f || '.py' AS file_path, 'C' || k AS qualified_name, 'class' AS kind, CAST(3 * i - 1 AS INTEGER) AS start_line, CAST(3 * i + 1 AS INTEGER) AS end_line FROM x
UNION ALL SELECT 'm' || f || '.py', 'C' || k || '.m', 'method', CAST(3 * i AS INTEGER), CAST(3 * i + 1 AS INTEGER) FROM x""")
def p2_symbols(spark, sf_dir):
    return _indexed(spark, sf_dir).symbols.select("file_path", "qualified_name", "kind", "start_line", "end_line")


@query(f"WITH {MODULES_SQL} SELECT 'm' || f || '.py' AS file_path, 'm' || (f + 1) AS module, 'C1' AS names, CAST(1 AS INTEGER) AS line FROM m")
def p3_imports(spark, sf_dir):
    return _indexed(spark, sf_dir).imports.select("file_path", "module", F.array_join("names", ",").alias("names"), "line")


@query(f"WITH {MODULES_SQL} SELECT 'm' || f || '.py' AS source, 'm' || (f + 1) || '.py' AS target, 'm' || f || '.py:1' AS location FROM m WHERE f + 1 IN (SELECT f FROM m)")
def p4_import_edges(spark, sf_dir):
    return _indexed(spark, sf_dir).edges.select("source", "target", "location")


@query(f"""WITH {MODULES_SQL}, c AS (SELECT f, 'C' || k AS symbol_name, 3 * i - 1 AS start_line, 3 * i + 1 AS end_line, starts_with(CAST(k AS VARCHAR), '1') AS used, 6 AS words FROM x
UNION ALL SELECT f, 'm', 3 * i, 3 * i + 1, false, 4 FROM x UNION ALL SELECT f, '_module', 1, 1, true, 4 FROM m)
SELECT 'm' || f || '.py:' || symbol_name || ':' || start_line AS id, CAST(end_line AS INTEGER) AS end_line, CASE WHEN used THEN 'from m' || (f + 1) || ' import C1' ELSE '' END AS imports_context, CAST((words + CASE WHEN used THEN 4 ELSE 0 END) * 13 // 10 AS BIGINT) AS token_count FROM c""")
def p5_chunks(spark, sf_dir):
    return _indexed(spark, sf_dir).chunks.select("id", F.col("end_line").cast("int").alias("end_line"), "imports_context", "token_count")


# orders


@query("""WITH p AS (SELECT DISTINCT string_split(regexp_replace(url, '^https?://', ''), '/') AS x FROM pages), t AS (SELECT DISTINCT x[1] AS path, len(x) > 1 AS is_dir FROM p)
SELECT CAST(row_number() OVER (ORDER BY is_dir DESC, path) AS INTEGER) AS place, path, is_dir FROM t""")
def t5_tree_order(spark, sf_dir):
    return hierarchy.root_order(hierarchy.file_tree(read(spark, sf_dir, "pages").select(F.regexp_replace("url", "^https?://", "").alias("path")), 1))


@query(f"WITH {SYMBOLS_SQL} SELECT file_path, parent || '.' || name AS id, start_line, CAST(row_number() OVER (PARTITION BY file_path ORDER BY start_line, parent || '.' || name) AS INTEGER) AS place FROM symbols")
def t6_chunk_order(spark, sf_dir):
    rows = b.symbols(spark, sf_dir).select("file_path", F.concat_ws(".", "parent", "name").alias("id"), "start_line")
    return lookups.chunk_order(rows)


# surrogates and vectors


@query(f"SELECT id, surrogate FROM ({SQL['v8_surrogate']}) JOIN (SELECT doc_id AS id, source FROM documents WHERE source IN ('src1', 'src3')) USING (id)")
def s11_surrogates_of_files(spark, sf_dir):
    rows = b.chunks(spark, sf_dir)
    stored = rows.select("id", F.col("source").alias("file_path"), vectors.surrogate(rows).alias("surrogate"))
    return lookups.surrogate_scan(stored, files=["src1", "src3"]).select("id", "surrogate")


@query("SELECT doc_id AS id, CASE WHEN doc_id % 2 = 0 THEN 'v2' ELSE 'v1' END AS version, CASE WHEN doc_id % 2 = 0 THEN n_chars + 1 ELSE n_chars END AS size FROM documents")
def k2_upsert_surrogates(spark, sf_dir):
    old = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.lit("v1").alias("version"), F.col("n_chars").alias("size"))
    fresh = old.where("id % 2 = 0").select("id", F.lit("v2").alias("version"), (F.col("size") + 1).alias("size"))
    return lookups.upsert(old, fresh, "id")


@query(f"WITH {DENSE_SQL}, {CHUNKS_SQL}, top AS (SELECT * FROM dense ORDER BY score DESC, id LIMIT 40) SELECT id, file_path, round(score, 5) AS score FROM top JOIN chunks USING (id) WHERE score > 0")
def j5_vector_chunks(spark, sf_dir):
    hits = vectors.top_k(read(spark, sf_dir, "embeddings"), _query_vector(spark, sf_dir), 40)
    return vectors.hits_to_chunks(hits, b.chunks(spark, sf_dir)).select("id", "file_path", F.round("score", 5).alias("score"))


# context

QUESTION = "How does the routing pipeline resolve a session?"


@query(f"""WITH {USER_EDGES_SQL}, seed AS (SELECT unnest([3]) AS node), one AS (SELECT DISTINCT node FROM (SELECT target AS node FROM edges WHERE source IN (SELECT node FROM seed) UNION ALL SELECT source FROM edges WHERE target IN (SELECT node FROM seed)) WHERE node NOT IN (SELECT node FROM seed))
SELECT DISTINCT target AS node FROM edges WHERE source IN (SELECT node FROM one) AND target NOT IN (SELECT node FROM seed) AND target NOT IN (SELECT node FROM one) ORDER BY node LIMIT 5""")
def c7_second_hop(spark, sf_dir):
    architecture = spark.range(1).select(text.is_architecture_question(F.lit(QUESTION))).first()[0]
    return context.second_hop(b.user_edges(spark, sf_dir), spark.createDataFrame([(3,)], "node long"), architecture, context.MAX_EXPANSION)


@query(f"""WITH {USER_EDGES_SQL}, kept AS (SELECT DISTINCT user_id AS node FROM events WHERE user_id < 12)
SELECT CAST(source AS VARCHAR) AS name, 'imports ' || array_to_string(list_sort(list(target)), ',') AS entry FROM edges WHERE source IN (SELECT node FROM kept) AND target IN (SELECT node FROM kept) GROUP BY source
UNION ALL SELECT 'C' || p_partkey, 'class' FROM part WHERE p_size < 12 AND p_partkey % 3 = 0""")
def c13_structure(spark, sf_dir):
    """The import graph among the files of an answer, and the types in them."""
    files = read(spark, sf_dir, "events").where("user_id < 12").select(F.col("user_id").alias("node")).distinct()
    kind = F.when(F.col("p_partkey") % 3 == 0, "class").otherwise("function")
    symbols = read(spark, sf_dir, "part").select(F.col("p_size").cast("long").alias("file_path"), F.concat(F.lit("C"), F.col("p_partkey").cast("string")).alias("name"), kind.alias("kind"))
    inside = spark.range(12).withColumnRenamed("id", "node")
    imports, _ = context.structure(b.user_edges(spark, sf_dir), symbols, files)
    _, types = context.structure(b.user_edges(spark, sf_dir), symbols, inside)
    lines = imports.select(F.col("source").cast("string").alias("name"), F.concat(F.lit("imports "), F.array_join("targets", ",")).alias("entry"))
    return lines.unionByName(types.select("name", F.col("kind").alias("entry")))


@query(f"""WITH {CHUNKS_SQL}, i AS (SELECT * FROM chunks WHERE id IN (SELECT doc_id FROM labels WHERE quality = 1))
SELECT (SELECT count(*) FROM chunks) AS candidates, (SELECT count(DISTINCT file_path) FROM chunks) AS candidate_files, count(*) AS included, count(DISTINCT file_path) AS included_files, CAST(coalesce(sum(token_count), 0) AS BIGINT) AS tokens, 5 AS expanded_files, 8192 AS budget, 0.8::DOUBLE AS relevance FROM i""")
def c14_metadata(spark, sf_dir):
    chunks = b.chunks(spark, sf_dir)
    good = read(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("id"))
    rows = context.metadata(chunks, lookups.by_ids(chunks, good), 5, 8192, QUESTION)
    return rows.select("candidates", "candidate_files", "included", "included_files", "tokens", "expanded_files", "budget", F.col("weights")["relevance"].alias("relevance"))


# maintenance


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'full' WHEN o_orderkey % 5 = o_orderkey % 7 THEN 'hit' WHEN o_orderstatus = 'F' AND o_custkey % 10 < 5 THEN 'delta' ELSE 'full' END AS way FROM orders""")
def d6_acquisition(spark, sf_dir):
    k = F.col("o_orderkey")
    stored = F.when(k % 5 != 0, (k % 5).cast("string"))
    way = delta.acquisition(stored, (k % 7).cast("string"), F.col("o_orderstatus") == "F", F.col("o_custkey") % 10, F.lit(10))
    return read(spark, sf_dir, "orders").select(k, way.alias("way"))


# analytics


@query(f"""SELECT pattern, confidence, CASE pattern {" ".join(f"WHEN '{k}' THEN '{', '.join(v)}'" for k, v in analytics.ALTERNATIVES.items() if k != "repository")} ELSE 'Custom implementation' END AS alternatives FROM ({PATTERNS_SQL}) WHERE confidence >= 0.5""")
def n11_decisions(spark, sf_dir):
    """Patterns of enough confidence with their alternatives; one is left out to meet the default."""
    known = analytics.known_alternatives(spark).where("pattern <> 'repository'")
    rows = analytics.decisions(analytics.patterns(_code(spark, sf_dir)), known)
    return rows.select("pattern", "confidence", F.array_join("alternatives", ", ").alias("alternatives"))


@query("SELECT DISTINCT CASE WHEN p_size % 2 = 0 THEN 'testing' ELSE p_brand END AS dimension FROM part WHERE p_size % 2 <> 0")
def u5_unsupported(spark, sf_dir):
    return analytics.unsupported(read(spark, sf_dir, "part").select(F.when(F.col("p_size") % 2 == 0, "testing").otherwise(F.col("p_brand")).alias("dimension")))


# reports


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_extendedprice > 0 THEN round(l_quantity * 100 / l_extendedprice, 4) ELSE 0 END::DOUBLE AS efficiency, CAST(greatest(7 - l_linenumber, 0) AS INTEGER) AS expanded, round(l_linenumber / 7, 4)::DOUBLE AS seed_share FROM lineitem""")
def m9_derived(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("tokens_in"), (F.col("l_quantity") * 100).alias("tokens_out"), F.col("l_linenumber").cast("int").alias("seeds"), F.lit(7).alias("files"))
    return metrics.derived(rows).select("l_orderkey", "l_linenumber", "efficiency", F.col("expanded").cast("int").alias("expanded"), "seed_share")


@query("""WITH r AS (SELECT o_orderkey AS task_id, (o_custkey % 50 + 1)::DOUBLE AS d, (o_orderkey % 1000)::DOUBLE AS f, o_orderstatus <> 'P' AS correct FROM orders), s AS (SELECT *, CAST(floor(f / greatest(d, 1) * 10) AS BIGINT) AS x FROM r)
SELECT task_id, CAST(d AS BIGINT) || ' ms / ' || CAST(f AS BIGINT) || ' ms, x' || (x // 10) || '.' || (x % 10) || CASE WHEN correct THEN ', correct' ELSE ', differs' END AS line FROM s""")
def a17_delta_lines(spark, sf_dir):
    runs = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("task_id"), (F.col("o_custkey") % 50 + 1).cast("double").alias("delta_ms"), (F.col("o_orderkey") % 1000).cast("double").alias("full_ms"), (F.col("o_orderstatus") != "P").alias("correct"))
    return metrics.delta_lines(runs)
