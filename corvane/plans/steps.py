"""Queries over the smaller steps: filters, defaults, schedules, maintenance of stored tables, and summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.operators import analytics, context, delta, graph, hierarchy, lookups, retrieval
from corvane.plans.architecture import SNAP_SQL, _snapshots
from corvane.plans.registry import query, read
from corvane.sources import bindings as b
from corvane.sources.bindings import CHUNKS_SQL, SYMBOLS_SQL, USER_EDGES_SQL

# filters and joins


@query("SELECT doc_id, lang FROM documents WHERE lang IN ('en', 'fr')")
def f12_language_filter(spark, sf_dir):
    return read(spark, sf_dir, "documents").where(F.col("lang").isin("en", "fr")).select("doc_id", "lang")


@query("SELECT doc_id, n_chars FROM documents WHERE n_chars <= 5000")
def f13_size_filter(spark, sf_dir):
    """Files over the limit are dropped, those at it stay."""
    return read(spark, sf_dir, "documents").where("n_chars <= 5000").select("doc_id", "n_chars")


@query(f"WITH {USER_EDGES_SQL} SELECT source, target FROM edges WHERE target IN (SELECT user_id FROM events WHERE user_id < 12)")
def j3_known_targets(spark, sf_dir):
    known = read(spark, sf_dir, "events").where("user_id < 12").select(F.col("user_id").alias("target"))
    return lookups.by_ids(b.user_edges(spark, sf_dir), known, "target").select("source", "target")


@query("""WITH bm AS (SELECT doc_id, max(quality)::DOUBLE AS bm25 FROM labels GROUP BY doc_id), nb AS (SELECT vec_id AS doc_id, max(label)::DOUBLE AS boost FROM embeddings GROUP BY vec_id)
SELECT doc_id, coalesce(nullif(bm25, 0), boost, 0) AS relevance FROM documents LEFT JOIN bm USING (doc_id) LEFT JOIN nb USING (doc_id)""")
def j12_relevance(spark, sf_dir):
    """A lexical score of zero counts as none."""
    bm = read(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").cast("double").alias("bm25"))
    nb = read(spark, sf_dir, "embeddings").groupBy(F.col("vec_id").alias("doc_id")).agg(F.max("label").cast("double").alias("boost"))
    rows = read(spark, sf_dir, "documents").select("doc_id").join(bm, "doc_id", "left").join(nb, "doc_id", "left")
    return rows.select("doc_id", context.relevance(F.col("bm25"), F.col("boost")).alias("relevance"))


QNAME_SQL = "source || CASE WHEN doc_id % 3 = 0 THEN '' WHEN doc_id % 3 = 1 THEN '::f' || doc_id ELSE '::C.m' || doc_id END"


@query(f"SELECT doc_id, regexp_extract({QNAME_SQL}, '^(.*)(::|\\.)[^.:]*$', 1) AS parent FROM documents")
def j22_parent_name(spark, sf_dir):
    d = F.col("doc_id").cast("string")
    tail = F.when(F.col("doc_id") % 3 == 0, "").when(F.col("doc_id") % 3 == 1, F.concat(F.lit("::f"), d)).otherwise(F.concat(F.lit("::C.m"), d))
    return read(spark, sf_dir, "documents").select("doc_id", hierarchy.parent_name(F.concat("source", tail)).alias("parent"))


# graphs


@query("SELECT l_suppkey % 50 AS source, l_partkey % 50 AS target, arg_max(l_linenumber, (l_orderkey, l_linenumber)) AS location FROM lineitem WHERE l_suppkey % 50 <> l_partkey % 50 GROUP BY ALL")
def g1_build(spark, sf_dir):
    imports = read(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 50).alias("source"), (F.col("l_partkey") % 50).alias("target"), F.col("l_linenumber").alias("location"), F.struct("l_orderkey", "l_linenumber").alias("place"))
    return graph.build(imports)


@query("SELECT c_custkey AS node, c_custkey NOT IN (SELECT o_custkey FROM orders) AS isolated FROM customer")
def g2_isolated(spark, sf_dir):
    """Nodes that edges alone would lose."""
    edges = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("source"), (-F.col("o_orderkey")).alias("target"))
    seen = graph.nodes_of(edges).withColumn("seen", F.lit(True))
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("node")).join(seen, "node", "left").select("node", F.col("seen").isNull().alias("isolated"))


# summaries


@query("SELECT lang AS language, count(*) AS files FROM documents GROUP BY lang")
def a8_language_counts(spark, sf_dir):
    return read(spark, sf_dir, "documents").groupBy(F.col("lang").alias("language")).agg(F.count("*").alias("files"))


@query(f"""WITH {SNAP_SQL}, c AS (SELECT CASE WHEN o.o_orderkey IS NULL THEN 'A' WHEN n.o_orderkey IS NULL THEN 'D' WHEN o.o_orderstatus IS DISTINCT FROM n.o_orderstatus THEN 'M' END AS s FROM old o FULL JOIN new n ON o.o_orderkey = n.o_orderkey),
m AS (SELECT count(*) FILTER (s = 'A') AS added, count(*) FILTER (s = 'M') AS modified, count(*) FILTER (s = 'D') AS deleted, 0::BIGINT AS renamed FROM c)
SELECT *, CAST(greatest(0, (SELECT count(*) FROM new) - (added + modified + deleted + renamed) + deleted) AS BIGINT) AS unchanged FROM m""")
def a23_delta_metrics(spark, sf_dir):
    old, new = _snapshots(spark, sf_dir)
    out = delta.summary(delta.snapshot_delta(old, new, "o_orderkey", "o_orderstatus"), new.count())
    return out.withColumn("unchanged", F.col("unchanged").cast("long"))


@query(f"WITH {CHUNKS_SQL} SELECT count(*) AS files, CAST(sum(end_line) AS BIGINT) AS lines, count(DISTINCT language) AS languages, CAST(sum(token_count) AS BIGINT) AS tokens FROM chunks")
def n12_profile(spark, sf_dir):
    return b.chunks(spark, sf_dir).agg(
        F.count("*").alias("files"), F.sum("end_line").cast("long").alias("lines"), F.count_distinct("language").alias("languages"), F.sum("token_count").cast("long").alias("tokens"),
    )


@query("SELECT l_orderkey, l_linenumber, round(CASE WHEN l_tax * 10 >= 0.5 THEN 0.5 + l_discount + 0.1 WHEN l_tax * 10 = 0 THEN 0.5 + l_discount - 0.15 ELSE 0.5 + l_discount END, 4) AS confidence FROM lineitem")
def n17_verified(spark, sf_dir):
    found = analytics.verified(F.lit(0.5) + F.col("l_discount"), F.col("l_tax") * 10)
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(found, 4).alias("confidence"))


@query(f"WITH {CHUNKS_SQL} SELECT source, CAST(coalesce(sum(token_count), 0) AS BIGINT) AS tokens FROM chunks WHERE id IN (SELECT doc_id FROM labels WHERE quality = 1) GROUP BY source")
def m8_file_tokens(spark, sf_dir):
    good = read(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("id"))
    return lookups.by_ids(b.chunks(spark, sf_dir), good).groupBy("source").agg(F.coalesce(F.sum("token_count"), F.lit(0)).cast("long").alias("tokens"))


@query(f"WITH {SYMBOLS_SQL}, e AS (SELECT DISTINCT parent, name FROM symbols), h AS (SELECT DISTINCT parent, name FROM symbols WHERE start_line < 2) SELECT e.parent, round(count(h.name) / count(*), 6) AS recall FROM e LEFT JOIN h ON e.parent = h.parent AND e.name = h.name GROUP BY e.parent")
def m7_symbol_recall(spark, sf_dir):
    s = b.symbols(spark, sf_dir)
    expected, hit = s.select("parent", "name").distinct(), s.where("start_line < 2").select("parent", "name", F.lit(1).alias("hit")).distinct()
    return expected.join(hit, ["parent", "name"], "left").groupBy("parent").agg(F.round(F.count("hit") / F.count("*"), 6).alias("recall"))


# order and schedules


@query("SELECT doc_id, CAST(CASE WHEN n_chars <= 100 THEN 30 WHEN n_chars <= 500 THEN 50 WHEN n_chars <= 2000 THEN 100 ELSE 150 END AS INTEGER) AS k FROM documents")
def t4_k_schedule(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", retrieval.k_schedule(F.col("n_chars")).alias("k"))


@query(r"""WITH w AS (SELECT item_id, unnest(string_split(text, ' ')) AS term, unnest(range(len(string_split(text, ' ')))) AS i FROM benchmark)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY length(term) DESC, i) - 1 AS INTEGER) AS pos, term FROM w""")
def t7_longest_first(spark, sf_dir):
    """Terms by length, longest first; those of one length keep their order."""
    return read(spark, sf_dir, "benchmark").select("item_id", F.posexplode(retrieval.longest_first(F.split("text", " "))).alias("pos", "term"))


@query("SELECT doc_id, round(n_chars / (SELECT max(n_chars) FROM documents), 6) AS score FROM documents WHERE round(n_chars / (SELECT max(n_chars) FROM documents), 6) >= 0.05")
def c4_eligible_seeds(spark, sf_dir):
    """Scores over the best one; what is below the floor does not expand."""
    hits = read(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").cast("double").alias("score"))
    return context.normalised(hits).select("doc_id", F.round("score", 6).alias("score")).where("score >= 0.05")


@query(f"WITH {CHUNKS_SQL} SELECT id, file_path, CAST(1 AS DOUBLE) AS score FROM chunks")
def c15_passthrough(spark, sf_dir):
    return b.chunks(spark, sf_dir).select("id", "file_path", F.lit(1.0).alias("score"))


@query("SELECT doc_id FROM labels WHERE quality = 1 UNION SELECT doc_id FROM documents WHERE n_chars > 6000")
def u1_union_seeds(spark, sf_dir):
    good = read(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return good.unionByName(read(spark, sf_dir, "documents").where("n_chars > 6000").select("doc_id")).distinct()


# maintenance

FRESH_SQL = "fresh AS (SELECT doc_id + 1000000 AS id, source AS file_path FROM documents WHERE source IN ('src1', 'src2') AND doc_id % 2 = 0)"


def _stored(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("file_path"))
    return rows, rows.where("file_path IN ('src1', 'src2') AND id % 2 = 0").select((F.col("id") + 1000000).alias("id"), "file_path")


@query(f"WITH {FRESH_SQL} SELECT doc_id AS id, source AS file_path FROM documents UNION ALL SELECT id, file_path FROM fresh")
def k3_append(spark, sf_dir):
    rows, fresh = _stored(spark, sf_dir)
    return rows.unionByName(fresh)


@query("SELECT doc_id AS id, source AS file_path FROM documents WHERE source IS NULL OR source NOT IN ('src1', 'src2')")
def k4_delete_files(spark, sf_dir):
    rows, fresh = _stored(spark, sf_dir)
    return lookups.replace_files(rows, fresh.limit(0), spark.createDataFrame([("src1",), ("src2",)], "file_path string"))


@query(f"WITH {FRESH_SQL} SELECT doc_id AS id, source AS file_path FROM documents WHERE source IS NULL OR source NOT IN (SELECT file_path FROM fresh) UNION ALL SELECT id, file_path FROM fresh")
def k7_replace_files(spark, sf_dir):
    rows, fresh = _stored(spark, sf_dir)
    return lookups.replace_files(rows, fresh)


CHANGES_SQL = "ch AS (SELECT 'f' || doc_id AS path, ['M', 'A', 'D', 'R'][doc_id % 4 + 1] AS status, CASE WHEN doc_id % 4 = 3 THEN 'old' || doc_id END AS old_path FROM documents)"


@query(f"""WITH {CHANGES_SQL} SELECT CASE status WHEN 'M' THEN 'modified' WHEN 'A' THEN 'added' WHEN 'D' THEN 'deleted' ELSE 'renamed' END AS view, path FROM ch
UNION ALL SELECT 'affected', path FROM ch UNION ALL SELECT 'affected', old_path FROM ch WHERE old_path IS NOT NULL""")
def d4_manifest_views(spark, sf_dir):
    d, rest = F.col("doc_id").cast("string"), F.col("doc_id") % 4
    line = F.when(rest == 3, F.concat_ws("\t", F.lit("R100"), F.concat(F.lit("old"), d), F.concat(F.lit("f"), d)))
    line = line.otherwise(F.concat_ws("\t", F.when(rest == 0, "M").when(rest == 1, "A").otherwise("D"), F.concat(F.lit("f"), d)))
    return delta.views(delta.parse_name_status(read(spark, sf_dir, "documents").select(line.alias("value"))))


@query("SELECT source, count(*) FILTER (doc_id % 3 = 0 OR lang = 'en') / count(*) < 0.5 AS use_delta FROM documents GROUP BY source")
def d5_threshold(spark, sf_dir):
    changed = F.count(F.when((F.col("doc_id") % 3 == 0) | (F.col("lang") == "en"), 1))
    return read(spark, sf_dir, "documents").groupBy("source").agg((changed / F.count("*") < delta.THRESHOLD).alias("use_delta"))
