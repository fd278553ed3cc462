"""Queries over lookups, joins, aggregates and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.functions import text
from corvane.operators import lookups
from corvane.plans.registry import query, read
from corvane.sources import bindings as b
from corvane.sources.bindings import CHUNKS_SQL, RESULTS_SQL

LANG_SQL = "CASE lower(regexp_extract(p, '\\.[^./]+$')) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in lookups.LANGUAGES.items()) + " END"
EXTS = ["py", "TS", "rs", "md", "kt", "java"]
FOLDERS = ["src", "node_modules", "build", "tests"]


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invented file paths from documents: every extension and folder occurs."""
    pick = lambda names, by: F.element_at(F.array(*map(F.lit, names)), (by % len(names) + 1).cast("int"))
    d = F.col("doc_id")
    return read(spark, sf_dir, "documents").select("doc_id", F.concat(F.col("source"), F.lit("/"), pick(FOLDERS, F.floor(d / 7)), F.lit("/f"), d.cast("string"), F.lit("."), pick(EXTS, d)).alias("p"))


PATHS_SQL = f"""paths AS (SELECT doc_id, source || '/' || ({FOLDERS})[CAST(floor(doc_id / 7) AS BIGINT) % 4 + 1] || '/f' || doc_id || '.' || ({EXTS})[doc_id % 6 + 1] AS p FROM documents)"""


@query(f"WITH {PATHS_SQL} SELECT doc_id, p AS path, {LANG_SQL} AS language FROM paths")
def s2_ext_language(spark, sf_dir):
    return _paths(spark, sf_dir).select("doc_id", F.col("p").alias("path"), lookups.language_of(F.col("p")).alias("language"))


IGNORED_SQL = "list_has_any(string_split(p, '/'), [" + ", ".join(f"'{x.rstrip('/')}'" for x in lookups.IGNORES) + "])"


@query(f"WITH {PATHS_SQL} SELECT doc_id, p AS path FROM paths WHERE NOT {IGNORED_SQL}")
def s3_ignore_segments(spark, sf_dir):
    return _paths(spark, sf_dir).where(~lookups.ignored(F.col("p"))).select("doc_id", F.col("p").alias("path"))


@query(f"WITH {CHUNKS_SQL} SELECT id, file_path, token_count FROM chunks WHERE id = 17")
def f1_chunk_by_id(spark, sf_dir):
    return b.chunks(spark, sf_dir).where("id = 17").select("id", "file_path", "token_count")


@query(f"WITH {CHUNKS_SQL} SELECT id, file_path, token_count FROM chunks WHERE id IN (SELECT doc_id FROM labels WHERE quality = 0)")
def f2_in_ids(spark, sf_dir):
    bad = read(spark, sf_dir, "labels").where("quality = 0").select(F.col("doc_id").alias("id"))
    return lookups.by_ids(b.chunks(spark, sf_dir), bad).select("id", "file_path", "token_count")


@query(f"WITH {CHUNKS_SQL} SELECT id, file_path FROM chunks WHERE file_path IN ('src3/en/3', 'src3/fr/3', 'src1/en/1', 'src2/en/2')")
def f3_files(spark, sf_dir):
    return b.chunks(spark, sf_dir).where(F.col("file_path").isin("src3/en/3", "src3/fr/3", "src1/en/1", "src2/en/2")).select("id", "file_path")


@query(f"WITH {CHUNKS_SQL} SELECT id, file_path FROM chunks WHERE contains(lower(file_path), 'src1/') ORDER BY id LIMIT 30")
def f6_path_keyword(spark, sf_dir):
    return lookups.with_path_keyword(b.chunks(spark, sf_dir), "SRC1/", 30).select("id", "file_path")


@query("""
WITH t AS (SELECT doc_id AS id, lang AS kind, ' ' || array_to_string(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'), ' ') || ' ' AS s FROM documents)
SELECT id, kind FROM t WHERE contains(s, ' of the ') AND kind = 'en' ORDER BY id LIMIT 25""")
def f7_phrase_limit_filter(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("kind"), text.tokens(F.col("text")).alias("tokens"))
    return lookups.symbol_search(rows, ["of", "the"], "en", 25).select("id", "kind")


BATCH = [5, 3, 5, 999999999, 0, 7]


@query(f"WITH {CHUNKS_SQL}, asked AS (SELECT unnest(range({len(BATCH)})) AS pos, CAST(unnest({BATCH}) AS BIGINT) AS id) SELECT CAST(pos AS INTEGER) AS pos, asked.id, file_path FROM asked LEFT JOIN chunks USING (id)")
def f10_batch_ordered(spark, sf_dir):
    return lookups.batch(b.chunks(spark, sf_dir).select("id", "file_path"), BATCH).select("pos", "id", "file_path")


@query("SELECT doc_id AS id, coalesce(CASE WHEN doc_id % 3 = 0 THEN 's' || doc_id END, CAST(doc_id AS VARCHAR)) AS symbol_id, coalesce(nullif(lang, 'fr'), 'variable') AS kind, coalesce(CASE WHEN n_chars > 2000 THEN 'private' END, 'public') AS visibility FROM documents")
def f11_defaults(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("s"), F.col("doc_id").cast("string"))).alias("symbol_id"),
        F.nullif("lang", F.lit("fr")).alias("kind"), F.when(F.col("n_chars") > 2000, "private").alias("visibility"))
    return lookups.with_defaults(rows)


@query(f"WITH {PATHS_SQL} SELECT doc_id, starts_with(p, 'test') OR contains(p, '/test') AS is_test FROM paths")
def f14_test_path(spark, sf_dir):
    return _paths(spark, sf_dir).select("doc_id", lookups.is_test_path(F.col("p")).alias("is_test"))


@query("""SELECT doc_id, contains(text, 'idiot') OR contains(text, 'token') OR contains(text, 'ingthe') AS relevant, contains(text, 'idiot') OR contains(text, 'und') AS bare FROM documents""")
def f15_import_relevance(spark, sf_dir):
    names, none = F.array(F.lit("token"), F.lit("ingthe")), F.array().cast("array<string>")
    held = lambda n: lookups.import_is_relevant(F.col("text"), F.lit("idiot"), n, F.lit("a.b.und"))
    return read(spark, sf_dir, "documents").select("doc_id", held(names).alias("relevant"), held(none).alias("bare"))


SYMS_SQL = "syms AS (SELECT p_partkey AS id, CASE WHEN p_size % 5 = 0 THEN '_' ELSE '' END || p_name AS name, ['function', 'class', 'method', 'interface'][p_size % 4 + 1] AS kind, CASE WHEN p_size % 3 = 0 THEN 'private' ELSE 'public' END AS visibility, CASE WHEN p_partkey % 7 = 0 THEN p_brand END AS parent FROM part)"


def _symbols(spark, sf_dir):
    size = F.col("p_size")
    return read(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), F.concat(F.when(size % 5 == 0, "_").otherwise(""), "p_name").alias("name"),
        F.element_at(F.array(*map(F.lit, ["function", "class", "method", "interface"])), (size % 4 + 1).cast("int")).alias("kind"),
        F.when(size % 3 == 0, "private").otherwise("public").alias("visibility"), F.when(F.col("p_partkey") % 7 == 0, F.col("p_brand")).alias("parent"))


@query(f"WITH {SYMS_SQL} SELECT id, name, kind FROM syms WHERE visibility = 'public' AND kind IN ('function', 'class', 'interface') AND parent IS NULL AND NOT (starts_with(name, '_') AND NOT (starts_with(name, '__') AND ends_with(name, '__')))")
def f16_interfaces(spark, sf_dir):
    return lookups.interfaces(_symbols(spark, sf_dir)).select("id", "name", "kind")


@query(f"WITH {SYMS_SQL} SELECT id, name, kind FROM syms WHERE visibility = 'public' AND kind IN ('function', 'class', 'interface') AND parent IS NULL")
def f17_exports(spark, sf_dir):
    return lookups.exports(_symbols(spark, sf_dir)).select("id", "name", "kind")


@query(f"WITH {SYMS_SQL} SELECT id, kind FROM syms WHERE kind IN ('class', 'type', 'interface')")
def f18_type_like(spark, sf_dir):
    return lookups.type_like(_symbols(spark, sf_dir)).select("id", "kind")


@query("SELECT o_orderkey, coalesce(c_name, 'order ' || o_orderkey) AS label FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON o_custkey = c_custkey")
def f19_surrogate_resolve(spark, sf_dir):
    stored = read(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return read(spark, sf_dir, "orders").join(stored, "o_custkey", "left").select("o_orderkey", F.coalesce("c_name", F.concat(F.lit("order "), F.col("o_orderkey").cast("string"))).alias("label"))


# joins

KEYS_SQL = "keys AS (SELECT DISTINCT source AS key FROM documents), asked AS (SELECT doc_id, source || '.' || lang || '.x' AS module FROM documents)"


@query(f"""WITH {KEYS_SQL}, cand AS (SELECT doc_id, module, unnest([1, 2, 3]) AS n FROM asked)
SELECT doc_id, arg_max(key, n) AS resolved FROM (SELECT doc_id, n, array_to_string(string_split(module, '.')[1:n], '.') AS c FROM cand) JOIN keys ON key = c GROUP BY doc_id""")
def j1_resolve_prefix(spark, sf_dir):
    """Longest dotted prefix of a module that is a known key."""
    docs = read(spark, sf_dir, "documents")
    keys = docs.select(F.col("source").alias("key")).distinct()
    parts = F.split(F.concat_ws(".", "source", "lang", F.lit("x")), r"\.")
    cand = docs.select("doc_id", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(n.alias("n"), F.array_join(F.slice(parts, 1, n), ".").alias("key")))).alias("c")).select("doc_id", "c.*")
    return cand.join(keys, "key").groupBy("doc_id").agg(F.max_by("key", "n").alias("resolved"))


@query(f"""WITH {PATHS_SQL}, k AS (SELECT doc_id, p, replace(regexp_replace(p, '\\.[^./]+$', ''), '/', '.') AS key FROM paths),
both_ AS (SELECT key, p, 0 AS priority FROM k UNION ALL SELECT regexp_replace(key, '^src[0-9]+\\.', ''), p, 1 FROM k WHERE regexp_matches(key, '^src[0-9]+\\.'))
SELECT key, arg_min(p, (priority, p)) AS path FROM both_ GROUP BY key""")
def j2_file_map(spark, sf_dir):
    """Dotted key of every path, and the key without its source folder where no other path has it."""
    k = _paths(spark, sf_dir).select("p", F.translate(F.regexp_replace("p", r"\.[^./]+$", ""), "/", ".").alias("key"))
    short = k.where(F.col("key").rlike(r"^src[0-9]+\.")).select("p", F.regexp_replace("key", r"^src[0-9]+\.", "").alias("key"), F.lit(1).alias("priority"))
    both = k.withColumn("priority", F.lit(0)).unionByName(short)
    return both.groupBy("key").agg(F.min_by("p", F.struct("priority", "p")).alias("path"))


@query("SELECT vec_id, n_name FROM embeddings JOIN nation ON label = n_nationkey")
def j13_module_join(spark, sf_dir):
    e, n = read(spark, sf_dir, "embeddings"), read(spark, sf_dir, "nation")
    return e.join(n, e["label"] == n["n_nationkey"]).select("vec_id", "n_name")


@query(f"WITH {RESULTS_SQL}, base AS (SELECT strategy, task_id, recall + 0.02 AS recall, precision - 0.02 AS precision FROM results WHERE task_id % 2 = 0), u AS (SELECT r.strategy, r.task_id, unnest(['recall', 'precision']) AS metric, unnest([r.recall, r.precision]) AS now, unnest([b.recall, b.precision]) AS was FROM results r JOIN base b USING (strategy, task_id)) SELECT strategy, task_id, metric, round(now - was, 4) AS delta, now < was - 0.01 AS regressed FROM u")
def j17_baseline_join(spark, sf_dir):
    from corvane.operators import metrics

    now = b.results(spark, sf_dir)
    base = now.where("task_id % 2 = 0").select("strategy", "task_id", (F.col("recall") + 0.02).alias("recall"), (F.col("precision") - 0.02).alias("precision"))
    return metrics.against_baseline(now, base, ["recall", "precision"], 0.01)


@query(f"WITH {b.SYMBOLS_SQL}, cls AS (SELECT DISTINCT file_path, parent AS class FROM symbols) SELECT c.file_path, c.class, count(*) AS n_methods, min(s.name) AS first_method FROM cls c JOIN symbols s ON s.file_path = c.file_path AND s.parent = c.class WHERE s.visibility = 'public' GROUP BY ALL")
def j18_class_methods(spark, sf_dir):
    s = b.symbols(spark, sf_dir)
    cls = s.select("file_path", F.col("parent").alias("class")).distinct()
    m = s.where("visibility = 'public'").select("file_path", F.col("parent").alias("class"), "name")
    return cls.join(m, ["file_path", "class"]).groupBy("file_path", "class").agg(F.count("*").alias("n_methods"), F.min("name").alias("first_method"))


@query(f"""WITH {b.SYMBOLS_SQL}, q AS (SELECT file_path, parent || '.' || name AS qname FROM symbols UNION ALL SELECT DISTINCT file_path, parent FROM symbols)
SELECT a.file_path, a.qname, p.qname AS parent FROM q a LEFT JOIN q p ON p.file_path = a.file_path AND p.qname = regexp_extract(a.qname, '^(.*)(::|\\.)[^.:]*$', 1)""")
def j21_outline_parent(spark, sf_dir):
    from corvane.operators import hierarchy

    s = b.symbols(spark, sf_dir)
    q = s.select("file_path", F.concat_ws(".", "parent", "name").alias("qname")).unionAll(s.select("file_path", F.col("parent").alias("qname")).distinct())
    return hierarchy.outline_parents(q)


@query("""WITH RECURSIVE q AS (SELECT DISTINCT o_orderstatus AS file_path, array_to_string(string_split(CAST(o_orderkey AS VARCHAR), ''), '.') AS qname FROM orders),
up AS (SELECT file_path, qname, qname AS node, 0 AS depth FROM q UNION ALL SELECT up.file_path, up.qname, p.qname, depth + 1 FROM up JOIN q p ON p.file_path = up.file_path AND p.qname = regexp_extract(up.node, '^(.*)(::|\\.)[^.:]*$', 1))
SELECT file_path, qname, max(CASE WHEN depth = 1 THEN node END) AS parent, arg_max(node, depth) AS top, CAST(max(depth) AS INTEGER) AS depth FROM up GROUP BY file_path, qname""")
def h3_outline(spark, sf_dir):
    """Orders as nested names, a level a digit of their key."""
    from corvane.operators import hierarchy

    name = F.array_join(F.regexp_extract_all(F.col("o_orderkey").cast("string"), F.lit("[0-9]"), 0), ".")
    return hierarchy.outline_levels(read(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("file_path"), name.alias("qname")))


# aggregates


@query(f"WITH {CHUNKS_SQL} SELECT source, min(language) AS language, CAST(max(end_line) AS BIGINT) AS lines, count(*) AS n_chunks FROM chunks GROUP BY source")
def a1_file_meta(spark, sf_dir):
    return b.chunks(spark, sf_dir).groupBy("source").agg(F.min("language").alias("language"), F.max("end_line").cast("long").alias("lines"), F.count("*").alias("n_chunks"))


@query(f"WITH {CHUNKS_SQL} SELECT CAST(coalesce(sum(token_count), 0) AS BIGINT) AS tokens FROM chunks")
def a2_total_tokens(spark, sf_dir):
    return b.chunks(spark, sf_dir).agg(F.coalesce(F.sum("token_count"), F.lit(0)).cast("long").alias("tokens"))


@query(f"WITH {CHUNKS_SQL} SELECT CAST(coalesce(sum(token_count), 0) AS BIGINT) AS tokens FROM chunks WHERE source = 'src3'")
def a3_file_tokens(spark, sf_dir):
    return b.chunks(spark, sf_dir).where("source = 'src3'").agg(F.coalesce(F.sum("token_count"), F.lit(0)).cast("long").alias("tokens"))


@query(f"WITH {CHUNKS_SQL} SELECT CAST(sum(token_count) AS BIGINT) AS tokens FROM chunks WHERE id IN (SELECT doc_id FROM labels)")
def a4_files_tokens(spark, sf_dir):
    ids = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"))
    return lookups.by_ids(b.chunks(spark, sf_dir), ids).agg(F.sum("token_count").cast("long").alias("tokens"))


@query(f"WITH {CHUNKS_SQL} SELECT count(*) AS chunks, count(DISTINCT source) AS files FROM chunks")
def a6_file_count(spark, sf_dir):
    return b.chunks(spark, sf_dir).agg(F.count("*").alias("chunks"), F.count_distinct("source").alias("files"))


@query(f"WITH {CHUNKS_SQL}, g AS (SELECT language, count(*) AS files, CAST(sum(end_line) AS BIGINT) AS lines FROM chunks GROUP BY language) SELECT *, round(100.0 * lines / sum(lines) OVER (), 2) AS percentage FROM g")
def a7_language_stats(spark, sf_dir):
    rows = b.chunks(spark, sf_dir).groupBy("language").agg(F.count("*").alias("files"), F.sum("end_line").cast("long").alias("lines"))
    total = Window.partitionBy()  # a row per language
    return rows.withColumn("percentage", F.round(100.0 * F.col("lines") / F.sum("lines").over(total), 2))


@query("SELECT l_suppkey AS file, round(max(l_extendedprice * CASE WHEN l_returnflag = 'R' THEN 0.6 ELSE 1.0 END), 4) AS seed FROM lineitem GROUP BY 1")
def a9_seed_max(spark, sf_dir):
    score = F.col("l_extendedprice") * F.when(F.col("l_returnflag") == "R", 0.6).otherwise(1.0)
    return read(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("file")).agg(F.round(F.max(score), 4).alias("seed"))


@query("SELECT l_suppkey AS file, CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) AS BIGINT) AS score FROM lineitem GROUP BY 1")
def a10_file_score(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("file")).agg(F.sum(F.round(F.col("l_discount") * 100).cast("long")).alias("score"))


@query("SELECT source, list_sort(list(n_chars), 'DESC')[count(*) // 2 + 1] AS median FROM documents GROUP BY source")
def a13_median(spark, sf_dir):
    """The element at place n div 2 (from 0) of the falling list, by exact order statistics rather than a list in memory."""
    rows = read(spark, sf_dir, "documents")
    w = Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id")
    placed = rows.select("source", "n_chars", F.row_number().over(w).alias("i"), F.count("*").over(Window.partitionBy("source")).alias("n"))
    return placed.where("i = n DIV 2 + 1").select("source", F.col("n_chars").alias("median"))


@query(f"WITH {RESULTS_SQL} SELECT strategy, round(avg(recall), 4) AS recall, round(avg(precision), 4) AS precision, count(*) AS tasks FROM results GROUP BY strategy")
def a14_strategy_avg(spark, sf_dir):
    return b.results(spark, sf_dir).groupBy("strategy").agg(F.round(F.avg("recall"), 4).alias("recall"), F.round(F.avg("precision"), 4).alias("precision"), F.count("*").alias("tasks"))


@query(f"WITH {RESULTS_SQL} SELECT strategy, CASE WHEN grouping(c) = 1 THEN '(all)' ELSE c END AS category, round(avg(recall), 4) AS recall FROM (SELECT *, 'c' || task_id % 3 AS c FROM results) GROUP BY GROUPING SETS ((strategy), (strategy, c))")
def a15_grouping_sets(spark, sf_dir):
    rows = b.results(spark, sf_dir).withColumn("c", F.concat(F.lit("c"), (F.col("task_id") % 3).cast("string")))
    out = rows.groupingSets([[F.col("strategy")], [F.col("strategy"), F.col("c")]], "strategy", "c").agg(F.round(F.avg("recall"), 4).alias("recall"), F.grouping("c").alias("g"))
    return out.select("strategy", F.when(F.col("g") == 1, "(all)").otherwise(F.col("c")).alias("category"), "recall")


@query(f"WITH {RESULTS_SQL}, u AS (SELECT task_id, strategy, unnest(['recall', 'precision']) AS metric, unnest([recall, precision]) AS v FROM results), w AS (SELECT metric, arg_max(strategy, (v, -ascii(strategy))) AS strategy FROM u GROUP BY task_id, metric) SELECT metric, strategy, count(*) AS wins FROM w GROUP BY ALL")
def a16_wins(spark, sf_dir):
    from corvane.operators import metrics

    return metrics.wins(b.results(spark, sf_dir), ["recall", "precision"])


@query("SELECT source, CAST(CASE WHEN n >= 3 THEN 0.85 WHEN n = 2 THEN 0.60 WHEN n = 1 THEN 0.30 ELSE 0.0 END AS DOUBLE) AS confidence FROM (SELECT source, count(*) FILTER (contains(text, 'token = ')) AS n FROM documents GROUP BY source)")
def a18_confidence(spark, sf_dir):
    from corvane.operators.analytics import confidence

    return read(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.when(F.contains("text", F.lit("token = ")), 1)).alias("n")).select("source", confidence(F.col("n")).alias("confidence"))


@query(f"WITH {CHUNKS_SQL}, g AS (SELECT source, CAST(sum(token_count) AS BIGINT) AS raw, CAST(sum(CASE WHEN id % 3 = 0 THEN token_count ELSE 0 END) AS BIGINT) AS returned FROM chunks GROUP BY source) SELECT source, CASE WHEN raw = 0 THEN 0.0 ELSE round((1 - returned / raw) * 100, 1) END AS savings FROM g")
def a19_savings(spark, sf_dir):
    from corvane.operators.metrics import savings

    g = b.chunks(spark, sf_dir).groupBy("source").agg(F.sum("token_count").alias("raw"), F.sum(F.when(F.col("id") % 3 == 0, F.col("token_count")).otherwise(0)).alias("returned"))
    return g.select("source", savings(F.col("returned"), F.col("raw")).alias("savings"))


@query(f"WITH {RESULTS_SQL}, w AS (SELECT *, max(CASE WHEN strategy = 'N' THEN tokens END) OVER (PARTITION BY task_id) AS raw FROM results) SELECT task_id, strategy, CASE WHEN coalesce(raw, 0) = 0 THEN 0.0 ELSE round((1 - tokens / raw) * 100, 1) END AS savings FROM w")
def a20_backfill(spark, sf_dir):
    from corvane.operators.metrics import backfill_savings

    return backfill_savings(b.results(spark, sf_dir), "N").select("task_id", "strategy", "savings")


@query("SELECT o_orderpriority AS dimension, count(*) FILTER (o_orderstatus = 'F') AS a, count(*) FILTER (o_orderstatus = 'O') AS b FROM orders GROUP BY 1")
def a22_dimension_counts(spark, sf_dir):
    return read(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("dimension")).pivot("o_orderstatus", ["F", "O"]).agg(F.count(F.lit(1))).na.fill(0).withColumnsRenamed({"F": "a", "O": "b"})


# windows


@query("SELECT doc_id, source || '#' || lang || CASE WHEN n > 1 THEN '@' || r ELSE '' END AS symbol_id FROM (SELECT *, count(*) OVER (PARTITION BY source, lang) AS c, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) AS r, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) AS n FROM documents)")
def w3_disambiguate(spark, sf_dir):
    from corvane.operators.chunking import disambiguate

    rows = read(spark, sf_dir, "documents").select("doc_id", F.concat_ws("#", "source", "lang").alias("symbol_id"), F.col("doc_id").alias("start_line"))
    return disambiguate(rows, ["symbol_id"]).select("doc_id", "symbol_id")


GAPS_SQL = """s AS (SELECT source AS f, doc_id % 400 AS a, doc_id % 400 + n_chars % 9 AS z FROM documents),
g AS (SELECT f, a, coalesce(max(z) OVER (PARTITION BY f ORDER BY a, z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS m FROM s)
SELECT f AS file_path, CAST(m + 1 AS BIGINT) AS first_line, CAST(a - 1 AS BIGINT) AS last_line FROM g WHERE a > m + 1
UNION ALL SELECT f, CAST(max(z) + 1 AS BIGINT), 420 FROM s GROUP BY f HAVING max(z) < 420"""


@query(f"WITH {GAPS_SQL}")
def w5_uncovered(spark, sf_dir):
    from corvane.operators.chunking import uncovered

    a = F.col("doc_id") % 400
    s = read(spark, sf_dir, "documents").select(F.col("source").alias("file_path"), a.alias("start_line"), (a + F.col("n_chars") % 9).alias("end_line"))
    return uncovered(s, s.select("file_path", F.lit(420).cast("long").alias("lines")).distinct())


@query("SELECT source, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS r FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) WHERE r <= 3")
def w7_cap(spark, sf_dir):
    from corvane.operators.context import first_per_file

    docs, seen = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels").select("doc_id")
    return first_per_file(docs.join(seen, "doc_id", "left_anti"), "source", [F.desc("n_chars"), F.col("doc_id")], 3).select("source", "doc_id")


# sets


@query("SELECT o_orderkey FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01' AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def u3_diff(spark, sf_dir):
    old = read(spark, sf_dir, "orders").where(F.col("o_orderdate") < F.lit("1996-01-01").cast("timestamp")).select("o_orderkey")
    gone = read(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return old.join(gone, "o_orderkey", "left_anti")


@query("WITH a AS (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_linestatus = 'O'), b AS (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_linestatus = 'F') SELECT coalesce(a.k, b.k) AS k, CASE WHEN b.k IS NULL THEN 'added' ELSE 'removed' END AS side FROM a FULL JOIN b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL")
def u4_symdiff(spark, sf_dir):
    from corvane.operators.delta import symmetric_difference

    rows = read(spark, sf_dir, "lineitem")
    part = lambda s: rows.where(F.col("l_linestatus") == s).select(F.col("l_orderkey").alias("k")).distinct()
    return symmetric_difference(part("O"), part("F"), ["k"])
