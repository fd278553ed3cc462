"""Queries over graphs, chunking, analytics, change detection, hierarchies and quality metrics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corvane.operators import analytics, chunking, delta, graph, hierarchy, metrics
from corvane.plans.registry import SQL, query, read
from corvane.sources import bindings as b
from corvane.sources.bindings import PAGE_EDGES_SQL, RANKED_SQL, RESULTS_SQL, SYMBOLS_SQL, USER_EDGES_SQL

SEEDS = [3, 8, 21]


def _seed_nodes(spark):
    return spark.createDataFrame([(x,) for x in SEEDS], "node long")


SEED_SQL = f"{USER_EDGES_SQL}, seed AS (SELECT unnest({SEEDS}) AS node)"


@query(f"WITH {SEED_SQL} SELECT source, target FROM edges WHERE source IN (SELECT node FROM seed)")
def j6_imports_of(spark, sf_dir):
    return graph.imports_of(b.user_edges(spark, sf_dir), _seed_nodes(spark)).select("source", "target")


@query(f"WITH {SEED_SQL} SELECT source, target FROM edges WHERE target IN (SELECT node FROM seed)")
def j7_imported_by(spark, sf_dir):
    return graph.imported_by(b.user_edges(spark, sf_dir), _seed_nodes(spark)).select("source", "target")


@query(f"WITH {SEED_SQL} SELECT DISTINCT node FROM (SELECT target AS node FROM edges WHERE source IN (SELECT node FROM seed) UNION ALL SELECT source FROM edges WHERE target IN (SELECT node FROM seed)) WHERE node NOT IN (SELECT node FROM seed)")
def j8_expand_anti(spark, sf_dir):
    return graph.expand(b.user_edges(spark, sf_dir), _seed_nodes(spark))


HOSTS_SQL = "seed AS (SELECT DISTINCT source AS node FROM edges WHERE source LIKE '%a.example.com')"


def _hosts(edges):
    return edges.where(F.col("source").like("%a.example.com")).select(F.col("source").alias("node")).distinct()


@query(f"""WITH {PAGE_EDGES_SQL}, {HOSTS_SQL}, one AS (SELECT DISTINCT node FROM (SELECT target AS node FROM edges WHERE source IN (SELECT node FROM seed) UNION ALL SELECT source FROM edges WHERE target IN (SELECT node FROM seed)) WHERE node NOT IN (SELECT node FROM seed)),
back AS (SELECT target AS source, source AS target FROM edges)
SELECT DISTINCT target AS node FROM back WHERE source IN (SELECT node FROM one) AND target NOT IN (SELECT node FROM seed) AND target NOT IN (SELECT node FROM one)""")
def j9_two_hop(spark, sf_dir):
    """Over links read both ways: targets are not linked from elsewhere in these pages."""
    e = b.page_edges(spark, sf_dir)
    seeds = _hosts(e)
    both = e.unionByName(e.select(F.col("target").alias("source"), F.col("source").alias("target")))
    return graph.two_hop(both, seeds)


@query(f"WITH {USER_EDGES_SQL}, kept AS (SELECT DISTINCT user_id AS node FROM events WHERE user_id < 12) SELECT source, array_to_string(list_sort(list(target)), ',') AS targets FROM edges WHERE source IN (SELECT node FROM kept) AND target IN (SELECT node FROM kept) GROUP BY source")
def j14_subgraph(spark, sf_dir):
    kept = read(spark, sf_dir, "events").where("user_id < 12").select(F.col("user_id").alias("node")).distinct()
    return graph.subgraph(b.user_edges(spark, sf_dir), kept).select("source", F.array_join("targets", ",").alias("targets"))


@query(f"WITH {PAGE_EDGES_SQL} SELECT target, count(DISTINCT source) AS n, array_to_string(list_sort(list(DISTINCT source)), ',') AS users FROM edges GROUP BY target")
def j15_used_by(spark, sf_dir):
    return graph.used_by(b.page_edges(spark, sf_dir)).select("target", F.size("users").cast("long").alias("n"), F.array_join("users", ",").alias("users"))


@query(f"""WITH {PAGE_EDGES_SQL}, {HOSTS_SQL}, both_ AS (SELECT source, target FROM edges UNION SELECT target, source FROM edges),
h1 AS (SELECT DISTINCT target AS node FROM both_ WHERE source IN (SELECT node FROM seed) AND target NOT IN (SELECT node FROM seed)),
h2 AS (SELECT DISTINCT target AS node FROM both_ WHERE source IN (SELECT node FROM h1) AND target NOT IN (SELECT node FROM seed UNION SELECT node FROM h1)),
h3 AS (SELECT DISTINCT target AS node FROM both_ WHERE source IN (SELECT node FROM h2) AND target NOT IN (SELECT node FROM seed UNION SELECT node FROM h1 UNION SELECT node FROM h2))
SELECT node, 1 AS hop FROM h1 UNION ALL SELECT node, 2 FROM h2 UNION ALL SELECT node, 3 FROM h3""")
def g3_khop(spark, sf_dir):
    e = b.page_edges(spark, sf_dir)
    return graph.k_hop(e, _hosts(e), 3)


def _rank_sql(edges: str, rounds: int) -> str:
    out = [edges, "nodes AS (SELECT source AS node FROM edges UNION SELECT target FROM edges)", "deg AS (SELECT source AS node, count(*) AS out FROM edges GROUP BY source)", "r0 AS (SELECT node, 1.0::DOUBLE / (SELECT count(*) FROM nodes) AS rank FROM nodes)"]
    for i in range(1, rounds + 1):
        out.append(
            f"""r{i} AS MATERIALIZED (SELECT nodes.node, 0.85 * (coalesce(g.given, 0) + (SELECT coalesce(sum(rank), 0) FROM r{i - 1} WHERE node NOT IN (SELECT node FROM deg)) / (SELECT count(*) FROM nodes)) + 0.15 / (SELECT count(*) FROM nodes) AS rank
FROM nodes LEFT JOIN (SELECT target AS node, sum(rank / out) AS given FROM edges JOIN r{i - 1} ON source = r{i - 1}.node JOIN deg ON deg.node = source GROUP BY target) g ON g.node = nodes.node)"""
        )
    return "WITH " + ", ".join(out) + f" SELECT node, round(rank, 6) AS rank FROM r{rounds}"


@query(_rank_sql(PAGE_EDGES_SQL, 8))
def g4_pagerank(spark, sf_dir):
    return graph.page_rank(b.page_edges(spark, sf_dir), rounds=8, tolerance=None).select("node", F.round("rank", 6).alias("rank"))


@query(f"WITH {USER_EDGES_SQL}, changed AS (SELECT unnest({SEEDS}) AS node), fresh AS (SELECT target AS source, source AS target FROM edges WHERE source IN (SELECT node FROM changed)) SELECT source, target FROM edges WHERE source NOT IN (SELECT node FROM changed) AND target NOT IN (SELECT node FROM changed) UNION SELECT source, target FROM fresh")
def g5_graph_update(spark, sf_dir):
    e, changed = b.user_edges(spark, sf_dir), _seed_nodes(spark)
    fresh = graph.imports_of(e, changed).select(F.col("target").alias("source"), F.col("source").alias("target"))
    return graph.update(e.select("source", "target"), changed, fresh)


@query(f"WITH {PAGE_EDGES_SQL} SELECT (SELECT count(*) FROM edges) AS edges, (SELECT count(*) FROM (SELECT source FROM edges UNION SELECT target FROM edges)) AS nodes")
def g6_counts(spark, sf_dir):
    e = b.page_edges(spark, sf_dir)
    return e.agg(F.count("*").alias("edges")).join(graph.nodes_of(e).agg(F.count("*").alias("nodes")))


def _labels_sql(rounds: int) -> str:
    out = [PAGE_EDGES_SQL, "both_ AS (SELECT DISTINCT source, target FROM (SELECT source, target FROM edges UNION ALL SELECT target, source FROM edges) WHERE source <> target)", "s0 AS (SELECT DISTINCT source AS node, source AS label FROM both_)"]
    for i in range(rounds):
        out.append(
            f"""s{i + 1} AS MATERIALIZED (SELECT node, CASE WHEN ascii(substr(md5(node), 32, 1)) % 2 = {i % 2} THEN best ELSE label END AS label FROM s{i} JOIN (
SELECT node, label AS best FROM (SELECT node, label, row_number() OVER (PARTITION BY node ORDER BY count(*) DESC, label) AS r FROM (SELECT source AS node, label FROM both_ JOIN s{i} ON target = node UNION ALL SELECT node, label FROM s{i}) GROUP BY node, label) WHERE r = 1) USING (node))"""
        )
    return "WITH " + ", ".join(out) + f" SELECT node, label AS community FROM s{rounds}"


@query(_labels_sql(8))
def g7_communities(spark, sf_dir):
    """Label propagation; the halves that move by turns are split by a digest."""
    return graph.communities(b.page_edges(spark, sf_dir))


@query(f"WITH {USER_EDGES_SQL} SELECT DISTINCT least(source, target) AS a, greatest(source, target) AS b FROM edges")
def g8_undirected(spark, sf_dir):
    return graph.undirected(b.user_edges(spark, sf_dir))


MEMBERS_SQL = "members AS (SELECT DISTINCT user_id AS node, user_id % 20 AS module FROM events)"


def _members(spark, sf_dir):
    return read(spark, sf_dir, "events").select(F.col("user_id").alias("node"), (F.col("user_id") % 20).alias("module")).distinct()


@query(f"""WITH {USER_EDGES_SQL}, {MEMBERS_SQL}, u AS (SELECT DISTINCT least(source, target) AS a, greatest(source, target) AS b FROM edges),
i AS (SELECT x.module, count(*) AS inner_ FROM u JOIN members x ON a = x.node JOIN members y ON b = y.node WHERE x.module = y.module GROUP BY x.module)
SELECT module, n, coalesce(inner_, 0) AS "inner", CASE WHEN n < 2 THEN 1.0 ELSE round(coalesce(inner_, 0) / (n * (n - 1) / 2), 4) END AS cohesion FROM (SELECT module, count(*) AS n FROM members GROUP BY module) LEFT JOIN i USING (module)""")
def g9_cohesion(spark, sf_dir):
    return graph.cohesion(b.user_edges(spark, sf_dir), _members(spark, sf_dir))


@query("""WITH e AS (SELECT source AS g, min('repo/' || source || '/' || lang) AS lo, max('repo/' || source || '/' || lang) AS hi FROM documents GROUP BY 1),
p AS (SELECT g, lo, list_max(list_filter(range(0, length(lo) + 1), lambda i: left(lo, i) = left(hi, i))) AS n FROM e)
SELECT g AS module, string_split(regexp_replace(left(lo, n), '/+$', ''), '/')[-1] AS name FROM p""")
def g10_module_name(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select(F.col("source").alias("module"), F.concat_ws("/", F.lit("repo"), "source", "lang").alias("path"))
    return graph.common_folder(rows, "module")


@query(f"""WITH {USER_EDGES_SQL}, files AS (SELECT user_id AS node, user_id % 20 AS module, count(*) AS lines FROM events GROUP BY ALL),
d AS (SELECT a.module, list_sort(list(DISTINCT target) FILTER (b.module = a.module)) AS i, list_sort(list(DISTINCT target) FILTER (b.module <> a.module)) AS x FROM edges JOIN files a ON source = a.node LEFT JOIN files b ON target = b.node GROUP BY a.module)
SELECT module, file_count, line_count, coalesce(array_to_string(i, ','), '') AS internal_deps, CAST(coalesce(len(x), 0) AS BIGINT) AS n_external FROM (SELECT module, count(*) AS file_count, CAST(sum(lines) AS BIGINT) AS line_count FROM files GROUP BY module) LEFT JOIN d USING (module)""")
def g11_module_agg(spark, sf_dir):
    files = read(spark, sf_dir, "events").groupBy(F.col("user_id").alias("node"), (F.col("user_id") % 20).alias("module")).agg(F.count("*").alias("lines"))
    out = graph.modules(files, b.user_edges(spark, sf_dir))
    return out.select("module", "file_count", "line_count", F.array_join("internal_deps", ",").alias("internal_deps"), F.size("external_deps").cast("long").alias("n_external"))


# chunking


@query(f"""WITH RECURSIVE l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents),
n AS (SELECT doc_id, i, len(list_filter(regexp_split_to_array(trim(line), '\\s+'), lambda w: w <> '')) AS n FROM l),
f AS (SELECT doc_id, i, n AS s, 0 AS g FROM n WHERE i = 0 UNION ALL SELECT n.doc_id, n.i, CASE WHEN f.s + n.n > 120 AND f.s > 0 THEN n.n ELSE f.s + n.n END, CASE WHEN f.s + n.n > 120 AND f.s > 0 THEN g + 1 ELSE g END FROM f JOIN n ON n.doc_id = f.doc_id AND n.i = f.i + 1)
SELECT doc_id AS id, CAST(g AS INTEGER) AS part, CAST(min(i) + 1 AS BIGINT) AS first, CAST(count(*) AS BIGINT) AS n_lines FROM f GROUP BY doc_id, g""")
def w4_token_split(spark, sf_dir):
    parts = chunking.split_lines(b.chunks(spark, sf_dir), 120)
    return parts.select("id", "part", "first", F.size(F.split("content", "\n")).cast("long").alias("n_lines"))


@query("""WITH RECURSIVE p AS (SELECT doc_id // 40 AS f, n_chars % 60 AS t, row_number() OVER (PARTITION BY doc_id // 40 ORDER BY doc_id) AS i FROM documents),
r AS (SELECT f, i, t, CAST(0 AS BIGINT) AS g, CAST(t AS BIGINT) AS open FROM p WHERE i = 1 UNION ALL
  SELECT p.f, p.i, p.t, CASE WHEN r.open >= 50 THEN g + 1 ELSE g END, CASE WHEN r.open >= 50 THEN 0 ELSE r.open END + p.t FROM r JOIN p ON p.f = r.f AND p.i = r.i + 1),
q AS (SELECT f, g, sum(t) AS t FROM r GROUP BY f, g)
SELECT CAST(f AS VARCHAR) AS file_path, CAST(CASE WHEN t < 50 THEN greatest(g - 1, 0) ELSE g END AS INTEGER) AS "group", CAST(sum(t) AS BIGINT) AS token_count FROM q GROUP BY 1, 2""")
def w6_merge_small(spark, sf_dir):
    """Runs of 40 ids stand for files, which have a bounded number of pieces."""
    pieces = read(spark, sf_dir, "documents").select(F.expr("CAST(doc_id DIV 40 AS STRING)").alias("file_path"), F.col("doc_id").alias("start_line"), (F.col("n_chars") % 60).alias("token_count"))
    return chunking.merge_small(pieces)


# analytics

VERBS = ["set_next", "process", "handle", "register", "get", "all", "subscribe", "on", "emit", "save", "find", "delete", "run", "__init__"]
CLASS_NAMES = ["LogHandler", "PluginRegistry", "EventBus", "UserRepo", "SortStrategy", "SortContext", "Plain"]
CODE_SQL = f"""code AS (SELECT 'f' || l_suppkey || '.py' AS file_path, {CLASS_NAMES}[l_partkey % 7 + 1] || l_linenumber AS parent, {VERBS}[CAST(l_quantity AS BIGINT) % 14 + 1] AS name, l_tax > 0.07 AS hidden FROM lineitem),
cls AS (SELECT DISTINCT file_path, parent AS symbol FROM code),
m AS (SELECT file_path, parent AS symbol, list(DISTINCT name) FILTER (NOT hidden) AS ms FROM code GROUP BY ALL),
c AS (SELECT *, coalesce(ms, []) AS methods FROM cls LEFT JOIN m USING (file_path, symbol))"""


def _code(spark, sf_dir):
    """Invented classes and methods: classes of a supplier's file by part, methods by quantity."""
    pick = lambda names, by: F.element_at(F.array(*map(F.lit, names)), (by % len(names) + 1).cast("int"))
    rows = read(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("f"), F.col("l_suppkey").cast("string"), F.lit(".py")).alias("file_path"),
        F.concat(pick(CLASS_NAMES, F.col("l_partkey")), F.col("l_linenumber").cast("string")).alias("parent"),
        pick(VERBS, F.col("l_quantity").cast("long")).alias("name"), F.when(F.col("l_tax") > 0.07, "private").otherwise("public").alias("visibility"), F.lit("method").alias("kind"),
    )
    cls = rows.select("file_path", F.lit(None).cast("string").alias("parent"), F.col("parent").alias("name"), F.lit("public").alias("visibility"), F.lit("class").alias("kind")).distinct()
    return rows.unionByName(cls)


def _named(words: str) -> str:
    return f"regexp_matches(lower(symbol), '{'|'.join(words.split())}')"


def _any(words: str) -> str:
    return "list_has_any(methods, [" + ", ".join(f"'{w}'" for w in words.split()) + "])"


@query(f"""WITH {CODE_SQL}, w AS (SELECT *, {_any("set_next next")} AND {_any("process handle")} AS full_, {_any("process handle")} AS works FROM c), x AS (SELECT *, bool_or(full_) OVER (PARTITION BY file_path) AS chain FROM w)
SELECT file_path, symbol, CASE WHEN full_ THEN 'chain' ELSE 'participant' END AS role FROM x WHERE full_ OR (works AND ({_named("middleware handler chain filter interceptor")} OR chain))""")
def n2_middleware(spark, sf_dir):
    return analytics.middleware(_code(spark, sf_dir))


@query(f"""WITH {CODE_SQL}, r AS (SELECT *, {_any("register unregister")} AND ({_any("get all")} OR {_named("registry manager store")}) AS reg FROM c) SELECT file_path, symbol, CASE WHEN reg THEN 'registry' ELSE 'contract' END AS role FROM r WHERE reg OR {_named("plugin extension handler")}""")
def n3_plugin(spark, sf_dir):
    return analytics.plugins(_code(spark, sf_dir))


SUB, EMIT = "subscribe on listen add_listener add_handler", "emit publish dispatch trigger fire send"


@query(f"""WITH {CODE_SQL}, r AS (SELECT *, list_intersect(methods, [{", ".join(f"'{w}'" for w in SUB.split())}]) AS s, {_any(EMIT)} AS e FROM c)
SELECT file_path, symbol, CASE WHEN len(s) > 0 AND e THEN 'bus' WHEN len(s) > 0 THEN 'subscriber' ELSE 'emitter' END AS role FROM r WHERE (len(s) > 0 OR e) AND NOT (len(s) = 1 AND s[1] = 'on' AND NOT {_named("event bus emitter dispatcher listener")})""")
def n4_event_bus(spark, sf_dir):
    return analytics.event_bus(_code(spark, sf_dir))


@query(f"""WITH {CODE_SQL}, r AS (SELECT *, len(list_intersect(methods, ['get', 'find', 'save', 'create', 'update', 'delete', 'all', 'list', 'fetch'])) AS n FROM c) SELECT file_path, symbol, 'repository' AS role FROM r WHERE n >= 3 OR (n >= 2 AND {_named("repo dao store data")})""")
def n5_repository(spark, sf_dir):
    return analytics.repository(_code(spark, sf_dir))


@query(f"""WITH {CODE_SQL}, o AS (SELECT file_path, parent AS symbol, list_filter(list(DISTINCT name), lambda x: NOT starts_with(x, '__')) AS own, count(*) FILTER (NOT starts_with(name, '__')) AS n_own FROM code GROUP BY ALL),
d AS (SELECT c.file_path, c.symbol, list_filter(methods, lambda x: NOT starts_with(x, '__')) AS shown, coalesce(own, []) AS own, coalesce(n_own, 0) AS n_own FROM c LEFT JOIN o USING (file_path, symbol)),
sm AS (SELECT file_path, list(m) AS shared FROM (SELECT file_path, m FROM (SELECT file_path, unnest(shown) AS m FROM d) GROUP BY ALL HAVING count(*) > 1) GROUP BY file_path),
r AS (SELECT d.*, CASE WHEN {_named("context executor runner engine sorter dispatcher")} AND n_own >= 1 THEN 'context' WHEN {_named("strategy policy algorithm interface protocol")} AND n_own <= 3 THEN 'protocol' WHEN list_has_any(shown, shared) THEN 'concrete' END AS role0 FROM d JOIN sm USING (file_path)),
a AS (SELECT *, count(*) FILTER (role0 = 'protocol') OVER w AS np, count(*) FILTER (role0 = 'context') OVER w AS nc, count(*) FILTER (role0 = 'concrete') OVER w AS nk, flatten(list(own) FILTER (role0 = 'protocol') OVER w) AS asked FROM r WINDOW w AS (PARTITION BY file_path)),
z AS (SELECT *, CASE WHEN role0 IS NULL AND nk = 0 AND list_has_any(shown, asked) THEN 'concrete' ELSE role0 END AS role FROM a), y AS (SELECT *, count(*) FILTER (role = 'concrete') OVER (PARTITION BY file_path) AS nz FROM z)
SELECT file_path, symbol, role FROM y WHERE nz > 0 AND (np > 0 OR nc > 0) AND role IS NOT NULL""")
def n6_strategy(spark, sf_dir):
    return analytics.strategy(_code(spark, sf_dir))


_FOUND = " UNION ALL ".join(f"SELECT '{name}' AS pattern, count(*) AS n FROM ({SQL[key]})" for name, key in zip(analytics.DETECTORS, ("n2_middleware", "n3_plugin", "n4_event_bus", "n5_repository", "n6_strategy"), strict=True))
PATTERNS_SQL = f"SELECT pattern, n, CASE WHEN n >= 3 THEN 0.85 WHEN n = 2 THEN 0.6 ELSE 0.3 END::DOUBLE AS confidence FROM ({_FOUND}) WHERE n > 0"


@query(PATTERNS_SQL)
def n1_patterns(spark, sf_dir):
    """All detectors in order; the twin is the union of theirs."""
    return analytics.patterns(_code(spark, sf_dir))


SIG_SQL = "'def f(self, x: int = ' || o_orderkey || ', *, y: dict[str, int], z) -> ' || CASE WHEN o_orderkey % 2 = 0 THEN 'list[' || o_orderstatus || ']:' ELSE 'None' END"


def _signature():
    return F.concat(F.lit("def f(self, x: int = "), F.col("o_orderkey").cast("string"), F.lit(", *, y: dict[str, int], z) -> "), F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("list["), "o_orderstatus", F.lit("]:"))).otherwise("None"))


@query("SELECT o_orderkey, unnest(['x', 'y', 'z']) AS name, unnest(['int', 'dict[str, int]', NULL]) AS type, unnest([CAST(o_orderkey AS VARCHAR), NULL, NULL]) AS \"default\", unnest([false, true, true]) AS required FROM orders")
def n9_parameters(spark, sf_dir):
    return read(spark, sf_dir, "orders").select("o_orderkey", F.explode(analytics.parameters(_signature())).alias("p")).select("o_orderkey", "p.*")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'list[' || o_orderstatus || ']' ELSE 'None' END AS returns FROM orders")
def n10_return_type(spark, sf_dir):
    return read(spark, sf_dir, "orders").select("o_orderkey", analytics.return_type(_signature()).alias("returns"))


@query(f"""WITH t AS (SELECT o_custkey % 2 AS side, CASE o_orderpriority WHEN '1-URGENT' THEN 'async route' WHEN '2-HIGH' THEN 'cache store' WHEN '3-MEDIUM' THEN 'mock fixture' ELSE 'config error ' || o_orderstatus END AS text FROM orders),
k AS (SELECT unnest([{", ".join(f"'{d}'" for d in analytics.DIMENSIONS)}]) AS dimension, unnest([{", ".join(f"'{'|'.join(v)}'" for v in analytics.DIMENSIONS.values())}]) AS re),
c AS (SELECT dimension, count(*) FILTER (side = 0) AS a, count(*) FILTER (side = 1) AS b FROM t, k WHERE regexp_matches(lower(text), re) GROUP BY dimension)
SELECT dimension, a, b, CASE WHEN a = 0 AND b = 0 THEN 'neither' WHEN a = 0 THEN 'only b' WHEN b = 0 THEN 'only a' WHEN a > 2 * b THEN 'a has more' WHEN b > 2 * a THEN 'b has more' ELSE 'comparable' END AS trade_off FROM c""")
def n13_compare(spark, sf_dir):
    p = F.col("o_orderpriority")
    t = F.when(p == "1-URGENT", "async route").when(p == "2-HIGH", "cache store").when(p == "3-MEDIUM", "mock fixture").otherwise(F.concat(F.lit("config error "), "o_orderstatus"))
    rows = analytics.dimension_evidence(read(spark, sf_dir, "orders").select((F.col("o_custkey") % 2).alias("side"), t.alias("text")))
    counts = rows.groupBy("dimension").agg(F.count(F.when(F.col("side") == 0, 1)).alias("a"), F.count(F.when(F.col("side") == 1, 1)).alias("b"))
    return counts.withColumn("trade_off", analytics.trade_off(F.col("a"), F.col("b")))


@query("""WITH c AS (SELECT n_nationkey, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal > 5000) AS a, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal <= 5000) AS b FROM nation)
SELECT n_nationkey, CASE WHEN a = 0 AND b = 0 THEN 'neither' WHEN a = 0 THEN 'only b' WHEN b = 0 THEN 'only a' WHEN a > 2 * b THEN 'a has more' WHEN b > 2 * a THEN 'b has more' ELSE 'comparable' END AS trade_off FROM c""")
def n15_tradeoffs(spark, sf_dir):
    s = read(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count(F.when(F.col("s_acctbal") > 5000, 1)).alias("a"), F.count(F.when(F.col("s_acctbal") <= 5000, 1)).alias("b"))
    rows = read(spark, sf_dir, "nation").join(s, "n_nationkey", "left").na.fill(0, ["a", "b"])
    return rows.select("n_nationkey", analytics.trade_off(F.col("a"), F.col("b")).alias("trade_off"))


# change detection

SNAP_SQL = """old AS (SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 11 <> 0), new AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 13 <> 0)"""


def _snapshots(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return o.where("o_orderkey % 11 <> 0"), o.where("o_orderkey % 13 <> 0").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 7 == 0, "X").otherwise(F.col("o_orderstatus")))


@query(f"WITH {SNAP_SQL} SELECT * FROM (SELECT coalesce(old.o_orderkey, new.o_orderkey) AS o_orderkey, CASE WHEN old.o_orderkey IS NULL THEN 'A' WHEN new.o_orderkey IS NULL THEN 'D' WHEN old.o_orderstatus <> new.o_orderstatus THEN 'M' END AS status FROM old FULL JOIN new ON old.o_orderkey = new.o_orderkey) WHERE status IS NOT NULL")
def d1_snapshot_delta(spark, sf_dir):
    return delta.snapshot_delta(*_snapshots(spark, sf_dir), "o_orderkey", "o_orderstatus")


@query("SELECT * FROM (SELECT coalesce(i.k, c.k) AS k, CASE WHEN i.k IS NULL THEN 'A' WHEN c.k IS NULL THEN 'D' WHEN m > TIMESTAMP '1997-06-01' THEN 'M' END AS status FROM (SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 5 <> 0) i FULL JOIN (SELECT o_orderkey AS k, o_orderdate AS m FROM orders WHERE o_orderkey % 3 <> 0) c ON i.k = c.k) WHERE status IS NOT NULL")
def d2_mtime_delta(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderdate").alias("m"))
    return delta.mtime_delta(o.where("k % 5 <> 0").select("k"), o.where("k % 3 <> 0"), "1997-06-01 00:00:00", "k", "m")


@query(f"WITH {SNAP_SQL} SELECT * FROM new")
def d3_apply_delta(spark, sf_dir):
    old, new = _snapshots(spark, sf_dir)
    return delta.apply_delta(old, delta.snapshot_delta(old, new, "o_orderkey", "o_orderstatus"), new, "o_orderkey")


@query("SELECT 0::BIGINT AS differences")
def d7_equivalence(spark, sf_dir):
    """A table after its delta holds the rows of the rebuilt one."""
    old, new = _snapshots(spark, sf_dir)
    after = delta.apply_delta(old, delta.snapshot_delta(old, new, "o_orderkey", "o_orderstatus"), new, "o_orderkey")
    return delta.difference(after, new).agg(F.count("*").alias("differences"))


@query("SELECT count(*) FILTER (doc_id % 3 <> 0) > 0 AS reindex FROM documents")
def d8_null_ids(spark, sf_dir):
    return delta.lacks_ids(read(spark, sf_dir, "documents").select(F.when(F.col("doc_id") % 3 == 0, "s").alias("symbol_id")))


@query("WITH u AS (SELECT o_orderkey AS k, o_orderstatus AS v, 0 AS s FROM orders UNION ALL SELECT o_orderkey * 2, 'new', 1 FROM orders WHERE o_orderkey < 500) SELECT k, arg_max(v, s) AS v FROM u GROUP BY k")
def k1_upsert(spark, sf_dir):
    from corvane.operators.lookups import upsert

    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("v"))
    return upsert(o, o.where("k < 500").select((F.col("k") * 2).alias("k"), F.lit("new").alias("v")), "k")


@query(f"WITH {USER_EDGES_SQL} SELECT source, target FROM edges WHERE source NOT IN ({SEEDS[0]}, {SEEDS[1]}, {SEEDS[2]}) AND target NOT IN ({SEEDS[0]}, {SEEDS[1]}, {SEEDS[2]})")
def k5_delete_edges(spark, sf_dir):
    e = b.user_edges(spark, sf_dir).select("source", "target")
    return graph.update(e, _seed_nodes(spark), e.limit(0))


@query("SELECT doc_id AS id, CASE source WHEN 'src1' THEN 'moved/one' WHEN 'src2' THEN 'moved/two' ELSE source END AS file_path FROM documents")
def k6_rename(spark, sf_dir):
    from corvane.operators.lookups import rename

    moves = spark.createDataFrame([("src1", "moved/one"), ("src2", "moved/two")], "old_path string, new_path string")
    return rename(read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("file_path")), moves)


# hierarchies


@query("""WITH p AS (SELECT regexp_replace(url, '^https?://', '') AS path FROM pages), s AS (SELECT string_split(path, '/') AS x FROM p), e AS (SELECT x, unnest(range(1, len(x) + 1)) AS n FROM s)
SELECT array_to_string(x[1:n], '/') AS path, CASE WHEN n > 1 THEN array_to_string(x[1:n - 1], '/') END AS parent, CAST(n AS INTEGER) AS depth, n < len(x) AS is_dir, count(*) AS n_files FROM e WHERE n <= 3 GROUP BY ALL""")
def h1_tree(spark, sf_dir):
    return hierarchy.file_tree(read(spark, sf_dir, "pages").select(F.regexp_replace("url", "^https?://", "").alias("path")), 3)


# quality


def _metric(name: str):
    def run(spark, sf_dir):
        rows = b.ranked(spark, sf_dir)
        results = rows.where("rank <= 30")
        expected = rows.where("expected").select("task_id", "doc_id").distinct()
        return metrics.per_task(results, expected, 10, item="doc_id").select("task_id", F.round(name, 6).alias(name))

    return run


METRIC_SQL = f"""WITH {RANKED_SQL}, r AS (SELECT *, sum(CASE WHEN expected THEN 1 ELSE 0 END) OVER (PARTITION BY task_id ORDER BY rank) AS so_far FROM ranked WHERE rank <= 30),
f AS (SELECT task_id, count(*) AS n, count(*) FILTER (expected) AS hits, min(rank) FILTER (expected) AS first, coalesce(sum(1 / log2(rank + 1)) FILTER (expected AND rank <= 10), 0) AS dcg, coalesce(sum(so_far / rank) FILTER (expected), 0) AS gains FROM r GROUP BY task_id),
m AS (SELECT task_id, count(*) AS m FROM ranked WHERE expected GROUP BY task_id), x AS (SELECT task_id, coalesce(n, 0) AS n, coalesce(hits, 0) AS hits, first, dcg, gains, coalesce(m, 0) AS m FROM f FULL JOIN m USING (task_id)),
v AS (SELECT task_id, CASE WHEN m > 0 THEN hits / m ELSE 0 END AS recall, CASE WHEN n > 0 THEN hits / n ELSE 0 END AS precision, coalesce(1.0 / first, 0) AS mrr, CASE WHEN m > 0 THEN dcg / list_sum(list_transform(range(1, greatest(least(m, 10), 1) + 1), lambda i: 1 / log2(i + 1))) ELSE 0 END AS ndcg, CASE WHEN m > 0 THEN gains / m ELSE 0 END AS map FROM x),
w AS (SELECT *, CASE WHEN recall + precision > 0 THEN 2 * recall * precision / (recall + precision) ELSE 0 END AS f1 FROM v)
SELECT task_id, round({{}}::DOUBLE, 6) AS {{}} FROM w"""
for _key, _name in (("m1_recall", "recall"), ("m2_precision", "precision"), ("m3_f1", "f1"), ("m4_mrr", "mrr"), ("m5_ndcg", "ndcg"), ("m6_map", "map")):
    _run = _metric(_name)
    _run.__name__ = _key
    query(METRIC_SQL.format(_name, _name))(_run)


@query(f"WITH {RESULTS_SQL}, u AS (SELECT strategy, task_id, unnest(['recall', 'precision']) AS metric, unnest([recall, precision]) AS value FROM results WHERE task_id NOT IN (3, 4)) SELECT *, CASE WHEN metric = 'recall' THEN CASE WHEN strategy = 'A' THEN 0.52 ELSE 0.5 END ELSE 0.4 END::DOUBLE AS threshold FROM u WHERE value < CASE WHEN metric = 'recall' THEN CASE WHEN strategy = 'A' THEN 0.52 ELSE 0.5 END ELSE 0.4 END")
def m12_gate(spark, sf_dir):
    return metrics.gate(b.results(spark, sf_dir), {"recall": 0.5, "precision": 0.4}, [3, 4], {"A": {"recall": 0.52}}).select("strategy", "task_id", "metric", "value", "threshold")


@query("WITH r AS (SELECT o_orderkey AS task_id, o_orderstatus <> 'P' AS correct, o_totalprice / 100000 AS speedup FROM orders) SELECT task_id, 'incorrect' AS reason FROM r WHERE NOT correct UNION ALL SELECT task_id, 'slow' FROM r WHERE speedup < 1.5")
def m14_delta_gate(spark, sf_dir):
    runs = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("task_id"), (F.col("o_orderstatus") != "P").alias("correct"), (F.col("o_totalprice") / 100000).alias("speedup"))
    return metrics.delta_gate(runs)


@query("SELECT l_orderkey AS task_id, max(l_extendedprice) AS wall_ms FROM lineitem GROUP BY 1 HAVING max(l_extendedprice) > 5000")
def m13_latency(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("task_id")).agg(F.max("l_extendedprice").alias("wall_ms"))
    return metrics.slow(rows)
