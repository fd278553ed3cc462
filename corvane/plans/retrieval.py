"""Queries over full-text and dense retrieval, fusion and context assembly."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.functions import text
from corvane.operators import context, graph, lookups, retrieval, vectors
from corvane.plans.registry import query, read
from corvane.sources import bindings as b
from corvane.sources.bindings import CHUNKS_SQL, PAGE_EDGES_SQL, USER_EDGES_SQL

TOKENS_SQL = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+')"
TERMS = ["the", "token", "eaux", "idiot"]


def _list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


@query(f"SELECT doc_id, CAST(len(t) AS BIGINT) AS n_tokens, CAST(len(list_distinct(t)) AS BIGINT) AS n_terms FROM (SELECT doc_id, {TOKENS_SQL.format('text')} AS t FROM documents)")
def b1_tokens(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select("doc_id", text.tokens(F.col("text")).alias("t"))
    return rows.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_terms"))


@query()
def b1_stem(spark, sf_dir):
    """Stems of all texts and how often they stand; the stemmer has no twin in SQL."""
    rows = read(spark, sf_dir, "documents").select(F.explode(text.stemmed(text.tokens(F.col("text")))).alias("stem"))
    return rows.groupBy("stem").agg(F.count("*").alias("n"))


IDENT = "[A-Za-z_][A-Za-z0-9_]{2,}"
NAMES_SQL = f"""names AS (SELECT doc_id, regexp_extract_all(regexp_replace(text, '([a-z])e ([a-z])', '\\1E\\2', 'g'), '{IDENT}') AS ids FROM documents)"""


@query(f"""WITH {NAMES_SQL}, w AS (SELECT doc_id, unnest(string_split(regexp_replace(regexp_replace(array_to_string(ids, ' '), '([a-z0-9])([A-Z])', '\\1_\\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1_\\2', 'g'), ' ')) AS w FROM names),
p AS (SELECT DISTINCT doc_id, unnest(string_split(lower(w), '_')) AS p FROM w WHERE contains(w, '_'))
SELECT d.doc_id, coalesce(string_agg(p, ' ' ORDER BY p) FILTER (length(p) > 1), '') AS fragments FROM documents d LEFT JOIN p USING (doc_id) GROUP BY d.doc_id""")
def b3_identifiers(spark, sf_dir):
    """Fragments of the identifiers in texts whose word ends in e were glued to the next word in camel case."""
    glued = F.regexp_replace("text", "([a-z])e ([a-z])", "$1E$2")
    return read(spark, sf_dir, "documents").select("doc_id", F.array_join(text.fragments(text.identifiers(glued)), " ").alias("fragments"))


CLEAN_SQL = f"list_filter(list_transform(list_filter(regexp_split_to_array(trim(text), '\\s+'), lambda w: w <> ''), lambda w: regexp_replace(w, '[^A-Za-z0-9_.]', '', 'g')), lambda w: w <> '' AND NOT list_contains({_list(text.SEARCH_STOP)}, lower(w)))"


@query(f"SELECT item_id, array_to_string({CLEAN_SQL}, ' ') AS terms FROM benchmark")
def b4_sanitize(spark, sf_dir):
    return read(spark, sf_dir, "benchmark").select("item_id", F.array_join(text.search_terms(F.col("text")), " ").alias("terms"))


@query(f"SELECT term, doc_id AS id, count(*) AS tf FROM (SELECT doc_id, unnest({TOKENS_SQL.format('text')}) AS term FROM documents) GROUP BY ALL")
def b6_postings(spark, sf_dir):
    return retrieval.postings(b.chunks(spark, sf_dir)).select("term", "id", "tf")


def _bm25_sql(terms: list[str], where: str = "TRUE") -> str:
    """Shares of each term by chunk: bm(id, i, share) over documents."""
    return f"""t AS (SELECT doc_id AS id, {TOKENS_SQL.format('text')} AS t FROM documents WHERE {where}),
st AS (SELECT count(*) AS n, avg(len(t)) AS mean FROM t),
tf AS (SELECT id, len(t) AS len, unnest({_list(terms)}) AS term, unnest(range({len(terms)})) AS i, t FROM t),
f AS (SELECT id, len, i, len(list_filter(t, lambda x: x = term)) AS f FROM tf),
df AS (SELECT i, count(*) AS df FROM f WHERE f > 0 GROUP BY i),
bm AS (SELECT id, i, CASE WHEN ln((n - df + 0.5) / (df + 0.5)) > 0 THEN ln((n - df + 0.5) / (df + 0.5)) ELSE 1e-6 END * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len / mean)) AS share
       FROM f JOIN df USING (i) CROSS JOIN st WHERE f > 0)"""


#: Stored indexes of this application, by the files they were made of.
_BUILT: dict[tuple, retrieval.TextIndex] = {}


def _made_of(rows) -> tuple:
    """What names the content of a table's files: path, size and time of each."""
    seen = rows.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
    return tuple(seen.agg(F.sum(F.xxhash64(*seen.columns).cast("decimal(38,0)")), F.count("*")).first())


def _index(spark, sf_dir) -> retrieval.TextIndex:
    """The inverted index of all documents, built by the first question and kept for the others while the files stay as they are."""
    name = spark.sparkContext.applicationId, sf_dir, _made_of(read(spark, sf_dir, "documents"))
    if name not in _BUILT:
        _BUILT[name] = retrieval.TextIndex.build(b.chunks(spark, sf_dir), {"content": 1.0})
    return _BUILT[name]


@query(f"SELECT count(*) AS texts, round(avg(len(t)), 4) AS mean, CAST(sum(len(list_distinct(t))) AS BIGINT) AS postings FROM (SELECT {TOKENS_SQL.format('text')} AS t FROM documents)")
def b6_index(spark, sf_dir):
    """Builds the inverted index that the questions below read, and says how large it is."""
    found = _index(spark, sf_dir)
    return found.postings.agg(F.lit(found.total).cast("long").alias("texts"), F.lit(round(found.mean, 4)).alias("mean"), F.count("term").alias("postings"))


@query(f"WITH {_bm25_sql(TERMS)} SELECT id, round(sum(share), 6) AS score FROM bm GROUP BY id ORDER BY 2 DESC, 1 LIMIT 50")
def search(spark, sf_dir):
    """The flagship: ranked retrieval of any of the terms."""
    return retrieval.or_search(_index(spark, sf_dir), TERMS, 50)


@query(f"WITH {_bm25_sql(TERMS)} SELECT id, round(sum(share), 6) AS score FROM bm GROUP BY id")
def b7_bm25(spark, sf_dir):
    rows = _index(spark, sf_dir).bm25(TERMS)
    return rows.select("id", F.round(F.aggregate("parts", F.lit(0.0), lambda a, x: a + x), 6).alias("score"))


@query(r"""WITH t AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS a, regexp_extract_all(lower(source || '/' || lang || '/' || doc_id), '[\p{L}\p{N}]+') AS p FROM documents),
f AS (SELECT id, len(a) + len(p) AS len, 3.0 * len(list_filter(a, lambda x: x = 'es')) + 1.0 * len(list_filter(p, lambda x: x = 'es')) AS f FROM t),
s AS (SELECT count(*) AS n, avg(len) AS mean, count(*) FILTER (f > 0) AS df FROM f)
SELECT id, round(CASE WHEN ln((n - df + 0.5) / (df + 0.5)) > 0 THEN ln((n - df + 0.5) / (df + 0.5)) ELSE 1e-6 END * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len / mean)), 6) AS score FROM f, s WHERE f > 0""")
def b7_bm25_fields(spark, sf_dir):
    """The same with weights by field."""
    rows = retrieval.bm25(b.chunks(spark, sf_dir), ["es"], {"content": 3.0, "file_path": 1.0})
    return rows.select("id", F.round(F.get("parts", F.lit(0)), 6).alias("score"))


GRADED = ["inonble", "thatea", "handre", "ereaing"]
PAIRS = [(0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3)]
TRIPLES = [(0, 1, 2), (0, 1, 3), (0, 2, 3), (1, 2, 3)]


def _subsets_sql(subsets) -> str:
    return "greatest(" + ", ".join("CASE WHEN " + " AND ".join(f"p{i} IS NOT NULL" for i in s) + " THEN " + " + ".join(f"p{i}" for i in s) + " END" for s in subsets) + ")"


@query(f"""WITH {_bm25_sql(GRADED)},
w AS (SELECT id, {", ".join(f"max(share) FILTER (i = {i}) AS p{i}" for i in range(4))}, sum(share) AS any_ FROM bm GROUP BY id),
s AS (SELECT id, CASE WHEN {" AND ".join(f"p{i} IS NOT NULL" for i in range(4))} THEN p0 + p1 + p2 + p3 END AS s0, {_subsets_sql(TRIPLES)} AS s1, {_subsets_sql(PAIRS)} AS s2, any_ FROM w),
c AS (SELECT CASE WHEN count(s0) >= 10 THEN 1 WHEN count(s1) >= 10 THEN 2 WHEN count(s2) >= 10 THEN 3 ELSE 4 END AS stage FROM s)
SELECT id, round(CASE stage WHEN 1 THEN s0 WHEN 2 THEN s1 WHEN 3 THEN greatest(s1, s2) ELSE greatest(any_, s1, s2) END, 6) AS score, stage FROM s, c
WHERE CASE stage WHEN 1 THEN s0 WHEN 2 THEN s1 WHEN 3 THEN greatest(s1, s2) ELSE any_ END IS NOT NULL ORDER BY score DESC, id LIMIT 30""")
def b8_graduated(spark, sf_dir):
    return retrieval.graduated(_index(spark, sf_dir), GRADED, 30)


PHRASES = [("of", "the"), ("the", "the", "and"), "es"]


def _phrase_sql(phrase) -> str:
    words = retrieval.unit_of(phrase)
    if len(words) == 1:
        return f"len(list_filter(t, lambda x: x = '{words[0]}'))"
    return "len(list_filter(range(1, len(t) + 1), lambda i: " + " AND ".join(f"t[i + {j}] = '{w}'" for j, w in enumerate(words)) + "))"


@query(f"SELECT id, n FROM (SELECT doc_id AS id, CAST({_phrase_sql(PHRASES[0])} AS DOUBLE) AS n FROM (SELECT doc_id, {TOKENS_SQL.format('text')} AS t FROM documents)) WHERE n > 0")
def b9_phrase(spark, sf_dir):
    """Words side by side, from positions in the stored index."""
    return _index(spark, sf_dir).phrase(list(PHRASES[0]))


@query(f"""WITH t AS (SELECT doc_id AS id, {TOKENS_SQL.format('text')} AS t FROM documents), st AS (SELECT count(*) AS n, avg(len(t)) AS mean FROM t),
f AS ({" UNION ALL ".join(f"SELECT id, len(t) AS len, {i} AS i, {_phrase_sql(p)} AS f FROM t" for i, p in enumerate(PHRASES))}), df AS (SELECT i, count(*) AS df FROM f WHERE f > 0 GROUP BY i)
SELECT id, round(sum(CASE WHEN ln((n - df + 0.5) / (df + 0.5)) > 0 THEN ln((n - df + 0.5) / (df + 0.5)) ELSE 1e-6 END * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len / mean))), 6) AS score
FROM f JOIN df USING (i) CROSS JOIN st WHERE f > 0 GROUP BY id""")
def b9_phrase_search(spark, sf_dir):
    """Ranked retrieval of phrases and words together."""
    rows = _index(spark, sf_dir).bm25(PHRASES)
    return rows.select("id", F.round(F.aggregate("parts", F.lit(0.0), lambda a, x: a + x), 6).alias("score"))


@query(r"""WITH s AS (SELECT p_partkey AS id, p_type AS kind, ' ' || array_to_string(regexp_extract_all(lower(p_brand || '::' || replace(p_name, ' ', '_') || '#' || p_type), '[\p{L}\p{N}]+'), ' ') || ' ' AS t FROM part)
SELECT id, kind FROM s WHERE contains(t, ' red widget ') AND kind = 'ECONOMY' ORDER BY id LIMIT 25""")
def f8_symbol_index(spark, sf_dir):
    """Symbols whose names hold the words side by side, read from an index of names."""
    rows = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("kind"), F.concat("p_brand", F.lit("::"), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("#"), "p_type").alias("content"))
    names = retrieval.TextIndex.build(rows)
    return lookups.narrowed(rows.join(names.phrase(["red", "widget"]).select("id"), "id", "left_semi"), "ECONOMY", 25).select("id", "kind")


STEMS_SQL = "list_distinct(list_concat(base, list_filter(flatten(list_transform(base, lambda w: list_transform(" + _list(text.STEM_SUFFIXES) + ", lambda s: CASE WHEN ends_with(w, s) AND length(w) - length(s) >= 4 THEN left(w, length(w) - length(s)) END))), lambda x: x IS NOT NULL)))"


@query(f"SELECT item_id, array_to_string(list_sort({STEMS_SQL}), ' ') AS terms FROM (SELECT item_id, list_filter(list_transform(regexp_extract_all(text, '{IDENT}'), lambda w: lower(w)), lambda w: length(w) >= 4 AND NOT list_contains({_list(text.PATH_NOISE)}, w)) AS base FROM benchmark)")
def b10_path_terms(spark, sf_dir):
    return read(spark, sf_dir, "benchmark").select("item_id", F.array_join(F.array_sort(text.path_terms(F.col("text"))), " ").alias("terms"))


PATH_TERMS = ["src7/", "/es", "src1"]


@query(f"""WITH {CHUNKS_SQL}, hits AS (SELECT id FROM chunks WHERE contains(content, 'token = ')),
m AS (SELECT id, i, row_number() OVER (PARTITION BY i ORDER BY id) AS n FROM (SELECT id, file_path, unnest({_list(PATH_TERMS)}) AS term, unnest(range(3)) AS i FROM chunks) WHERE contains(lower(file_path), term) QUALIFY n <= 20)
SELECT id, 2.0::DOUBLE AS score FROM (SELECT id, min((i, n)) AS first FROM m WHERE id NOT IN (SELECT id FROM hits) GROUP BY id ORDER BY first, id LIMIT 30)""")
def b11_path_boost(spark, sf_dir):
    chunks = b.chunks(spark, sf_dir)
    return retrieval.path_boost(chunks, PATH_TERMS, chunks.where(F.contains("content", F.lit("token = "))).select("id"), 4.0)


@query("""WITH s AS (SELECT p_partkey AS id, p_name AS name, p_brand || '.' || p_name AS qname FROM part), x AS (SELECT id, CASE WHEN lower(name) = 'part 12' THEN 6.0 WHEN contains(lower(name), 'part 12') OR contains(lower(qname), 'part 12') THEN 1.5 END AS score FROM s)
SELECT id, score::DOUBLE AS score FROM x WHERE score IS NOT NULL""".replace("part 12", "red widget"))
def b12_symbol_scores(spark, sf_dir):
    s = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.concat_ws(".", "p_brand", "p_name").alias("qname"))
    return s.select("id", retrieval.symbol_score(F.col("name"), F.col("qname"), F.lit("red widget"), 10.0).alias("score")).where("score IS NOT NULL")


SEEDED = "Where is the red widget or the small gizmo of a connection?"


@query(f"""WITH s AS (SELECT p_partkey AS id, lower(replace(p_name, ' ', '_')) AS name, lower(p_brand || '.' || replace(p_name, ' ', '_')) AS qname FROM part), q AS (SELECT unnest({_list(retrieval.symbol_phrases(SEEDED, text.SYMBOL_NOISE))}) AS phrase),
x AS (SELECT id, phrase, CASE WHEN name = phrase THEN 6.0 WHEN contains(name, phrase) OR contains(qname, phrase) THEN 1.5 END AS score FROM s, q),
n AS (SELECT id, score, row_number() OVER (PARTITION BY phrase ORDER BY id) AS n FROM x WHERE score IS NOT NULL)
SELECT id, max(score)::DOUBLE AS score FROM n WHERE n <= 20 GROUP BY id ORDER BY score DESC, id LIMIT 20""")
def b12_symbol_seeds(spark, sf_dir):
    """Symbols a question names: neighbours joined by an underscore, and long words."""
    name = F.replace("p_name", F.lit(" "), F.lit("_"))
    s = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), name.alias("symbol_name"), F.concat_ws(".", "p_brand", name).alias("qualified_name"))
    return retrieval.symbol_seeds(s, retrieval.symbol_phrases(SEEDED, text.SYMBOL_NOISE), 10.0)


@query("""WITH u AS (SELECT doc_id AS id, n_chars AS score, 0 AS p FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, -n_chars, 1 FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id, 0, 2 FROM labels)
SELECT id, arg_min(score, p) AS score, CAST(min(p) AS INTEGER) AS priority FROM u GROUP BY id""")
def b13_combined(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("n_chars").alias("score"))
    third = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.lit(0).cast("long").alias("score"))
    return retrieval.first_source(d.where("id % 2 = 0"), d.where("id % 3 = 0").withColumn("score", -F.col("score")), third)


SYN_SQL = "CASE w " + " ".join(f"WHEN '{k}' THEN {_list(v)}" for k, v in text.SYNONYMS.items()) + " ELSE [] END"
QUESTION = "lang || 'Routing of the query pipeline_' || source || ' session ' || doc_id"


@query(f"""WITH q AS (SELECT doc_id, regexp_extract_all({QUESTION}, '{IDENT}') AS ids FROM documents),
c AS (SELECT doc_id, list_filter(flatten(list_transform(ids, lambda w: list_concat([lower(w)], list_filter(CASE WHEN contains(w, '_') THEN string_split(lower(w), '_') ELSE string_split(lower(regexp_replace(w, '([a-z0-9])([A-Z])', '\\1_\\2', 'g')), '_') END, lambda p: length(p) > 1 AND p <> lower(w))))), lambda w: length(w) > 2 AND NOT list_contains({_list(text.QUERY_STOP)}, w)) AS p FROM q)
SELECT doc_id, array_to_string(list_sort(list_distinct(list_concat(list_concat(p, list_transform(range(1, len(p)), lambda i: p[i] || '_' || p[i + 1])), flatten(list_transform(p, lambda w: {SYN_SQL}))))), ' ') AS terms FROM c""")
def b15_query_terms(spark, sf_dir):
    q = F.concat("lang", F.lit("Routing of the query pipeline_"), "source", F.lit(" session "), F.col("doc_id").cast("string"))
    return read(spark, sf_dir, "documents").select("doc_id", F.array_join(text.query_terms(q), " ").alias("terms"))


@query(f"SELECT doc_id, list_has_any([k for k in {_list(text.SYNONYMS)} if contains(lower(text), k)], {_list(text.SYNONYMS)}) AS architecture FROM documents")
def b16_architecture(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", text.is_architecture_question(F.col("text")).alias("architecture"))


WORDS = ["idiot", "token", "Eauxre"]


@query(f"SELECT doc_id AS id, CAST(list_min([i for i in [0, 1, 2] if contains(lower(text), lower({_list(WORDS)}[i + 1]))]) AS INTEGER) AS first FROM documents WHERE " + " OR ".join(f"contains(lower(text), '{w.lower()}')" for w in WORDS))
def b18_grep(spark, sf_dir):
    return retrieval.grep(b.chunks(spark, sf_dir), WORDS)


@query(f"SELECT item_id, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9_]+'), lambda w: length(w) > 2 AND NOT list_contains({_list(text.KEYWORD_STOP)}, w)))), ' ') AS words FROM benchmark")
def b19_keywords(spark, sf_dir):
    return read(spark, sf_dir, "benchmark").select("item_id", F.array_join(F.array_sort(text.keywords(F.col("text"))), " ").alias("words"))


# dense retrieval

DOT = "list_dot_product(list_transform(e.embedding, lambda x: CAST(x AS DOUBLE)), list_transform(q.embedding, lambda x: CAST(x AS DOUBLE)))"


def _query_vector(spark, sf_dir) -> list[float]:
    return read(spark, sf_dir, "embeddings").where("vec_id = 0").first()["embedding"]


DENSE_SQL = f"dense AS (SELECT e.vec_id AS id, {DOT} / sqrt(list_dot_product(list_transform(q.embedding, lambda x: CAST(x AS DOUBLE)), list_transform(q.embedding, lambda x: CAST(x AS DOUBLE)))) AS score FROM embeddings e, embeddings q WHERE q.vec_id = 0)"


@query(f"WITH {DENSE_SQL}, top AS (SELECT * FROM dense ORDER BY score DESC, id LIMIT 40) SELECT id, round(score, 5) AS score FROM top WHERE score > 0")
def t2_vector_topk(spark, sf_dir):
    return vectors.top_k(read(spark, sf_dir, "embeddings"), _query_vector(spark, sf_dir), 40).select("id", F.round("score", 5).alias("score"))


@query("""WITH n AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), q AS (SELECT vec_id AS query, v AS w FROM n WHERE vec_id < 8),
x AS (SELECT query, vec_id AS id, list_dot_product(v, w) / sqrt(list_dot_product(v, v) * list_dot_product(w, w)) AS score FROM n, q)
SELECT query, id, round(score, 5) AS score FROM x WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, id) <= 10""")
def v3_search_blocks(spark, sf_dir):
    """The ten nearest stored vectors of eight queries at once, a matrix product a batch."""
    stored = read(spark, sf_dir, "embeddings")
    queries = [r["embedding"] for r in stored.where("vec_id < 8").orderBy("vec_id").collect()]
    return vectors.search_blocks(stored, queries, 10, key="vec_id").select("query", "id", F.round("score", 5).alias("score"))


@query(f"WITH {DENSE_SQL}, first AS (SELECT vec_id FROM embeddings WHERE label = 3 ORDER BY vec_id LIMIT 50), top AS (SELECT * FROM dense WHERE id IN (SELECT vec_id FROM first) ORDER BY score DESC, id LIMIT 10) SELECT id, round(score, 5) AS score FROM top WHERE score > 0")
def t3_rerank(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings")
    hits = e.where("label = 3").select(F.col("vec_id").alias("id"), (-F.col("vec_id")).alias("score"))
    return vectors.rerank(hits, e, _query_vector(spark, sf_dir), 10).select("id", F.round("score", 5).alias("score"))


@query("SELECT vec_id, round(sqrt(list_dot_product(v, v)), 5) AS norm, round(v[1] / greatest(sqrt(list_dot_product(v, v)), 1e-9), 5) AS first FROM (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings)")
def v1_normalise(spark, sf_dir):
    return read(spark, sf_dir, "embeddings").select("vec_id", F.round(vectors.norm(F.col("embedding")), 5).alias("norm"), F.round(F.get(vectors.normalised(F.col("embedding")), F.lit(0)), 5).alias("first"))


@query("""WITH h AS (SELECT doc_id AS id, sha256(text) AS h FROM documents), v AS (SELECT id, list_transform(range(32), lambda i: CAST('0x' || substr(h, CAST(2 * i + 1 AS BIGINT), 2) AS INTEGER) / 255.0::DOUBLE * 2 - 1) AS v FROM h)
SELECT id, 64 AS n, round(v[1] / sqrt(2 * list_dot_product(v, v)), 5) AS first FROM v""")
def v10_hash_embedder(spark, sf_dir):
    return vectors.embed(b.chunks(spark, sf_dir), F.col("content")).select("id", F.size("embedding").alias("n"), F.round(F.get("embedding", F.lit(0)), 5).alias("first"))


LISTS_SQL = """lex AS (SELECT doc_id AS id, n_chars AS score, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS a FROM documents QUALIFY a <= 40),
den AS (SELECT doc_id AS id, doc_id % 97 AS score, row_number() OVER (ORDER BY doc_id % 97 DESC, doc_id) AS b FROM documents QUALIFY b <= 40)"""


def _lists(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "n_chars", "source")
    lex = d.select("id", F.col("n_chars").alias("score"), "source").orderBy(F.desc("score"), "id").limit(40)
    den = d.select("id", (F.col("id") % 97).alias("score"), "source").orderBy(F.desc("score"), "id").limit(40)
    return lex, den


@query(f"WITH {LISTS_SQL} SELECT id, round(coalesce(1.0 / (60 + a), 0) + coalesce(1.0 / (60 + b), 0), 6) AS score FROM lex FULL JOIN den USING (id)")
def w1_rrf(spark, sf_dir):
    return vectors.fused(*_lists(spark, sf_dir)).select("id", F.round("score", 6).alias("score"))


AGREE_SQL = f"""{LISTS_SQL}, x AS (SELECT list(DISTINCT source) AS x FROM lex JOIN documents ON doc_id = id WHERE a <= 20), y AS (SELECT list(DISTINCT source) AS y FROM den JOIN documents ON doc_id = id WHERE b <= 20),
ag AS (SELECT len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))) AS agreement FROM x, y),
cv AS (SELECT stddev_pop(score) / avg(score) AS cv FROM lex WHERE a <= 10)"""


@query(f"WITH {AGREE_SQL}, w AS (SELECT CASE WHEN agreement > 0.7 THEN 0.85 WHEN agreement >= 0.3 THEN CASE WHEN cv > 0.3 THEN 0.5 ELSE 0.4 END ELSE 0.35 END AS w FROM ag, cv) SELECT id, round(coalesce(w / (60 + a), 0) + coalesce((1 - w) / (60 + b), 0), 6) AS score FROM lex FULL JOIN den USING (id), w")
def w2_weighted_rrf(spark, sf_dir):
    lex, den = _lists(spark, sf_dir)
    shared, cv = vectors.agreement(lex, den, column="source"), vectors.variation(lex)
    w = shared.join(cv).select(vectors.weights(F.col("agreement"), F.col("cv"))).first()[0]
    return vectors.fused(lex, den, (w, 1 - w)).select("id", F.round("score", 6).alias("score"))


@query(f"WITH {AGREE_SQL} SELECT round(agreement, 6) AS agreement FROM ag")
def a11_jaccard(spark, sf_dir):
    return vectors.agreement(*_lists(spark, sf_dir), column="source").select(F.round("agreement", 6).alias("agreement"))


@query(f"WITH {AGREE_SQL} SELECT round(cv, 6) AS cv FROM cv")
def a12_cv(spark, sf_dir):
    return vectors.variation(_lists(spark, sf_dir)[0]).select(F.round("cv", 6).alias("cv"))


@query(f"WITH {AGREE_SQL} SELECT NOT ((SELECT count(*) FROM lex) < 3 OR (SELECT count(*) FROM den) < 3 OR (cv > 0.5 AND agreement > 0.6)) AS fuse FROM ag, cv")
def v6_gate(spark, sf_dir):
    lex, den = _lists(spark, sf_dir)
    rows = vectors.agreement(lex, den, column="source").join(vectors.variation(lex)).join(lex.agg(F.count("*").alias("n"))).join(den.agg(F.count("*").alias("m")))
    return rows.select(vectors.fuse_wanted(F.col("n"), F.col("m"), F.col("agreement"), F.col("cv")).alias("fuse"))


@query(f"WITH {CHUNKS_SQL}, w AS (SELECT id, unnest(regexp_extract_all(content, '{IDENT}')) AS x, unnest(range(len(regexp_extract_all(content, '{IDENT}')))) AS p FROM chunks), f AS (SELECT id, x, min(p) AS p FROM w GROUP BY id, x QUALIFY row_number() OVER (PARTITION BY id ORDER BY min(p)) <= 8) SELECT chunks.id, coalesce(string_agg(x, ' ' ORDER BY p), '') AS anchors FROM chunks LEFT JOIN f USING (id) GROUP BY chunks.id")
def v9_anchors(spark, sf_dir):
    return b.chunks(spark, sf_dir).select("id", F.array_join(text.anchors(F.col("content")), " ").alias("anchors"))


@query(f"""WITH {CHUNKS_SQL}, w AS (SELECT id, unnest(regexp_extract_all(content, '{IDENT}')) AS x, unnest(range(len(regexp_extract_all(content, '{IDENT}')))) AS p FROM chunks), f AS (SELECT id, x, min(p) AS p FROM w GROUP BY id, x QUALIFY row_number() OVER (PARTITION BY id ORDER BY min(p)) <= 8), a AS (SELECT chunks.id, coalesce(string_agg(x, ', ' ORDER BY p), '') AS a FROM chunks LEFT JOIN f USING (id) GROUP BY chunks.id)
SELECT id, 'path: ' || file_path || chr(10) || 'language: ' || language || chr(10) || 'lines: 1-' || end_line || chr(10) || 'anchors: ' || a AS surrogate FROM chunks JOIN a USING (id)""")
def v8_surrogate(spark, sf_dir):
    rows = b.chunks(spark, sf_dir)
    return rows.select("id", vectors.surrogate(rows).alias("surrogate"))


# context

SEEDS_SQL = f"{USER_EDGES_SQL}, seeds AS (SELECT file, round(s / max(s) OVER (), 6) AS score FROM (SELECT user_id AS file, sum(value) AS s FROM events GROUP BY user_id ORDER BY round(s, 4) DESC, file LIMIT 20))"


def _seeds(spark, sf_dir):
    """The seeds of a question: the best twenty, over the best one."""
    s = read(spark, sf_dir, "events").groupBy(F.col("user_id").alias("file")).agg(F.sum("value").alias("score")).orderBy(F.desc(F.round("score", 4)), "file").limit(20)
    return context.normalised(s).select("file", F.round("score", 6).alias("score"))


@query(f"""WITH {SEEDS_SQL}, strong AS (SELECT file FROM seeds WHERE score >= 0.05),
r AS (SELECT target AS file, CASE WHEN target % 5 = 0 THEN 1.5 ELSE 1.0 END AS p FROM edges WHERE source IN (SELECT file FROM strong) UNION ALL SELECT source, CASE WHEN source % 5 = 0 THEN 0.75 ELSE 0.5 END FROM edges WHERE target IN (SELECT file FROM strong))
SELECT file, max(p)::DOUBLE AS priority FROM r WHERE file NOT IN (SELECT file FROM seeds) GROUP BY file""")
def c5_priority(spark, sf_dir):
    return context.priorities(b.user_edges(spark, sf_dir), _seeds(spark, sf_dir), F.col("file") % 5 == 0)


@query(f"""WITH {SEEDS_SQL}, r AS (SELECT target AS file, score * 0.65 * CASE WHEN target % 5 = 0 THEN 1.3 ELSE 1.0 END AS x FROM edges JOIN seeds ON source = file UNION ALL SELECT source, score * 0.20 FROM edges JOIN seeds ON target = file)
SELECT file, round(max(x), 5) AS boost FROM r GROUP BY file""")
def c8_neighbor_boost(spark, sf_dir):
    return context.neighbour_boost(b.user_edges(spark, sf_dir), _seeds(spark, sf_dir), F.col("file") % 5 == 0).select("file", F.round("boost", 5).alias("boost"))


@query("SELECT l_orderkey, l_linenumber, round((0.80 * l_discount * 10 + 0.08 * l_tax * 10 + 0.04 * CASE WHEN l_returnflag = 'R' THEN 0.5 ELSE 0 END + 0.08 * l_quantity / 50) * CASE WHEN l_linestatus = 'F' THEN 0.6 ELSE 1 END, 6) AS score FROM lineitem")
def c10_score(spark, sf_dir):
    c = F.col
    score = context.final_score(c("l_discount") * 10, c("l_tax") * 10, F.when(c("l_returnflag") == "R", context.TYPE_COVERAGE).otherwise(0.0), c("l_quantity") / 50, c("l_linestatus") == "F")
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(score, 6).alias("score"))


@query("""WITH t AS (SELECT o_custkey % 40 AS f, round(sum(o_totalprice / 1000 * CASE WHEN o_custkey % 40 < 2 THEN 5 ELSE 1 END), 3) AS total FROM orders GROUP BY 1),
p AS (SELECT *, row_number() OVER (ORDER BY total DESC, f) AS place, count(*) OVER () AS n, max(total) OVER () AS top FROM t), m AS (SELECT *, max(CASE WHEN place = n // 2 + 1 THEN total END) OVER () AS median FROM p)
SELECT f, round(total, 2) AS total FROM m WHERE place <= CASE WHEN n < 3 THEN n WHEN top / median > 5 THEN 4 WHEN top / median > 3 THEN 5 ELSE 8 END AND total >= 0.15 * top""")
def w8_file_cut(spark, sf_dir):
    f = F.col("o_custkey") % 40
    rows = read(spark, sf_dir, "orders").select(f.alias("f"), (F.col("o_totalprice") / 1000 * F.when(f < 2, 5).otherwise(1)).alias("s"))
    return context.file_cut(rows, "f", "s").select("f", F.round("total", 2).alias("total"))


@query(f"""WITH RECURSIVE {CHUNKS_SQL}, {_bm25_sql(TERMS)}, hit AS (SELECT id, round(sum(share), 6) AS score FROM bm GROUP BY id ORDER BY 2 DESC, 1 LIMIT 100),
c AS (SELECT id, score, token_count, row_number() OVER (ORDER BY score DESC, id) AS r FROM hit JOIN chunks USING (id)),
top AS (SELECT max(score) AS top FROM c),
fold AS (SELECT CAST(0 AS BIGINT) AS r, CAST(0 AS BIGINT) AS used, false AS taken UNION ALL
  SELECT c.r, CASE WHEN score >= 0.3 * top AND used + token_count <= 8192 THEN used + token_count ELSE used END, score >= 0.3 * top AND used + token_count <= 8192 FROM fold JOIN c ON c.r = fold.r + 1, top)
SELECT c.id, score, token_count FROM c JOIN fold USING (r) WHERE taken""")
def t9_pack(spark, sf_dir):
    """The best hundred hits of a question, packed into its budget."""
    rows = retrieval.or_search(_index(spark, sf_dir), TERMS, 100).join(b.chunks(spark, sf_dir).select("id", "token_count"), "id")
    return context.pack(rows, 8192)


@query("SELECT doc_id, CAST(CASE WHEN n_chars <= 2000 THEN n_chars WHEN n_chars >= 6000 THEN 2000 ELSE floor(n_chars - (n_chars - 2000) * ((n_chars - 2000) / 4000)) END AS BIGINT) AS budget FROM documents")
def c16_budget(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", context.effective_budget(F.col("n_chars"), 2000).alias("budget"))


@query(f"SELECT doc_id, CAST(floor({b.WORDS_SQL} * 13 / 10) AS BIGINT) AS tokens FROM documents")
def c17_estimate(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", text.estimated_tokens(F.col("text")).alias("tokens"))


def _bundle_sql(rounds: int) -> str:
    """The same question in SQL: hits, ranks of letters of hosts, scores, the best sources, and the fold of the budget."""
    ranks = ["edges AS (SELECT DISTINCT substr(source, 1, 1) AS source, substr(target, 2, 1) AS target FROM pages_)", "nodes AS (SELECT source AS node FROM edges UNION SELECT target FROM edges)", "deg AS (SELECT source AS node, count(*) AS out FROM edges GROUP BY source)", "r0 AS (SELECT node, 1.0::DOUBLE / (SELECT count(*) FROM nodes) AS rank FROM nodes)"]
    for i in range(1, rounds + 1):
        ranks.append(
            f"""r{i} AS MATERIALIZED (SELECT nodes.node, 0.85 * (coalesce(g.given, 0) + (SELECT coalesce(sum(rank), 0) FROM r{i - 1} WHERE node NOT IN (SELECT node FROM deg)) / (SELECT count(*) FROM nodes)) + 0.15 / (SELECT count(*) FROM nodes) AS rank
FROM nodes LEFT JOIN (SELECT target AS node, sum(rank / out) AS given FROM edges JOIN r{i - 1} ON source = r{i - 1}.node JOIN deg ON deg.node = source GROUP BY target) g ON g.node = nodes.node)"""
        )
    return f"""WITH RECURSIVE {CHUNKS_SQL}, {_bm25_sql(TERMS)}, hit AS (SELECT id, round(sum(share), 6) AS score FROM bm GROUP BY id ORDER BY 2 DESC, 1 LIMIT 100),
{PAGE_EDGES_SQL.replace("edges AS", "pages_ AS", 1)}, {", ".join(ranks)}, letter AS (SELECT lower(node) AS node, max(rank) AS rank FROM r{rounds} GROUP BY 1),
sc AS (SELECT id, source, token_count, round(0.80 * score / (SELECT max(score) FROM hit) + 0.08 * coalesce(rank, 0), 6) AS score FROM hit JOIN chunks USING (id) LEFT JOIN letter ON substr(source, 1, 1) = letter.node),
tot AS (SELECT source, round(sum(score), 6) AS total FROM sc GROUP BY source), pl AS (SELECT *, row_number() OVER (ORDER BY total DESC, source) AS place, count(*) OVER () AS n, max(total) OVER () AS top FROM tot),
md AS (SELECT *, max(CASE WHEN place = n // 2 + 1 THEN total END) OVER () AS median FROM pl),
cut AS (SELECT source FROM md WHERE place <= CASE WHEN n < 3 THEN n WHEN median > 0 AND top / median > 5 THEN 4 WHEN median > 0 AND top / median > 3 THEN 5 ELSE 8 END AND total >= 0.15 * top),
c AS (SELECT id, score, token_count, row_number() OVER (ORDER BY score DESC, id) AS r FROM sc WHERE source IN (SELECT source FROM cut)), best AS (SELECT max(score) AS top FROM c),
fold AS (SELECT CAST(0 AS BIGINT) AS r, CAST(0 AS BIGINT) AS used, false AS taken UNION ALL
  SELECT c.r, CASE WHEN score >= 0.3 * top AND used + token_count <= 8192 THEN used + token_count ELSE used END, score >= 0.3 * top AND used + token_count <= 8192 FROM fold JOIN c ON c.r = fold.r + 1, best)
SELECT c.id, score, token_count FROM c JOIN fold USING (r) WHERE taken"""


@query(_bundle_sql(10))
def context_bundle(spark, sf_dir):
    """One question from words to packed chunks: BM25, graph signals, scores, file cut, budget."""
    chunks = b.chunks(spark, sf_dir)
    hits = retrieval.or_search(_index(spark, sf_dir), TERMS, 100)
    rank = graph.page_rank(b.page_edges(spark, sf_dir).select(F.substring("source", 1, 1).alias("source"), F.substring("target", 2, 1).alias("target")).distinct(), rounds=10, tolerance=None)
    rows = hits.join(chunks.select("id", "file_path", "source", "token_count"), "id").join(F.broadcast(rank.groupBy(F.lower("node").alias("node")).agg(F.max("rank").alias("rank"))), F.substring("source", 1, 1) == F.col("node"), "left")
    scored = context.normalised(rows).select("id", "source", "token_count", F.round(context.final_score(F.col("score"), F.coalesce("rank", F.lit(0.0)), F.lit(0.0), F.lit(0.0), F.lit(False)), 6).alias("score"))
    files = context.file_cut(scored, "source")
    return context.pack(scored.join(files.select("source"), "source", "left_semi").select("id", "score", "token_count"), 8192)
