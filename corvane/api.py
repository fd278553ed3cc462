"""The engine's calls: index a tree of files, ask it, describe it, compare two."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.functions import render, text
from corvane.operators import analytics, context, graph, hierarchy, lookups, retrieval, vectors
from corvane.plans.index import Index, build
from corvane.plans.segments import Segments
from corvane.sources import files as sources
from corvane.sources.store import Store, materialise


@dataclass
class Answer:
    """An answer's chunks, the import graph among its files (source, targets), the types they define, and one row about it."""

    chunks: DataFrame
    structure: DataFrame
    types: DataFrame
    metadata: DataFrame


class Engine:
    """A session over one indexed tree; tables are written once and read back."""

    def __init__(self, spark: SparkSession, root: str, **options):
        self._begin(spark, sources.discover(spark, root, **options))

    @classmethod
    def of(cls, spark: SparkSession, files: DataFrame) -> Engine:
        """A session over files (path, language, content) that are a table already."""
        engine = cls.__new__(cls)
        engine._begin(spark, files)
        return engine

    def _begin(self, spark: SparkSession, files: DataFrame) -> None:
        found = build(materialise(files, "files"))
        self.spark = spark
        self.index = Index(found.files, *[materialise(getattr(found, n), n) for n in ("symbols", "imports", "edges", "chunks")])
        self._rank: DataFrame | None = None
        self._cohesion: DataFrame | None = None
        self._text: retrieval.TextIndex | None = None
        self._names: retrieval.TextIndex | None = None
        self._dense: dict = {}

    @classmethod
    def open(cls, spark: SparkSession, stored: str) -> Engine:
        """A session over the index stored under a folder, as its latest manifest has it."""
        return cls._over(spark, Segments(spark, stored))

    @classmethod
    def acquire(cls, spark: SparkSession, root: str, stored: str, **options) -> Engine:
        """A session over a tree whose index is kept under a folder: read where nothing changed, brought up to date where little did, else built anew (``way``)."""
        kept = Segments(spark, stored)
        way = kept.acquire(sources.discover(spark, root, **options))
        engine = cls._over(spark, kept)
        engine.way = way
        return engine

    @classmethod
    def _over(cls, spark: SparkSession, kept: Segments) -> Engine:
        engine, manifest = cls.__new__(cls), kept.catalog.head()
        engine.spark, engine.index, engine._text = spark, kept.index(manifest), kept.text_index(manifest)
        engine._rank, engine._cohesion, engine._names, engine._dense = None, None, None, {}
        return engine

    def rank(self) -> DataFrame:
        """node, rank of every file, isolated ones included; computed once."""
        if self._rank is None:
            self._rank = materialise(graph.page_rank(self.index.edges, self.index.files.select(F.col("path").alias("node")), tolerance=1e-6), "rank")
        return self._rank

    def save(self, root: str) -> Store:
        store = Store(self.spark, root)
        for name in ("files", "symbols", "imports", "edges", "chunks"):
            store.put(name, getattr(self.index, name))
        return store

    def text_index(self) -> retrieval.TextIndex:
        """The stored inverted index over chunks with their identifiers' parts, stemmed and without accents; built once."""
        if self._text is None:
            self._text = retrieval.TextIndex.build(self.index.chunks.withColumn("content", text.expanded(F.col("content"))), retrieval.FIELDS, analyse=text.analysed)
        return self._text

    def vectors(self, embedder: str) -> tuple:
        """The embedder (``words`` is fitted to the chunks) and the stored vectors of all chunks; made once."""
        if embedder not in self._dense:
            made = vectors.WordEmbedder(self.index.chunks) if embedder == "words" else embedder
            self._dense[embedder] = made, materialise(vectors.embed(self.index.chunks, F.col("content"), made), "vectors")
        return self._dense[embedder]

    def cohesion(self) -> DataFrame:
        """file_path, cohesion of the file's module; computed once."""
        if self._cohesion is None:
            own = materialise(self.members(), "members")
            self._cohesion = materialise(own.join(graph.cohesion(self.index.edges, own), "module").select(F.col("node").alias("file_path"), "cohesion"), "cohesion")
        return self._cohesion

    def _asked(self, question: str) -> dict:
        """What a question asks by: stems, path terms, names of symbols, words of the context, and whether it is about architecture."""
        words = text.search_terms(F.lit(question))
        found = self.spark.range(1).select(words.alias("words"), retrieval.longest_first(text.path_terms(F.lit(question))).alias("paths"), text.query_terms(F.lit(question)).alias("terms"), text.is_architecture_question(F.lit(question)).alias("architecture")).first()
        stems = self.spark.createDataFrame([(w,) for w in found["words"]], "w string").select(text.analysed(F.col("w")).alias("s")).collect() if found["words"] else []
        # a word of several parts (foo_bar, a.b) is a phrase
        return found.asDict() | {"stems": list(dict.fromkeys(tuple(r["s"]) for r in stems if r["s"])), "symbols": retrieval.symbol_phrases(question, text.SYMBOL_NOISE)}

    def seeds(self, asked: dict, k: int | None = None, embedder: str | None = None, question: str = "") -> DataFrame:
        """id, file_path, score (over the best): what the words find, then paths and symbols they name, fused with dense hits where these disagree."""
        chunks = self.index.chunks
        k = k or chunks.agg(retrieval.k_schedule(F.count("*"))).first()[0]
        lexical = retrieval.graduated(self.text_index(), asked["stems"], k).select("id", "score") if asked["stems"] else chunks.limit(0).select("id", F.lit(0.0).alias("score"))
        lexical = materialise(lexical.join(chunks.select("id", "file_path"), "id"), "lexical")
        top = lexical.agg(F.max("score")).first()[0]
        if embedder:
            made, stored = self.vectors(embedder)
            dense = materialise(vectors.search_texts(chunks, question, k, made, stored).join(chunks.select("id", "file_path"), "id"), "dense")
            shared, cv = vectors.agreement(lexical, dense).first()[0], vectors.variation(lexical).first()[0]
            gate = self.spark.range(1).select(vectors.fuse_wanted(F.lit(lexical.count()), F.lit(dense.count()), F.lit(shared), F.lit(cv)), vectors.weights(F.lit(shared), F.lit(cv))).first()
            if gate[0] or not top:
                lexical = materialise(vectors.fused(lexical, dense, (gate[1], 1 - gate[1])).join(chunks.select("id", "file_path"), "id"), "fused")
                top = lexical.agg(F.max("score")).first()[0]
        if not top:
            return lexical.limit(0)
        named = retrieval.first_source(lexical, retrieval.path_boost(chunks, asked["paths"], lexical, top), retrieval.symbol_seeds(chunks, asked["symbols"], top)) if asked["paths"] else retrieval.first_source(lexical, retrieval.symbol_seeds(chunks, asked["symbols"], top))
        return materialise(named.select("id", (F.col("score") / top).alias("score")).join(chunks.select("id", "file_path"), "id"), "seeds")

    def bundle(self, question: str, token_budget: int = 8192, k: int | None = None, embedder: str | None = None) -> Answer:
        """The packed chunks of an answer, the import graph and the types of its files, and what it was made of."""
        chunks, edges = self.index.chunks, self.index.edges
        asked = self._asked(question)
        hits = self.seeds(asked, k, embedder, question)
        is_test = lookups.is_test_path(F.col("file_path"))
        seeds = materialise(hits.groupBy(F.col("file_path").alias("file")).agg(F.max(F.col("score") * F.when(is_test, context.TEST_PENALTY).otherwise(1.0)).alias("score")), "files")
        matched = F.lower("file").rlike("|".join(re.escape(t) for t in asked["terms"])) if asked["terms"] else None
        reached = context.priorities(edges, seeds, matched).where(~lookups.is_test_path(F.col("file"))).orderBy(F.desc("priority"), "file").limit(context.MAX_EXPANSION)
        reached = materialise(reached.select(F.col("file").alias("node")), "reached")
        far = context.second_hop(edges, seeds.select(F.col("file").alias("node")), asked["architecture"], context.MAX_EXPANSION - reached.count())
        reached = materialise(reached.unionByName(far), "reached")
        boost = context.neighbour_boost(edges, seeds, matched).groupBy(F.col("file").alias("file_path")).agg(F.max("boost").alias("boost"))
        more = chunks.join(reached.select(F.col("node").alias("file_path")), "file_path", "left_semi").join(hits.select("id"), "id", "left_anti")
        pool = hits.select("id", F.col("score").alias("lexical")).unionByName(context.first_per_file(more, "file_path", [F.col("start_line"), F.col("id")]).select("id", F.lit(0.0).alias("lexical")))
        rows = chunks.join(pool, "id").join(boost, "file_path", "left").join(self.rank().withColumnRenamed("node", "file_path"), "file_path", "left").join(self.cohesion(), "file_path", "left")
        types = F.when(F.col("kind").isin("class", "type", "interface"), context.TYPE_COVERAGE).otherwise(0.0)
        score = context.final_score(context.relevance(F.col("lexical"), F.col("boost")), F.coalesce("rank", F.lit(0.0)), types, F.coalesce("cohesion", F.lit(0.0)), is_test)
        scored = materialise(rows.withColumn("score", F.round(score, 6)), "scored")
        total = scored.agg(F.coalesce(F.sum("token_count"), F.lit(0)).alias("t")).select(context.effective_budget(F.col("t"), token_budget)).first()[0]
        kept = scored.join(context.file_cut(scored).select("file_path"), "file_path", "left_semi")
        packed = context.pack(kept.select("id", "score", "token_count"), total)
        taken = materialise(kept.join(packed.select("id"), "id", "left_semi"), "taken")
        shape, defined = context.structure(edges, self.index.symbols, taken.select(F.col("file_path").alias("node")).distinct())
        out = taken.select("id", "file_path", "start_line", "end_line", "language", "content", "token_count", "score").orderBy(F.desc("score"), "id")
        return Answer(out, shape, defined, context.metadata(scored, taken, reached.count(), total, question))

    def query(self, question: str, token_budget: int = 8192, k: int | None = None, embedder: str | None = None) -> DataFrame:
        """The chunks of an answer: id, file_path, lines, language, content, token_count, score."""
        return self.bundle(question, token_budget, k, embedder).chunks

    def ask(self, question: str, token_budget: int = 8192, form: str = "markdown") -> str:
        return render.render(question, self.query(question, token_budget), form)

    def patterns(self) -> DataFrame:
        return analytics.patterns(self.index.symbols)

    def interfaces(self) -> DataFrame:
        rows = lookups.interfaces(self.index.symbols).select("file_path", "name", "kind", "signature")
        rows = rows.withColumns({"parameters": analytics.parameters(F.col("signature")), "returns": analytics.return_type(F.col("signature"))})
        return rows.join(graph.used_by(self.index.edges).withColumnRenamed("target", "file_path"), "file_path", "left")

    def modules(self) -> DataFrame:
        """Module, name, files, lines, dependencies and cohesion of the communities of the import graph."""
        own = materialise(self.members(), "members")
        lines = self.index.files.select(F.col("path").alias("node"), F.size(F.split("content", "\n")).alias("lines"))
        found = graph.modules(lines.join(own, "node"), self.index.edges)
        names = graph.common_folder(own.select("module", F.col("node").alias("path")), "module")
        return found.join(names, "module").join(graph.cohesion(self.index.edges, own).select("module", "cohesion"), "module")

    def members(self) -> DataFrame:
        """node, module: every file in a community of the import graph, or in its own."""
        own = graph.louvain(self.index.edges).select("node", F.col("community").alias("module"))
        return self.index.files.select(F.col("path").alias("node")).join(own, "node", "left").withColumn("module", F.coalesce("module", "node"))

    def languages(self) -> DataFrame:
        rows = self.index.files.groupBy("language").agg(F.count("*").alias("files"), F.sum(F.size(F.split("content", "\n"))).alias("lines"))
        return rows.withColumn("percentage", F.round(100.0 * F.col("lines") / F.sum("lines").over(Window.partitionBy()), 2))

    def tree(self, max_depth: int = 5) -> DataFrame:
        return hierarchy.file_tree(self.index.files, max_depth)

    def outline(self, path: str) -> DataFrame:
        own = self.index.symbols.where(F.col("file_path") == path)
        return hierarchy.outline_levels(own.select("file_path", F.col("qualified_name").alias("qname")))

    def outline_head(self, path: str) -> DataFrame:
        """file_path, language, lines, tokens of a file; one that is not indexed is of language ``unknown``, with zeros."""
        own = self.index.chunks.where(F.col("file_path") == path)
        return own.agg(F.coalesce(F.min("language"), F.lit("unknown")).alias("language"), F.coalesce(F.max("end_line"), F.lit(0)).alias("lines"), F.coalesce(F.sum("token_count"), F.lit(0)).alias("tokens")).select(F.lit(path).alias("file_path"), "language", "lines", "tokens")

    def symbols(self, words: str, kind: str | None = None, limit: int = 20, language: str | None = None) -> DataFrame:
        """Chunks of symbols in whose names the words stand side by side, from the index of names; by id."""
        if self._names is None:
            named = self.index.chunks.where("symbol_name IS NOT NULL")
            self._names = retrieval.TextIndex.build(named, dict.fromkeys(("symbol_id", "symbol_name", "qualified_name", "file_path"), 1.0))
        asked = self.spark.range(1).select(text.tokens(F.lit(words)).alias("t")).first()["t"]
        rows = self.index.chunks.join(self._names.phrase(asked).select("id"), "id", "left_semi") if asked else self.index.chunks.limit(0)
        return lookups.narrowed(rows, kind, limit, language=language)

    def symbol(self, symbol_id: str) -> DataFrame:
        return lookups.public_record(self.index.chunks.where(F.col("symbol_id") == symbol_id).limit(1))

    def profile(self, name: str) -> dict:
        """What ``render.profile_markdown`` shows: counts, languages, modules, patterns and the interface."""
        totals = self.index.files.agg(F.count("*").alias("files"), F.sum(F.size(F.split("content", "\n"))).alias("lines")).first()
        rows = lambda df: [r.asDict() for r in df.collect()]  # noqa: E731  one row a language, module, pattern
        return {
            "name": name, "files": totals["files"], "lines": totals["lines"] or 0, "languages": rows(self.languages().orderBy(F.desc("lines"), "language")), "modules": rows(self.modules().orderBy("module")),
            "patterns": rows(self.patterns().orderBy("pattern")), "exports": rows(lookups.interfaces(self.index.symbols).select("name", "file_path").orderBy("file_path", "name").limit(10)),
        }

    def decisions(self) -> DataFrame:
        return analytics.decisions(self.patterns(), analytics.known_alternatives(self.spark))


def compare(a: Engine, b: Engine) -> DataFrame:
    """dimension, a, b, trade_off by the keywords that stand in patterns and interfaces."""
    counts = None
    for name, e in (("a", a), ("b", b)):
        items = analytics.evidence(e.index.symbols).select(F.col("pattern").alias("text")).unionByName(e.interfaces().select(F.concat_ws(" ", "name", "signature", "file_path").alias("text")))
        own = analytics.dimension_evidence(items).groupBy("dimension").agg(F.count("*").alias(name))
        counts = own if counts is None else counts.join(own, "dimension", "full")
    counts = counts.na.fill(0, ["a", "b"])
    return counts.withColumn("trade_off", analytics.trade_off(F.col("a"), F.col("b")))
