"""Dense retrieval and the fusion of ranked lists."""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

RRF_K, RERANK = 60, 50
GATE_CV, GATE_AGREEMENT, GATE_LEAST, AGREEMENT_TOP, CV_TOP = 0.5, 0.6, 3, 20, 10


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalised(a: Column) -> Column:
    """Scaled to length one; the length counts as 1e-9 at least."""
    size = F.greatest(norm(a), F.lit(1e-9))
    return F.transform(a, lambda x: x.cast("double") / size)


def top_k(vectors: DataFrame, query: list[float], k: int, key: str = "vec_id") -> DataFrame:
    """id, score by dot product with a unit query vector; what is not positive is dropped after the cut. Zero query: nothing."""
    size = float(np.linalg.norm(query))
    unit = [x / size for x in query] if size else [0.0 for _ in query]
    literal = F.array(*[F.lit(float(x)) for x in unit])
    rows = vectors.select(F.col(key).alias("id"), dot(F.col("embedding"), literal).alias("score")).orderBy(F.desc("score"), "id").limit(k)
    return rows.where("score > 0") if size else rows.limit(0)


def search_blocks(vectors: DataFrame, queries: list[list[float]], k: int, key: str = "id") -> DataFrame:
    """query (place in the list), id, score: the k vectors nearest by cosine to each query, best first among equals by id.

    A task multiplies its vectors, a batch at a time as one matrix, with all queries and keeps k a query; the kept rows
    are merged.  Vectors of length zero or of another length than the query, and scores that are not positive, are no hits.
    """
    asked = np.array(queries, np.float64)
    size = np.linalg.norm(asked, axis=1, keepdims=True)
    asked = np.divide(asked, size, out=np.zeros_like(asked), where=size > 0)
    kind = dict(vectors.dtypes)[key]

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[tuple]] = [[] for _ in asked]
        for batch in frames:
            sizes = batch.column(1).value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
            fit = np.flatnonzero(sizes == asked.shape[1])
            some = batch.take(pa.array(fit))
            block = some.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(fit), -1)
            length = np.linalg.norm(block, axis=1)
            scores = (block @ asked.T) / np.where(length > 0, length, 1.0)[:, None]
            ids = some.column(0)
            for q in range(len(asked)):
                place = np.flatnonzero(scores[:, q] > 0)
                if len(place) > k:
                    least = np.partition(scores[place, q], len(place) - k)[len(place) - k]
                    place = place[scores[place, q] >= least]  # ties at the edge stay until ids decide
                held[q] += zip((-scores[place, q]).tolist(), ids.take(pa.array(place)).to_pylist(), strict=True)
                held[q] = heapq.nsmallest(k, held[q])
        rows = [(q, i, -s) for q, own in enumerate(held) for s, i in own]
        if rows:
            yield pa.RecordBatch.from_pylist([{"query": q, "id": i, "score": s} for q, i, s in rows])

    found = vectors.select(F.col(key).alias("id"), "embedding").where("id IS NOT NULL").mapInArrow(run, f"query long, id {kind}, score double")
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))
    return found.withColumn("__place", place).where(F.col("__place") <= k).drop("__place")


def rerank(hits: DataFrame, vectors: DataFrame, query: list[float], k: int, candidates: int = RERANK, key: str = "vec_id") -> DataFrame:
    """The first candidates of hits (id, score) ordered anew by cosine."""
    first = hits.orderBy(F.desc("score"), "id").limit(candidates).select("id")
    near = vectors.join(F.broadcast(first), F.col(key) == F.col("id"), "left_semi")
    return top_k(near, query, k, key)


def ranks(hits: DataFrame, name: str) -> DataFrame:
    """id and place (from 1) of a ranked list of bounded length."""
    return hits.select("id", F.row_number().over(Window.orderBy(F.desc("score"), "id")).alias(name))


def fused(lexical: DataFrame, dense: DataFrame, weights: tuple[float, float] = (1.0, 1.0), k: int = RRF_K) -> DataFrame:
    """id, score: weighted reciprocal ranks of two ranked lists."""
    both = ranks(lexical, "a").join(ranks(dense, "b"), "id", "full")
    part = lambda c, w: F.coalesce(F.lit(w) / (k + F.col(c)), F.lit(0.0))
    return both.select("id", (part("a", weights[0]) + part("b", weights[1])).alias("score"))


def agreement(a: DataFrame, b: DataFrame, top: int = AGREEMENT_TOP, column: str = "file_path") -> DataFrame:
    """One row, agreement: shared over all files of the first places of both lists."""
    one = a.orderBy(F.desc("score"), "id").limit(top).agg(F.collect_set(column).alias("x"))
    two = b.orderBy(F.desc("score"), "id").limit(top).agg(F.collect_set(column).alias("y"))
    size = F.size(F.array_union("x", "y"))
    return one.join(two).select(F.when(size > 0, F.size(F.array_intersect("x", "y")) / size).otherwise(F.lit(0.0)).alias("agreement"))


def variation(hits: DataFrame, top: int = CV_TOP) -> DataFrame:
    """One row, cv: deviation over mean of the first scores; 0 for fewer than two or a mean near 0."""
    first = hits.orderBy(F.desc("score"), "id").limit(top)
    out = first.agg(F.count("*").alias("n"), F.avg("score").alias("mean"), F.stddev_pop("score").alias("sd"))
    return out.select(F.when((F.col("n") < 2) | (F.col("mean") < 1e-9), 0.0).otherwise(F.col("sd") / F.col("mean")).alias("cv"))


def weights(shared: Column, cv: Column) -> Column:
    """Lexical weight by agreement and variation (the dense one is the rest)."""
    return F.when(shared > 0.7, 0.85).when(shared >= 0.3, F.when(cv > 0.3, 0.5).otherwise(0.4)).otherwise(0.35)


def fuse_wanted(n_lexical: Column, n_dense: Column, shared: Column, cv: Column) -> Column:
    few = (n_lexical < GATE_LEAST) | (n_dense < GATE_LEAST)
    return ~(few | ((cv > GATE_CV) & (shared > GATE_AGREEMENT)))


def surrogate(chunks: DataFrame) -> Column:
    """Labelled lines that describe a chunk; what is missing is left out."""
    from corvane.functions.text import anchors

    have = set(chunks.columns)
    line = lambda label, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{label}: "), F.col(c).cast("string"))) if c in have else F.lit(None).cast("string")
    return F.concat_ws(
        "\n", line("path", "file_path"), line("language", "language"),
        F.concat(F.lit("lines: "), F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string")),
        line("kind", "symbol_kind"), line("symbol", "symbol_name"), line("qualified", "qualified_name"), line("signature", "signature"),
        line("visibility", "visibility"), line("imports", "imports_context"), line("doc", "docstring"),
        F.concat(F.lit("anchors: "), F.array_join(anchors(F.col("content")), ", ")),
    )


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def hash_embedding(texts: pd.Series) -> pd.Series:
    """A deterministic 64-dimensional embedding from the SHA-256 bytes of a text."""

    def one(t: str) -> np.ndarray:
        data = np.frombuffer(hashlib.sha256((t or "").encode()).digest(), np.uint8)
        return np.tile(data, 2) / 255 * 2 - 1

    return texts.map(one)


EMBEDDERS = {"hash": hash_embedding}
#: Size of a word embedding, and the buckets by which words are counted.
DIM, BUCKETS = 256, 1 << 16


def _buckets(words: Column) -> Column:
    return F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(BUCKETS)).cast("int"))


def _terms(text: Column) -> Column:
    from corvane.functions.text import expanded, tokens

    return tokens(expanded(text))


class WordEmbedder:
    """Signed feature hashing of words and parts of identifiers, weighed by how rare they are among the texts fitted to.

    Texts that share rare words are near.  Fitting is one pass that counts texts by bucket (``BUCKETS`` numbers come to the driver).
    """

    def __init__(self, texts: DataFrame, column: str = "content"):
        own = texts.select(F.array_distinct(_buckets(_terms(F.col(column)))).alias("b"))
        counted = own.select(F.explode("b").alias("b")).groupBy("b").agg(F.count("*").alias("n")).toArrow()
        idf = np.full(BUCKETS, np.log(1.0 + texts.count()))
        idf[counted["b"].to_numpy()] = np.log(1.0 + texts.count() / counted["n"].to_numpy())
        drawn = np.random.default_rng(7)
        self.idf, self.place, self.sign = idf, drawn.integers(0, DIM, BUCKETS), drawn.choice([-1.0, 1.0], BUCKETS)

    def __call__(self, text: Column) -> Column:
        idf, place, sign = self.idf, self.place, self.sign

        @F.pandas_udf(T.ArrayType(T.DoubleType()))
        def vectors_of(buckets: pd.Series) -> pd.Series:
            def one(b) -> np.ndarray:
                found, n = np.unique(np.asarray(b, np.int64), return_counts=True)
                out = np.zeros(DIM)
                np.add.at(out, place[found], sign[found] * idf[found] * (1.0 + np.log(n)))
                return out

            return buckets.map(one)

        return vectors_of(_buckets(_terms(text)))


def hits_to_chunks(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """The chunks of hits (id, score), with the score; hits without a chunk are left out."""
    return chunks.join(hits.select("id", "score"), "id")


def search_texts(chunks: DataFrame, question: str, k: int, embedder: str | WordEmbedder = "hash", stored: DataFrame | None = None) -> DataFrame:
    """id, score: chunks (or their stored vectors) searched by a question."""
    embedder = WordEmbedder(chunks) if embedder == "words" else embedder
    asked = embed(chunks.sparkSession.createDataFrame([(0, question)], "id long, content string"), F.col("content"), embedder).first()["embedding"]
    return search_blocks(stored if stored is not None else embed(chunks, F.col("content"), embedder), [asked], k).select("id", "score")


def embed(chunks: DataFrame, text: Column, embedder: str | WordEmbedder = "hash") -> DataFrame:
    """id, embedding (unit length); ``words`` fits a ``WordEmbedder`` to the chunks."""
    if embedder == "words":
        embedder = WordEmbedder(chunks)
    if isinstance(embedder, str) and embedder not in EMBEDDERS:
        raise ValueError(f"unknown embedder {embedder!r}")
    raw = chunks.select("id", (embedder if isinstance(embedder, WordEmbedder) else EMBEDDERS[embedder])(text).alias("embedding"))
    return raw.select("id", normalised(F.col("embedding")).alias("embedding"))
