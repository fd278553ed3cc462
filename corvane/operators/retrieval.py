"""Full-text retrieval: postings, BM25 with field weights, graduated search, boosts."""

from __future__ import annotations

import math
import re
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.text import once, tokens
from corvane.sources.store import materialise, shared_folder

K1, B = 1.2, 0.75
#: Weights by field.
FIELDS = {"content": 3.0, "symbol_name": 1.5, "file_path": 1.0}
GRADUATED = 10
#: Partitions of a stored index, and tasks a bucket is written by.
BUCKETS, SPREAD = 64, 8
PATH_BOOST, SYMBOL_EXACT, SYMBOL_PARTIAL = 0.5, 0.60, 0.15
PATH_CAP, PER_TERM, SYMBOL_CAP = 30, 20, 20
#: A place in an index is a position in a field, and the number of the field from this bit on.
FIELD_BIT = 40
#: What is asked for: a word, or several words side by side.
Unit = str | tuple[str, ...]


def unit_of(unit: Unit | list[str]) -> tuple[str, ...]:
    return (unit,) if isinstance(unit, str) else tuple(unit)


def postings(chunks: DataFrame, fields: list[str] | None = None, key: str = "id") -> DataFrame:
    """term, id, field, tf: one row per term of a field of a chunk."""
    def terms(field: str) -> Column:
        return F.transform(tokens(F.col(field)), lambda t: F.struct(F.lit(field).alias("field"), t.alias("term")))

    parts = [terms(f) for f in (fields or ["content"])]
    rows = chunks.select(key, F.explode(F.concat(*parts)).alias("x")).select("x.term", F.col(key).alias("id"), "x.field")
    return rows.groupBy("term", "id", "field").agg(F.count("*").alias("tf"))


def doc_stats(chunks: DataFrame, fields: list[str] | None = None, key: str = "id") -> DataFrame:
    """id, length in tokens over the fields."""
    return chunks.select(F.col(key).alias("id"), sum((F.size(tokens(F.col(f))) for f in (fields or ["content"])), F.lit(0)).cast("long").alias("length"))


def phrase_count(words: Column, phrase: tuple[str, ...]) -> Column:
    """How often the phrase's words stand side by side in an array of words."""
    if len(phrase) == 1:
        return F.size(F.filter(words, lambda t: t == phrase[0]))
    shifted = [F.slice(words, j + 1, F.greatest(F.size(words), F.lit(1))).alias(f"w{j}") for j in range(len(phrase))]
    return F.size(F.filter(F.arrays_zip(*shifted), lambda x: reduce(lambda a, b: a & b, [x[f"w{j}"].eqNullSafe(F.lit(w)) for j, w in enumerate(phrase)])))


def matches(chunks: DataFrame, terms: list[Unit], fields: dict[str, float] | None = None, key: str = "id") -> DataFrame:
    """id, length and f: array of the weighted counts of each word or phrase, for all chunks, in one scan without a shuffle."""
    fields, units = fields or {"content": 1.0}, [unit_of(t) for t in terms]
    held = once(chunks.select(F.col(key).alias("id"), *[F.col(f).alias(f"_{i}") for i, f in enumerate(fields)]), ["id"], {f"t{i}": tokens(F.col(f"_{i}")) for i in range(len(fields))})
    length = sum((F.size(f"t{i}") for i in range(len(fields))), F.lit(0))
    if all(len(u) == 1 for u in units):  # only the words asked for are looked at again
        words = [u[0] for u in units]
        held = once(held, ["id"], {"length": length} | {f"t{i}": F.filter(f"t{i}", lambda t: t.isin(words)) for i in range(len(fields))})
    else:
        held = once(held, ["id"] + [f"t{i}" for i in range(len(fields))], {"length": length})
    f = F.array(*[sum((w * phrase_count(F.col(f"t{i}"), unit) for i, w in enumerate(fields.values())), F.lit(0.0)) for unit in units])
    return once(held, ["id", "length"], {"f": f})


def _idf(n: int, total: int) -> float:
    x = math.log((total - n + 0.5) / (n + 0.5))
    return x if x > 0 else 1e-6


def bm25(chunks: DataFrame, terms: list[Unit], fields: dict[str, float] | None = None, key: str = "id") -> DataFrame:
    """id, f, length and parts: the BM25 share of each word or phrase, for chunks with any.

    Corpus statistics are one aggregate over the chunks; scoring is a second scan.  Neither shuffles rows.
    """
    found = matches(chunks, terms, fields, key)
    stats = found.agg(F.count("*"), F.avg("length"), *[F.count(F.when(F.get("f", F.lit(i)) > 0, 1)) for i in range(len(terms))]).first()
    return _shares(found.where(F.exists("f", lambda x: x > 0)), [_idf(stats[2 + i], stats[0]) for i in range(len(terms))], stats[1] or 1.0)


def _shares(hits: DataFrame, idf: list[float], mean: float) -> DataFrame:
    """hits (id, length, f) with parts."""
    norm = K1 * (1 - B + B * F.col("length") / F.lit(float(mean)))
    part = lambda i: F.lit(idf[i]) * F.get("f", F.lit(i)) * (K1 + 1) / (F.get("f", F.lit(i)) + norm)
    return once(hits, ["id", "length", "f"], {"parts": F.array(*[part(i) for i in range(len(idf))])})


def _postings(frames: Iterator[pa.RecordBatch], weights: list[float]) -> Iterator[pa.RecordBatch]:
    """Batches of (id, words of each field) as (id, length, first, term, f, places): a row a different word of a text, and one without a word for an empty text."""
    for batch in frames:
        words, rows, places, weight = [], [], [], []
        for i, w in enumerate(weights):
            column = batch.column(i + 1)
            sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            words.append(column.flatten())
            rows.append(np.repeat(np.arange(batch.num_rows), sizes))
            places.append(np.arange(len(rows[-1])) - np.repeat(np.cumsum(sizes) - sizes, sizes) + (i << FIELD_BIT))
            weight.append(np.full(len(rows[-1]), w))
        row, place, weight = map(np.concatenate, (rows, places, weight))
        coded = pa.concat_arrays(words).dictionary_encode()
        code = coded.indices.to_numpy().astype(np.int64)
        order = np.lexsort((place, code, row))
        row, code, place, weight = row[order], code[order], place[order], weight[order]
        begins = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (code[1:] != code[:-1])))) if len(row) else np.zeros(0, np.int64)
        lengths = np.bincount(row, minlength=batch.num_rows)
        empty = np.flatnonzero(lengths == 0)
        at = np.concatenate((row[begins], empty))
        first = np.concatenate((np.concatenate(([True], row[begins][1:] != row[begins][:-1]))[: len(begins)], np.ones(len(empty), bool)))
        terms = pa.concat_arrays([coded.dictionary.take(pa.array(code[begins])), pa.nulls(len(empty), pa.string())])
        f = np.concatenate((np.add.reduceat(weight, begins) if len(begins) else [], np.zeros(len(empty))))
        ends = np.concatenate((begins, np.full(len(empty) + 1, len(place)))).astype(np.int32)
        yield pa.record_batch(
            [batch.column(0).take(pa.array(at)), pa.array(lengths[at].astype(np.int64)), pa.array(first), terms, pa.array(f.astype(np.float64)), pa.ListArray.from_arrays(pa.array(ends), pa.array(place.astype(np.int64)))],
            names=["id", "length", "first", "term", "f", "places"],
        )


def posting_rows(chunks: DataFrame, fields: dict[str, float] | None = None, key: str = "id", analyse: Callable[[Column], Column] = tokens, keep: tuple[str, ...] = ()) -> DataFrame:
    """id, length, first (of its chunk), term, f (weighted count), places: the words of each chunk, made within the row's task."""
    fields = fields or {"content": 1.0}
    words = once(chunks.select(F.col(key).alias("id"), *[F.col(f).alias(f"_{i}") for i, f in enumerate(fields)]), ["id"], {f"t{i}": analyse(F.col(f"_{i}")) for i in range(len(fields))})
    weights, kind = list(fields.values()), dict(words.dtypes)["id"]
    return words.mapInArrow(lambda frames: _postings(frames, weights), f"id {kind}, length long, first boolean, term string, f double, places array<long>")


def write_postings(rows: DataFrame, path: str) -> None:
    """One shuffle into ``BUCKETS`` folders by a hash of the term; a bucket is many tasks, so a term in a third of all texts is spread by id."""
    rows = rows.withColumn("bucket", bucket_of(F.col("term")))
    rows.repartition("bucket", F.pmod(F.xxhash64("id"), F.lit(SPREAD))).sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(path)


@dataclass(frozen=True)
class TextIndex:
    """A stored inverted index with positions: postings (bucket, term, id, f, length, places) in ``BUCKETS`` partitions by a hash of the term, sorted by term.

    A question reads the partitions of its words, and in them the blocks that hold the words; it never reads a text.
    Words of a phrase meet by chunk: places of one word that fall on those of the next, moved back.
    """

    postings: DataFrame
    total: int
    mean: float
    weights: tuple[float, ...] = (1.0,)

    @classmethod
    def build(cls, chunks: DataFrame, fields: dict[str, float] | None = None, key: str = "id", analyse: Callable[[Column], Column] = tokens) -> TextIndex:
        """One scan and one shuffle; weights by field go into f."""
        rows = posting_rows(chunks, fields, key, analyse)
        path = f"{shared_folder(chunks.sparkSession)}/postings-{uuid.uuid4().hex}"
        write_postings(rows, path)
        stored = chunks.sparkSession.read.schema(rows.withColumn("bucket", F.lit(0)).schema).parquet(path)
        return cls.over(stored, tuple((fields or {"content": 1.0}).values()))

    @classmethod
    def over(cls, stored: DataFrame, weights: tuple[float, ...]) -> TextIndex:
        """The index that stored postings are; one pass over their lengths."""
        sizes = stored.where("first").agg(F.count("*"), F.avg("length")).first()
        return cls(stored, sizes[0], sizes[1] or 1.0, weights)

    def asked(self, words: list[str]) -> DataFrame:
        """The postings of the words."""
        buckets = [r[0] for r in self.postings.sparkSession.createDataFrame([(w,) for w in words], "term string").select(bucket_of(F.col("term"))).distinct().collect()]
        return self.postings.where(F.col("bucket").isin(buckets) & F.col("term").isin(words))

    def bm25(self, terms: list[Unit]) -> DataFrame:
        """id, length, f and parts, as of ``bm25`` over texts."""
        units = [unit_of(t) for t in terms]
        if not units:
            return self.postings.limit(0).select("id", "length", F.array().cast("array<double>").alias("f"), F.array().cast("array<double>").alias("parts"))
        rows = self.asked(sorted({w for u in units for w in u}))
        if all(len(u) == 1 for u in units):
            found = {r["term"]: r["n"] for r in rows.groupBy("term").agg(F.count("*").alias("n")).collect()}
            f = F.array(*[F.coalesce(F.max(F.when(F.col("term") == u[0], F.col("f"))), F.lit(0.0)) for u in units])
            return _shares(rows.groupBy("id", "length").agg(f.alias("f")), [_idf(found.get(u[0], 0), self.total) for u in units], self.mean or 1.0)
        hits = materialise(self._held(rows, units), "phrases")
        counts = hits.agg(*[F.count(F.when(F.get("f", F.lit(i)) > 0, 1)) for i in range(len(units))]).first()
        return _shares(hits, [_idf(n, self.total) for n in counts], self.mean or 1.0)

    def _held(self, rows: DataFrame, units: list[tuple[str, ...]]) -> DataFrame:
        """id, length, f (a weighted count a unit) of the chunks that hold any."""
        words = sorted({w for u in units for w in u})
        none = F.array().cast("array<long>")
        held = rows.groupBy("id", "length").agg(*[F.coalesce(F.max(F.when(F.col("term") == w, F.col("places"))), none).alias(f"p{i}") for i, w in enumerate(words)])
        moved = lambda w, j: F.transform(f"p{words.index(w)}", lambda x: x - j)
        found = [reduce(F.array_intersect, [moved(w, j) for j, w in enumerate(u)]) if len(u) > 1 else F.col(f"p{words.index(u[0])}") for u in units]
        weighted = lambda hits: sum((w * F.size(F.filter(hits, lambda x: F.shiftright(x, FIELD_BIT) == i)) for i, w in enumerate(self.weights)), F.lit(0.0))
        return once(held, ["id", "length"], {"f": F.array(*[weighted(h) for h in found])}).where(F.exists("f", lambda x: x > 0))

    def phrase(self, words: list[str]) -> DataFrame:
        """id and n, how often the words stand side by side, of the chunks where they do."""
        hits = self._held(self.asked(sorted(set(words))), [tuple(words)])
        return hits.select("id", F.get("f", F.lit(0)).alias("n"))


def bucket_of(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def scored(source: DataFrame | TextIndex, terms: list[Unit], fields: dict[str, float] | None = None) -> DataFrame:
    return source.bm25(terms) if isinstance(source, TextIndex) else bm25(source, terms, fields)


def or_search(chunks: DataFrame | TextIndex, terms: list[Unit], k: int, fields: dict[str, float] | None = None) -> DataFrame:
    """id, score: sum of the shares, best first, by id among equals."""
    score = F.aggregate("parts", F.lit(0.0), lambda a, x: a + x)
    return scored(chunks, terms, fields).select("id", F.round(score, 6).alias("score")).orderBy(F.desc("score"), "id").limit(k)


def graduated(chunks: DataFrame | TextIndex, terms: list[Unit], k: int, threshold: int = GRADUATED) -> DataFrame:
    """id, score, stage: all terms; then all but one; then pairs; then any, each only while too few are found.

    One scan gives each chunk the shares of its terms, sorted once: the best sum over all terms but one leaves out the
    least share (or nothing, if a term is missing), the best pair are the two largest.
    """
    n = len(terms)
    stages = [size for size, least in ((n, 2), (n - 1, 3), (2, 4)) if n >= least]
    rows = once(scored(chunks, terms), ["id", "parts"], {"held": F.sort_array(F.filter("parts", lambda x: x > 0), asc=False)})
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda a, y: a + y)
    best = [F.when(F.size("held") >= size, total(F.slice("held", 1, size))) for size in stages]
    rows = rows.select("id", *[b.alias(f"s{i}") for i, b in enumerate(best)], total("parts").alias("any"))
    if stages:
        counts = rows.agg(*[F.count(f"s{i}") for i in range(len(stages))]).first()
        if counts[0] >= threshold:
            return rows.where("s0 IS NOT NULL").select("id", F.round("s0", 6).alias("score"), F.lit(1).alias("stage")).orderBy(F.desc("score"), "id").limit(k)
        for i in range(1, len(stages)):
            if counts[i] >= threshold:
                merged = F.greatest(*[F.col(f"s{j}") for j in range(1, i + 1)], F.lit(None).cast("double"))
                return rows.select("id", F.round(merged, 6).alias("score"), F.lit(i + 1).alias("stage")).where("score IS NOT NULL").orderBy(F.desc("score"), "id").limit(k)
    merged = F.greatest("any", *[F.col(f"s{j}") for j in range(1, len(stages))], F.lit(None).cast("double"))
    return rows.select("id", F.round(merged, 6).alias("score"), F.lit(len(stages) + 1).alias("stage")).orderBy(F.desc("score"), "id").limit(k)


def path_boost(chunks: DataFrame, terms: list[str], hits: DataFrame, top: float) -> DataFrame:
    """id, score: chunks whose path holds a term (first PER_TERM a term by id, PATH_CAP in all), without the hits."""
    term = F.explode(F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(t).alias("term")) for i, t in enumerate(terms)]))
    rows = chunks.select("id", "file_path", term.alias("t")).where(F.contains(F.lower("file_path"), F.col("t.term"))).select("id", "t.pos")
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("pos").orderBy("id"))).where(F.col("n") <= PER_TERM)
    rows = rows.join(hits.select("id"), "id", "left_anti").groupBy("id").agg(F.min(F.struct("pos", "n")).alias("first"))
    return rows.orderBy("first", "id").limit(PATH_CAP).select("id", F.lit(round(PATH_BOOST * top, 6)).alias("score"))


def symbol_score(name: Column, qualified: Column, term: Column, top: float) -> Column:
    """Boost of a symbol for a term: exact name, else part of the name or the qualified name, else null."""
    exact, part = F.lower(name) == term, F.contains(F.lower(name), term) | F.contains(F.lower(qualified), term)
    return F.when(exact, F.lit(SYMBOL_EXACT * top)).when(part, F.lit(SYMBOL_PARTIAL * top))


def first_source(*found: DataFrame) -> DataFrame:
    """id, score of the union; where an id comes from several, the first source wins."""
    rows = None
    for i, df in enumerate(found):
        part = df.select("id", "score", F.lit(i).alias("priority"))
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy("id").agg(F.min_by("score", "priority").alias("score"), F.min("priority").alias("priority"))


def grep(chunks: DataFrame, keywords: list[str]) -> DataFrame:
    """id, first: chunks that hold a keyword, with the place of the first such keyword; in that order, then by id."""
    lowered = F.lower("content")
    hits = F.array_compact(F.array(*[F.when(F.contains(lowered, F.lit(k.lower())), F.lit(i)) for i, k in enumerate(keywords)]))
    return chunks.select("id", F.array_min(hits).alias("first")).where("first IS NOT NULL")


def k_schedule(chunks: Column) -> Column:
    """How many hits to ask for, by the number of chunks."""
    return F.when(chunks <= 100, 30).when(chunks <= 500, 50).when(chunks <= 2000, 100).otherwise(150)


def and_join(terms: Column) -> Column:
    """The terms as one text that asks for all of them."""
    return F.array_join(terms, " AND ")


def has_data(chunks: DataFrame) -> DataFrame:
    """One row, has_data: whether anything is indexed."""
    return chunks.agg((F.count("*") > 0).alias("has_data"))


def symbol_phrases(question: str, noise: list[str]) -> list[str]:
    """What a question may name as a symbol: neighbours joined by _ and words of six or more characters, no noise."""
    words = [w for w in re.findall(r"[a-z][a-z0-9_]{2,}", question.lower()) if w not in noise]
    return list(dict.fromkeys([f"{a}_{b}" for a, b in zip(words, words[1:], strict=False)] + [w for w in words if len(w) >= 6]))


def symbol_seeds(chunks: DataFrame, phrases: list[str], top: float, per_term: int = 20, limit: int = 20) -> DataFrame:
    """id, score: chunks whose symbol or qualified name holds a phrase, the first per_term a phrase by id, best score of each."""
    if not phrases:
        return chunks.limit(0).select("id", F.lit(0.0).alias("score"))
    rows = chunks.where("symbol_name IS NOT NULL").select("id", "symbol_name", "qualified_name", F.explode(F.array(*map(F.lit, phrases))).alias("phrase"))
    rows = rows.withColumn("score", symbol_score(F.col("symbol_name"), F.coalesce("qualified_name", "symbol_name"), F.col("phrase"), top)).where("score IS NOT NULL")
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("phrase").orderBy("id"))).where(F.col("n") <= per_term)
    return rows.groupBy("id").agg(F.round(F.max("score"), 6).alias("score")).orderBy(F.desc("score"), "id").limit(limit)


def longest_first(terms: Column) -> Column:
    """Terms by falling length; those of one length keep their order."""
    keyed = F.transform(terms, lambda t, i: F.struct((-F.length(t)).alias("n"), i.alias("i"), t.alias("t")))
    return F.transform(F.array_sort(keyed), lambda x: x["t"])
