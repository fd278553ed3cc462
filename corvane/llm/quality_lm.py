"""Quality classifier: interpolated modified Kneser-Ney perplexity.

The model is over bytes (UTF-8, case kept), order 5, trained on trusted text: the
documents labelled quality 1 and not toxic.  The counts of the highest order are
gathered by shards (a combiner per task, then a shuffle by n-gram); every lower
order has continuation counts, derived by joins of the tables of n-grams.

Scoring joins counts by shard of n-grams as well: the distinct n-grams of all
texts are joined with the count tables, order by order, which gives each its
smoothed log-probability.  A text's perplexity is 10 ** (-mean of its n-grams).

A text is rejected where its perplexity is above the ``QUANTILE`` of trusted texts
of its language.  These are one in ``FOLDS`` of the trusted texts, which training
leaves out, so the quantile is not one of texts the model knows.  A language with
fewer than ``LEAST`` of them, or none, has the quantile over all.

Null or empty text: no perplexity, rejected.  Very long texts are counted and
scored whole, in pieces.  Repeated rows: each is judged, and trusted ones count as
often as they stand.  A perplexity equal to the threshold is kept.  No trusted text
at all: all perplexities are those of the uniform model; with fewer than ``LEAST``
left out, nothing but empty texts is rejected.  Empty tables: no rows.  Extra
columns pass through ``keep_good``, whatever their names.

The table of n-gram probabilities is sent to every task while it has no more than
``BROADCAST_NGRAMS`` rows, which is checked; beyond, texts and their n-grams meet
in shards (``shards`` of documents by hash) instead.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import batches, free_name, materialise, plain_names

ORDER = 5
QUANTILE, LEAST, FOLDS, SALT = 0.995, 10, 4, 11
#: 12 bytes each: 48 MB at most.
BROADCAST_NGRAMS = 4_000_000
#: Characters of one shard of documents on the shuffled path.
SHARD_CHARS = 16_000_000
#: Bytes of texts a task turns into n-grams at once; an n-gram takes some 60 bytes meanwhile.
BATCH = 1 << 20


def keys_of(text: str | None, size: int = BATCH) -> Iterator[np.ndarray]:
    """The packed 5-byte n-grams of a text, four zero bytes before it; as many as it has bytes, in arrays of at most ``size``."""
    data = b"\0" * (ORDER - 1) + (text or "").encode()
    total = len(data) - ORDER + 1
    for at in range(0, total, size):
        n = min(size, total - at)
        b = np.frombuffer(data, np.uint8, n + ORDER - 1, at).astype(np.int64)
        out = np.zeros(n, np.int64)
        for i in range(ORDER):
            out = (out << 8) | b[i : i + n]
        yield out


class _Combiner:
    """Counts of keys, merged whenever the buffer is full, given out when the table is large."""

    def __init__(self, limit: int = 500_000):
        self.parts, self.held, self.limit = [], 0, limit
        self.keys, self.counts = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, keys: np.ndarray) -> None:
        self.parts.append(keys)
        self.held += len(keys)
        if self.held >= self.limit:
            self.merge()

    def merge(self) -> None:
        if self.parts:
            keys, counts = np.unique(np.concatenate(self.parts), return_counts=True)
            both = np.concatenate((self.keys, keys))
            self.keys, place = np.unique(both, return_inverse=True)
            self.counts = np.bincount(place, np.concatenate((self.counts, counts)), len(self.keys)).astype(np.int64)
            self.parts, self.held = [], 0

    def full(self) -> bool:
        return len(self.keys) > 4 * self.limit

    def take(self) -> pa.RecordBatch:
        self.merge()
        out = pa.record_batch([pa.array(self.keys), pa.array(self.counts)], names=["key", "n"])
        self.keys, self.counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        return out


def ngram_counts(docs: DataFrame) -> DataFrame:
    """key, n: every n-gram of all texts and how often it stands."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Combiner()
        for batch in batches(frames, BATCH):
            for text in batch.column(0).to_pylist():
                for keys in keys_of(text):
                    held.add(keys)
                    if held.full():
                        yield held.take()
        yield held.take()

    return docs.select("text").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def trusted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs whose labels say good; labels grow with the corpus, so they are joined by shuffle at every size."""
    good = labels.where("quality = 1 AND coalesce(toxic, 0) = 0").select("doc_id").distinct()
    return docs.join(good.hint("merge"), "doc_id", "left_semi")


class Model:
    """Count tables of the orders 1 to 5, and the discounts of each."""

    def __init__(self, text: DataFrame):
        counts = materialise(ngram_counts(text), "kn-counts")
        self.orders = {}
        for order in range(ORDER, 0, -1):
            if order < ORDER:  # continuation counts: how many different bytes stand before
                mask = (1 << 8 * order) - 1
                counts = materialise(counts.select((F.col("key").bitwiseAND(F.lit(mask))).alias("key")).groupBy("key").agg(F.count("*").alias("n")), "kn-counts")
            of = counts.agg(*[F.count(F.when(F.col("n") == i, 1)) for i in (1, 2, 3, 4)]).first()
            self.orders[order] = (counts, discounts(of))

    def probabilities(self, queried: DataFrame) -> DataFrame:
        """key, lp: log10 probability of the last byte after the four before, for each distinct key asked.

        Order by order, each written, so that no plan holds more than the joins of one order.
        """
        lower = None
        for order in range(1, ORDER + 1):
            counts, (d1, d2, d3) = self.orders[order]
            n, shift = F.col("n"), lambda: F.shiftright("key", 8)
            context = counts.groupBy(shift().alias("context")).agg(
                F.sum("n").alias("total"),
                (d1 * F.count(F.when(n == 1, 1)) + d2 * F.count(F.when(n == 2, 1)) + d3 * F.count(F.when(n >= 3, 1))).alias("left"),
            )
            keys = queried if order == ORDER else queried.select(F.col("key").bitwiseAND(F.lit((1 << 8 * order) - 1)).alias("key")).distinct()
            rows = keys.join(counts, "key", "left").withColumn("context", shift()).join(context, "context", "left")
            if lower is None:
                rows = rows.withColumn("below", F.lit(1 / 256))
            else:
                mask = (1 << 8 * (order - 1)) - 1
                rows = rows.withColumn("suffix", F.col("key").bitwiseAND(F.lit(mask))).join(lower.select(F.col("key").alias("suffix"), F.col("p").alias("below")), "suffix")
            off = F.when(n == 1, d1).when(n == 2, d2).otherwise(d3)
            own = F.coalesce(F.greatest(n - off, F.lit(0.0)), F.lit(0.0))
            p = F.when(F.col("total").isNull(), F.col("below")).otherwise((own + F.col("left") * F.col("below")) / F.col("total"))
            lower = rows.select("key", p.alias("p"))
            if order < ORDER:
                lower = materialise(lower, "kn-lower")
        return lower.select("key", F.log10("p").alias("lp"))


def discounts(of) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts from the numbers of n-grams seen once to four times."""
    n1, n2, n3, n4 = (float(x) for x in of)
    if not (n1 and n2):
        return 0.5, 0.5, 0.5
    y = n1 / (n1 + 2 * n2)
    out = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 2.0]
    return tuple(min(max(x, 0.1), i + 0.9) for i, x in enumerate(out))


def mean_lp(texts: list[str | None], keys: np.ndarray, lp: np.ndarray) -> list[float | None]:
    """Perplexity of each text from sorted keys and their log-probabilities."""
    sums, size = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
    parts: list[tuple[int, np.ndarray]] = []
    held = 0

    def look_up() -> None:
        some, place = np.unique(np.concatenate([p for _, p in parts]), return_inverse=True)
        values = lp[np.searchsorted(keys, some)][place]
        starts = np.cumsum([0, *(len(p) for _, p in parts[:-1])])
        np.add.at(sums, [i for i, _ in parts], np.add.reduceat(values, starts))
        parts.clear()

    for i, text in enumerate(texts):
        for part in keys_of(text):
            parts.append((i, part))
            size[i] += len(part)
            held += len(part)
            if held >= BATCH:
                look_up()
                held = 0
    if parts:
        look_up()
    return [float(10 ** (-s / n)) if n else None for s, n in zip(sums.tolist(), size.tolist(), strict=True)]


class Scorer:
    """The model's probabilities of all n-grams of docs, ready to score any of their rows."""

    def __init__(self, docs: DataFrame, model: Model, broadcast_limit: int = BROADCAST_NGRAMS):
        self.table = materialise(model.probabilities(materialise(ngram_counts(docs).select("key"), "kn-asked")), "kn-probabilities")
        self.held = None
        if self.table.count() <= broadcast_limit:
            rows = self.table.toArrow()
            keys = rows["key"].to_numpy()
            order = np.argsort(keys)
            self.held = docs.sparkSession.sparkContext.broadcast((keys[order], rows["lp"].to_numpy()[order]))

    def score(self, docs: DataFrame, name: str) -> DataFrame:
        """docs and a new column of that name, the perplexity."""
        names, held = docs.columns, self.held
        at, docs = names.index("text"), plain_names(docs)
        schema = docs.select("*", F.lit(None).cast("double").alias("ppl")).schema
        if held is None:
            return _by_shards(docs, self.table, schema, at).toDF(*names, name)

        def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            keys, lp = held.value
            for batch in batches(frames, BATCH):
                ppl = mean_lp(batch.column(at).to_pylist(), keys, lp)
                yield pa.record_batch([*batch.columns, pa.array(ppl, pa.float64())], names=schema.names)

        return docs.mapInArrow(run, schema).toDF(*names, name)


def _by_shards(docs: DataFrame, table: DataFrame, schema, at: int) -> DataFrame:
    """The same with documents (plain names, text at ``at``) and probabilities meeting in shards."""
    names, text, shard = docs.columns, f"c{at}", "shard"
    chars = docs.agg(F.sum(F.length(text))).first()[0] or 0
    n = int(chars // SHARD_CHARS + 1)
    hashed = [c for c, kind in docs.dtypes if kind in ("bigint", "string")]
    dealt = docs.withColumn(shard, F.pmod(F.xxhash64(*hashed), F.lit(n)).cast("int"))

    def distinct(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, _Combiner] = {}
        for batch in batches(frames, BATCH):
            for x, text in zip(batch.column(len(names)).to_pylist(), batch.column(at).to_pylist(), strict=True):
                for keys in keys_of(text):
                    held.setdefault(x, _Combiner()).add(keys)
        for place, x in held.items():
            keys = x.take().column(0)
            yield pa.record_batch([pa.array(np.full(len(keys), place, np.int32)), keys], names=[shard, "key"])

    dealt = dealt.repartition(n, shard)
    asked = dealt.mapInArrow(distinct, f"{shard} int, key long").distinct().join(table, "key")

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("key")
        ppl = mean_lp(left[text].to_pylist(), right["key"].to_numpy(), right["lp"].to_numpy())
        return left.select(names).append_column("ppl", pa.array(ppl, pa.float64()))

    return dealt.groupBy(shard).cogroup(asked.groupBy(shard)).applyInArrow(score, schema)


def fold(docs: DataFrame, held_out: bool) -> DataFrame:
    """The rows of docs that are (or are not) among the one in ``FOLDS`` kept from training, by a hash of id and text."""
    mine = F.pmod(F.xxhash64(F.lit(SALT), "doc_id", "text"), F.lit(FOLDS)) == 0
    return docs.where(mine if held_out else ~mine)


def thresholds(scorer: Scorer, docs: DataFrame, labels: DataFrame) -> dict[str | None, float]:
    """Greatest perplexity kept, by language; None holds for the others. One row per language comes to the driver."""
    held = scorer.score(trusted(fold(docs.select("doc_id", "lang", "text"), True), labels), "__ppl").where("__ppl IS NOT NULL")
    held = materialise(held.select("lang", "__ppl"), "kn-held-out")
    cut = lambda rows: rows.agg(F.count("*").alias("n"), F.percentile_approx("__ppl", QUANTILE, 10_000).alias("q"))
    out = {r["lang"]: r["q"] for r in cut(held.groupBy("lang")).where(F.col("n") >= LEAST).collect() if r["lang"] is not None}
    every = cut(held).first()
    out[None] = every["q"] if every["n"] >= LEAST else float("inf")
    return out


def _limit(limits: dict[str | None, float]) -> Column:
    out = F.lit(limits[None])
    for lang, value in limits.items():
        if lang is not None:
            out = F.when(F.col("lang") == lang, F.lit(value)).otherwise(out)
    return out


def classify(docs: DataFrame, labels: DataFrame, broadcast_limit: int = BROADCAST_NGRAMS) -> DataFrame:
    """doc_id, lang, perplexity, threshold and kept, one row per row of docs."""
    scorer, limits = _fitted(docs, labels, broadcast_limit)
    scores = scorer.score(docs.select("doc_id", "lang", "text"), "perplexity").drop("text")
    limit = _limit(limits)
    return scores.select("doc_id", "lang", "perplexity", limit.alias("threshold"), F.coalesce(F.col("perplexity") <= limit, F.lit(False)).alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, broadcast_limit: int = BROADCAST_NGRAMS) -> DataFrame:
    """The rows of docs that the classifier keeps; columns stay."""
    scorer, limits = _fitted(docs, labels, broadcast_limit)
    name = free_name(docs, "perplexity")
    return scorer.score(docs, name).where(F.coalesce(F.col(name) <= _limit(limits), F.lit(False))).drop(name)


def _fitted(docs: DataFrame, labels: DataFrame, broadcast_limit: int) -> tuple[Scorer, dict[str | None, float]]:
    model = Model(trusted(fold(docs.select("doc_id", "text"), False), labels).select("text"))
    scorer = Scorer(docs, model, broadcast_limit)
    return scorer, thresholds(scorer, docs, labels)
