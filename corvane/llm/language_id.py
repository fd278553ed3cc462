"""Language identification by nearest centroid.

A text becomes a vector of its lower-cased letter n-grams (one to three letters,
words padded with a space), hashed to ``DIMENSIONS`` places, weighted by
log(1 + count) * idf and scaled to length one.  Every language has several
centroids, found by spherical k-means, because texts of one language differ.  The
prediction is the language of the centroid with the largest cosine; a text farther
from every centroid than nearly all training texts of that language is marked
``rejected`` (the prediction stays a learned language).

Document frequencies are counted over all training texts.  The clusters are fitted
on a sample of at most about ``SAMPLE`` texts a language (chosen by hash), the only
sample here; each language is fitted in a task.  Every text of any length is scored
whole.

Null or empty text or no letter: ``und``, score 0.  Nothing to learn from: ``und``
for all.  Equal cosines: the language first by code point.  Repeated rows: each is
scored, and each counts in training.  Empty table: no rows.  Extra columns are not
read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import batches, id_bucket

DIMENSIONS, CENTROIDS, ROUNDS = 4096, 4, 8
SAMPLE = 300
#: Share of a language's training texts that are as near to its centroids as the limit asks.
REJECT_QUANTILE, REJECT_SLACK = 0.01, 0.5
SALT = 4
_OTHER, _LETTER = regex.compile(r"[^\p{L}\p{M}]+"), regex.compile(r"\p{L}")


def counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Places and counts of a text's hashed n-grams; empty if it has no letter."""
    line = _OTHER.sub(" ", (text or "").lower())
    if not _LETTER.search(line):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    c = np.frombuffer(f" {line.strip()} ".encode("utf-32-le"), np.uint32).astype(np.uint64)
    mix = lambda x: ((x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 12)).astype(np.int64)
    two = c[:-1] * np.uint64(0x110000) + c[1:] + np.uint64(1 << 60)
    three = (c[:-2] * np.uint64(1 << 21) + c[1:-1]) * np.uint64(1 << 21) + c[2:] + np.uint64(1 << 62)
    space = np.uint64(32)
    keep = (c[1:-1] != space) | ((c[:-2] == space) & (c[2:] == space))  # no n-gram over two words
    total = np.bincount(np.concatenate((mix(c[c != space]), mix(two), mix(three[keep]))), minlength=DIMENSIONS)
    at = np.flatnonzero(total)
    return at, total[at]


def vector(text: str | None, idf: np.ndarray) -> np.ndarray | None:
    at, n = counts(text)
    if not len(at):
        return None
    out = np.zeros(DIMENSIONS, np.float32)
    out[at] = np.log1p(n) * idf[at]
    return out / max(float(np.linalg.norm(out)), 1e-12)


def learn(train: DataFrame, sample: int = SAMPLE) -> dict | None:
    """Model from (doc_id, text, lang): idf, unit centroids, their languages and least cosines."""

    def frequencies(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = np.zeros(DIMENSIONS, np.int64), 0
        for batch in batches(frames):
            for text in batch.column(0).to_pylist():
                at, _ = counts(text)
                seen[at] += 1
                n += 1
        at = np.flatnonzero(seen)
        yield pa.record_batch([pa.array([-1, *at.tolist()], pa.int32()), pa.array([n, *seen[at].tolist()], pa.int64())], names=["at", "n"])

    train = train.where("lang IS NOT NULL")
    found = train.select("text").mapInArrow(frequencies, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()  # DIMENSIONS + 1 rows at most
    df, n = np.zeros(DIMENSIONS), 0
    for r in found:
        if r["at"] < 0:
            n = r["n"]
        else:
            df[r["at"]] = r["n"]
    sizes = {r["lang"]: r["count"] for r in train.groupBy("lang").count().collect()}
    if not n:
        return None
    idf = np.log((1 + n) / (1 + df)).astype(np.float32) + 1
    held = train.sparkSession.sparkContext.broadcast(idf)
    share = F.pmod(F.xxhash64(F.lit(SALT), "doc_id", "text"), F.lit(1_000_000))
    rate = F.create_map(*[x for k, v in sizes.items() for x in (F.lit(k), F.lit(math.ceil(1e6 * min(1.0, sample / v))))])
    picked = train.where(share < F.element_at(rate, F.col("lang"))).select("lang", "text")

    def vectors(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(frames):
            rows = [(lang, v.tobytes()) for lang, text in zip(*(c.to_pylist() for c in batch.columns), strict=True) if (v := vector(text, held.value)) is not None]
            if rows:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.binary()), strict=True)], names=["lang", "v"])

    def fit(group: pa.Table) -> pa.Table:
        """One language's centroids; about SAMPLE vectors, in the order of their bytes, so that no other order of rows or layout of files shows."""
        own = np.frombuffer(b"".join(sorted(group["v"].to_pylist())), np.float32).reshape(-1, DIMENSIONS)
        centres = clusters(own, CENTROIDS)
        least = float(np.quantile((own @ centres.T).max(axis=1), REJECT_QUANTILE)) * REJECT_SLACK
        n = len(centres)
        return pa.table([pa.array([group["lang"][0].as_py()] * n), pa.array(range(n), pa.int32()), pa.array([c.tobytes() for c in centres]), pa.array([least] * n)], names=["lang", "place", "centre", "least"])

    fitted = picked.mapInArrow(vectors, "lang string, v binary").groupBy("lang").applyInArrow(fit, "lang string, place int, centre binary, least double")
    rows = sorted(fitted.collect())  # CENTROIDS rows a language
    if not rows:
        return None
    centres = np.frombuffer(b"".join(bytes(r.centre) for r in rows), np.float32).reshape(-1, DIMENSIONS)
    return {"idf": idf, "centres": centres, "names": [r.lang for r in rows], "limits": np.array([r.least for r in rows])}


def clusters(points: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = 5) -> np.ndarray:
    """Unit centroids of spherical k-means; at most k, none empty."""
    rng = np.random.default_rng(seed)
    centres = points[rng.permutation(len(points))[:k]].copy()
    for _ in range(rounds):
        near = (points @ centres.T).argmax(axis=1)
        sums = [points[near == i].sum(axis=0) for i in range(len(centres)) if (near == i).any()]
        centres = np.stack([s / max(float(np.linalg.norm(s)), 1e-12) for s in sums])
    return centres


SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean"


def predict(docs: DataFrame, model: dict | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score and rejected, one row per row of docs."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (id_bucket(F.col("doc_id"), 4) == 2).alias("held_out"), "text")

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in batches(frames):
            lang, score, far = [], [], []
            for text in batch.column(2).to_pylist():
                v = vector(text, m["idf"]) if m else None
                if v is None:
                    lang.append("und"), score.append(0.0), far.append(True)
                    continue
                cosines = m["centres"] @ v
                best = int(cosines.argmax())
                lang.append(m["names"][best])
                score.append(min(1.0, max(0.0, float(cosines[best]))))
                far.append(bool(cosines[best] < m["limits"][best]))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(far, pa.bool_())], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return rows.mapInArrow(run, SCHEMA)


def identify(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Learn from the rows whose id remainder is not 2, predict all rows."""
    train = docs.where(id_bucket(F.col("doc_id"), 4) != 2).select("doc_id", "text", "lang")
    return predict(docs, learn(train, sample))
