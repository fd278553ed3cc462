"""Vector compression: product codes of integer vectors, learnt exactly over all of them.

Vectors are scaled to integers, cut into parts and packed into columnar blocks: a
block is a NumPy array with a row per component and a column per vector, stored as
bytes in the shared folder.  Each round is one ``treeAggregate`` over the blocks of
an RDD: a task accumulates squared distances dimension by dimension, takes the
nearest entry, adds into int64 tensors of sums and counts with ``np.add.at``, and
the tensors (some ten kilobytes each) merge through a reduction tree.  Sums are of
integers, so neither the layout of rows nor the order of merging changes a bit.

Rows go whose vector is null or holds a null or non-finite component, or one beyond
``MOST`` (with it an error might not fit a long).  A kept vector's length has to be
that of the first kept vector, by vec_id, whose length is a multiple of ``PARTS``;
others (the empty one included) go too, as no codebook fits them.  The starting entries are
of the smallest vec_ids (null last; of rows that share an id by components); fewer
rows than entries make smaller codebooks.  Repeated rows count as often as they
come.  Equal distances: the lower entry.  Empty table: no rows.  Extra columns are
not read.

The blocks are read once a round and written once; to the driver come one tensor a
branch of the tree, never vectors but the starting ones.  A label may hold any share
of the rows: error sums are combined in the tasks, and sent back by broadcast up to
``BROADCAST_LABELS`` labels, else joined by shuffle, where large labels are split.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm.common import batches, materialise

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: The largest component, before scaling, for which all distances fit an int64.
MOST = float(1 << 27) / SCALE
#: Vectors of a block.
BLOCK = 2048
#: Labels up to which their error sums are sent to every task.
BROADCAST_LABELS = 100_000


def pack(embeddings: DataFrame) -> DataFrame:
    """Blocks of the rows kept: dim, n, width (bytes a component), values (dim x n, row by row), vec_ids, labels."""
    label = embeddings.schema["label"].dataType
    kind = T.StructType(
        [T.StructField(n, t) for n, t in (("dim", T.IntegerType()), ("n", T.IntegerType()), ("width", T.IntegerType()), ("values", T.BinaryType()), ("vec_ids", T.ArrayType(T.LongType())), ("labels", T.ArrayType(label)))]
    )

    def blocks(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        vectors = batch.column(2)
        sizes = vectors.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
        flat = vectors.flatten()
        ends = np.cumsum(np.maximum(sizes, 0))
        values = flat.to_numpy(zero_copy_only=False).astype(np.float64)  # nulls become NaN
        good = np.concatenate(([0], np.cumsum(np.isfinite(values) & (np.abs(values) <= MOST))))
        kept = (sizes > 0) & (good[ends] - good[ends - np.maximum(sizes, 0)] == sizes)
        for dim in np.unique(sizes[kept]).tolist():
            rows = np.flatnonzero(kept & (sizes == dim))
            for at in range(0, len(rows), BLOCK):
                some = rows[at : at + BLOCK]
                block = np.floor(values[(ends[some] - dim) + np.arange(dim)[:, None]] * SCALE).astype(np.int64)
                width = 2 if -(1 << 15) <= block.min() and block.max() < 1 << 15 else 4
                ids = [pa.ListArray.from_arrays(pa.array([0, len(some)], pa.int32()), batch.column(i).take(pa.array(some))) for i in (0, 1)]
                data = [pa.array([x], pa.int32()) for x in (dim, len(some), width)] + [pa.array([block.astype(f"<i{width}").tobytes()], pa.binary()), *ids]
                yield pa.record_batch(data, names=kind.names)

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(frames):
            yield from blocks(batch)

    return embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding").mapInArrow(run, kind)


def unpack(values: bytes, dim: int, width: int) -> np.ndarray:
    return np.frombuffer(values, f"<i{width}").reshape(dim, -1).astype(np.int64)


def nearest(block: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes (part x vector) and squared distances summed over parts; books is part x component x entry."""
    parts, width, entries = books.shape
    codes, errors = np.empty((parts, block.shape[1]), np.int64), np.zeros(block.shape[1], np.int64)
    for part in range(parts):
        distance = np.zeros((entries, block.shape[1]), np.int64)
        for j in range(width):
            gap = block[part * width + j] - books[part, j][:, None]
            distance += gap * gap
        codes[part] = distance.argmin(0)
        errors += distance.min(0)
    return codes, errors


def gathered(block: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per entry the sum of the parts nearest to it (part x component x entry), and their number (part x entry)."""
    parts, width, entries = books.shape
    codes, _ = nearest(block, books)
    sums, counts = np.zeros(books.shape, np.int64), np.zeros((parts, entries), np.int64)
    for part in range(parts):
        np.add.at(counts[part], codes[part], 1)
        for j in range(width):
            np.add.at(sums[part, j], codes[part], block[part * width + j])
    return sums, counts


def depth_of(partitions: int) -> int:
    """Depth of the reduction tree: no node, the driver among them, merges over some hundred tensors."""
    return max(2, int(np.ceil(np.log(max(2, partitions)) / np.log(100))))


def smallest(rows: list, n: int = ENTRIES) -> list:
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:n]


def train(blocks: DataFrame, dim: int, rounds: int = ROUNDS, entries: int = ENTRIES) -> np.ndarray:
    """The codebooks after all rounds, part x component x entry."""
    rdd = blocks.select("vec_ids", "values", "width").rdd
    depth = depth_of(rdd.getNumPartitions())

    def heads(found: list, row) -> list:
        ids, order = row[0], np.argsort([np.iinfo(np.int64).max if x is None else x for x in row[0]], kind="stable")
        last = ids[order[min(entries, len(ids)) - 1]]
        some = [i for i in order if last is None or ids[i] is not None and ids[i] <= last]  # rows that share the last id too
        block = unpack(row[1], dim, row[2])
        return smallest(found + [(ids[i], tuple(block[:, i].tolist())) for i in some], entries)

    first = rdd.treeAggregate([], heads, lambda a, b: smallest(a + b, entries), depth)
    books = np.array([v for _, v in first], np.int64).reshape(len(first), PARTS, dim // PARTS).transpose(1, 2, 0).copy()
    packed = blocks.select("values", "width").rdd
    context = blocks.sparkSession.sparkContext
    for _ in range(rounds):
        sent = context.broadcast(books)  # a few kilobytes

        def add(total, row, sent=sent):
            sums, counts = gathered(unpack(row[0], dim, row[1]), sent.value)
            return (sums, counts) if total is None else (total[0] + sums, total[1] + counts)

        def merge(a, b):
            return a or b if a is None or b is None else (a[0] + b[0], a[1] + b[1])

        sums, counts = packed.treeAggregate(None, add, merge, depth)
        books = np.where(counts[:, None, :] > 0, sums // np.maximum(counts, 1)[:, None, :], books)
        sent.unpersist()
    return books


def digest(books: np.ndarray) -> str:
    """All entries' components in order of part, entry and component, as decimal numbers between commas, hashed."""
    return hashlib.sha256(",".join(map(str, books.transpose(0, 2, 1).ravel().tolist())).encode()).hexdigest()


def encode(blocks: DataFrame, books: np.ndarray, label: T.DataType) -> DataFrame:
    """vec_id, label, code (two hex digits a part) and error of every vector."""
    kind = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("label", label), T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    hexes = np.array([f"{i:02x}" for i in range(256)])
    dim = books.shape[0] * books.shape[1]

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in frames:
            for i in range(batch.num_rows):
                codes, errors = nearest(unpack(batch.column(3)[i].as_py(), dim, batch.column(2)[i].as_py()), books)
                text = ["".join(x) for x in hexes[codes.T]]
                yield pa.record_batch([batch.column(0)[i].values, batch.column(1)[i].values, pa.array(text, pa.string()), pa.array(errors)], names=kind.names)

    return blocks.select("vec_ids", "labels", "width", "values").mapInArrow(run, kind)


def compress(embeddings: DataFrame, rounds: int = ROUNDS, entries: int = ENTRIES) -> DataFrame:
    """Per vector kept: vec_id, code, error, label_error (error summed over equal labels, nulls together), codebooks_sha256."""
    spark, label = embeddings.sparkSession, embeddings.schema["label"].dataType
    blocks = materialise(pack(embeddings), "code-blocks")
    fits = blocks.where((F.col("dim") % PARTS == 0) & (F.col("dim") > 0))
    found = fits.select(F.min(F.struct(F.array_min("vec_ids").isNull(), F.array_min("vec_ids"), "dim"))).first()[0]
    if found is None:
        return spark.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    blocks = fits.where(F.col("dim") == found["dim"])
    books = train(blocks, found["dim"], rounds, entries)
    coded = materialise(encode(blocks, books, label), "codes")
    sums = materialise(coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")), "code-sums")
    small = sums.count() <= BROADCAST_LABELS
    rows = coded.join(F.broadcast(sums) if small else sums, F.col("label").eqNullSafe(F.col("of")))
    return rows.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _sql(rounds: int = ROUNDS) -> str:
    """DuckDB twin: the rounds as one common table each, parts in rows."""
    width = 8
    gap = " + ".join(f"(v[{j}] - c[{j}]) * (v[{j}] - c[{j}])" for j in range(1, width + 1))
    floored = lambda j: f"(sum(v[{j}]) - ((sum(v[{j}]) % count(*)) + count(*)) % count(*)) // count(*)"
    means = ", ".join(f"CAST({floored(j)} AS BIGINT)" for j in range(1, width + 1))
    steps = []
    for r in range(rounds + 1):
        steps.append(
            f"near{r} AS MATERIALIZED (SELECT row, p.part, v, arg_min(k, d * {ENTRIES} + k) AS k, min(d) AS d FROM"
            f" (SELECT row, parts.part, v, k, {gap} AS d FROM parts JOIN book{r} ON parts.part = book{r}.part) p GROUP BY row, p.part, v)"
        )
        if r < rounds:
            steps.append(
                f"book{r + 1} AS MATERIALIZED (SELECT b.part, b.k, coalesce(m.c, b.c) AS c FROM book{r} b LEFT JOIN"
                f" (SELECT part, k, [{means}] AS c FROM near{r} GROUP BY part, k) m ON b.part = m.part AND b.k = m.k)"
            )
    return f"""
WITH kept AS MATERIALIZED (
    SELECT row_number() OVER (ORDER BY vec_id, embedding) AS row, vec_id, label, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * {SCALE}) AS BIGINT)) AS v
    FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT row, part, v[part * {width} + 1 : part * {width} + {width}] AS v FROM kept, (SELECT unnest(range({PARTS})) AS part)),
book0 AS MATERIALIZED (SELECT part, row - 1 AS k, v AS c FROM parts WHERE row <= {ENTRIES}),
{", ".join(steps)},
digest AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, k)) AS codebooks_sha256 FROM book{rounds}),
coded AS (SELECT row, string_agg(printf('%02x', k), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM near{rounds} GROUP BY row)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM coded JOIN kept USING (row), digest
"""


ORACLE = _sql()
