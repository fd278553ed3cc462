"""One document of each group of near copies: five-word shingles, Jaccard similarity of 0.8 or more.

The SimHash operator for a threshold of similarity.  At a similarity of 0.8 two
fingerprints of 64 bits differ in 10 bits on average and in up to 26, so blocks of
equal bits (the pigeonhole buckets of ``simhash.edges``) would be two bits wide
and bring all documents together.  Buckets come from minimum hashes instead:
``BANDS`` bands of ``ROWS`` each; two texts that are just similar enough share none
with probability (1 - 0.8 ** ROWS) ** BANDS, about 3 in a million.  In a bucket the
fingerprints meet in the Gray-order index, and what it finds within ``LINK_BITS``
bits is checked on the texts' own shingles, so no link is an estimate.

A text is the set of its shingles; texts with the same set are one node.  Links
are looked for in two steps, so that a large group costs a pair a member: first
every node of a bucket against the bucket's least node; then, in buckets that
still hold more than one component, the nodes that the index and the signatures
(``HINT`` of the minimum hashes equal) pair with another component meet with their
texts, cell by cell, and each cell gives a spanning forest of its true links.
Groups are what is reachable over the links.

A row is named by its id and its text: rows that repeat both are one document,
rows without an id are reduced like any others.  Null or empty text: the empty
set, one node.  Fewer words than a shingle: the whole sequence is one shingle.
A text of any length is read whole; cells are cut by the shingles in them.
Empty table: no rows.  Extra columns pass through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import batches, free_name, materialise, sieve
from corvane.llm.common import named as by_name
from corvane.llm.simhash import components, majority, sliced, walk

SHINGLE, SIMILAR_NUM, SIMILAR_DEN = 5, 4, 5
BANDS, ROWS = 24, 4
#: Bits in which fingerprints of similar texts may differ: more than four standard deviations over the mean, short texts included.
LINK_BITS = 26
#: Share of equal minimum hashes below which a pair is not looked at: more than four standard deviations under 0.8.
HINT = 0.62
#: Nodes and shingles of one slice of a bucket.
SLICE, SLICE_SHINGLES = 1024, 1_000_000

_U = np.uint64
_DRAWN = np.random.default_rng(42)
_FACTOR = _DRAWN.integers(0, 2**64, BANDS * ROWS, _U) | _U(1)
_SHIFT = _DRAWN.integers(0, 2**64, BANDS * ROWS, _U)


def shingles(text: str | None, size: int = SHINGLE) -> set[bytes]:
    """The different runs of ``size`` words; only A-Z are lowered, only ASCII white space splits."""
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def hashed(found: set[bytes]) -> np.ndarray:
    """The sorted XXH64 values of shingles."""
    return np.sort(np.fromiter((xxhash.xxh64_intdigest(s, 42) for s in found), _U, len(found)))


def similar(one: set[bytes], two: set[bytes]) -> bool:
    """Jaccard similarity of 0.8 or more, in whole numbers; two empty sets are similar."""
    both = len(one & two)
    return SIMILAR_DEN * both >= SIMILAR_NUM * (len(one) + len(two) - both)


def signature(values: np.ndarray) -> tuple[bytes, np.ndarray, bytes]:
    """Name of a set of hashed shingles, its value in each band, and a byte of each minimum hash."""
    least = np.full(BANDS * ROWS, ~_U(0))
    for at in range(0, len(values), 2048):
        np.minimum(least, (values[at : at + 2048, None] * _FACTOR + _SHIFT).min(axis=0), out=least)
    rows = least.reshape(BANDS, ROWS)
    bands = np.array([xxhash.xxh64_intdigest(r.tobytes(), 7) for r in rows], _U).view(np.int64)
    return xxhash.xxh3_128_digest(values.tobytes()), bands, (least >> _U(40)).astype(np.uint8).tobytes()


MARKS = "k1 long, k2 long, doc_id long, n1 long, node binary, size int, fp long, bands array<long>, sign binary"


def signatures(rows: DataFrame) -> DataFrame:
    """Columns MARKS of rows (k1, k2, doc_id, text); n1 is the first half of the node's name."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(frames):
            texts = batch.column(3).to_pylist()
            sets = [hashed(shingles(t)) for t in texts]
            found = [signature(s) for s in sets]
            flat = np.concatenate([x[1] for x in found]) if found else np.zeros(0, np.int64)
            bands = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1) * BANDS, pa.int32()), pa.array(flat, pa.int64()))
            first = np.frombuffer(b"".join(x[0][:8] for x in found), np.int64)
            fps = np.array([majority(s) for s in sets], _U).view(np.int64)
            node, sign = (pa.array([x[i] for x in found], pa.binary()) for i in (0, 2))
            sizes = pa.array([len(s) for s in sets], pa.int32())
            yield pa.record_batch([*batch.columns[:3], pa.array(first), node, sizes, pa.array(fps), bands, sign], names=[x.split()[0] for x in MARKS.split(", ")])

    return rows.mapInArrow(run, MARKS)


def checked(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """a, b: the nodes of the pairs (a, b) of n1 whose texts are similar."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, set()
        for frame in frames:
            for batch in batches([frame]):
                keep = []
                for a, one, two in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
                    if a != last:
                        last, held = a, shingles(one)
                    keep.append(similar(held, shingles(two)))
                yield pa.record_batch(batch.columns[:2], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    of = lambda side: texts.select(F.col("n1").alias(side), F.col("node").alias(f"n{side}"), F.col("text").alias(f"t{side}"))
    return pairs.join(of("b"), "b").join(of("a"), "a").select("na", "nb", "ta", "tb").mapInArrow(run, "a binary, b binary")


def candidates(fps: np.ndarray, cut: int, signs: np.ndarray, bands: np.ndarray, roots: np.ndarray, band: int) -> np.ndarray:
    """Places with a partner of another root: within LINK_BITS by the Gray index, equal in HINT of the signature, and in no
    earlier band together.  From ``cut`` on (if not 0) places are of the other slice."""
    found = np.zeros(len(fps), bool)
    for a, b in walk(fps[:cut] if cut else fps, fps[cut:] if cut else None, LINK_BITS, lambda: roots):
        for at in range(0, len(a), 8192):
            x, y = a[at : at + 8192], b[at : at + 8192]
            near = (roots[x] != roots[y]) & ((signs[x] == signs[y]).mean(axis=1) >= HINT)
            x, y = x[near], y[near]
            own = ~(bands[x, :band] == bands[y, :band]).any(axis=1)
            found[x[own]] = found[y[own]] = True
    return found


def forest(sets: list[np.ndarray], roots: list[bytes]) -> list[tuple[int, int]]:
    """Edges between sets of different roots that, with the roots, connect all pairs of a similarity of 0.8 or more.

    Breadth first: each set reached is held against all that are not yet reached, at once.
    """
    n, sizes = len(sets), np.array([len(s) for s in sets])
    _, word = np.unique(np.concatenate(sets), return_inverse=True)
    cuts, owner = np.concatenate(([0], np.cumsum(sizes))), np.repeat(np.arange(n), sizes)
    _, group = np.unique(np.array(roots, object), return_inverse=True)
    left, out = np.ones(n, bool), []
    live_word, live_owner, live = word, owner, n
    mark = np.zeros(int(word.max(initial=-1)) + 1, bool)
    while left.any():
        queue = np.flatnonzero(left & (group == group[left.argmax()])).tolist()
        left[queue] = False
        while queue and left.any():
            x = queue.pop()
            if 2 * left.sum() < live:  # drop what has been reached
                stay = left[live_owner]
                live_word, live_owner, live = live_word[stay], live_owner[stay], int(left.sum())
            own = word[cuts[x] : cuts[x + 1]]
            mark[own] = True
            both = np.bincount(live_owner[mark[live_word]], minlength=n)
            mark[own] = False
            for y in np.flatnonzero(left & (SIMILAR_DEN * both >= SIMILAR_NUM * (sizes[x] + sizes - both))).tolist():
                if left[y]:
                    out.append((x, y))
                    joined = np.flatnonzero(left & (group == group[y]))
                    left[joined] = False
                    queue += joined.tolist()
    return out


def unsettled(keyed: DataFrame, nodes: DataFrame, roots: DataFrame, texts: DataFrame) -> DataFrame:
    """a, b: links of nodes in buckets that hold more than one component."""
    group = nodes.select("n1", "node", "size").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    rows = keyed.join(group, "n1")
    counts = rows.groupBy("band", "value").agg(F.count("*").alias("n"), F.sum("size").alias("words"), F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y AND n > 2")
    slices = F.ceil(F.greatest(F.col("n") / F.lit(SLICE), F.col("words") / F.lit(SLICE_SHINGLES)))
    rows = rows.join(counts.select("band", "value", slices.alias("parts")), ["band", "value"]).drop("size", "n1").join(nodes.select("node", "fp", "bands", "sign"), "node")
    key = ["band", "value", "i", "j"]
    cells = sliced(rows, ["band", "value"], F.col("parts"), "node").drop("parts")

    def chosen(group: pa.Table) -> pa.Table:
        i, j = group["i"][0].as_py(), group["j"][0].as_py()
        group = group.sort_by("slice")
        sides = group["slice"].to_numpy()
        signs = np.frombuffer(b"".join(group["sign"].to_pylist()), np.uint8).reshape(len(sides), -1)
        bands = np.array(group["bands"].to_pylist(), np.int64)
        _, own = np.unique(np.array(group["root"].to_pylist(), object), return_inverse=True)
        cut = 0 if i == j else int(np.searchsorted(sides, j))
        if i != j and cut in (0, len(sides)):
            return group.select([*key, "node", "root"]).slice(0, 0)
        found = candidates(group["fp"].to_numpy().view(_U), cut, signs, bands, own, group["band"][0].as_py())
        return group.select([*key, "node", "root"]).filter(pa.array(found))

    met = cells.groupBy(*key).applyInArrow(chosen, cells.select(*key, "node", "root").schema)  # at most about 2 * SLICE rows

    def linked(group: pa.Table) -> pa.Table:
        nodes = group["node"].to_pylist()
        found = forest([hashed(shingles(t)) for t in group["text"].to_pylist()], group["root"].to_pylist())
        return pa.table({"a": pa.array([nodes[x] for x, _ in found], pa.binary()), "b": pa.array([nodes[y] for _, y in found], pa.binary())})

    return met.join(texts.select("node", "text"), "node").groupBy(*key).applyInArrow(linked, "a binary, b binary")


def near_copies(docs: DataFrame) -> DataFrame:
    """k1, k2, doc_id, node, root per row of docs (k1, k2, doc_id, text): rows with the same root are near copies."""
    marked = materialise(signatures(docs), "signatures")
    nodes = materialise(marked.groupBy("node", "n1", "size", "fp", "sign").agg(F.min(F.struct("k1", "k2")).alias("k"), F.first("bands").alias("bands")), "nodes")
    keyed = nodes.select("n1", F.posexplode("bands").alias("band", "value"))
    counts = keyed.groupBy("band", "value").agg(F.count("*").alias("n"), F.min("n1").alias("least")).where("n > 1")
    keyed = materialise(keyed.join(counts, ["band", "value"]).select("band", "value", "n1", "least"), "buckets")
    keys = nodes.join(keyed.select("n1").distinct(), "n1", "left_semi").select("k.k1", "k.k2", "n1", "node")
    some = docs.select("k1", "k2", "text").where(sieve(keys, "k1")("k1"))  # few texts are in groups: only they are shuffled
    texts = materialise(some.join(keys, ["k1", "k2"]).dropDuplicates(["node"]).select("n1", "node", "text"), "texts")
    fps = lambda side: nodes.select(F.col("n1").alias(side), F.col("fp").alias(f"f{side}"))
    stars = keyed.where("n1 <> least").select(F.col("least").alias("a"), F.col("n1").alias("b")).distinct()
    stars = stars.join(fps("a"), "a").join(fps("b"), "b").where(F.bit_count(F.col("fa").bitwiseXOR(F.col("fb"))) <= LINK_BITS).select("a", "b")
    first = materialise(checked(stars, texts), "links")
    roots = components(first)
    more = materialise(unsettled(keyed.drop("least"), nodes, roots, texts), "links")
    roots = components(first.unionByName(more)) if more.take(1) else roots
    return marked.select("k1", "k2", "doc_id", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs with one row of each group, of the least doc_id (rows without one come last); columns stay."""
    k1 = free_name(docs, "k1")
    k2 = free_name(docs.withColumn(k1, F.lit(0)), "k2")
    named = docs.withColumn(k1, F.xxhash64(F.lit(1), "doc_id", "text")).withColumn(k2, F.xxhash64(F.lit(2), "text", "doc_id"))
    groups = near_copies(named.select(F.col(k1).alias("k1"), F.col(k2).alias("k2"), F.col("doc_id").cast("long").alias("doc_id"), "text"))
    # rows that are not alone in their group are sorted out by a join; all others never move
    mine = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k1", "k2")
    kept = groups.groupBy("root").agg(F.count("*").alias("n"), F.min(mine).alias("k")).where("n > 1").select("root", "k")
    kept = materialise(kept, "kept")  # so that the join below has no sums under it, and its hot groups can be split
    shared = materialise(groups.join(kept, "root").select(F.col("k1").alias(k1), F.col("k2").alias(k2), ((F.col("k1") == F.col("k.k1")) & (F.col("k2") == F.col("k.k2"))).alias("stays")).distinct(), "shared")
    maybe = sieve(shared, k1)(k1)
    alone = named.where(~maybe).select(*(by_name(c) for c in docs.columns))
    stays = free_name(docs, "stays")
    rest = named.where(maybe).join(shared.withColumnRenamed("stays", stays), [k1, k2], "left").where(F.coalesce(F.col(stays), F.lit(True))).dropDuplicates([k1, k2])
    return alone.unionByName(rest.select(*(by_name(c) for c in docs.columns)))
