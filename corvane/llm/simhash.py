"""SimHash near-duplicates with a Gray-order hierarchical index.

A text's fingerprint has a bit for each of 64 that is set in more than half of the
XXH64 values of its word shingles.  Fingerprints within ``LINK_BITS`` bits link;
documents are grouped by reachability.

Equal fingerprints are one node from the start.  Nodes meet in buckets: the 64
bits are cut into LINK_BITS + 2 blocks, two linked fingerprints agree on two of
them, so there is a bucket for each two blocks and their values (15 rows a node,
21 bits a bucket at 4 bits).  Inside a bucket the fingerprints are sorted by Gray
rank and a tree is built over the order: a node keeps the bits all fingerprints
below it share (mask and values).  Pairs of nodes are walked from the top; a pair is dropped as soon as the
differences among bits that both sides share exceed the limit, and so are whole
groups already known to be one component.  A bucket gives a spanning forest, never
all pairs.  Buckets that are large are cut into slices that are joined two by
two, so no task holds one.  The forests' edges are joined into components by
large-star and small-star rounds over written tables.

Null or empty text: fingerprint zero, linked like any other.  Fewer words than a
shingle: the whole sequence is one shingle.  A text of any length is hashed whole,
its shingles in pieces of bounded size.  Repeated rows: the same fingerprint, the
same component.  Links are between fingerprints, so rows that share an id but not
a text do not link, and rows without an id link like any others; a component in
which no row has an id has none itself.  A bit set in just half of the values is 0.
Empty table: no rows.  Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import batches, materialise

SHINGLE, SEED, LINK_BITS = 4, 42, 4
#: Fingerprints of one slice of a bucket, and children of an index node.
SLICE, FAN = 4096, 8

_U = np.uint64


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """The 64-bit SimHash of a text as an unsigned number."""
    words = (text or "").encode().lower().split()  # bytes: only A-Z are lowered, only ASCII white space splits
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= size:
        return xxhash.xxh64_intdigest(line, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    pairs = zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist(), strict=True)
    n = len(words) - size + 1
    return majority(np.fromiter((digest(line[a:b], SEED) for a, b in pairs), _U, n))


def majority(values: np.ndarray) -> int:
    """The bits that are set in more than half of the values."""
    total = np.zeros(64, np.int64)
    for at in range(0, len(values), 65536):
        bits = np.unpackbits(values[at : at + 65536].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(values), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long), one row per row of docs."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(frames):
            values = np.array([fingerprint(t) for t in batch.column(1).to_pylist()], _U).view(np.int64)
            yield pa.record_batch([batch.column(0), pa.array(values, pa.int64())], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def gray_rank(values: np.ndarray) -> np.ndarray:
    """Place of each pattern in the reflected Gray code: neighbours in order differ in few bits."""
    out = values.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        out ^= out >> _U(shift)
    return out


class GrayIndex:
    """Hierarchy over fingerprints in Gray order; ``order`` sorts the given values."""

    def __init__(self, values: np.ndarray):
        self.order = np.argsort(gray_rank(values), kind="stable")
        leaves = values[self.order]
        full = np.full(len(leaves), ~_U(0))
        self.levels = [(leaves, full)]  # shared values, mask of shared bits; leaves first
        while len(leaves) > 1:
            cuts = np.arange(0, len(leaves), FAN)
            both, some = np.bitwise_and.reduceat(leaves & full, cuts), np.bitwise_or.reduceat(leaves & full, cuts)
            full = np.bitwise_and.reduceat(full, cuts) & ~(both ^ some)
            leaves = both & full
            self.levels.append((leaves, full))


class Forest:
    """Union-find over numbered nodes that keeps the edges it needed."""

    def __init__(self, n: int):
        self.parent = np.arange(n)
        self.edges: list[tuple[int, int]] = []

    def roots(self) -> np.ndarray:
        p = self.parent
        while True:
            q = p[p]
            if np.array_equal(q, p):
                self.parent = p
                return p
            p = q

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        """Union the linked pairs (a[i], b[i])."""
        while len(a):
            p = self.roots()
            x, y = p[a], p[b]
            live = x != y
            a, b, x, y = a[live], b[live], x[live], y[live]
            if not len(a):
                return
            low, high = np.minimum(x, y), np.maximum(x, y)
            _, first = np.unique(high, return_index=True)  # one hook per root and round: no cycle, as low < high
            self.parent[high[first]] = low[first]
            self.edges += list(zip(a[first].tolist(), b[first].tolist(), strict=True))


def walk(left: np.ndarray, right: np.ndarray | None, limit: int, roots: Callable[[], np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs within ``limit`` bits (left against right, or against itself) whose roots differ, in chunks of two arrays of places.

    Places count through left, then right.  ``roots`` gives the group of each place as known by then; whole tree nodes
    of one group are not walked against each other.
    """
    one = GrayIndex(left)
    two = one if right is None else GrayIndex(right)
    names = one.order, two.order + (0 if right is None else len(left))

    def grouped(index: GrayIndex, order: np.ndarray, level: int, known: np.ndarray) -> np.ndarray:
        """Root of each node of a level if all leaves below share it, else -1."""
        r = known[order]
        for _ in range(level):
            cuts = np.arange(0, len(r), FAN)
            r = np.where(np.minimum.reduceat(r, cuts) == np.maximum.reduceat(r, cuts), r[cuts], -1)
        return r

    # depth first over chunks of node pairs, so that what is found early prunes what comes later
    top_a, top_b = len(one.levels) - 1, len(two.levels) - 1
    stack = [(top_a, top_b, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while stack:
        la, lb, a, b = stack.pop()
        (va, ma), (vb, mb) = one.levels[la], two.levels[lb]
        near = np.bitwise_count((va[a] ^ vb[b]) & ma[a] & mb[b]) <= limit
        a, b = a[near], b[near]
        if not len(a):
            continue
        known = roots()
        ga, gb = grouped(one, names[0], la, known)[a], grouped(two, names[1], lb, known)[b]
        open_ = (ga != gb) | (ga < 0)
        a, b = a[open_], b[open_]
        if not len(a):
            continue
        if la == 0 and lb == 0:
            if right is None:
                a, b = a[a != b], b[a != b]
            yield names[0][a], names[1][b]
            continue
        down_a, down_b = la >= lb, lb >= la
        for n, down, which in ((len(one.levels[la - 1][0]) if down_a else 0, down_a, 0), (len(two.levels[lb - 1][0]) if down_b else 0, down_b, 1)):
            if down:
                old = a if which == 0 else b
                child = (old[:, None] * FAN + np.arange(FAN)).ravel()
                a, b = np.repeat(a, FAN), np.repeat(b, FAN)
                keep = child < n
                if which == 0:
                    a, b = child[keep], b[keep]
                else:
                    a, b = a[keep], child[keep]
        la, lb = la - down_a, lb - down_b
        if right is None and la == lb:
            a, b = a[a <= b], b[a <= b]
        step = 1 << 14
        stack += [(la, lb, a[i : i + step], b[i : i + step]) for i in range(0, len(a), step)][::-1]


def links(left: np.ndarray, right: np.ndarray | None, limit: int = LINK_BITS) -> list[tuple[int, int]]:
    """Edges of a spanning forest of all pairs within ``limit`` bits (left against right, or against itself)."""
    forest = Forest(len(left) + (0 if right is None else len(right)))
    for a, b in walk(left, right, limit, forest.roots):
        forest.add(a, b)
    return forest.edges


def block_values(limit: int, fp: str = "fp"):
    """Array of (block, value) of a fingerprint: two within ``limit`` bits agree on one.

    The bits are cut into limit + 2 blocks; differing bits touch ``limit`` of them at most, so two blocks agree whole.
    """
    n = limit + 2
    cuts = [64 * i // n for i in range(n + 1)]
    parts = []
    for number, pair in enumerate(combinations(range(n), 2)):
        mask = sum(((1 << cuts[i + 1]) - (1 << cuts[i])) for i in pair)
        parts.append(F.struct(F.lit(number).alias("block"), F.col(fp).bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask)).alias("value")))
    return F.array(*parts)


def sliced(keyed: DataFrame, keys: list[str], slices: Column, member: str) -> DataFrame:
    """keyed with slice, i and j: a large bucket is cut into slices by a hash of its members, and every two slices meet once."""
    cut = keyed.withColumn("slices", slices.cast("int")).withColumn("slice", F.pmod(F.xxhash64(member), F.col("slices")).cast("int"))
    both = lambda k: F.struct(F.least(k, F.col("slice")).alias("i"), F.greatest(k, F.col("slice")).alias("j"))
    met = cut.withColumn("pair", F.explode(F.transform(F.sequence(F.lit(0), F.col("slices") - 1), both)))
    return met.select(*keys, "pair.i", "pair.j", "slice", *[c for c in keyed.columns if c not in keys])


def edges(nodes: DataFrame, limit: int = LINK_BITS) -> DataFrame:
    """a, b: edges between fp values that connect whatever is within ``limit`` bits."""
    keyed = nodes.select("fp", F.explode(block_values(limit)).alias("at")).select("at.block", "at.value", "fp")
    counts = keyed.groupBy("block", "value").agg(F.count("*").alias("n")).where("n > 1")
    meet = sliced(keyed.join(counts, ["block", "value"]), ["block", "value"], F.ceil(F.col("n") / F.lit(SLICE)), "fp")
    cells = meet.groupBy("block", "value", "i", "j").agg(F.collect_list(F.struct("slice", "fp")).alias("members"))  # at most about 2 * SLICE

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in frames:
            out_a, out_b = [], []
            for i, j, members in zip(*(batch.column(n).to_pylist() for n in range(3)), strict=True):
                side = np.array([m["slice"] for m in members])
                fps = np.array([m["fp"] for m in members], np.int64)
                left, right = fps[side == i], fps[side == j]
                found = links(left.view(_U), None if i == j else right.view(_U), limit)
                every = left if i == j else np.concatenate((left, right))
                out_a += [int(every[x]) for x, _ in found]
                out_b += [int(every[y]) for _, y in found]
            if out_a:
                yield pa.record_batch([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], names=["a", "b"])

    return cells.select("i", "j", "members").mapInArrow(run, "a long, b long")


def components(pairs: DataFrame) -> DataFrame:
    """node, root: the least node reachable over the pairs (a, b); nodes without a pair are left out.

    Rounds of large-star and small-star, each written to the shared folder, until none changes an edge.
    """
    now = materialise(pairs.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "star")
    before = None
    while True:
        # large star: every node hangs its larger neighbours on its least neighbour
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: every node hangs its smaller neighbours on the least of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        now = materialise(small, "star")
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == before:
            return now.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node")
        before = mark


def near_duplicates(docs: DataFrame, limit: int = LINK_BITS) -> DataFrame:
    """doc_id, fingerprint and component_id (the least doc_id reachable) per row of docs."""
    marked = materialise(fingerprints(docs), "fingerprints")
    nodes = materialise(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    roots = components(edges(nodes.select("fp"), limit))  # over fingerprints: ids may be missing or name several texts
    group = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = group.groupBy("root").agg(F.min("least").alias("component_id"))
    group = group.join(least, "root").select("fp", "component_id")
    return marked.join(group, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
