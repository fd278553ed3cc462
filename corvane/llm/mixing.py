"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

1. Every source gets a word target by weight; no target exceeds twice its source,
   the excess is reshared by weight (water filling).
2. The documents of a source are dealt into blocks by a hash of id, source and text,
   up to ``MAX_BLOCKS`` per source, so a hot source is many blocks and no task holds
   it.  One pass over the texts sums words by source and block.
3. Blocks are permuted by hash.  A source gives every block once per whole pass
   and, for the rest of its target, the first blocks of the permutation; of the
   block that crosses the target it gives the documents with the least hashes, and
   after the first that does not fit each later one that still does; one more ends
   it where that comes nearer to the target.  Blocks drawn in one pass are disjoint, so no document is taken more than twice.
4. The exact numbers of drawn blocks per source are split among the output shards
   by a binary tree: each node draws its left half's share of every source from a
   multivariate hypergeometric distribution, seeded by its place in the tree.
5. Inside a shard rows are shuffled by a hash.

Every row is a document: rows that share an id, or have none, are told apart by
source and text, and only rows equal in all three share their place in the draw.
The same rows and seed give the same mix, however they are stored.  Null text:
size 0, never taken.  A null source is a source of its own, last in order.  Empty
table: empty mix.  A very long text is one document of its block.  Extra columns
pass through, whatever their names.

To the driver come a row per source and the numbers of blocks drawn from it, never
blocks or documents.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.common import free_name, materialise, named, word_count

WEIGHTS = (3.0, 1.0, 2.0)
SHARE, MAX_COPIES = 1.5, 2
#: A power of two; and documents a block has on average, at least.
MAX_BLOCKS, DOCS_PER_BLOCK = 4096, 32
#: Words of one output shard, and the most shards.
SHARD_WORDS, MAX_SHARDS = 2_000_000, 4096
#: Rows of the plan of blocks up to which it is sent to every task; beyond, it is joined by shuffle.
BROADCAST_BLOCKS = 250_000


def targets(sizes: list[tuple[str | None, int]], weights=WEIGHTS, share: float = SHARE, copies: int = MAX_COPIES) -> dict[str | None, float]:
    """Word target of each source: weights repeat over the sources by code point (null last)."""
    order = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    left, open_ = share * sum(n for _, n in order), []
    for i, (name, n) in enumerate(order):
        open_.append((copies * n / weights[i % len(weights)], weights[i % len(weights)], name, copies * n))
    open_.sort(key=lambda x: x[0])
    out, total = {}, sum(x[1] for x in open_)
    for level, weight, name, cap in open_:
        if total and left / total > level:  # its share by weight is above its cap
            out[name] = float(cap)
            left, total = left - cap, total - weight
        else:
            out[name] = left / total * weight
    return out


def split(counts: list[int], shards: int, seed: int) -> list[tuple[list[int], list[int]]]:
    """Per source the shards that get any of its blocks, and how many blocks; a node of the tree holds only sources it has blocks of."""
    out: list[tuple[list[int], list[int]]] = [([], []) for _ in counts]

    def node(first: int, last: int, who: np.ndarray, have: np.ndarray) -> None:
        who, have = who[have > 0], have[have > 0]
        if not len(who):
            return
        if last - first == 1:
            for x, n in zip(who.tolist(), have.tolist(), strict=True):
                out[x][0].append(first)
                out[x][1].append(n)
            return
        middle = (first + last) // 2
        want = int(have.sum()) * (middle - first) // (last - first)
        draw = np.random.default_rng([seed, first, last]).multivariate_hypergeometric(have, want, method="marginals")
        node(first, middle, who, draw)
        node(middle, last, who, have - draw)

    node(0, shards, np.arange(len(counts)), np.asarray(counts, dtype=np.int64))
    return out


def _hash(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), "doc_id", "source", "text")


def planned(docs: DataFrame, seed: int = 17, shard_words: int = SHARD_WORDS, weights=WEIGHTS, prefix: str = "") -> DataFrame:
    """docs with size, source_size, target and shards (one output shard per copy taken), one row per row; ``prefix`` precedes the new names."""
    spark = docs.sparkSession
    cell = F.pmod(_hash(seed), F.lit(MAX_BLOCKS)).cast("int")
    cells = docs.select("source", cell.alias("cell"), word_count(F.col("text")).alias("size"))
    cells = materialise(cells.groupBy("source", "cell").agg(F.sum("size").alias("words"), F.count("*").alias("docs")), "mix-cells")
    stats = cells.groupBy("source").agg(F.sum("words").alias("words"), F.sum("docs").alias("docs")).collect()  # one row per source
    goal = targets([(r["source"], r["words"]) for r in stats], weights)
    n_blocks = lambda docs: int(min(MAX_BLOCKS, 1 << (docs // DOCS_PER_BLOCK).bit_length()))
    per = spark.createDataFrame([(r["source"], int(r["words"]), goal[r["source"]], n_blocks(r["docs"])) for r in stats], "source string, source_size long, target double, n_blocks int")
    blocks = _join_small(cells, per, ["source"], len(stats)).withColumn("block", F.col("cell") % F.col("n_blocks"))
    blocks = blocks.groupBy("source", "source_size", "target", "n_blocks", "block").agg(F.sum("words").alias("words"))
    permuted = Window.partitionBy("source").orderBy(F.xxhash64(F.lit(seed), "source", "block"), "block")
    blocks = (
        blocks.withColumn("whole", (F.col("target") >= F.col("source_size")).cast("int"))
        .withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
        .withColumn("end", F.sum("words").over(permuted.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("place", F.row_number().over(permuted))
        .withColumn("full", F.col("end") <= F.col("rest"))
        .withColumn("room", F.when(~F.col("full") & (F.col("end") - F.col("words") < F.col("rest")), F.col("rest") - F.col("end") + F.col("words")))
        .withColumn("again", (F.col("full") | F.col("room").isNotNull()).cast("int"))
    )
    blocks = materialise(blocks, "mix-blocks")  # at most MAX_BLOCKS rows a source
    drawn = blocks.groupBy("source").agg(F.sum(F.col("whole") + F.col("again")).alias("n"), F.sum("whole").alias("n_whole"), F.count("*").alias("blocks")).collect()
    drawn.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    total = sum(r["blocks"] for r in drawn)
    shards = int(min(MAX_SHARDS, max(1, -(-sum(goal.values()) // shard_words))))
    quota = split([r["n"] for r in drawn], shards, seed)
    ends = spark.createDataFrame([(r["source"], r["n_whole"], at, np.cumsum(n).tolist()) for r, (at, n) in zip(drawn, quota, strict=True)], "source string, n_whole long, at array<int>, ends array<long>")
    # the draw of rank r goes to the shard whose quota it falls in
    shard = lambda rank: F.element_at("at", F.size(F.filter("ends", lambda e: e < rank)) + 1)
    # in the crossing block: the largest hash up to which all are taken, and the hashes beyond of what still fits
    crossing = blocks.where("room IS NOT NULL").select("source", "block", "n_blocks", "room")
    rank = F.xxhash64(F.lit(seed + 1), "doc_id", "source", "text")
    inside = docs.select("source", cell.alias("cell"), rank.alias("rank"), word_count(F.col("text")).alias("size"))
    inside = _join_small(inside, crossing, ["source"], len(drawn)).where(F.col("cell") % F.col("n_blocks") == F.col("block"))
    inside = inside.groupBy("source", "room", "rank").agg(F.sum("size").alias("size"))
    cuts = inside.groupBy("source").applyInPandas(_fitting, "source string, cut long, more array<long>")  # a source's block: its words over MAX_BLOCKS, as hashes and sizes
    none = F.array().cast("array<int>")
    blocks = _join_small(blocks, ends, ["source"], len(drawn)).select(
        "source", "block", "n_blocks", "source_size", "target", "room",
        F.when(F.col("whole") == 1, F.array(shard(F.col("place")))).otherwise(none).alias("first"),
        F.when(F.col("again") == 1, F.array(shard(F.col("place") + F.col("n_whole")))).otherwise(none).alias("second"),
    )
    plan = materialise(_join_small(blocks, cuts, ["source"], len(drawn), "left").withColumn("part", F.when(F.col("room").isNull(), True).otherwise(False)), "mix-plan")
    new = {n: free_name(docs, f"{prefix}{n}") for n in ("size", "source_size", "target", "shards")}
    held, count = free_name(docs, "__plan"), free_name(docs, "__blocks")
    # every row finds its number of blocks by source, then its block's plan
    rows = _join_small(docs, plan.groupBy("source").agg(F.first("n_blocks").alias(count)), ["source"], len(drawn), "left")
    packed = plan.select("source", F.col("block").alias("__block"), F.struct("source_size", "target", "first", "second", "part", "cut", "more").alias(held))
    block = free_name(rows, "__block")
    rows = rows.withColumn(block, cell % F.col(count))
    rows = _join_small(rows, packed.withColumnRenamed("__block", block), ["source", block], total, "left")
    of = lambda n: F.col(f"{held}.{n}")
    taken = of("part") | F.coalesce(rank <= of("cut"), F.lit(False)) | F.coalesce(F.array_contains(of("more"), rank), F.lit(False))
    second = F.when(taken, of("second")).otherwise(none)
    shards_of = F.when(F.coalesce(F.col("text"), F.lit("")).rlike(r"[^ \t-\r]"), F.concat(of("first"), second)).otherwise(none)
    made = [word_count(F.col("text")).alias(new["size"]), of("source_size").alias(new["source_size"]), of("target").alias(new["target"]), shards_of.alias(new["shards"])]
    return rows.select(*(named(c) for c in docs.columns), *made)


def _fitting(block: pd.DataFrame) -> pd.DataFrame:
    """cut and more of one crossing block (source, room, rank, size)."""
    block = block.sort_values("rank")
    room, sizes, ranks = float(block["room"].iloc[0]), block["size"].tolist(), block["rank"].tolist()
    n = int(np.searchsorted(np.cumsum(sizes), room, "right"))
    left, more, rest = room - sum(sizes[:n]), [], []
    for size, rank in zip(sizes[n:], ranks[n:], strict=True):
        if size <= left:
            more.append(rank)
            left -= size
        else:
            rest.append((size, rank))
    if rest and min(rest)[0] - left < left:
        more.append(min(rest)[1])
    return pd.DataFrame({"source": [block["source"].iloc[0]], "cut": pd.array([ranks[n - 1] if n else None], "Int64"), "more": [more]})


def decide(docs: DataFrame, seed: int = 17, shard_words: int = SHARD_WORDS, weights=WEIGHTS) -> DataFrame:
    """doc_id, size, source, source_size, target and shards: one output shard per copy taken, one row per row of docs."""
    rows = planned(docs.select("doc_id", "source", "text"), seed, shard_words, weights)
    return rows.select("doc_id", "size", "source", "source_size", "target", "shards")


def _join_small(rows: DataFrame, small: DataFrame, keys: list[str], n: int, how: str = "inner") -> DataFrame:
    """Null-safe join with a table of n rows: sent to every task up to BROADCAST_BLOCKS rows, else shuffled."""
    names = {k: f"__of_{k}" for k in keys}
    small = small.withColumnsRenamed(names)
    on = F.lit(True)
    for k, other in names.items():
        on = on & F.col(k).eqNullSafe(F.col(other))
    return rows.join(F.broadcast(small) if n <= BROADCAST_BLOCKS else small, on, how).drop(*names.values())


def mix(docs: DataFrame, seed: int = 17, shard_words: int = SHARD_WORDS, weights=WEIGHTS) -> DataFrame:
    """The mixed corpus: docs' columns plus mix_shard and mix_copy, one row per copy taken, shuffled inside shards."""
    shards, copy, shard = (free_name(docs, n) for n in ("mix_shards", "mix_copy", "mix_shard"))
    rows = planned(docs, seed, shard_words, weights, "__mix_")
    rows = rows.select(*(named(c) for c in docs.columns), F.col(rows.columns[-1]).alias(shards))
    rows = rows.select("*", F.posexplode(shards).alias(copy, shard)).drop(shards)
    return rows.repartition(shard).sortWithinPartitions(shard, F.xxhash64(F.lit(seed), "doc_id", "source", "text", copy))
