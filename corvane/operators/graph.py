"""Graph operators over edge tables (source, target)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.sources.store import materialise, tasks


def nodes_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("source").alias("node")).union(edges.select(F.col("target").alias("node"))).distinct()


def imports_of(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Targets of the seeds' edges: source, target."""
    return edges.join(seeds.select(F.col("node").alias("source")), "source", "left_semi")


def imported_by(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    return edges.join(seeds.select(F.col("node").alias("target")), "target", "left_semi")


def expand(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """node: neighbours of the seeds in either direction that are no seeds."""
    near = imports_of(edges, seeds).select(F.col("target").alias("node")).union(imported_by(edges, seeds).select(F.col("source").alias("node")))
    return near.distinct().join(seeds, "node", "left_anti")


def two_hop(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """node: targets two edges away that are neither seeds nor their direct neighbours."""
    one = expand(edges, seeds)
    out = imports_of(edges, one).select(F.col("target").alias("node")).distinct()
    return out.join(seeds, "node", "left_anti").join(one, "node", "left_anti")


def k_hop(edges: DataFrame, seeds: DataFrame, k: int) -> DataFrame:
    """node, hop: undirected distance up to k, without the seeds."""
    both = edges.select("source", "target").union(edges.select("target", "source"))
    seen, frontier = seeds.select("node", F.lit(0).alias("hop")), seeds.select("node")
    for hop in range(1, k + 1):
        found = both.join(frontier.withColumnRenamed("node", "source"), "source", "left_semi").select(F.col("target").alias("node")).distinct()
        frontier = found.join(seen, "node", "left_anti")
        seen = seen.unionByName(frontier.withColumn("hop", F.lit(hop)))
    return seen.where("hop > 0")


def page_rank(edges: DataFrame, nodes: DataFrame | None = None, alpha: float = 0.85, rounds: int = 100, tolerance: float | None = 1e-6) -> DataFrame:
    """node, rank: power method; the mass of dangling nodes is spread evenly, ranks sum to one.

    A round is one join and one sum by target, written to the shared folder; ranks sum to one, so what was not handed on
    is the dangling mass.  Stops where the total change falls below tolerance * nodes, after ``rounds`` at the latest (from
    100 rounds on less than one part in ten million of the start is left); no tolerance: exactly ``rounds``.
    """
    nodes = materialise((nodes if nodes is not None else nodes_of(edges)).select("node").distinct(), "rank-nodes")
    n = nodes.count()
    if not n:
        return nodes.withColumn("rank", F.lit(0.0))
    links = materialise(edges.join(edges.groupBy("source").agg(F.count("*").alias("out")), "source").select("source", "target", "out"), "rank-links")
    zero = nodes.select("node", F.lit(0.0).alias("given"))
    now = nodes.select("node", F.lit(1.0 / n).alias("rank"))
    for _ in range(rounds):
        sent = links.join(now.withColumnRenamed("node", "source"), "source").select(F.col("target").alias("node"), (F.col("rank") / F.col("out")).alias("given"))
        given = materialise(sent.unionByName(zero).groupBy("node").agg(F.sum("given").alias("given")), "rank")
        mass = 1 - given.agg(F.sum("given")).first()[0]
        new = given.select("node", (alpha * (F.col("given") + mass / n) + (1 - alpha) / n).alias("rank"))
        if tolerance:
            change = new.join(now.withColumnRenamed("rank", "old"), "node").agg(F.sum(F.abs(F.col("rank") - F.col("old")))).first()[0]
            if change < tolerance * n:
                return new
        now = new
    return now


def undirected(edges: DataFrame) -> DataFrame:
    return edges.select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).where("a <> b").distinct()


def cohesion(edges: DataFrame, members: DataFrame) -> DataFrame:
    """module, n, inner, cohesion: undirected edges inside over possible ones, one for a single member; 4 digits."""
    pairs = undirected(edges)
    a, b = members.select(F.col("node").alias("a"), F.col("module").alias("ma")), members.select(F.col("node").alias("b"), F.col("module").alias("mb"))
    inner = pairs.join(a, "a").join(b, "b").where("ma = mb").groupBy(F.col("ma").alias("module")).agg(F.count("*").alias("inner"))
    sized = members.groupBy("module").agg(F.count("*").alias("n")).join(inner, "module", "left")
    inner, n = F.coalesce("inner", F.lit(0)), F.col("n")
    return sized.select("module", "n", inner.cast("long").alias("inner"), F.when(n < 2, 1.0).otherwise(F.round(inner / (n * (n - 1) / 2), 4)).alias("cohesion"))


def communities(edges: DataFrame, rounds: int = 8) -> DataFrame:
    """node, community by label propagation: each round takes the most frequent label among neighbours and oneself, the least of ties.

    Half of the nodes (by hash) move in a round, so that two sides do not swap labels for ever.
    """
    pairs = undirected(edges)
    both = materialise(pairs.select(F.col("a").alias("source"), F.col("b").alias("target")).union(pairs.select("b", "a")), "lp-links")
    state = nodes_of(edges).withColumn("label", F.col("node"))
    for turn in range(rounds):
        votes = both.join(state.select(F.col("node").alias("target"), "label"), "target").select(F.col("source").alias("node"), "label").unionByName(state)
        counted = votes.groupBy("node", "label").agg(F.count("*").alias("n"))
        best = counted.groupBy("node").agg(F.min_by("label", F.struct(-F.col("n"), "label")).alias("best"))
        moves = F.ascii(F.substring(F.md5(F.col("node").cast("string").cast("binary")), 32, 1)) % 2 == turn % 2
        state = materialise(state.join(best, "node").select("node", F.when(moves, F.col("best")).otherwise(F.col("label")).alias("label")), "lp")
    return state.withColumnRenamed("label", "community")


#: Least gain in modularity for which another round of moves is made, and the parts of the nodes that move at a time.
LEAST_GAIN, PARTS = 1e-4, (2, 4, 16)
#: Nodes up to which their communities are sent to every task; beyond, they meet the links by shuffle.
BROADCAST_NODES = 1_000_000


def louvain(edges: DataFrame, least_gain: float = LEAST_GAIN) -> DataFrame:
    """node, community (its least node) by local moves of largest modularity gain, level by level.

    A level moves nodes between communities while modularity rises by ``least_gain`` or more, then contracts each community
    to one node; the levels end where none moves.  In a round every node knows the weight of its links into each
    neighbouring community and the communities' degree totals; half of the nodes (by hash) move together, and where that
    lowers the modularity a smaller part of them, so it never falls.  Several links are one.
    """
    edges = materialise(edges.select("source", "target"), "louvain-edges")  # looked at several times
    pairs = materialise(undirected(edges), "louvain-pairs")
    links = pairs.select(F.col("a").alias("source"), F.col("b").alias("target"), F.lit(1.0).alias("w")).unionByName(pairs.select(F.col("b").alias("source"), F.col("a").alias("target"), F.lit(1.0).alias("w")))
    twice = 2.0 * pairs.count()
    members = materialise(nodes_of(edges).withColumn("top", F.col("node")), "louvain-members")
    if not twice:
        return members.withColumnRenamed("top", "community")
    nodes = members.select("node", F.lit(0.0).alias("inner"))  # inner: weight of links inside, both ways
    while True:
        held = _sent if nodes.count() <= BROADCAST_NODES else (lambda x: x)
        state, moved = _moved(links, nodes, twice, least_gain, held)
        if not moved:
            return members.withColumnRenamed("top", "community")
        members = materialise(members.join(held(state.select(F.col("node").alias("top"), "community")), "top").select("node", F.col("community").alias("top")), "louvain-members")
        ends = lambda side: held(state.select(F.col("node").alias(side), F.col("community").alias(f"c_{side}")))
        joined = materialise(links.join(ends("source"), "source").join(ends("target"), "target").groupBy(F.col("c_source").alias("source"), F.col("c_target").alias("target")).agg(F.sum("w").alias("w")), "louvain-joined")
        inner = nodes.join(state, "node").groupBy(F.col("community").alias("node")).agg(F.sum("inner").alias("old"))
        nodes = materialise(inner.join(joined.where("source = target").select(F.col("source").alias("node"), "w"), "node", "left").select("node", (F.col("old") + F.coalesce("w", F.lit(0.0))).alias("inner")), "louvain-nodes")
        links = joined.where("source <> target")


def _sent(nodes: DataFrame) -> DataFrame:
    return F.broadcast(nodes)


def _moved(links: DataFrame, nodes: DataFrame, twice: float, least_gain: float, held: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, bool]:
    """node, community after one level's moves, and whether any node moved.

    The links are dealt by source once, from a written table, and kept so for the level: a round adds up a node's links in
    its task and shuffles and writes rows of nodes only.
    """
    links = links.repartition(tasks(links.sparkSession), "source").persist()
    links.count()
    out = links.groupBy(F.col("source").alias("node")).agg(F.sum("w").alias("out"))

    def totalled(state: DataFrame) -> DataFrame:
        totals = state.groupBy("community").agg(F.sum("degree").alias("total"))
        return materialise(state.join(held(totals), "community").select("node", "community", "inner", "degree", "total"), "louvain-state")

    def weighed(state: DataFrame) -> tuple[DataFrame, float, list[set[int]]]:
        """The nodes with where each would gain most; the modularity; and which parts have nodes that would move, by number of parts."""
        to = held(state.select(F.col("node").alias("target"), "community", "total"))
        into = links.join(to, "target").groupBy("source", "community").agg(F.sum("w").alias("w"), F.max("total").alias("total"))
        into = into.join(held(state.select(F.col("node").alias("source"), F.col("community").alias("now"), "degree")), "source")
        own = F.col("community") == F.col("now")
        into = into.withColumn("gain", F.col("w") - F.col("degree") * (F.col("total") - F.when(own, F.col("degree")).otherwise(0.0)) / twice)
        best = into.groupBy(F.col("source").alias("node")).agg(
            F.sum(F.when(own, F.col("w"))).alias("inside"), F.max("gain").alias("top"), F.max(F.when(own, F.col("gain"))).alias("stay"), F.min_by("community", F.struct(-F.col("gain"), "community")).alias("best")
        )
        alone = -F.col("degree") * (F.col("total") - F.col("degree")) / twice
        rows = state.join(best, "node", "left").withColumn("moves", F.coalesce(F.col("top") > F.coalesce("stay", alone) + 1e-9, F.lit(False)))
        rows = materialise(rows.select("node", "community", "inner", "degree", "total", "inside", "best", "moves", F.xxhash64("node").alias("hash")), "louvain-votes")
        # a community's squared total is the sum of its nodes' degrees times the total
        parts = [F.collect_set(F.when(F.col("moves"), F.pmod("hash", F.lit(p)))) for p in PARTS]
        inside, squares, loops, *there = rows.agg(F.sum("inside"), F.sum(F.col("degree") * F.col("total")), F.sum("inner"), *parts).first()
        return rows, ((inside or 0.0) + loops) / twice - squares / twice**2, [set(x) for x in there]

    state = totalled(nodes.join(out, "node", "left").select("node", F.col("node").alias("community"), "inner", (F.col("inner") + F.coalesce("out", F.lit(0.0))).alias("degree")))
    rows, quality, there = weighed(state)
    turn, size, still, any_moved = 0, 0, 0, False
    while size < len(PARTS) and there[size]:
        parts = PARTS[size]
        turn = next((turn + i) % parts for i in range(parts) if (turn + i) % parts in there[size])
        goes = F.col("moves") & (F.pmod("hash", F.lit(parts)) == turn)
        new = totalled(rows.select("node", F.when(goes, F.col("best")).otherwise(F.col("community")).alias("community"), "inner", "degree"))
        new_rows, new_quality, new_there = weighed(new)
        turn += 1
        if new_quality > quality + least_gain:
            state, rows, quality, there, any_moved, still = new, new_rows, new_quality, new_there, True, 0
        else:
            still += 1
            if still >= len(there[size]):  # every part that would move had its turn: smaller parts, where moves together got in each other's way
                size, still = size + 1, 0
    links.unpersist()
    least = state.groupBy("community").agg(F.min("node").alias("least"))
    return materialise(state.join(held(least), "community").select("node", F.col("least").alias("community")), "louvain-level"), any_moved


def modularity(edges: DataFrame, members: DataFrame) -> DataFrame:
    """One row: modularity of the partition (node, community) of the undirected graph."""
    pairs = materialise(undirected(edges), "mod")
    a, b = members.select(F.col("node").alias("a"), F.col("community").alias("ca")), members.select(F.col("node").alias("b"), F.col("community").alias("cb"))
    m = pairs.count()
    known = pairs.join(a, "a").join(b, "b")
    degree = known.select(F.col("ca").alias("c")).union(known.select("cb")).groupBy("c").agg(F.count("*").alias("d"))
    inner = known.where("ca = cb").groupBy(F.col("ca").alias("c")).agg(F.count("*").alias("inside"))
    rows = degree.join(inner, "c", "left")
    return rows.agg(F.sum(F.coalesce("inside", F.lit(0)) / m - F.pow(F.col("d") / (2 * m), 2)).alias("modularity"))


def subgraph(edges: DataFrame, kept: DataFrame) -> DataFrame:
    """source, targets (sorted): edges with both ends among the kept nodes."""
    inside = edges.join(kept.select(F.col("node").alias("source")), "source", "left_semi").join(kept.select(F.col("node").alias("target")), "target", "left_semi")
    return inside.groupBy("source").agg(F.array_sort(F.collect_set("target")).alias("targets"))


def used_by(edges: DataFrame) -> DataFrame:
    return edges.groupBy("target").agg(F.array_sort(F.collect_set("source")).alias("users"))


def update(edges: DataFrame, changed: DataFrame, new: DataFrame) -> DataFrame:
    """Edges that touch changed nodes go, the new ones come."""
    kept = edges.join(changed.select(F.col("node").alias("source")), "source", "left_anti").join(changed.select(F.col("node").alias("target")), "target", "left_anti")
    return kept.unionByName(new).distinct()


def modules(files: DataFrame, edges: DataFrame) -> DataFrame:
    """Per module of files (node, module, lines): files, lines, inner targets and outside targets, sorted."""
    known = files.select(F.col("node").alias("source"), "module")
    out = edges.join(known, "source").join(files.select(F.col("node").alias("target"), F.col("module").alias("other")), "target", "left")
    deps = out.groupBy("module").agg(
        F.array_sort(F.collect_set(F.when(F.col("module") == F.col("other"), F.col("target")))).alias("internal_deps"),
        F.array_sort(F.collect_set(F.when(F.col("module") != F.col("other"), F.col("target")))).alias("external_deps"),
    )
    empty = F.array().cast(dict(edges.dtypes)["target"].join(("array<", ">")))
    sizes = files.groupBy("module").agg(F.count("*").alias("file_count"), F.sum("lines").cast("long").alias("line_count"))
    return sizes.join(deps, "module", "left").withColumns({c: F.coalesce(c, empty) for c in ("internal_deps", "external_deps")})


def common_folder(rows: DataFrame, key: str, path: str = "path") -> DataFrame:
    """key, name: last part of what all paths of a group share letter by letter (by the least and the greatest path)."""
    ends = rows.groupBy(key).agg(F.min(path).alias("lo"), F.max(path).alias("hi"))
    shared = F.expr("substring(lo, 1, size(filter(sequence(1, greatest(1, least(length(lo), length(hi)))), i -> substring(lo, 1, i) = substring(hi, 1, i))))")
    return ends.select(key, F.element_at(F.split(F.regexp_replace(shared, "/+$", ""), "/"), -1).alias("name"))


def build(imports: DataFrame) -> DataFrame:
    """source, target, location from rows with a ``place``: one edge a pair, the last place's location; no loops."""
    return imports.where("source <> target").groupBy("source", "target").agg(F.max_by("location", "place").alias("location"))
