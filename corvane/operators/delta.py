"""Change detection and incremental maintenance over snapshots."""

from __future__ import annotations

import time
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.sources.store import materialise

THRESHOLD = 0.5


def snapshot_delta(old: DataFrame, new: DataFrame, key: str, version: str) -> DataFrame:
    """key, status: A, D, or M where the version differs."""
    both = old.select(key, F.col(version).alias("__was"), F.lit(1).alias("__o")).join(new.select(key, F.col(version).alias("__is"), F.lit(1).alias("__n")), key, "full")
    status = F.when(F.col("__o").isNull(), "A").when(F.col("__n").isNull(), "D").when(~F.col("__was").eqNullSafe(F.col("__is")), "M")
    return both.select(key, status.alias("status")).where("status IS NOT NULL")


def mtime_delta(indexed: DataFrame, current: DataFrame, last: str, key: str, mtime: str) -> DataFrame:
    """key, status: A, D, or M where the file is newer than the time of indexing (an equal time is no change)."""
    both = indexed.select(key, F.lit(1).alias("__o")).join(current.select(key, mtime, F.lit(1).alias("__n")), key, "full")
    status = F.when(F.col("__o").isNull(), "A").when(F.col("__n").isNull(), "D").when(F.col(mtime) > F.lit(last).cast("timestamp"), "M")
    return both.select(key, status.alias("status")).where("status IS NOT NULL")


#: Share of the larger file's lines that two files have in common at least to be one file under two names.
SIMILAR = 0.5


def _lines(files: DataFrame) -> DataFrame:
    """path, token (a line and which of its repeats), size of every line of files."""
    hashed = F.transform(F.split(F.coalesce("content", F.lit("")), "\n"), lambda x: F.xxhash64(x))
    rows = files.select("path", F.explode(hashed).alias("line")).groupBy("path", "line").agg(F.count("*").alias("n"))
    sizes = rows.groupBy("path").agg(F.sum("n").alias("size"))
    return rows.select("path", F.explode(F.transform(F.sequence(F.lit(1), "n"), lambda i: F.xxhash64("line", i))).alias("token")).join(sizes, "path")


def _kinds(gone: DataFrame, come: DataFrame) -> DataFrame:
    """side (0 gone, 1 come), path, size, kind, weight: the lines of every file, those that stand in just the same files as one row.

    A kind is how many files hold its lines and two hashes of which these are, so what all files share is a row a file, however many lines.
    """
    lines = materialise(_lines(gone).withColumn("side", F.lit(0)).unionByName(_lines(come).withColumn("side", F.lit(1))), "lines")
    held = lambda seed: F.bit_xor(F.xxhash64(F.lit(seed), "side", "path"))
    kinds = lines.groupBy("token").agg(F.struct(F.count("*").alias("often"), held(1).alias("h1"), held(2).alias("h2")).alias("kind"))
    return materialise(lines.join(kinds, "token").groupBy("side", "path", "kind").agg(F.count("*").alias("weight"), F.max("size").alias("size")), "kinds")


def _alike(a: DataFrame, b: DataFrame, least: float) -> DataFrame:
    """old_path, path, share of the pairs of files (of either side's kinds) that share enough.

    Pairs meet by their rarest lines: files that share a share ``least`` of the larger one's lines have one in common among
    the rarest of each (all but that share, and one more), so common lines bring nothing together and no pair is lost.
    """
    before = F.coalesce(F.sum("weight").over(Window.partitionBy("path").orderBy("kind").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rare = lambda x: x.withColumn("before", before).where(F.col("before") < F.col("size") - F.ceil(F.col("size") * least - 1e-9) + 1).select("path", "kind")
    pairs = rare(a).withColumnRenamed("path", "old_path").join(rare(b), "kind").select("old_path", "path").distinct()
    both = pairs.join(a.select(F.col("path").alias("old_path"), "kind", "weight", F.col("size").alias("n")), "old_path").join(b.select("path", "kind", "size"), ["path", "kind"])
    shares = both.groupBy("old_path", "path").agg((F.sum("weight") / F.greatest(F.max("n"), F.max("size"))).alias("share"))
    return shares.where(F.col("share") >= least)


def _sides(kinds: DataFrame) -> tuple[DataFrame, DataFrame]:
    return kinds.where("side = 0").drop("side"), kinds.where("side = 1").drop("side")


def similar_files(gone: DataFrame, come: DataFrame, least: float = SIMILAR) -> DataFrame:
    """old_path, path, share of all pairs of gone and come files (path, content) that share enough lines."""
    return _alike(*_sides(_kinds(gone, come)), least)


#: Shares from which pairs are looked for first; what finds its file there is not compared at the lower ones.
STEPS = (0.9, 0.75)


def _same(a: DataFrame, b: DataFrame) -> DataFrame:
    """old_path, path of files with the same lines, the first with the first and so on: no pairs are made of many copies."""

    def numbered(x: DataFrame) -> DataFrame:
        whole = x.groupBy("path").agg(F.sha2(F.to_json(F.array_sort(F.collect_list("kind"))), 256).alias("lines"))
        return whole.withColumn("n", F.row_number().over(Window.partitionBy("lines").orderBy("path")))

    return numbered(a).withColumnRenamed("path", "old_path").join(numbered(b), ["lines", "n"]).select("old_path", "path")


def with_renames(changes: DataFrame, old: DataFrame, new: DataFrame, least: float = SIMILAR) -> DataFrame:
    """path, status, old_path: changes in which a deleted and an added file that are alike are one renamed file (R).

    One to one, the best share first (ties: by old path, then new path): in each round pairs that are the best of both
    their files are taken.  Pairs of high shares are looked for first and among few lines; as these would be taken
    before all others anyway, the files that are left then find the same partners as if all pairs were known.
    """
    named = lambda status, files: files.select("path", "content").join(changes.where(F.col("status") == status).select("path"), "path", "left_semi")
    a, b = _sides(_kinds(named("D", old), named("A", new)))
    taken = materialise(_same(a, b), "renamed")
    a, b = a.join(taken.select(F.col("old_path").alias("path")), "path", "left_anti"), b.join(taken.select("path"), "path", "left_anti")
    for share in [*[x for x in STEPS if x > least], least]:
        if a.isEmpty() or b.isEmpty():
            break
        left, found = materialise(_alike(a, b, share), "alike"), None
        while not left.isEmpty():
            rank = F.struct(-F.col("share"), F.col("old_path"), F.col("path"))
            best = left.withColumn("rank", rank).withColumn("a", F.min("rank").over(Window.partitionBy("old_path"))).withColumn("b", F.min("rank").over(Window.partitionBy("path")))
            now = materialise(best.where((F.col("rank") == F.col("a")) & (F.col("rank") == F.col("b"))).select("old_path", "path"), "renamed")
            found = now if found is None else found.unionByName(now)
            left = materialise(left.join(now.select("old_path"), "old_path", "left_anti").join(now.select("path"), "path", "left_anti"), "alike")
        if found is not None:
            taken = taken.unionByName(found)
            a, b = a.join(found.select(F.col("old_path").alias("path")), "path", "left_anti"), b.join(found.select("path"), "path", "left_anti")
    gone = taken.select(F.col("old_path").alias("path")).unionByName(taken.select("path"))
    rest = changes.join(gone, "path", "left_anti").select("path", "status", F.lit(None).cast("string").alias("old_path"))
    return rest.unionByName(taken.select("path", F.lit("R").alias("status"), "old_path"))


def parse_name_status(lines: DataFrame, column: str = "value") -> DataFrame:
    """path, status, old_path from tab-separated name-status lines; other letters than M, A, D, R are left out."""
    parts = F.split(column, "\t")
    letter = F.substring(F.get(parts, F.lit(0)), 1, 1)
    out = lines.select(F.when(letter == "R", F.get(parts, F.lit(2))).otherwise(F.get(parts, F.lit(1))).alias("path"), letter.alias("status"), F.when(letter == "R", F.get(parts, F.lit(1))).alias("old_path"))
    return out.where(F.col("status").isin("M", "A", "D", "R"))


def apply_delta(rows: DataFrame, changes: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """rows without changed and deleted keys, and the fresh rows of the changed and added ones."""
    kept = rows.join(changes.select(key), key, "left_anti")
    return kept.unionByName(fresh.join(changes.where("status IN ('A', 'M', 'R')").select(key), key, "left_semi").select(rows.columns))


def use_delta(changes: int, total: int, threshold: float = THRESHOLD) -> bool:
    """Whether few enough keys changed for a delta rather than a rebuild."""
    return total > 0 and changes / total < threshold


def acquisition(stored: Column, wanted: Column, local: Column, changed: Column, total: Column, threshold: float = THRESHOLD) -> Column:
    """How an index comes about: the stored one if it is of the wanted version, a delta where the source is at hand and few files changed, else in full."""
    few = local & (total > 0) & (changed / total < threshold)
    return F.when(stored.eqNullSafe(wanted) & stored.isNotNull(), "hit").when(stored.isNotNull() & few, "delta").otherwise("full")


def timed_run(old: DataFrame, new: DataFrame, key: str, version: str) -> dict:
    """A delta against a rebuild of the same table: seconds of each, speedup, and whether both hold the same rows."""
    start = time.perf_counter()
    full = materialise(new, "rebuilt")
    middle = time.perf_counter()
    after = materialise(apply_delta(old, snapshot_delta(old, new, key, version), new, key), "after-delta")
    end = time.perf_counter()
    same = not difference(after, full).take(1)
    return {"full_ms": 1000 * (middle - start), "delta_ms": 1000 * (end - middle), "speedup": (middle - start) / max(end - middle, 1e-9), "correct": same}


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of either side that the other lacks, with ``side``; empty if both hold the same rows."""
    return a.exceptAll(b).withColumn("side", F.lit("a")).unionByName(b.select(a.columns).exceptAll(a).withColumn("side", F.lit("b")))


def symmetric_difference(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """keys, side: added (only in a) or removed (only in b)."""
    both = a.withColumn("__a", F.lit(1)).join(b.withColumn("__b", F.lit(1)), keys, "full")
    return both.where("__a IS NULL OR __b IS NULL").select(*keys, F.when(F.col("__b").isNull(), "added").otherwise("removed").alias("side"))


def summary(changes: DataFrame, total: int) -> DataFrame:
    """One row: counts by status, and what stayed."""
    n = lambda s: F.count(F.when(F.col("status") == s, 1))
    counts = changes.agg(*[n(s).alias(name) for s, name in (("A", "added"), ("M", "modified"), ("D", "deleted"), ("R", "renamed"))])
    changed = reduce(lambda x, y: x + y, [F.col(c) for c in ("added", "modified", "deleted", "renamed")])
    return counts.withColumn("unchanged", F.greatest(F.lit(0), F.lit(total) - changed + F.col("deleted")))


def lacks_ids(chunks: DataFrame) -> DataFrame:
    """One row, reindex: whether any chunk has no symbol_id."""
    return chunks.agg((F.count(F.when(F.col("symbol_id").isNull(), 1)) > 0).alias("reindex"))


def views(changes: DataFrame) -> DataFrame:
    """view, path: every change under its own view, and under ``affected`` (renames with both paths)."""
    own = F.when(F.col("status") == "M", "modified").when(F.col("status") == "A", "added").when(F.col("status") == "D", "deleted").otherwise("renamed")
    entry = lambda view, path: F.when(path.isNotNull(), F.struct(view.alias("view"), path.alias("path")))
    every = F.array_compact(F.array(entry(own, F.col("path")), entry(F.lit("affected"), F.col("path")), entry(F.lit("affected"), F.col("old_path"))))
    return changes.select(F.explode(every).alias("x")).select("x.*")
