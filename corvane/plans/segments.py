"""An index of a tree in segments: deltas write what changed, reads put the segments together.

A segment holds the rows of some files in all tables, their postings, and the paths
whose rows in earlier segments hold no longer (``gone`` for what comes of a file's
text, ``gone_edges`` for what its imports mean, which other files decide too).  A row
is live unless a later segment says its file is gone.  Segments are named by one
manifest (``catalog``), so all tables change together.

A delta parses the changed files only, and resolves again the imports of unchanged
files that ask for a key which an added or deleted file has.  Small segments merge
(a segment joins the one before while that is no more than twice its size), so a row
is written again a logarithmic number of times.

Corpus statistics for ranking are counts and lengths in the manifest, kept by adding
what came and subtracting what went; frequencies of words are counted among the live postings.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import text
from corvane.operators import delta, retrieval
from corvane.plans.index import Index, chunks_of, edges_of
from corvane.sources import parsing
from corvane.sources.catalog import Catalog
from corvane.sources.store import materialise

#: Tables by what makes their rows go, with the column that names their file.
BY_TEXT = {"files": "path", "symbols": "file_path", "chunks": "file_path", "lengths": "file_path"}
BY_IMPORTS = {"imports": "file_path", "edges": "source"}
#: Paths that are gone, up to which they are sent to every task; beyond, they meet the rows by shuffle.
BROADCAST_GONE = 200_000
#: A segment merges with the one before while that has at most so many times its chunks.
TIER = 2


class Segments:
    """The index stored under ``root``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.catalog = spark, root.rstrip("/"), Catalog(spark, root)

    def _at(self, segment: dict, table: str) -> str:
        return f"{self.root}/segments/{segment['id']}/{table}"

    # reading

    def table(self, name: str, manifest: dict | None = None, first: int = 0) -> DataFrame:
        """The live rows of a table; ``first``: of the segments from that one on."""
        manifest = manifest or self.catalog.head()
        segments = manifest["segments"]
        rows = [self.spark.read.parquet(self._at(s, name)).withColumn("__seg", F.lit(i)) for i, s in enumerate(segments) if i >= first]
        rows = reduce(lambda a, b: a.unionByName(b), rows)
        path = F.regexp_extract("id", r"^(.*):[^:]*:[0-9]+$", 1) if name == "postings" else F.col(BY_TEXT.get(name) or BY_IMPORTS[name])
        return self._live(rows, path, "gone_edges" if name in BY_IMPORTS else "gone", segments, first).drop("__seg")

    def _live(self, rows: DataFrame, path, gone: str, segments: list[dict], first: int) -> DataFrame:
        later = [(i, s) for i, s in enumerate(segments) if i > first and s[gone]]
        if not later:
            return rows
        dead = reduce(DataFrame.unionByName, [self.spark.read.parquet(self._at(s, gone)).select(F.col("path").alias("__path"), F.lit(i).alias("__until")) for i, s in later])
        dead = dead.groupBy("__path").agg(F.max("__until").alias("__until"))
        if sum(s[gone] for _, s in later) <= BROADCAST_GONE:
            dead = F.broadcast(dead)
        return rows.join(dead, (path == F.col("__path")) & (F.col("__seg") < F.col("__until")), "left_anti")

    def index(self, manifest: dict | None = None) -> Index:
        manifest = manifest or self.catalog.head()
        if manifest is None:
            raise KeyError(self.root)
        return Index(*[self.table(n, manifest) for n in ("files", "symbols", "imports", "edges", "chunks")])

    def text_index(self, manifest: dict | None = None) -> retrieval.TextIndex:
        manifest = manifest or self.catalog.head()
        n = manifest["chunks"]
        return retrieval.TextIndex(self.table("postings", manifest), n, manifest["tokens"] / n if n else 1.0, tuple(retrieval.FIELDS.values()))

    # writing

    def _write(self, files: DataFrame, symbols: DataFrame, chunks: DataFrame, imports: DataFrame, gone: DataFrame, gone_edges: DataFrame) -> dict:
        segment = {"id": uuid.uuid4().hex}
        for name, df in (("files", files), ("symbols", symbols), ("chunks", chunks), ("imports", imports), ("gone", gone), ("gone_edges", gone_edges)):
            df.write.parquet(self._at(segment, name))
        back = lambda name: self.spark.read.parquet(self._at(segment, name))
        edges_of(back("imports")).write.parquet(self._at(segment, "edges"))
        own = back("chunks")
        rows = materialise(retrieval.posting_rows(own.withColumn("content", text.expanded(F.col("content"))), retrieval.FIELDS, analyse=text.analysed), "segment-postings")
        retrieval.write_postings(rows, self._at(segment, "postings"))
        rows.where("first").select("id", "length").join(own.select("id", "file_path"), "id").write.parquet(self._at(segment, "lengths"))
        sizes = back("lengths").agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
        return segment | {"chunks": sizes[0], "tokens": sizes[1], "gone": back("gone").count(), "gone_edges": back("gone_edges").count()}

    def rebuild(self, files: DataFrame) -> int:
        """A manifest of one segment that holds all of files."""
        head = self.catalog.head()
        files = _hashed(files)
        symbols, raw = (materialise(x, "parsed") for x in parsing.parse(files))
        none = files.limit(0).select("path")
        segment = self._write(files, symbols, chunks_of(files, symbols, raw), parsing.resolve(raw, files), none, none)
        return self.catalog.commit({"segments": [segment], "chunks": segment["chunks"], "tokens": segment["tokens"]}, head["number"] if head else None)

    def changes(self, files: DataFrame) -> DataFrame:
        """path, status (A, M, D) of files against what is stored, by their hashes."""
        return delta.snapshot_delta(self.table("files").select("path", "hash"), _hashed(files), "path", "hash")

    def apply(self, files: DataFrame, changes: DataFrame) -> int:
        """A new segment for the changes; what is written grows with them and with the imports they touch, not with the tree."""
        head = self.catalog.head()
        files, changes = _hashed(files), materialise(changes, "changes")
        new = changes.where("status IN ('A', 'M')").select("path")
        gone = changes.where("status IN ('M', 'D')").select("path")
        fresh = materialise(files.join(new, "path", "left_semi").select(files.columns), "fresh")
        symbols, raw = (materialise(x, "parsed") for x in parsing.parse(fresh))
        # unchanged files whose imports ask for a key that came or went
        old = self.table("files", head).join(changes.where("status = 'D'").select("path"), "path", "left_semi")
        come = files.join(changes.where("status = 'A'").select("path"), "path", "left_semi")
        keys = parsing.keys_of(old.select("path", "language").unionByName(come.select("path", "language"))).select("key").distinct()
        known = self.table("imports", head).join(changes.select(F.col("path").alias("file_path")), "file_path", "left_anti")
        touched = materialise(parsing.asking(known, files, keys), "touched")
        again = known.join(touched.select("file_path"), "file_path", "left_semi").drop("resolved_path")
        imports = parsing.resolve(raw.unionByName(again.select(raw.columns)), files)
        gone_edges = gone.unionByName(touched.select(F.col("file_path").alias("path"))).distinct()
        segment = self._write(fresh, symbols, chunks_of(fresh, symbols, raw), imports, gone, gone_edges)
        lost = self.table("lengths", head).join(gone.select(F.col("path").alias("file_path")), "file_path", "left_semi").agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
        made = {"segments": [*head["segments"], segment], "chunks": head["chunks"] - lost[0] + segment["chunks"], "tokens": head["tokens"] - lost[1] + segment["tokens"]}
        return self._merged(self.catalog.commit(made, head["number"]))

    def _merged(self, number: int) -> int:
        """Merges the last segments while the one before is small; the number of the manifest that then holds."""
        manifest = self.catalog.get(number)
        segments = manifest["segments"]
        first, size = len(segments) - 1, segments[-1]["chunks"]
        while first > 0 and segments[first - 1]["chunks"] <= TIER * max(1, size):
            first -= 1
            size += segments[first]["chunks"]
        if first == len(segments) - 1:
            return number
        segment = {"id": uuid.uuid4().hex}
        for name in (*BY_TEXT, *BY_IMPORTS):
            self.table(name, manifest, first).write.parquet(self._at(segment, name))
        self.table("postings", manifest, first).repartition("bucket", F.pmod(F.xxhash64("id"), F.lit(retrieval.SPREAD))).sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(self._at(segment, "postings"))
        for gone in ("gone", "gone_edges"):
            paths = reduce(DataFrame.unionByName, [self.spark.read.parquet(self._at(s, gone)) for s in segments[first:]]).distinct()
            (paths if first else paths.limit(0)).write.parquet(self._at(segment, gone))
            segment[gone] = self.spark.read.parquet(self._at(segment, gone)).count()
        sizes = self.spark.read.parquet(self._at(segment, "lengths")).agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
        segment |= {"chunks": sizes[0], "tokens": sizes[1]}
        return self.catalog.commit(manifest | {"segments": [*segments[:first], segment]}, number)

    def acquire(self, files: DataFrame, threshold: float = delta.THRESHOLD) -> str:
        """Brings the stored index up to files: ``hit`` if nothing changed, ``delta`` if little did, else ``full``."""
        files = materialise(_hashed(files), "snapshot")
        if self.catalog.head() is None:
            self.rebuild(files)
            return "full"
        changes = materialise(self.changes(files), "changes")
        n = changes.count()
        if not n:
            return "hit"
        if delta.use_delta(n, files.count(), threshold):
            self.apply(files, changes)
            return "delta"
        self.rebuild(files)
        return "full"


def _hashed(files: DataFrame) -> DataFrame:
    return files if "hash" in files.columns else files.withColumn("hash", F.sha2(F.coalesce("content", F.lit("")), 256))
