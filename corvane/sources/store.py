"""Versioned tables in a folder: written snapshots, a pointer to the current one, small metadata.

A new version is written whole beside the old one and the pointer is replaced
last, so readers see either.  All files go through Spark, so a folder can be in
any store Spark reads.
"""

from __future__ import annotations

import json
import re
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Folders made for applications that set none.
_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a temporary folder where it is unset and Spark runs on one machine (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = _OWN.get(spark.sparkContext.applicationId) or tempfile.mkdtemp(prefix="spark-")
        _OWN[spark.sparkContext.applicationId] = folder
    return folder.rstrip("/")


def tasks(spark: SparkSession) -> int:
    """Tasks for rows that are small to shuffle and long to work on: what the session shuffles into, at least two a core.

    Given as a number, so that partitions are not put together by their size.
    """
    return max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write once to the shared folder and read back: cuts lineage and survives lost executors."""
    path = f"{shared_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Store:
    """Named tables under ``root``; ``put`` makes a new version, ``get`` reads the current one."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def put(self, name: str, df: DataFrame, partition_by: list[str] | None = None) -> str:
        version = uuid.uuid4().hex
        writer = df.write.partitionBy(*partition_by) if partition_by else df.write
        writer.parquet(f"{self.root}/{name}/{version}")
        self.set_meta(f"current:{name}", version)
        return version

    def get(self, name: str) -> DataFrame:
        version = self.meta().get(f"current:{name}")
        if version is None:
            raise KeyError(name)
        return self.spark.read.parquet(f"{self.root}/{name}/{version}")

    def set_meta(self, key: str, value: str) -> None:
        """Append (key, value, when); the latest row of a key holds."""
        row = self.spark.range(1).select(F.lit(key).alias("key"), F.lit(value).alias("value"), F.current_timestamp().alias("at"), F.lit(uuid.uuid4().hex).alias("tie"))
        row.coalesce(1).write.mode("append").parquet(f"{self.root}/_meta")

    def meta(self) -> dict[str, str]:
        """All metadata, one row per key."""
        try:
            rows = self.spark.read.schema("key string, value string, at timestamp, tie string").parquet(f"{self.root}/_meta")
        except Exception as e:  # nothing was ever put here
            if "PATH_NOT_FOUND" in str(e):
                return {}
            raise
        latest = rows.groupBy("key").agg(F.max_by("value", F.struct("at", "tie")).alias("value"))
        return {r["key"]: r["value"] for r in latest.collect()}


def save_vectors(store: Store, vectors: DataFrame, embedder: str, mode: str, version: str) -> None:
    """Vectors (id, embedding) with what made them; none at all are refused."""
    first = vectors.select(F.size("embedding").alias("n"), "id").first()
    if first is None:
        raise ValueError("no vectors to save")
    store.put("vectors", vectors.select("id", "embedding"))
    store.set_meta("vectors", json.dumps({"embedder": embedder, "mode": mode, "version": version, "dim": first["n"]}))


def load_vectors(store: Store, **wanted) -> DataFrame:
    """The stored vectors, if they were made as wanted (embedder, mode, version, dim; what is not named is not asked, and vectors
    without such a record are taken)."""
    made = json.loads(store.meta().get("vectors", "{}"))
    for key, value in wanted.items():
        if made and made.get(key) != value:
            raise ValueError(f"stored vectors have {key} {made.get(key)!r}, not {value!r}")
    rows = store.get("vectors")
    if rows.where("id IS NULL OR embedding IS NULL").take(1):
        raise ValueError("stored vectors lack ids or values")
    return rows


class Cache:
    """Stored indexes by content: an entry is named by what was indexed and its commit."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.store = spark, Store(spark, root)

    def put(self, identity: str, commit: str, tables: dict[str, DataFrame]) -> str:
        key = cache_key(identity, commit, self.spark)
        rows = 0
        for name, df in tables.items():
            self.store.put(f"{key}/{name}", df)
            rows += self.store.get(f"{key}/{name}").count()
        self.store.set_meta(f"entry:{key}", json.dumps({"identity": identity, "commit": commit, "rows": rows, "at": time.time()}))
        return key

    def get(self, key: str, table: str) -> DataFrame:
        if not re.fullmatch("[0-9a-f]{64}", key):
            raise ValueError("a key has 64 hexadecimal digits")
        if key not in self.entries():
            raise KeyError(key)
        return self.store.get(f"{key}/{table}")

    def entries(self) -> dict[str, dict]:
        """Key to identity, commit, rows and time, of all entries that hold."""
        found = {k.removeprefix("entry:"): json.loads(v) for k, v in self.store.meta().items() if k.startswith("entry:")}
        return {k: v for k, v in found.items() if v}

    def find(self, identity: str) -> list[str]:
        """Keys of a source, the latest first."""
        return [k for k, v in sorted(self.entries().items(), key=lambda x: -x[1]["at"]) if v["identity"] == identity]

    def stale(self, key: str, hours: float) -> bool:
        return time.time() - self.entries()[key]["at"] > 3600 * hours

    def invalidate(self, key: str) -> None:
        self.store.set_meta(f"entry:{key}", "null")

    def clean(self, hours: float) -> int:
        """Invalidates what is older; how many."""
        old = [k for k, v in self.entries().items() if time.time() - v["at"] > 3600 * hours]
        for key in old:
            self.invalidate(key)
        return len(old)

    def info(self) -> dict:
        return {"entries": len(self.entries()), "rows": sum(v["rows"] for v in self.entries().values())}


def cache_key(identity: str, commit: str, spark: SparkSession) -> str:
    """64 hexadecimal digits that name a source at a commit."""
    return spark.range(1).select(F.sha2(F.concat_ws("@", F.lit(identity), F.lit(commit)), 256)).first()[0]
