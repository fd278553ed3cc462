"""Source files as a table, and the small inputs of a run."""

from __future__ import annotations

import json
import os
import re
import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators.lookups import IGNORES, ignored, language_of

MAX_FILE_SIZE = 10_000_000
SCHEMA = "path string, language string, size_bytes long, content string"


def check_url(url: str) -> str:
    """An http(s) address as it is; any other scheme is refused."""
    if re.match(r"https?://[^\s]+$", url):
        return url
    raise ValueError(f"only http(s) addresses can be cloned: {url!r}")


def check_branch(branch: str) -> str:
    if branch.startswith("-") or not re.match(r"[\w./-]+$", branch) or ".." in branch:
        raise ValueError(f"bad branch name {branch!r}")
    return branch


def clone(url: str, target: str, branch: str | None = None, timeout: int = 120) -> str:
    """A shallow clone of an http(s) repository in the target folder."""
    extra = ["--branch", check_branch(branch)] if branch else []
    subprocess.run(["git", "clone", "--depth", "1", *extra, "--", check_url(url), target], check=True, capture_output=True, timeout=timeout)
    return target


def tracked(root: str) -> list[str] | None:
    """Paths that git lists (tracked or new, not ignored), None without a repository."""
    if not os.path.isdir(os.path.join(root, ".git")):
        return None
    out = subprocess.run(["git", "-C", root, "ls-files", "--cached", "--others", "--exclude-standard", "-z"], check=True, capture_output=True, text=True)
    return [p for p in out.stdout.split("\0") if p]


def discover(spark: SparkSession, root: str, languages: list[str] | None = None, ignores: list[str] | None = None, max_size: int = MAX_FILE_SIZE) -> DataFrame:
    """path (relative), language, size_bytes, content of the source files below a folder.

    Files are listed and read by Spark's binaryFile source, so the folder can be in any store; sizes are filtered in the
    scan.  Empty files hold nothing to read and are left out.  Where the folder is a local git repository, only what git lists stays.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).where(F.col("length") <= max_size)
    base = re.sub(r"^\w+:/*", "/", root).rstrip("/") + "/"
    path = F.regexp_replace(F.regexp_replace("path", r"^\w+:(//[^/]*)?/*", "/"), "^" + re.escape(base), "")
    rows = raw.select(path.alias("path"), F.col("length").alias("size_bytes"), "content").withColumn("language", language_of(F.col("path")))
    rows = rows.where(F.col("language").isNotNull() & ~ignored(F.col("path"), ignores or IGNORES))
    if languages:
        rows = rows.where(F.col("language").isin(languages))
    listed = tracked(root) if os.path.isdir(root) else None
    if listed is not None:
        rows = rows.join(spark.createDataFrame([(p,) for p in listed], "path string"), "path", "left_semi")
    return rows.select("path", "language", "size_bytes", F.decode("content", "utf-8").alias("content"))


def load_tasks(spark: SparkSession, path: str) -> DataFrame:
    """Benchmark tasks from JSON lines (task_id, question, expected_files, token_budget, category)."""
    return spark.read.schema("task_id string, question string, expected_files array<string>, token_budget int, category string").json(path)


def load_delta_tasks(spark: SparkSession, path: str) -> DataFrame:
    """Delta benchmark tasks from JSON lines (task_id, source, base_commit, delta_commit)."""
    return spark.read.schema("task_id string, source string, base_commit string, delta_commit string").json(path)


def check_tasks(tasks: DataFrame, files: DataFrame) -> DataFrame:
    """task_id, problem: blank questions, no expectations, expected files that do not exist."""
    blank = tasks.where(F.trim(F.coalesce("question", F.lit(""))) == "").select("task_id", F.lit("blank question").alias("problem"))
    none = tasks.where(F.coalesce(F.size("expected_files"), F.lit(0)) <= 0).select("task_id", F.lit("no expected files").alias("problem"))
    wanted = tasks.select("task_id", F.explode("expected_files").alias("path"))
    missing = wanted.join(files.select("path"), "path", "left_anti").select("task_id", F.concat(F.lit("missing file "), "path").alias("problem"))
    return blank.unionByName(none).unionByName(missing)


def load_config(path: str | None = None, prefix: str = "CORVANE_") -> dict:
    """Settings from a JSON file, overridden by environment variables of the prefix (numbers and true/false are parsed)."""
    out = json.load(open(path)) if path else {}
    for key, value in os.environ.items():
        if key.startswith(prefix):
            try:
                out[key[len(prefix) :].lower()] = json.loads(value)
            except ValueError:
                out[key[len(prefix) :].lower()] = value
    return out
