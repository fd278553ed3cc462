"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java regular expression of one white-space run: space, tab, line feed, VT, FF, CR.
WHITE = r"[ \t-\r]+"


#: Folders made for applications that set none.
_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir; a temporary one where that is unset and Spark runs on one machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = _OWN.get(spark.sparkContext.applicationId) or tempfile.mkdtemp(prefix="spark-")
        _OWN[spark.sparkContext.applicationId] = folder
    return folder.rstrip("/")


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write df once to the shared folder and read it back.

    Cuts lineage: a lost executor costs no recomputation of what went before,
    and sizes are known to the planner of the next step.
    """
    path = f"{shared_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def plain_names(df: DataFrame) -> DataFrame:
    """The same rows with columns named c0, c1 and so on, for functions that look columns up by name; ``toDF`` names them back."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def named(name: str) -> Column:
    """The column of exactly this name, dots and backticks included."""
    return F.col(f"`{name.replace('`', '``')}`")


def free_name(df: DataFrame, name: str) -> str:
    """The name, with underscores added until df has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def words_of(text: Column) -> Column:
    """Words of a text: maximal runs of anything but space, tab, LF, VT, FF, CR; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WHITE), "")


def word_count(text: Column) -> Column:
    """Number of words, as long."""
    return F.size(words_of(text)).cast("long")


def id_bucket(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(n))


def batches(frames: Iterator[pa.RecordBatch], limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slice batches so that one slice holds about ``limit`` bytes at most (one row at least)."""
    for batch in frames:
        step = max(1, int(batch.num_rows * limit / max(1, batch.nbytes)))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


#: Bits of the filter that ``sieve`` sends to every task, at least and at most (16 MB).
SIEVE_BITS = 1 << 16, 1 << 27


def sieve(keys: DataFrame, column: str) -> Callable[[str], Column]:
    """A Bloom filter over hashed keys: the function makes, of the name of a column, the condition that it may be among them.

    Rows that pass still have to be joined; rows that don't need no shuffle.  The filter has a bound, and past about ten
    million keys more and more rows pass that need not; what comes out stays the same.
    """
    least, most = SIEVE_BITS
    bits = least
    wanted = 16 * keys.count()
    while bits < min(wanted, most):
        bits *= 2
    place = lambda x: [F.col(x).bitwiseAND(F.lit(bits - 1)), F.shiftrightunsigned(x, 32).bitwiseAND(F.lit(bits - 1))]
    at = F.explode(F.array(*place(column)))
    words = keys.select(at.alias("at")).select(F.shiftright("at", 6).alias("word"), F.expr("shiftleft(1L, cast(at & 63 as int))").alias("bit"))
    found = words.groupBy("word").agg(F.bit_or("bit").alias("bit")).toArrow()  # at most bits / 64 rows
    held = np.zeros(bits // 64, np.int64)
    held[found["word"].to_numpy()] = found["bit"].to_numpy()
    table = keys.sparkSession.sparkContext.broadcast(held)

    @F.pandas_udf("boolean")
    def among(x: pd.Series) -> pd.Series:
        values = x.to_numpy(np.int64).view(np.uint64)
        passed = np.ones(len(values), bool)
        for at in (values & np.uint64(bits - 1), (values >> np.uint64(32)) & np.uint64(bits - 1)):
            at = at.astype(np.int64)
            passed &= (table.value[at >> 6] >> (at & 63)) & 1 == 1
        return pd.Series(passed)

    return lambda name: among(F.col(name))
