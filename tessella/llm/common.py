"""What the operators of this subpackage share: table access, lineage cuts, joins, words and shingles."""

from __future__ import annotations

import gc
import tempfile
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of the contracts: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which the driver and all executors see.

    Only a session in one JVM (tests) that names none gets a temporary one; on a cluster that is an error.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and the executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tessella-checkpoint-"))
        named = context.getCheckpointDir()
    return named.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """``df`` materialised in the shared folder, so that lost executors lose nothing."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def delete_folder(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def whole(text: Column) -> Column:
    """The text with null as empty."""
    return F.coalesce(text.cast("string"), F.lit(""))


def bounded_broadcast(df: DataFrame, rows: int, limit: int) -> DataFrame:
    """A broadcast hint if ``rows``, the counted size of ``df``, is within ``limit``; else the plain frame, to be shuffled."""
    return F.broadcast(df) if rows <= limit else df


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of frames that nothing refers to any more; it does so when the driver collects
    garbage, which without this may be long after."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def free_name(df: DataFrame, base: str) -> str:
    """A column name like ``base`` that ``df`` hasn't."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def strings(column) -> Iterator[str]:
    """The values of an Arrow string column one by one, null as empty; one text at a time is copied."""
    for value in column:
        yield value.as_py() or ""


def words_of(text: str) -> list[bytes]:
    """ASCII lower-cased words between the white space of ``SPACE``, as UTF-8."""
    return text.encode("utf-8", "replace").lower().split()


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer (the finaliser of MurmurHash3)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x
