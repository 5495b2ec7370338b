"""The merge as a stream: complete snapshots of units are announced, each merges into the catalog table.

A snapshot is a folder of any number of Parquet files. ``publish`` writes it whole and then announces it by one small
file; the stream reads announcements, so that it never takes a part of a snapshot for the whole of a locale. The table
is a folder of versions with a folder for each locale; a batch writes the locales that its snapshot has as the version
of its number, so that a batch that is run again after a failure overwrites its own version and no other. Locales it
lacks keep the version they have. Of each locale the newest KEPT versions stay, for readers that are still at one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessella.operators.merge import ENTRY, merged

UNITS = "locale string, path string, unit_id string, source string, reference string"
ENTRIES = f"locale string, path string, unit_id string, outcome string, obsolete boolean, {ENTRY}, state string"
ANNOUNCED = "snapshot string, path string"
KEPT = 2


def publish(units: DataFrame, folder: str, snapshot: str) -> None:
    """Writes the units (UNITS) of one snapshot under ``folder`` and announces it."""
    path = f"{folder}/data/{snapshot}"
    units.select(*[x.split()[0] for x in UNITS.split(", ")]).write.mode("overwrite").parquet(path)
    units.sparkSession.createDataFrame([(snapshot, path)], ANNOUNCED).coalesce(1).write.mode("append").json(f"{folder}/ready")


def _names(spark: SparkSession, folder: str) -> list[str]:
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []


def versions(spark: SparkSession, table: str) -> dict[str, list[int]]:
    """The versions of each locale that were written to their end, newest first."""
    out: dict[str, list[int]] = {}
    for number in sorted((int(n[1:]) for n in _names(spark, table) if n.startswith("v") and n[1:].isdigit()), reverse=True):
        names = _names(spark, f"{table}/v{number}")
        for name in names if "_SUCCESS" in names else ():
            if name.startswith("locale="):
                out.setdefault(name.removeprefix("locale="), []).append(number)
    return out


def _at(spark: SparkSession, table: str, before: int) -> DataFrame:
    """Every locale's newest version before a number."""
    newest = {locale: next((n for n in numbers if n < before), None) for locale, numbers in versions(spark, table).items()}
    plain = ", ".join(x for x in ENTRIES.split(", ", 1)[1:])
    parts = [spark.read.schema(plain).parquet(f"{table}/v{n}/locale={locale}").select(F.lit(locale).alias("locale"), "*") for locale, n in sorted(newest.items()) if n is not None]
    out = spark.createDataFrame([], ENTRIES)
    for part in parts:  # as many as there are locales
        out = out.unionByName(part)
    return out


def current(spark: SparkSession, table: str) -> DataFrame:
    return _at(spark, table, 1 << 62)


def _forget(spark: SparkSession, table: str) -> None:
    """Deletes what is older than the newest KEPT versions of a locale."""
    for locale, numbers in versions(spark, table).items():
        for n in numbers[KEPT:]:
            path = spark._jvm.org.apache.hadoop.fs.Path(f"{table}/v{n}/locale={locale}")
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def merge_stream(spark: SparkSession, folder: str, table: str, checkpoint: str, source_key: str, hash_key: str) -> StreamingQuery:
    """Starts the stream over the snapshots that are announced under ``folder``, one a batch; it ends when all are merged."""
    ready = spark.readStream.schema(ANNOUNCED).option("maxFilesPerTrigger", 1).json(f"{folder}/ready")

    def step(batch: DataFrame, number: int) -> None:
        own = batch.sparkSession
        for r in batch.collect():  # one announcement
            units = own.read.schema(UNITS).parquet(r.path)
            here = units.select("locale").distinct()
            touched = _at(own, table, number).join(F.broadcast(here), "locale", "left_semi").drop("outcome", "state")  # as many rows as locales
            merged(units, touched, source_key, hash_key).write.mode("overwrite").partitionBy("locale").parquet(f"{table}/v{number}")
        _forget(own, table)

    return ready.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
