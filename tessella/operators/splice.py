"""Composition by splicing: text around the holes is copied, never re-serialised.

``holes`` (path, unit_id, start, end, source) with 0-based code-point offsets, the end exclusive.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def with_offsets(lines: DataFrame, path: str, number: str, text: str) -> DataFrame:
    """``start`` and ``end`` of each line in its file, lines parted by one line feed."""
    so_far = W.partitionBy(path).orderBy(number).rowsBetween(W.unboundedPreceding, 0)
    end = F.sum(F.length(text).cast("long") + 1).over(so_far) - 1
    return lines.withColumn("end", end).withColumn("start", F.col("end") - F.length(text))


def overlaps(holes: DataFrame) -> DataFrame:
    """(path, unit_id, start, prior_end): holes that begin before the one before them ends."""
    w = W.partitionBy("path").orderBy("start", "unit_id")
    return holes.withColumn("prior_end", F.lag("end").over(w)).filter(F.col("start") < F.col("prior_end")).select("path", "unit_id", "start", "prior_end")


def _spliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One pass over each text: Catalyst's substring counts code points from the head again for every piece."""
    for batch in batches:
        done = []
        for text, changes in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            parts, at = [], 0
            for change in changes or ():
                parts += [text[at : change["start"]], change["said"]]
                at = change["end"]
            done.append("".join([*parts, text[at:]]) if changes else text)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(done, pa.string())], ["path", "composed"])


def compose(files: DataFrame, holes: DataFrame, translations: DataFrame) -> DataFrame:
    """(path, composed): ``files`` (path, text) with the translations (unit_id, text) in their holes.

    A hole without a translation, or with its own source as one, keeps its bytes. Only replacements are gathered per
    file, as a sorted array; a file's text never leaves its row.
    """
    said = translations.select("unit_id", F.col("text").alias("said"))
    new = holes.join(said, "unit_id").filter("said <> source")
    changes = new.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("start", "end", "said"))).alias("changes"))
    rows = files.join(changes, "path", "left")
    return rows.select(F.col("path").cast("string").alias("path"), F.col("text").cast("string").alias("text"), "changes").mapInArrow(_spliced, "path string, composed string")
