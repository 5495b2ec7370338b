"""Extraction over a frame of files: locators run where the files are, a file at a time; what they find is rows."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions.identity import source_hash
from tessella.locators.deck import locate_deck
from tessella.locators.lab import locate_lab
from tessella.locators.quiz import locate_quiz
from tessella.locators.spans import Located

FOUND = (
    "what string, surface string, path string, ord int, unit_id string, start long, end long, source string, kind string, prefix string, "
    "code string, severity string, message string, line int, column int"
)


def locate(surface: str, text: str, quiz_schema: str | None) -> Located:
    if surface == "slides":
        return locate_deck(text)
    return locate_lab(text) if surface == "labs" else locate_quiz(text, quiz_schema or "")


def located(files: DataFrame, quiz_schema: str | None = None) -> DataFrame:
    """Rows of FOUND: ``what`` is unit, container or diagnostic. ``files`` (surface, path, text, ord).

    A source with a lone surrogate can't be a unit of a UTF-8 catalog and is said as an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.strip().split()[0] for x in FOUND.split(",")]
        kinds = [{"string": pa.string(), "int": pa.int32(), "long": pa.int64()}[x.strip().split()[1]] for x in FOUND.split(",")]
        for batch in batches:
            rows: list[tuple] = []
            for surface, path, text, n in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                found = locate(surface, text or "", quiz_schema)
                for h in list(found.holes):
                    if any("\ud800" <= c <= "\udfff" for c in h.source):
                        found.say("control-byte", f"{h.unit_id} holds an unpaired surrogate", h.start, h.end)
                        found.holes.remove(h)
                rows += [("unit", surface, path, n, h.unit_id, h.start, h.end, h.source, h.kind, h.prefix, None, None, None, None, None) for h in found.holes]
                rows += [("container", surface, path, n, f"{surface}:{c}", None, None, None, None, None, None, None, None, None, None) for c in found.containers]
                rows += [("diagnostic", surface, path, n, None, d.start, d.end, None, None, None, d.code, d.severity, d.message, d.line, d.column) for d in found.diagnostics]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return files.select("surface", "path", "text", "ord").mapInArrow(run, FOUND)


def units(found: DataFrame) -> DataFrame:
    """(unit_id, section, source, source_hash, reference, ord, start)."""
    rows = found.filter("what = 'unit'")
    return rows.select("unit_id", F.col("path").alias("section"), "source", source_hash(F.col("source")).alias("source_hash"), F.col("path").alias("reference"), "ord", "start")


def duplicate_containers(found: DataFrame) -> DataFrame:
    """(container, paths): containers that more than one file declares, files in their order."""
    rows = found.filter("what = 'container'").select(F.col("unit_id").alias("container"), "path", "ord").distinct()
    grouped = rows.groupBy("container").agg(F.sort_array(F.collect_list(F.struct("ord", "path"))).alias("p"))
    return grouped.filter("size(p) > 1").select("container", F.transform("p", lambda x: x["path"]).alias("paths"))


def diagnostic_line() -> object:
    """``path:line:column: severity: message [code]``."""
    return F.format_string("%s:%d:%d: %s: %s [%s]", "path", "line", "column", "severity", "message", "code")


def duplicate_ids(records: DataFrame) -> DataFrame:
    """(id, places): ids that are declared more than once. ``records`` (id, path, line, ord)."""
    place = F.struct("ord", "line", F.concat("path", F.lit(":"), F.col("line").cast("string")).alias("place"))
    rows = records.filter("id is not null").groupBy("id").agg(F.sort_array(F.collect_list(place)).alias("p"))
    return rows.filter("size(p) > 1").select("id", F.array_join(F.transform("p", lambda x: x["place"]), " and ").alias("places"))
