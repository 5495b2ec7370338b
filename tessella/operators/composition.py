"""A locale's tree: source files with translations and overrides spliced in, on the executors, a file to a row.

Frames: ``files`` (surface, path, text), ``units`` (unit_id, reference), ``entries`` (unit_id, msgid, text, state) of one
locale, ``overrides`` (slide_id, path, text). Only a file's own translations are gathered, with its row.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.locators.compose import CompositionError, banner, compose
from tessella.locators.overrides import fences, parse_override, replacement, slides_of
from tessella.operators import gates
from tessella.operators.extraction import locate

#: In front of English text that has no translation yet.
WATERMARK = "[EN] "
#: States whose translation is shown. The others show the English text, marked.
SHOWN = ("reviewed", "needs-review")
COMPOSED = "path string, text string, issues array<struct<unit_id:string,reason:string>>"
SLIDES = "slide_id string, path string, slide_hash string, layout string, text string, fences array<string>"
OVERRIDES = "slide_id string, path string, source_slide_hash string, slides int, text string, replacement string, fences array<string>, errors array<string>"


def slides(files: DataFrame) -> DataFrame:
    """SLIDES of the decks among ``files``: every slide with an id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tessella.locators.overrides import source_hash as digest

        names = [x.split()[0] for x in SLIDES.split(", ")]
        for batch in batches:
            rows = []
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for s in slides_of(text or ""):
                    if s.slide_id:
                        layout = s.fields.get("layout")
                        rows.append((s.slide_id, path, digest(s.text), layout if isinstance(layout, str) else None, s.text, fences(s.text)))
            if rows:
                kinds = [pa.string()] * 5 + [pa.list_(pa.string())]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return files.filter("surface = 'slides'").select("path", "text").mapInArrow(run, SLIDES)


def read_overrides(files: DataFrame) -> DataFrame:
    """OVERRIDES of ``files`` (slide_id, path, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.strip().split()[0] for x in OVERRIDES.split(", ")]
        for batch in batches:
            rows = []
            for slide_id, path, text in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                found = parse_override(text or "")
                rows.append((slide_id, path, found.anchor, len(found.slides), text, replacement(slide_id, found), fences(text or ""), found.errors))
            if rows:
                kinds = [pa.string()] * 3 + [pa.int32(), pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string())]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return files.select("slide_id", "path", "text").mapInArrow(run, OVERRIDES)


def standing(overrides: DataFrame, decks: DataFrame) -> DataFrame:
    """(slide_id, path, standing): current, stale, orphaned (no slide has the id) or broken (the file says no anchor)."""
    rows = gates.override_standing(overrides.withColumnRenamed("slide_id", "container_id"), decks.select(F.col("slide_id").alias("container_id"), "slide_hash"))
    broken = F.size("errors") > 0
    return rows.select(F.col("container_id").alias("slide_id"), "path", F.when(broken, "broken").otherwise(F.col("standing")).alias("standing"))


def blockers(entries: DataFrame, stale: DataFrame | None = None) -> DataFrame:
    """(id, reason) of what a strict composition refuses: units that aren't reviewed, overrides that aren't current."""
    rows = entries.filter("state <> 'reviewed'").select(F.col("unit_id").alias("id"), F.col("state").alias("reason"))
    if stale is not None:
        rows = rows.unionAll(stale.filter("standing <> 'current'").select(F.col("slide_id").alias("id"), F.concat(F.col("standing"), F.lit(" override")).alias("reason")))
    return rows


def spoken(entries: DataFrame, watermark: str = WATERMARK) -> DataFrame:
    """(unit_id, said): translations that are shown, and the marked English of the others."""
    return entries.select("unit_id", F.when(F.col("state").isin(*SHOWN), F.col("text")).otherwise(F.concat(F.lit(watermark), "msgid")).alias("said"))


def composed(files: DataFrame, units: DataFrame, said: DataFrame, overrides: DataFrame | None = None, quiz_schema: str | None = None, generator: str | None = None) -> DataFrame:
    """COMPOSED: every file with its translations and overrides, or with what stops it (text is null then).

    Holes of a slide that is overridden keep out. With ``generator`` each file says that it is generated.
    """
    mine = units.select("unit_id", "reference").join(said, "unit_id").groupBy(F.col("reference").alias("path")).agg(F.collect_list(F.struct("unit_id", "said")).alias("said"))
    rows = files.select("surface", "path", "text").join(mine, "path", "left")
    if overrides is not None:
        own = slides(files).select("slide_id", F.col("path").alias("deck")).join(overrides.select("slide_id", "replacement"), "slide_id")
        own = own.groupBy(F.col("deck").alias("path")).agg(F.collect_list(F.struct("slide_id", "replacement")).alias("replaced"))
        rows = rows.join(own, "path", "left")
    else:
        rows = rows.withColumn("replaced", F.lit(None).cast("array<struct<slide_id:string,replacement:string>>"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for surface, path, text, said, replaced in zip(*(batch.column(c).to_pylist() for c in range(5)), strict=True):
                found = locate(surface, text or "", quiz_schema)
                swap = {r["slide_id"]: r["replacement"] for r in replaced or ()}
                spans = [(s.start, s.end, swap[s.slide_id]) for s in slides_of(text or "") if s.slide_id in swap] if swap else []
                try:
                    done = compose(found, {r["unit_id"]: r["said"] for r in said or ()}, spans)
                    out.append((path, banner(surface, done, generator) if generator else done, []))
                except CompositionError as error:
                    out.append((path, None, [{"unit_id": i.unit_id, "reason": i.reason} for i in error.issues]))
            if out:
                kinds = [pa.string(), pa.string(), pa.list_(pa.struct([("unit_id", pa.string()), ("reason", pa.string())]))]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], ["path", "text", "issues"])

    return rows.select("surface", "path", "text", "said", "replaced").mapInArrow(run, COMPOSED)


FINDING = ("locale", "id", "gate", "detail")


def verified(pairs: DataFrame, terms: list[str], budget: float, budgets: dict[str, float]) -> DataFrame:
    """FINDING rows of translations. ``pairs`` (locale, unit_id, source, translation, layout); layout null where there is none.

    Gates: protected-term (a term of the source that the translation lacks), length-budget (too long for its layout) and
    uncovered (a layout without a budget of its own; the default was applied).
    """
    keyed = pairs.withColumn("id", F.col("unit_id")).withColumn("unit_id", F.struct("locale", "unit_id"))
    long = gates.over_budget(keyed, budget, budgets).select("unit_id", F.lit("length-budget").alias("gate"), F.format_string("%.2f", "ratio").alias("detail"))
    rows = long
    if terms:
        rows = rows.unionAll(gates.lost_terms(keyed, terms).select("unit_id", F.lit("protected-term").alias("gate"), F.col("term").alias("detail")))
    known = F.col("layout").isin(*budgets) if budgets else F.lit(False)
    bare = keyed.filter(F.col("layout").isNotNull() & ~known).select("unit_id", F.lit("uncovered").alias("gate"), F.col("layout").alias("detail"))
    return rows.unionAll(bare).select(F.col("unit_id.locale").alias("locale"), F.col("unit_id.unit_id").alias("id"), "gate", "detail")


def verified_overrides(locale: str, overrides: DataFrame, decks: DataFrame, terms: list[str]) -> DataFrame:
    """FINDING rows of overrides: fence-identity (its fenced blocks aren't the slide's), protected-term, and override (it is
    stale, orphaned or broken)."""
    both = overrides.join(decks.select("slide_id", F.col("text").alias("english"), F.col("fences").alias("own"), "slide_hash"), "slide_id")
    fenced = both.filter(~gates.same_blocks(F.col("own"), F.col("fences"))).select("slide_id", F.lit("fence-identity").alias("gate"), F.array_join(F.array_union(F.array_except("own", "fences"), F.array_except("fences", "own")), " | ").alias("detail"))
    rows = fenced
    if terms:
        pairs = both.select(F.col("slide_id").alias("unit_id"), F.col("english").alias("source"), F.col("text").alias("translation"))
        rows = rows.unionAll(gates.lost_terms(pairs, terms).select("unit_id", F.lit("protected-term").alias("gate"), F.col("term").alias("detail")))
    rows = rows.unionAll(standing(overrides, decks).filter("standing <> 'current'").select("slide_id", F.lit("override").alias("gate"), F.col("standing").alias("detail")))
    return rows.select(F.lit(locale).alias("locale"), F.col("slide_id").alias("id"), "gate", "detail")


def seeded(units: DataFrame, tree: DataFrame) -> DataFrame:
    """(unit_id, section, outcome, text): text of a translated tree for the units of containers with the same structure.

    ``units`` (unit_id, container, unit_key, section), ``tree`` (container, path, unit_key, text). A container matches if
    both sides have the same unit keys and the tree has it in one file; else its units are missed (no such container, or
    another structure) or ambiguous (several files). Order within the trees doesn't count.
    """

    def shape(rows: DataFrame, name: str, *more) -> DataFrame:
        keys = F.sha2(F.concat_ws("\n", F.sort_array(F.collect_list("unit_key"))), 256)
        return rows.groupBy("container").agg(keys.alias(name), *more)

    theirs = shape(tree, "theirs", F.countDistinct("path").alias("files"))
    same = shape(units, "ours").join(theirs, "container", "left")
    verdict = F.when(F.col("files") > 1, "ambiguous").when(F.col("ours") == F.col("theirs"), "matched").otherwise("missed")
    marked = units.join(same.select("container", verdict.alias("verdict")), "container")
    found = gates.seed(marked, tree.select("container", "unit_key", "text")).withColumnRenamed("outcome", "place")
    rows = marked.select("unit_id", "section", "verdict").join(found, "unit_id")
    outcome = F.when(F.col("verdict") == "matched", F.col("place")).otherwise(F.col("verdict"))
    return rows.select("unit_id", "section", outcome.alias("outcome"), F.when(outcome == "matched", F.col("text")).alias("text"))
