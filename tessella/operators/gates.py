"""Gates and reports that a release asks for: coverage, inventory, protected terms, lengths, seeds, overrides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.identity import container_of


def coverage_gaps(diagnostics: DataFrame) -> DataFrame:
    """(section, gaps): warnings per file, files with any."""
    return diagnostics.filter("severity = 'warning'").groupBy(F.col("path").alias("section")).agg(F.count("*").alias("gaps"))


def surface_inventory(units: DataFrame, surfaces: list[str]) -> DataFrame:
    """(surface, files, containers, units), zeros for a surface without units. ``units`` (unit_id, reference)."""
    rows = units.select(F.substring_index("unit_id", ":", 1).alias("surface"), "reference", container_of(F.col("unit_id")).alias("container"))
    counts = rows.groupBy("surface").agg(F.countDistinct("reference").alias("files"), F.countDistinct("container").alias("containers"), F.count("*").alias("units"))
    every = units.sparkSession.createDataFrame([(s,) for s in surfaces], "surface string")
    return every.join(counts, "surface", "left").select("surface", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("files", "containers", "units")])


def lost_terms(pairs: DataFrame, terms: list[str]) -> DataFrame:
    """(unit_id, term): terms of the source that the translation lacks. ``pairs`` (unit_id, source, translation)."""
    lost = F.array_compact(F.array(*[F.when(F.col("source").contains(t) & ~F.col("translation").contains(t), F.lit(t)) for t in terms]))
    return pairs.select("unit_id", F.explode(lost).alias("term"))


def over_budget(pairs: DataFrame, budget: float, by_layout: dict[str, float] | None = None) -> DataFrame:
    """(unit_id, ratio): translations longer than the budget times the source. ``pairs`` may have ``layout``."""
    limit = F.lit(budget)
    for name, own in (by_layout or {}).items():
        limit = F.when(F.col("layout") == name, F.lit(own)).otherwise(limit)
    ratio = F.length("translation") / F.length("source")
    return pairs.filter((F.length("source") > 0) & (ratio > limit)).select("unit_id", ratio.alias("ratio"))


def same_blocks(one: Column, other: Column) -> Column:
    """Two arrays of blocks hold the same blocks, each as often."""
    return F.sort_array(one) == F.sort_array(other)


def seed(units: DataFrame, tree: DataFrame) -> DataFrame:
    """(unit_id, outcome, text): a translated tree's text where exactly one stands in the unit's place.

    ``units`` (unit_id, container, unit_key), ``tree`` (container, unit_key, text). Counts are taken before the join, so
    that many candidates of one place meet no unit.
    """
    places = tree.groupBy("container", "unit_key").agg(F.count("*").alias("n"), F.min("text").alias("text"))
    rows = units.join(places, ["container", "unit_key"], "left")
    outcome = F.when(F.col("n").isNull(), "missed").when(F.col("n") > 1, "ambiguous").otherwise("matched")
    return rows.select("unit_id", outcome.alias("outcome"), F.when(F.col("n") == 1, F.col("text")).alias("text"))


def override_standing(overrides: DataFrame, slides: DataFrame) -> DataFrame:
    """Overrides (container_id, source_slide_hash) with the slide they stand for: current, stale or orphaned."""
    rows = overrides.join(slides, "container_id", "left")
    standing = F.when(F.col("slide_hash").isNull(), "orphaned").when(F.col("slide_hash") == F.col("source_slide_hash"), "current").otherwise("stale")
    return rows.withColumn("standing", standing)
