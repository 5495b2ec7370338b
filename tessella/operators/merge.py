"""The incremental merge of extracted units into catalogs.

``units``: locale, path, unit_id, source, reference. ``entries``: locale, path, unit_id, msgid, msgstr (array), flags
(array), comments (array of marker, text), previous (msgctxt, msgid, msgid_plural), obsolete. A merge is one full outer
join on (locale, unit_id), whose sides are dealt out once, and a CASE over both sides. An entry follows its unit's id:
it goes to the catalog of the unit's file wherever it was before; what has no unit stays where it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.functions.identity import container_of, source_hash
from tessella.operators.states import FUZZY, NEEDS_REVIEW, is_draftable, source_moved, unit_state, with_provenance

CATALOG_ROOT = "i18n"
ENTRY = (
    "comments array<struct<marker:string,text:string>>, flags array<string>, "
    "previous struct<msgctxt:string,msgid:string,msgid_plural:string>, msgid string, msgstr array<string>"
)


def catalog_path(locale: Column, source_path: Column) -> Column:
    """Where the catalog of a source file is. A name that starts with its only dot has no extension."""
    stem = F.regexp_replace(source_path, r"(?<=[^/])\.[^./]*\z", "")
    return F.concat(F.lit(CATALOG_ROOT + "/"), locale, F.lit("/"), stem, F.lit(".po"))


def catalog_name(path: Column) -> Column:
    """A catalog's path below its locale, without the ending."""
    return F.regexp_replace(F.regexp_replace(path, "^[^/]*/[^/]*/", ""), r"\.po\z", "")


def outcome(unit_there: Column, entry_there: Column, obsolete: Column, moved: Column) -> Column:
    return (
        F.when(unit_there & ~entry_there, "added")
        .when(unit_there & obsolete, "resurrected")
        .when(unit_there & moved, "fuzzied")
        .when(unit_there, "unchanged")
        .when(~obsolete, "obsoleted")
        .otherwise("kept")
    )


class DuplicateUnitError(ValueError):
    """Units that are in one batch twice; ``rows`` has (locale, unit_id, n)."""

    def __init__(self, rows: list) -> None:
        super().__init__("; ".join(f"{r.unit_id!r} is {r.n} times among the units of {r.locale}" for r in rows))
        self.rows = rows


def repeated_units(units: DataFrame) -> DataFrame:
    """(locale, unit_id, n): ids that a batch has more than once in a locale. A merge of such a batch has no meaning."""
    return units.groupBy("locale", "unit_id").agg(F.count("*").alias("n")).filter("n > 1")


def assert_batch(units: DataFrame) -> None:
    """Raises for ids that repeat, naming up to ten."""
    if rows := repeated_units(units).orderBy("locale", "unit_id").take(10):
        raise DuplicateUnitError(rows)


def classified(units: DataFrame, entries: DataFrame) -> DataFrame:
    """Both sides of every id with ``outcome`` and ``moved``; u_ and e_ prefix the sides' columns.

    An id that the units have twice in a locale is an error (``assert_batch`` names them beforehand). Of a live and an
    obsolete entry of one id the live one meets the unit, and the other goes; without the unit both stay. The windows
    that tell this are dealt out as the join is: no row moves for them.
    """
    same = W.partitionBy("locale", "unit_id")
    once = F.when(F.count("*").over(same) > 1, F.raise_error(F.concat(F.lit("unit id is in the batch twice: "), F.col("unit_id"))).cast("boolean")).otherwise(F.lit(True))
    u = units.withColumn("u_there", once).select("locale", "unit_id", *[F.col(c).alias(f"u_{c}") for c in units.columns if c not in ("locale", "unit_id")], "u_there")
    twin = F.col("obsolete") & F.max(~F.col("obsolete")).over(same)
    e = entries.withColumn("e_twin", twin).select("locale", "unit_id", *[F.col(c).alias(f"e_{c}") for c in entries.columns if c not in ("locale", "unit_id")], F.lit(True).alias("e_there"), "e_twin")
    both = u.join(e, ["locale", "unit_id"], "full")
    there, was = F.coalesce("u_there", F.lit(False)), F.coalesce("e_there", F.lit(False))
    both = both.filter(~(there & F.coalesce("e_twin", F.lit(False)))).drop("e_twin")
    recorded = F.col("e_recorded_hash") if "e_recorded_hash" in both.columns else F.lit(None).cast("string")
    moved = there & was & source_moved(F.col("e_msgid"), recorded, F.col("u_source"))
    dead = F.coalesce("e_obsolete", F.lit(False))
    return both.withColumn("moved", moved).withColumn("outcome", outcome(there, was, dead, F.col("moved")))


def merged(units: DataFrame, entries: DataFrame, source_key: str, hash_key: str) -> DataFrame:
    """The entries after the merge: locale, path, unit_id, outcome, obsolete, comments, flags, previous, msgid, msgstr, state."""
    both = classified(units, entries)
    new, lost = F.col("outcome") == "added", F.col("outcome").isin("obsoleted", "kept")
    empty = F.array().cast("array<struct<marker:string,text:string>>")
    digest = source_hash(F.col("u_source"))
    comments = F.when(lost, F.col("e_comments")).otherwise(with_provenance(F.coalesce("e_comments", empty), F.col("u_reference"), digest, source_key, hash_key))
    flags = F.coalesce("e_flags", F.array().cast("array<string>"))
    flags = F.when(F.col("moved") & ~F.array_contains(flags, FUZZY), F.array_append(flags, FUZZY)).otherwise(flags)
    old = F.col("e_previous")
    previous = F.when(
        F.col("moved"), F.struct(old["msgctxt"].alias("msgctxt"), F.col("e_msgid").alias("msgid"), old["msgid_plural"].alias("msgid_plural"))
    ).otherwise(old)
    msgstr = F.when(new, F.array(F.lit(""))).otherwise(F.col("e_msgstr"))
    return both.select(
        "locale", F.coalesce("u_path", "e_path").alias("path"), "unit_id", "outcome", lost.alias("obsolete"), comments.alias("comments"), flags.alias("flags"),
        previous.alias("previous"), F.coalesce("u_source", "e_msgid").alias("msgid"), msgstr.alias("msgstr"),
    ).withColumn("state", unit_state(F.col("msgstr"), F.col("flags")))


def summary(rows: DataFrame) -> DataFrame:
    """Counts of outcomes per locale; ``fuzzy`` has the fuzzied and the resurrected that are fuzzy."""
    names = ("added", "unchanged", "fuzzied", "resurrected", "obsoleted")
    revived = F.count(F.when((F.col("outcome") == "resurrected") & (F.col("state") == FUZZY), 1))
    counts = rows.groupBy("locale").agg(*[F.count(F.when(F.col("outcome") == n, 1)).alias(n) for n in names], revived.alias("resurrected_fuzzy"))
    return counts.withColumn("fuzzy", F.col("fuzzied") + F.col("resurrected_fuzzy"))


def duplicate_ids(entries: DataFrame) -> DataFrame:
    """(locale, unit_id, places): ids in more than one place of a locale's catalogs, places as path:line."""
    place = F.concat("path", F.lit(":"), F.col("line").cast("string"))
    found = entries.groupBy("locale", "unit_id").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_list(place)), " and ").alias("places"))
    return found.filter("n > 1").select("locale", "unit_id", "places")


def path_collisions(paths: DataFrame) -> DataFrame:
    """(catalog_path, owners): source paths that would share a catalog."""
    rows = paths.select("path", catalog_path(F.lit("_"), F.col("path")).alias("catalog_path")).distinct()
    return rows.groupBy("catalog_path").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_list("path")), " and ").alias("owners")).filter("n > 1").drop("n")


def leftovers(entries: DataFrame, units: DataFrame) -> DataFrame:
    """Entries without a unit."""
    return entries.join(units.select("locale", "unit_id"), ["locale", "unit_id"], "left_anti")


def orphan_catalogs(entries: DataFrame, targets: DataFrame) -> DataFrame:
    """Catalogs that no source file has any more."""
    return entries.select("locale", "path").distinct().join(targets.select("locale", "path"), ["locale", "path"], "left_anti")


def donor_paths(units: DataFrame, entries: DataFrame) -> DataFrame:
    """(locale, path, donor): where the first unit of each catalog that had an entry had it. ``units`` has ``ord``."""
    pool = entries.select("locale", "unit_id", F.col("path").alias("pool_path"))
    return units.join(pool, ["locale", "unit_id"]).groupBy("locale", "path").agg(F.min_by("pool_path", "ord").alias("donor"))


def shifted_units(rows: DataFrame) -> DataFrame:
    """(locale, unit_id, from_id): units whose English now is what another unit of the container was translated from.

    ``rows`` are merged entries. Of several with the same old English the first counts: a fuzzied one before an
    obsoleted one, then by id. Reported, never acted on.
    """
    rows = rows.withColumn("container", container_of(F.col("unit_id")))
    old = rows.filter("outcome in ('fuzzied', 'obsoleted')").select(
        "locale", "container", F.when(F.col("outcome") == "fuzzied", F.col("previous.msgid")).otherwise(F.col("msgid")).alias("english"), F.col("unit_id").alias("from_id"), (F.col("outcome") == "obsoleted").cast("int").alias("late")
    )
    first = old.filter("english is not null").groupBy("locale", "container", "english").agg(F.min(F.struct("late", "from_id")).alias("first"))
    first = first.select("locale", "container", "english", F.col("first.from_id").alias("from_id"))
    now = rows.filter("outcome in ('added', 'fuzzied')").select("locale", "container", F.col("msgid").alias("english"), "unit_id")
    return now.join(first, ["locale", "container", "english"]).filter("from_id <> unit_id").select("locale", "unit_id", "from_id")


def rekeyed_containers(rows: DataFrame) -> DataFrame:
    """(locale, container, added, fuzzied, obsoleted, shifted, certain): containers that look re-keyed."""
    names = ("added", "fuzzied", "obsoleted")
    counts = rows.groupBy("locale", container_of(F.col("unit_id")).alias("container")).agg(*[F.count(F.when(F.col("outcome") == n, 1)).alias(n) for n in names])
    shifts = shifted_units(rows).groupBy("locale", container_of(F.col("unit_id")).alias("container")).agg(F.count("*").alias("shifted"))
    out = counts.join(shifts, ["locale", "container"], "left").withColumn("shifted", F.coalesce("shifted", F.lit(0).cast("long")))
    certain = (F.col("shifted") > 0) | ((F.col("added") > 0) & (F.col("obsoleted") > 0))
    return out.withColumn("certain", certain).filter(F.col("certain") | ((F.col("added") > 0) & (F.col("fuzzied") > 0)))


def draftable(entries: DataFrame) -> DataFrame:
    state = unit_state(F.col("msgstr"), F.col("flags"))
    return entries.filter(~F.col("obsolete") & is_draftable(state, F.col("flags")))


def with_drafts(entries: DataFrame, drafts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Live entries with the drafts (locale, unit_id, text) recorded, and the drafts refused with the reason.

    A draft is refused if it is empty, has no entry or would replace what a person wrote. A recorded one is flagged
    needs-review; nothing here can make an entry reviewed.
    """
    live = entries.filter(~F.col("obsolete"))
    state = unit_state(F.col("msgstr"), F.col("flags"))
    marks = live.select("locale", "unit_id", is_draftable(state, F.col("flags")).alias("free"))
    judged = drafts.join(marks, ["locale", "unit_id"], "left")
    reason = F.when(F.col("text") == "", "empty-draft").when(F.col("free").isNull(), "no-entry").when(~F.col("free"), "human-work")
    judged = judged.withColumn("reason", reason)
    good = judged.filter("reason is null").select("locale", "unit_id", F.col("text").alias("draft"))
    flags = F.array_remove(F.col("flags"), FUZZY)
    flags = F.when(F.array_contains(flags, NEEDS_REVIEW), flags).otherwise(F.array_append(flags, NEEDS_REVIEW))
    out = live.join(good, ["locale", "unit_id"], "left")
    has = F.col("draft").isNotNull()
    out = out.withColumn("flags", F.when(has, flags).otherwise(F.col("flags"))).withColumn("msgstr", F.when(has, F.array("draft")).otherwise(F.col("msgstr")))
    if "previous" in out.columns:
        out = out.withColumn("previous", F.when(~has, F.col("previous")))
    return out.drop("draft"), judged.filter("reason is not null").select("locale", "unit_id", "text", "reason")
