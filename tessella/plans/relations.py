"""The localization relations that the driver's tables stand in for, in Spark and in SQL.

A document is a lab, a line of it that isn't blank a unit; its source is the section. Labels are what is known of a
lab's first unit. Two snapshots of the documents, before and after an edit, feed the merge.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.identity import source_hash

LOCALES = ["de", "pt-BR"]
NOT_BLANK = r"[^\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines_of(docs: DataFrame, text: Column | None = None) -> DataFrame:
    """doc_id, section, n (from 1), source: the lines that aren't blank."""
    split = F.split(F.col("text") if text is None else text, "\n")
    rows = docs.select("doc_id", F.col("source").alias("section"), F.posexplode_outer(split).alias("n", "source"))
    return rows.filter(F.col("source").rlike(NOT_BLANK)).withColumn("n", F.col("n").cast("long") + 1)


def unit_name(doc: Column, n: Column) -> Column:
    return F.concat(F.lit("labs:doc-"), doc.cast("string"), F.lit(":body/p-"), n.cast("string"))


def source_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines_of(table(spark, sf_dir, "documents")).withColumn("unit_id", unit_name(F.col("doc_id"), F.col("n")))


def known_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    state = F.when(F.col("toxic") == 1, "fuzzy").when(F.col("quality") == 1, "reviewed").otherwise("needs-review")
    rows = labels.select("doc_id", unit_name(F.col("doc_id"), F.lit(1)).alias("unit_id"), state.alias("state"), F.explode(F.array(*map(F.lit, LOCALES))).alias("locale"))
    return rows.filter("not (locale = 'pt-BR' and doc_id % 5 = 0)")


def statuses_sql() -> str:
    return "st as (select l.locale, s.unit_id, s.section, coalesce(k.state, 'missing') as state, s.doc_id, s.n from src s cross join loc l left join known k on k.unit_id = s.unit_id and k.locale = l.locale)"


def fresh_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The units after the edit, for one locale per target: locale, path, unit_id, source, reference, ord."""
    docs = table(spark, sf_dir, "documents").filter("doc_id % 11 <> 0")
    rows = lines_of(docs).withColumn("source", F.when(F.col("doc_id") % 7 == 0, F.concat("source", F.lit("x"))).otherwise(F.col("source")))
    reference = F.concat(F.lit("labs/"), F.col("section"), F.lit("/doc-"), F.col("doc_id").cast("string"), F.lit(".md"))
    rows = rows.withColumn("unit_id", unit_name(F.col("doc_id"), F.col("n"))).withColumn("reference", reference)
    return rows.withColumn("locale", F.lit("de")).withColumn("path", F.concat(F.lit("i18n/de/labs/"), F.col("section"), F.lit("/doc-"), F.col("doc_id").cast("string"), F.lit(".po")))


def old_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalog entries before the edit, in the shape of a merge's entries. Some have a hash of their English, which an
    edit of the catalog by hand has made untrue, some an older English, some a translation of two lines."""
    docs = table(spark, sf_dir, "documents").filter("doc_id % 13 <> 0")
    rows = lines_of(docs).withColumn("unit_id", unit_name(F.col("doc_id"), F.col("n")))
    done, none = F.col("doc_id") % 3 != 0, F.lit(None).cast("string")
    recorded = F.when(F.col("doc_id") % 31 == 1, source_hash(F.concat("source", F.lit("?")))).when(F.col("doc_id") % 31 > 20, source_hash(F.col("source")))
    return rows.select(
        F.lit("de").alias("locale"), F.concat(F.lit("i18n/de/old/"), F.col("section"), F.lit(".po")).alias("path"), "unit_id", F.col("source").alias("msgid"),
        F.array(F.when(done, F.concat(F.lit("T:"), F.substring("source", 1, 8), F.when(F.col("doc_id") % 9 == 1, "\nzwei").otherwise(""))).otherwise(F.lit(""))).alias("msgstr"),
        F.when(F.col("doc_id") % 19 == 0, F.array(F.lit("needs-review"))).when(F.col("doc_id") % 23 == 0, F.array(F.lit("fuzzy"))).otherwise(F.array().cast("array<string>")).alias("flags"),
        F.array().cast("array<struct<marker:string,text:string>>").alias("comments"),
        F.when(F.col("doc_id") % 10 == 1, F.struct(none.alias("msgctxt"), F.concat(F.lit("was "), F.substring("source", 1, 5)).alias("msgid"), none.alias("msgid_plural"))).alias("previous"),
        (F.col("doc_id") % 17 == 0).alias("obsolete"), recorded.alias("recorded_hash"), F.col("n").alias("line"), "doc_id",
    )


#: The relations in DuckDB's SQL, by name; a query's WITH takes those it needs.
SQL = {
    "ln": r"ln as (select doc_id, source as section, i + 1 as n, l[i + 1] as source from (select doc_id, source, string_split(text, chr(10)) as l, unnest(range(len(string_split(text, chr(10))))) as i from documents) where regexp_matches(l[i + 1], '[^\x20\x09-\x0D]'))",
    "src": "src as (select doc_id, section, n, source, 'labs:doc-' || doc_id || ':body/p-' || n as unit_id from ln)",
    "loc": "loc as (select * from (values ('de'), ('pt-BR')) as v(locale))",
    "known": "known as (select doc_id, 'labs:doc-' || doc_id || ':body/p-1' as unit_id, locale, case when toxic = 1 then 'fuzzy' when quality = 1 then 'reviewed' else 'needs-review' end as state from labels cross join loc where not (locale = 'pt-BR' and doc_id % 5 = 0))",
    "st": statuses_sql(),
    "u": "u as (select doc_id, n, 'de' as locale, section, 'labs:doc-' || doc_id || ':body/p-' || n as unit_id, case when doc_id % 7 = 0 then source || 'x' else source end as source, 'labs/' || section || '/doc-' || doc_id || '.md' as reference, 'i18n/de/labs/' || section || '/doc-' || doc_id || '.po' as path from ln where doc_id % 11 <> 0)",
    "e": "e as (select doc_id, n, 'de' as locale, 'i18n/de/old/' || section || '.po' as path, 'labs:doc-' || doc_id || ':body/p-' || n as unit_id, source as msgid, case when doc_id % 3 <> 0 then 'T:' || substr(source, 1, 8) || case when doc_id % 9 = 1 then chr(10) || 'zwei' else '' end else '' end as msgstr, case when doc_id % 10 = 1 then 'was ' || substr(source, 1, 5) end as prev, 'sha256:' || substr(case when doc_id % 31 = 1 then sha256(source || '?') when doc_id % 31 > 20 then sha256(source) end, 1, 16) as rec, case when doc_id % 19 = 0 then 'needs-review' when doc_id % 23 = 0 then 'fuzzy' else '' end as flag, doc_id % 17 = 0 as obsolete from ln where doc_id % 13 <> 0)",
    "m": "m as (select coalesce(u.locale, e.locale) as locale, coalesce(u.path, e.path) as path, coalesce(u.unit_id, e.unit_id) as unit_id, case when e.unit_id is null then 'added' when u.unit_id is not null and e.obsolete then 'resurrected' when u.unit_id is not null and (e.msgid <> u.source or coalesce(e.rec <> 'sha256:' || substr(sha256(e.msgid), 1, 16), false)) then 'fuzzied' when u.unit_id is not null then 'unchanged' when not e.obsolete then 'obsoleted' else 'kept' end as outcome, u.unit_id is null as obsolete, coalesce(u.source, e.msgid) as msgid, e.msgid as old_msgid, coalesce(u.unit_id is not null and e.unit_id is not null and (e.msgid <> u.source or coalesce(e.rec <> 'sha256:' || substr(sha256(e.msgid), 1, 16), false)), false) as moved, e.prev as prev, coalesce(e.msgstr, '') as msgstr, coalesce(e.flag, '') as flag, u.reference as reference, u.source as u_source from u full join e on u.locale = e.locale and u.unit_id = e.unit_id)",
    "ms": "ms as (select *, case when msgstr = '' then 'missing' when moved or flag = 'fuzzy' then 'fuzzy' when flag = 'needs-review' then 'needs-review' else 'reviewed' end as state from m)",
}
NEEDS = {"src": ["ln"], "known": ["loc"], "st": ["ln", "src", "loc", "known"], "u": ["ln"], "e": ["ln"], "m": ["ln", "u", "e"], "ms": ["ln", "u", "e", "m"]}


def sql(body: str, *relations: str, more: str = "") -> str:
    """``body`` over the relations and what they need, in the order of SQL."""
    wanted = {x for r in relations for x in (*NEEDS.get(r, []), r)}
    parts = [SQL[k] for k in SQL if k in wanted] + ([more] if more else [])
    return f"with {', '.join(parts)} {body}" if parts else body
