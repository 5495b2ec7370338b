"""Line dedup by a log-template tree (operator 3), DataFrame functions only.

A line is parsed down a tree of fixed depth: its number of tokens, then its first DEPTH tokens, those with a digit as
``<*>``. In a leaf, a token that holds its place in fewer than LEAST_DOCS documents is a variable field and becomes
``<*>`` as well; what is left is the line's template. A template that recurs in LEAST_DOCS documents or more, and of
which at least half the tokens are constant, is boilerplate: its lines are dropped.

Equal lines are one row before any token is looked at, so that a line in a third of all documents costs what any other
costs, and only leaves that enough documents share are looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import SPACE, bounded_broadcast, cut, table, whole

DEPTH = 3
LEAST_DOCS = 10
FIELD = "<*>"
BROADCAST_ROWS = 400_000


def _tokens(line: Column) -> Column:
    """A line's tokens, those with a digit as FIELD."""
    masked = F.when(line.rlike("[0-9]"), F.regexp_replace(line, r"(?:[^\x20\x09-\x0D0-9]*+)[0-9][^\x20\x09-\x0D]*+", FIELD)).otherwise(line)
    return F.array_remove(F.split(masked, SPACE + "+"), "")


def _leaf(tokens: Column) -> Column:
    """A leaf's key: the number of tokens and the first DEPTH."""
    return F.concat_ws(" ", F.size(tokens).cast("string"), F.concat_ws(" ", F.slice(tokens, 1, DEPTH)))


def _lines(docs: DataFrame, text: str) -> DataFrame:
    """(doc, sha, number, line, h): h the hash of the line's leaf. doc is null-safe: the id as text, or empty."""
    t = whole(F.col(text))
    # What a document has once is made before its lines are dealt out: beside an explode it would be made for each line.
    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), F.sha2(t, 256).alias("sha"), F.split(t, "\n").alias("l"))
    rows = rows.select("doc", "sha", F.posexplode_outer("l").alias("number", "line"))
    return rows.select("doc", "sha", "number", "line", F.xxhash64(_leaf(_tokens(F.col("line")))).alias("h"))


def _shared(rows: DataFrame, key: list[str], least: int) -> DataFrame:
    """Keys that rows of at least so many documents have. A document counts once."""
    return rows.select(*key, "doc").distinct().groupBy(*key).agg(F.count("*").alias("docs")).filter(F.col("docs") >= least)


def template_lines(docs: DataFrame, text: str = "text", least_docs: int = LEAST_DOCS) -> DataFrame:
    """(doc, sha, number, template) for each line that is dropped."""
    lines = _lines(docs, text)
    leaves = cut(_shared(lines, ["h"], least_docs).select("h"))
    # The tokens are made again after the join, for the lines that are left; a filter before it would make them twice for all.
    some = lines.join(bounded_broadcast(leaves, leaves.count(), BROADCAST_ROWS), "h").select("doc", "sha", "number", F.array(_tokens(F.col("line"))).alias("tokens"))
    some = some.select("doc", "sha", "number", F.explode_outer("tokens").alias("tokens"))
    some = some.select("doc", "sha", "number", F.xxhash64(_leaf(F.col("tokens"))).alias("leaf"), F.concat_ws(" ", "tokens").alias("masked"))
    some = cut(some.withColumn("kind", F.xxhash64("leaf", "masked"))).filter("masked <> ''")
    # A kind of line is told by a 64-bit hash, so that its text moves once and not with each of its documents or tokens.
    counts = some.select("kind", "doc").distinct().groupBy("kind").agg(F.count("*").alias("docs"))
    kinds = cut(some.groupBy("kind").agg(F.min("leaf").alias("leaf"), F.min("masked").alias("masked")).join(counts, "kind"))
    tokens = kinds.select("leaf", "kind", "docs", F.posexplode_outer(F.split("masked", " ")).alias("place", "token"))
    held = tokens.groupBy("leaf", "place", "token").agg(F.sum("docs").alias("held")).filter(F.col("held") >= least_docs).filter(F.col("token") != FIELD)
    held = cut(held.select("leaf", "place", "token", F.lit(True).alias("constant")))
    parsed = tokens.join(held, ["leaf", "place", "token"], "left").withColumn("said", F.when(F.col("constant"), F.col("token")).otherwise(F.lit(FIELD)))
    parsed = parsed.groupBy("kind").agg(
        F.concat_ws(" ", F.transform(F.sort_array(F.collect_list(F.struct("place", "said"))), lambda x: x["said"])).alias("template"), F.count("constant").alias("constants"), F.count("*").alias("tokens")
    )
    parsed = cut(parsed.filter("2 * constants >= tokens").select("kind", "template", F.xxhash64("template").alias("shape")))
    # A kind or a shape that a third of all documents have is one key: its side is broadcast within a bound of rows, and
    # beyond it Spark splits the partitions that the key swells.
    shapes = bounded_broadcast(parsed.select("kind", "shape"), parsed.count(), BROADCAST_ROWS)
    told = cut(some.select("doc", "sha", "number", "kind").join(shapes, "kind").select("doc", "sha", "number", "shape"))
    recurring = _shared(told, ["shape"], least_docs).select("shape").join(parsed.groupBy("shape").agg(F.min("template").alias("template")), "shape")
    recurring = cut(recurring)
    return told.join(bounded_broadcast(recurring, recurring.count(), BROADCAST_ROWS // 8), "shape").select("doc", "sha", "number", "template").distinct()


def drop_template_lines(docs: DataFrame, text: str = "text", least_docs: int = LEAST_DOCS) -> DataFrame:
    """One row per row of ``docs``: doc_id, lines, dropped, clean_text (the lines left, as they were).

    Lines are parted by line feeds; empty lines stay. Null counts as empty: one empty line. Texts and lines of any length
    are read whole. Rows that repeat a doc_id count as one document; all rows with a null doc_id count as one. An empty
    table gives an empty result; other columns are ignored. Leaves, kinds of lines and templates are told apart by 64-bit
    hashes.
    """
    drop = template_lines(docs, text, least_docs).select("doc", "sha", "number").groupBy("doc", "sha").agg(F.collect_set("number").alias("numbers"))
    t = whole(F.col(text))
    rows = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), F.sha2(t, 256).alias("sha"), t.alias("t"))
    rows = rows.join(drop, ["doc", "sha"], "left").select("doc_id", F.split("t", "\n").alias("l"), F.coalesce("numbers", F.array().cast("array<int>")).alias("numbers"))
    kept = F.array_except(F.sequence(F.lit(0), F.size("l") - 1), F.col("numbers"))  # by hash: linear in the lines
    left = F.when(F.size("numbers") == 0, F.col("l")).otherwise(F.transform(kept, lambda i: F.get("l", i)))
    return rows.select("doc_id", F.size("l").cast("long").alias("lines"), F.size("numbers").cast("long").alias("dropped"), F.array_join(left, "\n").alias("clean_text"))


def op3_log_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = drop_template_lines(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "lines", "dropped", F.sha2("clean_text", 256).alias("clean_sha256"))


#: DuckDB: the same tree, leaf by leaf.
SQL = r"""
with d as (select doc_id, coalesce(cast(doc_id as varchar), '') as doc, string_split(coalesce(text, ''), chr(10)) as l from documents),
     n as (select doc, i as number, l[i + 1] as line from (select doc, l, unnest(range(len(l))) as i from d)),
     m as (select doc, number, list_filter(regexp_split_to_array(regexp_replace(line, '[^\x20\x09-\x0D]*[0-9][^\x20\x09-\x0D]*', '<*>', 'g'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from n),
     p as (select doc, number, concat_ws(' ', len(w), array_to_string(w[1:3], ' ')) as leaf, array_to_string(w, ' ') as masked from m where len(w) > 0),
     lv as (select leaf from p group by leaf having count(distinct doc) >= 10),
     s as (select p.* from p join lv using (leaf)),
     k as (select leaf, masked, count(distinct doc) as docs from s group by all),
     t as (select leaf, masked, docs, i as place, string_split(masked, ' ')[i + 1] as token from (select leaf, masked, docs, unnest(range(len(string_split(masked, ' ')))) as i from k)),
     h as (select leaf, place, token from t where token <> '<*>' group by all having sum(docs) >= 10),
     g as (select t.leaf, t.masked, string_agg(case when h.token is null then '<*>' else t.token end, ' ' order by t.place) as template, count(h.token) as constants, count(*) as tokens
           from t left join h on t.leaf = h.leaf and t.place = h.place and t.token = h.token group by all),
     o as (select s.doc, s.number, g.template from s join g using (leaf, masked) where 2 * g.constants >= g.tokens),
     r as (select template from o group by template having count(distinct doc) >= 10),
     x as (select o.doc, list(distinct o.number) as numbers from o join r using (template) group by o.doc)
select d.doc_id, len(d.l) as lines, coalesce(len(x.numbers), 0) as dropped,
       sha256(array_to_string(list_filter(d.l, lambda v, i: x.numbers is null or not list_contains(x.numbers, i - 1)), chr(10))) as clean_sha256
from d left join x using (doc)
"""
