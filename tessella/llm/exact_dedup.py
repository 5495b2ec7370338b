"""Exact duplicates by deterministic block naming (operator 7), DataFrame functions only.

A text is cut into blocks of a fixed number of bytes. All distinct blocks of the corpus are sorted, by their 64-bit hash
and then by themselves, and named by integers in that order; two blocks share a name exactly when they are equal. Then
adjacent pairs of names are named in the same way, round after round, until each text has one name. Equal names of the
last round mean equal texts: no hash decides.

Every distinct block is shuffled once together with its hash. A hash that only one block has names that block, so that
places need to carry the hash alone; the blocks of a hash that several share, and only those, are named by themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import SPACE, cut, table, whole

BLOCK_BYTES = 4096


def normalised(text: Column) -> Column:
    """Null is empty; every run of white space is one space."""
    return F.regexp_replace(whole(text), SPACE + "+", " ")


def _named(keys: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct rows of ``keys`` with ``name``: integers that rise in the order of ``columns``."""
    return cut(keys.select(*columns).distinct().orderBy(*columns).withColumn("name", F.monotonically_increasing_id()))


def _block_names(docs: DataFrame, text: str, block_bytes: int) -> DataFrame:
    """(doc_id, sha, n, pos, name) for every block of every text."""
    body = docs.select("doc_id", normalised(F.col(text)).alias("t")).select("doc_id", F.sha2("t", 256).alias("sha"), F.col("t").cast("binary").alias("t"))
    n = F.greatest(F.lit(1), F.ceil(F.octet_length("t") / block_bytes)).cast("int")
    # posexplode_outer: for posexplode the optimiser infers a filter that normalises the text a second time.
    blocks = body.select(
        "doc_id", "sha", n.alias("n"),
        F.posexplode_outer(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(F.col("t"), i * block_bytes + 1, F.lit(block_bytes)))).alias("pos", "block"),
    ).withColumn("h", F.xxhash64("block"))
    places = cut(blocks.select("doc_id", "sha", "n", "pos", "h"))
    variants = cut(blocks.select("h", "block").distinct().groupBy("h").agg(F.count("*").alias("variants")))
    out = places.join(_named(variants.filter("variants = 1"), ["h"]), "h").select("doc_id", "sha", "n", "pos", "name")
    several = variants.filter("variants > 1").select("h")
    if several.isEmpty():
        return out
    own = blocks.join(several, "h", "left_semi")
    names = _named(own, ["h", "block"]).withColumn("name", -2 - F.col("name"))  # apart from the others' names and from -1
    return out.unionAll(own.join(names, ["h", "block"]).select("doc_id", "sha", "n", "pos", "name"))


def identities(docs: DataFrame, text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, sha, n, name): equal (n, name) exactly for equal normalised texts. Repeated rows give one row."""
    level = cut(_block_names(docs, text, block_bytes).distinct())
    done = level.filter("n = 1").select("doc_id", "sha", "n", "name")
    level = level.filter("n > 1").withColumn("left", F.col("n"))
    widest = level.agg(F.max("n")).first()[0] or 1
    while widest > 1:
        half = F.expr("pos div 2")
        pairs = cut(
            level.groupBy("doc_id", "sha", "n", "left", half.alias("pos")).agg(
                F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("first"),
                F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1)).alias("second"),  # an odd last one is alone
            )
        )
        level = pairs.join(_named(pairs, ["first", "second"]), ["first", "second"]).select(
            "doc_id", "sha", "n", F.expr("cast((left + 1) div 2 as int)").alias("left"), "pos", "name"
        )
        level = cut(level)
        done = done.unionAll(level.filter("left = 1").select("doc_id", "sha", "n", "name"))
        level = level.filter("left > 1")
        widest = (widest + 1) // 2
    return done


def exact_duplicates(docs: DataFrame, text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256. Other columns are ignored.

    Null text counts as empty. In a group of equal texts the smallest doc_id stays (a null one only in a group without
    any other); rows that repeat a doc_id and its text count in group_size, and one of them is kept. An empty table
    gives an empty result. Texts of any length are read whole; those that differ only in the kind or length of white space
    runs are equal; case counts.
    """
    names = identities(docs.select("doc_id", F.col(text).alias("text")), "text", block_bytes)
    rows = docs.select("doc_id", F.sha2(normalised(F.col(text)), 256).alias("sha")).groupBy("doc_id", "sha").agg(F.count("*").alias("times"))
    rows = cut(
        rows.alias("r").join(names.alias("i"), F.col("r.doc_id").eqNullSafe(F.col("i.doc_id")) & (F.col("r.sha") == F.col("i.sha"))).select("r.*", "i.n", "i.name")
    )
    groups = cut(rows.groupBy("n", "name").agg(F.min("doc_id").alias("keep_id"), F.sum("times").alias("group_size")).filter("group_size > 1"))
    out = rows.join(groups, ["n", "name"], "left").select(
        "doc_id",
        F.coalesce("keep_id", "doc_id").alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))).alias("nth"),
        "sha",
    )
    return out.select("doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("nth") == 1)).alias("kept"), F.col("sha").alias("text_sha256"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


#: DuckDB: the same rows straight from the equality of the normalised texts.
SQL = r"""
with t as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as t from documents),
     g as (select t, min(doc_id) as keep_id, count(*) as group_size from t group by t)
select t.doc_id, g.keep_id, g.group_size, t.doc_id is not distinct from g.keep_id as kept, sha256(t.t) as text_sha256
from t join g using (t)
"""
