"""The corpus pipeline: toxicity, exact dedup, near-dedup, decontamination, packing.

Each stage takes all that its predecessor kept and writes Parquet; the next reads it. Filtering stages return the
columns they are given, with the rows that stay as they are; columns may have any names. A row is told by its doc_id
(null like any other value) and its text, never by the id alone: rows that share an id are judged each for itself. Null
texts count as empty, texts of any length are read whole, and an empty table gives an empty one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import bounded_broadcast, cut, delete_folder, free_name, shared_folder, table, whole
from tessella.llm.decontaminate import contaminated
from tessella.llm.exact_dedup import exact_duplicates, normalised
from tessella.llm.packing import pack
from tessella.llm.simhash import fingerprint_groups, fingerprints
from tessella.llm.toxicity import fit, with_score

#: Rows to remove (an id and a hash each) that may be broadcast.
BROADCAST_ROWS = 400_000


def _without(docs: DataFrame, mark: Column, lost: DataFrame) -> DataFrame:
    """``docs`` without the rows whose doc_id and ``mark`` are in ``lost`` (doc_id, mark), distinct; null equals null."""
    lost = lost.select(F.col("doc_id").alias("_lost_id"), F.col("mark").alias("_lost_mark"))
    lost = bounded_broadcast(lost, lost.count(), BROADCAST_ROWS)
    return docs.join(lost, docs["doc_id"].eqNullSafe(lost["_lost_id"]) & (mark == lost["_lost_mark"]), "left_anti")


def _once(docs: DataFrame, mark: Column, repeated: DataFrame) -> DataFrame:
    """``docs`` with one row of each doc_id and ``mark`` in ``repeated`` (doc_id, mark), distinct; the others as they are."""
    if repeated.isEmpty():
        return docs
    name = free_name(docs, "mark")
    marked = docs.withColumn(name, mark)
    repeated = repeated.select(F.col("doc_id").alias("_again_id"), F.col("mark").alias("_again_mark"))
    same = marked["doc_id"].eqNullSafe(repeated["_again_id"]) & (marked[name] == repeated["_again_mark"])
    single = marked.join(repeated, same, "left_semi").dropDuplicates(["doc_id", name])
    return marked.join(repeated, same, "left_anti").unionByName(single).drop(name)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that operator 2 doesn't predict toxic. A row is judged by its text alone; a null or empty text is clean, and so
    is every text if no label tells toxic from clean. Repeated rows stay as often as they are there."""
    score = free_name(docs, "score")
    return with_score(docs, fit(docs, table(spark, sf_dir, "labels")), score).filter(F.col(score) < 0.5).drop(score)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (operator 7), the row with the smallest doc_id; of several with that id, any one. Null and empty texts
    are equal. A null id stays only in a group without any other."""
    gone = cut(exact_duplicates(docs).filter("not kept").select("doc_id", "keep_id", F.col("text_sha256").alias("mark")))
    same = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    mark = F.sha2(normalised(F.col("text")), 256)
    rest = _without(docs, mark, cut(gone.filter(~same).select("doc_id", "mark").distinct()))
    return _once(rest, mark, cut(gone.filter(same).select("doc_id", "mark").distinct()))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked fingerprints (operator 10), the row with the smallest doc_id; of several with that id, one,
    chosen by the text's hash; a null id only in a group without any other. Rows that share an id but no link both stay.
    Null and empty texts have fingerprint zero and link like any other."""
    mark = F.xxhash64(whole(F.col("text")))
    prints = cut(fingerprints(docs.select("doc_id", "text", mark.alias("mark")), "text", "mark"))
    rows = prints.groupBy("doc_id", "mark", "fp").agg(F.count("*").alias("times"))
    rows = cut(rows.join(fingerprint_groups(prints), "fp", "left").withColumn("group", F.coalesce("group", "fp")))
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")
    heads = rows.groupBy("group").agg(F.min(first).alias("head"), F.count("*").alias("rows"), F.max("times").alias("times")).filter("rows > 1 or times > 1")
    rows = cut(rows.join(heads.select("group", "head"), "group"))
    stays = F.col("doc_id").eqNullSafe(F.col("head.doc_id")) & (F.col("mark") == F.col("head.mark"))
    rest = _without(docs, mark, rows.filter(~stays).select("doc_id", "mark"))
    return _once(rest, mark, rows.filter(stays & (F.col("times") > 1)).select("doc_id", "mark"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text contains no benchmark item (operator 5). A null or empty text contains none; repeated rows stay as
    often as they are there."""
    mark = F.xxhash64(whole(F.col("text")))
    rows = docs.select(F.struct(F.col("doc_id").alias("doc_id"), mark.alias("mark")).alias("doc_id"), "text")
    return _without(docs, mark, cut(contaminated(rows, table(spark, sf_dir, "benchmark")).select("doc_id.doc_id", "doc_id.mark").distinct()))


def pack_all(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in training sequences (operator 6); null texts are empty, repeated rows packed each."""
    return pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("packing", pack_all),
]

#: No SQL expresses the fitted scorer, the XXH64 fingerprints or the packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. Each stage's folder goes when the next is written; the last one's stays for the reader."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/corpus-pipeline-{uuid.uuid4().hex}"
    before = None
    for at, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(path := f"{folder}/{at}-{name}")
        docs = spark.read.parquet(path)
        if before:
            delete_folder(spark, before)
        before = path
    return docs
