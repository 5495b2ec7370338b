"""Benchmark decontamination by size-partitioned MinHash containment search (operator 5), DataFrame functions only.

Items are short and documents long, so the similarity of their full sets says nothing; containment does. Each item is
sketched by its SKETCH smallest shingle hashes (a bottom-k MinHash), and a document is searched for these hashes: the
share found estimates how much of the item it contains. Documents are partitioned by size: the longer a partition's
documents, the more hits it takes to become a candidate, up to LEAST_HITS, so that chance hits in long texts cost little.
An item contained to 80 % misses 4 of 16 hits with a probability of 2e-8. Candidates are verified by the exact containment of the item's shingles, compared as text.

Items are counted before anything is broadcast; beyond the limit the search is a shuffled join on the hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import bounded_broadcast, cut, table, whole

SHINGLE_WORDS = 5
CONTAINMENT = 0.8
SKETCH = 16
LEAST_HITS = 4
#: Rows of (hash, item) or of shingles that may be broadcast.
BROADCAST_ROWS = 400_000


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.array_remove(F.split(F.lower(whole(text)), r"[^\p{L}\p{N}]+"), "")


def _shingles(words: str, size: int, of) -> Column:
    """``of`` applied to the ``size`` columns of words of each shingle."""
    w = F.col(words)
    return F.when(
        F.size(w) >= size, F.transform(F.sequence(F.lit(0), F.size(w) - size), lambda i: of(*[F.get(w, i + k) for k in range(size)]))
    ).otherwise(F.array())


def _by_size(frame: DataFrame, sizes: list[int], of, name: str, *keep: str) -> DataFrame:
    """``keep`` and a row for each shingle of each of the sizes, with the number of shingles of that size in the text."""
    # The number is taken before the explode, which else copies the array to each of its rows; explode_outer, because
    # for explode the optimiser infers a filter that computes the shingles a second time, from the raw text.
    parts = [
        frame.select(*keep, F.lit(size).alias("size"), _shingles("words", size, of).alias("all"))
        .select(*keep, "size", F.size("all").alias("among"), "all")
        .select(*keep, "size", "among", F.explode_outer("all").alias(name))
        .filter(F.col(name).isNotNull())
        for size in sizes
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionAll(part)
    return out


def _text(*parts: Column) -> Column:
    return F.concat_ws(" ", *parts)


def contaminated(docs: DataFrame, items: DataFrame, text: str = "text", item_text: str = "text", containment: float = CONTAINMENT) -> DataFrame:
    """(doc_id, item_id, shingles, found, containment) for each item of which a document contains ``containment`` or more.

    Shingles are five words, lower-cased, without punctuation. An item of fewer words is one shingle of its whole length;
    an item without words is in no document. Null and empty documents contain nothing; documents of any length are read
    whole. Rows that repeat a doc_id count as one document, rows that repeat an item_id as one item; rows with a null
    doc_id or item_id are left out. Empty tables give an empty result; other columns are ignored. doc_id may be of any type
    that can be grouped.
    """
    docs = docs.select("doc_id", words(F.col(text)).alias("words")).filter("doc_id is not null")
    items = items.select(F.col("item_id").cast("long").alias("item_id"), words(F.col(item_text)).alias("words")).filter("item_id is not null and size(words) > 0")
    items = items.withColumn("size", F.least(F.size("words"), F.lit(SHINGLE_WORDS)))
    sizes = sorted(r.size for r in items.select("size").distinct().collect()) or [SHINGLE_WORDS]
    wanted = cut(_by_size(items.drop("size"), sizes, _text, "shingle", "item_id").join(items.select("item_id", "size").distinct(), ["item_id", "size"]).select("item_id", "size", "shingle").distinct())
    per_item = wanted.groupBy("item_id").agg(F.count("*").alias("shingles"))
    hashed = _by_size(items.drop("size"), sizes, F.xxhash64, "h", "item_id").join(items.select("item_id", "size").distinct(), ["item_id", "size"]).select("item_id", "size", "h").distinct()
    sketch = hashed.groupBy("item_id", "size").agg(F.slice(F.array_sort(F.collect_set("h")), 1, SKETCH).alias("hs"))
    sketch = cut(sketch.select("item_id", "size", F.size("hs").alias("sketched"), F.explode("hs").alias("h")))
    rows = sketch.count()

    found = (
        _by_size(docs, sizes, F.xxhash64, "h", "doc_id")
        .join(bounded_broadcast(sketch, rows, BROADCAST_ROWS), ["size", "h"])
        .groupBy("doc_id", "item_id")
        .agg(F.countDistinct("h").alias("hits"), F.max("among").alias("among"), F.max("sketched").alias("sketched"))
    )
    partition = F.floor(F.log(4.0, F.greatest(F.col("among"), F.lit(1)).cast("double")))  # sizes to a factor of four
    needed = F.least(F.greatest(F.lit(1), partition - 2), F.lit(LEAST_HITS), F.ceil(F.col("sketched") * containment / 2))
    candidates = cut(found.filter(F.col("hits") >= needed).select("doc_id", "item_id"))

    ids = candidates.select("doc_id").distinct()
    suspects = docs.join(bounded_broadcast(ids, ids.count(), BROADCAST_ROWS), "doc_id", "left_semi")
    exact = (
        _by_size(suspects, sizes, _text, "shingle", "doc_id")
        .join(bounded_broadcast(wanted, wanted.count(), BROADCAST_ROWS), ["size", "shingle"])
        .select("doc_id", "item_id", "shingle")
        .distinct()
        .groupBy("doc_id", "item_id")
        .agg(F.count("*").alias("found"))
        .join(candidates, ["doc_id", "item_id"])
        .join(per_item, "item_id")
    )
    share = F.col("found") / F.col("shingles")
    return exact.filter(share >= containment).select("doc_id", "item_id", "shingles", "found", share.alias("containment"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: DuckDB: the exact containment of every item in every document, without a search. Words are runs of letters and digits.
SQL = r"""
with d as (select doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') as w from documents where doc_id is not null),
     i as (select item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') as w from benchmark where item_id is not null),
     iz as (select item_id, w, least(len(w), 5) as k from i where len(w) > 0),
     s as (select distinct item_id, k, array_to_string(w[p : p + k - 1], ' ') as s from (select item_id, w, k, unnest(range(1, len(w) - k + 2)) as p from iz)),
     n as (select item_id, count(*) as shingles from s group by item_id),
     t as (select distinct doc_id, k, array_to_string(w[p : p + k - 1], ' ') as s
           from (select doc_id, w, k, unnest(range(1, len(w) - k + 2)) as p from d, (select distinct k from iz))),
     f as (select doc_id, item_id, count(*) as found from t join s using (k, s) group by all)
select doc_id, item_id, shingles, found, found / shingles as containment
from f join n using (item_id) where found / shingles >= 0.8
"""
