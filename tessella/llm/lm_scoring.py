"""LM scoring by cross-entropy difference (operator 4).

Two n-gram models are counted over the corpus: the target model over the documents of high quality, the background model
over all. They are matched: one vocabulary (every distinct word of the corpus and a mark for the ends of a text), one
smoothing, one estimate. A text is read as a ring of its words and the mark. A word's loss after its predecessor is the
mean of its losses under the bigram and the unigram estimate (log-linear interpolation),

    (log(n(predecessor) + SMOOTH V) - log(n(pair) + SMOOTH)) / 2 + (log(N + V) - log(n(word) + 1)) / 2

with V the size of the vocabulary and N all words and marks, and a document's score is the mean over its words and mark
of the loss under the target model less that under the background model; below zero it reads more like the target.

The loss is a sum of a term per word and a term per pair, so that nothing needs the counts of two grams at once. A
document's distinct grams (hashes of words and of pairs) are dealt out to shards by their hash, as one row of
bytes per document and shard. A shard holds all places of its grams: it counts them and gives each of its documents its
part of the sums. What is gathered grows with the corpus; the number of shards grows with the words counted, and a
shard's size doesn't. Grams so frequent that they would swell one shard (found from the counts of blocks: a gram with a
``2 / heavy`` share of all words has a ``1 / heavy`` share of the words of blocks where it is frequent) are at most
``2 * heavy``; their exact counts are broadcast and their terms added where the document is read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.blocks import Powers, Words, blocks
from tessella.llm.common import bounded_broadcast, cut, mix64, table, whole

#: Added to every count of a pair, and the bigram estimate's share of the loss.
SMOOTH, SHARE = 0.1, 0.5
BROADCAST_ROWS = 2_000_000
#: Words of a block that a task counts at once, and of a shard.
BLOCK, SHARD = 1_000_000, 4_000_000
#: Distinct words that a task merges before it sends them on.
MERGED = 2_000_000
#: Shards, and frequent grams, at least.
LEAST_SHARDS, LEAST_HEAVY = 16, 4096


def rings(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """The rings of the texts that have words, one after another: a text's mark (0), its words. (symbols, text of each)."""
    has = np.bincount(words.owner, minlength=len(words.edges) - 1) > 0
    place = np.arange(len(words.owner)) + np.cumsum(has)[words.owner]
    symbols, owner = np.zeros(len(place) + int(has.sum()), np.uint64), np.empty(len(place) + int(has.sum()), np.int64)
    symbols[place], owner[place] = words.hashes, words.owner
    marks = np.ones(len(symbols), bool)
    marks[place] = False
    owner[marks] = np.flatnonzero(has)
    return symbols, owner


def grams(symbols: np.ndarray) -> np.ndarray:
    """48-bit keys of the words (even) and pairs (odd) of whole rings. What follows a text's last word is its mark, and all
    marks are 0."""
    word = mix64(symbols + np.uint64(0x9E3779B97F4A7C15))
    pair = mix64(word ^ np.roll(symbols, -1))
    return np.concatenate([word >> np.uint64(17) << np.uint64(1), pair >> np.uint64(17) << np.uint64(1) | np.uint64(1)])


def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and how often each is there."""
    keys = np.sort(keys)
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[at], np.diff(np.append(at, len(keys)))


def _summed(keys: np.ndarray, *counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys and the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[at], *(np.add.reduceat(c[order], at) if len(at) else c for c in counts)


def _survey(heavy: int):
    """(kind, key, n): 0 each distinct word and the mark; 1 grams that are frequent in a block; 2 all words and marks (key
    0), those of the target (key 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        held, size, target = [], 0, 0
        merged = (np.zeros(0, np.uint64), np.zeros(0, np.int64))

        def rows(kind: int, keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], ["kind", "key", "n"])

        def block() -> Iterator[pa.RecordBatch]:
            nonlocal merged
            symbols = np.concatenate(held)
            keys, n = _counted(grams(symbols))
            often = n * heavy >= len(symbols)
            yield rows(1, keys[often], n[often])
            yield rows(2, np.arange(2, dtype=np.uint64), np.array([len(symbols), target]))
            own = keys & np.uint64(1) == 0  # the words
            merged = _summed(np.concatenate([merged[0], keys[own]]), np.concatenate([merged[1], n[own]]))
            if len(merged[0]) > MERGED:
                yield rows(0, *merged)
                merged = (np.zeros(0, np.uint64), np.zeros(0, np.int64))

        for batch in batches:
            wanted = batch.column(0).to_numpy(zero_copy_only=False)
            for low, x, edges in blocks(batch.column(1)):
                symbols, owner = rings(Words(x, edges, powers))
                held.append(symbols)
                size += len(symbols)
                target += int(wanted[low + owner].sum())
                if size > BLOCK:
                    yield from block()
                    held, size, target = [], 0, 0
        if size:
            yield from block()
        yield rows(0, *merged)

    return run


def _frequent(sent):
    """(key, n, t) of the grams in the broadcast array, counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, keys = Powers(), sent.value
        n, t = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        for batch in batches:
            wanted = batch.column(0).to_numpy(zero_copy_only=False)
            for low, x, edges in blocks(batch.column(1)):
                symbols, owner = rings(Words(x, edges, powers))
                found = grams(symbols)
                at = np.minimum(np.searchsorted(keys, found), len(keys) - 1)
                mine = keys[at] == found
                n += np.bincount(at[mine], minlength=len(keys))
                mine &= np.tile(wanted[low + owner], 2)
                t += np.bincount(at[mine], minlength=len(keys))
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n), pa.array(t)], ["key", "n", "t"])

    return run


def _terms(keys: np.ndarray, n: np.ndarray, vocabulary: int) -> np.ndarray:
    """A gram's part of the loss of a place."""
    pair = (keys & np.uint64(1)).astype(bool)
    return np.where(pair, -SHARE * np.log(n + SMOOTH), SHARE * np.log(n + SMOOTH * vocabulary) - (1 - SHARE) * np.log(n + 1))


PARTS = "row long, doc_id long, tokens long, target boolean, target_loss double, background_loss double, shard int, grams binary, times binary"


def _deal(sent, shards: int, vocabulary: int):
    """A row per document and shard: the document's grams there (6 bytes each) and how often each occurs (1 byte; repeated
    beyond 255). The first also has the document's words and the sums of its frequent grams."""
    names = [x.split()[0] for x in PARTS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        heavy, n, t = sent.value
        terms = [_terms(heavy, x, vocabulary) for x in (t, n)]
        once: list[pa.RecordBatch] = []  # what a document has once: its columns, its words, its sums
        held: list[tuple] = []
        docs = size = 0

        def ready() -> pa.RecordBatch:
            doc, keys, times = (np.concatenate([x[k] for x in held]) for k in range(3))
            own = pa.Table.from_batches(once).combine_chunks()
            # a count beyond 255 is several entries
            parts = (times + 254) // 255
            turn = np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)
            doc, keys, times = (np.repeat(x, parts) for x in (doc, keys, times))
            times = np.minimum(times - 255 * turn, 255)
            # entries by document and shard, and before them one without a gram for what the document has once
            rows = own.column("row").to_numpy()
            shard = np.concatenate([((keys >> np.uint64(1)) % np.uint64(shards)).astype(np.int64), rows % shards])
            doc = np.concatenate([doc, np.arange(len(rows))])
            alone = np.arange(len(doc)) >= len(keys)
            order = np.argsort(doc << 43 | shard << 1 | ~alone)  # under 2 ** 20 documents here, and shards of corpora to come
            doc, shard, alone = doc[order], shard[order], alone[order]
            at = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (shard[1:] != shard[:-1])]))
            ends = np.concatenate([[0], np.cumsum(~alone)])[np.append(at, len(doc))]
            entry, take, first = order[~alone], doc[at], alone[at]
            arrays = [own.column(k).combine_chunks().take(pa.array(take)) for k in ("row", "doc_id", "target")]
            sums = [pa.array(np.where(first, own.column(k).to_numpy()[take], 0)) for k in ("tokens", "target_loss", "background_loss")]
            values = (keys[entry].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6], times[entry].astype(np.uint8).reshape(-1, 1))
            blobs = [pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer((ends * x.shape[1]).astype(np.int32).tobytes()), pa.py_buffer(x.tobytes())]) for x in values]
            return pa.RecordBatch.from_arrays([arrays[0], arrays[1], sums[0], arrays[2], sums[1], sums[2], pa.array(shard[at].astype(np.int32)), *blobs], names)

        for batch in batches:
            for low, x, edges in blocks(batch.column(3)):
                words = Words(x, edges, powers)
                many = len(edges) - 1
                symbols, owner = rings(words)
                # a text's number fits above its grams' 48 bits
                both, times = _counted(np.tile(owner.astype(np.uint64) << np.uint64(48), 2) | grams(symbols))
                doc, keys = (both >> np.uint64(48)).astype(np.int64), both & np.uint64(2**48 - 1)
                sums = [np.zeros(many)] * 2
                if len(heavy):
                    at = np.minimum(np.searchsorted(heavy, keys), len(heavy) - 1)
                    often = heavy[at] == keys
                    sums = [np.bincount(doc[often], weights=term[at[often]] * times[often], minlength=many).astype(float) for term in terms]
                    keys, doc, times = keys[~often], doc[~often], times[~often]
                own = batch.slice(low, many)
                columns = [own.column(0), own.column(1), own.column(2), pa.array(np.bincount(words.owner, minlength=many)), *map(pa.array, sums)]
                once.append(pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "target", "tokens", "target_loss", "background_loss"]))
                held.append((docs + doc, keys, times))
                docs += many
                size += len(keys) + many
                if size > 400_000:
                    yield ready()
                    once, held, docs, size = [], [], 0, 0
        if docs:
            yield ready()

    return run


def _bytes(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary column, and the size of each value."""
    found, sizes = [np.zeros(0, np.uint8)], [np.zeros(0, np.int64)]
    for chunk in column.chunks:
        edges = np.frombuffer(chunk.buffers()[1], np.int64 if pa.types.is_large_binary(chunk.type) else np.int32)[chunk.offset : chunk.offset + len(chunk) + 1].astype(np.int64)
        found.append(np.frombuffer(chunk.buffers()[2] or b"", np.uint8)[edges[0] : edges[-1]])
        sizes.append(np.diff(edges))
    return np.concatenate(found), np.concatenate(sizes)


def _shard(vocabulary: int):
    """(row, doc_id, tokens, target_loss, background_loss): each document's part from the shard that a task has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        part = pa.Table.from_batches(held)
        keys, _ = _bytes(part.column("grams"))
        wide = np.zeros((len(keys) // 6, 8), np.uint8)
        wide[:, :6] = keys.reshape(-1, 6)
        keys = wide.reshape(-1).view("<u8")
        times, sizes = _bytes(part.column("times"))
        doc = np.repeat(np.arange(part.num_rows), sizes)
        target = part.column("target").to_numpy()
        distinct, place = np.unique(keys, return_inverse=True)
        out = [part.column(k).to_numpy(zero_copy_only=False) if k != "doc_id" else part.column(k) for k in ("row", "doc_id", "tokens")]
        for name, counted in (("target_loss", times * target[doc]), ("background_loss", times)):
            term = _terms(distinct, np.bincount(place, weights=counted, minlength=len(distinct)), vocabulary)
            out.append(part.column(name).to_numpy() + np.bincount(doc, weights=term[place] * times, minlength=part.num_rows).astype(float))
        yield from pa.Table.from_arrays([x if isinstance(x, pa.ChunkedArray) else pa.array(x) for x in out], ["row", "doc_id", "tokens", "target_loss", "background_loss"]).to_batches()

    return run


def cross_entropy_difference(docs: DataFrame, target_ids: DataFrame, text: str = "text", shard_words: int = SHARD, heavy: int | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, tokens, target_loss, background_loss, score (their difference, a word's mean).

    ``target_ids`` (doc_id) names the target documents; null ids there name none. Words are ASCII lower-cased and lie
    between ASCII white space. Null and empty texts have no words and 0 everywhere; texts of any length are read whole.
    Without target documents the target model is uniform. Rows that repeat a doc_id are scored and counted each for
    itself; a null doc_id stays null and is no target. An empty table gives an empty result; other columns are ignored.
    Documents are counted in the models that score them. Grams are told apart by 47-bit hashes: of a billion, one in
    100,000 shares its count with another, at every size of a text.
    """
    spark = docs.sparkSession
    ids = target_ids.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("_target")).distinct()
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), whole(F.col(text)).alias("text"))
    heavy = heavy or max(LEAST_HEAVY, 16 * rows.rdd.getNumPartitions())
    rows = rows.join(bounded_broadcast(ids, ids.count(), BROADCAST_ROWS), F.col("doc_id") == F.col("_target"), "left")
    rows = rows.select("row", "doc_id", F.col("_target").isNotNull().alias("target"), "text")

    survey = cut(rows.select("target", "text").mapInArrow(_survey(heavy), "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n")))
    sizes = [F.sum(F.when((F.col("kind") == 2) & (F.col("key") == k), F.col("n"))).alias(name) for k, name in enumerate(("words", "wanted"))]
    seen = survey.agg(F.count_if(F.col("kind") == 0).alias("vocabulary"), *sizes).first()
    vocabulary, words, wanted = max(1, seen.vocabulary), seen.words or 0, seen.wanted or 0
    often = survey.filter((F.col("kind") == 1) & (F.col("n") * heavy >= words)).select("key").toArrow()  # at most 2 * heavy: each place is in two grams
    keys = np.sort(often["key"].to_numpy().view(np.uint64))
    counts = [np.zeros(0, np.int64)] * 2
    if len(keys):
        sums = rows.select("target", "text").mapInArrow(_frequent(spark.sparkContext.broadcast(keys)), "key long, n long, t long").groupBy("key").agg(F.sum("n").alias("n"), F.sum("t").alias("t")).toArrow()
        order = np.argsort(sums["key"].to_numpy().view(np.uint64))
        counts = [sums[k].to_numpy()[order] for k in ("n", "t")]
    shards = max(LEAST_SHARDS, -(-words // shard_words))
    dealt = rows.mapInArrow(_deal(spark.sparkContext.broadcast((keys, *counts)), shards, vocabulary), PARTS)
    parts = dealt.repartitionById(shards, F.col("shard")).mapInArrow(_shard(vocabulary), "row long, doc_id long, tokens long, target_loss double, background_loss double")
    summed = parts.groupBy("row", "doc_id").agg(*[F.sum(k).alias(k) for k in ("tokens", "target_loss", "background_loss")])
    mean = [
        F.when(F.col("tokens") > 0, F.col(k) / (F.col("tokens") + 1) + (1 - SHARE) * math.log(n + vocabulary)).otherwise(F.lit(0.0)).alias(k)
        for k, n in (("target_loss", wanted), ("background_loss", words))
    ]
    return summed.select("doc_id", "tokens", *mean).withColumn("score", F.col("target_loss") - F.col("background_loss"))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    found = cross_entropy_difference(docs, labels.filter("quality = 1"))
    return found.select("doc_id", "tokens", *[F.round(k, 6).alias(k) for k in ("target_loss", "background_loss", "score")])


#: DuckDB: the same models, pair by pair.
SQL = r"""
with d as (select row_number() over () as r, doc_id, coalesce(doc_id in (select doc_id from labels where quality = 1 and doc_id is not null), false) as target,
                  list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
     p as (select r, target, case when i = 0 then '' else w[i] end as b, case when i = len(w) then '' else w[i + 1] end as w
           from (select r, target, w, unnest(range(0, len(w) + 1)) as i from d where len(w) > 0)),
     z as (select count(distinct w) as v, count(*) as n, count(*) filter (target) as t from p),
     n as (select b, w, count(*) as n, count(*) filter (target) as t from p group by all),
     c as (select b, sum(n) as n, sum(t) as t from n group by b),
     l as (select n.b, n.w, (ln(c.t + 0.1 * v) - ln(n.t + 0.1) + ln(z.t + v) - ln(u.t + 1)) / 2 as target_loss,
                  (ln(c.n + 0.1 * v) - ln(n.n + 0.1) + ln(z.n + v) - ln(u.n + 1)) / 2 as background_loss from n join c using (b) join c as u on u.b = n.w, z),
     s as (select r, avg(target_loss) as target_loss, avg(background_loss) as background_loss from p join l using (b, w) group by r)
select doc_id, len(w) as tokens, round(coalesce(target_loss, 0), 6) as target_loss, round(coalesce(background_loss, 0), 6) as background_loss,
       round(coalesce(target_loss, 0) - coalesce(background_loss, 0), 6) as score
from d left join s using (r)
"""
