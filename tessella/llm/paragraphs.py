"""Substring dedup by paragraph MinHash banding (operator 1).

A paragraph is a stretch of words, of one of two kinds that are never compared with each other:

* line: a line of at least LEAST_WORDS words;
* passage: UNIT_WORDS words in a row, whatever lines they lie in. Their beginnings are the places where the hash of the
  UNIT_WORDS words is the least of UNIT_PLACES neighbours (winnowing). Two texts that share UNIT_WORDS + UNIT_PLACES - 1
  = 50 words in a row, whatever surrounds them, share such a stretch.

Equal paragraphs (ASCII lower-cased words) are one class. Every class has a MinHash signature of its five-word shingles,
cut into bands of ROWS values. Classes that meet in a band are joined with their shingles and verified by the exact
Jaccard similarity, and the components of the links are the clusters. In a cluster the first paragraph stays.

Texts are read in blocks of bytes by NumPy, cheaply enough to be read again for each step: first for the bands (a class
once a block), then for the classes' copies and first places, then for the shingles of classes that met, last for the
rows. A bucket's members are dealt out by blocks of BUCKET_ROWS, each pair of blocks to a cell, so that no task compares
a large bucket alone. Within a cell similar members join one group: many near copies cost each a few comparisons and
give a link each, not all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.llm.blocks import STEP, Powers, Words, blocks, sums_of
from tessella.llm.common import bounded_broadcast, cut, mix64, release, table
from tessella.llm.components import components

LEAST_WORDS = 20
SHINGLE_WORDS = 5
SIMILARITY = 0.8
#: Values of a band, and bands of lines and of passages. 1 - (1 - 0.8 ** 3) ** 8 = 0.997 for lines at the threshold. The
#: most that passages can differ in and be similar is one of 16 shingles each, 15 / 17: 1 - (1 - 0.88 ** 3) ** 4 = 0.990.
ROWS, LINE_BANDS, PASSAGE_BANDS = 3, 8, 4
#: Words of a passage, and the places among which the least hash chooses its beginning.
UNIT_WORDS, UNIT_PLACES = 20, 31
#: Passages that begin within so many words of the one before are similar to it by their overlap: they have no bands.
NEAR_WORDS = 2
#: Members of one block of a bucket.
BUCKET_ROWS = 250
#: Rows that may be broadcast; beyond that the join is shuffled. So low that a tenth of a GB shuffles as a TB does.
BROADCAST_ROWS = 100_000
SEEDS = mix64(np.arange(1, LINE_BANDS * ROWS + 1, dtype=np.uint64) * STEP)
_END = np.uint64(2**64 - 1)


def _spread_out(at: np.ndarray) -> np.ndarray:
    """Marks places more than NEAR_WORDS after the last that is marked."""
    marked = np.ones(len(at), bool)
    last = 0
    for i in (np.flatnonzero(np.diff(at) <= NEAR_WORDS) + 1).tolist():
        last = at[i - 1] if marked[i - 1] else last
        marked[i] = at[i] - last > NEAR_WORDS
    return marked


class Block:
    """The paragraphs of some texts: lines first, then passages. ``edges`` are the texts' bounds among the bytes ``x``.

    ``first`` and ``last`` (exclusive) are a paragraph's words, ``doc`` its text, ``keys`` its class.
    """

    def __init__(self, x: np.ndarray, edges: np.ndarray, powers: Powers, least_words: int = LEAST_WORDS) -> None:
        words = Words(x, edges, powers)
        self.x, self.edges, self.begin, self.end, h, owner = x, edges, words.begin, words.end, words.hashes, words.owner
        sums = sums_of(h, powers)
        self.breaks = np.flatnonzero(x == 10)
        line = np.searchsorted(self.breaks, self.begin)
        turn = np.flatnonzero(np.concatenate([[True], (line[1:] != line[:-1]) | (owner[1:] != owner[:-1])])) if len(h) else np.zeros(0, np.int64)
        first, last = turn, np.append(turn[1:], len(h))
        long = last - first >= least_words
        first, last = first[long], last[long]
        keys = mix64((sums[last] - sums[first]) * powers.down[first])
        at, places = np.zeros(0, np.int64), len(h) - UNIT_WORDS + 1
        if places >= UNIT_PLACES:
            each = mix64((sums[UNIT_WORDS:] - sums[:-UNIT_WORDS]) * powers.down[:places] + STEP)
            least = np.lib.stride_tricks.sliding_window_view(each, UNIT_PLACES).argmin(axis=1) + np.arange(places - UNIT_PLACES + 1)
            at = np.unique(least[owner[: len(least)] == owner[UNIT_WORDS + UNIT_PLACES - 2 :]])  # windows within one text
            keys = np.concatenate([keys, each[at]])
        self.lines, self.keys = len(first), keys
        self.first, self.last = np.concatenate([first, at]), np.concatenate([last, at + UNIT_WORDS])
        self.passage = np.arange(len(keys)) >= self.lines
        self.banded = np.concatenate([np.ones(self.lines, bool), _spread_out(at)])
        self.doc, self.line = owner[self.first], line[self.first]
        s = h[: max(0, len(h) - SHINGLE_WORDS + 1)].copy()
        for k in range(1, SHINGLE_WORDS):
            s += h[k : len(s) + k] * powers.up[k]
        self.shingles = mix64(s)

    def bands(self) -> tuple[np.ndarray, np.ndarray]:
        """(bucket, key) of each class here, once for each of its bands; buckets of lines and of passages differ."""
        classes = np.unique(self.keys[self.banded], return_index=True)[1]
        own = np.flatnonzero(self.banded)[np.sort(classes)]  # in the order of the text: the stretches between stay short
        kinds, found = self.passage[own], []
        x = np.append(self.shingles, _END)  # closes the last stretch
        # every other stretch of reduceat is a paragraph's
        at = np.stack([self.first[own], self.last[own] - SHINGLE_WORDS + 1], 1).reshape(-1)
        for band in range(LINE_BANDS):
            if band == PASSAGE_BANDS:  # the others are of lines alone
                own, at, kinds = own[~kinds], at.reshape(-1, 2)[~kinds].reshape(-1), kinds[~kinds]
            if not len(own):
                break
            key = (kinds.astype(np.uint64) * np.uint64(LINE_BANDS) + np.uint64(band + 1)) * STEP
            for row in range(ROWS):
                y = (x ^ SEEDS[band * ROWS + row]) * np.uint64(0xFF51AFD7ED558CCD)
                y ^= y >> np.uint64(32)
                y[-1] = _END
                key = mix64(key * STEP ^ np.minimum.reduceat(y, at)[::2])
            found.append((key, self.keys[own]))
        return tuple(np.concatenate(part) for part in zip(*found, strict=True)) if found else (np.zeros(0, np.uint64),) * 2

    def places(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Line in its text, start and length in code points: of passages their words', of lines the whole line's."""
        low, high = self.begin[self.first], self.end[self.last - 1]
        start = self.edges[self.doc]
        lines, n = self.line[: self.lines], self.lines
        bounds = np.concatenate([[-1], self.breaks, [len(self.x)]])
        low[:n], high[:n] = np.maximum(bounds[lines] + 1, start[:n]), np.minimum(bounds[lines + 1], self.edges[self.doc[:n] + 1])
        para = self.line - np.searchsorted(self.breaks, start)
        if (self.x >= 128).any():
            points = np.concatenate([[0], np.cumsum((self.x & 0xC0) != 0x80)])
            low, high, start = points[low], points[high], points[start]
        return para, low - start, high - low


def paragraphs(column: pa.Array, powers: Powers, least_words: int) -> Iterator[tuple[int, Block]]:
    """The texts of an Arrow string column block by block, with the number of each block's first text."""
    for low, x, edges in blocks(column):
        yield low, Block(x, edges, powers, least_words)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _buckets(least_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            for _, block in paragraphs(batch.column(0), powers, least_words):
                buckets, keys = block.bands()
                yield pa.RecordBatch.from_arrays([_signed(buckets), _signed(keys)], ["bucket", "key"])

    return run


def _firsts(least_words: int):
    """(key, copies, none, doc_id, tid, start) of each class of a block: how often it is there, and its first place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            none = batch.column(0).is_null().to_numpy(zero_copy_only=False)
            doc_id = batch.column(0).fill_null(0).to_numpy()
            tid = batch.column(1).to_numpy()
            for low, block in paragraphs(batch.column(2), powers, least_words):
                doc, start = low + block.doc, block.places()[1]
                order = np.lexsort((start, tid[doc], doc_id[doc], none[doc], block.keys))
                keys = block.keys[order]
                at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
                own = doc[order][at]
                columns = [_signed(keys[at]), np.diff(np.append(at, len(keys))), none[own], pa.array(doc_id[own], mask=none[own]), tid[own], start[order][at]]
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns], ["key", "copies", "none", "doc_id", "tid", "start"])

    return run


def _pieces(least_words: int):
    """Every paragraph: doc_id, tid, passage, para, start, length, key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            for low, block in paragraphs(batch.column(2), powers, least_words):
                own = pa.array(low + block.doc)
                columns = [batch.column(0).take(own), batch.column(1).take(own), pa.array(block.passage), *map(pa.array, block.places()), _signed(block.keys)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "tid", "passage", "para", "start", "length", "key"])

    return run


def _shingles(least_words: int):
    """(key, shingles) of the wanted paragraphs of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            wanted = batch.column(0)
            for low, block in paragraphs(batch.column(1), powers, least_words):
                own = np.unique(wanted.slice(low, len(block.edges) - 1).flatten().to_numpy()).view(np.uint64)
                keys, at = np.unique(block.keys, return_index=True)
                at = at[np.isin(keys, own)]
                if len(at):
                    sets = [np.unique(block.shingles[a : b - SHINGLE_WORDS + 1]) for a, b in zip(block.first[at].tolist(), block.last[at].tolist(), strict=True)]
                    offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([_signed(block.keys[at]), pa.ListArray.from_arrays(pa.array(offsets), _signed(np.concatenate(sets)))], ["key", "shingles"])

    return run


def similar(a: set, b: set, similarity: float) -> bool:
    """Whether the Jaccard similarity of two sets is at least ``similarity``."""
    less, more = (a, b) if len(a) <= len(b) else (b, a)
    if len(less) < similarity * len(more):
        return False
    both = len(less & more)
    return both >= similarity * (len(a) + len(b) - both)


def bucket_links(nodes: list[int], sets: list[set], similarity: float, mine: list[bool] | None = None, theirs: list[bool] | None = None) -> list[tuple[int, int]]:
    """Links that connect what the similar pairs connect. ``mine`` and ``theirs``: only pairs with one of each are due."""
    groups: list[list[int]] = []
    links = []
    for i in range(len(nodes)):
        joined: list[int] = []
        for g, members in enumerate(groups):
            for j in members:
                if (mine is None or (mine[i] and theirs[j]) or (mine[j] and theirs[i])) and similar(sets[i], sets[j], similarity):
                    links.append((nodes[i], nodes[j]))
                    joined.append(g)
                    break
        if joined:
            groups[joined[0]].append(i)
            for g in reversed(joined[1:]):
                groups[joined[0]] += groups.pop(g)
        else:
            groups.append([i])
    return links


def _verify(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, nodes, sets, mine, theirs = None, [], [], [], []

        def done() -> Iterator[pa.RecordBatch]:
            links = bucket_links(nodes, sets, similarity, mine, theirs) if len(nodes) > 1 else []
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*links, strict=True)], ["a", "b"])

        for batch in batches:
            for at, cell, node, m, t, value in zip(*(batch.column(c).to_pylist() for c in range(5)), batch.column(5), strict=True):
                if (at, cell) != key:
                    yield from done()
                    key, nodes, sets, mine, theirs = (at, cell), [], [], [], []
                if nodes and nodes[-1] == node:  # of a text that is there twice
                    continue
                nodes.append(node)
                sets.append(set(value.values.to_numpy().tolist()))
                mine.append(m)
                theirs.append(t)
        yield from done()

    return run


def _links(members: DataFrame, shingles: DataFrame, similarity: float, bucket_rows: int, broadcast_rows: int) -> DataFrame:
    """(a, b) keys of similar classes. ``members`` (bucket, key) of buckets that hold two classes or more."""
    # Buckets with the same members need one look: as many of them, the same least, greatest and XOR of hashes.
    same = members.groupBy("bucket").agg(F.count("*").alias("members"), F.min("key").alias("low"), F.max("key").alias("high"), F.bit_xor(F.xxhash64("key")).alias("mark"))
    same = cut(same.groupBy("members", "low", "high", "mark").agg(F.min("bucket").alias("bucket")).select("bucket", F.ceil(F.col("members") / bucket_rows).cast("int").alias("side")))
    dealt = members.join(bounded_broadcast(same, same.count(), broadcast_rows), "bucket").withColumn("at", F.pmod(F.xxhash64("key"), F.col("side")).cast("int"))
    # block i meets block k in the cell (lesser, greater); the lesser's members are "mine"
    cells = dealt.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("side") - 1)))
    cells = cells.select("bucket", (F.least("at", "k") * F.col("side") + F.greatest("at", "k")).alias("cell"), "key", (F.col("at") <= F.col("k")).alias("mine"), (F.col("at") >= F.col("k")).alias("theirs"))
    rows = cells.join(shingles, "key").select("bucket", "cell", "key", "mine", "theirs", "shingles")
    return rows.repartition("bucket", "cell").sortWithinPartitions("bucket", "cell", "key").mapInArrow(_verify(similarity), "a long, b long")


def similar_paragraphs(
    docs: DataFrame, text: str = "text", least_words: int = LEAST_WORDS, similarity: float = SIMILARITY, bucket_rows: int = BUCKET_ROWS, broadcast_rows: int = BROADCAST_ROWS
) -> DataFrame:
    """One row per paragraph that is in a cluster of two or more: doc_id, unit (line or passage), para, start, length,
    class_id, cluster_id, copies, links, kept.

    ``para`` is the line, from 0, that the paragraph is or begins in; start and length are in code points. Equal
    paragraphs share class_id, linked ones cluster_id; ``copies`` is the number of paragraphs of the class, ``links`` 1
    if another class is in the cluster. One paragraph of a cluster is kept, the first by (doc_id, text, place); rows that
    repeat a doc_id and its text count each for itself and are kept or not alike. A paragraph that repeats within one
    document counts like any other, and so do the overlapping passages of a text that repeats itself word for word. Null
    and empty texts have none; texts of any length are read whole. Rows with a null doc_id take part and never are the
    one kept unless all are. An empty table gives an empty result; other columns are ignored. Words, classes and shingles
    are told apart by 64-bit hashes.
    """
    t = F.col(text).cast("string")  # tid tells rows of one doc_id apart
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.hash(t).alias("tid"), F.coalesce(t, F.lit("")).alias("text"))
    bands = own.select("text").mapInArrow(_buckets(least_words), "bucket long, key long").repartition("bucket")
    same = Window.partitionBy("bucket")
    mixed = bands.withColumn("low", F.min("key").over(same)).withColumn("high", F.max("key").over(same)).filter("low <> high")
    members = cut(mixed.select("bucket", "key").distinct())
    del bands, mixed
    release(docs.sparkSession)
    firsts = own.mapInArrow(_firsts(least_words), "key long, copies long, none boolean, doc_id long, tid int, start long")
    firsts = firsts.select("key", "copies", F.struct("none", "doc_id", "tid", "start").alias("first"), F.lit(0).alias("met"))
    met = members.select("key").distinct().select("key", F.lit(0).cast("long").alias("copies"), F.lit(None).cast("struct<none:boolean,doc_id:bigint,tid:int,start:bigint>").alias("first"), F.lit(1).alias("met"))
    classes = firsts.unionAll(met).groupBy("key").agg(F.sum("copies").alias("copies"), F.min("first").alias("first"), F.max("met").alias("met"))
    classes = cut(classes.filter("copies > 1 or met = 1"))
    del firsts, met
    release(docs.sparkSession)
    # The shingles of classes that met are made again from the text of each one's first place.
    wanted = classes.filter("met = 1").groupBy(F.col("first.tid").alias("tid"), F.col("first.doc_id").alias("only")).agg(F.collect_list("key").alias("wanted"))
    wanted = bounded_broadcast(cut(wanted), classes.filter("met = 1").count(), broadcast_rows)
    texts = own.join(wanted, (own["tid"] == wanted["tid"]) & own["doc_id"].eqNullSafe(wanted["only"])).select("wanted", "text")
    shingles = texts.mapInArrow(_shingles(least_words), "key long, shingles array<long>")
    found = cut(components(_links(members, shingles, similarity, bucket_rows, broadcast_rows)).withColumnRenamed("node", "key"))
    del wanted, texts, shingles, members
    clusters = cut(classes.join(found, "key", "left").filter("copies > 1 or component is not null").select("key", "copies", "first", F.coalesce("component", "key").alias("cluster_id"), F.col("component").isNotNull().cast("long").alias("links")))
    heads = cut(clusters.groupBy("cluster_id").agg(F.min("first").alias("head")).select("cluster_id", F.col("head.doc_id").alias("head_id"), F.col("head.tid").alias("head_tid"), F.col("head.start").alias("head_start")))
    clusters = cut(clusters.drop("first").join(bounded_broadcast(heads, heads.count(), broadcast_rows), "cluster_id"))
    release(docs.sparkSession)
    pieces = own.mapInArrow(_pieces(least_words), "doc_id long, tid int, passage boolean, para long, start long, length long, key long")
    out = pieces.join(bounded_broadcast(clusters, clusters.count(), broadcast_rows), "key")
    kept = F.col("doc_id").eqNullSafe(F.col("head_id")) & (F.col("tid") == F.col("head_tid")) & (F.col("start") == F.col("head_start"))
    return out.select("doc_id", F.when(F.col("passage"), "passage").otherwise("line").alias("unit"), "para", "start", "length", F.col("key").alias("class_id"), "cluster_id", "copies", "links", kept.alias("kept"))


def op1_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_paragraphs(table(spark, sf_dir, "documents"))
