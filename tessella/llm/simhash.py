"""SimHash near-duplicates by anchor-point covering (operator 10).

A fingerprint has 64 bits; two link at 3 or fewer differing bits. Such a pair differs in at most one bit in the low or
in the high half. The anchors of a half are a covering code: the Hamming code of length 31 on bits 0 to 30, times the
free bit 31. The code is perfect, so each half lies within the covering radius of 1 of exactly one anchor, its home. A
half that differs in at most one bit (the threshold) lies within 2 of that anchor, so each fingerprint is copied to all
17 anchors within 2 of each of its halves and compared there with the fingerprints whose home the anchor is. No pair is
missed, and 2 x 2^27 anchors keep strangers apart.

An anchor's fingerprints are read as one run of sorted rows and compared in NumPy; it gives links enough to connect
them (a forest), never all pairs. Anchors with very many fingerprints are dealt out over a grid of tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tessella.llm.common import cut, strings, table, words_of
from tessella.llm.components import components

SHINGLE_WORDS = 3
SEED = 42
MAX_BITS = 3
#: Fingerprints of one anchor that one task compares; of more, blocks of this size meet each other in a grid of tasks.
CELL_ROWS = 20_000
CHUNK = 1 << 15


def fingerprint(text: str) -> int:
    """Unsigned 64 bits: a bit is set if it is set in over half the shingles' XXH64. No words: zero."""
    words = words_of(text)
    if not words:
        return 0
    count = max(1, len(words) - SHINGLE_WORDS + 1)
    line = b" ".join(words)
    starts, at = [], 0
    for word in words:
        starts.append(at)
        at += len(word) + 1
    ends = [start + len(word) for start, word in zip(starts, words, strict=True)][min(SHINGLE_WORDS, len(words)) - 1 :]
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for low in range(0, count, CHUNK):
        part = np.array([digest(line[a:b], SEED) for a, b in zip(starts[low : low + CHUNK], ends[low : low + CHUNK], strict=False)], np.uint64)
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > count, bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.fromiter((fingerprint(t) for t in strings(batch.column(0))), np.uint64, batch.num_rows)
        yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(prints.view(np.int64))], [*batch.schema.names[1:], "fp"])


def fingerprints(docs: DataFrame, text: str = "text", *carried: str) -> DataFrame:
    """(doc_id, the carried columns, fp): fp the fingerprint as a signed long. Null and empty texts have 0."""
    rows = docs.select(F.col(text).cast("string").alias("text"), F.col("doc_id").cast("long").alias("doc_id"), *carried)
    return rows.mapInArrow(_fingerprints, StructType([*rows.schema.fields[1:], StructField("fp", LongType())]))


def _syndrome(x: np.ndarray) -> np.ndarray:
    """The XOR of i + 1 over the set bits i < 31: zero for a codeword, else the place of its one wrong bit, plus one."""
    out = np.zeros(x.shape, np.uint64)
    for place in range(5):
        mask = np.uint64(sum(1 << i for i in range(31) if (i + 1) >> place & 1))
        out |= (np.bitwise_count(x & mask).astype(np.uint64) & np.uint64(1)) << np.uint64(place)
    return out


def _home(half: np.ndarray) -> np.ndarray:
    at = _syndrome(half)
    return np.where(at > 0, half ^ (np.uint64(1) << (np.maximum(at, np.uint64(1)) - np.uint64(1))), half)


def anchors_near(half: np.ndarray) -> np.ndarray:
    """For 32-bit halves (n): the anchors within 2 (n, 17), the home first; a codeword has fewer, the home repeated.

    Each is the home of the half itself or of the half with one bit flipped: the code is perfect, so there are no others
    that a half within one bit can have as its home.
    """
    flips = np.concatenate([half[:, None], half[:, None] ^ (np.uint64(1) << np.arange(32, dtype=np.uint64))], axis=1)
    homes = _home(flips)
    first = homes[:, :1].copy()
    rest = np.sort(homes[:, 1:], axis=1)
    fresh = np.ones(rest.shape, bool)
    fresh[:, 1:] = rest[:, 1:] != rest[:, :-1]
    fresh &= rest != first
    rest = np.where(fresh, rest, np.uint64(1 << 40))
    rest.sort(axis=1)
    rest = rest[:, :16]
    return np.concatenate([first, np.where(rest == np.uint64(1 << 40), first, rest)], axis=1)


def _cover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row (anchor, fp, node, home) for each anchor near each half; the half is in the anchor's bit 32."""
    for whole in batches:
        for low in range(0, whole.num_rows, CHUNK):
            batch = whole.slice(low, CHUNK)
            fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for part in (0, 1):
                near = anchors_near((fp >> np.uint64(32 * part)) & np.uint64(0xFFFFFFFF))
                keep = np.ones(near.shape, bool)
                keep[:, 1:] = near[:, 1:] != near[:, :1]
                rows, places = np.nonzero(keep)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array((near[rows, places] | np.uint64(part << 32)).view(np.int64)),
                        pa.array(fp[rows].view(np.int64)),
                        batch.column(1).take(pa.array(rows)),
                        pa.array(places == 0),
                    ],
                    ["anchor", "fp", "node", "home"],
                )


def forest(fp: np.ndarray, node: np.ndarray, home: np.ndarray, other: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that connect what the links (a home, any row of another node) within MAX_BITS connect, one less than nodes.

    ``other``: rows that are compared with the homes only (a block of a grid); by default all rows.
    """
    rows = np.ones(len(fp), bool) if other is None else other
    label, links = np.arange(len(fp)), []
    for i in np.flatnonzero(home):
        apart = rows & (label != label[i])
        if not apart.any():
            continue
        at = np.flatnonzero(apart)
        at = at[np.bitwise_count(fp[at] ^ fp[i]) <= MAX_BITS]
        if len(at):
            _, first = np.unique(label[at], return_index=True)
            links += [(int(node[i]), int(node[j])) for j in at[first]]
            label[np.isin(label, label[at])] = label[i]
    return links


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by cell: the links of each cell, a cell being a run that may span batches."""
    held: list[np.ndarray] = []

    def of(parts: list[np.ndarray], last: bool) -> tuple[list[tuple[int, int]], list[np.ndarray]]:
        rows = np.concatenate(parts) if len(parts) > 1 else parts[0]
        edge = np.flatnonzero((rows["anchor"][1:] != rows["anchor"][:-1]) | (rows["cell"][1:] != rows["cell"][:-1])) + 1
        bounds = np.concatenate([[0], edge, [len(rows)]])
        if not last:
            bounds = bounds[:-1]
        links: list[tuple[int, int]] = []
        homes = np.concatenate([[0], np.cumsum(rows["home"])])
        worth = (bounds[1:] - bounds[:-1] > 1) & (homes[bounds[1:]] > homes[bounds[:-1]])
        for a, b in zip(bounds[:-1][worth], bounds[1:][worth], strict=True):
            links += forest(rows["fp"][a:b], rows["node"][a:b], rows["home"][a:b], rows["other"][a:b])
        return links, [rows[bounds[-1] :].copy()]

    kind = np.dtype([("anchor", np.int64), ("cell", np.int64), ("fp", np.uint64), ("node", np.int64), ("home", bool), ("other", bool)])
    for batch in batches:
        rows = np.empty(batch.num_rows, kind)
        for name in kind.names:
            rows[name] = batch.column(name).to_numpy(zero_copy_only=False)
        if not len(rows):
            continue
        held.append(rows)
        if rows["anchor"][-1] == held[0]["anchor"][0] and rows["cell"][-1] == held[0]["cell"][0]:
            continue  # one cell fills all that is held
        links, held = of(held, last=False)
        if links:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*links, strict=True)], ["a", "b"])
    if held and len(held[0]):
        links, _ = of(held, last=True)
        if links:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*links, strict=True)], ["a", "b"])


def links_of(nodes: DataFrame, cell_rows: int = CELL_ROWS) -> DataFrame:
    """``nodes`` (fp, node), distinct fingerprints: links (a, b) between nodes that connect all within MAX_BITS."""
    covered = cut(nodes.select("fp", "node").mapInArrow(_cover, "anchor long, fp long, node long, home boolean"))
    crowded = cut(covered.groupBy("anchor").agg(F.count("*").alias("rows")).filter(F.col("rows") > cell_rows))
    plain = covered
    parts = []
    if not crowded.isEmpty():
        plain = covered.join(crowded, "anchor", "left_anti")
        side = F.ceil(F.col("rows") / cell_rows).cast("int")
        dealt = covered.join(crowded, "anchor").withColumn("side", side).withColumn("at", F.pmod(F.xxhash64("node"), F.col("side")).cast("int"))
        others = dealt.withColumn("row", F.explode(F.sequence(F.lit(0), F.col("side") - 1))).select(
            "anchor", (F.col("row") * F.col("side") + F.col("at")).cast("long").alias("cell"), "fp", "node", F.lit(False).alias("home"), F.lit(True).alias("other")
        )
        homes = dealt.filter("home").withColumn("col", F.explode(F.sequence(F.lit(0), F.col("side") - 1))).select(
            "anchor", (F.col("at") * F.col("side") + F.col("col")).cast("long").alias("cell"), "fp", "node", F.lit(True).alias("home"), F.lit(False).alias("other")
        )
        parts = [others, homes]
    every = plain.select("anchor", F.lit(0).cast("long").alias("cell"), "fp", "node", "home", F.lit(True).alias("other"))
    for part in parts:
        every = every.unionByName(part)
    return every.repartition("anchor", "cell").sortWithinPartitions("anchor", "cell").mapInArrow(_compare, "a long, b long")


def fingerprint_groups(prints: DataFrame) -> DataFrame:
    """(fp, group) of the fingerprints that have a link: group is the least fingerprint of the component."""
    nodes = cut(prints.select("fp").distinct().withColumn("node", F.col("fp")))
    return components(links_of(nodes)).withColumnsRenamed({"node": "fp", "component": "group"})


def near_duplicates(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 lowercase hex digits), component_id.

    component_id is the smallest doc_id reachable over links of 3 or fewer differing bits, the document's own included.
    Null and empty texts have fingerprint zero, which links like any other. Rows that repeat a doc_id come back as often,
    and link as other rows do. A null doc_id is never a component_id; a row with one gets the component of the rows with
    its fingerprint that have an id, or null if there is none. Texts of any length are read whole. An empty table gives an
    empty result; other columns are ignored.
    """
    prints = cut(fingerprints(docs, text))
    nodes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("node")).filter("node is not null"))
    # One document can have several fingerprints if its id repeats: all of them are the same node and link through it.
    found = components(links_of(nodes).unionAll(_same_id(prints, nodes)))
    home = cut(nodes.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id")))
    return prints.join(home, "fp", "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _same_id(prints: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links between the nodes of fingerprints that share a doc_id."""
    repeated = prints.filter("doc_id is not null").groupBy("doc_id").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).filter("low <> high").select("doc_id")
    return prints.join(repeated, "doc_id").join(nodes, "fp").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
