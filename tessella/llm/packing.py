"""Packing documents into training sequences by best-fit decreasing (operator 6).

Each partition packs its own documents. A document's token ids are cut into full windows first; the rest, shorter than
a window, goes to the open window with the least capacity that still holds it, longest rest first. A segment tree over
capacities finds that window. Documents are taken in buffers of bounded bytes; windows stay open across buffers and
cost a few integers each. At the end of a partition, the least filled windows of the last buffer are taken apart and
their pieces cut to fill the gaps of the others, and what remains becomes sequences of powers of two, so that no
sequence needs padding unless a rest of an earlier buffer is left alone in its window.

Word ids come from the given tokenizer; a word is encoded once per task and remembered within a bound.
"""

from __future__ import annotations

import re
import struct
import unicodedata
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import strings, table

WINDOW = 2048
END_ID = 1
#: Bounds of a worker's memory: words remembered, and bytes of ids held at once.
WORDS_KEPT = 500_000
BUFFER_BYTES = 24 << 20
OUT_ROWS = 20_000
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Capacities:
    """Open windows by remaining capacity; a segment tree tells the least capacity that holds a length."""

    def __init__(self, most: int) -> None:
        self.leaves = 1 << most.bit_length()
        self.tree = bytearray(2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(self.leaves)]

    def add(self, capacity: int, window: int) -> None:
        if not self.open[capacity]:
            at = self.leaves + capacity
            while at and not self.tree[at]:
                self.tree[at] = 1
                at >>= 1
        self.open[capacity].append(window)

    def take(self, length: int) -> tuple[int, int] | None:
        """The tightest window for ``length`` and its capacity, removed; None if none holds it."""
        at, tree = self.leaves + length, self.tree
        if not tree[at]:
            while at > 1 and (at & 1 or not tree[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.leaves:
                at = 2 * at if tree[2 * at] else 2 * at + 1
        capacity = at - self.leaves
        window = self.open[capacity].pop()
        if not self.open[capacity]:
            while at and tree[at] and (at >= self.leaves or not (tree[2 * at] or tree[2 * at + 1])):
                tree[at] = 0
                at >>= 1
        return window, capacity


def _class(kind: str) -> str:
    """A regex class of the characters below U+0250 whose Unicode category starts with ``kind``."""
    return "".join(f"\\u{c:04x}" for c in range(0x250) if unicodedata.category(chr(c))[0] == kind)


def _byte_letters() -> dict[int, str]:
    """The letters that byte-level vocabularies write bytes as: printable Latin-1 itself, the others from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return {b: chr(b if b in plain else next(others)) for b in range(256)}


_FOREIGN = re.compile("[^\\x00-\\x1b\\x20-\\u024f]|<\\|").search


def cut_here(text: str) -> bool:
    """Whether ``encoder`` cuts a text into words itself: it and its lower case have letters below U+0250 alone."""
    return not _FOREIGN(text) and (text.isascii() or not _FOREIGN(text.lower()))


def encoder(path: str) -> Callable[[str], bytes]:
    """Text to its ids as little-endian unsigned 32-bit integers, as the tokenizer at ``path`` gives them without special tokens.

    Texts of Latin letters (``cut_here``) are cut into words and encoded word by word, through a memory; the vocabulary's
    own rules (lower case, no white space, words encoded apart) make that the same. All other texts go to it whole.
    """
    import numpy as np
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    chunks: dict[str, bytes] = {}
    words: dict[str, bytes] = {}
    letters, numbers = _class("L"), _class("N")
    parts = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^{letters}{numbers}]+").findall
    bpe, as_letters = tokenizer.model.tokenize, _byte_letters()

    def word(w: str) -> bytes:
        ids = [x.id for x in bpe(w.encode().decode("latin-1").translate(as_letters))]
        words[w] = out = struct.pack(f"<{len(ids)}I", *ids)
        return out

    def chunk(w: str) -> bytes:
        chunks[w] = out = b"".join([words.get(x) or word(x) for x in parts(w)])
        return out

    def encode(text: str) -> bytes:
        if not cut_here(text):
            return np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if len(chunks) > WORDS_KEPT or len(words) > WORDS_KEPT:
            chunks.clear()
            words.clear()
        found = text.lower().split()
        try:
            return b"".join([chunks[w] for w in found])
        except KeyError:
            return b"".join([chunks.get(w) or chunk(w) for w in found])

    return encode


class Packer:
    """Packs the documents of one partition; ``rows`` are pieces ready to leave."""

    def __init__(self, partition: int, window: int = WINDOW) -> None:
        self.window, self.base, self.made = window, partition << 40, 0
        self.capacities = Capacities(window)
        self.rows: list[tuple] = []
        self.held: list[tuple] = []  # rests of the buffer: doc_id, start, ids, doc_tokens
        self.bytes = 0

    def _new(self) -> int:
        self.made += 1
        return self.base + self.made - 1

    def _row(self, doc: int | None, start: int, ids: bytes, total: int, sequence: int, offset: int) -> None:
        self.rows.append((doc, start, len(ids) // 4, zlib.crc32(ids), total, sequence, offset))

    def add(self, doc: int | None, ids: bytes) -> None:
        total, full = len(ids) // 4, len(ids) // 4 // self.window * self.window
        for start in range(0, full, self.window):
            self._row(doc, start, ids[4 * start : 4 * (start + self.window)], total, self._new(), 0)
        if full < total:
            if self.held and self.bytes + 4 * (total - full) > BUFFER_BYTES:
                self._place(last=False)
            self.held.append((doc, full, ids[4 * full :], total))
            self.bytes += 4 * (total - full)

    def _place(self, last: bool) -> None:
        """Best-fit decreasing over the buffer."""
        own: dict[int, list[tuple]] = {}  # of the last buffer: windows that hold nothing else
        for piece in sorted(self.held, key=lambda p: -len(p[2])):
            length = len(piece[2]) // 4
            window, capacity = self.capacities.take(length) or (self._new(), self.window)
            if capacity > length:
                self.capacities.add(capacity - length, window)
            if last and (window in own or capacity == self.window):
                own.setdefault(window, []).append((*piece, self.window - capacity))
            else:
                self._row(*piece, window, self.window - capacity)
        self.held, self.bytes = [], 0
        if last:
            self._close(own)

    def _close(self, own: dict[int, list[tuple]]) -> None:
        """Fills the gaps of open windows with cut pieces of the least filled windows of the last buffer."""
        gaps = sorted((capacity, window) for capacity, windows in enumerate(self.capacities.open) for window in windows)
        spare: list[tuple] = []
        for capacity, window in gaps:
            need = capacity
            while need:
                while not spare and gaps[-1][1] != window:
                    spare = [p[:4] for p in own.pop(gaps.pop()[1], ())]  # a window without pieces of its own keeps its gap
                if not spare:
                    break
                doc, start, ids, total = spare.pop()
                if len(ids) // 4 > need:
                    spare.append((doc, start + need, ids[4 * need :], total))
                    ids = ids[: 4 * need]
                self._row(doc, start, ids, total, window, self.window - need)
                need -= len(ids) // 4
            if gaps[-1][1] == window:
                spare += [p[:4] for p in own.pop(window, ())] if need == capacity else []
                break
        for window, pieces in own.items():
            for *piece, offset in pieces:
                self._row(*piece, window, offset)
        rest = sum(len(p[2]) for p in spare) // 4
        while rest:
            need, sequence, offset = 1 << (rest.bit_length() - 1), self._new(), 0
            rest -= need
            while offset < need:
                doc, start, ids, total = spare.pop()
                if len(ids) // 4 > need - offset:
                    room = need - offset
                    spare.append((doc, start + room, ids[4 * room :], total))
                    ids = ids[: 4 * room]
                self._row(doc, start, ids, total, sequence, offset)
                offset += len(ids) // 4

    def end(self) -> None:
        self._place(last=True)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*rows, strict=True) if rows else [[]] * len(names))], names)


def pack(docs: DataFrame, tokenizer_path: str | None = None, text: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document's ids are those of its text (null: empty) and then END_ID; each lies in exactly one piece. Texts of any
    length are encoded whole. Offsets in a sequence are gapless from 0. Rows that repeat a doc_id are packed each for
    itself; a null doc_id stays null. Of rests of one length the one read first is placed first. An empty table gives an
    empty result; other columns are ignored. Sequence ids are unique, not consecutive.
    """
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path("word_bpe_49k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(tokenizer_path), END_ID.to_bytes(4, "little")
        packer = Packer(TaskContext.get().partitionId(), window)
        for batch in batches:
            for doc, value in zip(batch.column(0).to_pylist(), strings(batch.column(1)), strict=True):
                packer.add(doc, encode(value) + end)
                if len(packer.rows) >= OUT_ROWS:
                    yield _batch(packer.rows)
                    packer.rows = []
        packer.end()
        yield _batch(packer.rows)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, SCHEMA)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
