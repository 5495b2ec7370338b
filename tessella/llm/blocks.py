"""Words of many texts at once: Arrow string columns are read in blocks of bytes by NumPy, no text becomes a Python string."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from tessella.llm.common import mix64

#: Bytes of text that are read at once; a longer text is a block of its own.
BLOCK_BYTES = 1 << 18
#: Texts of a block, at most.
MOST_TEXTS = 1 << 15
STEP = np.uint64(0x9E3779B97F4A7C15)


class Powers:
    """Powers of an odd number and of its inverse, modulo 2 ** 64, as far as a block needs them; a hash for each byte."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)
        low = np.arange(256)
        low[65:91] += 32  # ASCII lower case
        self.bytes = mix64((low + 1).astype(np.uint64) * STEP)
        self.blank = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])

    def reach(self, n: int) -> None:
        if len(self.up) <= n:
            size = n + n // 4 + 1024
            both = [np.full(size, x, np.uint64) for x in (int(STEP), pow(int(STEP), -1, 1 << 64))]
            for x in both:
                x[0] = 1
            self.up, self.down = (np.cumprod(x) for x in both)


def sums_of(x: np.ndarray, powers: Powers) -> np.ndarray:
    """Prefix sums of which the hash of a stretch is a difference, times ``powers.down`` of its first place."""
    sums = np.zeros(len(x) + 1, np.uint64)
    np.cumsum(x * powers.up[: len(x)], out=sums[1:])
    return sums


class Words:
    """The words of some texts, ASCII lower-cased, between ASCII white space. ``edges`` are the texts' bounds among the
    bytes ``x``; ``begin`` and ``end`` (exclusive) are a word's bytes, ``owner`` its text, ``hashes`` 64 bits of it."""

    def __init__(self, x: np.ndarray, edges: np.ndarray, powers: Powers) -> None:
        self.x, self.edges = x, edges
        powers.reach(len(x) + 1)
        blank = powers.blank[x]
        before, after = np.ones(len(x), bool), np.ones(len(x), bool)
        before[1:], after[:-1] = blank[:-1], blank[1:]
        inner = edges[(edges > 0) & (edges < len(x))]
        before[inner] = after[inner - 1] = True
        self.begin, self.end = np.flatnonzero(~blank & before), np.flatnonzero(~blank & after) + 1
        sums = sums_of(powers.bytes[x], powers)
        self.hashes = mix64((sums[self.end] - sums[self.begin]) * powers.down[self.begin])
        self.owner = np.searchsorted(edges, self.begin, "right") - 1


def blocks(column: pa.Array, size: int = BLOCK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The texts of an Arrow string column without nulls block by block: the number of the block's first text, the bytes, the
    texts' bounds among them."""
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    edges = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    low = 0
    while low < len(column):
        high = min(max(low + 1, int(np.searchsorted(edges, edges[low] + size, "right")) - 1), low + MOST_TEXTS)
        yield low, data[edges[low] : edges[high]], edges[low : high + 1] - edges[low]
        low = high
