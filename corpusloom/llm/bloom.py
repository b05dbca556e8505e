"""Bloom filters over all keys of a table: which hashes occur, and which may occur twice.

Each task keeps two bitmaps of the hashes that it has read, cut into blocks, and sends them when it has read FLUSH hashes;
a block's bitmaps are merged where Spark deals the block to.  Keys and hashes are never shuffled.  A filter has at most
MOST_BITS bits, which is what the driver joins together and the tasks get, whatever the input; beyond that it says yes
more often, and what asks it must be right without it.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame

from corpusloom.llm.common import map_tasks

#: Bits of a block (as a power of two), bits that a hash sets in its block, bits for each key and of a filter at most.
BLOCK, SETS, BITS_A_KEY, MOST_BITS = 19, 3, 12, 1 << 29
#: Hashes that a task holds before it sends its bitmaps.
FLUSH = 1 << 20
_BYTES = (1 << BLOCK) // 8


class Filter:
    """Bits of a number of blocks, a power of two."""

    def __init__(self, blocks: int):
        self.blocks, self.bits = blocks, np.zeros(blocks * _BYTES, np.uint8)

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        """Whether all bits of each hash (uint64) are set: true for every key put in, and by chance for some others."""
        block, places = _places(hashes, self.blocks)
        out = np.ones(len(hashes), bool)
        for p in places:
            at = block * (1 << BLOCK) + p
            out &= (self.bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
        return out


def blocks_for(keys: int) -> int:
    """Blocks of a filter for so many keys at most."""
    want = min(max(1, keys) * BITS_A_KEY, MOST_BITS) >> BLOCK
    return 1 << max(0, min((want - 1).bit_length() if want else 0, (MOST_BITS >> BLOCK).bit_length() - 1))


def _places(hashes: np.ndarray, blocks: int) -> tuple[np.ndarray, list[np.ndarray]]:
    low = np.uint64((1 << BLOCK) - 1)
    a, b = hashes & low, (hashes >> np.uint64(BLOCK)) & low | np.uint64(1)
    block = (hashes >> np.uint64(2 * BLOCK)) & np.uint64(blocks - 1)
    return block.astype(np.int64), [((a + np.uint64(i) * b) & low).astype(np.int64) for i in range(SETS)]


def _bitmaps(hashes: np.ndarray, blocks: int) -> dict[int, bytes]:
    """The blocks that the hashes set bits in."""
    block, places = _places(hashes, blocks)
    order = np.argsort(block, kind="stable")
    block, places = block[order], [p[order] for p in places]
    out, edges = {}, np.flatnonzero(np.diff(block, prepend=-1, append=-1))
    for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist()):
        flags = np.zeros(1 << BLOCK, bool)
        for p in places:
            flags[p[lo:hi]] = True
        out[int(block[lo])] = zlib.compress(np.packbits(flags, bitorder="little").tobytes(), 1)
    return out


def build(df: DataFrame, hashes: Callable[[list[list]], np.ndarray], blocks: int, twice: bool) -> Filter:
    """The filter of all hashes (uint64) that ``hashes(columns)`` gives for batches of ``df``, or, with ``twice``, of those
    that come at least two times.  No rows give an empty filter.
    """

    def local(batches: Iterator[list[list]]) -> Iterator[tuple[list, ...]]:
        held: list[np.ndarray] = []

        def maps() -> tuple[list, ...]:
            found, n = np.unique(np.concatenate(held), return_counts=True)
            once, again = _bitmaps(found, blocks), _bitmaps(found[n > 1], blocks)
            return list(once), list(once.values()), [again.get(b) for b in once]

        for columns in batches:
            held.append(hashes(columns))
            if sum(map(len, held)) >= FLUSH:
                yield maps()
                held = []
        if sum(map(len, held)):
            yield maps()

    def merged(batches: Iterator[list[list]]) -> Iterator[tuple[list, ...]]:
        now, once, again = None, None, None
        for block, first, second in (row for columns in batches for row in zip(*columns, strict=True)):
            if block != now:
                if now is not None:
                    yield [now], [zlib.compress((again if twice else once).tobytes(), 1)]
                now, once, again = block, np.zeros(_BYTES, np.uint8), np.zeros(_BYTES, np.uint8)
            new = np.frombuffer(zlib.decompress(first), np.uint8)
            again |= once & new
            if second is not None:
                again |= np.frombuffer(zlib.decompress(second), np.uint8)
            once |= new
        if now is not None:
            yield [now], [zlib.compress((again if twice else once).tobytes(), 1)]

    parts = map_tasks(df, local, "block int, once binary, again binary").repartition("block").sortWithinPartitions("block")
    out = Filter(blocks)
    for row in map_tasks(parts, merged, "block int, bits binary").collect():  # MOST_BITS at most, compressed
        out.bits[row["block"] * _BYTES : (row["block"] + 1) * _BYTES] = np.frombuffer(zlib.decompress(row["bits"]), np.uint8)
    return out
