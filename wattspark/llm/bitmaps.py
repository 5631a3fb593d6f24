"""Bounded counters and bitmaps over all rows, merged by block on Spark.

A task gathers positions in a space of ``2**bits`` and hands on one row per block; the blocks are summed
where they meet, one after another, and only the finished space, whose size is fixed, reaches the driver, as a bit or
a byte per position, compressed and a few blocks at a time.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from wattspark.llm.common import U64, mix, settle

#: positions per block row (a power of two), and tasks that merge blocks
BLOCK, MERGERS = 16, 16


def twice(df: DataFrame, positions, bits: int) -> np.ndarray:
    """Packed bitmap of the positions met at least twice over all rows of ``df``. ``positions(batch)`` gives the
    positions of an Arrow batch, with repeats."""
    return _whole(_merged(df, positions, bits, lambda n: np.packbits(n >= 2), most=2), bits, 8)


def levels(df: DataFrame, positions, bits: int) -> np.ndarray:
    """A byte per position: 0 where it was met no more often than chance puts there, then growing with the logarithm of how often."""
    counts = settle(_merged(df, positions, bits, lambda n: n.astype("<i4")), "counts")
    mean = (counts.agg(F.sum("total")).first()[0] or 0) / (1 << bits)
    usual = mean + 4 * np.sqrt(mean) + 3

    def ranked(batches):
        for b in batches:
            n = [np.frombuffer(zlib.decompress(x), "<i4") for x in b.column("bytes").to_pylist()]
            out = [np.where(x > usual, 1 + np.floor(2 * np.log2(np.maximum(x, 1) / usual)), 0).astype(np.uint8) for x in n]
            yield pa.RecordBatch.from_arrays([b.column("block"), pa.array([zlib.compress(x.tobytes(), 1) for x in out], pa.binary())], names=["block", "bytes"])

    return _whole(counts.select("block", "bytes").mapInArrow(ranked, "block int, bytes binary"), bits, 1)


def _whole(blocks: DataFrame, bits: int, per_byte: int) -> np.ndarray:
    """All blocks in one array; positions that no block has are 0."""
    out = np.zeros((1 << bits) // per_byte, dtype=np.uint8)
    for r in blocks.select("block", "bytes").toLocalIterator():
        part = np.frombuffer(zlib.decompress(r.bytes), np.uint8)
        out[r.block * len(part):(r.block + 1) * len(part)] = part
    return out


def _merged(df: DataFrame, positions, bits: int, kept, most: int | None = None) -> DataFrame:
    """``block, total, bytes``: what ``kept`` makes of each block's counts (up to ``most``), compressed, and their sum."""
    blocks = 1 << max(0, bits - BLOCK)
    width = 1 << min(bits, BLOCK)

    def gathered(batches):
        parts, size = [], 0

        def rows():
            at = np.sort(np.concatenate(parts)) if parts else np.zeros(0, np.int64)
            edge = np.searchsorted(at, np.arange(blocks + 1, dtype=np.int64) * width)
            full = np.flatnonzero(np.diff(edge))
            low = (at & (width - 1)).astype("<u2")
            return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([low[edge[k]:edge[k + 1]].tobytes() for k in full.tolist()], pa.binary())], names=["block", "low"])

        for b in batches:
            if b.num_rows:
                parts.append(positions(b).astype(np.int64))
                size += len(parts[-1])
                if size >= 1 << 20:
                    yield rows()
                    parts, size = [], 0
        if parts:
            yield rows()

    def merged(batches):
        have: dict[int, np.ndarray] = {}
        for b in batches:
            for k, low in zip(b.column("block").to_pylist(), b.column("low").to_pylist()):
                n = np.bincount(np.frombuffer(low, "<u2"), minlength=width)
                if k not in have:
                    have[k] = np.zeros(width, dtype=np.int32 if most is None else np.uint8)
                have[k] = have[k] + n.astype(np.int32) if most is None else np.minimum(have[k] + n, most).astype(np.uint8)
        for k, n in have.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([int(n.sum(dtype=np.int64))], pa.int64()), pa.array([zlib.compress(kept(n).tobytes(), 1)], pa.binary())], names=["block", "total", "bytes"])

    return df.mapInArrow(gathered, "block int, low binary").repartition(MERGERS, "block").mapInArrow(merged, "block int, total long, bytes binary")


def bit(bitmap: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the positions are set in a packed bitmap."""
    return bitmap[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1 == 1


def place(hashes: np.ndarray, bits: int, salt: int = 0) -> np.ndarray:
    """Positions of hashes in a space of ``2**bits``."""
    return (mix(hashes.view(U64) + U64(salt)) >> U64(64 - bits)).astype(np.int64)


def filter_of(df: DataFrame, column: str, rows: int, most: int = 27) -> tuple[np.ndarray, int]:
    """A bitmap that has (the places of) all values of a 64-bit column; at most ``2**most`` bits."""
    bits = min(most, max(16, int(rows * 16).bit_length()))

    def twice_over(b):  # met at least twice: each value counts as two
        at = place(b.column(0).to_numpy(zero_copy_only=False), bits)
        return np.concatenate((at, at))

    return twice(df.select(column), twice_over, bits), bits
