"""Benchmark decontamination (operator 6): SimHash of item-sized windows.

Words are compared without ASCII case and punctuation. A document's windows have as many 5-word
shingles as the item; each window and item has a 64-bit SimHash over its numbered shingles: the second
occurrence of a shingle is an element of its own, so that weighted similarity is that of plain sets. A
multi-index finds the items near a window's fingerprint: of eight 8-bit blocks, two fingerprints within
``RADIUS`` bits differ in some block by at most three bits (8 blocks of 4 differing bits would be 32),
so looking up every block value within three bits misses none of them. The weighted Jaccard
similarity of the shingles, at least 0.8, then decides.

A similarity above 0 needs a common shingle, so only windows that hold a shingle of their item are
fingerprinted, and only items that share a shingle with the text are looked up: no other pair could be
verified. A document shorter than the item is one window.

Items are read in blocks of bounded number and size, each against all documents, so the broadcast
block does not grow with the benchmark.

Defined results: null and empty texts match nothing; items with fewer than five words have one
shingle, the whole sequence; equal rows give equal rows; empty tables give empty results; extra
columns are not read (``remove`` passes them through).
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from wattspark.llm.common import U64, Words, as_bytes, mix, pieces, shingles, with_columns

SIZE = 5
#: Hamming radius within which fingerprints are candidates; sets of numbered shingles with a Jaccard
#: similarity of 0.8 differ by 9.7 bits on average, with a standard deviation of 2.9 (12 and 3.1 for sets of
#: four and five), so that a pair right at 0.8 lies outside the radius less than once in ten million times
RADIUS = 31
#: what two fingerprints within the radius differ by in at least one of the eight blocks, at most
BLOCK_RADIUS = RADIUS // 8
BLOCK_ITEMS, BLOCK_BYTES = 4096, 4 << 20
_BITS = np.array([bin(v).count("1") for v in range(256)], dtype=np.uint8)


def _votes(hashes: np.ndarray) -> np.ndarray:
    """+1 or -1 for each of the 64 bits of each shingle hash."""
    bits = np.unpackbits(np.ascontiguousarray(hashes.astype("<u8")).view(np.uint8).reshape(-1, 8), axis=1)
    return bits.astype(np.int32) * 2 - 1


def _numbered(hashes: np.ndarray, nth: np.ndarray) -> np.ndarray:
    """Hashes of the elements "``nth`` occurrence of this shingle"; a first one is the shingle itself."""
    return np.where(nth > 1, mix(hashes + nth.astype(U64) * U64(0x9E3779B97F4A7C15)), hashes)


class Occurrences:
    """How often the shingle at a position occurs in stretches that begin or end there."""

    def __init__(self, hashes: np.ndarray):
        self.size = len(hashes)
        same = np.unique(hashes, return_inverse=True)[1].astype(np.int64)
        key = same * (self.size + 1) + np.arange(self.size)
        order = np.argsort(key)
        self.key, self.base = key[order], same * (self.size + 1)
        self.rank = np.empty(self.size, dtype=np.int64)
        self.rank[order] = np.arange(self.size)

    def since(self, first: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of the shingle at ``at`` in ``first .. at``, both included."""
        return self.rank[at] - np.searchsorted(self.key, self.base[at] + first) + 1

    def until(self, at: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Occurrences of the shingle at ``at`` in ``at .. end``, ``end`` excluded."""
        return np.searchsorted(self.key, self.base[at] + end) - self.rank[at]


def _bag_votes(hashes: np.ndarray, nth: np.ndarray) -> np.ndarray:
    """Votes of the numbered shingles, summed in bounded slices."""
    total = np.zeros(64, dtype=np.int32)
    for lo in range(0, len(hashes), 8192):
        total += _votes(_numbered(hashes[lo:lo + 8192], nth[lo:lo + 8192])).sum(axis=0, dtype=np.int32)
    return total


def _window_sums(hashes: np.ndarray, n: int) -> np.ndarray:
    """Sums of votes of every window of ``n`` of the hashes: a window differs from the one before it by the
    last occurrence of the shingle that leaves and the next one of the shingle that enters."""
    seen, steps = Occurrences(hashes), np.arange(len(hashes) - n)
    head = np.arange(n)
    out = np.empty((len(steps) + 1, 64), dtype=np.int32)
    out[0] = _bag_votes(hashes[:n], seen.since(np.zeros(n, dtype=np.int64), head))
    leaves = _numbered(hashes[steps], seen.until(steps, steps + n))
    enters = _numbered(hashes[steps + n], seen.since(steps + 1, steps + n))
    out[1:] = _votes(enters) - _votes(leaves)
    return np.cumsum(out, axis=0, out=out)


def _sign(sums: np.ndarray) -> np.ndarray:
    """Fingerprints, as 8 bytes a row."""
    return np.packbits(sums > 0, axis=1)


def _short(words: Words, lo: int, n: int) -> np.ndarray:
    h = words.hash[lo]
    for k in range(1, n):
        h = h * U64(0xD6E8FEB86659FD93) + words.hash[lo + k]
    return mix(np.array([h], dtype=U64) + U64(n))


class Items:
    """A block of the benchmark: shingles, fingerprints and the multi-index."""

    def __init__(self, rows: list[tuple[int, str]]):
        self.ids = [i for i, _ in rows]
        words = Words([(t or "").encode() for _, t in rows], lower=True, marks=True)
        at, h = shingles(words, SIZE)
        doc = words.doc[at]
        n_words = np.diff(words.first)
        self.bags: list[np.ndarray] = []
        self.short: dict[int, dict[int, list[int]]] = {}  # number of words -> shingle -> items
        for k in range(len(rows)):
            n = int(n_words[k])
            if 0 < n < SIZE:
                self.short.setdefault(n, {}).setdefault(int(_short(words, int(words.first[k]), n)[0]), []).append(k)
            self.bags.append(h[doc == k])
        self.counts = [Counter(b.tolist()) for b in self.bags]
        self.size = np.array([len(b) for b in self.bags], dtype=np.int64)
        self.prints = np.stack([_sign(_window_sums(b, len(b)))[0] if len(b) else np.zeros(8, np.uint8) for b in self.bags]) if rows else np.zeros((0, 8), np.uint8)
        # block value -> items of which that block is near
        values = np.arange(256, dtype=np.uint8)
        self.near = [_BITS[values[:, None] ^ self.prints[None, :, b]] <= BLOCK_RADIUS for b in range(8)]
        pairs = sorted({(int(x), k) for k, b in enumerate(self.bags) for x in b.tolist()})
        self.keys = np.array(sorted({x for x, _ in pairs}), dtype=U64)
        self.of: dict[int, list[int]] = {}
        for x, k in pairs:
            self.of.setdefault(x, []).append(k)
        self.maybe = np.zeros(1 << 16, dtype=bool)
        self.maybe[(self.keys >> U64(48)).astype(np.int64)] = True

    def known(self, h: np.ndarray) -> np.ndarray:
        """Positions of hashes that are shingles of some item."""
        at = np.flatnonzero(self.maybe[(h >> U64(48)).astype(np.int64)])
        if not len(self.keys):
            return at[:0]
        found = np.minimum(np.searchsorted(self.keys, h[at]), len(self.keys) - 1)
        return at[self.keys[found] == h[at]]

    def matches(self, texts: list[bytes], least: float):
        """(text, item, similarity, bits apart, first word of the window, words) of the best window of each match."""
        words = Words(texts, lower=True, marks=True)
        at, h = shingles(words, SIZE)
        hits = self.known(h)
        if len(hits):
            owner = words.doc[at]
            edge = np.searchsorted(owner, np.arange(len(texts) + 1))
            groups = np.flatnonzero(np.append(True, np.diff(owner[hits]) != 0))
            for lo, hi in zip(groups.tolist(), [*groups[1:].tolist(), len(hits)]):
                text = int(owner[hits[lo]])
                yield from self._windows(text, h, int(edge[text]), int(edge[text + 1]), hits[lo:hi], at - words.first[owner], least)
        for n, table in self.short.items():
            for text in np.flatnonzero(np.diff(words.first) >= n).tolist():
                lo, hi = int(words.first[text]), int(words.first[text + 1])
                run = words.hash[lo:hi - n + 1]
                for k in range(1, n):
                    run = run * U64(0xD6E8FEB86659FD93) + words.hash[lo + k:hi - n + 1 + k]
                seen = set()
                for p, x in enumerate(mix(run + U64(n)).tolist()):
                    for k in table.get(x, ()):
                        if k not in seen:
                            seen.add(k)
                            yield text, self.ids[k], 1.0, 0, p, n

    def _windows(self, text, h, lo, hi, hits, word, least):
        by_item: dict[int, list[int]] = {}
        for p in hits.tolist():
            for k in self.of[int(h[p])]:
                by_item.setdefault(k, []).append(p)
        by_size: dict[int, list[int]] = {}
        for k in sorted(by_item):
            by_size.setdefault(int(self.size[k]), []).append(k)
        best: dict[int, tuple] = {}
        for size, own in by_size.items():
            n = min(size, hi - lo)
            at_item = [np.array(by_item[k]) for k in own]
            p = np.unique(np.concatenate(at_item))
            # starts of the windows of n shingles that hold one of the hits
            mark = np.zeros(hi - lo + 2, dtype=np.int64)
            np.add.at(mark, np.maximum(p - n + 1, lo) - lo, 1)
            np.add.at(mark, np.minimum(p, hi - n) + 1 - lo, -1)
            starts = np.flatnonzero(np.cumsum(mark) > 0) + lo
            for run in np.split(starts, np.flatnonzero(np.diff(starts) > n) + 1):
                for at in range(0, len(run), 4096):
                    part = run[at:at + 4096]
                    prints = _sign(_window_sums(h[int(part[0]):int(part[-1]) + n], n)[part - part[0]])
                    near = np.zeros((len(part), len(own)), dtype=bool)
                    for b in range(8):
                        near |= self.near[b][:, own][prints[:, b]]
                    for j, k in enumerate(own):
                        bits = _BITS[prints ^ self.prints[k]].sum(axis=1)
                        # no more shingles can be shared than stand in the window
                        most = np.searchsorted(at_item[j], part + n) - np.searchsorted(at_item[j], part)
                        close = near[:, j] & (bits <= RADIUS) & (most * (1 + least) >= least * (n + size) - 1e-6)
                        for i in np.flatnonzero(close).tolist():
                            if k in best and best[k][0] == 1.0:
                                break
                            start = int(part[i])
                            bag, other = Counter(h[start:start + n].tolist()), self.counts[k]
                            both = sum(min(c, other[x]) for x, c in bag.items() if x in other)
                            similarity = both / (n + size - both)
                            if similarity >= least and (k not in best or similarity > best[k][0]):
                                best[k] = (similarity, int(bits[i]), int(word[start]), n + SIZE - 1)
        for k, found in sorted(best.items()):
            yield text, self.ids[k], *found


def blocks(benchmark: DataFrame):
    """The benchmark's rows in blocks of bounded number and size (by a hash of the id)."""
    rows = benchmark.select(F.col("item_id").alias("item_id"), F.col("text").alias("text"))
    n, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    parts = max(1, -(-n // BLOCK_ITEMS), -(-size // BLOCK_BYTES))
    for b in range(parts):
        yield sorted(((r.item_id, r.text) for r in rows.where(F.pmod(F.coalesce(F.xxhash64("item_id"), F.lit(0)), F.lit(parts)) == b).collect()), key=lambda r: (r[0] is None, r[0], r[1] or ""))


def find(docs: DataFrame, benchmark: DataFrame, least: float = 0.8) -> DataFrame:
    """``doc_id, item_id, similarity, bits, first_word, n_words``: the best window of each matching pair."""
    src = with_columns(docs, doc_id=F.col("doc_id"), text=F.col("text"))
    item_type = to_arrow_type(benchmark.schema["item_id"].dataType)
    kinds = [src.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()]
    out = None
    for rows in blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(rows)

        def matched(batches, shared=shared):
            items = Items(shared.value)
            for b in pieces(batches, 4 << 20):
                found = list(items.matches(as_bytes(b.column("text")), least))
                cols = list(zip(*found)) if found else [()] * 6
                yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(cols[0], pa.int64())), pa.array(cols[1], item_type), pa.array(cols[2], pa.float64()),
                                                  pa.array(cols[3], pa.int32()), pa.array(cols[4], pa.int64()), pa.array(cols[5], pa.int32())],
                                                 names=["doc_id", "item_id", "similarity", "bits", "first_word", "n_words"])

        part = src.mapInArrow(matched, f"doc_id {kinds[0]}, item_id {kinds[1]}, similarity double, bits int, first_word long, n_words int")
        out = part if out is None else out.unionByName(part)
    return out


def remove(docs: DataFrame, benchmark: DataFrame, least: float = 0.8) -> DataFrame:
    """The rows of ``docs``, with all their columns, without a window that matches an item."""
    for rows in blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(rows)

        def clean(batches, shared=shared):
            items = Items(shared.value)
            for b in pieces(batches, 4 << 20):
                hit = np.zeros(b.num_rows, dtype=bool)
                for text, *_ in items.matches(as_bytes(b.column("text")), least):
                    hit[text] = True
                yield b.filter(pa.array(~hit))

        docs = docs.mapInArrow(clean, docs.schema)
    return docs
