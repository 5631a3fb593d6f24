"""Suffix-array dedup (operator 10): bytes covered by a ``SPAN``-byte string that also starts elsewhere.

The corpus is never sorted as one string. Blocks of text that can hold equal ``SPAN``-byte strings are
found first, without losing any; then each block's suffixes are sorted in two stages and adjacent
common prefixes decide.

1. Anchors. In each window of ``SPAN`` bytes, the ``GRAM``-byte string with the smallest hash (the leftmost of
   equals) is the window's anchor. Equal windows have equal anchors at equal offsets. Neighbouring windows
   with the same anchor form a run; the text that a run covers is its context.
2. Only runs whose anchor occurs twice (a bounded bitmap; collisions add runs, never lose one) go on.
   Contexts that are equal as a whole are counted: they are repeated as a whole, and one copy stands for all.
3. Different contexts with the same anchor form a block. Two-stage sorting: suffixes smaller than their
   successors are sorted directly, the others are induced by bucket scans; adjacent suffixes with a common
   prefix of ``SPAN`` bytes are repeated. Blocks are sorted by their anchor in bounded batches.
4. A block with more than ``LIMIT`` different contexts (a passage that a large share of all documents hold in different
   surroundings) is settled without gathering it: its windows are counted by 128-bit hashes.

Defined results: a null text is empty; texts shorter than ``SPAN`` lose nothing; rows with equal id and text
are two documents and repeat each other; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from wattspark.llm.bitmaps import bit, filter_of, place, twice
from wattspark.llm.common import U64, _BYTE, as_bytes, join_counted, mix, pieces, powers, release, settle

SPAN, GRAM = 400, 200
#: a block with more different contexts is counted instead of sorted
LIMIT = 8192
ANCHOR_BITS = 27
_SLICE = 1 << 19
_LOW = 20


# ------------------------------------------------------------------ anchors and runs
def runs(texts: list[bytes], span: int = SPAN, gram: int = GRAM):
    """(text, first window, number of windows, anchor hash) of each run, as arrays."""
    out = [[], [], [], []]
    part, owner, begin, size = [], [], [], 0

    def flush():
        if part:
            for have, got in zip(out, _runs(part, owner, begin, span, gram)):
                have.append(got)

    for i, t in enumerate(texts):
        for lo in range(0, max(len(t) - span + 1, 0), _SLICE):  # slices share span - 1 bytes: every window is in one
            piece = t[lo:lo + _SLICE + span - 1]
            if size + len(piece) > 1 << _LOW:  # positions of a batch have _LOW bits
                flush()
                part, owner, begin, size = [], [], [], 0
            part.append(piece)
            owner.append(i)
            begin.append(lo)
            size += len(piece)
            if size >= _SLICE:
                flush()
                part, owner, begin, size = [], [], [], 0
    flush()
    kinds = (np.int64, np.int64, np.int64, U64)
    return [np.concatenate(x) if x else np.zeros(0, k) for x, k in zip(out, kinds)]


def _runs(part, owner, begin, span, gram):
    length = np.fromiter(map(len, part), np.int64, len(part))
    start = np.cumsum(length) - length
    data = np.frombuffer(b"".join(part), np.uint8)
    n, wide = len(data), span - gram + 1
    up, down = powers(n + 1)
    total = np.empty(n + 1, dtype=U64)
    total[0] = 0
    np.cumsum(_BYTE[data] * up[:-1], out=total[1:])
    grams = mix((total[gram:] - total[:-gram]) * down[: n - gram + 1])
    # smallest by the high bits, then leftmost
    low = (grams >> U64(_LOW)) << U64(_LOW) | np.arange(len(grams), dtype=U64)
    step = 1
    while step * 2 <= wide:
        low = np.minimum(low[:-step], low[step:])
        step *= 2
    low = np.minimum(low[: n - span + 1], low[wide - step: wide - step + n - span + 1])
    anchor = (low & U64((1 << _LOW) - 1)).astype(np.int64)
    # windows inside one piece, cut where the anchor changes
    inside = np.zeros(n + 1, dtype=np.int8)
    inside[start] += 1
    inside[start + length - span + 1] -= 1
    inside = np.cumsum(inside[: n - span + 1]) > 0
    new = np.append(True, anchor[1:] != anchor[:-1])
    new[start] = True
    first = np.flatnonzero(new & inside)
    ends = np.flatnonzero(np.append((new | ~inside)[1:], True) & inside) + 1
    count = ends - first
    k = np.searchsorted(start, first, side="right") - 1
    return np.array(owner)[k], first - start[k] + np.array(begin)[k], count, grams[anchor[first]]


# ------------------------------------------------------------------ two-stage sorting of a batch of contexts
def repeated(contexts: list[bytes], span: int = SPAN) -> np.ndarray:
    """For every window start of the contexts, one after another: does its ``span``-byte string start elsewhere in them?"""
    length = np.fromiter(map(len, contexts), np.int64, len(contexts))
    begin = np.cumsum(length) - length
    n = int(length.sum())
    t = np.frombuffer(b"".join(contexts) + bytes(span + 16), dtype=np.uint8)
    words = -(-span // 8)
    w8 = np.zeros(n + span, dtype=U64)
    for k in range(8):
        w8 |= t[k:k + n + span].astype(U64) << U64(56 - 8 * k)
    tail = U64((1 << 64) - 1) << U64(8 * (8 * words - span)) if 8 * words > span else None

    def word(at, k):
        x = w8[at + 8 * k]
        return x & tail if tail is not None and k == words - 1 else x

    # types: smaller (True) or larger than the successor, by the next different byte
    step = t[1:n + 2].astype(np.int16) - t[:n + 1]
    other = np.where(step != 0, np.arange(n + 1), n + 1)
    other = np.minimum.accumulate(other[::-1])[::-1]
    smaller = np.append(step, 1)[other] > 0
    starts = length - span + 1
    # each context's starts, and further up to the next directly sorted suffix
    nxt = np.minimum.accumulate(np.where(smaller, np.arange(n + 1), n)[::-1])[::-1]
    reach = np.minimum(np.maximum(nxt[np.minimum(begin + starts - 1, n)] + 1, begin + starts), n)
    many = reach - begin
    need = np.repeat(begin - (np.cumsum(many) - many), many) + np.arange(many.sum())
    need = np.unique(need)
    direct, induced = need[smaller[need]], need[~smaller[need]]
    direct = _sort_directly(direct, word, words)

    # bucket scans: per first byte, first the induced suffixes, then the directly sorted ones
    rank = np.full(n + 2, -1, dtype=np.int64)
    level = other[induced] - induced  # equal bytes that follow
    by = np.lexsort((level, t[induced]))
    induced, level = induced[by], level[by]
    key = t[induced].astype(np.int64) << 40 | level
    cut = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    groups: dict[int, list] = {}
    for lo, hi in zip(cut.tolist(), [*cut[1:].tolist(), len(induced)]):
        groups.setdefault(int(t[induced[lo]]), []).append(induced[lo:hi])
    edge = np.searchsorted(t[direct], np.arange(257))
    order, size = [], 0
    for c in range(256):
        for g in [*groups.get(c, ()), None]:
            g = direct[edge[c]:edge[c + 1]] if g is None else g[np.argsort(rank[g + 1], kind="stable")]
            if len(g):
                rank[g] = np.arange(size, size + len(g))
                size += len(g)
                order.append(g)
    order = np.concatenate(order) if order else np.zeros(0, np.int64)
    is_start = np.zeros(n + 1, dtype=bool)
    flat = np.repeat(begin - (np.cumsum(starts) - starts), starts) + np.arange(starts.sum())
    is_start[flat] = True
    order = order[is_start[order]]

    # adjacent common prefixes
    same = np.arange(max(0, len(order) - 1))
    for k in range(words):
        same = same[word(order[same], k) == word(order[same + 1], k)]
    twice = np.zeros(n + 1, dtype=bool)
    twice[order[same]] = twice[order[same + 1]] = True
    return twice[flat]


def _sort_directly(at: np.ndarray, word, words: int) -> np.ndarray:
    """Sort suffixes by their first ``words`` words; only groups that are still tied and differ are sorted on."""
    if not len(at):
        return at
    key = word(at, 0)
    by = np.argsort(key, kind="stable")
    at, key = at[by], key[by]
    new = np.append(True, key[1:] != key[:-1])
    # places (in the order) that are tied with a neighbour, and the group of each
    tied = np.flatnonzero(~(new & np.append(new[1:], True)))
    group = np.cumsum(new)[tied]
    for k in range(1, words):
        if not len(tied):
            break
        key = word(at[tied], k)
        edge = np.append(True, group[1:] != group[:-1])
        differs = np.append(False, (key[1:] != key[:-1])) & ~edge
        if differs.any():
            number = np.cumsum(edge) - 1
            mixed = np.zeros(number[-1] + 1, dtype=bool)
            mixed[number[differs]] = True
            chosen = np.flatnonzero(mixed[number])
            by = np.lexsort((key[chosen], group[chosen]))
            at[tied[chosen]] = at[tied[chosen]][by]
            key[chosen] = key[chosen][by]
            edge = edge | np.append(False, key[1:] != key[:-1])
            group = np.cumsum(edge)
            keep = ~(edge & np.append(edge[1:], True))
            tied, group = tied[keep], group[keep]
    return at


# ------------------------------------------------------------------ on DataFrames
def _rows(docs: DataFrame) -> DataFrame:
    text = F.coalesce(docs["text"], F.lit(""))
    return docs.select(docs["doc_id"].alias("doc_id"), F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), docs["doc_id"], text).alias("k2"), text.alias("text"))


def anchored(rows: DataFrame, span: int, gram: int) -> DataFrame:
    """Settled: ``k1, k2, at, n, a, f, f2`` of the runs whose anchor may occur twice; ``f, f2`` are 128 bits of a
    cryptographic hash of the run's context."""
    def anchors(b):
        found = [place(runs(as_bytes(p.column("text")), span, gram)[3], ANCHOR_BITS) for p in pieces([b], 4 << 20)]
        return np.concatenate(found) if found else np.zeros(0, np.int64)

    often = rows.sparkSession.sparkContext.broadcast(twice(rows.select("text"), anchors, ANCHOR_BITS))

    def kept(batches):
        for b in pieces(batches, 4 << 20):
            texts = as_bytes(b.column("text"))
            owner, at, n, a = runs(texts, span, gram)
            hit = np.flatnonzero(bit(often.value, place(a, ANCHOR_BITS)))
            who, at, n = owner[hit], at[hit], n[hit]
            names = b"".join(hashlib.blake2b(texts[k][lo:lo + m - 1 + span], digest_size=16).digest() for k, lo, m in zip(who.tolist(), at.tolist(), n.tolist()))
            f = np.frombuffer(names, "<i8").reshape(-1, 2)
            who = pa.array(who, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("k1").take(who), b.column("k2").take(who), pa.array(at, pa.int64()), pa.array(n.astype(np.int32)),
                                              pa.array(a[hit].view(np.int64)), pa.array(f[:, 0].copy()), pa.array(f[:, 1].copy())], names=["k1", "k2", "at", "n", "a", "f", "f2"])

    out = settle(rows.select("k1", "k2", "text").mapInArrow(kept, "k1 long, k2 long, at long, n int, a long, f long, f2 long"), "runs")
    release(rows.sparkSession, often)
    return out


def _texts_of(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """Settled ``k1, k2, text`` of the documents with the given keys, once each."""
    wanted = settle(keys.select("k1", "k2").distinct(), "keys")
    bitmap, bits = filter_of(wanted, "k2", wanted.count())
    shared = rows.sparkSession.sparkContext.broadcast(bitmap)

    def chosen(batches):
        for b in batches:
            if b.num_rows:
                yield b.filter(pa.array(bit(shared.value, place(b.column("k2").to_numpy(zero_copy_only=False), bits))))

    found = rows.select("k1", "k2", "text").mapInArrow(chosen, "k1 long, k2 long, text string")
    out = settle(found.groupBy("k1", "k2").agg(F.first("text").alias("text")).join(wanted, ["k1", "k2"], "left_semi"), "texts")
    release(rows.sparkSession, shared)
    return out


def _sorted_blocks(contexts: DataFrame, span: int) -> DataFrame:
    """Repeated stretches ``k1, k2, at, to`` of the contexts ``a, k1, k2, at, alone, context``."""
    def marked(batches):
        held, size, last = [], 0, None

        def settled(rows):
            hit = repeated([r[5] for r in rows], span)
            out, pos = [], 0
            for a, k1, k2, at, alone, context in rows:
                n = len(context) - span + 1
                if alone:
                    on = np.flatnonzero(hit[pos:pos + n])
                    if len(on):
                        edge = np.flatnonzero(np.append(True, np.diff(on) > 1))
                        for lo, hi in zip(on[edge].tolist(), on[np.append(edge[1:], len(on)) - 1].tolist()):
                            out.append((k1, k2, at + lo, at + hi + span))
                pos += n
            cols = list(zip(*out)) if out else [()] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["k1", "k2", "at", "to"])

        for b in batches:
            for r in zip(*(b.column(c).to_pylist() for c in ("a", "k1", "k2", "at", "alone", "context"))):
                if r[0] != last and size >= 1 << 20:  # whole blocks only
                    yield settled(held)
                    held, size = [], 0
                last = r[0]
                held.append(r)
                size += len(r[5])
        if held:
            yield settled(held)

    return contexts.repartition("a").sortWithinPartitions("a").mapInArrow(marked, "k1 long, k2 long, at long, to long")


def _counted_windows(contexts: DataFrame, span: int) -> DataFrame:
    """The same for contexts of very large blocks, by counts of 128-bit hashes of their windows."""
    def windows(batches):
        for b in batches:
            for a, k1, k2, at, alone, context in zip(*(b.column(c).to_pylist() for c in ("a", "k1", "k2", "at", "alone", "context"))):
                n = len(context) - span + 1
                names = [hashlib.blake2b(context[i:i + span], digest_size=16).digest() for i in range(n)]
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array([k1] * n), pa.array([k2] * n), pa.array(np.arange(at, at + n)), pa.array([alone] * n)], names=["w", "k1", "k2", "at", "alone"])

    rows = contexts.mapInArrow(windows, "w binary, k1 long, k2 long, at long, alone boolean")
    often = rows.groupBy("w").agg(F.count("*").alias("c")).where("c > 1").select("w")
    return rows.where("alone").join(often, "w").select("k1", "k2", "at", (F.col("at") + span).alias("to"))


def stretches(rows: DataFrame, span: int, gram: int, limit: int) -> tuple[DataFrame, DataFrame]:
    """(settled repeated stretches ``k1, k2, at, to``, settled texts of the documents that have some)."""
    found = anchored(rows, span, gram)
    same = settle(found.groupBy("a", "f", "f2").agg(F.count("*").alias("c"), F.min(F.struct("k1", "k2", "at", "n")).alias("one")), "contexts")
    whole = join_counted(found, same.where("c > 1").select("a", "f", "f2", "c"), ["a", "f", "f2"], "c").select("k1", "k2", "at", (F.col("at") + F.col("n") - 1 + span).alias("to"))
    blocks = same.groupBy("a").agg(F.count("*").alias("contexts"), F.min("c").alias("least")).where("contexts > 1 AND least = 1").select("a", "contexts")
    chosen = settle(join_counted(same, settle(blocks, "blocks"), ["a"], "contexts").select("a", "contexts", "one.*", (F.col("c") == 1).alias("alone")), "chosen")
    texts = _texts_of(rows, whole.select("k1", "k2").union(chosen.select("k1", "k2")))
    cut = settle(chosen.join(texts, ["k1", "k2"]).select("a", "k1", "k2", "at", "alone", "contexts", F.substring(F.col("text").cast("binary"), F.col("at").cast("int") + 1, F.col("n") - 1 + span).alias("context")), "cut")
    columns = ["a", "k1", "k2", "at", "alone", "context"]
    more = _sorted_blocks(cut.where(F.col("contexts") <= limit).select(columns), span).union(_counted_windows(cut.where(F.col("contexts") > limit).select(columns), span))
    return settle(whole.union(more), "stretches"), texts


def dedup(docs: DataFrame, span: int = SPAN, gram: int | None = None, limit: int = LIMIT, keep_text: bool = False) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` per row of ``docs`` (and ``kept``, the bytes left, on demand)."""
    rows = _rows(docs)
    found, texts = stretches(rows, span, gram or max(1, span // 2), limit)
    parts = found.groupBy("k1", "k2").agg(F.sort_array(F.collect_set(F.struct("at", "to"))).alias("parts"))
    joined = texts.join(parts, ["k1", "k2"]).select("k1", "k2", "text", F.col("parts.at").alias("at"), F.col("parts.to").alias("to"))

    def cut(batches):
        for b in pieces(batches, 4 << 20):
            removed, spans, sha, kept = [], [], [], []
            for t, ats, tos in zip(as_bytes(b.column("text")), b.column("at").to_pylist(), b.column("to").to_pylist()):
                left, end, gone, n, h = [], 0, 0, 0, hashlib.sha256()
                for at, to in zip(ats, tos):
                    if at > end or not n:
                        left.append(t[end:at])
                        n += 1
                        gone += to - at
                    else:
                        gone += max(0, to - end)
                    end = max(end, to)
                left.append(t[end:])
                rest = b"".join(left)
                h.update(rest)
                removed.append(gone)
                spans.append(n)
                sha.append(h.hexdigest())
                kept.append(rest if keep_text else b"")
            yield pa.RecordBatch.from_arrays([b.column("k1"), b.column("k2"), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(sha, pa.string()), pa.array(kept, pa.binary())],
                                             names=["k1", "k2", "n_removed", "n_spans", "sha", "kept"])

    done = joined.mapInArrow(cut, "k1 long, k2 long, n_removed long, n_spans long, sha string, kept binary")
    every = rows.select("doc_id", "k1", "k2", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("whole"), *([F.col("text").cast("binary").alias("raw")] if keep_text else []))
    out = every.join(done, ["k1", "k2"], "left").select(
        "doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"), F.coalesce("n_spans", F.lit(0).cast("long")).alias("n_spans"), F.coalesce("sha", "whole").alias("kept_sha256"),
        *([F.coalesce(F.when(F.col("sha").isNotNull(), F.col("kept")), "raw").alias("kept")] if keep_text else []))
    return out
