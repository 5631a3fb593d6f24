"""Periodic run detection (operator 12): maximal word repetitions of each text, and the text without them.

A run is a stretch of at least ``max(min_words, 2 * q)`` consecutive words with smallest period ``q`` (words
``q`` apart are equal) that can't be extended to either side. Equivalently, on the diagonal of lag ``q``, where
word i meets word i + q, at least ``max(min_words - q, q)`` meetings in a row are equal.

Seed and extend. Lags are taken in bands, each up to twice the lag of the one before (``min_words`` for the first). All runs of a
band have a minimum overlap of m meetings, so they hold a whole k-gram, k = ceil(m / 2), that starts at a multiple of k:

* an index of the k-grams of the texts of a batch, as numbers that are equal only for equal words of the same text: those of
  2k words come from pairs of those of k; grams that a text has once are left out from then on;
* a seed is a gram on the grid and an occurrence of it in the same text, at a lag of the band. A band has about 2 n / p seeds for n words of
  period p, so a text of one word n times has O(n log n), not all pairs;
* seeds whose lag is a multiple of a known run's period, both grams inside that run, can only give that run again;
* a table per text and lag says how far the diagonal is covered; a seed inside is passed over, another is
  extended both ways to its maximal stretch, in steps that double.

A stretch at a multiple of the smallest period is the same stretch of words as that period's run: of equal ones the
smallest period stays.

Texts are read in Arrow batches cut to slices of bounded size; a text is never split, a task's memory is bounded by a slice or
the longest text. No shuffle.

Defined results: null, empty and blank texts have no words and no runs; every row is judged by itself, so repeated
rows give repeated results; extra columns pass through ``collapse`` untouched, names used here included; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from wattspark.llm.common import pieces, ship

WORD = re.compile("[^\\x20\\x09-\\x0D]+")
#: seeds looked at together
BLOCK = 1 << 20
RUN_TYPE = T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")]))


def _paired(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Numbers of the pairs: equal for equal pairs only."""
    _, out = np.unique(a * np.int64(b.max() + 1) + b if len(b) else a, return_inverse=True)
    return out.reshape(-1)


def _double(at: np.ndarray, gram: np.ndarray, by: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, numbers) of the grams of words [i, i + size) and [i + by, i + by + size) together."""
    mate = np.searchsorted(at, at + by)
    has = mate < len(at)
    has[has] = at[mate[has]] == at[has] + by
    return at[has], _paired(gram[has], gram[mate[has]])


def _repeated(at: np.ndarray, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Without the grams that occur once."""
    if not len(at):
        return at, gram
    more = np.bincount(gram)[gram] > 1
    at, gram = at[more], gram[more]
    return at, np.unique(gram, return_inverse=True)[1].reshape(-1)


def _same(words: np.ndarray, a: int, b: int, lag: int, step: int) -> int:
    """How many words from ``a`` on (``step`` 1), or before it (-1), equal those ``lag`` behind, up to the text's end ``b``."""
    size, done, room = 32, 0, (b - lag - a if step > 0 else a - b)
    while done < room:
        n = min(size, room - done)
        lo = a + done if step > 0 else a - done - n
        equal = words[lo:lo + n] == words[lo + lag:lo + lag + n]
        if not equal.all():
            return done + int(np.argmin(equal if step > 0 else equal[::-1]))
        done, size = done + n, size * 2
    return done


def find_runs(words: np.ndarray, first: np.ndarray, min_words: int = 12) -> list[tuple[int, int, int, int]]:
    """Runs ``(text, start, length, period)`` of the texts that begin at ``first`` (with the end as last entry) in
    ``words``, numbers that stand for words; by text, start, period."""
    n = len(words)
    if not n:
        return []
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    found: dict[tuple[int, int], int] = {}  # (start, end) -> smallest period
    # words of different texts never compare equal
    gram = _paired(text, words.astype(np.int64))
    at = np.arange(n)
    at, gram, size = *_repeated(at, gram), 1
    low, high = 1, max(min_words, 2)
    while len(at):
        k = -(-max(-(-min_words // 2), low) // 2)  # half of the least of max(min_words - q, q)
        while size < k:  # grams of ``size`` words become grams of up to twice as many, at most k
            by = min(size, k - size)
            at, gram = _repeated(*_double(at, gram, by))
            size += by
        if not len(at):
            break
        cover_end, cover_lag = _covers(found, n)
        for i, j in _seeds(at, gram, first[text[at]], k, low, high):
            inside = (cover_end[i] >= j + k) & ((j - i) % cover_lag[i] == 0)
            i, j = i[~inside], j[~inside]
            order = np.lexsort((i, j - i, text[i]))
            _extend(words, first, text, i[order], j[order], k, min_words, found)
        low, high = high, high * 2
    out = [(int(text[s]), s - int(first[text[s]]), e - s, q) for (s, e), q in found.items()]
    return sorted(out, key=lambda r: (r[0], r[1], r[3]))


def _covers(found: dict, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For every word: end and period of the known run before or at it that reaches furthest."""
    end, lag = np.zeros(n, dtype=np.int64), np.ones(n, dtype=np.int64)
    reach = 0
    for (s, e), q in sorted(found.items()):
        if e > reach:
            end[s:e], lag[s:e] = e, q
            reach = e
    return end, lag


def _seeds(at: np.ndarray, gram: np.ndarray, begin: np.ndarray, k: int, low: int, high: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of pairs of positions with the same gram, the first on the text's grid, at a lag of [low, high)."""
    span = int(at[-1]) + high + 1
    key = gram.astype(np.int64) * span + at
    order = np.argsort(key, kind="stable")
    key, place = key[order], at[order]
    grid = np.flatnonzero((at - begin) % k == 0)
    lo = np.searchsorted(key, gram[grid] * np.int64(span) + at[grid] + low)
    hi = np.searchsorted(key, gram[grid] * np.int64(span) + at[grid] + high)
    many = np.flatnonzero(hi > lo)
    total = np.cumsum(hi[many] - lo[many])
    done = 0
    while done < len(many):
        before = int(total[done - 1]) if done else 0
        to = max(done + 1, int(np.searchsorted(total, before + BLOCK, side="right")))
        part = many[done:to]
        count = hi[part] - lo[part]
        offset = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        yield np.repeat(at[grid[part]], count), place[np.repeat(lo[part], count) + offset]
        done = to


def _extend(words: np.ndarray, first: np.ndarray, text: np.ndarray, i: np.ndarray, j: np.ndarray, k: int, min_words: int, found: dict) -> None:
    """Adds the runs that the seeds, in order of text, lag and place, lie in."""
    covered, last = 0, (-1, 0)
    for a, b, t in zip(i.tolist(), j.tolist(), text[i].tolist()):
        lag = b - a
        if (t, lag) != last:
            covered, last = 0, (t, lag)
        if a < covered:
            continue
        end = a + k + _same(words, a + k, int(first[t + 1]), lag, 1)
        start = a - _same(words, a, int(first[t]), lag, -1)
        covered = end
        if end - start >= max(min_words - lag, lag):
            key = (start, end + lag)
            found[key] = min(lag, found.get(key, lag))


def kept(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of ``n`` words stay: those that no run (``start, length, period``) holds behind its first period."""
    edge = np.zeros(n + 1, dtype=np.int64)
    for s, size, q in runs:
        edge[s + q] += 1
        edge[s + size] -= 1
    return np.cumsum(edge[:n]) == 0


def _read(texts: list[str | None], min_words: int) -> Iterator[tuple[int, list, str]]:
    """(number of words, runs, collapsed text) of each text."""
    lists = [WORD.findall(t or "") for t in texts]
    first = np.cumsum([0, *map(len, lists)])
    flat = pa.array([w for x in lists for w in x], type=pa.large_string())
    words = flat.dictionary_encode().indices.to_numpy(zero_copy_only=False) if len(flat) else np.empty(0, dtype=np.int32)
    runs: list[list] = [[] for _ in texts]
    for t, *run in find_runs(words, first, min_words):
        runs[t].append(tuple(run))
    for x, r in zip(lists, runs):
        yield len(x), r, " ".join([w for w, k in zip(x, kept(len(x), r).tolist()) if k] if r else x)


def collapse(docs: DataFrame, min_words: int = 12) -> DataFrame:
    """All rows of ``docs`` in a column ``row``, with ``n_words``, ``runs`` (by start, then period; word numbers from 0) and ``collapsed``,
    the words that no run repeats, joined by single spaces."""
    ship(docs.sparkSession)
    names = [f"c{i}" for i in range(len(docs.columns))]
    schema = T.StructType([T.StructField(n, f.dataType) for n, f in zip(names, docs.schema)])
    schema = schema.add("n_words", "long").add("runs", RUN_TYPE).add("collapsed", "string")
    text = names[docs.columns.index("text")]

    def work(batches):
        run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for b in pieces(batches, column=text):
            n, runs, out = zip(*_read(b.column(text).to_pylist(), min_words))
            runs = [[dict(zip(("start", "length", "period"), r)) for r in x] for x in runs]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(n, pa.int64()), pa.array(runs, run_type), pa.array(out, pa.string())], names=[*names, "n_words", "runs", "collapsed"])

    out = docs.toDF(*names).mapInArrow(work, schema)
    return out.select(F.struct(*[F.col(n).alias(c) for n, c in zip(names, docs.columns)]).alias("row"), "n_words", "runs", "collapsed")


def digest(out: DataFrame) -> DataFrame:
    """``doc_id, n_runs``, the longest run (ties: smallest start, then period) with its exponent, and digests of the runs and the text."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    return out.withColumn("best", best).select(
        F.col("row.doc_id").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"), (-F.col("best.s")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.p")).alias("period"),
        F.floor(F.lit(1000).cast("long") * F.col("best.length") / -F.col("best.p")).alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def planted(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` of ``docs``, the words of each tenth text (by h = crc32 of its decimal id) made periodic from word a on, so that the given
    rows hold long runs: word i >= a becomes word a + (i - a) % p, with g = h // 10, a = g % n, p = 1 + (n - a) // (3 + g % 8). Rows with a null id stay as they are."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    slim = docs.select(docs["doc_id"], docs["text"]).withColumn("g", F.when(h % 10 == 0, F.floor(h / 10)))
    slim = slim.withColumn("w", F.when(F.col("g").isNotNull(), F.regexp_extract_all("text", F.lit(WORD.pattern), F.lit(0))))
    n = F.size("w")
    a = (F.col("g") % n).cast("int")
    p = F.lit(1) + F.floor((n - F.col("a")) / (F.lit(3) + F.col("g") % 8)).cast("int")
    slim = slim.withColumn("a", F.when(n > 0, a)).withColumn("p", p)
    made = F.array_join(F.transform("w", lambda x, i: F.when(i < F.col("a"), x).otherwise(F.get(F.col("w"), F.col("a") + (i - F.col("a")) % F.col("p")))), " ")
    return slim.select("doc_id", F.when(F.col("a").isNull(), F.col("text")).otherwise(made).alias("text"))
