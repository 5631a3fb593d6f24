"""Helpers shared by the operators: shared scratch tables and word hashes of Arrow batches."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import hashlib
import io
import os
import tempfile
import uuid
import zipfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from wattspark.session import scratch_path

U64 = np.uint64


# ------------------------------------------------------------------ shared scratch tables
def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared checkpoint folder."""
    return scratch_path(spark, f"wattspark-llm/{name}-{uuid.uuid4().hex[:12]}")


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to shared scratch and read it back: cuts the lineage, survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, *shared) -> None:
    """Drop broadcast values whose readers are written, and let Spark's cleaner remove the shuffle files of
    plans that nothing refers to any more."""
    for b in shared:
        b.destroy()
    gc.collect()
    spark._jvm.System.gc()


#: at most so many keys are broadcast by ``join_counted``
HOT = 20_000


def join_counted(rows: DataFrame, counted: DataFrame, keys: list[str], n: str) -> DataFrame:
    """``rows`` joined to ``counted``, which has each key once, its number of rows in ``n`` and any other columns.

    Keys that hold at least one in ``HOT`` of all the rows counted are at most ``HOT`` many at any size: they are
    broadcast, so that a hot key needs no task of its own. The others are joined by hash. Both sides are read twice: settled ones.
    """
    total = counted.agg(F.coalesce(F.sum(n), F.lit(0))).first()[0]
    hot, cold = counted.where(F.col(n) * HOT >= total), counted.where(F.col(n) * HOT < total)
    rest = rows.join(F.broadcast(hot.select(keys)), keys, "left_anti").join(cold, keys)
    return rows.join(F.broadcast(hot), keys).unionByName(rest)


def drop_path(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def ship(spark: SparkSession) -> None:
    """Let Spark hand this package to its Python workers, unless their path has it already."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    sc = spark.sparkContext
    if root in os.environ.get("PYTHONPATH", "").split(os.pathsep) or getattr(sc, "_wattspark_shipped", False):
        return
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        for folder in ("wattspark", os.path.join("wattspark", "llm")):
            for name in sorted(os.listdir(os.path.join(root, folder))):
                if name.endswith(".py"):
                    z.write(os.path.join(root, folder, name), os.path.join(folder, name))
    path = os.path.join(tempfile.mkdtemp(prefix="wattspark-ship-"), "wattspark_llm.zip")  # the driver's; Spark serves it
    with open(path, "wb") as f:
        f.write(buf.getvalue())
    sc.addPyFile(path)
    sc._wattspark_shipped = True


# ------------------------------------------------------------------ words and shingles (numpy)
_RNG = np.random.default_rng(20240229)
#: one odd random weight per byte value, and the multiplier of the positional hash
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)
_BASE = U64(0x9E3779B97F4A7C15)
_INV = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_STEP = U64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (a bijection with good avalanche)."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    return x ^ (x >> U64(32))


_POWERS: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i (mod 2**64) for i < n; grown on demand, kept per worker."""
    have = _POWERS.get("up")
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        for key, base in (("up", _BASE), ("down", _INV)):
            p = np.full(size, base, dtype=U64)
            p[0] = 1
            _POWERS[key] = np.multiply.accumulate(p)
    return _POWERS["up"][:n], _POWERS["down"][:n]


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_APART = _SPACE.copy()
_APART[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a list of UTF-8 texts, as flat arrays.

    ``doc`` (text index), ``start`` / ``end`` (byte span in ``data``) and ``hash`` per word;
    ``first`` has the index of each text's first word (one more entry than texts). With ``marks``,
    ASCII punctuation also separates words.
    """

    def __init__(self, texts: list[bytes], lower: bool, marks: bool = False):
        self.sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        # one space behind each text: words never cross texts
        self.data = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
        self.begin = np.cumsum(self.sizes + 1) - (self.sizes + 1)
        data = _LOWER[self.data] if lower else self.data
        space = (_APART if marks else _SPACE)[self.data]
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        if len(space) and not space[0]:
            edge = np.concatenate((np.zeros(1, dtype=edge.dtype), edge))
        self.start, self.end = edge[0::2], edge[1::2]
        self.doc = np.searchsorted(self.begin, self.start, side="right") - 1
        self.first = np.searchsorted(self.start, np.append(self.begin, len(self.data)))
        self.hash = _span_hash(data, self.start, self.end)


#: words longer than this are hashed one by one
LONG = 4096


@functools.cache
def _place_values() -> np.ndarray:
    """A random number for every byte value at every place of a word (8 MB, once per worker)."""
    return np.random.default_rng(20240301).integers(0, 1 << 64, LONG * 256, dtype=U64)


def _span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray, block: int = 1 << 18) -> np.ndarray:
    """Hash of the byte spans: the sum of a random number per byte and place (no arithmetic relation between
    places, as the powers of a base have), mixed with the length."""
    out = np.empty(len(start), dtype=U64)
    size = end - start
    for i in np.flatnonzero(size > LONG).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[start[i]:end[i]].tobytes(), digest_size=8).digest(), "little")
    short = np.flatnonzero(size <= LONG)
    start, end = start[short], end[short]
    values = _place_values()
    at = 0
    while at < len(start):  # in blocks of bytes: bounded memory
        lo = int(start[at])
        to = int(np.searchsorted(start, lo + block, side="right"))
        s, e = start[at:to] - lo, end[at:to] - lo
        n = e - s
        upto = np.cumsum(n)
        place = np.arange(int(upto[-1])) - np.repeat(upto - n, n)
        byte = data[np.repeat(s, n) + place + lo]
        total = np.zeros(len(place) + 1, dtype=U64)
        np.cumsum(values[place * 256 + byte], out=total[1:])
        out[short[at:to]] = total[upto] - total[upto - n] + n.astype(U64) * _STEP
        at = to
    return mix(out)


def shingles(words: Words, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(word index of the first word, hash) of every run of ``size`` words inside one text."""
    n = len(words.hash)
    if n < size:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=U64)
    at = np.flatnonzero(words.doc[: n - size + 1] == words.doc[size - 1:])
    h = words.hash[at]
    for k in range(1, size):
        h = h * _STEP + words.hash[at + k]
    return at, mix(h)


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null counts as empty."""
    return [x or b"" for x in column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()]


#: what a worker keeps from task to task, by name: functions that drop it
CACHES: dict[str, object] = {}


def only(cache: str = "") -> None:
    """Drop what this worker keeps for other operators: it serves many, one after another."""
    for name in [n for n in CACHES if n != cache]:
        CACHES.pop(name)()
        gc.collect()
        with contextlib.suppress(OSError, AttributeError):  # a C library without it keeps the memory
            ctypes.CDLL(None).malloc_trim(0)


def pieces(batches, limit: int = 4 << 20, column: str = "text", cache: str = ""):
    """Cut Arrow batches so that each slice holds at most about ``limit`` bytes of text; of what the worker
    keeps, only ``cache`` stays."""
    only(cache)
    for b in batches:
        if not b.num_rows:
            continue
        import pyarrow.compute as pc
        size = pc.fill_null(pc.binary_length(b.column(b.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False)
        cut = (np.cumsum(size + 16) // limit)
        edge = np.flatnonzero(np.diff(cut)) + 1
        for lo, hi in zip([0, *edge.tolist()], [*edge.tolist(), b.num_rows]):
            yield b.slice(lo, hi - lo)


def with_columns(docs: DataFrame, **columns) -> DataFrame:
    """``docs`` cut to the given names, so that extra columns can't clash."""
    return docs.select(*[c.alias(n) for n, c in columns.items()])
