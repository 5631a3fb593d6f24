"""Token-ID / binary output (operator 1): frequency-ranked ids, byte-aligned variable-length coding.

Pass 1 encodes every text and writes the raw ids to shared scratch, so that nothing is encoded
twice. Its tasks count the ids they write and add the counts as rows of their own, one per task and id, so that
pass 2 sums those and reads no ids; the most frequent id gets rank 0. Pass 3 codes each document's ranks: 1 to 4 data bytes a value, and separate control bytes
with two bits a value (length - 1). The coded rows, smaller than the texts, are range-partitioned
and sorted by ``doc_id`` and written as a Parquet table, one row a document with ``control`` and
``data`` columns; Spark's committer makes the write survive lost executors and any file system.
Only the rank table, bounded by the vocabulary, passes through the driver.

Decoding looks up the four lengths of each control byte in a 256-row table and gathers the bytes.

Defined results: null text is an empty text (only the end id); null ``doc_id`` sorts first; rows
with the same ``doc_id`` stand in the order of a hash of their text; an empty table gives files without rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from wattspark.llm.common import drop_path, pieces, scratch, with_columns
from wattspark.llm.tokens import UnitEncoder

#: lengths of the four values of a control byte
LENGTHS = np.array([[(c >> 2 * k & 3) + 1 for k in range(4)] for c in range(256)], dtype=np.int64)


# ------------------------------------------------------------------ coding
def code(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(control bytes, control bytes per run, data bytes, data bytes per run) of runs of values."""
    values = values.astype(np.uint32)
    size = (values > 0xFF).astype(np.int64) + (values > 0xFFFF) + (values > 0xFFFFFF)
    n_control = (counts + 3) // 4
    slot = _slots(counts, n_control)
    codes = np.zeros(4 * n_control.sum(), dtype=np.uint8)
    codes[slot] = size
    codes = codes.reshape(-1, 4)
    control = codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6
    size += 1
    at = np.cumsum(size) - size
    data = np.empty(int(size.sum()), dtype=np.uint8)
    data[at] = values & 0xFF
    for k in (1, 2, 3):
        m = np.flatnonzero(size > k)
        data[at[m] + k] = values[m] >> (8 * k) & 0xFF
    n_data = np.diff(np.append(0, np.cumsum(size))[np.append(0, np.cumsum(counts))])
    return control, n_control, data, n_data


def decode(control: np.ndarray, data: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The values of runs with ``counts`` values each, from their control and data bytes."""
    size = LENGTHS[control].reshape(-1)[_slots(counts, (counts + 3) // 4)]
    at = np.cumsum(size) - size
    values = data[at].astype(np.uint32)
    for k in (1, 2, 3):
        m = np.flatnonzero(size > k)
        values[m] |= data[at[m] + k].astype(np.uint32) << np.uint32(8 * k)
    return values


def _slots(counts, n_control):
    """Where each value stands when every run is padded to whole control bytes."""
    shift = 4 * (np.cumsum(n_control) - n_control) - (np.cumsum(counts) - counts)
    return np.arange(counts.sum()) + np.repeat(shift, counts)


def _binary(flat: np.ndarray, counts: np.ndarray) -> pa.Array:
    """A binary column of runs of ``flat``'s bytes."""
    offsets = np.append(0, np.cumsum(counts * flat.dtype.itemsize)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(flat).tobytes())])


def _flat(column: pa.Array, dtype) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=dtype)


# ------------------------------------------------------------------ writing
def write_token_files(docs: DataFrame, path: str, vocab: str, end_id: int | None = 2) -> str:
    """Write the ids of ``docs`` (``doc_id``, ``text``) below ``path``; returns ``path``.

    ``path/ranks`` has ``rank, id, n``; ``path/docs`` has ``doc_id, shard, start_in_shard,
    n_tokens, control, data`` in ascending ``doc_id`` order over its files.
    """
    spark = docs.sparkSession
    src = with_columns(docs, doc_id=F.col("doc_id"), tie=F.xxhash64("text"), text=F.col("text"))
    kind = src.schema["doc_id"].dataType.simpleString()
    raw = scratch(spark, "ids")
    wide = np.dtype("<u2" if end_id is None or end_id < 1 << 16 else "<u4")

    def encoded(batches):
        encoder, total, key = UnitEncoder.get(vocab), np.zeros(0, dtype=np.int64), pa.null()
        for b in pieces(batches, 8 << 20, cache="tokens"):
            ids, count = encoder.encode(b.column("text"))
            ids = ids.astype(max(wide, encoder.dtype, key=lambda d: d.itemsize))
            if end_id is not None:
                ids = np.insert(ids, np.cumsum(count), end_id)
                count = count + 1
            n = np.bincount(ids)
            total = np.pad(total, (0, max(0, len(n) - len(total))))
            total[: len(n)] += n
            key, none = b.column("doc_id").type, pa.nulls(len(count), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("tie"), pa.array(count, pa.int64()), pa.array(np.full(len(count), ids.dtype.itemsize, np.int8)), _binary(ids, count), none, none],
                names=["doc_id", "tie", "n_tokens", "width", "ids", "id", "n"])
        # the task's counts, as rows of their own: the ids need not be read again for them
        seen = np.flatnonzero(total)
        if len(seen):
            empty = [pa.nulls(len(seen), t) for t in (key, pa.int64(), pa.int64(), pa.int8(), pa.binary())]
            yield pa.RecordBatch.from_arrays([*empty, pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())],
                                             names=["doc_id", "tie", "n_tokens", "width", "ids", "id", "n"])

    src.mapInArrow(encoded, f"doc_id {kind}, tie long, n_tokens long, width byte, ids binary, id long, n long").write.option("compression", "zstd").parquet(raw)
    written = spark.read.parquet(raw)
    ids = written.where("ids IS NOT NULL").drop("id", "n")
    counts = written.where("id IS NOT NULL").groupBy("id").agg(F.sum("n").alias("n"))
    table = counts.collect()  # at most one row per id of the vocabulary
    table.sort(key=lambda r: (-r.n, r.id))
    spark.createDataFrame([(k, r.id, r.n) for k, r in enumerate(table)], "rank long, id long, n long").coalesce(1).write.parquet(f"{path}/ranks")
    rank = np.zeros(max([0, *(r.id for r in table)]) + 1, dtype=np.uint32)
    rank[[r.id for r in table]] = np.arange(len(table))
    ranks = spark.sparkContext.broadcast(rank)

    def coded(batches):
        for b in pieces(batches, 1 << 20, column="ids"):  # and the worker forgets the encoder
            count = b.column("n_tokens").to_numpy(zero_copy_only=False)
            control, n_control, data, n_data = code(ranks.value[_flat(b.column("ids"), f"<u{b.column('width')[0].as_py()}")], count)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("tie"), b.column("n_tokens"), _binary(control, n_control), _binary(data, n_data)],
                                             names=["doc_id", "tie", "n_tokens", "control", "data"])

    def placed(batches):
        shard, start = TaskContext.get().partitionId(), 0
        for b in batches:
            count = b.column("n_tokens").to_numpy(zero_copy_only=False)
            at = start + np.cumsum(count) - count
            start += int(count.sum())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(np.full(len(count), shard, np.int32)), pa.array(at, pa.int64()), b.column("n_tokens"), b.column("control"), b.column("data")],
                names=["doc_id", "shard", "start_in_shard", "n_tokens", "control", "data"])

    rows = ids.mapInArrow(coded, f"doc_id {kind}, tie long, n_tokens long, control binary, data binary")
    (rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
     .mapInArrow(placed, f"doc_id {kind}, shard int, start_in_shard long, n_tokens long, control binary, data binary")
     .write.option("compression", "zstd").parquet(f"{path}/docs"))
    drop_path(spark, raw)
    return path


# ------------------------------------------------------------------ reading
def read_token_files(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """``doc_id, start, n_tokens`` and, per document, ``ids`` (little-endian 32-bit integers) or their crc32."""
    table = spark.read.parquet(f"{path}/ranks").collect()  # bounded by the vocabulary
    of = np.zeros(len(table), dtype=np.uint32)
    of[[r["rank"] for r in table]] = [r["id"] for r in table]
    id_of = spark.sparkContext.broadcast(of)
    files = spark.read.parquet(f"{path}/docs")
    kind = files.schema["doc_id"].dataType.simpleString()
    name, out = ("ids_crc32", "long") if digest else ("ids", "binary")

    def decoded(batches):
        for b in pieces(batches, 1 << 20, column="data"):
            count = b.column("n_tokens").to_numpy(zero_copy_only=False)
            values = id_of.value[decode(_flat(b.column("control"), np.uint8), _flat(b.column("data"), np.uint8), count)].astype("<u4")
            if digest:
                edge = np.append(0, np.cumsum(count)).tolist()
                last = pa.array([zlib.crc32(values[lo:hi]) for lo, hi in zip(edge, edge[1:])], pa.int64())
            else:
                last = _binary(values, count)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("shard"), b.column("start_in_shard"), b.column("n_tokens"), last],
                                             names=["doc_id", "shard", "start_in_shard", "n_tokens", name])

    # one row per shard: the number of tasks of the write
    size = files.groupBy("shard").agg(F.sum("n_tokens").alias("size"))
    before = size.select(F.col("shard").alias("in_shard"), (F.sum("size").over(Window.orderBy("shard")) - F.col("size")).alias("before"))
    rows = files.mapInArrow(decoded, f"doc_id {kind}, shard int, start_in_shard long, n_tokens long, {name} {out}")
    return (rows.join(F.broadcast(before), F.col("shard") == F.col("in_shard"))
            .select("doc_id", (F.col("before") + F.col("start_in_shard")).alias("start"), "n_tokens", name))
