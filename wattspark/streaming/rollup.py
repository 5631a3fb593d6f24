"""Rollups that grow with their stream: partial aggregates per (keys, base cell) in a snapshot table.

A micro-batch is reduced to one row per key and base cell (a minute, say) with count, sum, least and greatest of each
value, and loaded with its batch id as token: a replayed batch is not loaded twice. Late samples are further partials of
an old cell, so nothing waits for a watermark and nothing is dropped. Any coarser bucket, for any span of whole cells and any hosts, is
answered by merging partials; zone maps on the cell and Bloom filters on the keys name the files to read.

Loads are merged by size: ``FAN`` of the newest loads, none of them ``FAN`` times as large as the last one, are folded into one.
A partial is so rewritten a number of times that grows with the logarithm of the table, and a
read folds a logarithmic number of loads, where merging everything each time would rewrite all history.
Files of folded loads stay for readers of older snapshots until the table's ``vacuum``.

Defined results: samples without a time are in no cell; a NULL key is a key of its own; a NULL value counts in no
aggregate of its column (count 0, sum NULL); an empty batch loads no rows.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from wattspark.functions.timecols import bucket_start
from wattspark.sources.snapshots import SnapshotTable

#: so many loads of one size are folded into one; a load of so many times the rows is of another size
FAN = 4

CELL = "cell"


class Rollup:
    """The rollup of samples ``timestamp, *keys, *values`` at ``root``, in cells of ``base_s`` seconds."""

    def __init__(self, spark: SparkSession, root: str, keys: Sequence[str], values: Sequence[str], base_s: int = 60, ts_col: str = "timestamp"):
        self.keys, self.values, self.base_s, self.ts_col = list(keys), list(values), base_s, ts_col
        self.table = SnapshotTable(spark, root, bloom=self.keys)

    # ------------------------------------------------------------------ partials
    def _merge(self, partials: DataFrame, cell: Column) -> DataFrame:
        aggs = [F.sum("rows").alias("rows"), F.max("last_ts").alias("last_ts")]
        for v in self.values:
            aggs += [F.sum(f"n_{v}").alias(f"n_{v}"), F.sum(f"sum_{v}").alias(f"sum_{v}"), F.min(f"min_{v}").alias(f"min_{v}"), F.max(f"max_{v}").alias(f"max_{v}")]
        return partials.groupBy(*self.keys, cell.alias(CELL)).agg(*aggs)

    def partials(self, samples: DataFrame) -> DataFrame:
        """One row per keys and base cell: ``rows, last_ts`` and ``n_v, sum_v, min_v, max_v`` of each value."""
        t = F.col(self.ts_col)
        aggs = [F.count(F.lit(1)).alias("rows"), F.max(t).cast("timestamp_ntz").alias("last_ts")]
        for v in self.values:
            c = F.col(v).cast("double")
            aggs += [F.count(c).alias(f"n_{v}"), F.sum(c).alias(f"sum_{v}"), F.min(c).alias(f"min_{v}"), F.max(c).alias(f"max_{v}")]
        return samples.where(t.isNotNull()).groupBy(*self.keys, bucket_start(t, self.base_s).alias(CELL)).agg(*aggs)

    # ------------------------------------------------------------------ writing
    def add(self, samples: DataFrame, token: str | None = None) -> None:
        """Loads the partials of ``samples``, once per token, and folds loads together where that is due."""
        self.table.load(self.partials(samples), token=token)
        self.fold()

    def fold(self) -> int:
        """Merges the newest loads of one size as long as there are ``FAN`` of them; returns how many loads were merged."""
        merged = 0
        while True:
            loads = self.table.entry()["loads"]
            k = len(loads) - 1
            while k and loads[k - 1]["rows"] < FAN * max(loads[-1]["rows"], 1):
                k -= 1
            due = [x["load"] for x in loads[k:]]
            if len(due) < FAN:
                return merged
            rows = self._merge(self.table.read_loads(due), F.col(CELL))
            by = [CELL, *self.keys]  # narrow zones; a batch itself is narrow, and sampling its bounds would compute it twice
            self.table.replace_loads(due, rows.repartitionByRange(*by).sortWithinPartitions(*by))
            merged += len(due)

    def writer(self, stream: str = "stream"):
        """foreachBatch function. ``stream`` names the query whose batch ids are the tokens."""
        def write(batch: DataFrame, batch_id: int) -> None:
            self.add(batch, f"{stream}-{batch_id}")
        return write

    # ------------------------------------------------------------------ answers
    def query(self, every_s: int | None = None, start=None, end=None, **of: Sequence) -> DataFrame:
        """``*keys, timestamp, rows, last_ts`` and ``n_v, sum_v, mean_v, min_v, max_v`` per bucket of ``every_s`` seconds, over the cells in
        [``start``, ``end``). ``of``: values that a key column may have. Buckets and bounds are whole base cells."""
        every_s = every_s or self.base_s
        if every_s % self.base_s:
            raise ValueError(f"{every_s} seconds are not whole cells of {self.base_s}")
        for bound in (start, end):
            if bound is not None and bound.replace(tzinfo=dt.timezone.utc).timestamp() % self.base_s:
                raise ValueError(f"{bound} is not the edge of a cell of {self.base_s} seconds")
        ranges = {} if start is None and end is None else {CELL: (start, end)}
        found = self.table.scan(ranges, of) if ranges or of else self.table.read()
        out = self._merge(found, bucket_start(CELL, every_s))
        per = [c for v in self.values for c in (F.col(f"n_{v}"), F.col(f"sum_{v}"), F.try_divide(F.col(f"sum_{v}"), F.col(f"n_{v}")).alias(f"mean_{v}"), F.col(f"min_{v}"), F.col(f"max_{v}"))]
        return out.select(*self.keys, F.col(CELL).alias("timestamp"), "rows", "last_ts", *per)
