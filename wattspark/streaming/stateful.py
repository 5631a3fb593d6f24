"""Series folded in event-time order with ``transformWithStateInPandas``.

Collectors send batches with jitter, so samples of a series arrive out of order and in different
micro-batches. Each series keeps its samples of the last ``delay`` in state. An event-time timer fires when the
watermark passes the oldest one. Then all samples up to the watermark are final: they are folded in order of
(time, value) and removed from state. Any arrival order within the delay therefore gives the result
of the batch operator (I2, I9) over the samples up to the watermark.

A sample that comes after its time has been folded can't be placed any more: it is counted (J4) or passed on
marked, without a rate (J3). Whole milliseconds are compared, as Spark's watermark has no finer unit: a time
between two of them belongs to the later one.

Each call to the state store costs as much as thousands of samples in an array, so state is kept per group of series
(a hash of the key, ``GROUPS`` of them): the series of a group share one packed value, and their samples
another one up to ``SMALL``. More of them go to slices (``MapState``: first time and number -> packed samples): a flush is sorted by
time and cut by the number of samples, at least ``SMALL`` each. Calls so grow with the groups and with samples / ``SMALL``, not with
series times batches, with the samples, nor with the span of time.

Memory: input rows are read frame by frame as Spark hands them over and flushed at ``FLUSH`` samples. Slices are read by their first
time, and what lies before the next one's is folded, so that about one slice of each flush is held at a time and neither a
backlog nor a hot host makes a frame of all its rows.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

ENERGY_OUT = "host string, energy_J double, energy_Wh double, samples long, late_samples long, last_ts timestamp"
RATE_OUT = "host string, timestamp timestamp, rate double, late boolean"
#: a group of series with at most so many buffered samples has no slices, and a slice has at least as many
SMALL = 16384
#: so many samples of a group are held in memory before they go to their slices
FLUSH = 1 << 19
#: groups of series; a checkpoint holds for one number of them
GROUPS = 128
#: no time yet
NEVER = -1 << 62

PACKED = "id binary, us binary, value binary"
KINDS = ("<i8", "<i8", "<f8")


def _packed(samples: tuple) -> tuple:
    return tuple(a.astype(kind).tobytes() for a, kind in zip(samples, KINDS))


def _unpack(have: tuple | None) -> tuple:
    return tuple(np.frombuffer(have[i] if have else b"", kind) for i, kind in enumerate(KINDS))


def _joined(parts: list[tuple]) -> tuple:
    return tuple(np.concatenate(a) for a in zip(*parts)) if parts else _unpack(None)


class Series:
    """The series of a group: ``host`` names, and per series an array entry of each of ``COMMON`` and of the operator's own
    fields (name -> value at first). ``id`` is what buffered samples refer to, ascending."""

    COMMON = {"id": 0, "folded_ms": NEVER, "newest_us": NEVER, "last_us": NEVER, "last": 0.0}

    def __init__(self, own: dict, have: tuple | None):
        self.first = self.COMMON | own
        self.host, self.next = [], 0
        self.at = {k: np.zeros(0, "<f8" if isinstance(v, float) else "<i8") for k, v in self.first.items()}
        if have:
            stored = np.load(io.BytesIO(have[0]), allow_pickle=False)
            self.at = {k: stored[k] for k in self.first}
            ends = np.cumsum(stored["length"]).tolist()
            names = stored["names"].tobytes()
            self.host = [names[a:b].decode() if known else None for a, b, known in zip([0, *ends], ends, stored["known"].tolist())]
            self.next = int(stored["next"])
        self.row = {h: i for i, h in enumerate(self.host)}

    def packed(self) -> tuple:
        names = [(h or "").encode() for h in self.host]
        out = io.BytesIO()
        np.savez(out, names=np.frombuffer(b"".join(names), "u1"), length=np.array([len(x) for x in names], "<i8"), known=np.array([h is not None for h in self.host], bool), next=self.next, **self.at)
        return (out.getvalue(),)

    def rows(self, hosts: pd.Series) -> np.ndarray:
        """The place of each sample's series; new ones are added."""
        codes, names = pd.factorize(hosts, use_na_sentinel=False)
        names = [h if isinstance(h, str) else None for h in names]
        new = [h for h in names if h not in self.row]
        if new:
            self.row.update((h, len(self.host) + i) for i, h in enumerate(new))
            self.host += new
            self.at = {k: np.concatenate([a, np.full(len(new), self.first[k], a.dtype)]) for k, a in self.at.items()}
            self.at["id"][-len(new):] = np.arange(self.next, self.next + len(new))
            self.next += len(new)
        return np.array([self.row[h] for h in names], "<i8")[codes]

    def of(self, ids: np.ndarray) -> np.ndarray:
        """The places of ids."""
        return np.searchsorted(self.at["id"], ids)

    def keep(self, stay: np.ndarray) -> None:
        self.host = [h for h, k in zip(self.host, stay.tolist()) if k]
        self.at = {k: a[stay] for k, a in self.at.items()}
        self.row = {h: i for i, h in enumerate(self.host)}

    def names(self, rows: np.ndarray) -> np.ndarray:
        return np.array(self.host, object)[rows]


class Ordered:
    """Samples of a group in order of (series, time, value): ``row`` of the series, ``us``, ``value``, the places where a series
    starts, and of each sample the time and value before it (of the first one ever: its own)."""

    def __init__(self, series: Series, row: np.ndarray, us: np.ndarray, value: np.ndarray):
        self.row, self.us, self.value = row, us, value
        self.starts = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        self.ends = np.concatenate([self.starts[1:], [len(row)]]) - 1
        self.series = row[self.starts]  # each once
        seen = series.at["last_us"][self.series] != NEVER
        self.prev_us, self.prev = np.concatenate([us[:1], us[:-1]]), np.concatenate([value[:1], value[:-1]])
        self.prev_us[self.starts] = np.where(seen, series.at["last_us"][self.series], us[self.starts])
        self.prev[self.starts] = np.where(seen, series.at["last"][self.series], value[self.starts])


class OrderedProcessor(StatefulProcessor):
    """Buffers samples and hands those that the watermark makes final to ``fold``, in order.

    Input: ``host, us, value`` of a group of series. ``progress`` holds the time of the pending timer (-1: none) and
    the number of the next slice (0: there are none). A series has the watermark up to which it has been folded. With
    ``forget_ms`` a series without samples for that long loses its state; ``small`` is how many samples of a group
    are buffered in one value, ``flush`` how many are held in memory.
    """

    #: fields of a series besides the common ones
    OWN: dict = {}

    def __init__(self, forget_ms: int | None = None, small: int = SMALL, flush: int = FLUSH):
        self.forget_ms, self.most, self.flush = forget_ms, small, flush

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.series = handle.getValueState("series", "packed binary")
        self.small = handle.getValueState("small", PACKED)
        self.buffer = handle.getMapState("buffer", "first_us long, number long", PACKED)
        self.progress = handle.getValueState("progress", "timer_ms long, slices long")

    # ---- what an operator adds
    def fold(self, series: Series, x: Ordered) -> pd.DataFrame | None:
        raise NotImplementedError

    def late(self, series: Series, row: np.ndarray, us: np.ndarray) -> pd.DataFrame | None:
        raise NotImplementedError

    def done(self, series: Series, rows: np.ndarray) -> pd.DataFrame | None:
        """Output after a round of folds, for the series that were folded."""
        return None

    # ---- buffering
    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        series = Series(self.OWN, self.series.get())
        pending, slices = self.progress.get() or (-1, 0)
        held = [_unpack(self.small.get())]  # what is in, or goes to, the small buffer
        oldest, changed = None, False
        for pdf in rows:
            pdf = pdf.dropna(subset=["us", "value"])
            if not len(pdf):
                continue
            changed = True
            us, value = pdf["us"].to_numpy(dtype="int64"), pdf["value"].to_numpy(dtype="float64")
            row = series.rows(pdf["host"])
            ms = -(-us // 1000)
            old = ms <= series.at["folded_ms"][row]
            if old.any():
                out = self.late(series, row[old], us[old])
                if out is not None:
                    yield out
                row, us, value, ms = row[~old], us[~old], value[~old], ms[~old]
            if not len(us):
                continue
            np.maximum.at(series.at["newest_us"], row, us)
            oldest = int(ms.min()) if oldest is None else min(oldest, int(ms.min()))
            held.append((series.at["id"][row], us, value))
            if sum(len(x[1]) for x in held) > self.flush:
                slices = self._slice(_joined(held), slices)
                held = []
        if changed:
            self.series.update(series.packed())
        if oldest is None:
            return
        if sum(len(x[1]) for x in held) > self.most:
            slices = self._slice(_joined(held), slices)
            held = []
        self._keep_small(_joined(held))
        want = max(oldest if pending < 0 else min(oldest, pending), 0)
        if pending != want:
            if pending >= 0:
                self.handle.deleteTimer(pending)
            self.handle.registerTimer(want)
        self.progress.update((want, slices))

    def _keep_small(self, samples: tuple) -> None:
        if len(samples[1]):
            self.small.update(_packed(samples))
        else:
            self.small.clear()

    def _slice(self, samples: tuple, slices: int) -> int:
        """Adds samples as slices, cut by time into equal numbers; returns the number of the next slice."""
        order = np.argsort(samples[1], kind="stable")
        for at in np.array_split(order, max(len(order) // max(self.most, 1), 1)):
            self.buffer.updateValue((int(samples[1][at[0]]), slices), _packed(tuple(a[at] for a in samples)))
            slices += 1
        return slices

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = int(timerValues.getCurrentWatermarkInMs())
        series = Series(self.OWN, self.series.get())
        _, slices = self.progress.get()
        rest = _unpack(self.small.get())
        folded = np.zeros(len(series.host), bool)
        todo = sorted((int(k[0]), int(k[1])) for k in self.buffer.keys()) if slices else []
        due = sum(first <= mark * 1000 for first, _ in todo)
        held, size, most = [rest], len(rest[1]), self.most
        for first, number in todo[:due]:
            if size > most:  # all that lies before this slice is here
                out, rest = self._fold_until(series, first - 1, _joined(held), folded)
                held, size = [rest], len(rest[1])
                most = max(self.most, 2 * size)
                if out is not None:
                    yield out
            held.append(_unpack(self.buffer.getValue((first, number))))
            size += len(held[-1][1])
            self.buffer.removeKey((first, number))
        out, rest = self._fold_until(series, mark * 1000, _joined(held), folded)
        if out is not None:
            yield out
        todo = todo[due:]
        # the time that the next timer waits for
        waits = [int(rest[1].min())] if len(rest[1]) else []
        waits += [todo[0][0]] if todo else []
        nxt = -(-min(waits) // 1000) if waits else None
        if not todo:
            slices = 0
        if len(rest[1]) > self.most:
            slices = self._slice(rest, slices)
            rest = _unpack(None)
        self._keep_small(rest)
        series.at["folded_ms"][folded] = mark
        if folded.any():
            out = self.done(series, np.flatnonzero(folded))
            if out is not None:
                yield out
        if self.forget_ms is not None:
            until = series.at["last_us"] // 1000 + self.forget_ms
            idle = (-(-series.at["newest_us"] // 1000) <= mark) & (series.at["last_us"] != NEVER)
            gone = idle & (until <= mark)  # silent for so long
            if (idle & ~gone).any():
                soon = int(until[idle & ~gone].min())
                nxt = soon if nxt is None else min(nxt, soon)
            if gone.any():
                series.keep(~gone)
        if nxt is None and not series.host:
            self.series.clear()
            self.progress.clear()
            return
        self.series.update(series.packed())
        if nxt is not None:
            nxt = int(max(nxt, mark + 1))
            self.handle.registerTimer(nxt)
        self.progress.update((-1 if nxt is None else nxt, slices))

    def _fold_until(self, series: Series, until_us: int, samples: tuple, folded: np.ndarray):
        """(output, later samples) of the samples up to ``until_us``; marks their series as folded."""
        final = samples[1] <= until_us
        later = tuple(a[~final] for a in samples)
        if not final.any():
            return None, later
        ids, us, value = (a[final] for a in samples)
        row = series.of(ids)
        order = np.lexsort((value, us, row))
        x = Ordered(series, row[order], us[order], value[order])
        out = self.fold(series, x)
        series.at["last_us"][x.series], series.at["last"][x.series] = x.us[x.ends], x.value[x.ends]
        folded[x.series] = True
        return out, later

    def close(self) -> None:
        pass


class EnergyProcessor(OrderedProcessor):
    """Running trapezoid energy per host: the sum of (p_i + p_{i-1}) / 2 * dt_i over positive whole-millisecond steps."""

    OWN = {"total_j": 0.0, "n": 0, "late": 0}

    def fold(self, series, x):
        dt_ms = (x.us - x.prev_us) // 1000
        energy = np.where(dt_ms > 0, (x.value + x.prev) / 2.0 * (dt_ms / 1000.0), 0.0)
        series.at["total_j"][x.series] += np.add.reduceat(energy, x.starts)
        series.at["n"][x.series] += x.ends - x.starts + 1

    def late(self, series, row, us):
        np.add.at(series.at["late"], row, 1)
        return self.done(series, np.unique(row))

    def done(self, series, rows):
        at = {k: series.at[k][rows] for k in ("last_us", "total_j", "n", "late")}
        last = pd.Series(pd.to_datetime(np.where(at["last_us"] == NEVER, 0, at["last_us"]), unit="us")).mask(at["last_us"] == NEVER)
        return pd.DataFrame({"host": series.names(rows), "energy_J": at["total_j"], "energy_Wh": at["total_j"] / 3600.0, "samples": at["n"], "late_samples": at["late"],
                             "last_ts": last})


class CounterRateProcessor(OrderedProcessor):
    """Per-series counter -> clipped increment since the previous sample (reset -> 0)."""

    def fold(self, series, x):
        rate = np.clip(x.value - x.prev, 0, None)
        if self.forget_ms is not None:  # a new series after the silence, whether or not the state was dropped by then
            rate[(x.us - x.prev_us) // 1000 >= self.forget_ms] = 0.0
        return pd.DataFrame({"host": series.names(x.row), "timestamp": pd.to_datetime(x.us, unit="us"), "rate": rate, "late": False})

    def late(self, series, row, us):
        return pd.DataFrame({"host": series.names(row), "timestamp": pd.to_datetime(us, unit="us"), "rate": np.full(len(us), np.nan), "late": True})


def _series(samples: DataFrame, key: str, delay: str):
    """Samples by group of series, with the watermark on whole milliseconds (rounded up). Late rows must reach the processors to be
    counted, so the time that carries the watermark is not among their columns."""
    us = F.unix_micros(F.col("timestamp").cast("timestamp"))
    mark = F.timestamp_millis(F.ceil(us / F.lit(1000)).cast("long"))
    rows = samples.withColumn("event_time", mark).withWatermark("event_time", delay)
    host = F.col(key).cast("string")
    group = F.pmod(F.xxhash64(host), F.lit(GROUPS)).cast("int").alias("series_group")
    return rows.select(group, host.alias("host"), us.alias("us"), F.col("value").cast("double").alias("value")).groupBy("series_group")


def stream_energy(samples: DataFrame, key: str = "host", delay: str = "0 seconds", small: int = SMALL) -> DataFrame:
    """Running energy per key over the samples that are final (update mode: the newest total per key each batch).
    ``delay``: how far behind the newest sample one may arrive."""
    return (_series(samples, key, delay)
            .transformWithStateInPandas(EnergyProcessor(small=small), ENERGY_OUT, "Update", "EventTime"))


def stream_counter_rate(samples: DataFrame, key: str = "host", delay: str = "0 seconds", forget_ms: int | None = None, small: int = SMALL) -> DataFrame:
    """Per-key counter increments (append mode), each emitted once it is final. ``forget_ms``: state of a key that is
    silent for so long is dropped; its next sample starts a new series."""
    return (_series(samples, key, delay)
            .transformWithStateInPandas(CounterRateProcessor(forget_ms, small), RATE_OUT, "Append", "EventTime"))
