"""Stays of tracks whose points arrive late and in any order.

A track's points wait in state until the watermark has passed them; then they're
folded in order of time (:class:`medialake.operators.sequences.StayFold`), and stays leave as soon as
no later point can change them. One timer a track wakes it: at its earliest waiting
point, or when it has been silent for ``idle_s``, which ends the track. State
holds the running sums, the current stay's points (a list that is only appended
to until the stay ends), and the waiting points, which the watermark's delay bounds.

The session's state store must be RocksDB's, as ``transformWithState`` asks.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from medialake.operators.sequences import StayFold

_SUMMARY = "n long, sum_lat double, sum_lon double, start double, t double, lat double, lon double, has_pending boolean, p_start double, p_end double, p_lat double, p_lon double, p_alt double, timer long"
_POINT = "lat double, lon double, alt double"
_OUT = ["start", "end", "lat", "lon", "alt"]
#: The summary of a track none of whose points is folded yet, without its timer.
_NEW = (0, 0.0, 0.0, None, None, None, None, False, *[None] * 5)


def _known(x: float | None) -> float | None:
    return None if x is None or pd.isna(x) else float(x)


class StayProcessor(StatefulProcessor):
    def __init__(self, by: list[str], radius_m: float, merge_s: float, idle_s: float):
        self.by, self.how, self.idle_s = by, (radius_m, merge_s, idle_s), idle_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.summary = handle.getValueState("summary", _SUMMARY)
        self.current = handle.getListState("current", _POINT)
        self.waiting = handle.getListState("waiting", f"t double, {_POINT}")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = [(float(t), float(lat), float(lon), _known(alt)) for df in rows for t, lat, lon, alt in zip(df["time"], df["lat"], df["lon"], df["alt"])]
        if new:
            self.waiting.appendList(new)
        now_ms = timerValues.getCurrentWatermarkInMs()
        old = self.summary.get()
        timer = old[-1] if old else None
        first = min((p[0] for p in new), default=None)
        if first is not None and first >= now_ms / 1000 and (timer is None or timer > now_ms):
            # Nothing is due, neither of these points nor of those that wait: they only wait with them, and are not read.
            wake = max(int(first * 1000) + 1, now_ms + 1)
            if timer is None or wake < timer:
                if timer is not None:
                    self.handle.deleteTimer(timer)
                self.handle.registerTimer(wake)
                self.summary.update((*(old[:-1] if old else _NEW), wake))
            return
        # The points that the watermark has passed by now are folded with the others that wait.
        yield from self._advance(key, now_ms, old)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._advance(key, timerValues.getCurrentWatermarkInMs(), self.summary.get(), fired=expiredTimerInfo.getExpiryTimeInMs())

    def _advance(self, key, now_ms: int, old: tuple | None, fired: int | None = None) -> Iterator[pd.DataFrame]:
        now = now_ms / 1000
        held = [tuple(p) for p in self.waiting.get()]
        ready = sorted((p for p in held if p[0] < now), key=lambda p: p[:3])
        rest = [p for p in held if p[0] >= now]
        fold = StayFold(*self.how, earlier=lambda: [tuple(p) for p in self.current.get()] if old and old[0] else [])
        timer = None
        if old:
            n, a, b, start, t, lat, lon, has, *pending, timer = old
            fold.n, fold.sums, fold.start, fold.last = n, (a, b), start, (t, lat, lon) if n else None
            fold.pending = (*pending[:4], _known(pending[4])) if has else None
        out = [s for p in ready for s in fold.add(*p[:3], _known(p[3]))]
        if fold.n and now > fold.last[0] + self.idle_s:
            out += fold.close()
        if ready and rest:
            self.waiting.put(rest)
        elif ready:
            self.waiting.clear()
        if fold.ended and old and old[0]:
            self.current.clear()
        if fold.points:
            self.current.appendList(fold.points)
        # Past the moment that it waits for, as a timer fires at the watermark itself.
        moments = [p[0] for p in rest] + ([fold.last[0] + self.idle_s] if fold.n else [])
        wake = int(min(moments) * 1000) + 1 if moments else None
        if timer is not None and timer not in (fired, wake):
            self.handle.deleteTimer(timer)
        if wake is not None and (wake != timer or wake == fired):
            self.handle.registerTimer(max(wake, now_ms + 1))
            wake = max(wake, now_ms + 1)
        if wake is None:
            self.summary.clear()
        else:
            pending = fold.pending or (None,) * 5
            self.summary.update((fold.n, *fold.sums, fold.start, *(fold.last or (None,) * 3), fold.pending is not None, *pending, wake))
        if out:
            yield pd.DataFrame([[*key, *s] for s in out], columns=[*self.by, *_OUT]).astype({"alt": "float64"})

    def close(self) -> None:
        pass


def stay_stream(points: DataFrame, by: list[str], time: str = "ts", late: str = "1 hour", *, radius_m: float = 500.0, merge_s: float = 2700.0, idle_s: float = 6 * 3600.0) -> DataFrame:
    """(by, start, end, lat, lon, alt) of a stream of points (``time`` column, ``lat``, ``lon``, ``alt``), in append mode.

    Points later than ``late`` behind the latest one are dropped, as are those without time or place. The same
    points in any order and any batches give the stays of :func:`medialake.operators.sequences.stays` with the same ``idle_s``.
    """
    known = points.where(F.col(time).isNotNull() & F.col("lat").isNotNull() & F.col("lon").isNotNull() & ~F.isnan("lat") & ~F.isnan("lon"))
    seconds = F.unix_micros(F.col(time).cast("timestamp")) / 1_000_000
    rows = known.withWatermark(time, late).select(*by, time, seconds.alias("time"), F.col("lat").cast("double"), F.col("lon").cast("double"), F.col("alt").cast("double"))
    fields = ", ".join(f"`{c}` {points.schema[c].dataType.simpleString()}" for c in by)
    return rows.groupBy(*by).transformWithStateInPandas(StayProcessor(by, radius_m, merge_s, idle_s), f"{fields}, start double, `end` double, lat double, lon double, alt double", "append", "EventTime")
