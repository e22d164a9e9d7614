"""Folds over ordered points of a group, which depend on what was kept so far.

*Spikes and runs.* Whether a point is kept depends on the last one kept, which is the
one before it or the one before that, and on whether that one is its run's first: four
states. So points are dealt to blocks, each block is walked from all four states at once, the blocks'
outcomes are put together in order (a row for each block), and each block is walked again from the state that it
really begins in. A history of any length is many tasks' work.

*Stays* keep a running mean, which has no few states: a track is one task's, point by point as its batches
come, and a task has many; longer histories are split by date.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import reduce
from itertools import repeat
from statistics import median

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from medialake.operators.ranks import numbered
from medialake.session import written

R = 6_371_000.0


def metres(a: float, b: float, c: float, d: float) -> float:
    h = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2
    return 2 * R * math.asin(min(1.0, math.sqrt(h)))


#: Points of a block.
BLOCK = 4096
#: States: how far back the last kept point lies (one or two points) and whether its run has more than one. 0: no point yet.
_STATES = [None, (1, False), (1, True), (2, False), (2, True)]
_KEEP, _SKIP, _RESTART, _JUMP = range(4)


def _step(near: tuple, state: tuple[int, bool] | None) -> tuple[int, tuple[int, bool]]:
    """What becomes of a point, and the state after it. ``near``: whether it's in reach of the first and second point before it, and the next one of the first, second and third before that."""
    if state is None:
        return _KEEP, (1, False)
    back, more = state
    if near[back - 1]:
        return _KEEP, (1, True)
    if near[back + 2]:
        return _SKIP, (2, more)
    if not more and near[2]:
        return _RESTART, (1, False)
    return _JUMP, (1, False)


#: Of the five bits of ``near`` and a state: the state after a point and, times eight, what becomes of it.
_AFTER = np.array([[_STATES.index(state) + 8 * what for what, state in (_step(tuple(bits >> i & 1 for i in range(5)), s) for s in _STATES)] for bits in range(32)])
#: The same where a jump doesn't end a run.
_AFTER_KEPT = np.where(_AFTER >> 3 == _JUMP, _STATES.index((1, True)), _AFTER)


class _Walk:
    """The steps over the points of many blocks, one after the other, each with two points before it and three after."""

    def __init__(self, table: pa.Table, position: list[str], reach, on_jump: bool, block: int):
        at, of = table["_at"].to_numpy(), table["_block"].to_numpy()
        n = len(at)
        # A block's points are numbered without gaps, so another one begins where they aren't.
        starts = np.ones(n, bool)
        starts[1:] = (at[1:] != at[:-1] + 1) | (of[1:] != of[:-1])
        self.segment = np.cumsum(starts) - 1
        inside = np.arange(n) - np.flatnonzero(starts)[self.segment]
        self.own, self.late, self.entry = at // block == of, at >= of * block, np.flatnonzero(at == of * block)
        self.first, self.after = at[self.entry] == 0, _AFTER if on_jump else _AFTER_KEPT
        values = [table[c].to_numpy() for c in position]
        near = np.zeros((4, n + 1), bool)
        for d in (1, 2, 3):
            near[d, d:n] = np.asarray(reach([v[:-d] for v in values], [v[d:] for v in values]), bool) if n > d else False
            near[d, :n] &= inside >= d
        # The next point, if it's of the same block.
        ahead = near[:, 1:] & ~np.append(starts[1:], True)
        self.bits = near[1, :n] + 2 * near[2, :n] + 4 * ahead[1] + 8 * ahead[2] + 16 * ahead[3]

    def steps(self, states) -> tuple[np.ndarray, np.ndarray]:
        """What becomes of each point, and the state after it, if the blocks begin in ``states``."""
        codes = self.bits.copy()
        codes[self.entry] = 32 + self.after[self.bits[self.entry], np.where(self.first, 0, states)]
        table = [*self.after.tolist(), *([x] * len(_STATES) for x in range(32))]
        out, x = [], 0
        for code in codes.tolist():
            x = table[code][x & 7]
            out.append(x)
        found = np.array(out, np.int64)
        return found >> 3, found & 7


def _metres(a, b, c, d) -> np.ndarray:
    a, b, c, d = (np.radians(x) for x in (a, b, c, d))
    return 2 * R * np.arcsin(np.minimum(1.0, np.sqrt(np.sin((c - a) / 2) ** 2 + np.cos(a) * np.cos(c) * np.sin((d - b) / 2) ** 2)))


def hop(a: Sequence, b: Sequence) -> np.ndarray:
    """Whether a camera gets from one (seconds, latitude, longitude) to another, or from each of many: at most 300 m/s, 2 km in a short time; always without times."""
    (t, *here), (u, *there) = ([np.asarray(x, float) for x in p] for p in (a, b))
    with np.errstate(invalid="ignore", divide="ignore"):
        d, s = _metres(*here, *there), np.abs(u - t)
        return ~np.isnan(d) & ((d < 1) | np.isnan(t) | np.isnan(u) | np.where(s <= 0.75, d <= 2000, d / s <= 300))


def within(most: float):
    """The reach of positions on a line."""
    return lambda a, b: abs(a[0] - b[0]) <= most


def _in_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows again, cut between blocks: the last block of a batch waits for its other rows."""
    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch] if rest is None else [*rest.to_batches(), batch]).combine_chunks()
        at, of = table["_at"].to_numpy(), table["_block"].to_numpy()
        cuts = np.flatnonzero((at[1:] != at[:-1] + 1) | (of[1:] != of[:-1])) + 1
        if len(cuts):
            yield table.slice(0, cuts[-1]).combine_chunks()
        rest = table.slice(cuts[-1]).combine_chunks() if len(cuts) else table
    if rest is not None and rest.num_rows:
        yield rest


def _walked(rows: DataFrame, by: list[str], order: list[str], position: list[str], reach, on_jump: bool, block: int) -> DataFrame:
    """The kept rows with ``_run``, the number of a point's run.

    A task walks its blocks in one go, however small they are. Histories of more than a block are walked twice.
    """
    placed = numbered(rows, by, [F.col(c).asc_nulls_last() for c in order], "_at")
    own = F.floor(F.col("_at") / block)
    last, first = F.col("_at") % block >= block - 2, F.col("_at") % block < 3
    blocks = F.array_compact(F.array(own, F.when(last, own + 1), F.when(first & (own > 0), own - 1)))
    dealt = written(placed.withColumn("_block", F.explode(blocks)), "blocks")
    keys, columns = [rows.schema[c] for c in by], rows.columns
    together = lambda df: df.repartition(*by, "_block").sortWithinPartitions(*by, "_block", "_at")
    named = lambda df: df.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)], *[c for c in df.columns if c not in by])
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(by)])
    found_schema = T.StructType([*keys, T.StructField("_block", T.LongType()), T.StructField("_to", T.ArrayType(T.LongType())), T.StructField("_jumps", T.ArrayType(T.LongType()))])

    def outcomes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        to = to_arrow_schema(found_schema)
        for table in _in_blocks(batches):
            w = _Walk(table, position, reach, on_jump, block)
            ends = np.flatnonzero(w.own)
            ends = ends[np.append(w.segment[ends][1:] != w.segment[ends][:-1], True)] if len(ends) else ends
            after, jumps = [], []
            for state in range(len(_STATES)):
                what, left = w.steps(state)
                after.append(left[ends])
                jumps.append(np.bincount(w.segment, (what == _JUMP) & w.own, w.segment[-1] + 1)[w.segment[ends]].astype(np.int64))
            lists = [pa.array(list(np.array(x).T), pa.list_(pa.int64())) for x in (after, jumps)]
            held = table.select([*by, "_block"]).take(pa.array(ends)).columns
            yield pa.RecordBatch.from_arrays([*[c.combine_chunks().cast(f.type) for c, f in zip(held, to)], *[x.cast(to.field(i).type) for x, i in zip(lists, (-2 + len(to), -1 + len(to)))]], schema=to)

    def begins(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values("_block")
        state, runs, out = 0, 0, []
        for to, jumps in df[["_to", "_jumps"]].itertuples(index=False):
            out.append((state, runs))
            state, runs = int(to[state]), runs + int(jumps[state])
        return df[[*by, "_block"]].assign(_state=[s for s, _ in out], _runs=[r for _, r in out])

    long = written(dealt.where((F.col("_at") == block) & (F.col("_block") == 1)).select(*by), "long")
    if long.isEmpty():
        entered = dealt.withColumns({"_state": F.lit(0).cast("long"), "_runs": F.lit(0).cast("long")})
    else:
        found = written(together(dealt.join(named(long), same, "left_semi")).mapInArrow(outcomes, found_schema), "outcomes")
        known = found.groupBy(*by).applyInPandas(begins, T.StructType([*found_schema.fields[:-2], T.StructField("_state", T.LongType()), T.StructField("_runs", T.LongType())]))
        entry = written(named(known.withColumnRenamed("_block", "_b")), "entries")
        entered = dealt.join(entry, same & (F.col("_block") == F.col("_b")), "left").select(*dealt.columns, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("_state", "_runs")])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _in_blocks(batches):
            w = _Walk(table, position, reach, on_jump, block)
            what, after = w.steps(table["_state"].to_numpy()[w.entry])
            kept = w.own & (what != _SKIP)
            again = np.flatnonzero((what == _RESTART) & w.late)
            again = again[~np.isin(again, w.entry)]
            kept[again - np.where(after[again - 1] > 2, 2, 1)] = False
            jumps = (what == _JUMP) & w.own
            runs = np.cumsum(jumps)
            before = np.zeros(w.segment[-1] + 1, np.int64)
            before[w.segment[w.entry]] = runs[w.entry] - jumps[w.entry]
            run = table["_runs"].to_numpy() + runs - before[w.segment]
            yield from table.select(columns).append_column("_run", pa.array(run, pa.int64())).filter(pa.array(kept)).to_batches()

    return together(entered).mapInArrow(fold, T.StructType([*rows.schema.fields, T.StructField("_run", T.LongType())]))


def drop_spikes(rows: DataFrame, by: list[str], order: list[str], position: list[str], reach=hop, block: int = BLOCK) -> DataFrame:
    """Drops a point out of reach of the last kept one if the next is within its reach, and a bad first point.

    ``position`` names what ``reach`` is given of points and of others, as arrays: (seconds, latitude, longitude) for :func:`hop`.
    """
    return _walked(rows, by, order, position, reach, False, block).drop("_run")


def plausible_runs(rows: DataFrame, by: list[str], order: list[str], position: list[str], reach=hop, block: int = BLOCK) -> DataFrame:
    """As :func:`drop_spikes`, but any other jump begins a new ``run``; runs of one point go unless there is no other (then the last one stays)."""
    walked = written(_walked(rows, by, order, position, reach, True, block), "walked")
    sizes = walked.groupBy(*by, "_run").agg(F.count("*").alias("_n"))
    of_group = sizes.groupBy(*by).agg(F.max("_n").alias("_most"), F.max("_run").alias("_last"))
    same = lambda columns: reduce(lambda a, b: a & b, [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in columns])
    stay = sizes.alias("l").join(of_group.alias("r"), same(by)).where((F.col("_n") > 1) | (F.col("_most") == 1) & (F.col("_run") == F.col("_last"))).select("l.*")
    kept = walked.alias("l").join(stay.alias("r"), same([*by, "_run"]), "left_semi")
    return kept.withColumnRenamed("_run", "run")


def cluster_line(rows: DataFrame, by: list[str], order: list[str], value: str, radius: float) -> DataFrame:
    """Adds ``stay``: a point within ``radius`` of the running centre or of the last point stays in the cluster."""
    schema = T.StructType([*rows.schema.fields, T.StructField("stay", T.LongType())])

    def fold(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values(order, kind="stable")
        out, stay, n, total, last = [], 0, 0, 0.0, None
        for x in df[value]:
            if n and abs(x - total / n) > radius and abs(x - last) > radius:
                stay, n, total = stay + 1, 0, 0.0
            out.append(stay)
            n, total, last = n + 1, total + x, x
        df["stay"] = out
        return df

    return rows.groupBy(*by).applyInPandas(fold, schema)


class StayFold:
    """Stays of one track, point by point in order of time.

    A point within ``radius_m`` of the current stay's mean or of its last point
    belongs to it; any other ends it. A stay has the median place of its points; within
    ``radius_m`` of the stay before and at most ``merge_s`` later it joins that one. After ``idle_s``
    without a point the track ends and another begins. ``earlier`` gives the
    current stay's points that were kept elsewhere; it's asked when the stay ends.
    """

    def __init__(self, radius_m: float, merge_s: float, idle_s: float | None = None, earlier=list):
        self.radius_m, self.merge_s, self.idle_s, self.earlier = radius_m, merge_s, idle_s, earlier
        self.n, self.sums, self.start, self.last = 0, (0.0, 0.0), None, None
        self.points: list[tuple] = []
        self.pending: tuple | None = None
        self.ended = False

    def add(self, t: float, lat: float, lon: float, alt: float | None) -> list[tuple]:
        """The stays (start, end, latitude, longitude, altitude) that are final now."""
        out = []
        if self.n:
            if self.idle_s is not None and t - self.last[0] > self.idle_s:
                out = self.close()
            elif metres(self.sums[0] / self.n, self.sums[1] / self.n, lat, lon) > self.radius_m and metres(*self.last[1:], lat, lon) > self.radius_m:
                out = self._end()
        if not self.n:
            self.start = t
        self.points.append((lat, lon, alt))
        self.n, self.sums, self.last = self.n + 1, (self.sums[0] + lat, self.sums[1] + lon), (t, lat, lon)
        return out

    def _end(self) -> list[tuple]:
        rows = [*self.earlier(), *self.points]
        alts = [a for *_, a in rows if a is not None and not math.isnan(a)]
        stay = (self.start, self.last[0], median(r[0] for r in rows), median(r[1] for r in rows), median(alts) if alts else None)
        self.n, self.sums, self.points, self.earlier, self.ended = 0, (0.0, 0.0), [], list, True
        before = self.pending
        if before and stay[0] - before[1] <= self.merge_s and metres(before[2], before[3], stay[2], stay[3]) <= self.radius_m:
            self.pending = (before[0], max(before[1], stay[1]), (before[2] + stay[2]) / 2, (before[3] + stay[3]) / 2, before[4] if stay[4] is None else stay[4])
            return []
        self.pending = stay
        return [before] if before else []

    def close(self) -> list[tuple]:
        out = self._end() if self.n else []
        last, self.pending = self.pending, None
        return [*out, last] if last else out


def stays(rows: DataFrame, by: list[str], radius_m: float = 500.0, merge_s: float = 2700.0, idle_s: float | None = None) -> DataFrame:
    """Stays of tracks (``time`` in seconds, ``lat``, ``lon``, and ``alt`` if there is one): first and last time, median place and altitude (see :class:`StayFold`)."""
    alt = ["alt"] if "alt" in rows.columns else []
    schema = T.StructType([*[rows.schema[c] for c in by], *[T.StructField(c, T.DoubleType()) for c in ("start", "end", "lat", "lon", "alt")]])
    values = [F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))).alias(f"_{c}") for c in ("time", "lat", "lon", *alt)]
    tracks = rows.select(*by, *values).repartition(*by).sortWithinPartitions(*by, "_time", "_lat", "_lon")
    same = lambda a, b: all(x == y or x != x and y != y for x, y in zip(a, b))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        to, n = to_arrow_schema(schema), len(by)
        key, track, out = None, None, []

        def flush() -> pa.RecordBatch:
            found = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), to)] if out else [pa.array([], f.type) for f in to], schema=to)
            out.clear()
            return found

        for batch in batches:
            points = zip(*[batch.column(i).to_numpy(zero_copy_only=False).tolist() for i in range(n, batch.num_columns)])
            for own, p in zip(zip(*[batch.column(i).to_pylist() for i in range(n)]) if n else repeat(()), points):
                if track is None or not same(own, key):
                    out += [(*key, *s) for s in track.close()] if track else []
                    key, track = own, StayFold(radius_m, merge_s, idle_s)
                out += [(*key, *s) for s in track.add(*p, *[None] * (not alt))]
            yield flush()
        if track:
            out += [(*key, *s) for s in track.close()]
            yield flush()

    return tracks.mapInArrow(fold, schema)
