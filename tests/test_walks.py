"""Spikes and runs of long histories beside the loop that they follow."""

import random

import pytest

from medialake.operators import sequences as Q


def loop(values, reach, on_jump):
    """The run of each point, None if it's dropped."""
    runs = []
    run, kept, last = 0, 0, None
    for i, x in enumerate(values):
        ahead = values[i + 1] if i + 1 < len(values) else None
        if last is None or reach(values[last], x):
            pass
        elif ahead is not None and reach(values[last], ahead):
            runs.append(None)
            continue
        elif kept == 1 and ahead is not None and reach(x, ahead):
            runs[last], kept = None, 0
        elif on_jump:
            run, kept = run + 1, 0
        runs.append(run)
        kept, last = kept + 1, i
    return runs


def line(seed, n):
    rng = random.Random(seed)
    x, out = 0.0, []
    for _ in range(n):
        x += rng.choice([0, 0, 1, 1, 8, -8, 20, -20])
        out.append(x + rng.choice([0, 0, 0, 15, -15]))
    return out


@pytest.mark.parametrize("block", [3, 5, 4096])
def test_as_the_loop_has_it(spark, block):
    groups = {k: line(seed, n) for seed, (k, n) in enumerate([("hot", 400), ("b", 37), (None, 11), ("one", 1), ("two", 2), ("three", 3)])}
    rows = spark.createDataFrame([(k, i, v, f"x{i}") for k, vs in groups.items() for i, v in enumerate(vs)], "k string, i int, v double, note string").repartition(5)
    reach = Q.within(10.0)
    kept, expected_kept, runs, expected_runs = {}, {}, {}, {}
    for r in Q.drop_spikes(rows, ["k"], ["i"], ["v"], reach, block).collect():
        kept.setdefault(r["k"], set()).add(r["i"])
    for r in Q.plausible_runs(rows, ["k"], ["i"], ["v"], reach, block).collect():
        runs.setdefault(r["k"], {})[r["i"]] = r["run"]
    for k, vs in groups.items():
        values = [(v,) for v in vs]
        expected_kept[k] = {i for i, r in enumerate(loop(values, reach, False)) if r is not None}
        own = loop(values, reach, True)
        sizes = {r: own.count(r) for r in set(own) - {None}}
        stay = {r for r, n in sizes.items() if n > 1} or {max(sizes)}
        expected_runs[k] = {i: r for i, r in enumerate(own) if r in stay}
    assert kept == expected_kept and runs == expected_runs
    assert len(expected_kept["hot"]) < 400 and len(set(expected_runs["hot"].values())) > 3


def test_positions_without_time_or_place(spark):
    rows = spark.createDataFrame([("t", 0, 0.0, 10.0, 10.0), ("t", 1, None, 40.0, 10.0), ("t", 2, 20.0, 10.0, None), ("t", 3, 30.0, 40.0, 10.0)], "k string, i int, s double, lat double, lon double")
    assert sorted(r["i"] for r in Q.drop_spikes(rows, ["k"], ["i"], ["s", "lat", "lon"], block=3).collect()) == [0, 1, 3]
    assert Q.plausible_runs(rows.limit(0), ["k"], ["i"], ["s", "lat", "lon"]).count() == 0


@pytest.mark.parametrize("records", [2, 10_000])
def test_many_short_histories_share_a_call(spark, records):
    """Groups of a few points come by the batch, not by a call each, and batches may end anywhere in them."""
    own = spark.newSession()
    own.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", records)
    groups = {k: line(k, 1 + k % 9 if k else 60) for k in range(50)}
    rows = own.createDataFrame([(k, i, v) for k, vs in groups.items() for i, v in enumerate(vs)], "k int, i int, v double").repartition(3)
    kept = Q.drop_spikes(rows, ["k"], ["i"], ["v"], Q.within(10.0), 16)
    assert "InPandas" not in kept._jdf.queryExecution().toString()
    assert {(r["k"], r["i"]) for r in kept.collect()} == {(k, i) for k, vs in groups.items() for i, x in enumerate(loop([(v,) for v in vs], Q.within(10.0), False)) if x is not None}
