"""Stacked pins beside the loop they follow, and numbering of large groups."""

import math
import random

import pytest
from pyspark.sql import functions as F

from medialake.operators import pins as P
from medialake.operators.ranks import numbered
from medialake.operators.sequences import metres


def loop(rows, reach=P.STACK_M):
    """rows: (trip, id, lat, lon, t, selected)."""
    out = {}
    for trip in {r[0] for r in rows}:
        rest = sorted((r for r in rows if r[0] == trip), key=lambda r: (r[4] is None, r[4] or 0, r[1]))
        while rest:
            first, rest = rest[0], rest[1:]
            group = [first] + [r for r in rest if metres(first[2], first[3], r[2], r[3]) <= reach]
            taken = {r[1] for r in group}
            rest = [r for r in rest if r[1] not in taken]
            leader = first[1]
            at = next((i for i, r in enumerate(group) if r[5]), 0)
            group[0], group[at] = group[at], group[0]
            n = len(group)
            for i, r in enumerate(group):
                angle, radius = 2 * math.pi * i / n - math.pi / 2, (24 + 3.2 * n) * (n > 1)
                out[r[1]] = (trip, leader, i, n, round(math.cos(angle) * radius, 6), round(math.sin(angle) * radius, 6))
    return out


def stacks(spark, rows, **sizes):
    df = spark.createDataFrame(rows, "trip string, id long, latitude double, longitude double, t int, selected boolean").repartition(5)
    got = P.stack_pins(df, ["trip"], "t", **sizes).collect()
    assert len(got) == len({r["id"] for r in got})
    return {r["id"]: (r["trip"], r["leader"], r["position"], r["size"], round(r["x"], 6), round(r["y"], 6)) for r in got}


def scattered(seed, n, lat, lon, spread):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        a, b = lat + rng.gauss(0, spread), lon + rng.gauss(0, spread * 1.5)
        a, b = (180 - a, b + 180) if a > 90 else (a, b)
        rows.append((rng.choice(["p", "q", None]), i, a, (b + 180) % 360 - 180, rng.choice([None, *range(40)]), rng.random() < 0.1))
    return rows


@pytest.mark.parametrize("lat,lon,spread", [(45.0, 7.0, 0.0004), (-12.0, 180.0, 0.0003), (89.9999, 0.0, 0.0002)])
def test_as_the_loop_has_it(spark, lat, lon, spread):
    rows = scattered(1, 260, lat, lon, spread)
    expected = loop(rows)
    assert 1 < len({v[1] for v in expected.values()}) < 200
    assert stacks(spark, rows) == expected
    assert stacks(spark, rows, tile=2, given=2) == expected  # many rims, fences in most cubes


def test_a_chain_through_many_tiles_and_a_crowded_spot(spark):
    rows = [("p", i, 10.0 + i * 0.00009, 20.0, i, False) for i in range(300)]  # 10 m apart: each decision hangs on the one before
    rows += [("p", 1000 + i, 30.0, 20.0, None, i == 77) for i in range(500)]
    assert stacks(spark, rows, tile=8, given=4) == loop(rows)


def test_pins_without_place_and_no_pins(spark):
    rows = [("p", 1, None, 2.0, 1, False), ("p", 2, 1.0, float("nan"), 1, False), ("p", 3, 1.0, 2.0, 1, None)]
    assert stacks(spark, rows) == {3: ("p", 3, 0, 1, 0.0, 0.0)}
    assert stacks(spark, []) == {}


def test_numbers_of_a_group_that_spans_partitions(spark):
    rows = spark.range(5000).select(F.when(F.col("id") % 10 < 7, "hot").when(F.col("id") % 10 < 9, "b").alias("k"), (F.col("id") * 7919 % 100).alias("o"), "id")
    got = numbered(rows.repartition(6), ["k"], [F.col("o")]).collect()
    by = {}
    for r in got:
        by.setdefault(r["k"], []).append((r["position"], r["o"]))
    for found in by.values():
        found.sort()
        assert [p for p, _ in found] == list(range(len(found)))
        assert [o for _, o in found] == sorted(o for _, o in found)
    assert {k: len(v) for k, v in by.items()} == {"hot": 3500, "b": 1000, None: 500}
