"""Neighbours in time beside sorted lists, stays, zones, places near the pole, and look-alikes beside all pairs."""

import random

from pyspark.sql import functions as F

from medialake.operators import library as L
from medialake.operators import relations as O
from medialake.operators.ranks import Look, neighbours
from medialake.operators.sequences import metres


def test_neighbours_of_a_hot_group(spark):
    rng = random.Random(1)
    group = lambda: rng.choice(["hot"] * 8 + ["b", None])
    points = [(group(), rng.randrange(400), i) for i in range(1500)]
    probes = [(i, group(), rng.choice([None, *range(-5, 410)])) for i in range(900)]
    p = spark.createDataFrame(points, "k string, t int, pos int").repartition(7)
    q = spark.createDataFrame(probes, "id int, k string, t int").repartition(5)
    looks = {n: Look(p, after, strictly) for n, after, strictly in (("a", False, False), ("b", True, False), ("c", False, True), ("d", True, True))}
    got = {r["id"]: {n: r[n] and (r[n]["t"], r[n]["pos"]) for n in looks} for r in neighbours(q, looks, ["k"], "t").collect()}
    assert len(got) == 900

    def plain(k, t):
        own = sorted((x, pos) for key, x, pos in points if key == k)
        if t is None:
            return dict.fromkeys("abcd")
        before, strictly = [x for x in own if x[0] <= t], [x for x in own if x[0] < t]
        after, beyond = [x for x in own if x[0] >= t], [x for x in own if x[0] > t]
        return {"a": before[-1] if before else None, "b": after[0] if after else None, "c": strictly[-1] if strictly else None, "d": beyond[0] if beyond else None}

    assert got == {i: plain(k, t) for i, k, t in probes}
    assert neighbours(q.limit(0), looks, ["k"], "t").count() == 0
    assert neighbours(q, {"a": Look(p.limit(0))}, ["k"], "t").where("a IS NULL").count() == 900


def test_interpolation(spark):
    at = "timestamp'2024-01-01 00:00:{:02d}'"
    track = [(10, 0, 1.0, None), (20, 1, 2.0, 100.0), (20, 2, 9.0, 900.0), (30, 3, 4.0, None), (40, 4, 6.0, 200.0)]
    rows = spark.sql(" UNION ALL ".join(f"SELECT 'g' AS k, {at.format(t)} AS t, {pos} AS pos, {lat}D AS lat, CAST({'NULL' if alt is None else alt} AS DOUBLE) AS alt" for t, pos, lat, alt in track))
    probes = spark.sql(" UNION ALL ".join(f"SELECT 'g' AS k, {at.format(t)} AS t, {t} AS id" for t in (9, 10, 15, 20, 25, 35, 40, 41)))
    got = {r["id"]: (r["lat"], r["alt"]) for r in O.asof_interpolate(probes, rows, ["k"], "t", ["lat", "alt"]).collect()}
    assert got == {9: (None, None), 10: (1.0, None), 15: (1.5, 100.0), 20: (2.0, 100.0), 25: (6.5, 900.0), 35: (5.0, 200.0), 40: (6.0, 200.0), 41: (None, None)}


def test_stays_shorter_than_their_padding(spark):
    stays = spark.createDataFrame([("k", "s1", 0, 60), ("k", "s2", 300, 360), ("k", "s3", 600, 660), ("k", "s4", 90_000, 90_060)], "k string, stay string, start_s long, end_s long")
    probes = spark.createDataFrame([(t, "k", t) for t in (-1201, -1200, 900, 1261, 1700, 3000, 89_000, 200_000)] + [(1, "other", 1)], "id long, k string, t_s long")
    got = {r["id"]: (r["relation"], r["stay"]) for r in L.stay_of(probes, stays, ["k"]).collect()}
    assert got == {-1201: ("next", "s1"), -1200: ("inside", "s1"), 900: ("inside", "s1"), 1261: ("inside", "s2"), 1700: ("inside", "s3"), 3000: ("previous", "s3"), 89_000: ("inside", "s4"), 200_000: ("previous", "s4"), 1: (None, None)}


def test_offsets_count_times_with_a_zone(spark):
    rows = [("a", 3600, 0, True, 10.0, 10.0, 0), *[("a", 7200, 0, False, 10.0, 10.0, i) for i in range(5)], ("b", 7200, 0, False, 10.0, -31.0, 1), ("b", 0, 0, False, None, None, 0), ("c", -4000, 0, True, 10.0, 10.0, 0)]
    df = spark.createDataFrame(rows, "k string, civil_s long, utc_s long, has_zone boolean, latitude double, longitude double, pos int")
    offsets = L.utc_offset(df, ["k"])
    assert {r["k"]: r["offset_s"] for r in offsets.collect()} == {"a": 3600, "b": -7200, "c": -3600}
    moved = L.aligned_instant(df.where("k = 'a'").withColumn("folder_s", F.when(F.col("pos") == 1, 60)), offsets, ["k"]).select("pos", "has_zone", "aligned_s").distinct().collect()
    assert sorted((r["pos"], r["aligned_s"]) for r in moved if not r["has_zone"]) == [(0, 3600), (1, 3660), (2, 3600), (3, 3600), (4, 3600)]


def test_nearest_places_anywhere(spark):
    rng = random.Random(2)
    around = [(89.95, 10.0), (-89.9999, 170.0), (0.0, 180.0), (60.0, -180.0), (45.0, 7.0)]
    place = lambda: (lambda c: (max(-90.0, min(90.0, c[0] + rng.uniform(-0.01, 0.01))), (c[1] + rng.choice([rng.uniform(-0.01, 0.01), rng.uniform(-180, 180) if abs(c[0]) > 80 else 0]) + 180) % 360 - 180))(rng.choice(around))
    places, probes = [(i, *place()) for i in range(120)], [(i, *place()) for i in range(80)] + [(80, 89.95, 0.0)]
    places.append((120, 89.955, 5.0))
    got = {r["id"]: (r["place"], round(r["metres"], 3)) for r in O.grid_nearest(spark.createDataFrame(probes, "id int, lat double, lon double"), spark.createDataFrame(places, "place int, lat double, lon double"), 1000.0).collect()}
    expected = {}
    for i, a, b in probes:
        near = [(metres(a, b, c, d), -p) for p, c, d in places if metres(a, b, c, d) <= 1000]
        if near:
            m, p = min(near)
            expected[i] = (-p, round(m, 3))
    assert 80 in expected and len(expected) > 20 and got == expected


def test_one_tag_of_two_sources(spark):
    tags = spark.createDataFrame([(1, "m", "calm", "ai"), (1, "m", "calm", "user"), (1, "a", "b", "path")], "id int, category string, value string, source string")
    rows = L.with_tags(spark.createDataFrame([(1,), (2,)], "id int"), tags, "id").orderBy("id").collect()
    assert [[(t["category"], t["source"]) for t in r["tags"]] for r in rows] == [[("m", "user"), ("a", "path")], []]


def test_far_codes_and_edited_originals(spark):
    rng = random.Random(3)
    codes = [rng.getrandbits(64) for _ in range(12)]
    rows = []
    for i in range(160):
        c = rng.choice(codes)
        for _ in range(rng.randrange(24)):
            c ^= 1 << rng.randrange(64)
        rows.append((i, c - (1 << 64) if c >> 63 else c))
    distance = lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count()
    for most in (0, 5, 18):
        got = [tuple(r) for r in O.hamming_pairs(spark.createDataFrame(rows, "id int, code long"), "id", "code", most).collect()]
        expected = {(a, b, distance(x, y)) for a, x in rows for b, y in rows if a < b and distance(x, y) <= most}
        assert len(got) == len(set(got)) and set(got) == expected and (most == 0 or expected)
    media = [(i, rng.choice("pq"), rng.choice(["image"] * 5 + ["video"]), c, rng.choice([None, *range(0, 9000, 600)]), *((1.0, 2.0, rng.choice(["header", "gpx", None])) if rng.random() < 0.6 else (None, None, None))) for i, c in rows]
    df = spark.createDataFrame(media, "id int, trip string, kind string, code long, aligned_s int, latitude double, longitude double, gps_source string")
    got = {r["id"]: (r["original"], r["distance"]) for r in O.edited_originals(df, ["trip"], most=18).collect()}
    expected = {}
    for i, trip, kind, c, t, lat, *_ in media:
        fits = [(distance(c, d), -u, j) for j, other, k2, d, u, la, _, g in media if j != i and other == trip and k2 == "image" and la is not None and g != "gpx" and u is not None and t is not None and t - u >= 1200 and distance(c, d) <= 18]
        if kind == "image" and lat is None and fits:
            expected[i] = (min(fits)[2], min(fits)[0])
    assert len(expected) > 5 and got == expected
