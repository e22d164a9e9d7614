"""Land under a route, and its lines."""

from pyspark.sql import functions as F

from medialake.operators import routes as R

TAIPEI, KAOHSIUNG, BRISBANE = (25.033, 121.565), (22.627, 120.301), (-27.470, 153.026)


def lines(spark, *runs):
    rows = [(f"r{i}", n, *map(float, p)) for i, run in enumerate(runs) for n, p in enumerate(run)]
    found = {}
    for r in R.route_lines(spark.createDataFrame(rows, "run string, n int, latitude double, longitude double"), ["run"], "n").orderBy("run", "segment", "seq").collect():
        found.setdefault((r["run"], r["segment"], r["kind"]), []).append((r["latitude"], r["longitude"]))
    return found


def test_land_masses(spark):
    cases = {TAIPEI: ["taiwan"], (35.0, 139.0): ["japan"], BRISBANE: ["australia"], (48.85, 2.35): ["eurasia"], (51.5, -0.1): ["uk"], (30.0, 31.0): ["eurasia", "africa"], (0.0, -30.0): [], (21.2, 116.8): ["philippines"], (53.0, -6.5): ["uk", "ireland"]}
    rows = spark.createDataFrame([(*p,) for p in cases], "lat double, lon double").select("lat", "lon", R.land_masses(F.col("lat"), F.col("lon"))).collect()
    assert {(a, b): m for a, b, m in rows} == cases


def test_hops(spark):
    hops = [(*TAIPEI, *KAOHSIUNG, "land"), (*TAIPEI, *BRISBANE, "sea"), (0.0, 0.0, 0.01, 0.01, "land"), (-27.391, 153.068, -27.418, 153.057, "land"), (*TAIPEI, 24.45, 118.08, "sea"), (48.85, 2.35, 55.75, 37.6, "land"), (48.85, 2.35, 51.5, -0.1, "sea")]
    rows = spark.createDataFrame(hops, "a double, b double, c double, d double, kind string")
    assert rows.where(R.hop_kind(F.col("a"), F.col("b"), F.col("c"), F.col("d")) != F.col("kind")).count() == 0


def test_lines(spark):
    found = lines(spark, [TAIPEI, KAOHSIUNG], [TAIPEI, BRISBANE], [(0, 0), (0.01, 0.01)], [TAIPEI], [TAIPEI, TAIPEI])
    assert set(found) == {("r0", 1, "land"), ("r1", 1, "sea"), ("r2", 1, "land")}
    assert found["r0", 1, "land"] == [TAIPEI, KAOHSIUNG]
    arc = found["r1", 1, "sea"]
    assert len(arc) == 24 and TAIPEI[0] > arc[12][0] > BRISBANE[0]
    assert all(abs(x - y) < 1e-9 for p, q in ((arc[0], TAIPEI), (arc[-1], BRISBANE)) for x, y in zip(p, q))


def test_land_on_both_sides_of_the_sea(spark):
    run = [TAIPEI, KAOHSIUNG, KAOHSIUNG, (23.0, 120.5), BRISBANE, (-27.4, 153.0), (-27.3, 153.0), TAIPEI, KAOHSIUNG]
    found = lines(spark, run)
    assert [(k[1], k[2], len(v)) for k, v in sorted(found.items())] == [(1, "land", 3), (4, "sea", 24), (5, "land", 3), (7, "sea", 24), (8, "land", 2)]
    assert found["r0", 1, "land"] == [TAIPEI, KAOHSIUNG, (23.0, 120.5)] and found["r0", 5, "land"][0] == BRISBANE


def test_no_points(spark):
    assert lines(spark) == {}
