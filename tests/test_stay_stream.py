"""Stays of a stream beside those of the whole table."""

import random

import pytest
from pyspark.sql import functions as F

from medialake.operators.sequences import stays
from medialake.streaming.stays import stay_stream

SCHEMA = "track string, s double, lat double, lon double, alt double"


def points(seed=7, n=400):
    rng = random.Random(seed)
    rows = []
    for track in ("a", "b", None):
        t, lat, lon = 1_700_000_000.0, 40.0, 5.0
        for _ in range(n):
            t += rng.choice([1, 30, 600, 600, 4000] + [30_000] * (rng.random() < 0.1)) + rng.random()
            if rng.random() < 0.15:
                lat, lon = 40 + rng.randrange(3) * 0.02, 5 + rng.randrange(3) * 0.02
            rows.append((track, round(t, 3), lat + rng.gauss(0, 0.002), lon + rng.gauss(0, 0.002), rng.choice([None, 100 * rng.random()])))
    return rows


def as_set(df):
    return sorted((r["track"] or "", *(round(r[c], 3) for c in ("start", "end", "lat", "lon")), r["alt"] is None, round(r["alt"] or 0, 3)) for r in df.collect())


def write(spark, rows, path):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).withColumn("ts", F.timestamp_micros(F.round(F.col("s") * 1_000_000).cast("long"))).write.mode("append").parquet(path)


def run(spark, root):
    source = spark.readStream.schema(f"{SCHEMA}, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    q = stay_stream(source, ["track"], late="20 days", idle_s=20_000).writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    assert q.awaitTermination(300)


def test_shuffled_batches_and_a_restart(spark, tmp_path):
    root, rows = str(tmp_path), points()
    expected = as_set(stays(spark.createDataFrame(rows, SCHEMA).withColumnRenamed("s", "time"), ["track"], idle_s=20_000))
    assert len(expected) > 60
    shuffled = list(rows)
    random.Random(1).shuffle(shuffled)
    for i in range(3):
        write(spark, shuffled[i::6], f"{root}/in")
    run(spark, root)
    assert as_set(spark.read.schema("track string, start double, `end` double, lat double, lon double, alt double").parquet(f"{root}/out")) == []  # all may still change
    for i in range(3, 6):
        write(spark, shuffled[i::6], f"{root}/in")
    write(spark, [("later", 1_800_000_000.0, 1.0, 1.0, None), ("a", None, 1.0, 1.0, None), ("a", 1_700_000_000.0, None, 1.0, None)], f"{root}/in")
    run(spark, root)  # from the checkpoint
    write(spark, [("later", 1_900_000_000.0, 1.0, 1.0, None)], f"{root}/in")
    run(spark, root)
    got = as_set(spark.read.parquet(f"{root}/out"))
    assert [r for r in got if r[0] != "later"] == expected
    assert [r[1] for r in got if r[0] == "later"] == [1_800_000_000.0]


def test_altitudes_merges_and_idle_tracks(spark):
    rows = [("t", 0.0, 10.0, 10.0, 5.0), ("t", 10.0, 10.0, 10.001, None), ("t", 20.0, 10.1, 10.0, None), ("t", 30.0, 10.0, 10.0, None), ("t", 40.0, 10.1, 10.0, 9.0), ("t", 100_000.0, 10.1, 10.0, 1.0)]
    df = spark.createDataFrame(rows, SCHEMA).withColumnRenamed("s", "time")
    got = [tuple(r)[1:3] + (r["alt"],) for r in stays(df, ["track"]).orderBy("start").collect()]
    assert got == [(0.0, 10.0, 5.0), (20.0, 20.0, None), (30.0, 30.0, None), (40.0, 100_000.0, 5.0)]
    idle = [tuple(r)[1:3] for r in stays(df, ["track"], idle_s=1000.0).orderBy("start").collect()]
    assert idle == [(0.0, 10.0), (20.0, 20.0), (30.0, 30.0), (40.0, 40.0), (100_000.0, 100_000.0)]
    assert stays(df.limit(0), ["track"]).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_more_points_than_a_batch(spark, tmp_path, seed):
    root, rows = str(tmp_path), points(seed, 150)
    rows += [("end", 1_990_000_000.0, 0.0, 1.0, None)]
    for i in range(4):
        write(spark, rows[i::4], f"{root}/in")
    run(spark, root)
    expected = as_set(stays(spark.createDataFrame(rows[:-1], SCHEMA).withColumnRenamed("s", "time"), ["track"], idle_s=20_000))
    assert as_set(spark.read.parquet(f"{root}/out")) == expected


def test_tracks_go_by_the_batch(spark):
    """Tracks are folded as batches come, not by a call each, and batches may end anywhere in them."""
    own = spark.newSession()
    own.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    rows = points(3, 60)
    expected = as_set(stays(spark.createDataFrame(rows, SCHEMA).withColumnRenamed("s", "time").coalesce(1), ["track"]))
    found = stays(own.createDataFrame(rows, SCHEMA).withColumnRenamed("s", "time").repartition(5), ["track"])
    assert "InPandas" not in found._jdf.queryExecution().toString()
    assert as_set(found) == expected and {r[0] for r in expected} == {"", "a", "b"}


def test_points_that_only_wait_are_not_read():
    """A batch none of whose points is due costs no look at those that wait."""
    import pandas as pd

    from medialake.streaming import stays as S

    calls = []

    class State:
        def __init__(self, name):
            self.name, self.value = name, None

        def __getattr__(self, call):
            def act(*args):
                calls.append((self.name, call))
                if call == "update":
                    self.value = args[0]
                return self.value if call == "get" else None

            return act

    class Timers:
        def getCurrentWatermarkInMs(self):
            return 1000

    p = S.StayProcessor(["track"], 500.0, 2700.0, 100.0)
    p.handle, p.summary, p.current, p.waiting = State("handle"), State("summary"), State("current"), State("waiting")
    batch = lambda t: [pd.DataFrame({"time": [t, t + 1], "lat": [1.0, 1.0], "lon": [2.0, 2.0], "alt": [None, None]})]
    assert list(p.handleInputRows(("a",), iter(batch(50.0)), Timers())) == []
    assert calls == [("waiting", "appendList"), ("summary", "get"), ("handle", "registerTimer"), ("summary", "update")] and p.summary.value[-1] == 50_001
    calls.clear()
    assert list(p.handleInputRows(("a",), iter(batch(70.0)), Timers())) == []
    assert calls == [("waiting", "appendList"), ("summary", "get")]
    list(p.handleInputRows(("a",), iter(batch(20.0)), Timers()))
    assert ("handle", "deleteTimer") in calls and p.summary.value[-1] == 20_001
