"""Readers of side files and listings, and the streaming forms, on small files."""

import json

from pyspark.sql import functions as F

from medialake.sources import media
from medialake.streaming import events


def test_listing(spark, tmp_path):
    for name in ("a/One.MOV", "a/b/two.jpg", "note.txt", ".hidden/three.jpg"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"12345")
    rows = {r["relative_path"]: r for r in media.listing(spark, str(tmp_path)).collect()}
    assert set(rows) == {"a/One.MOV", "a/b/two.jpg"} and all(r["size"] == 5 and r["mtime"] > 0 for r in rows.values())
    hashes = [r["content_hash"] for r in media.content_hashes(spark, str(tmp_path / "a")).collect()]
    assert len(hashes) == 2 and len(set(hashes)) == 1


def test_gpx(spark, tmp_path):
    points = "".join(f"<trkpt {a}><ele>3</ele>{t}</trkpt>" for a, t in [('lat="1.5" lon="2.5"', "<time>2024-01-01T00:00:00Z</time>"), ('lat="1" lon="2"', "")])
    way = '<wpt lat="7" lon="8"><time>2024-01-02T00:00:00Z</time></wpt>'
    (tmp_path / "day.gpx").write_text(f"<gpx>{way}<trk><trkseg>{points}</trkseg></trk></gpx>")
    rows = media.gpx_points(spark, str(tmp_path / "day.gpx")).orderBy("time").collect()
    assert [(r["track"], r["latitude"], r["longitude"], r["altitude"]) for r in rows] == [("day.gpx", 1.5, 2.5, 3.0), ("day.gpx", 7.0, 8.0, None)]


def test_side_files(spark, tmp_path):
    (tmp_path / "offsets.json").write_text(json.dumps({"x": 90, "y": {"hours": 2, "seconds": 5}}))
    offsets = {r["folder"]: (r["hours"], r["minutes"], r["seconds"]) for r in media.folder_offsets(spark, str(tmp_path / "offsets.json")).collect()}
    assert offsets == {"x": (0, 90, 0), "y": (2, 0, 5)}
    (tmp_path / "assigned.json").write_text(json.dumps({"x": "t.gpx", "y": ""}))
    assert [r["target"] for r in media.folder_assignments(spark, str(tmp_path / "assigned.json")).collect()] == ["t.gpx"]
    (tmp_path / "tags.json").write_text(json.dumps({"categories": [{"id": "c", "names": {"en": "C"}, "tags": [{"id": "t1", "names": {"en": "one"}}, {"id": "t2", "names": {}}]}]}))
    assert [(r["category"], r["tag"]) for r in media.tag_catalogue(spark, str(tmp_path / "tags.json")).orderBy("ord").collect()] == [("c", "t1"), ("c", "t2")]


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([("a", "2024-01-01 00:00:01"), ("a", "2024-01-01 00:00:30"), ("a", "2024-01-01 00:05:00"), ("b", "2024-01-01 00:00:01")], "k string, at string").withColumn("at", F.to_timestamp("at"))
    assert sorted((r["k"], r["n"]) for r in events.tumbling(rows, "at", "1 minute", "k").collect()) == [("a", 1), ("a", 2), ("b", 1)]
    assert sorted((r["k"], r["n"]) for r in events.sessions(rows, "at", "1 minute", "k").collect()) == [("a", 1), ("a", 2), ("b", 1)]
    rows.write.parquet(str(tmp_path / "in"))
    seen = []
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    query = events.each_batch(events.watermarked(stream, "at", "1 hour"), lambda df, _: seen.append(df.count()), str(tmp_path / "checkpoint"))
    assert query.awaitTermination(60) and sum(seen) == 4
