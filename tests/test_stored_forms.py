"""Captures as JSON and back; custom tags' words of a dictionary."""

import json

from pyspark.sql import functions as F

from medialake.functions import variants as V
from medialake.operators import library as L

CAPTURE = "captured_s double, captured_local string, has_zone boolean, captured_source string, latitude double, longitude double, altitude double, gps_source string"


def test_captures(spark):
    rows = [
        (1714558830.5, "2024-05-01T10:20:30", False, "header", 25.5, 121.5, 3.0, "gpx"), (1.0, "", True, "file_date", 0.0, 0.0, 9.0, "header"), (None,) * 8, (None, None, False, None, 25.5, 121.5, None, None),
    ]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, c struct<{CAPTURE}>").select("i", V.capture_json(F.col("c")).alias("j")).orderBy("i")
    texts = [r["j"] for r in df.collect()]
    assert [t and json.loads(t) for t in texts] == [
        {"capturedAt": 1714558830.5, "capturedAtLocal": "2024-05-01T10:20:30", "capturedAtSource": "header", "latitude": 25.5, "longitude": 121.5, "altitude": 3.0, "gpsSource": "gpx"},
        {"capturedAt": 1.0, "capturedAtSource": "file_date", "capturedAtHasTimeZone": True}, None, {"latitude": 25.5, "longitude": 121.5},
    ]
    more = [*texts, "no json", '{"capturedAt": "x", "capturedAtHasTimeZone": 1, "latitude": 7, "longitude": 8, "gpsSource": 3}']
    back = [tuple(r["c"]) for r in spark.createDataFrame([(i, t) for i, t in enumerate(more)], "i int, t string").select("i", V.stored_capture(F.col("t")).alias("c")).orderBy("i").collect()]
    empty = (None, None, False, None, None, None, None, None)
    assert back == [rows[0], (1.0, None, True, "file_date", None, None, None, None), empty, (None, None, False, None, 25.5, 121.5, None, "header"), empty, (None, None, True, None, 7.0, 8.0, None, "header")]


def test_words_of_a_dictionary(spark):
    tags = spark.createDataFrame([(1, "custom", "破冰船", "user"), (2, "custom", "港口", "ai"), (3, "custom", "Hafenstraße", "user"), (4, "custom", "harbour", "user"), (5, "nature", "ocean", "ai"), (6, "custom", "海", "user")], "id int, category string, value string, source string")
    catalogue = spark.createDataFrame([("nature", "ocean", {"en": "Ocean", "zh": "海"}, 1)], "category string, tag string, names map<string,string>, ord int")
    glossary = spark.createDataFrame([("港口", "port")], "a string, b string")
    dictionary = spark.createDataFrame([("破冰船", "Icebreaker"), ("港口", "harbour"), ("海", "sea"), ("harbour", "x")], "word string, english string")

    def expanded(**how):
        out = {}
        for r in L.expand_tags(tags, catalogue, glossary, ["id"], **how).collect():
            out.setdefault(r["id"], set()).add((r["category"], r["value"]))
        return out

    full = expanded(dictionary=dictionary)
    assert full[1] == {("custom", "破冰船"), ("custom", "icebreaker")} and full[2] == {("custom", "港口"), ("custom", "port")} and full[3] == {("custom", "Hafenstraße")} and full[4] == {("custom", "harbour")}
    assert full[5] == {("nature", "ocean"), ("custom", "ocean")} and full[6] == {("custom", "海"), ("nature", "ocean"), ("custom", "ocean")}
    plain = expanded(english=False)
    assert plain[1] == {("custom", "破冰船")} and plain[5] == {("nature", "ocean")} and plain[6] == full[6]
