"""A trip from its media to its map."""

import pytest
from pyspark.sql import functions as F

from medialake.operators import trips as T

ROWS = "trip string, id string, kind string, status string, directory string, filename string, latitude double, longitude double, altitude double, gps_source string, code long, captured_s long, civil_s long, has_zone boolean, pos int, folder_s long"
A, B = (25.0, 121.5), (25.1, 121.5)


def row(i, t, at=None, source="header", code=None, kind="image", directory="trip", zone=True, alt=None, folder_s=None, trip="t"):
    lat, lon = at or (None, None)
    return (trip, i, kind, "available", directory, f"{i}.jpg", lat, lon, alt, source if at else None, code, t, t if t is not None else None, zone, 0, folder_s)


MEDIA = [
    row("a1", 0, A, code=0b1111, alt=10.0), row("a2", 300, (25.001, 121.5), alt=20.0), row("spike", 400, (60.0, 0.0)), row("a3", 600, A, alt=30.0), row("b1", 7200, B), row("b2", 7800, B), row("guess", 650, (1.0, 1.0), "itinerary"),
    row("in", 300), row("after", 2400), row("before", 5900), row("near", 6500), row("edit", 5000, code=0b1110), row("burst", 900, code=0b1111), row("untimed", None), row("moved", 0, folder_s=2400), row("video", 310, kind="video"), row("sound", 310, kind="audio"),
    row("else", 300, directory="other"), row("lone", 50, trip="u"),
]


@pytest.fixture(scope="module")
def media(spark):
    return spark.createDataFrame(MEDIA, ROWS)


@pytest.fixture(scope="module")
def guesses(media):
    return {r["id"]: r for r in T.place_guesses(media, ["trip"]).collect()}


def test_guesses(guesses):
    relation = {i: r["relation"] for i, r in guesses.items()}
    expected = {"in": "inside", "after": "previous", "before": "next", "near": "inside", "edit": "edited", "burst": "inside", "moved": "previous", "video": "inside"}
    assert {i: relation.get(i) for i in expected} == expected and "untimed" not in relation and "lone" not in relation
    assert [(guesses[i]["latitude"], guesses[i]["longitude"]) for i in ("in", "near", "after", "before")] == [A, B, A, B]
    assert guesses["in"]["altitude"] == 20.0 and guesses["in"]["previous"] is None and guesses["in"]["next"]["start_s"] == 7200
    assert guesses["near"]["previous"]["end_s"] == 600 and guesses["near"]["next"] is None
    assert (guesses["after"]["previous"]["start_s"], guesses["after"]["next"]["start_s"]) == (0, 7200)
    assert (guesses["edit"]["edited_from"], guesses["edit"]["latitude"], guesses["edit"]["altitude"], guesses["edit"]["previous"]) == ("a1", 25.0, 10.0, None)


def test_a_track_comes_before_stays(spark, media):
    track = spark.createDataFrame([("t", 2000.0, 24.0, 120.0, None), ("t", 3000.0, 24.5, 120.5, 8.0)], "trip string, time_s double, latitude double, longitude double, altitude double")
    got = {r["id"]: (r["relation"], r["latitude"] and round(r["latitude"], 6), r["altitude"]) for r in T.place_guesses(media, ["trip"], track).collect()}
    assert got["after"] == ("inside", 24.2, 8.0) and got["in"] == ("inside", 25.0, 20.0) and got["edit"][0] == "edited" and got["moved"] == ("inside", 24.2, 8.0)


def test_members(spark, media):
    members = {r["id"]: (r["reason"], r["pending"]) for r in T.timeline_members(media, "/trip", ["trip"]).collect()}
    assert members["a1"] == ("gps", False) and members["guess"] == ("gps", False) and members["edit"] == ("edited", True) and members["before"] == ("stays", True)
    assert not {"else", "untimed", "sound", "lone"} & set(members)
    track = spark.createDataFrame([("t", 4000.0), ("t", 4500.0)], "trip string, time_s double")
    on = spark.createDataFrame([("a1",)], "id string")
    found = {r["id"]: (r["reason"], r["pending"]) for r in T.track_members(media, "trip", ["trip"], track, on).collect()}
    assert found == {"a1": ("on_track", False), "after": ("nearby", True), "before": ("nearby", True), "edit": ("nearby", True), "moved": ("nearby", True)}
    done = T.without_pending(T.timeline_members(media, "trip", ["trip"]), spark.createDataFrame([("edit",)], "id string"))
    assert {r["id"]: r["pending"] for r in done.where("id IN ('edit', 'before')").collect()} == {"edit": False, "before": True}


def test_the_map(spark, media):
    g = T.place_guesses(media, ["trip"])
    members = media.where("trip = 't' AND kind <> 'audio'").select("trip", "id").unionByName(spark.createDataFrame([("t", "deleted")], "trip string, id string"))
    shown = {r["id"]: (r["latitude"], r["guessed"]) for r in T.map_pins(members, media, g, ["trip"]).collect()}
    assert shown["a1"] == (25.0, False) and shown["in"] == (25.0, True) and shown["edit"] == (25.0, True) and not {"after", "before", "deleted", "untimed"} & set(shown)
    previews = spark.createDataFrame([("after", "next")], "id string, preview string")
    pins = T.map_pins(members, media, g, ["trip"], previews)
    assert {r["id"]: r["latitude"] for r in pins.collect()}["after"] == 25.1
    kept, lines, region = T.map_snapshot(pins.where("id NOT IN ('guess', 'spike')"), ["trip"])
    assert "a1" in {r["id"] for r in kept.collect()} and {r["kind"] for r in lines.collect()} == {"land"}
    r = region.first()
    assert (round(r["latitude"], 4), round(r["latitude_delta"], 4)) == (25.05, round(0.1 * 1.45, 4))


def test_confirming(spark, media):
    g = T.place_guesses(media, ["trip"])
    targets = spark.createDataFrame([("in", None), ("after", "next"), ("before", None), ("edit", None), ("in2", None)], "id string, choice string")
    got = {r["id"]: r for r in T.confirmed_places(g, targets, media, ["trip"]).collect()}
    assert {i: (r["latitude"], r["retouch"], r["gps_source"]) for i, r in got.items()} == {"in": (25.0, False, "itinerary"), "after": (25.1, False, "itinerary"), "before": (25.1, False, "itinerary"), "edit": (25.0, True, "itinerary")}
    assert (got["edit"]["original_captured_s"], got["edit"]["original_has_zone"], got["in"]["original_captured_s"]) == (0, True, None)


def test_no_media(media):
    none = media.where(F.lit(False))
    assert T.place_guesses(none, ["trip"]).count() == 0 and T.timeline_members(none, "trip", ["trip"]).count() == 0
