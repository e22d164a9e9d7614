"""What a library shows and where its media were, beside the rules written out."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from medialake.operators import gpx as X
from medialake.operators import visible as W

FOOTAGE = "id string, warehouse string, relative_path string, filename string, directory string, status string, kind string, size long, mtime long, duration double, captured_at timestamp, phash string, user_notes string, tags array<struct<category: string, value: string, source: string>>"


def clip(i, path, warehouse="w", status="available", tags=(), **more):
    name = path.rsplit("/", 1)
    row = {"kind": "video", "size": 1, "mtime": 1, "duration": None, "captured_at": None, "phash": None, "user_notes": ""} | more
    return (i, warehouse, path, name[-1], name[0] if len(name) > 1 else "", status, *(row[k] for k in ("kind", "size", "mtime", "duration", "captured_at", "phash", "user_notes")), [(*t, "user") for t in tags])


@pytest.fixture(scope="module")
def library(spark):
    rows = [
        clip("johor", "malaysia/johor/a.mov", tags=[("nature", "ocean")]), clip("kl", "malaysia/kl/b.mov"), clip("root", "root.mov"), clip("gone", "malaysia/kl/gone.mov", status="missing"),
        clip("twin", "malaysia/johor/a.mov", "w2", tags=[("custom", "Harbour View")]), clip("off", "x/off.mov", "w3"), clip("lost", "x/lost.mov", "w3", status="missing"),
    ]
    houses = spark.createDataFrame([("w", "Travel", True), ("w2", "Second", True), ("w3", "Shelf", False)], "warehouse string, name string, online boolean")
    return spark.createDataFrame(rows, FOOTAGE), houses


def shown(library, selection, scopes=(), **of):
    return {r["id"] for r in W.included(*library, selection, scopes, **of).collect()}


def test_selections(spark, library):
    S = W.Selection
    assert shown(library, S("all")) == {"johor", "kl", "root", "twin"} and shown(library, S("tagged")) == {"johor", "twin"} and shown(library, S("untagged")) == {"kl", "root"}
    assert shown(library, S("missing")) == {"gone", "lost"} and shown(library, S("retouch")) == set()
    assert shown(library, S("warehouse", "w")) == {"johor", "kl", "root"} and shown(library, S("warehouse", "w3")) == set()
    assert shown(library, S("category", value="custom")) == {"twin"}
    assert shown(library, S("folder", "w", "./malaysia/johor/")) == {"johor"} and shown(library, S("folder", "w", "")) == {"johor", "kl", "root"}
    # Other scopes take a selected folder's place, in any warehouse; the same folder of another warehouse is another folder.
    assert shown(library, S("folder", "w", "malaysia"), [("w2", "malaysia/johor")]) == {"twin"}
    johor, kl = ("w", "malaysia/johor"), ("w", "malaysia/kl")
    assert shown(library, S("untagged"), [johor]) == set() and shown(library, S("all"), [johor, kl]) == {"johor", "kl"} and shown(library, S("missing"), [kl]) == {"gone"}
    ids = spark.createDataFrame([("johor",), ("kl",), ("gone",), ("off",)], "id string")
    assert shown(library, S("duplicates"), [johor], duplicates=ids) == {"johor"} and shown(library, S("duplicates"), duplicates=ids) == {"johor", "kl", "gone"}
    members = ids.withColumn("owner", F.lit("trip"))
    for kind in ("gpx", "itinerary"):
        assert shown(library, S(kind, "w", "trip"), [johor], members=members) == {"johor", "kl"}  # scopes don't hold
        assert shown(library, S(kind, "w2", "trip"), members=members) == set() and shown(library, S(kind, "w", "other"), members=members) == set()


def test_duplicates_and_counts(spark, library):
    footage, houses = library
    groups = spark.createDataFrame([("g", "unresolved"), ("h", "unresolved"), ("i", "ignored")], "group string, resolution string")
    members = spark.createDataFrame([("g", "kl"), ("g", "johor"), ("g", "deleted"), ("h", "root"), ("h", "deleted"), ("i", "johor"), ("i", "kl")], "group string, id string")
    found = W.unresolved_duplicates(footage, groups, members)
    assert sorted(map(tuple, found.collect())) == [("g", "johor", 0), ("g", "kl", 1)]
    assert W.unresolved_duplicates(footage, groups, members, [("w", "malaysia/kl")]).count() == 2 and W.unresolved_duplicates(footage, groups, members, [("w2", "malaysia/kl")]).count() == 0
    counts = W.collection_counts(footage, houses, duplicates=found, retouch_pairs=spark.range(3)).first().asDict()
    assert counts == {"n_all": 4, "n_tagged": 2, "n_untagged": 2, "n_missing": 2, "n_duplicates": 1, "n_retouch": 3}
    scoped = W.collection_counts(footage, houses, [("w", "malaysia")]).first().asDict()
    assert scoped == {"n_all": 2, "n_tagged": 1, "n_untagged": 1, "n_missing": 1, "n_duplicates": 0, "n_retouch": 0}


def catalogue(spark):
    rows = [("nature", {"en": "Nature", "de": "Natur"}, "ocean", {"en": "Ocean Waves", "de": "Meer"}), ("nature", {"en": "Nature", "de": "Natur"}, "lake", {"en": "Lake"})]
    return spark.createDataFrame(rows, "category string, category_names map<string,string>, tag string, names map<string,string>")


def test_every_case_of_a_token(spark):
    rows = [
        clip("id", "p", tags=[("nature", "ocean")]), clip("free", "p", tags=[("other", "sea")]), clip("own", "p", tags=[("custom", "Blue Harbour")]), clip("file", "p/night.mov"), clip("path", "night/p.mov"),
        clip("note", "p", user_notes="A NIGHT"), clip("year", "p", captured_at=dt.datetime(2019, 5, 1)), clip("all", "night/night.mov", tags=[("nature", "lake"), ("custom", "night")], user_notes="2019 night"),
    ]
    df, c = spark.createDataFrame(rows, FOOTAGE), catalogue(spark)

    def score(*tokens):
        return {r["id"]: r["score"] for r in W.search_scores(df, tokens, c).collect()}

    assert score("ocean") == {"id": 100} and score("meer") == {"id": 100} and score("ocean waves") == {"id": 100} and score("waves") == {"id": 70} and score("sea") == {"free": 100}
    assert score("harbour") == {"own": 90} and score("blue harbour") == {"own": 100}
    assert score("nature") == {"id": 40, "all": 40} and score("natur") == {"id": 40, "all": 40} and score("custom") == {}
    assert score("night") == {"file": 30, "path": 20, "note": 15, "all": 100} and score("2019") == {"year": 25, "all": 15}
    assert score("night", "lake", "nothing") == {"file": 30, "path": 20, "note": 15, "all": 200}
    assert set(score()) == {r[0] for r in rows} and set(score().values()) == {1.0}


def test_visible_results(spark, library):
    _, houses = library
    rows = [
        clip("a", "x/night b.mov", phash="0" * 64, size=5), clip("b", "x/night a.mov", phash="0" * 61 + "111", size=9), clip("c", "night/c.mov", phash="1" * 64, size=1), clip("d", "night/d.mov", phash="0" * 64),
        clip("e", "x/night.mov", "w3"), clip("f", "x/night.mov", "w3", status="missing"), clip("g", "x/day.mov"),
    ]
    df, c = spark.createDataFrame(rows, FOOTAGE), catalogue(spark)
    show = lambda *a, **k: [(r["id"], r["score"]) for r in W.visible(df, houses, *a, catalogue=c, **k).collect()]
    assert show(W.Selection("all"), tokens=["night"]) == [("b", 35.0), ("a", 30.0), ("c", 20.0), ("d", 20.0)]
    assert [i for i, _ in show(W.Selection("all"), tokens=["night"], sort="size")] == ["b", "a", "c", "d"]
    assert show(W.Selection("missing"), tokens=["night"]) == [("f", 30.0)]
    assert [i for i, _ in show(W.Selection("all"), [("w", "night")], sort="filename", ascending=False)] == ["d", "c"]
    assert show(W.Selection("duplicates"), duplicates=df.select("id")) == [] and show(W.Selection("all"), tokens=["nobody"]) == []
    with pytest.raises(ValueError):
        W.visible(df, houses, W.Selection("all"), tokens=["x"])


MEDIA = "id int, directory string, status string, kind string, captured_at timestamp, latitude double, longitude double, gps_source string"
T0 = dt.datetime(2024, 6, 1, 10)


def at(s):
    return T0 + dt.timedelta(seconds=s)


def test_tracks_of_folders(spark):
    media = [
        (1, "trip", "available", "image", at(30), None, None, None), (2, "trip", "available", "image", at(400), None, None, None), (3, "trip/day", "available", "video", at(60), 5.0, 5.0, "gpx"),
        (4, "trip/other", "available", "image", at(60), None, None, None), (5, "trip", "available", "audio", at(60), None, None, None), (6, "trip", "missing", "image", at(60), None, None, None),
        (7, "trip", "available", "image", None, None, None, None), (8, "trip", "available", "image", at(60), 7.0, 7.0, "header"), (9, "tripod", "available", "image", at(60), None, None, None),
        (10, "card", "available", "image", at(-300), None, None, None), (11, "trip", "available", "image", at(120), 0.0, 0.0, None),
    ]
    rows = spark.createDataFrame(media, MEDIA)
    points = spark.createDataFrame([("t.gpx", at(0), 1.0, 2.0, None), ("t.gpx", at(120), 3.0, 4.0, 8.0), ("u.gpx", at(0), 50.0, 60.0, None), ("u.gpx", at(90), 50.0, 60.0, None)], "track string, time timestamp, latitude double, longitude double, altitude double")
    assigned = spark.createDataFrame([("trip/other", "u.gpx"), ("card", "t.gpx")], "folder string, target string")
    offsets = spark.createDataFrame([("card", 0, 0, 0, 5, 0), ("tripod", 0, 0, 0, 1, 0)], "folder string, years int, days int, hours int, minutes int, seconds int")
    after, writes, counts = X.apply_track(rows, assigned, offsets, points, "t.gpx", "/trip/")
    assert {tuple(r) for r in after.collect()} == {("trip", "t.gpx"), ("trip/other", "u.gpx"), ("card", "t.gpx")}
    assert sorted((r["id"], r["latitude"], r["longitude"], r["altitude"], r["gps_source"]) for r in writes.collect()) == [(1, 1.5, 2.5, 8.0, "gpx"), (3, 2.0, 3.0, 8.0, "gpx"), (11, 3.0, 4.0, 8.0, "gpx")]
    assert tuple(counts.first()) == (4, 3)  # the one with a position of its own matches but stays
    places = {r["id"]: (r["owner"], r["latitude"]) for r in X.track_locations(rows, after, offsets, points).collect()}
    assert places == {1: ("t.gpx", 1.5), 3: ("t.gpx", 2.0), 4: ("u.gpx", 50.0), 8: ("t.gpx", 2.0), 10: ("t.gpx", 1.0), 11: ("t.gpx", 3.0)}
    assert X.track_locations(rows, after, offsets.where("folder = 'tripod'"), points).where("id = 10").count() == 0


def test_merged_captures(spark):
    fields = "captured_at timestamp, captured_local string, has_zone boolean, captured_source string, latitude double, longitude double, altitude double, gps_source string"
    stored = (at(1), "l1", False, "header", 1.1, 2.2, 3.3, "gpx")
    cases = [
        (stored, (at(2), None, True, "file_date", None, None, None, None), False, (at(1), "l1", False, "header", 1.1, 2.2, 3.3, "gpx")),
        (stored, (at(2), None, True, "file_date", 9.0, 8.0, None, None), True, (at(2), None, True, "file_date", 9.0, 8.0, None, "header")),
        ((at(1), None, True, "header", 0.0, 0.0, 1.0, "header"), (at(2), None, True, "header", 0.0, 0.0, 1.0, "user"), False, (at(1), None, True, "header", None, None, None, None)),
    ]
    df = spark.createDataFrame([(i, s, v, r) for i, (s, v, r, _) in enumerate(cases)], f"i int, stored struct<{fields}>, live struct<{fields}>, r boolean")
    got = df.select("i", X.merge_capture(F.col("r")).alias("m")).orderBy("i").collect()
    assert [tuple(r["m"]) for r in got] == [c[3] for c in cases]


def test_random_scopes(spark):
    rng = random.Random(8)
    folders = ["", "a", "a/b", "ab", "a/b/c", "b"]
    rows = [clip(str(i), f"{f}/x{i}.mov" if (f := rng.choice(folders)) else f"x{i}.mov", rng.choice(["w", "w2"]), rng.choice(["available", "missing"])) for i in range(120)]
    df, houses = spark.createDataFrame(rows, FOOTAGE), spark.createDataFrame([("w", "A", True), ("w2", "B", True)], "warehouse string, name string, online boolean")
    for _ in range(3):
        scopes = [(rng.choice(["w", "w2"]), rng.choice(folders)) for _ in range(2)]
        expected = {r[0] for r in rows if r[5] == "available" and any(r[1] == w and (f == "" or r[4] == f or r[4].startswith(f + "/")) for w, f in scopes)}
        assert {r["id"] for r in W.included(df, houses, W.Selection("all"), scopes).collect()} == expected
