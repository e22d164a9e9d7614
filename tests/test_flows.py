"""Values of names, labels and search tokens that no whole-table query covers."""

import math

from pyspark.sql import functions as F

from medialake.functions import columns as C
from medialake.operators import frames as V
from medialake.operators import itineraries as I
from medialake.operators import library as B

L = F.lit


def labels(*items):
    return F.array(*[F.struct(L(a).alias("label"), L(c).alias("confidence")) for a, c in items])


def sure(**items):
    return F.create_map(*[L(x) for kv in items.items() for x in kv])


def region(*values):
    return F.struct(*[L(float(v)).alias(c) for v, c in zip(values, ("latitude", "longitude", "latitude_delta", "longitude_delta"))])


def cases() -> dict:
    return {
        "geocode": (C.geocode_parts(L("Kyoto, 京都，; Japan")), ["Kyoto", "京都", "Japan"]),
        "geocode_null": (C.geocode_parts(L(None).cast("string")), []),
        "clip": (C.clip_filename(L(" a/b:c\\d "), L("clip.mp4")), "a-b-c-d.mp4"),
        "clip_kept": (C.clip_filename(L("x.mov"), L("clip.mp4")), "x.mov"),
        "clip_blank": (C.clip_filename(L("  "), L("clip.mp4")), "clip.mp4"),
        "cut": (C.default_clip_name(L("sea.view.mov")), "sea.view_cut.mp4"),
        "cut_blank": (C.default_clip_name(L("")), "clip_cut.mp4"),
        "posix": (C.escape_posix(L("/a b/(c)'$x")), "/a\\ b/\\(c\\)\\'\\$x"),
        "offset": (C.offset_summary({"y": L(1), "d": L(0), "h": L(-9)}, "zero"), "+1 y -9 h"),
        "offset_zero": (C.offset_summary({"y": L(0), "d": L(0)}, "zero"), "zero"),
        "scenes": (V.scene_labels(labels(("Sea_Side", 0.2), ("art", 0.9), ("sky", 0.5), ("fog", 0.01), (" ", 0.3))), ["sky", "sea side"]),
        "scenes_most": (V.scene_labels(labels(("a", 0.3), ("b", 0.2), ("c", 0.1)), 2), ["a", "b"]),
        "animals": (V.animal_labels(labels(("Snow_Leopard", 0.25), ("cat", 0.2)), labels(("Dog", 0.04), ("tree", 0.9), ("fox", 0.03))), ["snow leopard", "dog"]),
        "texts": (V.text_labels(labels(("  OPEN   now ", 0.7), ("x", 0.9), ("a b c d e", 0.9), ("low", 0.6))), ["OPEN now"]),
        "no_people": (V.people_count(L(3), L(0), F.array(L("dog")), L(True)), 0),
        "hands_only": (V.people_count(L(0), L(0), F.array().cast("array<string>"), L(True)), 1),
        "bodies": (V.people_count(L(3), L(1), F.array(L("dog")), L(True)), 3),
        "crowd": (V.people_id(L(11)), "crowd"),
        "portrait": (V.face_id(L(0.025), L(1)), "portrait"),
        "visible": (V.face_id(L(0.015), L(1)), "visible"),
        "distant": (V.face_id(L(0.0), L(2)), "distant"),
        "adult": (V.demographic(sure(adult=0.2, baby=0.2)), "adult"),
        "child": (V.demographic(sure(adult=0.2, baby=0.3, senior=0.3)), "child"),
        "senior": (V.demographic(sure(elderly=0.3, child=0.2)), "senior"),
        "nobody": (V.demographic(sure(adult=0.1)), None),
        "each_once": (V.first_of_each(F.array(L("Dog"), L("dog"), L("cat"), L("cow")), 2), ["Dog", "cat"]),
        "wide": (I.plausible_region(region(0, 0, 50, 1), region(0, 0, 1, 1)), False),
        "fits": (I.plausible_region(region(0, 0, 50, 1), region(0, 0, 9, 1)), True),
        "no_fit": (I.plausible_region(region(0, 0, 50, 1), L(None).cast("struct<latitude: double, longitude: double, latitude_delta: double, longitude_delta: double>")), True),
        "not_finite": (I.usable_region(region(math.nan, 0, 1, 1)), False),
        "beyond": (I.usable_region(region(0, 0, 120, 1)), False),
        "alone": (I.spread_offsets(L(1)), [(0.0, 0.0)]),
        "none": (I.spread_offsets(L(0)), [(0.0, 0.0)]),
    }


def test_values(spark):
    expected = cases()
    row = spark.range(1).select(*[c.alias(n) for n, (c, _) in expected.items()]).first()
    for name, (_, want) in expected.items():
        got = row[name]
        assert ([tuple(x) if isinstance(x, tuple) else x for x in got] if isinstance(got, list) else got) == want, name


def test_spread(spark):
    [(places,)] = spark.range(1).select(I.spread_offsets(L(4))).collect()
    r = 24 + 4 * 3.2
    want = [(0, -r), (r, 0), (0, r), (-r, 0)]
    assert all(math.isclose(a, b, abs_tol=1e-9) for p, w in zip(places, want, strict=True) for a, b in zip(p, w))


def test_orders(spark):
    rows = spark.createDataFrame([(1, None, "b2"), (2, 5, "b10"), (3, 5, "b9"), (4, 1, "a")], "id int, captured_at int, filename string")
    assert [r.id for r in rows.orderBy(*I.pin_order()).collect()] == [4, 3, 2, 1]
    assert [r.id for r in rows.orderBy(*I.retouch_order()).collect()] == [1, 4, 3, 2]


def test_search_tokens(spark):
    tokens = spark.createDataFrame([(1, "Calm"), (1, "海"), (2, "山"), (2, " "), (3, "空"), (3, "空"), (4, "橋")], "query int, token string")
    catalogue = spark.createDataFrame([("subject", "sea_view", {"en": "Sea View", "zh": "海"}, 0)], "category string, tag string, names map<string, string>, ord int")
    glossary = spark.createDataFrame([("橋", "Bridge"), ("calm", "静")], "a string, b string")
    dictionary = spark.createDataFrame([("山", "mountain"), ("橋", "span"), ("空", "sky")], "word string, english string")
    found = {(r.query, r.token) for r in B.search_tokens(tokens, catalogue, glossary, dictionary).collect()}
    assert found == {(1, "calm"), (1, "静"), (1, "海"), (1, "sea view"), (1, "sea_view"), (2, "山"), (2, "mountain"), (3, "空"), (3, "sky"), (4, "橋"), (4, "bridge")}
