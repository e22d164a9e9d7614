"""Values of column functions and operators that no whole-table query covers."""

import hashlib
import math

from pyspark.sql import functions as F

from medialake.functions import columns as C
from medialake.operators import relations as O
from medialake.operators import sequences as Q
from medialake.sources import media

L = F.lit


def cases() -> dict:
    none = L(None)
    return {
        "tokenize": (C.tokenize(L("  Calm, SEA，海 ")), ["calm", "sea", "海"]),
        "stock_keyword": (C.stock_keyword(L("  #Blue   Sky ")), "blue sky"),
        "needs_companion": (C.needs_companion(L("海x")), True),
        "no_companion": (C.needs_companion(L("sea!")), False),
        "contains_han": (C.contains_han(L("a海")), True),
        "no_han": (C.contains_han(L("カナ")), False),
        "custom_tags": (C.split_custom_tags(L("a, b，c；; d ")), ["a", "b", "c", "d"]),
        "safe": (C.safe_folder(L("a/b.c")), True),
        "unsafe": (C.safe_folder(L("a/.b")), False),
        "gps": (C.usable_gps(L(35.0), L(-139.0)), True),
        "null_island": (C.usable_gps(L(0.00001), L(0.0)), False),
        "gps_range": (C.usable_gps(L(91.0), L(0.0)), False),
        "gps_null": (C.usable_gps(L(None).cast("double"), L(1.0)), False),
        "exif": (F.unix_timestamp(C.exif_clock(L("2024:02:03 04:05:06"))), 1706933106),
        "iso6709": (C.iso6709(L("+35.6895-139.6917+040.0/"))["longitude"], -139.6917),
        "iso6709_not": (C.iso6709(L("here")).isNull(), True),
        "capture": (C.plausible_capture(F.to_timestamp(L("2014-12-31 00:00:00")), F.to_date(L("2024-01-01"))), False),
        "capture_ahead": (C.plausible_capture(F.to_timestamp(L("2024-01-02 00:00:00")), F.to_date(L("2024-01-01"))), True),
        "localized": (C.localized(F.create_map(L("en"), L("sea"), L("zh"), L("海")), "fr", L("id")), "sea"),
        "localized_id": (C.localized(F.create_map(L("zh"), L("海")), "fr", L("id")), "id"),
        "code": (F.bit_count(C.bit_code(L("1" * 64))), 64),
        "signed": (F.array(C.signed_coordinate(L(5.0), L("s")), C.signed_coordinate(L(5.0), L("E"))), [-5.0, 5.0]),
        "display": (C.display_size(L(4), L(3), L(6))["width"], 3),
        "aspect": (F.array(C.clamped_aspect(L(9.0), L(1.0)), C.clamped_aspect(L(1.0), L(9.0))), [2.35, 0.55]),
        "progress": (F.array(C.scan_progress(L(5), L(0), L(True)), C.scan_progress(L(7075), L(7075), L(True)), C.scan_progress(L(1), L(4), L(False))), [None, 0.99, 0.25]),
        "relative": (F.array(C.relative_path(L("/m/a/b.mov"), L("/m")), C.relative_path(L("/m/.t/b.mov"), L("/m")), C.relative_path(L("/mm/b.mov"), L("/m"))), ["a/b.mov", None, None]),
        "label": (C.distinct_label([L("Cafe"), L(" "), L("Taipei"), L("TAIPEI"), L(None).cast("string"), L("Taiwan")]), "Cafe, Taipei, Taiwan"),
        "hop_kind": (F.array(C.hop_kind(L(False), L(50_000.0)), C.hop_kind(L(True), L(9e9)), C.hop_kind(L(False), L(10.0))), ["sea", "land", "land"]),
        "visible": (F.array(C.visible_custom_label(L("über")), C.visible_custom_label(L("uber")), C.visible_custom_label(L("ü"))), [True, False, False]),
        "misplaced": (F.array(C.is_misplaced_gps(L(0.0), L(0.0), none.cast("string")), C.is_misplaced_gps(L(1.0), L(1.0), L("itinerary")), C.is_misplaced_gps(L(1.0), L(1.0), L("user")), C.is_misplaced_gps(none.cast("double"), none.cast("double"), none.cast("string"))), [True, True, False, False]),
        "natural": (F.array_sort(F.array(C.natural_key(L("a10")), C.natural_key(L("a2"))))[0], "a" + "2".zfill(20)),
    }


def test_values(spark):
    every = cases()
    row = spark.range(1).select(*[c.alias(k) for k, (c, _) in every.items()]).head()
    wrong = {k: (row[k], want) for k, (_, want) in every.items() if row[k] != want}
    assert not wrong


def test_great_circle(spark):
    points = spark.range(1).select(C.great_circle(L(0.0), L(0.0), L(0.0), L(90.0), 4).alias("p")).head()["p"]
    assert [round(p["longitude"], 9) for p in points] == [0, 30, 60, 90] and all(abs(p["latitude"]) < 1e-9 for p in points)


def test_upsert_clears(spark):
    old = spark.createDataFrame([(1, "a", "h1"), (2, "b", "h2")], "id int, name string, phash string")
    new = spark.createDataFrame([(1, None, None), (3, "c", None)], "id int, name string, phash string")
    assert sorted(map(tuple, O.upsert(old, new, ["id"], clears=["phash"]).collect())) == [(1, "a", None), (2, "b", "h2"), (3, "c", None)]


def test_hamming_pairs(spark):
    codes = [0, 1, 3, -1, -2, 1 << 62, (1 << 62) + 7]
    rows = spark.createDataFrame(list(enumerate(codes)), "id int, code long")
    want = sorted((i, j, d) for i in range(7) for j in range(i + 1, 7) if (d := ((codes[i] ^ codes[j]) & (1 << 64) - 1).bit_count()) <= 4)
    assert sorted(map(tuple, O.hamming_pairs(rows, "id", "code", 4).collect())) == want and len(want) > 5


def test_content_hashes_by_ranges(spark, tmp_path):
    for name, size in (("a.mov", 10), ("b c.mov", 25), ("d.mov", 1000)):
        (tmp_path / name).write_bytes(bytes(i * 7 % 251 for i in range(size)))
    got = {r["path"].rsplit("/", 1)[1].replace("%20", " "): r["content_hash"] for r in media.content_hashes(spark, str(tmp_path), chunk=20).collect()}
    for name in ("a.mov", "b c.mov", "d.mov"):
        data = (tmp_path / name).read_bytes()
        n = len(data)
        parts = data[:20] + (data[n // 2 - 10 : n // 2 + 10] if n > 40 else b"") + (data[n - 20 :] if n > 20 else b"")
        assert got[name] == hashlib.sha256(n.to_bytes(8, "little") + parts).hexdigest()


def test_hop_and_stays(spark):
    assert Q.hop((0, 10.0, 10.0), (10, 10.0, 10.02)) and not Q.hop((0, 10.0, 10.0), (10, 10.0, 10.2))
    assert Q.hop((0, 1.0, 1.0), (0.5, 1.0, 1.015)) and not Q.hop((0, 1.0, 1.0), (0.5, 1.0, 1.03)) and not Q.hop((0, math.nan, 1.0), (1, 1.0, 1.0))
    track = [(1, 0.0, 25.0, 121.0), (1, 60.0, 25.001, 121.0), (1, 4000.0, 25.1, 121.0), (1, 5000.0, 25.1005, 121.0), (1, 7000.0, 25.1, 121.001), (2, 0.0, 1.0, 1.0)]
    rows = spark.createDataFrame(track, "id int, time double, lat double, lon double")
    got = sorted((r["id"], r["start"], r["end"], round(r["lat"], 4)) for r in Q.stays(rows, ["id"]).collect())
    assert got == [(1, 0.0, 60.0, 25.0005), (1, 4000.0, 7000.0, 25.1), (2, 0.0, 0.0, 1.0)]
