"""Rules of single values, examples for a model, help texts."""

import datetime as dt

from pyspark.sql import functions as F

from medialake.functions import columns as C
from medialake.operators import examples as X
from medialake.sources import guides


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first().asDict()


def test_times_names_and_ranges(spark):
    at = F.lit(dt.datetime(2024, 5, 1, 2, 20, 30))
    t, none, L = F.lit("2024-05-01T10:20:30"), F.lit(None).cast("string"), F.lit
    got = one(
        spark, civil=C.model_time(at, t, L(False)), utc=C.model_time(at, t, L(True)), blank=C.model_time(at, L(""), L(False)), nothing=C.model_time(F.lit(None).cast("timestamp"), none, none.cast("boolean")), seen=C.inspector_time(at, t, L(False)),
        zh=C.app_locale(L("zh_CN")), de=C.app_locale(L("de-AT")), old=C.canonical_model(L(" gemini-2.0-flash "), L("d")), own=C.canonical_model(L("x"), L("d")), empty=C.canonical_model(L(" "), L("gemini-2.5-pro")), null=C.canonical_model(none, L("d")),
        inside=C.loop_playhead(L(2.0), L(1.0), L(3.0)), over=C.loop_playhead(L(2.9995), L(1.0), L(3.0)), under=C.loop_playhead(L(0.97), L(3.0), L(1.0)), near=C.loop_playhead(L(0.985), L(1.0), L(3.0)),
        uris=C.uri_list(F.array(L("/a b/é.mov"), L("/c+d"))), tags=F.transform(C.custom_tags(L("a，b; ;c")), lambda x: x["value"]), clip=C.is_trimmed_clip(L(1)), whole=C.is_trimmed_clip(none),
    )
    assert got == {
        "civil": "2024-05-01T10:20:30", "utc": "2024-05-01T02:20:30Z", "blank": "2024-05-01T02:20:30Z", "nothing": None, "seen": "2024-05-01 10:20:30", "zh": "zh-Hant", "de": "en", "old": "gemini-3.5-flash", "own": "x", "empty": "gemini-3.8-flash", "null": "d",
        "inside": None, "over": 1.0, "under": 1.0, "near": None, "uris": "file:///a%20b/%C3%A9.mov\r\nfile:///c%2Bd\r\n", "tags": ["a", "b", "c"], "clip": True, "whole": False,
    }


def test_tones(spark):
    pixel = lambda r, g, b: F.struct(F.lit(r).alias("r"), F.lit(g).alias("g"), F.lit(b).alias("b"))
    got = one(spark, grey=C.tone_flags(F.array(pixel(0.5, 0.5, 0.5), pixel(0.1, 0.1, 0.1))), warm=C.tone_flags(F.array(pixel(0.9, 0.4, 0.1))), cool=C.tone_flags(F.array(pixel(0.1, 0.2, 0.4))), night=C.tone_flags(F.array(pixel(0.0, 0.0, 0.0), pixel(0.1, 0.1, 0.12))), none=C.tone_flags(F.array().cast("array<struct<r: double, g: double, b: double>>")))
    names = lambda f: {k for k, v in f.asDict().items() if v}
    assert names(got["grey"]) == {"bw"} and names(got["warm"]) == {"vivid", "warm"} and names(got["cool"]) == {"vivid", "cool"} and "dark" in names(got["night"]) and got["none"] is None


SIDE = "array<struct<category: string, value: string>>"


def test_examples(spark):
    tag = "array<struct<category: string, value: string, source: string>>"
    rows = [("a", [("n", "ocean", "ai"), (" n ", "ocean", "ai"), ("n", "own", "user")], [("n", "lake", "user")]), ("b", [("n", "x", "ai"), ("m", "y", "ai")], [("m", "y", "ai"), ("n", "x", "user")]), ("c", [("n", "x", "user")], [("n", "x", "user")]), ("d", [("n", f"{i}", "ai") for i in range(20)], [("n", "x", "user"), ("", "y", "user")])]
    made = X.make_examples(spark.createDataFrame(rows, f"id string, proposed {tag}, kept {tag}"), ["id"])
    got = {r["id"]: ([tuple(x) for x in r["ai"]], [tuple(x) for x in r["kept"]], r["correction"]) for r in made.collect()}
    assert set(got) == {"a", "b", "d"} and got["a"] == ([("n", "ocean")], [("n", "lake")], True) and got["b"][2] is False and len(got["d"][0]) == 12 and got["d"][1] == [("n", "x")]
    assert made.where("id = 'a'").select(X.example_payload(F.col("ai"), F.col("kept"))).first()[0] == '{"ai": [{"category": "n", "value": "ocean"}], "kept": [{"category": "n", "value": "lake"}]}'


def test_examples_in_their_order(spark):
    e = lambda v: ([("c", v)], [("c", v)])
    old = spark.createDataFrame([("w", i, *e(f"o{i}")) for i in range(7)] + [("v", 0, *e("only"))], f"w string, pos int, ai {SIDE}, kept {SIDE}")
    new = spark.createDataFrame([("w", 0, *e("n0"), False), ("w", 1, *e("o3"), True), ("w", 2, *e("n2"), False), ("w", 3, *e("n3"), True), ("w", 4, *e("n0"), False)], f"w string, pos int, ai {SIDE}, kept {SIDE}, correction boolean")
    got = {}
    for r in X.record_examples(old, new, ["w"]).orderBy("w", "pos").collect():
        got.setdefault(r["w"], []).append((r["pos"], r["ai"][0]["value"]))
    assert got == {"v": [(0, "only")], "w": list(enumerate(["o3", "n3", "n0", "o0", "o1", "o2", "o4", "o5"]))}
    tags = spark.createDataFrame([("custom", "a", "ai"), ("custom", "a", "user"), ("custom", "b", "x"), ("n", "c", "user")], "category string, value string, source string")
    assert sorted(map(tuple, X.custom_tags_in_use(tags).collect())) == [("a", "user"), ("b", "x")]


def test_help_texts(spark):
    text = "# Guide\nlost\n## Start {#start}\nFirst\nline.\n\n- one\n* two\n1. do\n12. that \nafter\n## No id\nlost\n## Next { #x}\n## Last {# end }\n2024.x\n\n\n- only\n"
    lines = guides.topics(spark.createDataFrame([("en", text), ("empty", "")], "file string, text string"))
    got = [(r["id"], r["title"], r["kind"], r["items"]) for r in guides.blocks(lines).orderBy("file", "topic", "block").collect()]
    assert got == [("start", "Start", "paragraph", ["First line."]), ("start", "Start", "bullets", ["one", "two"]), ("start", "Start", "steps", ["do", "that"]), ("start", "Start", "paragraph", ["after"]), ("end", "Last", "paragraph", ["2024.x"]), ("end", "Last", "bullets", ["only"])]
