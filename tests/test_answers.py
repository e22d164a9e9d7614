"""Answers of any shape, side files, and the gate's branches one by one."""

import json

import pytest
from pyspark.sql import functions as F

from medialake.functions import variants as V
from medialake.operators import gate as G
from medialake.sources import side_files as S


def answers(spark, texts):
    v = F.col("v")
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", V.answer(F.col("t")).alias("v"))
    return rows.select("i", F.transform(V.answer_tags(v), lambda t: F.concat_ws("/", t["category"], t["value"])).alias("tags"), V.answer_keywords(v).alias("keywords"), V.compact_json(v).alias("compact")).orderBy("i").collect()


def test_answers(spark):
    texts = [
        '{"tags":[{"category":"nature","value":"ocean"},{"category":"mood","value":"calm"}]}',
        '```json\n{"tags":[\n  {"category":"nature","value":"ocean"},\n  {"category":"nature","value":"ocean"},\n  {"category":"","value":"skip"}\n]}\n```',
        "not json", "", None, "42", '"text"', "{broken", 'so {"tags": [{"category": "a", "value": "b"}]} it is', '[{"category":"a","value":" b "},{"category":1,"value":"c"},null,"x",{"value":"c"}]', "``` [1] ```", '{"tags": {"category": "a"}}',
    ]
    got = [r["tags"] for r in answers(spark, texts)]
    assert got == [["nature/ocean", "mood/calm"], ["nature/ocean"], [], [], [], [], [], [], ["a/b"], ["a/b"], [], []]
    found = [r["keywords"] for r in answers(spark, ['{"tags":[{"category":"nature","value":"ocean"}],"keywords":["Icebreaker","arctic ocean","ab","nope!!!"]}', '["Icebreaker"]', '{"keywords":"x"}', json.dumps({"keywords": [f"word {i}" for i in range(30)] + [{"value": " ", "keyword": "late"}]})])]
    assert found[:3] == [["icebreaker", "arctic ocean"], [], []] and found[3] == [f"word {i}" for i in range(20)]


def test_compact_json(spark):
    values = [
        {"b": [1, 2.0, -0.5, 103.8], "a": {"z": None, "y": True, "x": "q\"u\\o/te, a: b"}}, [], {}, [[], {}, [{"a": [{}]}]], {"é": "日本, 1.0", "k": "12.0"}, [100.0, 10.05, 1.20, 0.0, -7.000, 12345678901234567890],
    ]
    got = [r["compact"] for r in answers(spark, [json.dumps(v, ensure_ascii=False) for v in values])]

    def plain(v):
        if isinstance(v, dict):
            return "{" + ", ".join(f"{plain(k)}: {plain(v[k])}" for k in sorted(v)) + "}"
        if isinstance(v, list):
            return "[" + ", ".join(map(plain, v)) + "]"
        if isinstance(v, float) and v == int(v):
            return str(int(v))
        return json.dumps(v, ensure_ascii=False).replace("/", "\\/")

    assert got == [plain(v) for v in values]
    deep = '{"a":[' * 200 + "1" + "]}" * 200
    assert answers(spark, [deep])[0]["compact"] == '{"a": [' * 200 + "1" + "]}" * 200


U = "00000000-0000-0000-0000-00000000000"


def test_side_files(spark, tmp_path):
    trip = {"id": U + "1", "name": "Trip", "source": "gpx", "gpxFilename": "t.gpx", "folder": "a", "memberIDs": [U + "2"], "pendingIDs": [], "createdAt": "2024-05-01T10:20:30Z", "mapLatitude": 1, "extra": 1}
    later = {**trip, "id": U + "3", "gpxFilename": None, "source": "timeline", "mapLatitude": 2.5}
    at = tmp_path / "itineraries.json"

    def read(value):
        at.write_text(value if isinstance(value, str) else json.dumps(value))
        return S.itineraries(spark, str(at)).orderBy("pos").collect()

    got = read([trip, later])
    assert [(r["id"], r["source"], r["gpx_filename"], r["member_ids"], r["pending_ids"], r["map_latitude"], r["map_longitude"]) for r in got] == [(U + "1", "gpx", "t.gpx", [U + "2"], [], 1.0, None), (U + "3", "timeline", None, [U + "2"], [], 2.5, None)]
    assert got[0]["created_at"].timestamp() == pytest.approx(1714558830)
    for bad in ({"id": "x"}, {"name": None}, {"memberIDs": ["x"]}, {"createdAt": "2024-05-01"}, {"mapLatitude": "1"}, {"source": "other"}):
        assert read([trip, {**later, **bad}]) == []  # one bad item empties the list
    assert read([{k: v for k, v in trip.items() if k != "folder"}]) == read("{") == read({"a": 1}) == read([]) == []
    (tmp_path / "declined.json").write_text(json.dumps({"declinedIDs": [U + "1", U + "1", U + "2"]}))
    assert sorted(r["id"] for r in S.declined_retouches(spark, str(tmp_path / "declined.json")).collect()) == [U + "1", U + "2"]
    assert S.declined_retouches(spark, str(tmp_path / "none.json")).count() == 0
    (tmp_path / "places.json").write_text(json.dumps({"entries": [{"latitude": 1.5, "longitude": 2, "label": "A"}, {"latitude": 3, "longitude": 4, "label": "B"}]}))
    assert [tuple(r) for r in S.geocode_entries(spark, str(tmp_path / "places.json")).orderBy("pos").collect()] == [(0, 1.5, 2.0, "A"), (1, 3.0, 4.0, "B")]
    (tmp_path / "config.json").write_text(json.dumps({"version": 1, "warehouses": [{"id": U + "1", "name": "Travel", "path": "/v/t", "bookmark": None}]}))
    assert [tuple(r) for r in S.warehouses(spark, str(tmp_path / "config.json")).collect()] == [(0, U + "1", "Travel", "/v/t")]


SEEN = {"people": "two", "hands": True, "face": "portrait", "animals": ["dog"], "reliable": True}
NOBODY = {"people": "none", "hands": False, "face": "none", "animals": [], "reliable": True}


@pytest.fixture(scope="module")
def gated(spark):
    """Each case is a row of its own: (tags as category/value, what was seen or None) -> the tags that stay."""
    cases = {
        "counts are replaced": (["people/one", "people/crowd", "mood/calm"], SEEN, ["mood/calm", "people/two", "people/hands"]),
        "nobody": (["people/portrait", "people/senior", "people/silhouette", "people/hands", "people/other"], NOBODY, ["people/other", "people/none"]),
        "portrait and distant follow the face": (["people/portrait", "people/distant"], SEEN, ["people/portrait", "people/two", "people/hands"]),
        "distant": (["people/portrait", "people/distant"], SEEN | {"face": "distant", "hands": False}, ["people/distant", "people/two"]),
        "hands stay in their place": (["people/hands", "mood/calm"], SEEN, ["people/hands", "mood/calm", "people/two"]),
        "hands without hands": (["people/hands"], SEEN | {"hands": False}, ["people/two"]),
        "pets": (["animals/pet", "animals/bird", "custom/puppy love", "custom/House Pet", "custom/catalogue"], SEEN | {"animals": [], "hands": False}, ["animals/bird", "custom/catalogue", "people/two"]),
        "pets beside an animal": (["animals/pet", "custom/my pets"], SEEN | {"hands": False}, ["animals/pet", "custom/my pets", "people/two"]),
        "identities that need somebody": (["lifestyle/family", "lifestyle/city", "sport/spectators", "sport/kidsPlay", "lifestyle/friends", "other/family"], NOBODY | {"animals": ["dog"]}, ["lifestyle/city", "other/family", "people/none"]),
        "people keywords": (["custom/two Men", "custom/no people", "custom/ No People ", "custom/manual", "custom/crowd  scene"], NOBODY, ["custom/no people", "custom/ No People ", "custom/manual", "people/none"]),
        "people keywords beside people": (["custom/two men"], SEEN | {"hands": False}, ["custom/two men", "people/two"]),
        "calendar": (["custom/March", "custom/march walk", "custom/ Friday ", "time/march"], SEEN | {"hands": False}, ["custom/march walk", "time/march", "people/two"]),
        "not looked at": (["custom/March", "people/one", "animals/pet", "custom/two men"], None, ["people/one", "animals/pet", "custom/two men"]),
        "not reliable": (["people/portrait", "custom/pet"], SEEN | {"reliable": False}, ["people/none"]),
        "repeated": (["mood/calm", "mood/calm"], None, ["mood/calm"]),
        "nothing": ([], NOBODY, ["people/none"]),
    }
    tags = [(name, *t.split("/", 1), "model", i) for name, (ts, _, _) in cases.items() for i, t in enumerate(ts)]
    seen = [(name, *(s[k] for k in ("people", "hands", "face", "animals", "reliable"))) for name, (_, s, _) in cases.items() if s]
    out = G.apply_gate(spark.createDataFrame(tags, "id string, category string, value string, source string, pos int"), spark.createDataFrame(seen, "id string, people string, hands boolean, face string, animals array<string>, reliable boolean"), "id")
    got = {}
    for r in out.orderBy("id", "pos").collect():
        got.setdefault(r["id"], []).append((f"{r['category']}/{r['value']}", r["source"]))
    return cases, got


def test_every_branch_of_the_gate(gated):
    cases, got = gated
    assert {name: [t for t, _ in got.get(name, [])] for name in cases} == {name: expected for name, (_, _, expected) in cases.items()}
    assert dict(got["counts are replaced"])["people/two"] == "ai" and dict(got["hands stay in their place"])["people/hands"] == "model"


def test_keyword_classes(spark):
    words = ["Two  People", "no people", "manual", " March ", "march walk", "House pet", "puppy", "petunia", "someone"]
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", G.is_people_keyword(F.col("w")), G.is_calendar_keyword(F.col("w")), G.is_pet_keyword(F.col("w"))).collect()
    assert [w for w, p, _, _ in rows if p] == ["Two  People", "someone"] and [w for w, _, c, _ in rows if c] == [" March "] and [w for w, _, _, p in rows if p] == ["House pet", "puppy"]


def test_an_answer_is_parsed_once():
    """A value that an expression uses several times is bound, not written out each time."""
    assert str(V.answer(F.col("t"))._jc.toString()).count("try_parse_json") == 2
    keys = str(V.first_of(F.col("x"), lambda x: F.md5(x))._jc.toString())
    assert keys.count("md5") == 1
