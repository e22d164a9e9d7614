"""The versioned catalogue: versions, keys, references, failed and rival changes, and its mutations."""

import hashlib

import pytest
from pyspark.sql import functions as F

from medialake.operators import flows
from medialake.sources import catalogue as K

FOOTAGE = "id string, relative_path string, filename string, size long, mtime long, content_hash string, phash string, status string, duration double, width int, height int, parent_id string, user_notes string, metadata_json string"
TAGS = "footage_id string, category string, value string, source string"


def footage(spark, *ids, **same):
    base = {"size": 1, "mtime": 1, "content_hash": None, "phash": None, "status": "available", "duration": None, "width": None, "height": None, "parent_id": None, "user_notes": "", "metadata_json": None}
    rows = []
    for i in ids:
        given, own = (i, {}) if isinstance(i, str) else i
        rows.append({"id": given, "relative_path": f"d/{given}.jpg", "filename": f"{given}.jpg"} | base | same | own)
    return spark.createDataFrame(rows, FOOTAGE)


def tags(spark, *rows):
    return spark.createDataFrame(list(rows), TAGS)


@pytest.fixture
def store(spark, tmp_path):
    cat = K.Catalogue(spark, str(tmp_path / "cat"), buckets=8)
    assert K.create(cat) == K.create(cat) == 1
    change = cat.change()
    K.put_footage(change, footage(spark, *"abcdef"), tags(spark, ("a", "mood", "calm", "ai"), ("a", "mood", "calm", "user"), ("b", "mood", "wild", "path"), ("zz", "x", "y", "user")), 10.0)
    assert change.commit() == 2
    return cat


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def ids(spark, *found):
    return spark.createDataFrame([(i,) for i in found], "id string")


def test_put_keeps_creation_and_replaces_tags(spark, store):
    assert rows_of(store.read("tags")) == [("a", "mood", "calm", "user"), ("b", "mood", "wild", "path")]
    change = store.change()
    K.put_footage(change, footage(spark, ("a", {"user_notes": "new"}), "g"), tags(spark, ("g", "c", "v", "ai")), 20.0)
    change.commit()
    got = {r["id"]: (r["created_at"], r["updated_at"], r["user_notes"]) for r in store.read("footage").collect()}
    assert got["a"] == (10.0, 20.0, "new") and got["g"] == (20.0, 20.0, "") and got["b"] == (10.0, 10.0, "")
    assert rows_of(store.read("tags")) == [("b", "mood", "wild", "path"), ("g", "c", "v", "ai")]
    assert len(rows_of(store.read("footage", version=2))) == 6  # the version before is as it was


def test_only_touched_buckets_are_written(spark, store):
    before = store.manifest()["tables"]
    change = store.change()
    K.set_columns(change, spark.createDataFrame([("a", None, 3.5)], "id string, user_notes string, duration double"), 30.0)
    change.commit()
    after = store.manifest()["tables"]
    assert sum(after["footage"][b] != before["footage"].get(b) for b in after["footage"]) == 1 and after["tags"] == before["tags"]
    assert store.read("footage").where("id = 'a'").select("user_notes", "duration", "updated_at").first() == (None, 3.5, 30.0)


def test_cascades(spark, store):
    change = store.change()
    K.put_footage(change, footage(spark, *"abc", content_hash="h"), tags(spark, ("a", "m", "1", "user"), ("b", "m", "2", "user")), 11.0)
    K.refresh_duplicates(change)
    change.commit()
    group = store.read("duplicate_groups").first()
    assert (group["content_hash"], group["resolution"]) == ("h", "unresolved") and store.read("duplicate_members").count() == 3
    change = store.change()
    K.delete_footage(change, ids(spark, "a", "nobody"))
    change.commit()
    assert rows_of(store.read("tags")) == [("b", "m", "2", "user")] and {r["footage_id"] for r in store.read("duplicate_members").collect()} == {"b", "c"}
    change = store.change()
    K.set_resolution(change, spark.createDataFrame([(group["id"], "ignored"), ("nobody", "x")], "id string, resolution string"))
    K.refresh_duplicates(change)
    change.commit()
    assert rows_of(store.read("duplicate_groups").select("content_hash", "resolution")) == [("h", "ignored")]
    change = store.change()
    change.delete("duplicate_groups", ids(spark, group["id"]))
    change.commit()
    assert store.read("duplicate_members").count() == 0 and store.read("footage").count() == 5


def test_violations_leave_the_version_before(spark, store):
    before = rows_of(store.read("footage"))

    def refused(do, what):
        change = store.change()
        do(change)
        with pytest.raises(K.Invalid, match=what):
            change.commit()
        assert store.manifest()["version"] == 2 and rows_of(store.read("footage")) == before

    twice = footage(spark, "x").unionByName(footage(spark, "x", relative_path="other"))
    refused(lambda c: K.put_footage(c, twice, tags(spark), 1.0), "id occurs twice")
    refused(lambda c: K.put_footage(c, footage(spark, "x", relative_path="d/a.jpg"), tags(spark), 1.0), "relative_path occurs twice")
    refused(lambda c: K.put_footage(c, footage(spark, ("x", {"size": None})), tags(spark), 1.0), "size is null")
    refused(lambda c: c.put("tags", tags(spark, ("nobody", "m", "v", "user"))), "footage_id has no row in footage")
    refused(lambda c: c.put("duplicate_members", spark.createDataFrame([("g", "a")], "group_id string, footage_id string")), "group_id has no row")


def test_a_failed_write_and_a_torn_manifest(spark, store):
    change = store.change()
    change.put("footage", store.read("footage").withColumn("size", F.raise_error(F.lit("disk full")).cast("long")))
    with pytest.raises(Exception, match="disk full"):
        change.commit()
    assert store.manifest()["version"] == 2 and store.read("footage").count() == 6
    stream = store._fs.create(store._path("versions/000000000003.json"), False)
    stream.write(bytearray(b'{"version": 3, "tab'))
    stream.close()
    assert store.manifest()["version"] == 2
    change = store.change()
    K.delete_footage(change, ids(spark, "a"))
    assert change.commit() == 4 and store.read("footage").count() == 5


def test_rivals_and_sweep(spark, store):
    one, two = store.change(), store.change()
    K.delete_footage(one, ids(spark, "a"))
    K.delete_footage(two, ids(spark, "b"))
    one.commit()
    with pytest.raises(K.Conflict):
        two.commit()
    assert {r["id"] for r in store.read("footage").collect()} == set("bcdef")
    assert store.sweep() > 0 and store.read("footage").count() == 5 and store.sweep() == 0


def test_tags_given_and_taken(spark, store):
    change = store.change()
    K.add_tags(change, ids(spark, "a", "c", "c"), [("mood", "calm", "ai"), ("x", "1", "path"), ("x", "1", "user")])
    K.add_tags(change, ids(spark, "a"), [])
    change.commit()
    assert rows_of(store.read("tags")) == [("a", "mood", "calm", "ai"), ("a", "x", "1", "user"), ("b", "mood", "wild", "path"), ("c", "mood", "calm", "ai"), ("c", "x", "1", "user")]
    change = store.change()
    K.remove_tags(change, ids(spark, "a", "b"), [("x", "1")], source="path")
    change.commit()
    assert rows_of(store.read("tags")) == [("a", "mood", "calm", "ai"), ("c", "mood", "calm", "ai"), ("c", "x", "1", "user")]


def test_merge_of_duplicates(spark, store):
    change = store.change()
    K.set_columns(change, spark.createDataFrame([("b", "second"), ("c", "first")], "id string, user_notes string"), 1.0)
    K.merge_duplicates(change, spark.createDataFrame([("a", "b", 2), ("a", "c", 1)], "keeper string, id string, pos int"), 2.0)
    change.commit()
    assert rows_of(store.read("tags")) == [(i, "mood", *t) for i in "abc" for t in (("calm", "user"), ("wild", "path"))]
    assert {r["id"]: r["user_notes"] for r in store.read("footage").where("id in ('a', 'b', 'c')").collect()} == {"a": "first", "b": "second", "c": "first"}


def test_reconciling_a_library(spark, tmp_path):
    cat = K.Catalogue(spark, str(tmp_path / "cat"), buckets=4)
    K.create(cat)
    content, asked = {}, []

    def run(files, now, discarded=None):
        content.clear()
        content.update(files)
        listing = spark.createDataFrame([(p, len(c), t) for p, (c, t) in files.items()] or [], "relative_path string, size long, mtime long")

        def hashes(paths):
            found = [r["path"] for r in paths.collect()]
            asked.append(sorted(found))
            return spark.createDataFrame([(p, hashlib.sha256(content[p][0]).hexdigest()) for p in found], "path string, hash string")

        version, pending = flows.reconcile_library(cat, listing, hashes, now, discarded)
        return {r["relative_path"]: r for r in cat.read("footage", version).collect()}, sorted(r["relative_path"] for r in pending.collect())

    first, pending = run({"a.jpg": (b"one", 1), "b.mov": (b"two", 2), "sub/c.jpg": (b"one", 3)}, 100.0)
    assert pending == ["a.jpg", "b.mov", "sub/c.jpg"] and first["sub/c.jpg"]["filename"] == "c.jpg"
    assert cat.read("duplicate_members").count() == 2
    change = cat.change()
    K.add_tags(change, ids(spark, first["a.jpg"]["id"]), [("m", "v", "user")])
    K.set_columns(change, spark.createDataFrame([(first["a.jpg"]["id"], "ph"), (first["b.mov"]["id"], "pv")], "id string, phash string"), 101.0)
    change.commit()
    second, pending = run({"new/a.jpg": (b"one", 9), "b.mov": (b"changed", 4), "sub/c.jpg": (b"one", 3), "d.jpg": (b"four", 5)}, 200.0)
    assert asked[-1] == ["b.mov", "d.jpg", "new/a.jpg"]  # the stable one isn't read
    assert second["new/a.jpg"]["id"] == first["a.jpg"]["id"] and (second["new/a.jpg"]["phash"], second["new/a.jpg"]["created_at"]) == ("ph", 100.0)
    assert (second["b.mov"]["id"], second["b.mov"]["phash"], second["b.mov"]["updated_at"]) == (first["b.mov"]["id"], None, 200.0)
    assert second["sub/c.jpg"] == first["sub/c.jpg"]
    assert pending == ["b.mov", "d.jpg"] and cat.read("tags").count() == 1
    third, pending = run({"d.jpg": (b"four", 5)}, 300.0, discarded=ids(spark, second["b.mov"]["id"]))
    assert {p: r["status"] for p, r in third.items()} == {"new/a.jpg": "missing", "b.mov": "available", "sub/c.jpg": "missing", "d.jpg": "available"}
    assert pending == [] and cat.read("duplicate_groups").count() == 0
