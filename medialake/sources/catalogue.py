"""A library's catalogue as versioned tables.

Each table's rows are dealt to buckets by a hash of one column; a bucket is a
folder of Parquet files. A version is one small manifest, which names the folder
of every bucket. A change stages new folders for the buckets that it touches,
checks keys and references on what was staged, and writes the next manifest, all or
nothing: until then, and if anything fails, readers have the version before. Two
changes made from the same version can't both be committed. Files of old
versions stay until :meth:`Catalogue.sweep`.

The driver holds bucket numbers and folder names, as many as there are buckets; rows stay in Spark.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Table:
    """Columns as DDL, the primary key, the column that deals rows, columns that may not be null or not occur twice, and parents (column: table and column), with whose rows a row goes."""

    columns: str
    key: tuple[str, ...]
    dealt: str
    required: tuple[str, ...] = ()
    unique: tuple[str, ...] = ()
    parents: Mapping[str, tuple[str, str]] = field(default_factory=dict)


TABLES = {
    "footage": Table(
        "id string, relative_path string, filename string, size long, mtime long, content_hash string, phash string, status string, duration double, width int, height int, "
        "created_at double, updated_at double, parent_id string, user_notes string, metadata_json string",
        ("id",), "id", ("id", "relative_path", "filename", "size", "mtime", "status", "created_at", "updated_at"), ("relative_path",),
    ),
    "tags": Table("footage_id string, category string, value string, source string", ("footage_id", "category", "value", "source"), "footage_id", ("footage_id", "category", "value", "source"), parents={"footage_id": ("footage", "id")}),
    "duplicate_groups": Table("id string, content_hash string, resolution string", ("id",), "id", ("id", "content_hash", "resolution")),
    "duplicate_members": Table("group_id string, footage_id string", ("group_id", "footage_id"), "footage_id", ("group_id", "footage_id"), parents={"group_id": ("duplicate_groups", "id")}),
    "schema_info": Table("key string, value string", ("key",), "key", ("key", "value")),
}


class Conflict(Exception):
    """Another change was committed meanwhile."""


class Invalid(Exception):
    """A key, a required value or a reference is violated."""


class Catalogue:
    """The tables below ``root``, on any file system that Spark writes to."""

    def __init__(self, spark: SparkSession, root: str, tables: Mapping[str, Table] = TABLES, buckets: int = 64):
        self.spark, self.root, self.tables, self.buckets = spark, root.rstrip("/"), tables, buckets
        self._jvm = spark.sparkContext._jvm
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def _manifests(self) -> list[int]:
        versions = self._path("versions")
        if not self._fs.exists(versions):
            return []
        return sorted(int(s.getPath().getName().removesuffix(".json")) for s in self._fs.listStatus(versions) if s.getPath().getName().endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        """That of ``version``, or of the last one that was written to its end."""
        for n in reversed(self._manifests() if version is None else [version]):
            stream = self._fs.open(self._path(f"versions/{n:012d}.json"))
            try:
                text = bytes(stream.readAllBytes()).decode()
            finally:
                stream.close()
            try:
                return json.loads(text)
            except ValueError:
                if version is not None:
                    raise
        return {"version": 0, "buckets": self.buckets, "tables": {}}

    def read(self, name: str, version: int | None = None, manifest: dict | None = None) -> DataFrame:
        found = (manifest or self.manifest(version))["tables"].get(name, {})
        reader = self.spark.read.schema(self.tables[name].columns)
        return reader.parquet(*[f"{self.root}/{p}" for p in found.values()]) if found else self.spark.createDataFrame([], self.tables[name].columns)

    def change(self) -> Change:
        return Change(self)

    def sweep(self, keep: int = 1) -> int:
        """Removes the manifests before the last ``keep`` and the folders that none of the others names; returns how many folders went. No change may be running."""
        last = self.manifest()["version"]
        kept = [self.manifest(n) for n in self._manifests() if last - keep < n <= last]
        named = {p.rsplit("/", 1)[0] for m in kept for t in m["tables"].values() for p in t.values()}
        gone = 0
        for name in self.tables:
            at = self._path(name)
            for s in self._fs.listStatus(at) if self._fs.exists(at) else []:
                if f"{name}/{s.getPath().getName()}" not in named:
                    gone += bool(self._fs.delete(s.getPath(), True))
        for n in self._manifests():
            if n <= last - keep or n > last:
                self._fs.delete(self._path(f"versions/{n:012d}.json"), False)
        return gone


class Change:
    """Puts and deletes on one version, committed together."""

    def __init__(self, catalogue: Catalogue):
        self.catalogue, self.base = catalogue, catalogue.manifest()
        self._now: dict[str, DataFrame] = {}
        self._touched: dict[str, list[DataFrame]] = {}

    def table(self, name: str) -> DataFrame:
        """A table as it is after what was put and deleted so far."""
        return self._now[name] if name in self._now else self.catalogue.read(name, manifest=self.base)

    def _bucket(self, column: str) -> Column:
        return F.pmod(F.xxhash64(column), F.lit(self.base["buckets"])).cast("int")

    def _touch(self, name: str, rows: DataFrame) -> None:
        self._touched.setdefault(name, []).append(rows.select(self._bucket(self.catalogue.tables[name].dealt).alias("bucket")))

    def put(self, name: str, rows: DataFrame) -> None:
        """Rows that replace those of the same primary key."""
        table = self.catalogue.tables[name]
        own = self.table(name)
        rows = rows.select([F.col(f.name).cast(f.dataType) for f in own.schema])
        self._now[name] = own.join(rows.select(*table.key).distinct(), list(table.key), "left_anti").select(own.columns).unionByName(rows)
        self._touch(name, rows)

    def delete(self, name: str, keys: DataFrame) -> None:
        """Rows that have the values of one of ``keys``' rows, and all that refer to them."""
        own = self.table(name)
        keys = keys.distinct()
        gone = own.join(keys, keys.columns, "left_semi").select(own.columns)
        self._now[name] = own.join(keys, keys.columns, "left_anti").select(own.columns)
        self._touch(name, gone)
        for child, table in self.catalogue.tables.items():
            for column, (parent, of) in table.parents.items():
                if parent == name:
                    self.delete(child, gone.select(F.col(of).alias(column)))

    def _stage(self, name: str, at: str) -> dict[str, str]:
        """Writes the touched buckets; returns the table's folders by bucket."""
        own, spark = self._now[name], self.catalogue.spark
        every = self._touched[name][0]
        for more in self._touched[name][1:]:
            every = every.unionByName(more)
        touched = {r["bucket"] for r in every.distinct().collect()}  # as many as there are buckets at most
        folders = dict(self.base["tables"].get(name, {}))
        for b in touched:
            folders.pop(str(b), None)
        dealt = self.catalogue.tables[name].dealt
        rows = own.withColumn("bucket", self._bucket(dealt)).where(F.col("bucket").isin(sorted(touched))) if touched else own.limit(0).withColumn("bucket", F.lit(0))
        rows.repartition("bucket").write.partitionBy("bucket").parquet(f"{self.catalogue.root}/{at}")
        written = spark.read.schema(f"{self.catalogue.tables[name].columns}, bucket int").option("basePath", f"{self.catalogue.root}/{at}").parquet(f"{self.catalogue.root}/{at}")
        self._check(name, written)
        return folders | {str(r["bucket"]): f"{at}/bucket={r['bucket']}" for r in written.select("bucket").distinct().collect()}

    def _check(self, name: str, written: DataFrame) -> None:
        """Of the rows in the touched buckets; a key's rows lie in one bucket if the key holds the column that deals."""
        table = self.catalogue.tables[name]

        def none(rows: DataFrame, what: str) -> None:
            if not rows.isEmpty():
                raise Invalid(f"{name}: {what}")

        for c in dict.fromkeys((*table.key, *table.required)):
            none(written.where(F.col(c).isNull()), f"{c} is null")
        none(written.groupBy(*table.key).count().where("count > 1"), f"{', '.join(table.key)} occurs twice")
        for c in table.unique:
            of = written.select(c).distinct()
            none(self.table(name).select(c).join(of, c, "left_semi").groupBy(c).count().where("count > 1"), f"{c} occurs twice")
        for c, (parent, of) in table.parents.items():
            none(written.select(c).distinct().join(self.table(parent).select(F.col(of).alias(c)), c, "left_anti"), f"{c} has no row in {parent}")

    def commit(self) -> int:
        """The new version's number."""
        cat, name = self.catalogue, uuid.uuid4().hex
        tables = dict(self.base["tables"])
        for t in self._now:
            tables[t] = self._stage(t, f"{t}/{name}")
        if cat.manifest()["version"] != self.base["version"]:
            raise Conflict(f"version {self.base['version']} isn't the last one any more")
        version = max([0, *cat._manifests()]) + 1
        text = json.dumps({"version": version, "buckets": self.base["buckets"], "tables": tables})
        cat._fs.mkdirs(cat._path("versions"))
        try:
            stream = cat._fs.create(cat._path(f"versions/{version:012d}.json"), False)
        except Exception as e:
            raise Conflict(f"version {version} was committed meanwhile") from e
        stream.write(bytearray(text.encode()))
        stream.close()
        return version


# -- mutations ----------------------------------------------------------------------------------------------------------------
def create(catalogue: Catalogue) -> int:
    """The first version, with the schema's number; an existing catalogue stays as it is."""
    if catalogue.manifest()["version"]:
        return catalogue.manifest()["version"]
    change = catalogue.change()
    change.put("schema_info", catalogue.spark.createDataFrame([("version", "1")], "key string, value string"))
    return change.commit()


def put_footage(change: Change, records: DataFrame, tags: DataFrame, now: float) -> None:
    """Rows that are updated if their id is known (``created_at`` stays), else inserted, and all their tags: each once, by its best source.

    ``records`` has the columns of footage but the stamps, ``tags`` the columns of tags; a record without tags loses those that it had.
    """
    from medialake.operators.relations import best_source

    old = change.table("footage").select("id", F.col("created_at").alias("_created"))
    rows = records.join(old, "id", "left").withColumn("created_at", F.coalesce("_created", F.lit(now))).withColumn("updated_at", F.lit(now))
    ids = records.select(F.col("id").alias("footage_id"))
    change.put("footage", rows)
    change.delete("tags", ids)
    of = tags.join(ids, "footage_id", "left_semi").withColumn("_pos", F.lit(0))
    change.put("tags", best_source(of, ["footage_id", "category", "value"], "source", "_pos"))


def set_columns(change: Change, changes: DataFrame, now: float) -> None:
    """Sets the columns that ``changes`` has beside ``id``, null included, and ``updated_at``; unknown ids are left out."""
    new = [c for c in changes.columns if c != "id"]
    own = change.table("footage")
    given = changes.select(F.col("id"), *[F.col(c).alias(f"_{c}") for c in new])
    rows = own.join(given, "id").withColumn("updated_at", F.lit(now))
    change.put("footage", rows.select(*[F.col(f"_{c}").alias(c) if c in new else F.col(c) for c in own.columns]))


def add_tags(change: Change, ids: DataFrame, tags: Sequence[tuple[str, str, str]]) -> None:
    """Gives each of ``ids`` (id) the tags (category, value, source), the best source of one that is named twice; one that a row has already takes the new source."""
    if not tags:
        return
    best: dict[tuple[str, str], str] = {}
    for category, value, source in tags:
        ranks = {"user": 0, "path": 1, "ai": 2}
        known = best.get((category, value))
        if known is None or ranks.get(source, 3) < ranks.get(known, 3):
            best[category, value] = source
    each = F.explode(F.array(*[F.struct(*[F.lit(x).alias(c) for c, x in zip(("category", "value", "source"), (*key, source))]) for key, source in best.items()]))
    rows = ids.select(F.col("id").alias("footage_id")).distinct().select("footage_id", each.alias("t")).select("footage_id", "t.*")
    change.delete("tags", rows.select("footage_id", "category", "value"))
    change.put("tags", rows)


def remove_tags(change: Change, ids: DataFrame, tags: Sequence[tuple[str, str]] = (), source: str | None = None) -> None:
    """Takes the tags (category, value) of any source from ``ids``, or all those of one ``source``."""
    own = ids.select(F.col("id").alias("footage_id")).distinct()
    for category, value in tags:
        change.delete("tags", own.select("footage_id", F.lit(category).alias("category"), F.lit(value).alias("value")))
    if source is not None:
        change.delete("tags", own.select("footage_id", F.lit(source).alias("source")))


def delete_footage(change: Change, ids: DataFrame) -> None:
    """Rows with their tags and places in duplicate groups."""
    change.delete("duplicate_members", ids.select(F.col("id").alias("footage_id")))
    change.delete("footage", ids.select("id"))


def set_resolution(change: Change, groups: DataFrame) -> None:
    """``groups``: id, resolution."""
    own = change.table("duplicate_groups")
    change.put("duplicate_groups", own.join(groups.select("id", F.col("resolution").alias("_new")), "id").select("id", "content_hash", F.col("_new").alias("resolution")))


def refresh_duplicates(change: Change) -> None:
    """Groups of available rows with the same content; a group that was there before keeps its resolution.

    A group's id is a name-based UUID of its content, so that it stays the same from one refresh to the next.
    """
    old = change.table("duplicate_groups").groupBy("content_hash").agg(F.max("resolution").alias("_old"))
    rows = change.table("footage").where((F.col("status") == "available") & F.col("content_hash").isNotNull()).select("id", "content_hash")
    h = F.sha2("content_hash", 256)
    name = F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    groups = rows.groupBy("content_hash").agg(F.count("*").alias("_n")).where("_n > 1").join(old, "content_hash", "left").select(name.alias("id"), "content_hash", F.coalesce("_old", F.lit("unresolved")).alias("resolution"))
    members = rows.join(groups.select(F.col("id").alias("group_id"), "content_hash"), "content_hash").select("group_id", F.col("id").alias("footage_id"))
    change.delete("duplicate_groups", change.table("duplicate_groups").select("id"))
    change.put("duplicate_groups", groups)
    change.put("duplicate_members", members)


def merge_duplicates(change: Change, merged: DataFrame, now: float) -> None:
    """Gives the keeper and the others of a group all their tags, and a keeper without notes the first others' notes.

    ``merged``: keeper, id, pos (the others, in order). A tag that several have keeps its best source.
    """
    from medialake.operators.relations import best_source

    all_of = merged.select("keeper", "id").unionByName(merged.select("keeper", F.col("keeper").alias("id"))).distinct()
    tags = all_of.join(change.table("tags").withColumnRenamed("footage_id", "id"), "id").withColumn("_pos", F.lit(0))
    union = best_source(tags.drop("id"), ["keeper", "category", "value"], "source", "_pos")
    change.delete("tags", all_of.select(F.col("id").alias("footage_id")))
    change.put("tags", all_of.join(union, "keeper").select(F.col("id").alias("footage_id"), "category", "value", "source"))
    footage = change.table("footage").select("id", "user_notes")
    noted = merged.join(footage, "id").where(F.coalesce("user_notes", F.lit("")) != "").groupBy("keeper").agg(F.min_by("user_notes", "pos").alias("user_notes"))
    blank = footage.where(F.coalesce("user_notes", F.lit("")) == "").select(F.col("id").alias("keeper"))
    set_columns(change, noted.join(blank, "keeper").select(F.col("keeper").alias("id"), "user_notes"), now)
