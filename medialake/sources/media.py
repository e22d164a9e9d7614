"""Reading media libraries: listings, tracks, side files."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pa_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from medialake.functions import columns as C


def listing(spark: SparkSession, root: str) -> DataFrame:
    """(relative_path, size, mtime, kind) of a library's media; contents aren't read.

    Spark's own file index leaves out names that begin with ``_`` or ``.``.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length", "modificationTime")
    base = root.rstrip("/").split("://", 1)[-1].removeprefix("file:").rstrip("/") + "/"
    relative = F.when(F.instr("path", base) > 0, F.substring_index("path", base, -1)).otherwise(C.filename(F.col("path")))
    wanted = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(C.VIDEO + C.IMAGE + C.AUDIO)
    return files.where(wanted & ~F.col("path").contains("/.")).select(relative.alias("relative_path"), F.col("length").alias("size"), F.unix_timestamp("modificationTime").alias("mtime"), C.media_kind(F.col("path")).alias("kind"))


def content_hashes(spark: SparkSession, root: str, chunk: int = 256 * 1024) -> DataFrame:
    """(path, content_hash): SHA-256 over the size and the first, middle and last ``chunk`` of each file.

    Files are dealt as rows; a task reads three ranges of each through its file system, whatever the file's size.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests = []
            for path, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with _opened(path) as f:
                    ranges = [(0, min(chunk, size))] + [(size // 2 - chunk // 2, chunk)] * (size > 2 * chunk) + [(size - chunk, chunk)] * (size > chunk)
                    digests.append(hashlib.sha256(size.to_bytes(8, "little") + b"".join(f.read_at(n, at) for at, n in ranges)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.string())], names=["path", "content_hash"])

    return files.repartition("path").mapInArrow(run, "path string, content_hash string")


def _opened(path: str) -> pa.NativeFile:
    if "://" not in path or path.startswith("file:"):
        return pa_fs.LocalFileSystem().open_input_file("/" + path.removeprefix("file:").lstrip("/"))
    system, place = pa_fs.FileSystem.from_uri(quote(path, safe=":/@"))
    return system.open_input_file(place)


def gpx_points(spark: SparkSession, path: str) -> DataFrame:
    """(track, time, latitude, longitude, altitude) of track and way points; incomplete points go."""
    schema = "_lat DOUBLE, _lon DOUBLE, time STRING, ele DOUBLE"
    both = [spark.read.format("xml").option("rowTag", tag).schema(schema).load(path).withColumn("track", F.element_at(F.split(F.input_file_name(), "/"), -1)) for tag in ("trkpt", "wpt")]
    rows = both[0].unionByName(both[1])
    return rows.select("track", F.try_to_timestamp("time").alias("time"), F.col("_lat").alias("latitude"), F.col("_lon").alias("longitude"), F.col("ele").alias("altitude")).where("time is not null and latitude is not null and longitude is not null")


def folder_offsets(spark: SparkSession, path: str) -> DataFrame:
    """(folder, years, days, hours, minutes, seconds): an offset is minutes, or an object of parts."""
    text = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,string>")).alias("folder", "v"))
    parts = F.from_json("v", "years INT, days INT, hours INT, minutes INT, seconds INT")
    number = F.col("v").try_cast("int")
    return text.select("folder", *[F.coalesce(number if c == "minutes" else None, parts[c], F.lit(0)).alias(c) if c == "minutes" else F.coalesce(parts[c], F.lit(0)).alias(c) for c in ("years", "days", "hours", "minutes", "seconds")])


def folder_assignments(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,string>")).alias("folder", "target"))
    return rows.where(F.col("target") != "").select(C.normalize_path(F.col("folder")).alias("folder"), "target")


def tag_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """(category, tag, names, ord) of a catalogue file."""
    schema = "categories ARRAY<STRUCT<id: STRING, names: MAP<STRING,STRING>, tags: ARRAY<STRUCT<id: STRING, names: MAP<STRING,STRING>>>>>"
    top = spark.read.schema(schema).json(path, multiLine=True).select(F.posexplode("categories").alias("c_ord", "c"))
    return top.select(F.col("c.id").alias("category"), F.col("c.names").alias("category_names"), "c_ord", F.posexplode("c.tags").alias("t_ord", "t")).select("category", "category_names", F.col("t.id").alias("tag"), F.col("t.names").alias("names"), (F.col("c_ord") * 10_000 + F.col("t_ord")).alias("ord"))
