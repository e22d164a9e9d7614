"""A library's JSON side files of any shape: read whole, parsed as VARIANT, checked as strictly as their writers would; what doesn't fit is empty."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from medialake.functions import variants as V

_UUID = r"^[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$"


def json_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, doc) of the files at ``path`` (a file, a folder or a pattern) that hold JSON; none if there is no such file."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(place)
    if not found:
        return spark.createDataFrame([], "file string, text string").select("file", F.try_parse_json("text").alias("doc"))
    text = spark.read.text(path, wholetext=True)
    return text.select(F.input_file_name().alias("file"), F.try_parse_json("value").alias("doc")).where("doc IS NOT NULL")


def _typed(v: Column, name: str, kind: str) -> tuple[Column, Column]:
    """A field's value and whether it's of its kind: string, uuid, uuids, double, int, time; with a ``?`` it may be absent or null."""
    optional, kind = kind.endswith("?"), kind.removesuffix("?")
    own = V.field(v, name)
    absent = own.isNull() | F.coalesce(F.is_variant_null(own), F.lit(False))
    text = F.try_variant_get(v, f"$.{name}", "string")
    if kind == "uuids":
        listed = F.try_variant_get(v, f"$.{name}", "array<variant>")
        value = F.transform(listed, lambda x: F.when(V.is_string(x), F.try_variant_get(x, "$", "string")))
        fits = V.is_array(own) & F.forall(value, lambda s: F.coalesce(s.rlike(_UUID), F.lit(False)))
    elif kind in ("double", "int"):
        value = F.try_variant_get(v, f"$.{name}", "double" if kind == "double" else "bigint")
        number = F.schema_of_variant(own).rlike("^(BIGINT|DOUBLE|DECIMAL)")
        fits = number & value.isNotNull() & (F.lit(True) if kind == "double" else value.cast("double") == F.try_variant_get(v, f"$.{name}", "double"))
    elif kind == "time":
        value = F.when(text.rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(Z|[+-]\d\d:?\d\d)$"), F.try_to_timestamp(text))
        fits = V.is_string(own) & value.isNotNull()
    else:
        value = text
        fits = V.is_string(own) & (text.rlike(_UUID) if kind == "uuid" else F.lit(True))
    fits = F.coalesce(fits, F.lit(False))
    return F.when(~absent, value), (absent | fits) if optional else (~absent & fits)


def records(docs: DataFrame, items: Column, fields: Mapping[str, str]) -> DataFrame:
    """A row for each item of each document: (file, pos, the fields in snake case).

    A document any of whose items lacks a field or has it of another kind gives no row at all, as its decoder would fail.
    """
    fits = lambda x: F.forall(F.array(*[_typed(x, n, k)[1] for n, k in fields.items()]), lambda c: c)
    sound = docs.select("file", items.alias("_items")).where(F.coalesce(F.forall("_items", lambda x: V.is_object(x) & fits(x)), F.lit(False)))
    each = sound.select("file", F.posexplode("_items").alias("pos", "_x"))
    snake = lambda n: "".join(f"_{c.lower()}" if c.isupper() and not n[i - 1].isupper() else c.lower() for i, c in enumerate(n))
    return each.select("file", "pos", *[_typed(F.col("_x"), n, k)[0].alias(snake(n)) for n, k in fields.items()])


def itineraries(spark: SparkSession, path: str) -> DataFrame:
    fields = {"id": "uuid", "name": "string", "source": "string", "gpxFilename": "string?", "folder": "string", "memberIDs": "uuids", "pendingIDs": "uuids", "createdAt": "time"}
    fields |= dict.fromkeys(("mapLatitude", "mapLongitude", "mapLatitudeDelta", "mapLongitudeDelta"), "double?")
    rows = records(json_files(spark, path), V.items_of(F.col("doc")), fields)
    wrong = rows.where(~F.col("source").isin("gpx", "timeline")).select("file").distinct()
    return rows.join(wrong, "file", "left_anti")


def declined_retouches(spark: SparkSession, path: str) -> DataFrame:
    """(id): the edited rows that were declined."""
    rows = records(json_files(spark, path), F.array("doc"), {"declinedIDs": "uuids"})
    return rows.select(F.explode("declined_ids").alias("id")).distinct()


def geocode_entries(spark: SparkSession, path: str) -> DataFrame:
    """(pos, latitude, longitude, label) of a cache of places, the last used first."""
    docs = json_files(spark, path)
    return records(docs, V.items_of(V.field(F.col("doc"), "entries")), {"latitude": "double", "longitude": "double", "label": "string"}).drop("file")


def warehouses(spark: SparkSession, path: str) -> DataFrame:
    """(pos, id, name, path) of the libraries that a configuration lists."""
    docs = json_files(spark, path)
    listed = F.coalesce(V.items_of(V.field(F.col("doc"), "warehouses")), F.array().cast("array<variant>"))
    return records(docs, listed, {"id": "uuid", "name": "string", "path": "string"}).drop("file")
