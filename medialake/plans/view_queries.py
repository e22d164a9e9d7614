"""What a library shows and where its media were, on the driver tables, each with its DuckDB oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from medialake.operators import gpx as X
from medialake.operators import library as L
from medialake.operators import relations as O
from medialake.operators import trips as T
from medialake.operators import visible as W
from medialake.plans.catalogue_queries import Tables, query, scaled
from medialake.plans.library_queries import _TAG, _tags

_SHELF = "SELECT doc_id AS id, lang AS warehouse, source AS directory, 'f' || doc_id || '.mov' AS filename, doc_id % 10 = 0 AS missing, text, sha256(text) AS h FROM documents"
_HERE = "(warehouse <> 'fr' AND NOT missing)"
_SCOPED = "((warehouse = 'en' AND directory IN ('src1', 'src2')) OR (warehouse = 'de' AND directory = 'src1') OR warehouse = 'es')"


def _shelf(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    d = F.col("doc_id")
    none = {"duration": "double", "captured_at": "timestamp", "phash": "string"}
    rows = Tables(spark, sf_dir).documents.select(
        d.alias("id"), F.col("lang").alias("warehouse"), F.concat("source", F.lit("/f"), d, F.lit(".mov")).alias("relative_path"), F.concat(F.lit("f"), d, F.lit(".mov")).alias("filename"), F.col("source").alias("directory"),
        F.when(d % 10 == 0, "missing").otherwise("available").alias("status"), F.lit("video").alias("kind"), F.col("n_chars").alias("size"), d.alias("mtime"), F.col("text").alias("user_notes"), *[F.lit(None).cast(t).alias(c) for c, t in none.items()],
    )
    houses = rows.select("warehouse").distinct().select("warehouse", F.upper("warehouse").alias("name"), (F.col("warehouse") != "fr").alias("online"))
    return L.with_tags(rows, _tags(spark, sf_dir).withColumnRenamed("doc_id", "id"), "id"), houses


SCOPES = [("en", "src1"), ("en", "src2"), ("de", "src1"), ("es", "")]


@query(f"""WITH t AS ({_TAG}), s AS ({_SHELF}), r AS (SELECT s.*, category, value FROM s JOIN t ON doc_id = id WHERE {_HERE} AND {_SCOPED}),
k AS (SELECT id, greatest(CASE WHEN category = 'c1' AND value = 'q1' THEN 70 ELSE 0 END, CASE WHEN contains(lower(text), 'the') THEN 15 ELSE 0 END) + CASE WHEN value = 'q1' THEN 100 WHEN contains(lower(text), 'q1') THEN 15 ELSE 0 END
 + greatest(CASE WHEN category = 'c1' AND value = 'q1' THEN 100 ELSE 0 END, CASE WHEN contains(filename, 'f1') THEN 30 WHEN contains(directory || '/' || filename, 'f1') THEN 20 WHEN contains(lower(text), 'f1') THEN 15 ELSE 0 END) AS score FROM r)
SELECT id, CAST(score AS INT) AS score FROM k WHERE score > 0""")
def visible_results(spark, sf_dir):
    footage, houses = _shelf(spark, sf_dir)
    names = "category string, category_names map<string,string>, tag string, names map<string,string>"
    catalogue = spark.createDataFrame([("c1", {"en": "The group"}, "q1", {"en": "The best", "de": "F1"})], names)
    found = W.visible(footage, houses, W.Selection("tagged"), SCOPES, tokens=["the", "q1", "f1"], catalogue=catalogue)
    return found.select("id", F.col("score").cast("int").alias("score"))


@query(f"""WITH t AS (SELECT DISTINCT doc_id FROM ({_TAG})), s AS ({_SHELF}), r AS (SELECT s.*, t.doc_id IS NOT NULL AS tagged FROM s LEFT JOIN t ON t.doc_id = id),
g AS (SELECT h FROM s WHERE h IS NOT NULL GROUP BY 1 HAVING count(*) > 1 AND bool_or({_SCOPED}) AND min(id) % 3 <> 0)
SELECT count(*) FILTER ({_HERE}) AS n_all, count(*) FILTER ({_HERE} AND tagged) AS n_tagged, count(*) FILTER ({_HERE} AND NOT tagged) AS n_untagged, count(*) FILTER (missing) AS n_missing,
(SELECT count(*) FROM g) AS n_duplicates, 0 AS n_retouch FROM r WHERE {_SCOPED}""")
def scoped_counts(spark, sf_dir):
    footage, houses = _shelf(spark, sf_dir)
    duplicates = _duplicates(spark, sf_dir, footage)
    return W.collection_counts(footage, houses, SCOPES, duplicates=duplicates)


def _duplicates(spark, sf_dir, footage: DataFrame) -> DataFrame:
    hashed = Tables(spark, sf_dir).documents.where("text IS NOT NULL").select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("group"))
    first = hashed.groupBy("group").agg(F.min("id").alias("m"))
    groups = first.join(O.duplicate_groups(hashed, "group"), "group").select("group", F.when(F.col("m") % 3 == 0, "merged").otherwise("unresolved").alias("resolution"))
    return W.unresolved_duplicates(footage, groups, hashed, SCOPES)


@query(f"""WITH s AS ({_SHELF}), g AS (SELECT h FROM s WHERE h IS NOT NULL GROUP BY 1 HAVING count(*) > 1 AND bool_or({_SCOPED}) AND min(id) % 3 <> 0)
SELECT h AS "group", id, row_number() OVER (PARTITION BY h ORDER BY CAST(regexp_extract(directory, '[0-9]+') AS INT), id) - 1 AS position FROM s JOIN g USING (h)""")
def duplicate_members(spark, sf_dir):
    return _duplicates(spark, sf_dir, _shelf(spark, sf_dir)[0])


_MEDIA = "SELECT event_id AS id, ts, user_id, CASE WHEN user_id % 10 = 6 THEN 't2' WHEN user_id % 5 = 0 THEN 't0' WHEN user_id % 5 = 1 THEN 't1' END AS owner, ts + CASE WHEN user_id % 10 = 5 THEN INTERVAL 90 MINUTE ELSE INTERVAL 0 MINUTE END AS adj FROM events WHERE event_type = 'purchase' AND event_id % 4 <> 0"
_POINTS = "SELECT 't' || user_id % 5 AS track, ts, min(value) AS lat, min(CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id % 100 END) AS alt FROM events WHERE event_type = 'view' GROUP BY 1, 2"


@query(f"""WITH m AS ({_MEDIA}), p AS ({_POINTS}), j AS (SELECT m.*, (SELECT max(p.ts) FROM p WHERE track = owner AND p.ts < adj) AS a, (SELECT min(p.ts) FROM p WHERE track = owner AND p.ts >= adj) AS b FROM m WHERE owner IS NOT NULL),
k AS (SELECT j.*, x.lat AS la, x.alt AS ha, y.lat AS lb, y.alt AS hb, CAST(epoch_us(adj) - epoch_us(a) AS DOUBLE) / CAST(epoch_us(b) - epoch_us(a) AS DOUBLE) AS f FROM j LEFT JOIN p x ON x.track = owner AND x.ts = a JOIN p y ON y.track = owner AND y.ts = b)
SELECT id, owner, CAST(floor((CASE WHEN b = adj THEN lb ELSE la + (lb - la) * f END) * 1e4 + 0.5) AS BIGINT) AS lat, CAST(floor((CASE WHEN b = adj THEN hb WHEN ha IS NULL THEN hb WHEN hb IS NULL THEN ha ELSE ha + (hb - ha) * f END) * 1e4 + 0.5) AS BIGINT) AS alt
FROM k WHERE b = adj OR la IS NOT NULL""")
def track_locations(spark, sf_dir):
    e, u, d = Tables(spark, sf_dir).events, F.col("user_id"), F.col("event_id")
    folder = F.concat(F.lit("u"), u % 5, F.lit("/d"), u % 10)
    media = e.where("event_type = 'purchase'").select(d.alias("id"), folder.alias("directory"), F.when(d % 4 == 0, "missing").otherwise("available").alias("status"), F.lit("image").alias("kind"), F.col("ts").cast("timestamp").alias("captured_at"))
    points = e.where("event_type = 'view'").groupBy(F.concat(F.lit("t"), u % 5).alias("track"), F.col("ts").cast("timestamp").alias("time")).agg(F.min("value").alias("latitude"), F.min("value").alias("longitude"), F.min(F.when(d % 3 != 0, d % 100)).cast("double").alias("altitude"))
    assigned = spark.createDataFrame([("u0", "t0"), ("u1", "t1"), ("u1/d6", "t2")], "folder string, target string")
    offsets = spark.createDataFrame([("u0/d5", 0, 0, 1, 30, 0), ("u0", 0, 0, 7, 0, 0)], "folder string, years int, days int, hours int, minutes int, seconds int")
    found = X.track_locations(media, assigned, offsets, points)
    return found.select("id", "owner", scaled(F.col("latitude")).alias("lat"), scaled(F.col("altitude")).alias("alt"))


@query()
def place_guesses(spark, sf_dir):
    """Where events without a position were by the stays of their user's own ones. SQL doesn't express it; tests hold it against cases written out."""
    e, d = Tables(spark, sf_dir).events, F.col("event_id")
    placed = d % 3 != 0
    t = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000)
    rows = e.select(
        "user_id", d.alias("id"), F.lit("image").alias("kind"), F.lit("available").alias("status"), F.lit("trip").alias("directory"), F.concat(F.lit("f"), d).alias("filename"),
        F.when(placed, 40.0 + F.floor(F.day("ts") / 3) % 4 * 0.02 + d % 3 * 0.001).alias("latitude"), F.when(placed, 20.0 + d % 2 * 0.001).alias("longitude"), F.lit(None).cast("double").alias("altitude"), F.when(placed, "header").alias("gps_source"),
        F.when(d % 7 == 0, F.xxhash64(d % 700)).alias("code"), t.alias("captured_s"), (t + 3600).alias("civil_s"), (d % 5 != 0).alias("has_zone"), d.alias("pos"), F.lit(None).cast("long").alias("folder_s"),
    )
    found = T.place_guesses(rows, ["user_id"])
    return found.select("user_id", "id", "relation", scaled(F.col("latitude")).alias("lat"), scaled(F.col("longitude")).alias("lon"), "edited_from")
