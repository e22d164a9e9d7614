"""Itinerary, map and frame operators applied to the driver tables, each with its DuckDB oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from medialake.functions import columns as C
from medialake.operators import frames as V
from medialake.operators import itineraries as I
from medialake.operators import library as L
from medialake.plans.catalogue_queries import Tables, query, scaled
from medialake.plans.library_queries import _PLACED, _USABLE, _placed

_TRIP = f"(SELECT *, source AS trip, CASE WHEN id % 4 <> 0 THEN n_chars END AS captured_s FROM ({_PLACED}))"
_RELIABLE = f"({_USABLE} AND coalesce(gps_source, 'header') IN ('header', 'user'))"


def _trip(spark, sf_dir) -> DataFrame:
    return _placed(spark, sf_dir).withColumn("trip", F.col("source")).withColumn("captured_s", F.when(F.col("id") % 4 != 0, F.col("n_chars")))


@query(f"""WITH r AS (SELECT * FROM {_TRIP} WHERE trip <> 'src2'), k AS (SELECT *, bool_or({_RELIABLE}) OVER (PARTITION BY trip) AS trusted FROM r),
p AS (SELECT trip, captured_s AS t_s, latitude, longitude FROM k WHERE {_USABLE} AND captured_s IS NOT NULL AND (NOT trusted OR {_RELIABLE})),
x AS (SELECT * FROM p UNION ALL SELECT source, n_chars, 1, 2 FROM documents WHERE source NOT IN (SELECT trip FROM p))
SELECT trip, t_s, CAST(floor(latitude * 1e4 + 0.5) AS BIGINT) AS lat, CAST(floor(longitude * 1e4 + 0.5) AS BIGINT) AS lon FROM x""")
def guess_track(spark, sf_dir):
    rows = _trip(spark, sf_dir)
    gpx = rows.select("trip", F.col("n_chars").alias("t_s"), F.lit(1.0).alias("latitude"), F.lit(2.0).alias("longitude"))
    found = I.guess_track(rows.where("trip <> 'src2'"), gpx, ["trip"])
    return found.select("trip", "t_s", scaled(F.col("latitude")).alias("lat"), scaled(F.col("longitude")).alias("lon"))


@query(f"SELECT trip, captured_s - 60 AS t_s, count(*) AS n FROM {_TRIP} WHERE {_RELIABLE} AND captured_s IS NOT NULL GROUP BY ALL")
def gps_anchors(spark, sf_dir):
    rows = _trip(spark, sf_dir).withColumn("aligned_s", F.col("captured_s") - 60)
    return I.gps_anchors(rows, ["trip"]).groupBy("trip", "t_s").agg(F.count("*").alias("n"))


_SPANS = f"""s AS (SELECT trip, min(captured_s) AS a, max(captured_s) AS b FROM {_TRIP} WHERE {_USABLE} GROUP BY 1)"""
_MEMBERS = f"""{_SPANS}, m AS (SELECT id, r.trip, CASE WHEN {_USABLE} THEN 'gps' WHEN id % 11 = 0 THEN 'edited' WHEN captured_s * 9 BETWEEN a - 1800 AND b - 1700 THEN 'track' WHEN captured_s * 7 BETWEEN a - 1800 AND b + 1800 THEN 'stays' END AS reason
FROM {_TRIP} r LEFT JOIN s ON s.trip = r.trip)"""


def _members(spark, sf_dir) -> DataFrame:
    rows = _trip(spark, sf_dir).withColumns({"aligned_s": F.col("captured_s") * 7, "adjusted_s": F.col("captured_s") * 9})
    placed = rows.where(C.usable_gps(F.col("latitude"), F.col("longitude")) & F.col("captured_s").isNotNull())
    stays = placed.select("trip", F.col("captured_s").alias("start_s"), F.col("captured_s").alias("end_s"))
    return I.members_and_pending(rows, stays, stays.withColumn("end_s", F.col("end_s") - 3500), rows.where("id % 11 = 0"), ["trip"])


@query(f"WITH {_MEMBERS} SELECT id, trip, reason, reason <> 'gps' AS pending FROM m WHERE reason IS NOT NULL")
def itinerary_members(spark, sf_dir):
    return _members(spark, sf_dir)


@query(f"""WITH {_MEMBERS} SELECT trip, count(*) AS n_members, count(*) FILTER (reason <> 'gps' OR id % 3 = 0) AS n_pending, count(*) FILTER (reason = 'gps' AND id % 3 <> 0) AS n_placed FROM m WHERE reason IS NOT NULL GROUP BY 1""")
def itinerary_tallies(spark, sf_dir):
    return I.tallies(I.restore_pending(_members(spark, sf_dir), _placed(spark, sf_dir).where("id % 3 = 0")), ["trip"])


@query(f"""SELECT id FROM ({_PLACED}) WHERE status = 'available' AND kind IN ('image', 'video') AND (source = 'src1' OR starts_with(source, 'src1/'))""")
def scoped_media(spark, sf_dir):
    return I.scoped_media(_placed(spark, sf_dir).withColumn("directory", F.col("source")), "./src1/").select("id")


@query("""SELECT o_custkey AS edited, o_orderkey AS original FROM orders WHERE o_custkey % 5 <> 0 AND o_custkey % 3 <> 1""")
def retouch_candidates(spark, sf_dir):
    o = Tables(spark, sf_dir).orders
    ids = o.select(F.col("o_custkey").alias("id"))
    return I.retouch_candidates(o.select(F.col("o_custkey").alias("edited"), F.col("o_orderkey").alias("original")), ids.where("id % 5 = 0"), ids.where("id % 3 = 1"))


@query(f"""WITH r AS (SELECT *, id % 3 = 0 AS gap, CASE id % 2 WHEN 0 THEN 'previous' ELSE CASE WHEN id % 5 = 0 THEN 'next' END END AS preview FROM ({_PLACED})),
g AS (SELECT *, CASE WHEN {_USABLE} THEN latitude WHEN gap AND preview = 'previous' THEN 10.0 WHEN gap AND preview = 'next' THEN 20.0 WHEN NOT gap THEN 30.0 END AS lat, NOT {_USABLE} AS guessed FROM r)
SELECT id, CAST(floor(lat * 1e4 + 0.5) AS BIGINT) AS lat, guessed FROM g WHERE lat IS NOT NULL""")
def map_coordinate(spark, sf_dir):
    place = lambda v, name: F.struct(F.lit(v).alias("latitude"), F.lit(5.0).alias("longitude")).alias(name)
    guess = F.struct((F.col("id") % 3 == 0).alias("is_gap"), place(30.0, "point"), place(10.0, "previous"), place(20.0, "next"))
    preview = F.when(F.col("id") % 2 == 0, "previous").when(F.col("id") % 5 == 0, "next")
    at = _placed(spark, sf_dir).select("id", I.map_coordinate(F.col("latitude"), F.col("longitude"), guess, preview).alias("m")).where("m IS NOT NULL")
    return at.select("id", scaled(F.col("m.latitude")).alias("lat"), F.col("m.guessed").alias("guessed"))


@query("""WITH p AS (SELECT c_nationkey AS trip, CAST(c_custkey % 60 AS DOUBLE) AS lat, CAST(c_custkey % 50 AS DOUBLE) AS lon FROM customer WHERE c_nationkey < 20 UNION ALL SELECT n_nationkey + 100, 7.5, 8.25 FROM nation),
r AS (SELECT trip, (min(lat) + max(lat)) / 2 AS lat, (min(lon) + max(lon)) / 2 AS lon, max(lat) - min(lat) AS h, max(lon) - min(lon) AS w FROM p GROUP BY 1),
d AS (SELECT *, CASE WHEN h < 1e-7 AND w < 1e-7 THEN 0.007::DOUBLE ELSE greatest(h * 1.45::DOUBLE, 0.0025::DOUBLE) END AS dh, CASE WHEN h < 1e-7 AND w < 1e-7 THEN 0.007::DOUBLE ELSE greatest(w * 1.45::DOUBLE, 0.0025::DOUBLE) END AS dw FROM r)
SELECT trip, CAST(floor(lat * 1e4 + 0.5) AS BIGINT) AS lat, CAST(floor(lon * 1e4 + 0.5) AS BIGINT) AS lon, CAST(floor(dh * 1e4 + 0.5) AS BIGINT) AS dh, CAST(floor(dw * 1e4 + 0.5) AS BIGINT) AS dw, dh >= 0.012 AS clusters, dh > 0 AND dw > 0 AND dh < 120 AND dw < 180 AS usable FROM d""")
def map_regions(spark, sf_dir):
    t = Tables(spark, sf_dir)
    part = lambda m: (F.col("c_custkey") % m).cast("double")
    points = t.customer.where("c_nationkey < 20").select(F.col("c_nationkey").cast("long").alias("trip"), part(60).alias("latitude"), part(50).alias("longitude"))
    points = points.unionByName(t.nation.select((F.col("n_nationkey") + 100).cast("long").alias("trip"), F.lit(7.5).alias("latitude"), F.lit(8.25).alias("longitude")))
    r = I.map_regions(points, ["trip"])
    region = F.struct("latitude", "longitude", "latitude_delta", "longitude_delta")
    return r.select("trip", scaled(F.col("latitude")).alias("lat"), scaled(F.col("longitude")).alias("lon"), scaled(F.col("latitude_delta")).alias("dh"), scaled(F.col("longitude_delta")).alias("dw"), I.clusters_pins(F.col("latitude_delta")).alias("clusters"), I.usable_region(region).alias("usable"))


@query("""SELECT n_nationkey, CASE WHEN n_nationkey >= 1 THEN n_nationkey - 1 END AS "left", CASE WHEN n_nationkey + 1 < 23 THEN n_nationkey + 1 END AS "right", CASE WHEN n_nationkey - 4 >= 0 THEN n_nationkey - 4 END AS up, CASE WHEN n_nationkey + 4 < 23 THEN n_nationkey + 4 END AS down FROM nation WHERE n_nationkey < 23""")
def grid_neighbour(spark, sf_dir):
    i = F.col("n_nationkey")
    cells = Tables(spark, sf_dir).nation.where(i < 23)
    return cells.select(i, *[I.grid_neighbour(i, F.lit(23), F.lit(4), d).alias(d) for d in ("left", "right", "up", "down")])


_LABELS = "SELECT l_orderkey AS id, ((CAST(l_linenumber AS BIGINT) * 100000 + l_partkey) * 10000 + l_suppkey) * 100 + CAST(l_quantity AS INT) AS frame, CAST(l_quantity AS INT) % 4 AS bodies, CAST(l_quantity AS INT) % 3 AS faces, l_partkey % 5 = 0 AS hands, CAST(l_partkey % 40 AS DOUBLE) / 1000 AS face_area, 's' || l_suppkey % 7 AS scene, CASE WHEN l_partkey % 9 = 0 THEN 'Dog' WHEN l_partkey % 9 = 1 THEN 'dog' END AS animal, l_returnflag || l_linestatus AS word FROM lineitem"


@query(f"""WITH f AS ({_LABELS}), u AS (SELECT id, frame, 'scenes' AS k, scene AS v FROM f UNION ALL SELECT id, frame, 'animals', animal FROM f WHERE animal IS NOT NULL UNION ALL SELECT id, frame, 'texts', word FROM f),
d AS (SELECT id, k, lower(v) AS w, min(frame) AS frame, arg_min(v, frame) AS v FROM u GROUP BY 1, 2, 3), n AS (SELECT *, row_number() OVER (PARTITION BY id, k ORDER BY frame) AS pos FROM d),
l AS (SELECT id, k, string_agg(v, ',' ORDER BY pos) AS vs FROM n WHERE pos <= CASE k WHEN 'scenes' THEN 5 WHEN 'animals' THEN 4 ELSE 6 END GROUP BY 1, 2),
g AS (SELECT id, max(bodies) AS b, max(faces) AS fc, bool_or(hands) AS h, max(face_area) AS area FROM f GROUP BY 1),
j AS (SELECT g.*, s.vs AS scenes, coalesce(a.vs, '') AS animals, t.vs AS texts, a.vs IS NOT NULL AND fc = 0 AS beast FROM g LEFT JOIN l s ON s.id = g.id AND s.k = 'scenes' LEFT JOIN l a ON a.id = g.id AND a.k = 'animals' LEFT JOIN l t ON t.id = g.id AND t.k = 'texts'),
p AS (SELECT *, CASE WHEN beast THEN 0 WHEN h AND b <= 0 THEN 1 ELSE b END AS n FROM j)
SELECT id, CASE WHEN n <= 0 THEN 'none' WHEN n = 1 THEN 'one' WHEN n = 2 THEN 'two' ELSE 'group' END AS people, n AS n_people, h AND NOT beast AND n > 0 AS hands,
CASE WHEN n <= 0 THEN 'none' WHEN area >= 0.025 THEN 'portrait' WHEN area >= 0.015 THEN 'visible' ELSE 'distant' END AS face, scenes, animals, texts FROM p""")
def merge_frames(spark, sf_dir):
    quantity, part = F.col("l_quantity").cast("int"), F.col("l_partkey")
    animal = F.when(part % 9 == 0, F.array(F.lit("Dog"))).when(part % 9 == 1, F.array(F.lit("dog")))
    frames = Tables(spark, sf_dir).lineitem.select(
        F.col("l_orderkey").alias("id"), (((F.col("l_linenumber").cast("long") * 100000 + part) * 10000 + F.col("l_suppkey")) * 100 + quantity).alias("frame"), (quantity % 4).alias("bodies"), (quantity % 3).alias("faces"), (part % 5 == 0).alias("hands"), ((part % 40).cast("double") / 1000).alias("face_area"),
        F.array(F.concat(F.lit("s"), F.col("l_suppkey") % 7)).alias("scenes"), animal.alias("animals"), F.array(F.concat("l_returnflag", "l_linestatus")).alias("texts"),
    )
    return V.merge_frames(frames, "id").withColumns({c: F.array_join(c, ",") for c in ("scenes", "animals", "texts")})


@query("""SELECT o_orderkey AS id, CAST(NULL AS BIGINT) AS parent_id, CAST(o_custkey AS VARCHAR) AS path, CAST(o_custkey % 50 AS BIGINT) * 10 AS duration, false AS needs_reanalysis FROM orders
UNION ALL SELECT -o_orderkey, o_orderkey, 'cut', greatest((o_custkey % 9 - 3) * 10, 2), true FROM orders WHERE o_orderkey % 5 = 0""")
def register_clips(spark, sf_dir):
    o = Tables(spark, sf_dir).orders
    rows = o.select(F.col("o_orderkey").alias("id"), F.lit(None).cast("long").alias("parent_id"), F.col("o_custkey").cast("string").alias("path"), (F.col("o_custkey") % 50).cast("double").alias("duration"), F.lit(False).alias("needs_reanalysis"))
    clips = o.where("o_orderkey % 5 = 0").select((-F.col("o_orderkey")).alias("id"), F.col("o_orderkey").alias("parent_id"), F.lit("cut").alias("path"), F.lit(3.0).alias("start_s"), (F.col("o_custkey") % 9).cast("double").alias("end_s"))
    return L.register_clips(rows, clips).withColumn("duration", scaled(F.col("duration"), 10))


@query("""SELECT n_nationkey AS id, CASE WHEN n_regionkey = 1 THEN '#' || lower(n_name) ELSE n_name END AS native, CASE WHEN n_regionkey = 1 THEN 'new' ELSE 'old' END AS english FROM nation
UNION ALL SELECT r_regionkey + 100, r_name, 'region' FROM region""")
def glossary_add(spark, sf_dir):
    t = Tables(spark, sf_dir)
    pairs = t.nation.select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("native"), F.lit("old").alias("english"))
    known = t.nation.where("n_regionkey = 1").select((F.col("n_nationkey") + 50).cast("long").alias("id"), F.concat(F.lit(" #"), F.lower("n_name"), F.lit(" ")).alias("native"), F.lit("new").alias("english"))
    more = t.region.select((F.col("r_regionkey") + 100).cast("long").alias("id"), F.col("r_name").alias("native"), F.lit("region").alias("english"))
    return L.glossary_add(pairs, known.unionByName(more).unionByName(known.withColumn("english", F.lit(" "))))
