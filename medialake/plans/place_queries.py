"""Headers, pins and routes on the driver tables, each with its DuckDB oracle."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medialake.operators import pins as P
from medialake.operators import routes as R
from medialake.session import shared_dir
from medialake.sources import headers as H
from medialake.streaming.stays import stay_stream
from medialake.plans.catalogue_queries import Tables, _hav, micros, query, scaled

_PINS = """SELECT c_nationkey AS trip, c_custkey AS id, 40.0::DOUBLE + (c_custkey % 23) * 0.0001::DOUBLE AS lat, CAST(c_custkey * 7 % 19 AS DOUBLE) * 0.0001::DOUBLE + 179.9995::DOUBLE AS lon_,
CASE WHEN c_custkey % 13 <> 0 THEN c_custkey * 31 % 1009 END AS t, c_custkey % 11 = 3 AS selected FROM customer"""


@query(f"""WITH RECURSIVE q AS (SELECT *, CASE WHEN lon_ > 180 THEN lon_ - 360 ELSE lon_ END AS lon FROM ({_PINS})),
p AS (SELECT *, row_number() OVER (PARTITION BY trip ORDER BY t NULLS LAST, id) AS k FROM q),
g AS (SELECT DISTINCT trip, 0::BIGINT AS k, []::STRUCT(id BIGINT, lat DOUBLE, lon DOUBLE)[] AS ls FROM p
  UNION ALL SELECT g.trip, p.k, CASE WHEN len(list_filter(ls, lambda l: {_hav("l.lat", "l.lon", "p.lat", "p.lon")} <= 18)) > 0 THEN ls ELSE list_append(ls, {{'id': p.id, 'lat': p.lat, 'lon': p.lon}}) END
  FROM g JOIN p ON p.trip = g.trip AND p.k = g.k + 1),
e AS (SELECT trip, arg_max(ls, k) AS ls FROM g GROUP BY 1),
o AS (SELECT p.*, list_filter(ls, lambda l: {_hav("l.lat", "l.lon", "p.lat", "p.lon")} <= 18)[1].id AS leader FROM p JOIN e USING (trip)),
n AS (SELECT *, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY leader) AS size FROM o WINDOW w AS (PARTITION BY leader ORDER BY k)),
f AS (SELECT *, coalesce(min(pos) FILTER (selected) OVER (PARTITION BY leader), 0) AS front FROM n),
r AS (SELECT *, CASE WHEN pos = front THEN 0 WHEN pos = 0 THEN front ELSE pos END AS position FROM f)
SELECT trip, id, leader, CAST(position AS BIGINT) AS position, size, CAST(floor(CASE WHEN size > 1 THEN cos(position * (2 * pi() / size) - pi() / 2) * (24 + size * 3.2::DOUBLE) ELSE 0 END * 1e4 + 0.5) AS BIGINT) AS x,
CAST(floor(CASE WHEN size > 1 THEN sin(position * (2 * pi() / size) - pi() / 2) * (24 + size * 3.2::DOUBLE) ELSE 0 END * 1e4 + 0.5) AS BIGINT) AS y FROM r""")
def stack_pins(spark, sf_dir):
    k = F.col("c_custkey")
    lon = (k * 7 % 19).cast("double") * 0.0001 + 179.9995
    pins = Tables(spark, sf_dir).customer.select(F.col("c_nationkey").alias("trip"), k.alias("id"), (F.lit(40.0) + (k % 23) * F.lit(0.0001)).alias("latitude"), F.when(lon > 180, lon - 360).otherwise(lon).alias("longitude"), F.when(k % 13 != 0, k * 31 % 1009).alias("t"), (k % 11 == 3).alias("selected"))
    return P.stack_pins(pins, ["trip"], "t").withColumns({c: scaled(F.col(c)) for c in "xy"})


# -- headers ------------------------------------------------------------------------------------------------------------
def _pictures(spark, sf_dir) -> DataFrame:
    """A small JPEG for each document, with an EXIF block of big-endian directories that Spark writes."""
    d = F.col("doc_id")
    big = lambda c, n: F.lpad(F.hex(c), 2 * n, "0")
    text = lambda c: F.concat(F.hex(c), F.lit("00"))
    tag = lambda name, kind, n, value: F.concat(F.lit(f"{name:04X}{kind:04X}{n:08X}"), value if isinstance(value, Column) else F.lit(f"{value:08X}"))
    ratios = lambda *parts: F.concat(*[F.concat(big(a, 4), F.lit(f"{b:08X}")) for a, b in parts])
    none = F.lit("00000000")
    time = F.format_string("%04d:%02d:%02d %02d:%02d:%02d", d % 8 + 2013, d % 12 + 1, d % 28 + 1, d % 24, d % 60, d * 11 % 60)
    main = F.concat(F.lit("0002"), tag(0x8769, 4, 1, 38), tag(0x8825, 4, 1, 96), none)
    clock = F.concat(F.lit("0002"), tag(0x9003, 2, 20, 68), tag(0x9011, 2, 7, 88), none, text(time), text(F.when(d % 2 == 0, "+08:00").otherwise("-05:30")), F.lit("00"))
    side = lambda c, a, b: F.concat(F.hex(F.when(c, a).otherwise(b)), F.lit("000000"))
    spot = F.concat(F.lit("0004"), tag(1, 2, 2, side(d % 3 == 0, "S", "N")), tag(2, 5, 3, 150), tag(3, 2, 2, side(d % 5 == 0, "W", "E")), tag(4, 5, 3, 174), none, ratios((d % 80, 1), (d % 60, 1), (d * 7 % 5900, 100)), ratios((d % 170, 1), (d * 3 % 60, 1), (d * 7 % 5900, 100)))
    jpeg = F.concat(F.lit("FFD8FFE100CE457869660000" + "4D4D002A00000008"), main, clock, spot, F.lit("FFDA0002"))
    path = F.when(d % 5 == 0, "DJI_20230405060708_0001_D.mov").when(d % 5 == 1, "clip.mov").otherwise("p.jpg")
    return Tables(spark, sf_dir).documents.select("doc_id", path.alias("path"), F.timestamp_seconds(d * 60 + 1_600_000_000).alias("modified"), F.unhex(jpeg).alias("content"))


@query("""WITH d AS (SELECT doc_id, make_timestamp(2013 + doc_id % 8, 1 + doc_id % 12, 1 + doc_id % 28, doc_id % 24, doc_id % 60, CAST(doc_id * 11 % 60 AS DOUBLE)) AS civil, doc_id % 5 > 1 AS image FROM documents),
c AS (SELECT *, civil - CASE WHEN doc_id % 2 = 0 THEN INTERVAL 8 HOUR ELSE INTERVAL '-5 hours -30 minutes' END AS utc, image AND year(civil) >= 2015 AS dated FROM d),
p AS (SELECT *, (CASE WHEN doc_id % 3 = 0 THEN -1 ELSE 1 END) * (doc_id % 80 + (doc_id % 60) / 60.0::DOUBLE + (doc_id * 7 % 5900) / 360000.0::DOUBLE) AS lat, (CASE WHEN doc_id % 5 = 0 THEN -1 ELSE 1 END) * (doc_id % 170 + (doc_id * 3 % 60) / 60.0::DOUBLE + (doc_id * 7 % 5900) / 360000.0::DOUBLE) AS lon FROM c)
SELECT doc_id, epoch_us(CASE WHEN dated THEN utc WHEN doc_id % 5 = 0 THEN TIMESTAMP '2023-04-05 06:07:08' ELSE to_timestamp(1600000000 + doc_id * 60)::TIMESTAMP END) AS captured_us,
CASE WHEN dated THEN strftime(civil, '%Y-%m-%dT%H:%M:%S') WHEN doc_id % 5 = 0 THEN '2023-04-05T06:07:08' END AS captured_local, CASE WHEN dated THEN 'header' WHEN doc_id % 5 = 0 THEN 'dji_filename' ELSE 'file_date' END AS captured_source,
CASE WHEN image THEN CAST(floor(lat * 1e6 + 0.5) AS BIGINT) END AS lat, CASE WHEN image THEN CAST(floor(lon * 1e6 + 0.5) AS BIGINT) END AS lon FROM p""")
def media_captures(spark, sf_dir):
    got = H.captures(H.headers_of(_pictures(spark, sf_dir)), today=F.lit("2026-01-01").cast("date"))
    return got.select("doc_id", micros(F.col("captured_at")).alias("captured_us"), "captured_local", "captured_source", scaled(F.col("latitude"), 1e6).alias("lat"), scaled(F.col("longitude"), 1e6).alias("lon"))


# -- stays of a stream --------------------------------------------------------------------------------------------------
_WALK = "SELECT user_id AS u, event_id, ts, 40.0::DOUBLE + (day(ts) // 3 % 4) * 0.02::DOUBLE + (event_id % 3) * 0.001::DOUBLE + CASE WHEN event_id % 17 = 0 THEN 0.01 ELSE 0 END::DOUBLE AS lat, 20.0::DOUBLE + (event_id % 2) * 0.001::DOUBLE AS lon FROM events"
_CLOSED = f"""CASE WHEN len(la) = 0 THEN outs WHEN len(outs) > 0 AND a - outs[-1].z <= 2700000000 AND {_hav("outs[-1].la", "outs[-1].lo", "list_median(la)", "list_median(lo)")} <= 500
THEN list_append(list_slice(outs, 1, len(outs) - 1), {{'a': outs[-1].a, 'z': greatest(z, outs[-1].z), 'la': (outs[-1].la + list_median(la)) / 2, 'lo': (outs[-1].lo + list_median(lo)) / 2}})
ELSE list_append(outs, {{'a': a, 'z': z, 'la': list_median(la), 'lo': list_median(lo)}}) END"""


@query(f"""WITH RECURSIVE s AS ({_WALK}), w AS (SELECT epoch_ms(max(ts)) * 1000 - 86400000000 AS wm FROM s),
e AS (SELECT u, epoch_us(ts) AS t, lat, lon, row_number() OVER (PARTITION BY u ORDER BY ts, lat, lon) AS k FROM s, w WHERE epoch_us(ts) < wm),
g AS (SELECT DISTINCT u, 0::BIGINT AS k, []::DOUBLE[] AS la, []::DOUBLE[] AS lo, 0::BIGINT AS a, 0::BIGINT AS z, []::STRUCT(a BIGINT, z BIGINT, la DOUBLE, lo DOUBLE)[] AS outs, 0::BIGINT AS fin FROM e
  UNION ALL SELECT u, k + 1, CASE WHEN near THEN list_append(la, lat) ELSE [lat] END, CASE WHEN near THEN list_append(lo, lon) ELSE [lon] END, CASE WHEN near THEN a ELSE t END, t,
    CASE WHEN near THEN outs ELSE closed END, CASE WHEN gap THEN len(closed) ELSE fin END
  FROM (SELECT g.*, e.t, e.lat, e.lon, len(la) > 0 AND e.t - z > 259200000000 AS gap, {_CLOSED} AS closed,
    len(la) > 0 AND e.t - z <= 259200000000 AND ({_hav("list_avg(la)", "list_avg(lo)", "e.lat", "e.lon")} <= 500 OR {_hav("la[-1]", "lo[-1]", "e.lat", "e.lon")} <= 500) AS near FROM g JOIN e ON e.u = g.u AND e.k = g.k + 1)),
l AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY u ORDER BY k DESC) = 1),
f AS (SELECT u, CASE WHEN z + 259200000000 < wm THEN {_CLOSED} ELSE list_slice(outs, 1, greatest(fin, len(outs) - 1, 0)) END AS outs FROM l, w)
SELECT u AS user_id, o.a AS start_us, o.z AS end_us, CAST(floor(o.la * 1e6 + 0.25) AS BIGINT) AS lat, CAST(floor(o.lo * 1e6 + 0.25) AS BIGINT) AS lon FROM (SELECT u, unnest(outs) AS o FROM f)""")
def stay_stream_final(spark, sf_dir):
    """The stays of an event stream that are final once all of the table has arrived: what its stream has put out."""
    events = f"{sf_dir}/events.parquet"
    own = spark.newSession()  # the caller's settings stay as they are
    own.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    at = f"{shared_dir(spark)}/stay-stream-{uuid.uuid4().hex}"
    d = F.col("event_id")
    lat = F.lit(40.0) + F.floor(F.day("ts") / 3) % 4 * F.lit(0.02) + d % 3 * F.lit(0.001) + F.when(d % 17 == 0, 0.01).otherwise(0.0)
    rows = own.readStream.schema(spark.read.parquet(events).schema).parquet(f"{sf_dir}/events*.parquet")
    points = rows.select("user_id", F.col("ts").cast("timestamp"), lat.alias("lat"), (F.lit(20.0) + d % 2 * F.lit(0.001)).alias("lon"), F.lit(None).cast("double").alias("alt"))
    found = stay_stream(points, ["user_id"], late="1 day", idle_s=3 * 86400.0)
    running = found.writeStream.format("parquet").option("path", f"{at}/stays").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    running.awaitTermination()
    out = spark.read.schema(found.schema).parquet(f"{at}/stays")
    us = lambda c: F.round(F.col(c) * 1_000_000).cast("long")
    place = lambda c: F.floor(F.col(c) * 1e6 + 0.25).cast("long").alias(c)
    return out.select("user_id", us("start").alias("start_us"), us("end").alias("end_us"), place("lat"), place("lon"))


# -- routes -------------------------------------------------------------------------------------------------------------
def _boxes(boxes) -> str:
    return ", ".join(f"('{name}', {a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE, {d}::DOUBLE)" for name, a, b, c, d in boxes)


_ROUTE = "SELECT c_nationkey AS trip, c_custkey AS seq, CASE WHEN c_custkey % 11 = 0 THEN 25.0 ELSE CAST((c_custkey // 3 * 37 % 120) - 50 AS DOUBLE) + (c_custkey % 3) * 0.25 END AS lat, CASE WHEN c_custkey % 11 = 0 THEN 121.5 ELSE CAST((c_custkey // 3 * 53 % 340) - 170 AS DOUBLE) + (c_custkey % 3) * 0.25 END AS lon FROM customer"


@query(f"""WITH p AS ({_ROUTE}), m AS (SELECT * FROM (VALUES {_boxes(R.ISLANDS)}) t(mass, s, n, w, e)), c AS (SELECT * FROM (VALUES {_boxes(R.CONTINENTS)}) t(mass, s, n, w, e)),
i AS (SELECT trip, seq, list(mass) AS ms FROM p JOIN m ON lat BETWEEN s AND n AND lon BETWEEN w AND e GROUP BY 1, 2), k AS (SELECT trip, seq, list(mass) AS ms FROM p JOIN c ON lat BETWEEN s AND n AND lon BETWEEN w AND e GROUP BY 1, 2),
l AS (SELECT p.*, coalesce(i.ms, k.ms, []) AS ms FROM p LEFT JOIN i USING (trip, seq) LEFT JOIN k USING (trip, seq)),
h AS (SELECT *, lag(lat) OVER w AS lat1, lag(lon) OVER w AS lon1, lag(ms) OVER w AS ms1 FROM l WINDOW w AS (PARTITION BY trip ORDER BY seq)),
q AS (SELECT trip, seq, CASE WHEN list_has_any(ms, ms1) OR {_hav("lat1", "lon1", "lat", "lon")} < 50000 THEN 'land' ELSE 'sea' END AS kind FROM h WHERE lat1 IS NOT NULL AND NOT (abs(lat - lat1) < 1e-8 AND abs(lon - lon1) < 1e-8)),
n AS (SELECT *, coalesce(kind = 'sea' OR lag(kind) OVER w = 'sea', true) OR lag(kind) OVER w IS NULL AS new FROM q WINDOW w AS (PARTITION BY trip ORDER BY seq)),
g AS (SELECT *, max(CASE WHEN new THEN seq END) OVER (PARTITION BY trip ORDER BY seq) AS segment FROM n)
SELECT trip, segment, kind, CAST(sum(CASE WHEN kind = 'sea' THEN 24 WHEN new THEN 2 ELSE 1 END) AS BIGINT) AS n_points FROM g GROUP BY ALL""")
def route_lines(spark, sf_dir):
    k = F.col("c_custkey")
    at = lambda step, wide, less, home: F.when(k % 11 == 0, home).otherwise((F.floor(k / 3) * step % wide - less).cast("double") + k % 3 * F.lit(0.25))
    points = Tables(spark, sf_dir).customer.select(F.col("c_nationkey").alias("trip"), k.alias("seq"), at(37, 120, 50, 25.0).alias("latitude"), at(53, 340, 170, 121.5).alias("longitude"))
    return R.route_lines(points, ["trip"], "seq").groupBy("trip", "segment", "kind").agg(F.count("*").alias("n_points"))
