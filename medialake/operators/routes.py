"""Routes on a map: which land a place lies on, whether a hop goes over land or sea, and the lines to draw."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medialake.functions import columns as C
from medialake.operators.ranks import Look, neighbours

# Land masses by south, north, west and east. Islands shadow the continents around them.
ISLANDS = (
    ("taiwan", 21.8, 25.4, 119.9, 122.15),
    ("japan", 24.0, 45.8, 122.9, 146.0),
    ("philippines", 4.5, 21.2, 116.8, 126.7),
    ("indonesia", -11.0, 6.1, 95.0, 141.0),
    ("sri-lanka", 5.8, 9.9, 79.5, 82.1),
    ("uk", 49.8, 58.7, -8.7, 1.8),
    ("ireland", 51.3, 55.5, -10.6, -5.4),
    ("iceland", 63.2, 66.6, -24.6, -13.4),
    ("madagascar", -25.7, -11.9, 43.1, 50.6),
    ("new-zealand", -47.4, -34.3, 166.3, 178.6),
    ("hawaii", 18.7, 22.4, -160.5, -154.6),
    ("hainan", 18.1, 20.2, 108.6, 111.1),
    ("tasmania", -43.8, -40.4, 144.5, 148.5),
)
CONTINENTS = (
    ("australia", -39.2, -10.0, 112.0, 154.5),
    ("eurasia", 1.2, 72.0, -10.0, 141.0),
    ("africa", -35.0, 37.5, -18.0, 52.0),
    ("north-america", 14.5, 72.0, -168.0, -52.0),
    ("south-america", -56.0, 12.5, -82.0, -34.0),
)
#: Hops below this many metres are drawn straight wherever they are; a sea hop's arc has so many points.
NEARBY_M = 50_000
ARC = 24


def _holding(boxes: Sequence[tuple], lat: Column, lon: Column) -> Column:
    return F.array_compact(F.array(*[F.when(lat.between(s, n) & lon.between(w, e), name) for name, s, n, w, e in boxes]))


def land_masses(lat: Column, lon: Column) -> Column:
    """The islands whose box holds a place, else the continents; empty at sea."""
    islands = _holding(ISLANDS, lat, lon)
    return F.when(F.size(islands) > 0, islands).otherwise(_holding(CONTINENTS, lat, lon))


def hop_kind(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """land if both ends share a land mass or are near each other, else sea."""
    share = F.arrays_overlap(land_masses(lat1, lon1), land_masses(lat2, lon2))
    return F.when(share | (C.haversine(lat1, lon1, lat2, lon2) < NEARBY_M), "land").otherwise("sea")


def route_lines(points: DataFrame, by: Sequence[str], order: str) -> DataFrame:
    """(by, segment, kind, seq, latitude, longitude): the points of a route's lines, in order of ``seq``.

    Hops over land in a row make one ``segment`` (named by the place in the order of its first hop), each sea hop one of
    its own, drawn as an arc of the great circle; hops to the same place aren't drawn. ``points``: the columns
    of ``by`` (such as a trip and a run), a numeric ``order`` that is unique in a group, latitude, longitude. A group of any size is many tasks' work.
    """
    known = points.select(*by, F.col(order).cast("long").alias("seq"), "latitude", "longitude").where(C.usable_gps(F.col("latitude"), F.col("longitude")) | ((F.col("latitude") == 0) & (F.col("longitude") == 0)))
    met = neighbours(known, {"from": Look(known, strictly=True)}, by, "seq")
    there = [F.col("from.latitude"), F.col("from.longitude"), F.col("latitude"), F.col("longitude")]
    still = (F.abs(there[0] - there[2]) < 1e-8) & (F.abs(there[1] - there[3]) < 1e-8)
    hops = met.where(F.col("from").isNotNull() & ~still).select(*by, "seq", "latitude", "longitude", F.col("from.latitude").alias("lat1"), F.col("from.longitude").alias("lon1"), hop_kind(*there).alias("kind"))
    before = neighbours(hops, {"last": Look(hops.select(*by, "seq", "kind"), strictly=True)}, by, "seq")
    begins = before.withColumn("new", F.col("last").isNull() | (F.col("kind") == "sea") | (F.col("last.kind") == "sea")).drop("last")
    placed = neighbours(begins, {"first": Look(begins.where("new").select(*by, "seq"))}, by, "seq")
    spot = lambda i, lat, lon: F.struct(i.alias("part"), lat.alias("latitude"), lon.alias("longitude"))
    end = spot(F.lit(1), F.col("latitude"), F.col("longitude"))
    straight = F.when(F.col("new"), F.array(spot(F.lit(0), F.col("lat1"), F.col("lon1")), end)).otherwise(F.array(end))
    arc = F.transform(C.great_circle(F.col("lat1"), F.col("lon1"), F.col("latitude"), F.col("longitude"), ARC), lambda p, i: spot(i, p["latitude"], p["longitude"]))
    drawn = placed.select(*by, F.col("first.seq").alias("segment"), "kind", "seq", F.explode(F.when(F.col("kind") == "sea", arc).otherwise(straight)).alias("p"))
    return drawn.select(*by, "segment", "kind", (F.col("seq") * ARC + F.col("p.part")).alias("seq"), "p.latitude", "p.longitude")
