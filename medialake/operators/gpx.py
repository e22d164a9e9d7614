"""Media and the tracks of their folders: which track a row is assigned to, where it was by that track, and what is written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medialake.functions import columns as C
from medialake.operators.relations import asof_interpolate, longest_prefix

_PARTS = ("years", "days", "hours", "minutes", "seconds")


def adjusted_captures(rows: DataFrame, offsets: DataFrame) -> DataFrame:
    """Adds ``adjusted_at``: the capture time moved by the offset of the row's own folder (``folder`` and its parts), if it has one."""
    own = offsets.select(F.col("folder").alias("directory"), *[F.coalesce(p, F.lit(0)).alias(f"_{p}") for p in _PARTS])
    moved = C.offset_apply(F.col("captured_at"), *[F.coalesce(f"_{p}", F.lit(0)) for p in _PARTS])
    return rows.join(own, "directory", "left").select(*rows.columns, moved.alias("adjusted_at"))


def track_locations(rows: DataFrame, assignments: DataFrame, offsets: DataFrame, points: DataFrame) -> DataFrame:
    """(id, owner, adjusted_at, latitude, longitude, altitude): where each available photo or video was by its folder's track.

    The assignment (``folder``, ``target``) of the deepest folder around a row counts; rows whose adjusted time the track
    doesn't span belong to none. ``points``: track, time, latitude, longitude, altitude and, for equal times, ``pos``.
    """
    media = rows.where((F.col("status") == "available") & F.col("kind").isin("image", "video") & F.col("captured_at").isNotNull()).select("id", "directory", "captured_at")
    assigned = longest_prefix(media, "directory", assignments, ["id"]).where("target IS NOT NULL")
    probes = adjusted_captures(assigned, offsets).select("id", F.col("target").alias("track"), F.col("adjusted_at").alias("time"))
    found = asof_interpolate(probes, points, ["track"], "time", ["latitude", "longitude", "altitude"])
    return found.where(F.col("latitude").isNotNull() & F.col("longitude").isNotNull()).select("id", F.col("track").alias("owner"), F.col("time").alias("adjusted_at"), "latitude", "longitude", "altitude")


def apply_track(rows: DataFrame, assignments: DataFrame, offsets: DataFrame, points: DataFrame, track: str, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Assigns a track to a folder: the assignments after it, the positions to write (id, latitude, longitude, altitude, gps_source), and one row (matching, wrote).

    Concerned are rows below the folder that no deeper assignment takes elsewhere; a position is written where
    there is none or one that came from a track before.
    """
    place = C.normalize_path(F.lit(folder))
    new = rows.sparkSession.range(1).select(place.alias("folder"), F.lit(track).alias("target"))
    after = assignments.where(F.col("folder") != place).select("folder", "target").unionByName(new)
    below = rows.where(C.in_folder(F.col("directory"), place))
    found = track_locations(below, after, offsets, points.where(F.col("track") == track)).where(F.col("owner") == track)
    own = below.select("id", *[F.col(c).alias(f"_{c}") for c in ("latitude", "longitude", "gps_source")])
    writable = C.may_write_gps(F.col("_latitude"), F.col("_longitude"), F.col("_gps_source")) & C.usable_gps(F.col("latitude"), F.col("longitude"))
    judged = found.join(own, "id").withColumn("_write", F.coalesce(writable, F.lit(False)))
    written_ = judged.where("_write").select("id", "latitude", "longitude", "altitude", F.lit("gpx").alias("gps_source"))
    return after, written_, judged.agg(F.count("*").alias("matching"), F.count_if("_write").alias("wrote"))


def merge_capture(replace_time: Column, stored: str = "stored", live: str = "live") -> Column:
    """A stored capture (struct) with what was read anew (struct of the same fields): the time if asked for, a usable position in any case; unusable ones are left out."""
    usable = lambda s: C.usable_gps(F.col(f"{s}.latitude"), F.col(f"{s}.longitude"))
    at = {c: F.when(replace_time, F.col(f"{live}.{c}")).otherwise(F.col(f"{stored}.{c}")) for c in ("captured_at", "captured_local", "has_zone", "captured_source")}
    where = {c: F.when(usable(live), F.col(f"{live}.{c}")).when(usable(stored), F.col(f"{stored}.{c}")) for c in ("latitude", "longitude", "altitude")}
    source = F.when(usable(live), F.coalesce(F.col(f"{live}.gps_source"), F.lit("header"))).when(usable(stored), F.col(f"{stored}.gps_source"))
    return F.struct(*[c.alias(n) for n, c in (at | where | {"gps_source": source}).items()])
