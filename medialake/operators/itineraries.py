"""Itineraries: what belongs to a trip, its track, where its rows lie on a map, and their orders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medialake.functions import columns as C

#: Seconds by which a trip's stays and tracks reach further for rows without a position.
PAD_S = 1800


def _at() -> list[Column]:
    return [F.col("latitude"), F.col("longitude")]


def scoped_media(rows: DataFrame, folder: str) -> DataFrame:
    """Available photos and videos in ``folder`` and below."""
    inside = C.in_folder(F.col("directory"), C.normalize_path(F.lit(folder)))
    return rows.where((F.col("status") == "available") & F.col("kind").isin("image", "video") & inside)


# -- tracks ---------------------------------------------------------------------------------------------------------------
def timeline_track(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, t_s, latitude, longitude) of the rows with a position and a time."""
    return rows.where(C.usable_gps(*_at()) & F.col("captured_s").isNotNull()).select(*by, F.col("captured_s").alias("t_s"), "latitude", "longitude")


def guess_track(rows: DataFrame, gpx: DataFrame, by: Sequence[str]) -> DataFrame:
    """A trip's own track: of its reliable positions, or of any if it has no reliable one; without points, that of ``gpx``."""
    reliable = C.reliable_anchor(*_at(), F.col("gps_source"))
    trusted = rows.groupBy(*by).agg(F.max(reliable).alias("_trusted"))
    photos = timeline_track(rows.join(trusted, list(by)).where(~F.col("_trusted") | reliable), by)
    return photos.unionByName(gpx.join(photos.select(*by).distinct(), list(by), "left_anti").select(photos.columns))


def gps_anchors(aligned: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, t_s, latitude, longitude) of reliable positions at their ``aligned_s``."""
    reliable = C.reliable_anchor(*_at(), F.col("gps_source")) & F.col("aligned_s").isNotNull()
    return aligned.where(reliable).select(*by, F.col("aligned_s").alias("t_s"), "latitude", "longitude")


# -- members ----------------------------------------------------------------------------------------------------------------
def members_and_pending(rows: DataFrame, stays: DataFrame, tracks: DataFrame, edited: DataFrame, by: Sequence[str], key: str = "id") -> DataFrame:
    """(by, key, reason, pending): rows that belong to a trip; those without a position of their own are pending.

    Reasons, the first that holds: ``gps``; ``edited`` (a copy of a placed row); ``track`` (the adjusted time lies in the
    track's span) and ``stays`` (the aligned time lies between the first and the last stay), both widened by ``PAD_S``.
    """
    span = lambda df, name: df.groupBy(*by).agg((F.min("start_s") - PAD_S).alias(f"_{name}_a"), (F.max("end_s") + PAD_S).alias(f"_{name}_b"))
    copies = edited.select(key).distinct().withColumn("_edited", F.lit(True))
    joined = rows.join(span(stays, "stays"), list(by), "left").join(span(tracks, "track"), list(by), "left").join(copies, key, "left")
    reason = F.when(C.usable_gps(*_at()), "gps").when(F.col("_edited"), "edited")
    reason = reason.when(F.col("adjusted_s").between(F.col("_track_a"), F.col("_track_b")), "track")
    reason = reason.when(F.col("aligned_s").between(F.col("_stays_a"), F.col("_stays_b")), "stays")
    return joined.select(*by, key, reason.alias("reason")).where("reason IS NOT NULL").withColumn("pending", F.col("reason") != "gps")


def tallies(members: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, n_members, n_pending, n_placed)."""
    counts = members.groupBy(*by).agg(F.count("*").alias("n_members"), F.count_if("pending").alias("n_pending"))
    return counts.withColumn("n_placed", F.col("n_members") - F.col("n_pending"))


def restore_pending(members: DataFrame, cleared: DataFrame, key: str = "id") -> DataFrame:
    """Members whose position was cleared are pending again."""
    gone = cleared.select(key).distinct().withColumn("_cleared", F.lit(True))
    return members.join(gone, key, "left").select(*[(F.col("pending") | F.coalesce("_cleared", F.lit(False))).alias(c) if c == "pending" else F.col(c) for c in members.columns])


def retouch_candidates(pairs: DataFrame, declined: DataFrame, tagged: DataFrame) -> DataFrame:
    """Pairs (``edited``, ``original``) whose edited row wasn't declined and has no retouch tag."""
    over = declined.select("id").unionByName(tagged.select("id")).distinct().withColumnRenamed("id", "edited")
    return pairs.join(over, "edited", "left_anti").select(pairs.columns)


# -- the map ----------------------------------------------------------------------------------------------------------------
def map_coordinate(latitude: Column, longitude: Column, guess: Column, preview: Column) -> Column:
    """Struct latitude, longitude, guessed: the stored position, else the guessed one, else null.

    ``guess``: struct of is_gap and the positions point, previous and next. A gap between two stays is only shown at
    the one that ``preview`` (previous or next) names.
    """
    at = F.when(guess["is_gap"], F.when(preview == "previous", guess["previous"]).when(preview == "next", guess["next"])).otherwise(guess["point"])
    shown = lambda lat, lon, guessed: F.struct(lat.alias("latitude"), lon.alias("longitude"), F.lit(guessed).alias("guessed"))
    return F.when(C.usable_gps(latitude, longitude), shown(latitude, longitude, False)).when(C.usable_gps(at["latitude"], at["longitude"]), shown(at["latitude"], at["longitude"], True))


def map_regions(points: DataFrame, by: Sequence[str], padding: float = 1.45, least: float = 0.0025, single: float = 0.007) -> DataFrame:
    """(by, latitude, longitude, latitude_delta, longitude_delta): the region that shows all points, with a margin; one place has a span of its own."""
    ends = points.groupBy(*by).agg(*[f(c).alias(f"{c}_{n}") for c in ("latitude", "longitude") for n, f in (("lo", F.min), ("hi", F.max))])
    span = {c: F.col(f"{c}_hi") - F.col(f"{c}_lo") for c in ("latitude", "longitude")}
    one = (span["latitude"] < 1e-7) & (span["longitude"] < 1e-7)
    middle = [((F.col(f"{c}_lo") + F.col(f"{c}_hi")) / 2).alias(c) for c in span]
    return ends.select(*by, *middle, *[F.when(one, single).otherwise(F.greatest(s * padding, F.lit(least))).alias(f"{c}_delta") for c, s in span.items()])


def usable_region(region: Column) -> Column:
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    parts = [region[c] for c in ("latitude", "longitude", "latitude_delta", "longitude_delta")]
    sane = (F.abs(parts[0]) <= 90) & (F.abs(parts[1]) <= 180) & (parts[2] > 0) & (parts[3] > 0) & (parts[2] < 120) & (parts[3] < 180)
    return F.coalesce(finite(parts[0]) & finite(parts[1]) & finite(parts[2]) & finite(parts[3]) & sane, F.lit(False))


def plausible_region(region: Column, fit: Column) -> Column:
    """A usable region that isn't world-wide (over 40 degrees) for content of under 8."""
    wide = F.lit(False)
    for c in ("latitude_delta", "longitude_delta"):
        wide = wide | ((region[c] > 40) & (fit[c] < 8))
    return usable_region(region) & (~usable_region(fit) | ~F.coalesce(wide, F.lit(False)))


def clusters_pins(latitude_delta: Column, least: float = 0.012) -> Column:
    return latitude_delta >= least


def spread_offset(index: Column, count: Column) -> Column:
    """The place (x, y) of pin ``index`` (from 0) of ``count`` on a circle, from the top on; a pin by itself stays in the middle."""
    radius, angle = F.lit(24.0) + count * 3.2, index * (2 * F.pi() / F.greatest(count, F.lit(1))) - F.pi() / 2
    at = lambda f: F.when(count > 1, f(angle) * radius).otherwise(0.0)
    return F.struct(at(F.cos).alias("x"), at(F.sin).alias("y"))


def spread_offsets(count: Column) -> Column:
    """The places of all ``count`` pins."""
    return F.transform(F.sequence(F.lit(0), F.greatest(count, F.lit(1)) - 1), lambda i: spread_offset(i, count))


def grid_neighbour(index: Column, count: Column, columns: Column, direction: str) -> Column:
    """The index of the cell beside one in a grid filled by rows; null outside."""
    wide = F.greatest(columns, F.lit(1))
    to = {"left": index - 1, "right": index + 1, "up": index - wide, "down": index + wide}[direction]
    return F.when((index >= 0) & (index < count) & (to >= 0) & (to < count), to)


# -- orders -----------------------------------------------------------------------------------------------------------------
def pin_order() -> list[Column]:
    """By time, those without one last; then by natural file name."""
    return [F.col("captured_at").asc_nulls_last(), C.natural_key(F.col("filename")).asc()]


def retouch_order() -> list[Column]:
    """By the edited row's time, those without one first; then by natural file name."""
    return [F.col("captured_at").asc_nulls_first(), C.natural_key(F.col("filename")).asc()]
