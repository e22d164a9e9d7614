"""Trips end to end: where rows without a position were, who belongs to a trip, and what its map shows.

``rows`` are a trip's media (the columns of ``by`` name the trip): id, kind, status, directory, filename, latitude, longitude, altitude,
gps_source, code (a fingerprint as BIGINT), captured_s (UTC seconds), civil_s, has_zone, pos, and ``folder_s``, the offset of the row's folder in seconds.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from medialake.functions import columns as C
from medialake.operators import itineraries as I
from medialake.operators import library as L
from medialake.operators import sequences as Q
from medialake.operators.ranks import Look, neighbours, numbered
from medialake.operators.relations import asof_interpolate, edited_originals
from medialake.operators.routes import route_lines
from medialake.session import written

#: A stay holds what was taken so many seconds before and after it, too.
STAY_PAD_S = 1200
_SPOT = ("start_s", "end_s", "latitude", "longitude", "altitude")


def aligned(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """Adds ``aligned_s`` (see :func:`medialake.operators.library.aligned_instant`), by the trip's own zone."""
    timed = rows.withColumn("utc_s", F.col("captured_s"))
    return L.aligned_instant(timed, L.utc_offset(timed, by), by).drop("utc_s")


def trip_stays(times: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, start_s, end_s, latitude, longitude, altitude) of the trips' reliable positions, without spikes. ``times`` is of :func:`aligned`."""
    reliable = C.reliable_anchor(F.col("latitude"), F.col("longitude"), F.col("gps_source"))
    anchors = times.where(reliable & F.col("aligned_s").isNotNull()).select(*by, "id", F.col("aligned_s").cast("double").alias("time"), F.col("latitude").alias("lat"), F.col("longitude").alias("lon"), F.col("altitude").alias("alt"))
    # Rows keep their ids through the cleaning, so a kept point is the row that it came from.
    kept = Q.drop_spikes(anchors, list(by), ["time", "id"], ["time", "lat", "lon"])
    found = Q.stays(kept, list(by))
    return found.select(*by, F.col("start").alias("start_s"), F.col("end").alias("end_s"), F.col("lat").alias("latitude"), F.col("lon").alias("longitude"), F.col("alt").alias("altitude"))


def place_guesses(rows: DataFrame, by: Sequence[str], track: DataFrame | None = None, *, stays: DataFrame | None = None) -> DataFrame:
    """(by, id, relation, time_s, latitude, longitude, altitude, previous, next, edited_from): where each row was by what is known of its trip.

    An edited copy was where its original was; else a row lies on the ``track`` (by, time_s, latitude, longitude, altitude; relation
    inside), else inside a stay, else in the gap beside the nearer one (previous or next). ``previous`` and ``next`` are the stays around it. Rows
    without a time that are no edited copy have no guess.
    """
    times = written(aligned(rows, by), "aligned")
    stays = written(trip_stays(times, by), "stays") if stays is None else stays
    in_order = Window.partitionBy(*by).orderBy("start_s", "end_s")
    spot = F.struct(*_SPOT)
    around = stays.select(*by, *_SPOT, F.lag(spot).over(in_order).alias("before"), F.lead(spot).over(in_order).alias("after"), F.row_number().over(in_order).alias("pos"))
    at = lambda moment: around.withColumn("time_s", moment)
    looks = {"holding": Look(at(F.col("end_s") + STAY_PAD_S), after=True), "ended": Look(at(F.col("end_s"))), "begins": Look(at(F.col("start_s")), after=True)}
    probes = times.select(*by, "id", F.col("aligned_s").cast("double").alias("time_s"))
    met = neighbours(probes, looks, by, "time_s")
    t = F.col("time_s")
    inside = F.coalesce(F.col("holding.start_s") - STAY_PAD_S <= t, F.lit(False))
    back, ahead = t - F.col("ended.end_s"), F.col("begins.start_s") - t
    gap = F.when(back.isNull() & ahead.isNull(), None).when(ahead.isNull() | (back <= ahead), "previous").otherwise("next")
    relation = F.when(inside, "inside").otherwise(gap)
    of = lambda name: F.when(F.col(name).isNotNull(), F.struct(*[F.col(f"{name}.{c}").alias(c) for c in _SPOT]))
    stay = F.when(relation == "inside", of("holding")).when(relation == "previous", of("ended")).when(relation == "next", of("begins"))
    previous, following = F.when(inside, F.col("holding.before")).otherwise(of("ended")), F.when(inside, F.col("holding.after")).otherwise(of("begins"))
    guessed = met.select(*by, "id", "time_s", relation.alias("_r"), stay.alias("_s"), previous.alias("_p"), following.alias("_n"))
    copies = edited_originals(times, by).select(*by, "id", F.col("original").alias("_from"), F.struct("latitude", "longitude").alias("_e"))
    copies = copies.join(rows.select(*by, F.col("id").alias("_from"), F.col("altitude").alias("_alt")), [*by, "_from"])
    joined = guessed.join(copies, [*by, "id"], "left")
    if track is None:
        on_track = F.lit(None).cast("struct<latitude: double, longitude: double, altitude: double>")
    else:
        points = track.select(*by, F.timestamp_micros((F.col("time_s") * 1_000_000).cast("long")).alias("at"), "latitude", "longitude", "altitude", *[c for c in ("pos",) if c in track.columns])
        asked = probes.select(*by, "id", F.timestamp_micros((t * 1_000_000).cast("long")).alias("at"))
        located = asof_interpolate(asked, points, by, "at", ["latitude", "longitude", "altitude"]).where("latitude IS NOT NULL")
        joined = joined.join(located.select(*by, "id", F.struct("latitude", "longitude", "altitude").alias("_t")), [*by, "id"], "left")
        on_track = F.col("_t")
    copied, plain = F.col("_from").isNotNull(), on_track.isNull() & F.col("_from").isNull()
    where = {c: F.when(copied, F.col(f"_e.{c}") if c != "altitude" else F.col("_alt")).when(on_track.isNotNull(), on_track[c]).otherwise(F.col(f"_s.{c}")) for c in ("latitude", "longitude", "altitude")}
    named = F.when(copied, "edited").when(on_track.isNotNull(), "inside").otherwise(F.col("_r"))
    out = joined.select(*by, "id", named.alias("relation"), "time_s", *[w.alias(c) for c, w in where.items()], F.when(plain, F.col("_p")).alias("previous"), F.when(plain, F.col("_n")).alias("next"), F.col("_from").alias("edited_from"))
    return out.where("relation IS NOT NULL")


def timeline_members(rows: DataFrame, folder: str, by: Sequence[str]) -> DataFrame:
    """(by, id, reason, pending) of trips along their own positions: the media in ``folder``; a trip without a stay has none."""
    times = written(aligned(I.scoped_media(rows, folder), by), "aligned").withColumn("adjusted_s", F.lit(None).cast("long"))
    stays = written(trip_stays(times, by), "stays")
    none = stays.limit(0)
    edited = edited_originals(times, by).select("id")
    return I.members_and_pending(times, stays, none, edited, by).join(stays.select(*by).distinct(), list(by), "left_semi")


def track_members(rows: DataFrame, folder: str, by: Sequence[str], track: DataFrame, belonging: DataFrame) -> DataFrame:
    """(by, id, reason, pending) of trips along a track: media in ``folder`` that belong to it (``id``), were taken within its padded span, or are edited copies.

    Those without a position of their own are pending. ``track``: by, time_s.
    """
    times = written(aligned(I.scoped_media(rows, folder), by), "aligned")
    span = track.groupBy(*by).agg((F.min("time_s") - I.PAD_S).alias("_a"), (F.max("time_s") + I.PAD_S).alias("_b"))
    adjusted = F.col("captured_s") + F.coalesce("folder_s", F.lit(0))
    flags = times.join(span, list(by), "left").join(belonging.select("id", F.lit(True).alias("_on")).distinct(), "id", "left").join(edited_originals(times, by).select("id", F.lit(True).alias("_edited")).distinct(), "id", "left")
    reason = F.when(F.col("_on"), "on_track").when(adjusted.between(F.col("_a"), F.col("_b")), "nearby").when(F.col("_edited"), "edited")
    pending = ~C.usable_gps(F.col("latitude"), F.col("longitude"))
    return flags.select(*by, "id", reason.alias("reason"), pending.alias("pending")).where("reason IS NOT NULL")


def map_pins(members: DataFrame, footage: DataFrame, guesses: DataFrame, by: Sequence[str], previews: DataFrame | None = None) -> DataFrame:
    """(by, id, filename, captured_s, latitude, longitude, guessed): the members that are shown on the map.

    Members that are no rows of ``footage`` any more are left out. A guess in a gap is only shown at the stay that ``previews`` (id, preview: previous or next) names.
    """
    asked = previews.select("id", "preview") if previews is not None else footage.select("id").limit(0).withColumn("preview", F.lit(None).cast("string"))
    g = guesses.select(*by, "id", F.col("relation").isin("previous", "next").alias("_gap"), F.struct("latitude", "longitude").alias("_point"), "previous", "next")
    joined = members.select(*by, "id").join(footage.select("id", "filename", "captured_s", "latitude", "longitude"), "id").join(g, [*by, "id"], "left").join(asked, "id", "left")
    place = lambda c: F.struct(c["latitude"].alias("latitude"), c["longitude"].alias("longitude"))
    guess = F.struct(F.coalesce("_gap", F.lit(False)).alias("is_gap"), F.col("_point").alias("point"), place(F.col("previous")).alias("previous"), place(F.col("next")).alias("next"))
    at = I.map_coordinate(F.col("latitude"), F.col("longitude"), guess, F.col("preview"))
    return joined.select(*by, "id", "filename", "captured_s", at.alias("_m")).where("_m IS NOT NULL").select(*by, "id", "filename", "captured_s", "_m.latitude", "_m.longitude", "_m.guessed")


def map_snapshot(pins: DataFrame, by: Sequence[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of pins in order of time: the points of plausible runs (by, id, seq, run, latitude, longitude), the lines between them, and the region that shows them."""
    placed = written(numbered(pins, by, [F.col("captured_s").asc_nulls_last(), C.natural_key(F.col("filename")), F.col("id")], "seq"), "pins")
    runs = written(Q.plausible_runs(placed.withColumn("captured_s", F.col("captured_s").cast("double")), list(by), ["seq"], ["captured_s", "latitude", "longitude"]), "runs").select(*by, "id", "seq", "run", "latitude", "longitude")
    return runs, route_lines(runs, [*by, "run"], "seq"), I.map_regions(runs, by)


def confirmed_places(guesses: DataFrame, targets: DataFrame, originals: DataFrame, by: Sequence[str]) -> DataFrame:
    """What is written when guesses are confirmed: (by, id, latitude, longitude, altitude, gps_source, retouch, original time columns).

    ``targets``: id and ``choice``, for a gap the stay meant (previous or next; null: the guess itself). An edited copy also takes its original's
    time (``captured_s, civil_s, has_zone`` of ``originals``, by id) and the retouch tag.
    """
    g = guesses.join(targets.select("id", "choice"), "id")
    stay = F.when(F.col("choice") == "previous", F.col("previous")).when(F.col("choice") == "next", F.col("next"))
    gap = F.col("relation").isin("previous", "next") & F.col("choice").isNotNull()
    at = {c: F.when(gap, stay[c]).otherwise(F.col(c)) for c in ("latitude", "longitude", "altitude")}
    retouch = F.col("relation") == "edited"
    own = originals.select(F.col("id").alias("edited_from"), *[F.col(c).alias(f"_{c}") for c in ("captured_s", "civil_s", "has_zone")])
    found = g.join(own, "edited_from", "left")
    times = [F.when(retouch, F.col(f"_{c}")).alias(f"original_{c}") for c in ("captured_s", "civil_s", "has_zone")]
    usable = C.usable_gps(F.col("latitude"), F.col("longitude"))
    return found.select(*by, "id", *[v.alias(c) for c, v in at.items()], F.lit("itinerary").alias("gps_source"), retouch.alias("retouch"), *times).where(usable)


def without_pending(members: DataFrame, decided: DataFrame) -> DataFrame:
    """Members whose place was confirmed, pinned or declined aren't pending any more."""
    gone = decided.select("id").distinct().withColumn("_done", F.lit(True))
    pending = F.col("pending") & ~F.coalesce("_done", F.lit(False))
    return members.join(gone, "id", "left").select(*[pending.alias(c) if c == "pending" else F.col(c) for c in members.columns])
