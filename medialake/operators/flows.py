"""Flows over a stored catalogue."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from medialake.functions import columns as C
from medialake.operators.library import needs_analysis
from medialake.operators.reconcile import needs_hash, outcome_records, reconcile
from medialake.session import written
from medialake.sources import catalogue as K


def omit(rows: DataFrame, discarded: DataFrame | None) -> DataFrame:
    """Rows whose id isn't among the discarded ones."""
    return rows if discarded is None else rows.join(discarded.select("id").distinct(), "id", "left_anti").select(rows.columns)


def reconcile_library(catalogue: K.Catalogue, listing: DataFrame, hashes: Callable[[DataFrame], DataFrame], now: float, discarded: DataFrame | None = None) -> tuple[int, DataFrame]:
    """Brings a catalogue up to a listing in one version; returns its number and the rows to be analysed (``id, relative_path``).

    ``listing``: relative_path, size, mtime. ``hashes`` is given the files that aren't stably matched (``path``) and
    returns their ``path, hash``: only those are read. Rows that the user discarded meanwhile (``id``) aren't
    written again. Tags and notes of matched rows stay; duplicate groups are formed anew.
    """
    change = catalogue.change()
    stored = change.table("footage").withColumnsRenamed({"relative_path": "path", "content_hash": "hash"}).withColumn("pos", F.struct("created_at", "id"))
    disk = written(listing.select(F.col("relative_path").alias("path"), "size", "mtime"), "listing")
    wanted = needs_hash(disk, stored).select("path")
    hashed = written(hashes(wanted).select("path", "hash"), "hashes")
    disk = disk.join(hashed, "path", "left").withColumn("pos", F.col("path"))
    rows = stored.withColumn("needs_reanalysis", F.lit(False))
    plan = written(reconcile(disk, stored), "plan")
    # Written once, as new rows' ids are random.
    records = written(omit(outcome_records(plan, disk, rows), discarded), "records").withColumnsRenamed({"path": "relative_path", "hash": "content_hash"}).withColumn("filename", C.filename(F.col("relative_path")))
    own = change.table("footage").columns
    stamped = records.withColumn("created_at", F.coalesce("created_at", F.lit(now))).withColumn("updated_at", F.lit(now))
    stable = plan.where("outcome = 'stable'").select("id")
    change.put("footage", stamped.join(stable, "id", "left_anti").select(own))
    K.refresh_duplicates(change)
    version = change.commit()
    pending = records.where(needs_analysis(F.col("status"), C.media_kind(F.col("relative_path")), F.col("needs_reanalysis"), F.col("duration")))
    return version, pending.select("id", "relative_path")
