"""Reconciling a stored catalogue with a file listing.

A file is a stored one if the path is the same, else if the content is (a rename
or a return; the n-th file of a hash takes the n-th free row), else, for rows
without a hash, if size and time fit exactly one of them. What is left is new or
missing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from medialake.session import written


def stable(size: Column, mtime: Column, old_size: Column, old_mtime: Column, status: Column, content_hash: Column) -> Column:
    return F.coalesce((size == old_size) & (mtime == old_mtime) & (status == "available") & content_hash.isNotNull(), F.lit(False))


def needs_hash(disk: DataFrame, stored: DataFrame) -> DataFrame:
    """Listed files that aren't stably matched by path."""
    s = stored.select("path", F.col("size").alias("s_size"), F.col("mtime").alias("s_mtime"), F.col("status").alias("s_status"), F.col("hash").alias("s_hash"))
    match = stable(F.col("size"), F.col("mtime"), F.col("s_size"), F.col("s_mtime"), F.col("s_status"), F.col("s_hash"))
    return disk.join(s, "path", "left").where(~match).select(disk.columns)


def reconcile(disk: DataFrame, stored: DataFrame) -> DataFrame:
    """``id, path, outcome`` for every listed file and stored row.

    ``disk``: (path, size, mtime, hash, pos); ``stored``: (id, path, size, mtime,
    hash, status, pos). Outcomes: stable, touched, first_hash, changed, renamed,
    legacy, new (no id yet) and missing (with the old path).
    """
    d, s = disk.select(*[F.col(c).alias(f"d_{c}") for c in disk.columns]), stored.select(*[F.col(c).alias(f"s_{c}") for c in stored.columns])
    w = Window.partitionBy("s_path").orderBy("s_pos")
    s = s.withColumn("_first", F.row_number().over(w))
    # Both joins are written, as several branches go on from them.
    joined = written(d.join(s, (F.col("d_path") == F.col("s_path")) & (F.col("_first") == 1), "full_outer"), "by-path")
    same_path = F.col("d_path").isNotNull() & F.col("s_id").isNotNull()
    outcome = (
        F.when(stable(F.col("d_size"), F.col("d_mtime"), F.col("s_size"), F.col("s_mtime"), F.col("s_status"), F.col("s_hash")), "stable")
        .when(F.col("s_hash").isNull(), "first_hash").when(F.col("s_hash") == F.col("d_hash"), "touched").otherwise("changed")
    )
    by_path = joined.where(same_path).select(F.col("s_id").alias("id"), F.col("d_path").alias("path"), outcome.alias("outcome"))
    free_disk, free_stored = joined.where(F.col("s_id").isNull()).select([c for c in joined.columns if c.startswith("d_")]), joined.where(F.col("d_path").isNull()).select([c for c in joined.columns if c.startswith("s_")])
    no_disk, no_stored = free_disk.where(F.col("d_hash").isNull()), free_stored.where(F.col("s_hash").isNull())
    # Rows without a hash would all be one key.
    dn = free_disk.where(F.col("d_hash").isNotNull()).withColumn("rn", F.row_number().over(Window.partitionBy("d_hash").orderBy("d_pos")))
    sn = free_stored.where(F.col("s_hash").isNotNull()).withColumn("rn", F.row_number().over(Window.partitionBy("s_hash").orderBy("s_pos")))
    hashed = written(dn.withColumnRenamed("rn", "_dn").join(sn.withColumnRenamed("rn", "_sn"), (F.col("d_hash") == F.col("s_hash")) & (F.col("_dn") == F.col("_sn")), "full_outer").drop("_dn", "_sn"), "by-hash")
    renamed = hashed.where(F.col("d_path").isNotNull() & F.col("s_id").isNotNull()).select(F.col("s_id").alias("id"), F.col("d_path").alias("path"), F.lit("renamed").alias("outcome"))
    left_disk, left_stored = hashed.where(F.col("s_id").isNull()).select(free_disk.columns), hashed.where(F.col("d_path").isNull()).select(free_stored.columns)
    left_disk, left_stored = left_disk.unionByName(no_disk), left_stored.unionByName(no_stored)
    cell = Window.partitionBy("s_size", "s_mtime")
    lone = left_stored.where(F.col("s_hash").isNull()).withColumn("n", F.count("*").over(cell)).where(F.col("n") == 1).drop("n")
    first = left_disk.withColumn("rn", F.row_number().over(Window.partitionBy("d_size", "d_mtime").orderBy("d_pos"))).where(F.col("rn") == 1).drop("rn")
    legacy = first.join(lone, (F.col("d_size") == F.col("s_size")) & (F.col("d_mtime") == F.col("s_mtime"))).select(F.col("s_id").alias("id"), F.col("d_path").alias("path"), F.lit("legacy").alias("outcome"))
    new = left_disk.join(legacy.select(F.col("path").alias("d_path")), "d_path", "left_anti").select(F.lit(None).cast(stored.schema["id"].dataType).alias("id"), F.col("d_path").alias("path"), F.lit("new").alias("outcome"))
    gone = left_stored.join(legacy.select(F.col("id").alias("s_id")), "s_id", "left_anti").select(F.col("s_id").alias("id"), F.col("s_path").alias("path"), F.lit("missing").alias("outcome"))
    return by_path.unionByName(renamed).unionByName(legacy).unionByName(new).unionByName(gone)


def outcome_records(plan: DataFrame, disk: DataFrame, stored: DataFrame) -> DataFrame:
    """The catalogue's rows after a plan: ``stored``'s columns, with the listed file's size, time and content where it was matched.

    ``plan`` is of :func:`reconcile`, ``disk`` and ``stored`` are its arguments; ``stored`` may have any other columns, and those named
    here are kept up: ``phash`` goes with a changed content, ``needs_reanalysis`` is set by new and changed content and cleared by a match.
    New rows get a random id and nulls (``user_notes`` is empty).
    """
    found = disk.select("path", *[F.col(c).alias(f"_d_{c}") for c in ("size", "mtime", "hash")]).withColumnRenamed("path", "_path")
    known = plan.select(F.col("id"), F.col("path").alias("_path"), F.col("outcome").alias("_outcome")).join(found, "_path", "left")
    kept = stored.join(known.where(F.col("id").isNotNull()), "id")
    by = F.col("_outcome")
    moved, hashed, matched = by.isin("renamed", "legacy"), by.isin("first_hash", "changed", "legacy"), ~by.isin("stable", "missing")
    new = {
        "path": F.when(moved, F.col("_path")).otherwise(F.col("path")),
        "size": F.when(matched, F.col("_d_size")).otherwise(F.col("size")),
        "mtime": F.when(matched, F.col("_d_mtime")).otherwise(F.col("mtime")),
        "hash": F.when(hashed, F.col("_d_hash")).otherwise(F.col("hash")),
        "status": F.when(by == "missing", "missing").when(by == "stable", F.col("status")).otherwise("available"),
        "phash": F.when(by != "changed", F.col("phash")) if "phash" in stored.columns else None,
        "needs_reanalysis": F.when(by == "changed", True).when(by.isin("touched", "renamed"), False).otherwise(F.col("needs_reanalysis")) if "needs_reanalysis" in stored.columns else None,
    }
    rows = kept.select(*[new[c].alias(c) if c in new else F.col(c) for c in stored.columns])
    own = {"id": F.uuid(), "path": F.col("_path"), "size": F.col("_d_size"), "mtime": F.col("_d_mtime"), "hash": F.col("_d_hash"), "status": F.lit("available"), "needs_reanalysis": F.lit(True), "user_notes": F.lit("")}
    types = {f.name: f.dataType for f in stored.schema}
    added = known.where(by == "new").select(*[own.get(c, F.lit(None)).cast(types[c]).alias(c) for c in stored.columns])
    return rows.unionByName(added)
