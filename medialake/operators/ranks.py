"""Row numbers and neighbours in time within groups of any size.

Rows are dealt by ranges of (group, order), so a group that holds a third of all
rows lies in many partitions. Each range does its own part; what goes over a
range's end is at most a row for each range and is sent to all.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from medialake.session import written


def numbered(rows: DataFrame, by: Sequence[str], order: Sequence[Column], name: str = "position") -> DataFrame:
    """Adds each row's place (from 0) in its group's order: that in its range and what earlier ranges hold of the group."""
    dealt = written(rows.repartitionByRange(*by, *order, F.monotonically_increasing_id()).withColumn("_range", F.spark_partition_id()), "ranges")
    own = F.row_number().over(Window.partitionBy("_range", *by).orderBy(*order))
    earlier = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    held = dealt.groupBy(*by, "_range").agg(F.count("*").alias("_n")).withColumn("_before", F.sum("_n").over(earlier)).where(F.col("_before") > 0)
    same = [F.col(f"_k{i}").eqNullSafe(F.col(c)) for i, c in enumerate(by)]
    carried = held.select(F.col("_range").alias("_r"), *[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)], "_before")
    joined = dealt.withColumn("_own", own).join(F.broadcast(carried), reduce(lambda a, b: a & b, same, F.col("_range") == F.col("_r")), "left")
    return joined.select(*rows.columns, (F.col("_own") - 1 + F.coalesce("_before", F.lit(0))).cast("long").alias(name))


@dataclass(frozen=True)
class Look:
    """What a probe looks for: the last of ``points`` (group, time, ``pos`` for points of equal time, any other columns) before it, or the first ``after`` it; one at its own time counts unless ``strictly``."""

    points: DataFrame
    after: bool = False
    strictly: bool = False


def neighbours(probes: DataFrame, looks: Mapping[str, Look], by: Sequence[str], time: str) -> DataFrame:
    """The probes with a struct for each look: the point found (without the group), or null. Probes without a time find nothing."""
    kinds, lines = {}, []
    for name, look in looks.items():
        points = look.points if "pos" in look.points.columns else look.points.withColumn("pos", F.lit(0))
        value = F.struct(*[c for c in points.columns if c not in by])
        of = points.where(F.col(time).isNotNull()).select(*by, F.col(time).alias("_time"), F.col("pos").cast("long").alias("_pos"), value.alias(name))
        kinds[name] = of.schema[name].dataType
        lines.append(of)
    row = F.struct(*probes.columns)
    asked = probes.select(*by, F.col(time).alias("_time"), F.lit(0).cast("long").alias("_pos"), row.alias("_row"))
    null = {n: F.lit(None).cast(k) for n, k in kinds.items()} | {"_row": F.lit(None).cast(asked.schema["_row"].dataType)}
    lined = reduce(lambda a, b: a.unionByName(b), [x.select(*by, "_time", "_pos", *[F.col(c) if c in x.columns else v.alias(c) for c, v in null.items()]) for x in (*lines, asked)])
    dealt = written(lined.withColumn("_probe", F.col("_row").isNotNull()).repartitionByRange(*by, "_time").withColumn("_range", F.spark_partition_id()), "timeline")
    local, carried, edges = [], [], []
    for name, look in looks.items():
        ends = F.max_by if not look.after else F.min_by
        edges.append(ends(name, F.when(F.col(name).isNotNull(), F.struct("_time", "_pos"))).alias(name))
        at = [F.col("_probe").desc() if look.strictly else F.col("_probe").asc()]
        order = [F.col("_time").desc(), *at, F.col("_pos").desc()] if look.after else [F.col("_time").asc(), *at, F.col("_pos").asc()]
        local.append(F.last(name, ignorenulls=True).over(Window.partitionBy("_range", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias(f"_own_{name}"))
        beyond = Window.partitionBy(*by).orderBy("_range").rowsBetween(*((1, Window.unboundedFollowing) if look.after else (Window.unboundedPreceding, -1)))
        carried.append((F.first if look.after else F.last)(name, ignorenulls=True).over(beyond).alias(f"_far_{name}"))
    keys = [F.col(c).alias(f"_k{i}") for i, c in enumerate(by)]
    far = dealt.groupBy(*by, "_range").agg(*edges).select(F.col("_range").alias("_r"), *keys, *carried).where(reduce(lambda a, b: a | b, [F.col(f"_far_{n}").isNotNull() for n in looks]))
    same = reduce(lambda a, b: a & b, [F.col(f"_k{i}").eqNullSafe(F.col(c)) for i, c in enumerate(by)], F.col("_range") == F.col("_r"))
    found = dealt.select(*by, "_range", "_time", "_row", "_probe", *local).where("_probe").join(F.broadcast(far), same, "left")
    return found.select("_row.*", *[F.when(F.col("_time").isNotNull(), F.coalesce(f"_own_{n}", f"_far_{n}")).alias(n) for n in looks])
