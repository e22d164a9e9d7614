"""Pins that lie on each other, in stacks.

In order, a pin that isn't taken yet takes all pins within reach that aren't
either; so a pin leads a stack if no earlier leader is within its reach, and
belongs to the earliest leader that is. Order decides, and a decision may hang on
a chain of others.

Space is cut into cubes as wide as the reach (on the sphere in three dimensions,
so there's no pole and no date line to mind), cubes into tiles. In a round, each
tile goes through its pins in order, together with a rim of its neighbours':
a pin leads if no leader is in reach and nothing undecided before it; rim pins
count as undecided unless a leader of the tile takes them. Then all pins in reach
of the new leaders go, in one join by cube, and the next round begins. The first undecided pin of
all always leads, so rounds end; there are as many as a chain of pins has tiles, some ten in most libraries.

A cube gives ``GIVEN`` pins a round and a fence that stands for the rest: what is
beyond the fence in order and near its cube stays undecided. So a task's rows are bounded by its tile's
cubes, however many pins lie at one spot; as any two leaders are further apart
than the reach, a cube meets few of them, and no join here grows with the square of a spot's pins.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Sequence
from itertools import product

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from medialake.functions import columns as C
from medialake.operators.itineraries import spread_offset
from medialake.operators.ranks import numbered
from medialake.operators.sequences import metres
from medialake.session import shared_dir, written

#: Pins nearer than this are drawn as one stack.
STACK_M = 18.0
#: Cubes along a tile's edge, and pins that a cube gives in a round.
TILE, GIVEN = 64, 64

_CUBE = ["_cx", "_cy", "_cz"]
_AROUND = list(product((-1, 0, 1), repeat=3))


def _neighbourhood(leaders: DataFrame, by: Sequence[str]) -> DataFrame:
    """Each leader once for each of the cubes that its reach may touch."""
    around = F.explode(F.array(*[F.struct(*[(F.col(c) + d).alias(c) for c, d in zip(_CUBE, step)]) for step in _AROUND]))
    return leaders.select(*[F.col(c).alias(f"_l_{c}") for c in by], F.struct(F.col("_order").isNull().alias("late"), "_order", "_id").alias("_leader"), F.col("_lat").alias("_la"), F.col("_lon").alias("_lo"), around.alias("_at"))


def _in_reach(by: Sequence[str], reach: float) -> Column:
    same = [F.col(c).eqNullSafe(F.col(f"_l_{c}")) for c in by] + [F.col(c) == F.col(f"_at.{c}") for c in _CUBE]
    near = C.haversine(F.col("_lat"), F.col("_lon"), F.col("_la"), F.col("_lo")) <= reach
    for s in same:
        near = s & near
    return near


def _leaders_of_tiles(open_: DataFrame, by: Sequence[str], reach: float, tile: int, given: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*by, *_CUBE).orderBy(F.col("_order").asc_nulls_last(), "_id"))
    first = open_.withColumn("_k", place).where(F.col("_k") <= given + 1)
    tile_of = lambda step: F.struct(*[F.floor((F.col(c) + d) / tile).alias(c.replace("c", "t")) for c, d in zip(_CUBE, step)])
    tiles = F.array_distinct(F.array(*map(tile_of, _AROUND)))
    dealt = first.withColumn("_tile", F.explode(tiles)).withColumn("_own", F.col("_tile") == tile_of((0, 0, 0))).withColumn("_fence", F.col("_k") > given)
    columns = open_.columns

    def fold(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values(["_order", "_id"], kind="stable", na_position="last")
        leaders: dict[tuple, list[tuple]] = {}
        unsure: dict[tuple, list[tuple | None]] = {}
        out = []

        def near(known: dict, cube: tuple, lat: float, lon: float) -> bool:
            for step in _AROUND:
                for other in known.get((cube[0] + step[0], cube[1] + step[1], cube[2] + step[2]), ()):
                    if other is None or metres(*other, lat, lon) <= reach:
                        return True
            return False

        for i, (own, fence, lat, lon, *cube) in enumerate(zip(*(df[c].tolist() for c in ("_own", "_fence", "_lat", "_lon", *_CUBE)))):
            cube = tuple(cube)
            if fence:
                unsure.setdefault(cube, []).append(None)
            elif near(leaders, cube, lat, lon):
                continue
            elif not own or near(unsure, cube, lat, lon):
                unsure.setdefault(cube, []).append((lat, lon))
            else:
                leaders.setdefault(cube, []).append((lat, lon))
                out.append(i)
        return df.iloc[out][columns]

    return dealt.groupBy(*by, "_tile").applyInPandas(fold, open_.schema)


def stack_leaders(pins: DataFrame, by: Sequence[str], reach: float = STACK_M, tile: int = TILE, given: int = GIVEN) -> DataFrame:
    """The pins (a written table, see :func:`_placed`) that lead stacks."""
    spark, path = pins.sparkSession, f"{shared_dir(pins.sparkSession)}/leaders-{uuid.uuid4().hex}"
    open_, turn = pins, 0
    pins.limit(0).write.parquet(path)
    while not open_.isEmpty():
        at = f"{path}/turn-{turn}"
        _leaders_of_tiles(open_, by, reach, tile, given).write.parquet(at)
        new = spark.read.schema(pins.schema).parquet(at)
        open_, turn = written(open_.join(_neighbourhood(new, by), _in_reach(by, reach), "left_anti"), "open-pins"), turn + 1
    return spark.read.schema(pins.schema).option("recursiveFileLookup", True).parquet(path)


def _placed(pins: DataFrame, by: Sequence[str], order: str, reach: float) -> DataFrame:
    lat, lon = F.col("latitude").cast("double"), F.col("longitude").cast("double")
    known = pins.where(F.coalesce(~F.isnan(lat) & ~F.isnan(lon) & (F.abs(lat) <= 90), F.lit(False)) & lon.isNotNull())
    # A little wider than the reach, so that rounding can't put two pins in reach two cubes apart.
    return written(known.select(*by, F.col(order).alias("_order"), F.col("id").alias("_id"), lat.alias("_lat"), lon.alias("_lon"), *[c.alias(n) for n, c in zip(_CUBE, C.cubes(lat, lon, reach * 1.001))]), "pins")


def stack_pins(pins: DataFrame, by: Sequence[str], order: str, *, reach: float = STACK_M, tile: int = TILE, given: int = GIVEN) -> DataFrame:
    """(by, id, leader, position, size, x, y): the stack of each pin, its place in it and where it's drawn.

    ``pins``: ``id`` (unique), ``latitude``, ``longitude``, ``selected`` and the order's
    column (nulls last, ties by id). The leader stands at position 0, the others behind it in
    order; the first selected pin of a stack changes places with its leader. Pins without a position are left out.
    """
    placed = _placed(pins, by, order, reach)
    leaders = stack_leaders(placed, by, reach, tile, given)
    met = placed.join(_neighbourhood(leaders, by), _in_reach(by, reach))
    owned = met.groupBy(*by, F.col("_id").alias("id")).agg(F.min("_leader").alias("_l"), F.min("_order").alias("_order")).select(*by, "id", F.col("_l._id").alias("leader"), "_order")
    chosen = pins.where("selected").select(F.col("id"), F.lit(True).alias("_selected"))
    flagged = owned.join(chosen, "id", "left").select(*by, "id", "leader", "_order", F.coalesce("_selected", F.lit(False)).alias("_selected"))
    placed_in = written(numbered(flagged, [*by, "leader"], [F.col("_order").asc_nulls_last(), F.col("id")]), "stacks")
    of_stack = placed_in.groupBy("leader").agg(F.count("*").alias("size"), F.min(F.when(F.col("_selected"), F.col("position"))).alias("_front"))
    front, own = F.coalesce("_front", F.lit(0)), F.col("position")
    swapped = F.when(own == front, F.lit(0)).when(own == 0, front).otherwise(own).cast("long")
    out = placed_in.join(of_stack, "leader").select(*by, "id", "leader", swapped.alias("position"), "size")
    return out.withColumn("_o", spread_offset(F.col("position"), F.col("size"))).select(*by, "id", "leader", "position", "size", "_o.x", "_o.y")
