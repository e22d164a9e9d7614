"""Filters, joins, aggregates and set operations over catalogue tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import combinations, product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from medialake.functions import columns as C
from medialake.operators.ranks import Look, neighbours


# -- selections ---------------------------------------------------------------------------------------------------------
def selection(name: str, online: Column, status: Column, n_tags: Column, in_duplicates: Column | None = None) -> Column:
    """The smart lists; *missing* ignores whether the library is online."""
    here = online & (status == "available")
    return {"all": here, "tagged": here & (n_tags > 0), "untagged": here & (n_tags == 0), "missing": status == "missing", "duplicates": here & (in_duplicates if in_duplicates is not None else F.lit(False)), "retouch": F.lit(False)}[name]


def smart_counts(rows: DataFrame, online: Column, status: Column, n_tags: Column) -> DataFrame:
    """All smart lists in one pass."""
    return rows.agg(*[F.count_if(F.coalesce(selection(k, online, status, n_tags), F.lit(False))).alias(f"n_{k}") for k in ("all", "tagged", "untagged", "missing")])


def in_scopes(rows: DataFrame, directory: str, scopes: Sequence[str]) -> DataFrame:
    """Rows in any of a stated list of folders; all rows if the list is empty."""
    return rows if not scopes else rows.where(C.any_column([C.in_folder(F.col(directory), F.lit(s)) for s in scopes]))


# -- tags ---------------------------------------------------------------------------------------------------------------
def best_source(tags: DataFrame, keys: Sequence[str], source: str, pos: str) -> DataFrame:
    """One row for each tag: its best source, at its first place."""
    return tags.groupBy(*keys).agg(F.min_by(source, F.struct(C.source_rank(F.col(source)), F.col(pos))).alias(source), F.min(pos).alias(pos))


def add_tags(tags: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The last writer's source wins."""
    return tags.join(new, list(keys), "left_anti").unionByName(new)


def facets(values: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Distinct categories in use, in catalogue order; ``custom`` comes last, unknown ones are dropped."""
    used = values.select("category").distinct()
    known = used.join(catalogue, "category").select("category", "ord")
    return known.unionByName(used.where(F.col("category") == "custom").select("category", F.lit(1 << 30).alias("ord")))


# -- duplicates ---------------------------------------------------------------------------------------------------------
def duplicate_groups(rows: DataFrame, content_hash: str) -> DataFrame:
    """Hashes of more than one row, of available ones if there is a ``status``; counts only, so that a large group stays small."""
    here = F.col("status") == "available" if "status" in rows.columns else F.lit(True)
    return rows.where(here & F.col(content_hash).isNotNull()).groupBy(content_hash).agg(F.count("*").alias("n")).where(F.col("n") > 1)


def carry_resolution(groups: DataFrame, previous: DataFrame, content_hash: str) -> DataFrame:
    return groups.join(previous.select(content_hash, "resolution"), content_hash, "left").withColumn("resolution", F.coalesce("resolution", F.lit("unresolved")))


# -- joins --------------------------------------------------------------------------------------------------------------
def longest_prefix(rows: DataFrame, directory: str, assignments: DataFrame, key: Sequence[str]) -> DataFrame:
    """The assignment of the deepest folder that holds a row; null if none does. ``assignments``: (folder, target)."""
    steps = rows.select(*key, F.explode(F.concat(F.array(F.lit("")), C.ancestors(F.col(directory)))).alias("folder"))
    best = steps.join(assignments, "folder").groupBy(*key).agg(F.max_by("target", F.char_length("folder")).alias("target"))
    return rows.join(best, list(key), "left")


def asof_interpolate(probes: DataFrame, track: DataFrame, by: Sequence[str], time: str, values: Sequence[str]) -> DataFrame:
    """Values of a track at the probes' times (``id``): those of the first point of that very time (by ``pos``, if there is one), else linear between the points around it; null outside the track's span.

    A value that only one of the two points has is taken from it.
    """
    points = track.select(*by, time, *[c for c in ("pos",) if c in track.columns], *values)
    found = neighbours(probes.select(*by, time, "id"), {"a": Look(points, strictly=True), "b": Look(points, after=True)}, by, time)
    micros = lambda c: F.unix_micros(c.cast("timestamp")).cast("double")
    share = (micros(F.col(time)) - micros(F.col(f"a.{time}"))) / (micros(F.col(f"b.{time}")) - micros(F.col(f"a.{time}")))

    def between(v: str) -> Column:
        a, b = F.col(f"a.{v}"), F.col(f"b.{v}")
        return F.when(F.col(f"b.{time}") == F.col(time), b).when(F.col("a").isNotNull() & F.col("b").isNotNull(), F.when(a.isNotNull() & b.isNotNull(), a + (b - a) * share).otherwise(F.coalesce(a, b)))

    return found.select(*by, time, "id", *[between(v).alias(v) for v in values])


def nearest_gap(probes: DataFrame, events: DataFrame, by: Sequence[str], time: str) -> DataFrame:
    """The nearer of the last event at or before a probe and the first at or after it; the earlier on a tie."""
    points = events.select(*by, time)
    found = neighbours(probes.select(*by, time, "id"), {"a": Look(points), "b": Look(points, after=True)}, by, time)
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    back, ahead = micros(time) - micros(f"a.{time}"), micros(f"b.{time}") - micros(time)
    side = F.when(back.isNull() & ahead.isNull(), None).when(ahead.isNull() | (back <= ahead), "previous").otherwise("next")
    return found.select(*by, "id", side.alias("side"), F.least(back, ahead).alias("gap_us"))


def _within(block: Column, width: int, radius: int) -> Column:
    """All values of ``width`` bits that differ from ``block`` in at most ``radius``."""
    flips = [sum(1 << i for i in c) for r in range(radius + 1) for c in combinations(range(width), r)]
    return F.transform(F.array(*map(F.lit, flips)), lambda f: block.bitwiseXOR(f.cast("long")))


def hamming_meetings(left: DataFrame, right: DataFrame, code: str, most: int, by: Sequence[str] = (), width: int = 64) -> DataFrame:
    """Rows (``l``, ``r``: structs of both sides, ``distance``) whose codes (BIGINT) lie within ``most`` bits, each pair once.

    Codes are cut into blocks; of two within ``most`` bits one block differs in at most ``radius``. The right side stands
    under its own blocks, the left side asks under all values of that many flipped bits; with ``by``, only rows of equal keys meet.
    Blocks of some ten bits at radius 2, for far codes, and sixteen at radius 1, for near ones, meet far fewer others than blocks that must be equal.
    """
    radius = 2 if most >= 12 else 1 if most >= 1 else 0
    n = -(-(most + 1) // (radius + 1))
    cuts = [width * i // n for i in range(n + 1)]
    mask = [(1 << b - a) - 1 if b - a < 64 else -1 for a, b in zip(cuts, cuts[1:])]
    block = lambda c, i: F.shiftrightunsigned(c, cuts[i]).bitwiseAND(F.lit(mask[i]))
    c = F.col(code)
    of = lambda df, name: df.select(F.struct(*df.columns).alias(name), c.alias(f"{name}_code"), *[F.col(k).alias(f"{name}_{k}") for k in by])
    stand = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), block(F.col("r_code"), i).alias("v")) for i in range(n)]))
    placed = lambda i: lambda v: F.struct(F.lit(i).alias("i"), v.alias("v"))
    ask = F.explode(F.concat(*[F.transform(_within(block(F.col("l_code"), i), cuts[i + 1] - cuts[i], radius), placed(i)) for i in range(n)]))
    lefts, rights = of(left, "l").withColumn("at", ask), of(right, "r").withColumn("at", stand)
    both = F.col("l_code").bitwiseXOR(F.col("r_code"))
    # A pair meets in each block that is near enough; the first of these keeps it.
    earlier = any_of([(F.col("at.i") > i) & (F.bit_count(block(both, i)) <= radius) for i in range(n - 1)])
    same = reduce(lambda a, b: a & b, [F.col(f"l_{k}") == F.col(f"r_{k}") for k in by], F.col("at") == F.col("at2"))
    distance = F.bit_count(both).cast("int")
    return lefts.join(rights.withColumnRenamed("at", "at2"), same & (distance <= most) & ~earlier).select("l", "r", distance.alias("distance"))


def hamming_pairs(rows: DataFrame, key: str, code: str, most: int = 6, width: int = 64) -> DataFrame:
    """Pairs of codes (BIGINT) within ``most`` bits, each once."""
    met = hamming_meetings(rows.select(key, code), rows.select(key, code), code, most, width=width)
    return met.where(F.col(f"l.{key}") < F.col(f"r.{key}")).select(F.col(f"l.{key}").alias("a"), F.col(f"r.{key}").alias("b"), "distance")


def edited_originals(rows: DataFrame, by: Sequence[str], *, most: int = 6, lag_s: float = 1200.0) -> DataFrame:
    """(by, id, original, distance, latitude, longitude): for pictures without a position, the picture with a reliable one that looks alike and was taken at least ``lag_s`` earlier: the nearest, and of these the latest.

    ``rows``: id, kind, code, aligned_s, latitude, longitude, gps_source and the columns of ``by`` (a trip).
    """
    at = [F.col(c) for c in ("latitude", "longitude", "gps_source")]
    pictures = rows.where((F.col("kind") == "image") & F.col("code").isNotNull() & F.col("aligned_s").isNotNull())
    edited = pictures.where(~C.usable_gps(*at[:2])).select(*by, "id", "code", "aligned_s")
    anchors = pictures.where(C.reliable_anchor(*at)).select(*by, "id", "code", "aligned_s", "latitude", "longitude")
    met = hamming_meetings(edited, anchors, "code", most, by).where((F.col("l.id") != F.col("r.id")) & (F.col("l.aligned_s") - F.col("r.aligned_s") >= lag_s))
    best = met.groupBy(*[F.col(f"l.{c}").alias(c) for c in by], F.col("l.id").alias("id")).agg(F.min_by(F.struct("r", "distance"), F.struct("distance", -F.col("r.aligned_s"), F.col("r.id"))).alias("_b"))
    return best.select(*by, "id", F.col("_b.r.id").alias("original"), "_b.distance", "_b.r.latitude", "_b.r.longitude")


def any_of(conditions: Sequence[Column]) -> Column:
    return C.any_column(conditions)


def grid_nearest(probes: DataFrame, places: DataFrame, radius_m: float) -> DataFrame:
    """The nearest place within ``radius_m`` of each probe, by cubes of that width and their neighbours.

    ``probes``: (id, lat, lon); ``places``: (place, lat, lon). The later place wins a tie.
    """
    cube = F.struct(*[c.alias(n) for n, c in zip("xyz", C.cubes(F.col("lat"), F.col("lon"), radius_m * 1.001))])
    around = F.array(*[F.struct(*[(F.col(f"_c.{n}") + d).alias(n) for n, d in zip("xyz", step)]) for step in product((-1, 0, 1), repeat=3)])
    near = probes.select("id", "lat", "lon", cube.alias("_c")).select("id", "lat", "lon", F.explode(around).alias("cube"))
    at = places.select("place", F.col("lat").alias("plat"), F.col("lon").alias("plon"), cube.alias("cube"))
    d = C.haversine(F.col("lat"), F.col("lon"), F.col("plat"), F.col("plon"))
    found = near.join(at, "cube").select("id", "place", d.alias("metres")).where(F.col("metres") <= radius_m)
    return found.groupBy("id").agg(F.min_by("place", F.struct("metres", -F.col("place"))).alias("place"), F.min("metres").alias("metres"))


# -- sequences of rows --------------------------------------------------------------------------------------------------
def first_by(rows: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_rn") == 1).drop("_rn")


def capped_pick(rows: DataFrame, owner: str, category: str, label: str, order: Sequence[Column], per_category: int, total: int) -> DataFrame:
    """The best rows of an owner, few of a category and few in all; repeated labels don't count."""
    distinct = first_by(rows, [owner, category, label], *order)
    few = distinct.withColumn("_c", F.row_number().over(Window.partitionBy(owner, category).orderBy(*order))).where(F.col("_c") <= per_category)
    return few.withColumn("rank", F.row_number().over(Window.partitionBy(owner).orderBy(*order))).where(F.col("rank") <= total).drop("_c")


def islands(rows: DataFrame, by: Sequence[str], order: Sequence[Column], kind: str) -> DataFrame:
    """Adds ``run``: a number for each stretch of rows of the same kind."""
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("_new", F.coalesce((F.col(kind) != F.lag(kind).over(w)).cast("int"), F.lit(1))).withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def upsert(existing: DataFrame, new: DataFrame, keys: Sequence[str], clears: Sequence[str] = ()) -> DataFrame:
    """Rows of ``new`` replace those of the same key, column by column where they aren't null.

    The columns named in ``clears`` are replaced by a null as well.
    """
    others = [c for c in existing.columns if c not in keys]
    joined = existing.alias("o").join(new.withColumn("_new", F.lit(True)).alias("n"), list(keys), "full_outer")
    value = lambda c: F.when(F.col("n._new"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")) if c in clears else F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}"))
    return joined.select(*keys, *[value(c).alias(c) for c in others])
