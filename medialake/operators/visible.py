"""What a library shows: a selection within scopes, ranked by a search, in an order; its counts and duplicate groups.

``footage``: id, warehouse, relative_path, filename, directory, status, kind, size, mtime, duration, captured_at, phash,
user_notes and ``tags`` (an array as of :func:`medialake.operators.library.with_tags`). ``warehouses``: warehouse, name, online.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medialake.functions import columns as C
from medialake.operators import library as L
from medialake.operators.ranks import numbered

LISTS = ("all", "tagged", "untagged", "missing", "duplicates", "retouch")


@dataclass(frozen=True)
class Selection:
    """One of ``LISTS``, or a ``warehouse``, ``folder`` (warehouse, value), ``gpx`` or ``itinerary`` (warehouse, value), or ``category`` (value)."""

    kind: str
    warehouse: str | None = None
    value: str | None = None


def resolved_scopes(selection: Selection, scopes: Sequence[tuple[str, str]]) -> list[tuple[str, str]]:
    """The (warehouse, folder) scopes that hold: none for a track or trip, else the given ones, else a selected folder."""
    if selection.kind in ("gpx", "itinerary"):
        return []
    if scopes:
        return list(scopes)
    return [(selection.warehouse, selection.value)] if selection.kind == "folder" else []


def in_scopes(scopes: Sequence[tuple[str, str]]) -> Column:
    """Whether a row lies in any scope: its folder in the scope's and of the same warehouse; true without scopes."""
    if not scopes:
        return F.lit(True)
    return C.any_column([(F.col("warehouse") == w) & C.in_folder(F.col("directory"), C.normalize_path(F.lit(folder))) for w, folder in scopes])


def _selected(selection: Selection, scopes: Sequence[tuple[str, str]]) -> Column:
    online, here = F.col("online"), F.col("online") & (F.col("status") == "available")
    n = F.size("tags")
    own = F.col("warehouse") == F.lit(selection.warehouse)
    return {
        "all": here, "tagged": here & (n > 0), "untagged": here & (n == 0), "missing": F.col("status") == "missing", "duplicates": online & F.col("_duplicate"), "retouch": F.lit(False),
        "warehouse": here & own, "folder": here & (F.lit(True) if scopes else own), "gpx": here & own & F.col("_member"), "itinerary": here & own & F.col("_member"),
        "category": here & F.exists("tags", lambda t: t["category"] == F.lit(selection.value)),
    }[selection.kind]


def included(footage: DataFrame, warehouses: DataFrame, selection: Selection, scopes: Sequence[tuple[str, str]] = (), *, duplicates: DataFrame | None = None, members: DataFrame | None = None) -> DataFrame:
    """Rows of the selection within the scopes, with their warehouse's ``name`` and ``online``.

    ``duplicates`` (id) are the members of duplicate groups, ``members`` (owner, id) those of tracks (see
    :func:`medialake.operators.gpx.track_locations`) or trips.
    """
    rows = footage.join(warehouses.select("warehouse", F.col("name").alias("warehouse_name"), F.coalesce("online", F.lit(False)).alias("online")), "warehouse")

    def flagged(df: DataFrame, ids: DataFrame | None, name: str) -> DataFrame:
        if ids is None:
            return df.withColumn(name, F.lit(False))
        return df.join(ids.select("id").distinct().withColumn(name, F.lit(True)), "id", "left").withColumn(name, F.coalesce(name, F.lit(False)))

    rows = flagged(rows, duplicates if selection.kind == "duplicates" else None, "_duplicate")
    rows = flagged(rows, members.where(F.col("owner") == F.lit(selection.value)) if members is not None and selection.kind in ("gpx", "itinerary") else None, "_member")
    return rows.where(F.coalesce(_selected(selection, scopes), F.lit(False)) & F.coalesce(in_scopes(resolved_scopes(selection, scopes)), F.lit(False))).drop("_duplicate", "_member")


def unresolved_duplicates(footage: DataFrame, groups: DataFrame, members: DataFrame, scopes: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """(group, id, position): the members, in natural order of their paths, of unresolved groups with more than one left, if any lies in the scopes.

    ``groups``: group, resolution; ``members``: group, id.
    """
    left = members.join(groups.where(F.col("resolution") == "unresolved").select("group"), "group").join(footage.select("id", "warehouse", "directory", "relative_path"), "id")
    sizes = left.groupBy("group").agg(F.count("*").alias("_n"), F.bool_or(F.coalesce(in_scopes(scopes), F.lit(False))).alias("_in")).where((F.col("_n") > 1) & F.col("_in"))
    rows = left.join(sizes.select("group"), "group").select("group", "id", C.natural_key(F.col("relative_path")).alias("_key"), "relative_path")
    return numbered(rows, ["group"], [F.col("_key"), F.col("relative_path"), F.col("id")]).select("group", "id", "position")


def collection_counts(footage: DataFrame, warehouses: DataFrame, scopes: Sequence[tuple[str, str]] = (), *, duplicates: DataFrame | None = None, retouch_pairs: DataFrame | None = None) -> DataFrame:
    """One row ``n_all, n_tagged, n_untagged, n_missing, n_duplicates, n_retouch``: rows within the scopes, unresolved groups, pairs."""
    rows = footage.join(warehouses.select("warehouse", F.coalesce("online", F.lit(False)).alias("online")), "warehouse").where(F.coalesce(in_scopes(scopes), F.lit(False)))
    here = F.col("online") & (F.col("status") == "available")
    n = F.size("tags")
    one = rows.agg(*[F.count_if(c).alias(f"n_{k}") for k, c in (("all", here), ("tagged", here & (n > 0)), ("untagged", here & (n == 0)), ("missing", F.col("status") == "missing"))])
    groups = duplicates.agg(F.count_distinct("group").alias("n_duplicates")) if duplicates is not None else None
    pairs = retouch_pairs.agg(F.count("*").alias("n_retouch")) if retouch_pairs is not None else None
    for name, df in (("n_duplicates", groups), ("n_retouch", pairs)):
        # One row beside one row.
        one = one.join(df, F.lit(True), "left") if df is not None else one.withColumn(name, F.lit(0).cast("long"))
    return one


def search_scores(footage: DataFrame, tokens: Sequence[str], catalogue: DataFrame) -> DataFrame:
    """(id, score): the sum over the tokens of the best case by which each is found; rows that none finds are left out.

    100: a tag's value, name or English keyword; 90: part of a custom tag; 70: part of a tag's name; 40: a category or its name; 30, 20, 15: part
    of the file name, path or notes; 25: the year. ``catalogue``: category, category_names, tag, names.
    """
    if not tokens:
        return footage.select("id", F.lit(1.0).alias("score"))
    parts = catalogue.select("category", F.col("tag").alias("value"), F.transform(F.map_values("names"), lambda n: F.lower(n)).alias("_names"), C.stock_keyword(F.try_element_at("names", F.lit("en"))).alias("_english"))
    above = catalogue.groupBy("category").agg(F.first("category_names").alias("_c")).select("category", F.transform(F.map_values("_c"), lambda n: F.lower(n)).alias("_categories"))
    tags = footage.select("id", F.explode("tags").alias("t")).select("id", F.col("t.category").alias("category"), F.col("t.value").alias("value")).join(parts, ["category", "value"], "left").join(above, "category", "left")
    value, known = F.lower("value"), F.col("_categories").isNotNull()

    def of_tag(token: str) -> Column:
        t = F.lit(token)
        names = F.coalesce(F.col("_names"), F.array().cast("array<string>"))
        exact = (value == t) | F.array_contains(names, t) | (F.col("_english") == t)
        part = F.exists(names, lambda n: n.contains(t))
        category = known & ((F.lower("category") == t) | F.array_contains("_categories", t))
        cases = ((100, exact), (90, (F.col("category") == "custom") & value.contains(t)), (70, part), (40, category))
        return F.greatest(F.lit(0), *[F.when(F.coalesce(c, F.lit(False)), s).otherwise(0) for s, c in cases])

    best = tags.groupBy("id").agg(*[F.max(of_tag(t)).alias(f"_s{i}") for i, t in enumerate(tokens)])
    # Lower-cased once; a subquery of its own, as each token looks into all three.
    text = footage.select("id", F.lower("filename").alias("_f"), F.lower("relative_path").alias("_p"), F.lower("user_notes").alias("_n"), F.date_format("captured_at", "yyyy").alias("_y"))

    def of_row(token: str) -> Column:
        cases = ((30, F.col("_f").contains(token)), (25, F.col("_y") == token), (20, F.col("_p").contains(token)), (15, F.col("_n").contains(token)))
        return F.greatest(F.lit(0), *[F.when(F.coalesce(c, F.lit(False)), s).otherwise(0) for s, c in cases])

    joined = text.join(best, "id", "left")
    total = sum((F.greatest(of_row(t), F.coalesce(f"_s{i}", F.lit(0))) for i, t in enumerate(tokens)), F.lit(0))
    return joined.select("id", total.cast("double").alias("score")).where("score > 0")


def visible(footage: DataFrame, warehouses: DataFrame, selection: Selection, scopes: Sequence[tuple[str, str]] = (), *, tokens: Sequence[str] = (), catalogue: DataFrame | None = None, sort: str = "relevance", ascending: bool | None = None, most_alike: int = 8, **of) -> DataFrame:
    """The rows to show, with ``score``, in the order of ``sort``; none for the lists of duplicates and retouched pairs, which show groups.

    Rows that are available but offline aren't found. With tokens, rows that look like the best hit (``phash`` within ``most_alike`` bits) gain what is left of them.
    """
    rows = included(footage, warehouses, selection, scopes, **of).where(~((F.col("status") == "available") & ~F.col("online")))
    if selection.kind in ("duplicates", "retouch"):
        rows = rows.where(F.lit(False))
    if not tokens:
        found = rows.withColumn("score", F.lit(1.0))
    else:
        if catalogue is None:
            raise ValueError("a search needs the tag catalogue")
        found = rows.join(search_scores(rows, tokens, catalogue), "id")
        top = found.orderBy(F.desc("score"), F.col("phash").asc_nulls_last(), F.lower("filename"), "id").limit(1).select(F.col("phash").alias("_seed"))
        d = C.hamming(F.col("phash"), F.col("_seed"))
        gain = F.when((F.coalesce("_seed", F.lit("")) != "") & (F.col("phash") != F.col("_seed")) & (d <= most_alike), most_alike - d).otherwise(0)
        found = found.join(F.broadcast(top), F.lit(True), "left").withColumn("score", F.col("score") + F.coalesce(gain, F.lit(0))).drop("_seed")
    return found.orderBy(*L.sort_order(sort, ascending))
