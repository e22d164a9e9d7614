"""What users kept of a model's tags, as examples for the next request; and a library's own custom tags."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from medialake.functions import columns as C
from medialake.functions import variants as V

#: Tags of a side, examples taken of one confirmation, and examples kept, at most.
MOST_TAGS, MOST_NEW, MOST_KEPT = 12, 3, 8


def compact_tags(tags: Column, most: int = MOST_TAGS) -> Column:
    """Array of (category, value): trimmed, without blanks and repeats, ``most`` at most."""
    trimmed = F.transform(tags, lambda t: F.struct(F.trim(t["category"]).alias("category"), F.trim(t["value"]).alias("value")))
    filled = F.filter(trimmed, lambda t: (t["category"] != "") & (t["value"] != ""))
    return F.slice(V.first_of(filled, lambda t: F.concat(t["category"], F.lit("/"), t["value"])), 1, most)


def make_examples(confirmed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, ai, kept, correction): what a model proposed and what was kept of each confirmed row (arrays ``proposed`` and ``kept`` of category, value, source).

    Rows where either side is empty give none. ``correction``: the sides differ as sets.
    """
    sides = confirmed.select(*keys, compact_tags(F.filter("proposed", lambda t: t["source"] == "ai")).alias("ai"), compact_tags(F.col("kept")).alias("kept"))
    return sides.where((F.size("ai") > 0) & (F.size("kept") > 0)).withColumn("correction", F.array_sort("ai") != F.array_sort("kept"))


def record_examples(existing: DataFrame, newest: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, pos, ai, kept): each library's examples, the newest first, ``MOST_KEPT`` at most.

    Of ``newest`` (by, pos, ai, kept, correction) the first ``MOST_NEW`` are taken, corrections before others; one that
    is there already moves to the front. ``existing``: by, pos, ai, kept.
    """
    taken = newest.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy((~F.col("correction")).cast("int"), "pos"))).where(F.col("_k") <= MOST_NEW)
    every = taken.select(*by, F.lit(0).alias("_age"), F.col("_k").cast("long").alias("pos"), "ai", "kept").unionByName(existing.select(*by, F.lit(1).alias("_age"), F.col("pos").cast("long").alias("pos"), "ai", "kept"))
    first = every.groupBy(*by, "ai", "kept").agg(F.min(F.struct("_age", "pos")).alias("_o"))
    placed = first.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy("_o"))).where(F.col("_n") <= MOST_KEPT)
    return placed.select(*by, (F.col("_n") - 1).alias("pos"), "ai", "kept")


def example_payload(ai: Column, kept: Column) -> Column:
    """An example on one line of JSON, as a prompt holds it."""
    return V.compact_json(F.try_parse_json(F.to_json(F.struct(ai.alias("ai"), kept.alias("kept")))))


def custom_tags_in_use(tags: DataFrame) -> DataFrame:
    """(value, source): the custom tags of all rows, once each by the best source."""
    custom = tags.where(F.col("category") == "custom")
    return custom.groupBy("value").agg(F.min_by("source", F.struct(C.source_rank(F.col("source")), "source")).alias("source"))
