"""Ranked keyword search over a catalogue."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medialake.functions import columns as C


def token_score(token: str, exact: Sequence[Column], custom: Sequence[Column] = (), names: Sequence[Column] = (), categories: Sequence[Column] = (), filename: Column | None = None, year: Column | None = None, path: Column | None = None, notes: Column | None = None) -> Column:
    """The best of the cases a token can match by; 0 if it doesn't."""
    cases = [(100, lower_equals(c, token)) for c in exact]
    cases += [(90, holds(c, token)) for c in custom] + [(70, holds(c, token)) for c in names] + [(40, lower_equals(c, token)) for c in categories]
    cases += [(s, holds(c, token)) for s, c in ((30, filename), (20, path), (15, notes)) if c is not None]
    if year is not None:
        cases.append((25, year.cast("string") == token))
    return F.greatest(F.lit(0), *[F.when(c, s).otherwise(0) for s, c in cases], F.lit(0))


def lower_equals(c: Column, token: str) -> Column:
    return F.coalesce(F.lower(c) == token, F.lit(False))


def holds(c: Column, token: str) -> Column:
    return F.coalesce(F.lower(c).contains(token), F.lit(False))


def rank(rows: DataFrame, tokens: Sequence[str], cases) -> DataFrame:
    """Adds ``score``, the sum over the tokens; rows that no token finds go. Without tokens every row has 1.

    ``cases(token)`` is the token's score.
    """
    if not tokens:
        return rows.withColumn("score", F.lit(1))
    total = sum((cases(t) for t in tokens[1:]), cases(tokens[0]))
    return rows.withColumn("score", total).where(F.col("score") > 0)


def nudge(hits: DataFrame, key: str, bits: str, most: int = 8) -> DataFrame:
    """Hits that look like the top one gain ``most`` less the distance of their fingerprints."""
    top = hits.orderBy(F.desc("score"), key).limit(1).select(F.col(key).alias("_top"), F.col(bits).alias("_bits"))
    d = C.hamming(F.col(bits), F.col("_bits"))
    gain = F.when((F.col(key) != F.col("_top")) & (F.col(bits) != F.col("_bits")) & (d <= most), most - d).otherwise(0)
    return hits.join(F.broadcast(top), F.lit(True), "left").withColumn("score", F.col("score") + F.coalesce(gain, F.lit(0))).drop("_top", "_bits")
