"""What a model's tags have to agree with: the facts that were seen in the frames.

Rules are rows of (category, value, fact): a tag with that identity goes if the
fact holds. A custom keyword also meets the rules for its words and for the whole
phrase. One join finds what goes; the facts' own tags are added after.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# People counts, values that need a person, identities that need a living person, and keywords' words by class.
COUNTS = ("none", "one", "two", "group", "crowd")
NEEDS_PERSON = ("portrait", "distant", "silhouette", "hands", "infant", "child", "teen", "youngAdult", "adult", "senior")
NEEDS_LIVING = (("lifestyle", "family"), ("lifestyle", "friends"), ("sport", "spectators"), ("sport", "kidsPlay"))
PEOPLE_WORDS = ("people", "person", "man", "woman", "men", "women", "crowd", "portrait", "human", "humans", "child", "children", "boy", "girl", "baby", "infant", "teen", "adult", "senior", "couple", "someone")
CALENDAR_WORDS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")
PET_PHRASES = ("pet", "pets", "house pet")
PET_WORDS = ("pet", "pets", "puppy", "kitten")
NO_PEOPLE = "no people"

#: The categories under which a custom keyword's phrase and words are looked up.
PHRASE, WORD = "\0phrase", "\0word"


def rules(spark: SparkSession) -> DataFrame:
    """(category, value, fact): ``always``, ``seen`` (there are facts), ``nobody``, ``no_portrait``, ``no_distant``, ``no_hands``, ``no_animals``."""
    rows = [("people", v, "seen") for v in COUNTS] + [("people", v, "nobody") for v in NEEDS_PERSON] + [(*x, "nobody") for x in NEEDS_LIVING]
    rows += [("people", v, f"no_{v}") for v in ("portrait", "distant", "hands")] + [("animals", "pet", "no_animals")]
    rows += [(PHRASE, w, "always") for w in CALENDAR_WORDS] + [(WORD, w, "nobody") for w in PEOPLE_WORDS]
    rows += [(PHRASE, w, "no_animals") for w in PET_PHRASES] + [(WORD, w, "no_animals") for w in PET_WORDS]
    return spark.createDataFrame(rows, "category string, value string, fact string")


def _normal(keyword: Column) -> Column:
    return F.lower(F.regexp_replace(keyword, r"^\s+|\s+$", ""))


def _words(keyword: Column) -> Column:
    return F.split(_normal(keyword), r"\s+")


def is_people_keyword(keyword: Column) -> Column:
    return (_normal(keyword) != NO_PEOPLE) & F.arrays_overlap(_words(keyword), F.array(*map(F.lit, PEOPLE_WORDS)))


def is_calendar_keyword(keyword: Column) -> Column:
    return _normal(keyword).isin(*CALENDAR_WORDS)


def is_pet_keyword(keyword: Column) -> Column:
    return _normal(keyword).isin(*PET_PHRASES) | F.arrays_overlap(_words(keyword), F.array(*map(F.lit, PET_WORDS)))


def _facts(people: Column, hands: Column, face: Column, animals: Column) -> Column:
    nobody = people == "none"
    held = {"always": F.lit(True), "seen": F.lit(True), "nobody": nobody, "no_portrait": face != "portrait", "no_distant": face != "distant", "no_hands": ~hands | nobody, "no_animals": F.size(animals) == 0}
    return F.array_compact(F.array(*[F.when(c, name) for name, c in held.items()]))


def apply_gate(tags: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """(key, category, value, source, pos): tags (with ``pos``, their order) that agree with what was seen, once each, and the facts' own tags behind them.

    ``seen``: key, people, hands, face, animals (array), reliable. What isn't reliable counts as nobody and nothing. A row that
    wasn't looked at at all (no row in ``seen``) loses calendar keywords only and gains nothing.
    """
    sure = F.coalesce("reliable", F.lit(False))
    facts = seen.select(
        key, F.when(sure, F.col("people")).otherwise("none").alias("_people"), (sure & F.coalesce("hands", F.lit(False))).alias("_hands"),
        F.when(sure, F.col("face")).otherwise("none").alias("_face"), F.when(sure, F.coalesce("animals", F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>")).alias("_animals"),
    )
    known = facts.select(key, "_people", "_hands", _facts(F.col("_people"), F.col("_hands"), F.col("_face"), F.col("_animals")).alias("_facts"))
    own = tags.select(key, "category", "value", "source", "pos")
    at = lambda category, value: F.struct(F.lit(category).alias("c") if isinstance(category, str) else category.alias("c"), value.alias("v"))
    normal, custom = _normal(F.col("value")), F.col("category") == "custom"
    words = F.when(normal == NO_PEOPLE, F.array().cast("array<string>")).otherwise(_words(F.col("value")))
    looked_up = F.concat(F.array(at(F.col("category"), F.col("value"))), F.when(custom, F.concat(F.array(at(PHRASE, normal)), F.transform(words, lambda w: at(WORD, w)))).otherwise(F.array().cast("array<struct<c: string, v: string>>")))
    met = own.join(known.select(key, "_facts"), key, "left").select(key, "category", "value", F.coalesce("_facts", F.array(F.lit("always"))).alias("_facts"), F.explode(looked_up).alias("_at"))
    rule = rules(tags.sparkSession).select(F.struct(F.col("category").alias("c"), F.col("value").alias("v")).alias("_at"), "fact")
    gone = met.join(F.broadcast(rule), "_at").where(F.array_contains("_facts", F.col("fact"))).select(key, "category", "value").distinct()
    kept = own.join(gone, [key, "category", "value"], "left_anti").select(own.columns)
    last = 1 << 30
    forced = F.filter(F.array(F.struct(F.col("_people").alias("value"), F.lit(last).alias("pos")), F.when(F.col("_hands") & (F.col("_people") != "none"), F.struct(F.lit("hands").alias("value"), F.lit(last + 1).alias("pos")))), lambda x: x.isNotNull())
    own_tags = known.select(key, F.explode(forced).alias("x")).select(key, F.lit("people").alias("category"), "x.value", F.lit("ai").alias("source"), F.col("x.pos").cast(own.schema["pos"].dataType).alias("pos"))
    every = kept.unionByName(own_tags)
    return every.groupBy(key, "category", "value").agg(F.min_by("source", "pos").alias("source"), F.min("pos").alias("pos")).select(own.columns)
