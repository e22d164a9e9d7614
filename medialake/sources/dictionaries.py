"""Keyword dictionaries: CC-CEDICT text files and JSON maps of words to English keywords."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from medialake.functions import columns as C

# Beginnings of definitions that aren't a translation.
NOT_GLOSSES = ("variant of", "old variant of", "japanese variant of", "see ", "surname ", "kangxi", "abbr.", "also pr.", "also written", "erhua variant", "classifier", "archaic variant", "used in", "see also", "cl:")
# The blocks of CJK ideographs, radicals and strokes.
_CJK = r"[\x{2E80}-\x{2EFF}\x{31C0}-\x{31EF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{323AF}]"
_ENTRY = r"^(\S+)\s+(\S+)\s+\[([^\]]*)\]\s+/(.+)/$"


def _plain(definition: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(definition, r"\([^)]*\)", " "), r"\s+", " "))


def gloss_keyword(definition: Column) -> Column:
    """A definition's first sense as a keyword, without remarks in brackets, ``to`` and ``the``; null if it gives none."""
    text = F.regexp_replace(F.regexp_replace(F.replace(_plain(definition), F.lit("|"), F.lit(" ")), r"\s+", " "), r"^[ ,;.]+|[ ,;.]+$", "")
    sense = F.trim(F.element_at(F.split(text, "[;/,]"), 1))
    word = C.stock_keyword(F.regexp_replace(F.regexp_replace(sense, r"(?i)^to +", ""), r"(?i)^the +", ""))
    other = F.lit(False)
    for beginning in NOT_GLOSSES:
        other = other | F.startswith(F.lower(text), F.lit(beginning))
    hyphened = word.rlike("^[a-z0-9]+(-[a-z0-9]+)*( [a-z0-9]+(-[a-z0-9]+)*)*$")
    return F.when(~other & C.keyword_valid(word) & hyphened, word)


def cedict(spark: SparkSession, path: str) -> DataFrame:
    """(word, english): each traditional or simplified word of 2 to 8 characters with its first usable gloss; names of persons and places only where there's no other.

    Lines are read in blocks; a word's first gloss is that of the file, block, line and place in the line.
    """
    lines = spark.read.text(path).select(F.trim("value").alias("line"), F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("row")).alias("at"))
    part = lambda i: F.regexp_extract("line", _ENTRY, i)
    entries = lines.where(~F.startswith(F.col("line"), F.lit("#")) & F.col("line").rlike(_ENTRY)).select("at", F.array_distinct(F.array(part(1), part(2))).alias("words"), F.posexplode(F.split(part(4), "/")).alias("pos", "definition"))
    name = _plain(F.col("definition")).rlike("^[A-Z][a-z]+( [A-Z][a-z]+)*$")
    glosses = entries.select("at", "pos", name.alias("name"), gloss_keyword(F.col("definition")).alias("english"), F.explode("words").alias("word"))
    usable = glosses.where(F.col("english").isNotNull() & F.char_length("word").between(2, 8) & F.col("word").rlike(_CJK))
    return usable.groupBy("word").agg(F.min_by("english", F.struct("name", "at", "pos")).alias("english"))


def keyword_map(spark: SparkSession, path: str) -> DataFrame:
    """(word, english) of a JSON object."""
    return spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,string>")).alias("word", "english"))


def merged_dictionary(base: DataFrame, over: DataFrame) -> DataFrame:
    """One English keyword for each word (trimmed, and as a keyword) of two dictionaries, ``over`` before ``base``; words of one character or plain ASCII letters are left out."""
    every = base.withColumn("rank", F.lit(2)).unionByName(over.withColumn("rank", F.lit(0))).withColumn("word", F.trim("word"))
    fit = every.where((F.char_length("word") >= 2) & C.needs_companion(F.col("word")))
    both = fit.unionByName(fit.select(C.stock_keyword(F.col("word")).alias("word"), "english", (F.col("rank") + 1).alias("rank")))
    return both.groupBy("word").agg(F.min_by("english", F.struct("rank", "english")).alias("english"))
