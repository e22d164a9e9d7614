"""A library's rows: views, selections, mutations, sort orders, keyword expansion, time and place lookups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from medialake.functions import columns as C
from medialake.operators.ranks import Look, neighbours


# -- views --------------------------------------------------------------------------------------------------------------
def with_tags(footage: DataFrame, tags: DataFrame, key: str) -> DataFrame:
    """Rows with their ``tags`` (category, value, source; by source rank, then category and value) as an array, each tag once with its best source; untagged ones have an empty one."""
    item = F.struct(C.source_rank(F.col("source")).alias("rank"), "category", "value", "source")
    best = tags.groupBy(key, "category", "value").agg(F.min_by("source", F.struct(C.source_rank(F.col("source")), "source")).alias("source"))
    own = best.groupBy(key).agg(F.array_sort(F.collect_set(item)).alias("tags"))
    return footage.join(own, key, "left").withColumn("tags", F.coalesce("tags", F.array().cast(own.schema["tags"].dataType)))


def with_members(groups: DataFrame, footage: DataFrame, content_hash: str, key: str) -> DataFrame:
    """(group row, member row), one for each member, so that a large group isn't one value."""
    return groups.join(footage.select(content_hash, key), content_hash)


def select_by(rows: DataFrame, name: str, value: str, members: DataFrame | None = None, *, key: str = "id") -> DataFrame:
    """Rows of a ``warehouse``, a ``folder`` (with what is below), a tag ``category`` (``tags``), or a ``gpx`` or ``itinerary`` member list."""
    if name == "warehouse":
        return rows.where(F.col("warehouse") == value)
    if name == "folder":
        return rows.where(C.in_folder(F.col("directory"), F.lit(value)))
    if name == "category":
        return rows.where(F.exists("tags", lambda t: t["category"] == value))
    if name in ("gpx", "itinerary") and members is not None:
        return rows.join(members.where(F.col("owner") == value).select(key).distinct(), key, "left_semi")
    raise ValueError(name)


# -- mutations: each gives the table after it ---------------------------------------------------------------------------
def clear_misplaced_gps(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The table with misplaced positions nulled, and the ids of the rows concerned."""
    bad = C.is_misplaced_gps(F.col("latitude"), F.col("longitude"), F.col("gps_source"))
    parts = ("latitude", "longitude", "altitude", "gps_source")
    return rows.select(*[F.when(~bad, F.col(c)).alias(c) if c in parts else F.col(c) for c in rows.columns]), rows.where(bad).select("id")


def remove_tags(tags: DataFrame, gone: DataFrame, keys: Sequence[str], source: str | None = None) -> DataFrame:
    """Tags without those of ``gone``; with ``source``, only that source's go."""
    if source is None:
        return tags.join(gone.select(*keys).distinct(), list(keys), "left_anti")
    hit = tags.join(gone.select(*keys).distinct().withColumn("_gone", F.lit(True)), list(keys), "left")
    return hit.where(F.col("_gone").isNull() | F.coalesce(F.col("source") != source, F.lit(True))).select(tags.columns)


def delete_cascade(ids: DataFrame, key: str, *tables: DataFrame) -> list[DataFrame]:
    """Every table without the rows of the deleted ids."""
    gone = ids.select(key).distinct()
    return [t.join(gone, key, "left_anti").select(t.columns) for t in tables]


def register_clips(rows: DataFrame, clips: DataFrame, least: float = 0.2) -> DataFrame:
    """The table with derived clips (id, parent_id, path, start_s, end_s): a clip has what its parent has, but its own path and duration, and is to be analysed.

    ``rows``: id, parent_id, path, duration, needs_reanalysis and any others; a clip without a parent row is left out.
    """
    own = {"id": F.col("_c.id"), "parent_id": F.col("_c.parent_id"), "path": F.col("_c.path"), "duration": F.greatest(F.col("_c.end_s") - F.col("_c.start_s"), F.lit(least)), "needs_reanalysis": F.lit(True)}
    joined = rows.alias("_r").join(clips.select(F.struct("id", "parent_id", "path", "start_s", "end_s").alias("_c")), F.col("_r.id") == F.col("_c.parent_id"))
    return rows.unionByName(joined.select(*[own.get(c, F.col(f"_r.{c}")).alias(c) for c in rows.columns]))


def set_value(rows: DataFrame, changes: DataFrame, key: str, column: str) -> DataFrame:
    """``column`` from ``changes`` (unique by ``key``) where there is one, null included."""
    new = changes.select(key, F.col(column).alias("_value"), F.lit(True).alias("_there"))
    return rows.join(new, key, "left").select(*[F.when(F.col("_there"), F.col("_value")).otherwise(F.col(c)).alias(c) if c == column else F.col(c) for c in rows.columns])


def keep_by_precedence(existing: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Incoming tags whose source is at least as good as the existing one's."""
    old = existing.select(*keys, C.source_rank(F.col("source")).alias("_rank")).groupBy(*keys).agg(F.min("_rank").alias("_rank"))
    return incoming.join(old, list(keys), "left").where(F.col("_rank").isNull() | (C.source_rank(F.col("source")) <= F.col("_rank"))).select(incoming.columns)


# -- orders and bounded lists -------------------------------------------------------------------------------------------
#: Whether an order goes up unless said otherwise.
ASCENDING = {"relevance": False, "filename": True, "captured_at": False, "modified": False, "duration": False, "size": False, "kind": True}


def sort_order(name: str, ascending: bool | None = None) -> list[Column]:
    """An order of a library by one of seven keys; nulls last either way, ties by natural file name, then id."""
    up = ASCENDING[name] if ascending is None else ascending
    key = {"relevance": F.col("score"), "filename": C.natural_key(F.col("filename")), "kind": C.kind_order(F.col("kind"))}.get(name, F.col(name))
    return [key.asc_nulls_last() if up else key.desc_nulls_last(), C.natural_key(F.col("filename")).asc(), F.col("id").asc()]


def recent_first(values: DataFrame, used: DataFrame, value: str, time: str, most: int = 50) -> DataFrame:
    """Values used last first, the others by natural name after them, ``most`` in all."""
    last = used.groupBy(value).agg(F.max(time).alias("_last"))
    order = [F.col("_last").desc_nulls_last(), C.natural_key(F.col(value)).asc(), F.col(value).asc()]
    return values.select(value).distinct().join(last, value, "left").orderBy(*order).limit(most).drop("_last")


def move_to_front(kept: DataFrame, new: DataFrame, key: str, at: str, most: int) -> DataFrame:
    """A bounded list by last use: entries of ``new`` replace those of the same key and come first; the ``most`` last used stay."""
    every = kept.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    value = F.struct(*[F.col(c) for c in kept.columns])
    last = every.groupBy(key).agg(F.max_by(value, F.struct("_new", at)).alias("_row")).select("_row.*")
    return last.orderBy(F.desc(at), key).limit(most)


# -- keywords -----------------------------------------------------------------------------------------------------------
def catalogue_names(catalogue: DataFrame) -> DataFrame:
    """(name, category, tag, english): the first catalogue entry that has a name, in any language or as its id."""
    names = catalogue.select("category", "tag", F.coalesce(F.try_element_at("names", F.lit("en")), F.col("tag")).alias("english"), "ord", F.explode(F.concat(F.array("tag"), F.map_values("names"))).alias("name"))
    keyed = names.select(C.stock_keyword(F.col("name")).alias("name"), "category", "tag", "english", "ord").where("name <> ''")
    return keyed.groupBy("name").agg(F.min(F.struct("ord", "category", "tag", "english")).alias("m")).select("name", "m.category", "m.tag", "m.english")


def expand_tags(tags: DataFrame, catalogue: DataFrame, glossary: DataFrame, keys: Sequence[str], *, dictionary: DataFrame | None = None, english: bool = True) -> DataFrame:
    """Tags (``keys``, category, value, source) with what they stand for, once each by the best source.

    A custom tag gains its glossary counterparts and, if a catalogue entry has its
    name, that entry and its English keyword; one with letters beyond ASCII and neither an entry nor a counterpart without such letters
    gains its words in ``dictionary`` (word, english). A catalogue tag gains its English keyword, unless ``english`` is false.
    """
    both = glossary.select(C.stock_keyword(F.col("a")).alias("w"), F.col("b").alias("o")).unionByName(glossary.select(C.stock_keyword(F.col("b")).alias("w"), F.col("a").alias("o"))).distinct()
    custom = tags.where(F.col("category") == "custom").withColumn("w", C.stock_keyword(F.col("value")))
    met = custom.join(both, "w")
    counterparts = met.select(*keys, F.lit("custom").alias("category"), F.col("o").alias("value"), "source")
    found = custom.join(catalogue_names(catalogue).toDF("w", "_category", "_tag", "_english"), "w")
    entries = found.select(*keys, F.col("_category").alias("category"), F.col("_tag").alias("value"), "source")
    named = found.where(C.stock_keyword(F.col("_english")) != F.lower("value")).select(*keys, F.lit("custom").alias("category"), C.stock_keyword(F.col("_english")).alias("value"), "source")
    more = [counterparts, entries, named]
    if dictionary is not None:
        foreign = custom.where(C.needs_companion(F.col("value")))
        latin = met.where(~C.needs_companion(F.col("o"))).select("w").distinct()
        bare = foreign.join(found.select("w").distinct(), "w", "left_anti").join(latin, "w", "left_anti")
        looked = dictionary_words(bare.select("w").distinct(), "w", "w", dictionary)
        more.append(bare.join(looked, "w").select(*keys, F.lit("custom").alias("category"), F.col("english").alias("value"), "source"))
    if english:
        presets = catalogue.select("category", F.col("tag").alias("value"), C.stock_keyword(F.try_element_at("names", F.lit("en"))).alias("_english"))
        more.append(tags.join(presets, ["category", "value"]).where("_english <> ''").select(*keys, F.lit("custom").alias("category"), F.col("_english").alias("value"), "source"))
    every = tags.select(*keys, "category", "value", "source")
    for df in more:
        every = every.unionByName(df)
    return every.groupBy(*keys, "category", "value").agg(F.min_by("source", C.source_rank(F.col("source"))).alias("source"))


def search_tokens(tokens: DataFrame, catalogue: DataFrame, glossary: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(query, token): a query's tokens (``query``, ``token``) and what else they may be written as, once each.

    A token's glossary counterparts; for one with letters beyond ASCII also the English keyword and the id of the
    catalogue entry of that name, or, without entry and Latin counterpart, its words in the dictionary.
    """
    word = C.stock_keyword(F.col("token"))
    own = tokens.select("query", F.lower(F.trim("token")).alias("token")).where("token <> ''").distinct()
    sides = [glossary.select(C.stock_keyword(F.col(a)).alias("w"), C.stock_keyword(F.col(b)).alias("o")) for a, b in (("a", "b"), ("b", "a"))]
    w = own.withColumn("w", word)
    other = w.join(sides[0].unionByName(sides[1]).where("o <> ''").distinct(), "w").select("query", "token", "w", F.col("o").alias("alias"))
    foreign = w.where(C.needs_companion(F.col("token")))
    entry = foreign.join(catalogue_names(catalogue).toDF("w", "_category", "_tag", "_english"), "w")
    named = entry.select("query", "token", "w", F.explode(F.array(C.stock_keyword(F.col("_english")), F.lower("_tag"))).alias("alias"))
    latin = other.where(~C.needs_companion(F.col("alias"))).select("query", "token").distinct()
    bare = foreign.join(entry.select("query", "token").distinct(), ["query", "token"], "left_anti").join(latin, ["query", "token"], "left_anti")
    looked = dictionary_words(bare.select("token").distinct(), "token", "token", dictionary)
    found = bare.join(looked, "token").select("query", "token", "w", F.col("english").alias("alias"))
    aliases = other.unionByName(named).unionByName(found).where("alias <> '' AND alias <> w").select("query", F.col("alias").alias("token"))
    return own.unionByName(aliases).distinct()


def glossary_add(pairs: DataFrame, new: DataFrame) -> DataFrame:
    """Pairs (id, native, english) with the new ones, one of a native word: a known one keeps its id and takes the new form; one with a blank side is left out."""
    given = new.select("id", F.trim("native").alias("native"), F.trim("english").alias("english")).where("native <> '' AND english <> ''")
    keyed = given.groupBy(C.stock_keyword(F.col("native")).alias("_key")).agg(F.max_by(F.struct("id", "native", "english"), "id").alias("_new"))
    old = pairs.select("id", "native", "english", C.stock_keyword(F.col("native")).alias("_key")).join(keyed, "_key", "full")
    return old.select(F.coalesce("id", "_new.id").alias("id"), F.coalesce("_new.native", "native").alias("native"), F.coalesce("_new.english", "english").alias("english"))


def dictionary_words(rows: DataFrame, key: str, text: str, dictionary: DataFrame, longest: int = 6) -> DataFrame:
    """(key, english): a text's entry in ``dictionary`` (word, english), else those of the longest words in it, left to right.

    Pieces of 2 to ``longest`` characters meet the dictionary in a join, so it may
    have any size; the greedy choice is a fold over a text's own hits.
    """
    base = rows.select(F.col(key).alias("_key"), F.lower(F.trim(text)).alias("_text"))
    exact = base.join(dictionary.select(F.col("word").alias("_text"), "english"), "_text").select("_key", "english", F.lit(0).alias("_at"))
    n = F.char_length("_text")
    starts = F.explode(F.when(n >= 2, F.sequence(F.lit(1), n - 1)).otherwise(F.array().cast("array<int>")))
    pieces = base.join(exact.select("_key"), "_key", "left_anti").select("_key", "_text", starts.alias("_at")).select("_key", "_at", F.explode(F.array(*[F.substring(F.col("_text"), F.col("_at"), F.lit(i)) for i in range(2, longest + 1)])).alias("word"), F.char_length("_text").alias("_n"))
    hits = pieces.join(dictionary, "word").where(F.col("_at") + F.char_length("word") - 1 <= F.col("_n")).groupBy("_key", "_at").agg(F.max_by(F.struct(F.char_length("word").alias("len"), "english"), F.char_length("word")).alias("m"))
    ordered = hits.groupBy("_key").agg(F.array_sort(F.collect_list(F.struct("_at", "m.len", "m.english"))).alias("h"))
    none = F.struct(F.lit(0).alias("end"), F.array().cast("array<struct<_at: int, english: string>>").alias("out"))
    greedy = F.aggregate("h", none, lambda s, x: F.when(x["_at"] > s["end"], F.struct((x["_at"] + x["len"] - 1).alias("end"), F.concat(s["out"], F.array(F.struct(x["_at"].alias("_at"), x["english"].alias("english")))).alias("out"))).otherwise(s))
    contained = ordered.select("_key", F.explode(greedy["out"]).alias("x")).select("_key", "x.english", "x._at")
    every = exact.unionByName(contained).select("_key", C.stock_keyword(F.col("english")).alias("english")).where("english <> ''").distinct()
    return every.select(F.col("_key").alias(key), "english")


def allowed_tags(tags: DataFrame, catalogue: DataFrame, known: DataFrame, blocked: DataFrame) -> DataFrame:
    """A model's tags that may be kept: catalogue entries, and custom values that aren't blocked and are known or fit to be seen."""
    presets = tags.where(F.col("category") != "custom").join(catalogue.select("category", F.col("tag").alias("value")), ["category", "value"], "left_semi").select(tags.columns)
    custom = tags.where(F.col("category") == "custom").withColumn("_key", C.stock_keyword(F.col("value")))
    open_ = custom.join(blocked.select(C.stock_keyword(F.col("value")).alias("_key")).where("_key <> ''").distinct(), "_key", "left_anti")
    seen = open_.join(known.select("value", F.lit(True).alias("_known")).distinct(), "value", "left")
    return presets.unionByName(seen.where(F.coalesce("_known", C.visible_custom_label(F.col("value")))).select(tags.columns))


# -- time and place -----------------------------------------------------------------------------------------------------
def nearest_in_time(probes: DataFrame, track: DataFrame, by: Sequence[str], time: str, value: str) -> DataFrame:
    """The value of a track's point nearest in time to each probe (``id``), the earlier one on a tie; null without points."""
    points = track.groupBy(*by, time).agg(F.min(value).alias(value))
    found = neighbours(probes.select(*by, time, "id"), {"a": Look(points), "b": Look(points, after=True)}, by, time)
    t = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    before = F.col("b").isNull() | (t(time) - t(f"a.{time}") <= t(f"b.{time}") - t(time))
    return found.select(*by, "id", F.when(F.col("a").isNotNull() & before, F.col(f"a.{value}")).otherwise(F.col(f"b.{value}")).alias(value))


def stay_of(probes: DataFrame, stays: DataFrame, by: Sequence[str], pad_s: int = 1200) -> DataFrame:
    """The first stay (``stay``, ``start_s``, ``end_s``) that holds a probe (``id``, ``t_s``) within ``pad_s``, else the nearer neighbour.

    ``relation``: inside, previous or next (the previous one on a tie). Stays of a key don't overlap, so they end in
    the order in which they begin, and the first that holds a moment is the first whose padded end isn't before it.
    """
    row = stays.withColumn("pos", F.row_number().over(Window.partitionBy(*by, "start_s").orderBy("end_s", "stay")))
    at = lambda moment: row.withColumn("t_s", moment)
    looks = {"holding": Look(at(F.col("end_s") + pad_s), after=True), "previous": Look(at(F.col("end_s"))), "following": Look(at(F.col("start_s")), after=True)}
    found = neighbours(probes.select(*by, "id", "t_s"), looks, by, "t_s")
    t = F.col("t_s")
    inside = F.coalesce(F.col("holding.start_s") - pad_s <= t, F.lit(False))
    back, ahead = t - F.col("previous.end_s"), F.col("following.start_s") - t
    use = F.when(back.isNull() & ahead.isNull(), None).when(ahead.isNull() | (back <= ahead), "previous").otherwise("next")
    relation = F.when(inside, "inside").otherwise(use)
    stay = F.when(relation == "inside", F.col("holding.stay")).when(relation == "previous", F.col("previous.stay")).when(relation == "next", F.col("following.stay"))
    return found.select(*by, "id", relation.alias("relation"), stay.alias("stay"))


def utc_offset(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, offset_s): the most frequent civil minus UTC time of located rows whose time has a zone, in quarters of an hour, at most 14 h (the smaller on a tie); else by the first located row's longitude; else 0.

    ``rows``: civil_s and utc_s (null if unknown), has_zone, latitude, longitude, pos.
    """
    located = C.usable_gps(F.col("latitude"), F.col("longitude"))
    quarter = (F.signum(F.col("civil_s") - F.col("utc_s")) * F.floor(F.abs(F.col("civil_s") - F.col("utc_s")) / 900 + 0.5) * 900).cast("long")
    counts = rows.where(located & F.col("has_zone") & quarter.isNotNull() & (F.abs(quarter) <= 14 * 3600)).groupBy(*by, quarter.alias("q")).agg(F.count("*").alias("n"))
    best = counts.groupBy(*by).agg(F.max_by("q", F.struct("n", -F.col("q"))).alias("q"))
    first = rows.where(located).groupBy(*by).agg(F.min_by("longitude", "pos").alias("lon"))
    hours = F.floor(F.abs(F.col("lon")) / 15 + 0.5) * F.signum("lon") * 3600
    return rows.select(*by).distinct().join(best, list(by), "left").join(first, list(by), "left").select(*by, F.coalesce("q", hours.cast("long"), F.lit(0).cast("long")).alias("offset_s"))


def aligned_instant(rows: DataFrame, offsets: DataFrame, by: Sequence[str]) -> DataFrame:
    """Adds ``aligned_s``: a time with its own zone as it is, else the civil time read in the library's zone, else the stored time; then moved by the folder's offset, if ``rows`` has one (``folder_s``)."""
    joined = rows.join(offsets, list(by), "left")
    local = F.col("civil_s") - F.coalesce("offset_s", F.lit(0))
    moved = F.coalesce("folder_s", F.lit(0)) if "folder_s" in rows.columns else F.lit(0)
    return joined.withColumn("aligned_s", F.when(F.col("has_zone"), F.col("utc_s")).otherwise(F.coalesce(local, F.col("utc_s"))) + moved).drop("offset_s")


def gpx_eligible(rows: DataFrame) -> DataFrame:
    """Available photos and videos with a time and without a position."""
    return rows.where((F.col("status") == "available") & F.col("kind").isin("image", "video") & ~C.usable_gps(F.col("latitude"), F.col("longitude")) & F.col("captured_s").isNotNull())


def belongs_to_track(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """Available photos and videos whose assigned track (``target``) spans their adjusted time."""
    joined = rows.where((F.col("status") == "available") & F.col("kind").isin("image", "video")).join(spans, "target")
    return joined.where(F.col("captured_s").between(F.col("start_s"), F.col("end_s"))).select(rows.columns)


# -- names, tags and runs -----------------------------------------------------------------------------------------------
def unique_names(wanted: DataFrame, used: DataFrame, name: str, default: str) -> DataFrame:
    """(name, unique): each wanted name, or with the first number from 2 on, that isn't in ``used``; a blank one is ``default``.

    The numbers taken of a name are ranked: as long as number and rank agree, there's no gap.
    """
    seed = F.coalesce(F.nullif(F.trim(name), F.lit("")), F.lit(default))
    pattern = r"(?s)^(.*) ([1-9][0-9]{0,17})$"
    number = F.try_to_number(F.nullif(F.regexp_extract(name, pattern, 2), F.lit("")), F.lit("9" * 18)).cast("long")
    plain = used.select(F.col(name).alias("_seed"), F.lit(1).cast("long").alias("_n"))
    numbered = used.select(F.regexp_extract(name, pattern, 1).alias("_seed"), number.alias("_n")).where("_n >= 2")
    taken = plain.unionByName(numbered).distinct().withColumn("_rank", F.row_number().over(Window.partitionBy("_seed").orderBy("_n")))
    last = taken.where("_n = _rank").groupBy("_seed").agg(F.max("_n").alias("_last"))
    free = wanted.select(name, seed.alias("_seed")).join(last, "_seed", "left").withColumn("_free", F.coalesce("_last", F.lit(0)) + 1)
    return free.select(name, F.when(F.col("_free") == 1, F.col("_seed")).otherwise(F.concat_ws(" ", "_seed", "_free")).alias("unique"))


def union_tags(first: DataFrame, second: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Both lists of tags, each tag once with its best source."""
    best = F.min(F.struct(C.source_rank(F.col("source")).alias("rank"), "source"))
    return first.select(*keys, "source").unionByName(second.select(*keys, "source")).groupBy(*keys).agg(best.alias("_b")).select(*keys, F.col("_b.source").alias("source"))


def label_confidence(labels: DataFrame, keys: Sequence[str], label: str, confidence: str) -> DataFrame:
    """The highest confidence of each label over the frames of a row."""
    return labels.groupBy(*keys, label).agg(F.max(confidence).alias(confidence))


def run_tallies(rows: DataFrame, outcome: str) -> DataFrame:
    """One row: how many were tagged, failed or skipped, and how many remain."""
    ended = {f"n_{x}": F.count_if(F.col(outcome) == x) for x in ("tagged", "failed", "skipped")}
    remain = F.count_if(~F.coalesce(F.col(outcome).isin("tagged", "failed", "skipped"), F.lit(False)))
    return rows.agg(*[c.alias(n) for n, c in ended.items()], remain.alias("n_remaining"))


def needs_analysis(status: Column, kind: Column, flagged: Column, duration: Column) -> Column:
    """Available rows that are flagged, and those with sound or pictures in motion whose duration isn't known."""
    return F.coalesce((status == "available") & (F.coalesce(flagged, F.lit(False)) | ((kind != "image") & duration.isNull())), F.lit(False))


def trim_range(start: Column, end: Column, duration: Column, least: float = 0.2) -> Column:
    """A trim's ``start`` and ``end`` inside the media, at least ``least`` seconds apart."""
    limit, gap = F.greatest(duration, F.lit(least)), F.lit(least)
    a = F.least(F.greatest(F.lit(0.0), start), F.greatest(F.lit(0.0), limit - gap))
    b = F.least(F.greatest(a + gap, end), limit)
    short = b - a < gap
    close = F.least(limit, a + gap)
    return F.struct(F.when(short, F.greatest(F.lit(0.0), close - gap)).otherwise(a).alias("start"), F.when(short, close).otherwise(b).alias("end"))
