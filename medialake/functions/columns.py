"""Column expressions: text, paths, geography, capture clocks, fingerprints and JSON. All run in the JVM."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0
#: Extensions by kind.
VIDEO = ["mov", "mp4", "m4v", "avi", "mkv", "mxf", "webm", "mpg", "mpeg"]
IMAGE = ["heic", "heif", "hif", "jpg", "jpeg", "png", "webp", "gif", "tif", "tiff", "avif", "arw", "dng", "cr2", "cr3", "nef", "raf", "raw"]
AUDIO = ["mp3", "m4a", "aac", "wav"]


# -- text ---------------------------------------------------------------------------------------------------------------
def tokenize(query: Column) -> Column:
    """Lower-cased search tokens; commas separate like white space."""
    return F.filter(F.split(F.lower(F.translate(query, ",，", "  ")), r"\s+"), lambda t: t != "")


def stock_keyword(s: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(F.replace(s, F.lit("#"), F.lit("")), r"\s+", " ")))


def keyword_valid(s: Column) -> Column:
    """3 to 40 characters, one to five words of ASCII letters, digits and hyphens."""
    return F.char_length(s).between(3, 40) & s.rlike("^[a-z0-9-]+( [a-z0-9-]+){0,4}$")


def count_keyword_words(text: Column) -> Column:
    """How many words of a text (between spaces, tabs and line ends) are valid keywords by themselves: one pass, without an array of words."""
    return F.regexp_count(F.lower(text), F.lit(r"(?<![^\x20\x09-\x0D])[a-z0-9-]{3,40}+(?![^\x20\x09-\x0D])"))


def needs_companion(s: Column) -> Column:
    return s.rlike(r"[\p{L}&&[^\x00-\x7F]]")


def contains_han(s: Column) -> Column:
    return s.rlike(r"[\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}]")


def fold(s: Column) -> Column:
    """Lower case without white space and ``-_./``."""
    return F.regexp_replace(F.lower(s), r"[\s\-_./]", "")


def split_custom_tags(s: Column) -> Column:
    return F.filter(F.transform(F.split(s, "[,，；;]"), lambda t: F.trim(t)), lambda t: t != "")


def geocode_parts(s: Column) -> Column:
    """The parts of a place name; none of a null."""
    return F.coalesce(split_custom_tags(s), F.array().cast("array<string>"))


def clip_filename(name: Column, fallback: Column) -> Column:
    """A file name without separators, ``fallback`` if blank, with an extension."""
    safe = F.coalesce(F.nullif(F.translate(F.trim(name), "/:\\", "---"), F.lit("")), fallback)
    return F.when(safe.rlike(r"[^.].*\.[^. ]+$"), safe).otherwise(F.concat(safe, F.lit(".mp4")))


def default_clip_name(name: Column) -> Column:
    return F.concat(F.coalesce(F.nullif(F.regexp_replace(name, r"(?<=.)\.[^.]*$", ""), F.lit("")), F.lit("clip")), F.lit("_cut.mp4"))


def escape_posix(path: Column) -> Column:
    """A path with a backslash before what a shell would read otherwise."""
    return F.regexp_replace(path, r"([ \\'\"()\[\]{}*?$`!#&|;<>\t\n])", r"\\$1")


def offset_summary(parts: dict[str, Column], zero: str) -> Column:
    """The parts that aren't 0, each with its sign and unit; ``zero`` if all are."""
    said = [F.when(v > 0, F.concat(F.lit("+"), v, F.lit(f" {unit}"))).when(v < 0, F.concat(v, F.lit(f" {unit}"))) for unit, v in parts.items()]
    return F.coalesce(F.nullif(F.concat_ws(" ", *said), F.lit("")), F.lit(zero))


def natural_key(s: Column) -> Column:
    """A sort key for which a2 comes before a10."""
    return F.array_join(F.transform(F.regexp_extract_all(F.lower(s), F.lit(r"(\d+|\D+)"), F.lit(1)), lambda p: F.when(p.rlike(r"^\d"), F.lpad(p, 20, "0")).otherwise(p)), "")


def longest_matches(s: Column, words: Sequence[str]) -> Column:
    """Greedy left-to-right matches of a bounded word list, the longest first at each place."""
    escaped = sorted(words, key=lambda w: (-len(w), w))
    return F.regexp_extract_all(s, F.lit("(" + "|".join("\\Q" + w + "\\E" for w in escaped) + ")"), F.lit(1))


# -- paths --------------------------------------------------------------------------------------------------------------
def filename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def directory(path: Column) -> Column:
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def normalize_path(path: Column) -> Column:
    return F.array_join(F.filter(F.split(path, "/"), lambda x: (x != "") & (x != ".")), "/")


def ancestors(path: Column) -> Column:
    """All folders from the root down to ``path``; none for the empty path."""
    parts = F.split(path, "/")
    return F.when(path == "", F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/")))


def in_folder(directory_: Column, scope: Column) -> Column:
    """Component-wise: ``a/b`` is in ``a``, ``ab`` isn't; everything is in the empty scope."""
    return (scope == "") | (directory_ == scope) | directory_.startswith(F.concat(scope, F.lit("/")))


def media_kind(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return F.when(ext.isin(IMAGE), "image").when(ext.isin(AUDIO), "audio").otherwise("video")


def safe_folder(path: Column) -> Column:
    return ~F.exists(F.split(path, "/"), lambda x: x.startswith("."))


# -- geography ----------------------------------------------------------------------------------------------------------
def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres on the sphere."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * EARTH_M) * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def cubes(lat: Column, lon: Column, wide: float) -> list[Column]:
    """The cube of ``wide`` metres that holds a place on the sphere: three whole numbers. Places within ``wide`` lie in neighbouring cubes, without poles or a date line."""
    a, b = F.radians(lat), F.radians(lon)
    return [F.floor(p * (EARTH_M / wide)).cast("long") for p in (F.cos(a) * F.cos(b), F.cos(a) * F.sin(b), F.sin(a))]


def usable_gps(lat: Column, lon: Column) -> Column:
    finite = ~F.isnan(lat) & ~F.isnan(lon) & lat.between(-90, 90) & lon.between(-180, 180)
    return F.coalesce(finite & ((F.abs(lat) > 1e-4) | (F.abs(lon) > 1e-4)), F.lit(False))


def plausible_hop(metres: Column, seconds: Column) -> Column:
    """At most 300 m/s; short gaps allow 2 km; a missing time is plausible."""
    return F.when(F.isnan(metres), False).when(metres < 1, True).when(seconds.isNull(), True).when(seconds <= 0.75, metres <= 2000).otherwise(metres / seconds <= 300)


def great_circle(lat1: Column, lon1: Column, lat2: Column, lon2: Column, n: int = 24) -> Column:
    """``n`` points from end to end along the great circle."""
    d = haversine(lat1, lon1, lat2, lon2) / EARTH_M

    def at(i: Column) -> Column:
        f = i / F.lit(n - 1)
        a, b = F.sin((1 - f) * d) / F.sin(d), F.sin(f * d) / F.sin(d)
        x = a * F.cos(F.radians(lat1)) * F.cos(F.radians(lon1)) + b * F.cos(F.radians(lat2)) * F.cos(F.radians(lon2))
        y = a * F.cos(F.radians(lat1)) * F.sin(F.radians(lon1)) + b * F.cos(F.radians(lat2)) * F.sin(F.radians(lon2))
        z = a * F.sin(F.radians(lat1)) + b * F.sin(F.radians(lat2))
        same = d < 1e-12
        return F.struct(F.when(same, lat1).otherwise(F.degrees(F.atan2(z, F.sqrt(x * x + y * y)))).alias("latitude"), F.when(same, lon1).otherwise(F.degrees(F.atan2(y, x))).alias("longitude"))

    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), at)


# -- capture clocks -----------------------------------------------------------------------------------------------------
def dji_clock(name: Column) -> Column:
    """The clock in names like DJI_20260919143022_0029_D.MP4; null if it isn't a date."""
    return F.try_to_timestamp(F.nullif(F.regexp_extract(name, r"DJI_(\d{14})", 1), F.lit("")), F.lit("yyyyMMddHHmmss"))


def exif_clock(clock: Column) -> Column:
    return F.try_to_timestamp(clock, F.lit("yyyy:MM:dd HH:mm:ss"))


def metadata_clock(text: Column, formats: Sequence[str] = ("yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy:MM:dd HH:mm:ss")) -> Column:
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats])


def _clock(at: Column, local: Column, zone: Column) -> Column:
    return F.struct(at.cast("timestamp").alias("at"), local.alias("local"), zone.alias("has_zone"))


def exif_capture(raw: Column, offset: Column) -> Column:
    """Struct at, local, has_zone of an EXIF clock (2024:05:01 10:20:30) and its offset (+08:00 or Z, or null); null if it isn't one.

    Days and hours beyond their month or day run on into the next. An offset of another form counts as UTC.
    """
    pattern = r"^\s*(\d+):(\d+):(\d+) +(\d+):(\d+)(?::([^:]*))?(?::.*)?\s*$"
    part = lambda i: F.regexp_extract(raw, pattern, i).try_cast("int")
    second = F.coalesce(F.regexp_extract(raw, pattern, 6).try_cast("double").cast("int"), F.lit(0))
    utc = F.make_timestamp(part(1), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0), F.lit("UTC")) + F.make_interval(F.lit(0), part(2) - 1, F.lit(0), part(3) - 1, part(4), part(5), second.cast("decimal(18,6)"))
    local = F.format_string("%04d-%02d-%02dT%02d:%02d:%02d", part(1), part(2), part(3), part(4), part(5), second)
    sane = part(2).between(1, 12) & (part(3) >= 1) & (part(3) <= F.day(F.last_day(F.make_date(part(1), F.greatest(F.least(part(2), F.lit(12)), F.lit(1)), F.lit(1))))) & (part(4) <= 23) & (part(5) <= 59) & (second <= 59)
    given = F.trim(offset)
    compact = F.replace(given, F.lit(":"), F.lit(""))
    hours, minutes = F.substring(compact, 2, 2).try_cast("int"), F.substring(compact, 4, 2).try_cast("int")
    shift = F.when(compact.startswith("-"), -1).otherwise(1) * (hours * 3600 + minutes * 60)
    formed = compact.rlike(r"^[+-].{4}$")
    moved = F.timestamp_micros(F.unix_micros(utc) - shift.cast("long") * 1_000_000)
    zone = F.when(given.isNull(), False).when(F.lower(given) == "z", sane).when(formed, sane & compact.rlike(r"^[+-]\d{4}$")).otherwise(True)
    at = F.when(zone & formed, moved).otherwise(utc)
    return F.when(F.coalesce(raw.rlike(pattern), F.lit(False)) & part(1).between(1, 9999), _clock(at, local, F.coalesce(zone, F.lit(False))))


def metadata_capture(text: Column) -> Column:
    """Struct at, local, has_zone of a container's creation date: with its zone, or civil as it stands; null if it isn't one."""
    t = F.trim(text)
    zoned = F.coalesce(*[F.try_to_timestamp(t, F.lit(f"yyyy-MM-dd'T'HH:mm:ss{f}{z}")) for f in ("", ".S", ".SSS", ".SSSSSS") for z in ("XXX", "XX")])
    civil = F.coalesce(*[F.try_to_timestamp(t, F.lit(f)) for f in ("yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss")])
    return F.when(zoned.isNotNull(), _clock(zoned, F.lit(None).cast("string"), F.lit(True))).when(civil.isNotNull(), _clock(civil, F.replace(t, F.lit(" "), F.lit("T")), F.lit(False)))


def matroska_codec(header: Column) -> Column:
    """The video codec that a Matroska file's first bytes name: av1, vp9, vp8 or other."""
    names = F.when(F.lit(False), "")
    for name in ("AV1", "VP9", "VP8"):
        names = names.when(F.contains(header, F.lit(f"V_{name}".encode())), name.lower())
    return names.otherwise("other")


def encode_progress(line: Column) -> Column:
    """Struct duration, encoded: the seconds that an encoder's line tells of, each null if it doesn't."""

    def seconds(mark: str) -> Column:
        clock = F.regexp_extract(line, mark + r"([0-9.]+):([0-9.]+):([0-9.]+)(?![0-9:.])", 0)
        part = lambda i: F.regexp_extract(line, mark + r"([0-9.]+):([0-9.]+):([0-9.]+)(?![0-9:.])", i).try_cast("double")
        return F.when(clock != "", part(1) * 3600 + part(2) * 60 + part(3))

    return F.struct(seconds("Duration: ").alias("duration"), seconds("time=").alias("encoded"))


def iso6709(text: Column) -> Column:
    """Latitude, longitude and altitude of +35.6895+139.6917+040.0/."""
    number = r"([+-]\d+(?:\.\d+)?)"
    part = lambda i: F.regexp_extract(text, f"^{number}{number}{number}?", i).try_cast("double")
    return F.when(text.rlike(f"^{number}{number}"), F.struct(part(1).alias("latitude"), part(2).alias("longitude"), part(3).alias("altitude")))


def offset_apply(ts: Column, years: Column, days: Column, hours: Column, minutes: Column, seconds: Column) -> Column:
    return ts + F.make_interval(years, F.lit(0), F.lit(0), days, hours, minutes, seconds)


def plausible_capture(ts: Column, today: Column, year: Column | None = None) -> Column:
    """From 2015 (``year`` is that of the civil clock, if known) to tomorrow."""
    own = F.year(ts) if year is None else F.coalesce(year, F.year(ts))
    return (own >= 2015) & (F.to_date(ts) <= F.date_add(today, 1))


# -- fingerprints -------------------------------------------------------------------------------------------------------
def mean_hash(pixels: Column) -> Column:
    """A bit for each pixel: whether it's at least the mean."""
    d = F.transform(pixels, lambda x: x.cast("double"))
    mean = F.aggregate(d, F.lit(0.0), lambda a, x: a + x) / F.size(d)
    return F.array_join(F.transform(d, lambda x: F.when(x >= mean, "1").otherwise("0")), "")


def bit_code(bits: Column) -> Column:
    """A string of at most 64 bits as a BIGINT."""
    return F.conv(bits, 2, -10).cast("long")


def hamming(a: Column, b: Column) -> Column:
    """Differing characters, up to the shorter string's end."""
    n = F.least(F.char_length(a), F.char_length(b))
    differ = F.zip_with(F.split(F.substring(a, F.lit(1), n), ""), F.split(F.substring(b, F.lit(1), n), ""), lambda x, y: F.when(x == y, 0).otherwise(1))
    return F.when(n == 0, 0).otherwise(F.aggregate(differ, F.lit(0), lambda s, x: s + x))


# -- tags and JSON ------------------------------------------------------------------------------------------------------
def source_rank(source: Column) -> Column:
    return F.when(source == "user", 0).when(source == "path", 1).when(source == "ai", 2).otherwise(3)


def localized(names: Column, locale: str, fallback: Column) -> Column:
    return F.coalesce(F.try_element_at(names, F.lit(locale)), F.try_element_at(names, F.lit("en")), fallback)


def tolerant_json(text: Column, schema: str) -> Column:
    """The outermost object of a model's answer, with or without a fence; null if there is none."""
    return F.from_json(F.nullif(F.regexp_extract(text, r"(?s)(\{.*\})", 1), F.lit("")), schema)


def even_pick(items: Column, k: int) -> Column:
    """``k`` evenly spaced items, places rounded half to even."""
    n = F.size(items)
    step = (n - 1) / F.lit(max(1, k - 1))
    places = F.when(n <= k, F.sequence(F.lit(0), n - 1)).otherwise(F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.bround(i * step).cast("int")))
    return F.when(n == 0, items).otherwise(F.transform(places, lambda i: F.get(items, i)))


def any_column(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


# -- facts of a media row -------------------------------------------------------------------------------------------------
def is_misplaced_gps(lat: Column, lon: Column, source: Column) -> Column:
    """A guessed position, or any part of one that isn't usable."""
    any_part = lat.isNotNull() | lon.isNotNull() | source.isNotNull()
    return F.coalesce(source == "itinerary", F.lit(False)) | (any_part & ~usable_gps(lat, lon))


def gps_source(lat: Column, lon: Column, source: Column) -> Column:
    return F.when(usable_gps(lat, lon), F.coalesce(source, F.lit("header")))


def reliable_anchor(lat: Column, lon: Column, source: Column) -> Column:
    return F.coalesce(gps_source(lat, lon, source).isin("header", "user"), F.lit(False))


def may_write_gps(lat: Column, lon: Column, source: Column) -> Column:
    return ~usable_gps(lat, lon) | F.coalesce(source == "gpx", F.lit(False))


def signed_coordinate(value: Column, hemisphere: Column) -> Column:
    return F.when(F.upper(hemisphere).isin("S", "W"), -F.abs(value)).otherwise(F.abs(value))


def ai_taggable(status: Column, kind: Column, size: Column) -> Column:
    """Available images, and videos of 8 KiB or more."""
    return F.coalesce((status == "available") & ((kind == "image") | ((kind == "video") & (size >= 8192))), F.lit(False))


def display_size(width: Column, height: Column, orientation: Column) -> Column:
    turned = F.coalesce(orientation.between(5, 8), F.lit(False))
    return F.struct(F.when(turned, height).otherwise(width).alias("width"), F.when(turned, width).otherwise(height).alias("height"))


def clamped_aspect(width: Column, height: Column) -> Column:
    return F.least(F.greatest(width / height, F.lit(0.55)), F.lit(2.35))


def scan_progress(done: Column, total: Column, scanning: Column) -> Column:
    """Null while the total is unknown; below 1 until the scan has ended."""
    share = done.cast("double") / total
    return F.when(scanning & (F.coalesce(total, F.lit(0)) <= 0), None).when(scanning, F.least(share, F.lit(0.99))).when(F.coalesce(total, F.lit(0)) <= 0, 1.0).otherwise(F.least(share, F.lit(1.0)))


def relative_path(path: Column, root: Column) -> Column:
    """The part below the root; null outside of it or in a folder whose name begins with a dot."""
    rest = F.substring(path, F.char_length(root) + 2, F.char_length(path))
    return F.when(path.startswith(F.concat(root, F.lit("/"))) & safe_folder(rest), rest)


def distinct_label(parts: Sequence[Column]) -> Column:
    """Parts of a place's name in order, without blanks and repeats of any case."""
    there = F.filter(F.transform(F.array(*parts), lambda p: F.trim(F.coalesce(p, F.lit("")))), lambda p: p != "")
    return F.array_join(F.aggregate(there, F.array().cast("array<string>"), lambda out, p: F.when(F.exists(out, lambda o: F.lower(o) == F.lower(p)), out).otherwise(F.concat(out, F.array(p)))), ", ")


def hop_kind(shares_land: Column, metres: Column) -> Column:
    return F.when(~shares_land & (metres >= 50_000), "sea").otherwise("land")


def visible_custom_label(s: Column) -> Column:
    return F.char_length(s).between(2, 16) & ~s.rlike(r"[\r\n]") & needs_companion(s)


def kind_order(kind: Column) -> Column:
    return F.when(kind == "video", 0).when(kind == "image", 1).otherwise(2)


# -- what is shown of a row -------------------------------------------------------------------------------------------------
def is_trimmed_clip(parent_id: Column) -> Column:
    return parent_id.isNotNull()


def _civil(local: Column, has_zone: Column) -> Column:
    return F.when(~F.coalesce(has_zone, F.lit(False)) & (local != ""), local)


def model_time(at: Column, local: Column, has_zone: Column) -> Column:
    """A capture time as a model is told: the civil clock where there's no zone, else UTC."""
    return F.coalesce(_civil(local, has_zone), F.date_format(F.to_utc_timestamp(at, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'"))


def inspector_time(at: Column, local: Column, has_zone: Column) -> Column:
    """A capture time as a user sees it: the civil clock where there's no zone, else that of the session's zone."""
    return F.coalesce(F.replace(_civil(local, has_zone), F.lit("T"), F.lit(" ")), F.date_format(at, "yyyy-MM-dd HH:mm:ss"))


def app_locale(raw: Column) -> Column:
    """zh-Hant for any Chinese, else en."""
    return F.when(F.lower(raw).startswith("zh"), "zh-Hant").otherwise("en")


# Models that are no longer offered, and what takes their place.
RETIRED_MODELS = {
    "gemini-2.5-flash-lite": "gemini-3.5-flash-lite",
    "gemini-2.0-flash-lite": "gemini-3.5-flash-lite",
    "gemini-2.0-flash": "gemini-3.5-flash",
    "gemini-2.5-flash": "gemini-3.5-flash",
    "gemini-2.5-pro": "gemini-3.8-flash",
}


def canonical_model(stored: Column, default: Column, retired: dict[str, str] = RETIRED_MODELS) -> Column:
    """The model that a stored name stands for; the default for a blank one."""
    name = F.coalesce(F.nullif(F.trim(stored), F.lit("")), default)
    known = F.create_map(*[F.lit(x) for pair in retired.items() for x in pair])
    return F.coalesce(F.try_element_at(known, name), name)


def custom_tags(raw: Column) -> Column:
    """Array of (category, value, source) of a user's text of custom tags."""
    return F.transform(split_custom_tags(raw), lambda v: F.struct(F.lit("custom").alias("category"), v.alias("value"), F.lit("user").alias("source")))


def reached_out_point(current: Column, end: Column) -> Column:
    return current >= end - 0.001


def loop_playhead(current: Column, start: Column, end: Column) -> Column:
    """The in point, if playback has left the range, else null."""
    lower, upper = F.least(start, end), F.greatest(start, end)
    return F.when((current < lower - 0.02) | reached_out_point(current, upper), lower)


def uri_list(paths: Column) -> Column:
    """An array of paths as file URIs, each on a line of its own."""
    encoded = lambda p: F.replace(F.replace(F.url_encode(p), F.lit("+"), F.lit("%20")), F.lit("%2F"), F.lit("/"))
    return F.concat(F.array_join(F.transform(paths, lambda p: F.concat(F.lit("file://"), encoded(p))), "\r\n"), F.lit("\r\n"))


def tone_flags(pixels: Column) -> Column:
    """Struct bw, vivid, warm, cool, dark of an array of pixels (r, g, b from 0 to 1)."""
    sums = F.aggregate(
        pixels, F.struct(*[F.lit(0.0).alias(c) for c in ("r", "g", "b", "s")]),
        lambda a, p: F.struct(
            (a["r"] + p["r"]).alias("r"), (a["g"] + p["g"]).alias("g"), (a["b"] + p["b"]).alias("b"),
            (a["s"] + F.when(F.greatest(p["r"], p["g"], p["b"]) > 0, 1 - F.least(p["r"], p["g"], p["b"]) / F.greatest(p["r"], p["g"], p["b"])).otherwise(0.0)).alias("s"),
        ),
    )
    mean = {c: sums[c] / F.size(pixels) for c in ("r", "g", "b", "s")}
    flags = {
        "bw": mean["s"] < 0.08, "vivid": mean["s"] > 0.40, "warm": (mean["r"] > mean["b"] + 0.08) & (mean["r"] > 0.25), "cool": (mean["b"] > mean["r"] + 0.08) & (mean["b"] > 0.25),
        "dark": (mean["r"] + mean["g"] + mean["b"]) / 3 < 0.15,
    }
    return F.when(F.size(pixels) > 0, F.struct(*[v.alias(k) for k, v in flags.items()]))
