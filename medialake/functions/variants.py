"""Records of any shape, as VARIANT: a model's answers and side files."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from medialake.functions import columns as C


def _trimmed(s: Column) -> Column:
    return F.regexp_replace(s, r"^\s+|\s+$", "")


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def bound(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, wherever the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def is_string(v: Column) -> Column:
    return F.coalesce(_kind(v) == "STRING", F.lit(False))


def is_object(v: Column) -> Column:
    return F.coalesce(_kind(v).startswith("OBJECT"), F.lit(False))


def is_array(v: Column) -> Column:
    return F.coalesce(_kind(v).startswith("ARRAY"), F.lit(False))


def field(v: Column, name: str) -> Column:
    """A field of an object as VARIANT; null if ``v`` isn't one or has none."""
    return F.try_variant_get(v, f"$.{name}", "variant")


def text_of(v: Column, name: str) -> Column:
    """A field that is a string, trimmed; empty if it's absent or anything else."""
    return F.when(is_string(field(v, name)), _trimmed(F.try_variant_get(v, f"$.{name}", "string"))).otherwise("")


def items_of(v: Column) -> Column:
    """The items of an array, as VARIANT; null if it isn't one."""
    return F.when(is_array(v), F.try_variant_get(v, "$", "array<variant>"))


def answer(text: Column) -> Column:
    """The object or array that a model's answer holds, as VARIANT: bare or in a fence, else the outermost braces; null if there is none."""
    def bare(trimmed: Column) -> Column:
        inner = lambda t: F.when(F.lower(t).startswith("json"), _trimmed(F.substring(t, F.lit(5), F.char_length(t)))).otherwise(t)
        return F.when(trimmed.startswith("```"), bound(F.btrim(trimmed, F.lit("`")), inner)).otherwise(trimmed)

    parsed = lambda s: F.try_parse_json(F.nullif(s, F.lit("")))
    shaped = lambda s: bound(parsed(s), lambda v: F.when(is_object(v) | is_array(v), v))
    return bound(bound(_trimmed(text), bare), lambda s: F.coalesce(shaped(s), shaped(F.regexp_extract(s, r"(?s)\{.*\}", 0))))


def answer_tags(v: Column) -> Column:
    """Array of (category, value) of an :func:`answer`: its items, or those of its ``tags``, that have both as texts; once each."""
    items = F.when(is_object(v), items_of(field(v, "tags"))).otherwise(items_of(v))
    pairs = F.filter(F.transform(items, lambda x: F.struct(text_of(x, "category").alias("category"), text_of(x, "value").alias("value"))), lambda t: (t["category"] != "") & (t["value"] != ""))
    return F.coalesce(first_of(pairs, lambda t: F.concat(t["category"], F.lit("/"), t["value"])), F.array().cast("array<struct<category: string, value: string>>"))


def first_of(items: Column, key) -> Column:
    """The first item of each key."""
    chosen = lambda xs, keys: F.filter(xs, lambda x, i: F.array_position(keys, F.get(keys, i)) == i + 1)
    return bound(items, lambda xs: bound(F.transform(xs, key), lambda keys: chosen(xs, keys)))


def answer_keywords(v: Column, most: int = 20) -> Column:
    """The fit ``keywords`` of an :func:`answer` in their stock form, once each: texts, or objects with a ``value`` or else a ``keyword``."""
    items = F.when(is_object(v), items_of(field(v, "keywords")))
    raw = F.transform(items, lambda x: F.when(is_string(x), F.try_variant_get(x, "$", "string")).when(is_object(x), F.coalesce(F.nullif(text_of(x, "value"), F.lit("")), text_of(x, "keyword"))))
    stock = F.transform(raw, lambda s: C.stock_keyword(s))
    fit = F.filter(stock, lambda s: F.coalesce(C.keyword_valid(s), F.lit(False)))
    return F.coalesce(F.slice(F.array_distinct(fit), 1, most), F.array().cast("array<string>"))


#: A run of strings and of characters that are neither quotes, commas nor colons: what may stand before a separator.
_BEFORE = r'\G((?:"(?:[^"\\]|\\.)*+"|[^",:])*+)'


def compact_json(v: Column) -> Column:
    """A VARIANT of any nesting on one line: keys in order, ``", "`` and ``": "`` between, slashes escaped, whole numbers without a fraction.

    Numbers that JSON wrote with an exponent stay as Spark writes doubles.
    """
    plain = F.replace(F.to_json(v), F.lit("/"), F.lit("\\/"))
    spaced = F.regexp_replace(plain, F.lit(_BEFORE + "([,:])"), F.lit("$1$2 "))
    return F.regexp_replace(spaced, F.lit(r'("(?:[^"\\]|\\.)*+")|(?<![0-9.])(-?[0-9]++)\.0++(?![0-9eE])'), F.lit("$1$2"))


# -- captures as they're stored -------------------------------------------------------------------------------------------
_NUMBERS = {"captured_s": "capturedAt", "latitude": "latitude", "longitude": "longitude", "altitude": "altitude"}
_TEXTS = {"captured_local": "capturedAtLocal", "captured_source": "capturedAtSource", "gps_source": "gpsSource"}


def capture_json(capture: Column) -> Column:
    """A capture (struct captured_s, captured_local, has_zone, captured_source, latitude, longitude, altitude, gps_source) as JSON; absent parts are left out, as is a position that can't be.

    Null if nothing is left.
    """
    usable = C.usable_gps(capture["latitude"], capture["longitude"])
    places = ("latitude", "longitude", "altitude", "gps_source")
    value = lambda c: F.when(usable, capture[c]) if c in places else F.nullif(capture[c], F.lit("")) if c in _TEXTS else capture[c]
    fields = {name: value(c) for c, name in (_NUMBERS | _TEXTS).items()} | {"capturedAtHasTimeZone": F.when(capture["has_zone"], True)}
    return F.nullif(F.to_json(F.struct(*[v.alias(n) for n, v in fields.items()])), F.lit("{}"))


def stored_capture(text: Column) -> Column:
    """The capture that :func:`capture_json` wrote, or anything like it: parts of another kind are null; a position without a source comes from the header."""
    v = F.try_parse_json(text)
    number = lambda n: F.when(_kind(field(v, n)).rlike("^(BIGINT|DOUBLE|DECIMAL)"), F.try_variant_get(v, f"$.{n}", "double"))
    word = lambda n: F.when(is_string(field(v, n)), F.try_variant_get(v, f"$.{n}", "string"))
    parts = {c: number(n) for c, n in _NUMBERS.items()} | {c: word(n) for c, n in _TEXTS.items()}
    zone = F.coalesce(F.try_variant_get(v, "$.capturedAtHasTimeZone", "boolean"), F.lit(False))
    source = F.coalesce(parts["gps_source"], F.when(C.usable_gps(parts["latitude"], parts["longitude"]), "header"))
    named = parts | {"has_zone": zone, "gps_source": source}
    order = ("captured_s", "captured_local", "has_zone", "captured_source", "latitude", "longitude", "altitude", "gps_source")
    return F.struct(*[named[c].alias(c) for c in order])
