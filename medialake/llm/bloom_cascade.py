"""URL filters by a Bloom filter cascade, with DataFrame functions only.

A rule is a host and a path prefix with a verdict. A URL's candidate keys are
every suffix of its host at a label boundary, with every prefix of its path that
is as long as some rule's path. The complete key universe is the distinct
candidate keys of the whole table. Each verdict has a cascade over that universe:

* level 0 is a Bloom filter of the verdict's listed keys;
* level 1 is a Bloom filter of the other keys of the universe that level 0 lets
  through, level 2 one of the listed keys that level 1 lets through, and so on,
  until a level lets nothing wrong through.

A key of the universe is listed if the first level that rejects it has an odd
number (or, if none does, the number of levels is odd). That is exact for every
key of the universe, so URLs are judged without a join.

*Sizes.* Level 0 has as many bits a key as it takes to let no more foreign keys
of the universe through than there are listed ones, so all levels together are
of the list's size, whatever the universe's. Levels reach the plan as literals. A
list is dealt by a hash of its keys to shards of some ``SHARD`` keys, each with a
cascade over the universe's keys of that shard, so no literal outgrows a bound;
the plan holds ``TOGETHER`` shards at a time, and what they found is written
before the next. A short list has one shard and nothing is written.

Defined results: a null url, or one without ``://``, has an empty host and path
and so no rule; a repeated row is returned as often; an empty table gives an
empty table; other columns are dropped unless named in ``keep``, where a column
named like an output is left out. A rule's path starts with ``/``; a null rule
does nothing. Where two rules fit, the one with more characters wins, then the
one with the longer host; of equal rules with two verdicts, the verdict that
sorts last.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from medialake.llm.common import ascii_lower, carried, written

BITS_PER_KEY = 12
HASHES = 4
#: Listed keys of a shard on average (at 22 bits a key, 3 MB a level), and shards that are in one plan.
SHARD, TOGETHER = 1_000_000, 4
#: The part of a url before its path.
HOST, PATH = r"^(?s:.*?)://([^/?#]*)", r"^(?s:.*?)://[^/?#]*([^?#]*)"


@dataclass(frozen=True)
class Rule:
    """``text`` is host and path, as in ``example.net/en/``."""

    text: str
    verdict: str

    @property
    def host(self) -> str:
        return self.text.partition("/")[0].lower()

    @property
    def path(self) -> str:
        return "/" + self.text.partition("/")[2]

    @property
    def key(self) -> str:
        return self.host + self.path


def rule_table(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    """(key, path_length, verdict) of a list of rules, as literals."""
    rows = [F.struct(F.lit(r.key).alias("key"), F.lit(len(r.path)).alias("path_length"), F.lit(r.verdict).alias("verdict")) for r in rules]
    return spark.range(1).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def url_host(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, HOST, 1)), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PATH, 1), F.lit(""))


def candidate_keys(host: Column, path: Column, path_lengths: list[int]) -> Column:
    """Host suffixes with path prefixes of the given lengths, as an array of keys; none for an empty host."""
    labels = F.split(host, r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    lengths = F.filter(F.array(*[F.lit(n) for n in sorted(set(path_lengths))]), lambda n: n <= F.char_length(path))
    keys = F.flatten(F.transform(suffixes, lambda s: F.transform(lengths, lambda n: F.concat(s, F.substring(path, F.lit(1), n)))))
    return F.when(host != "", keys).otherwise(F.array().cast("array<string>"))


def shard_of(key: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(-1)), F.lit(shards))


def bits_for(n: int, others: int) -> int:
    """Bits of a filter of ``n`` keys that lets at most some ``n`` of ``others`` through."""
    rate = min(n / max(others, 1), 1.0)
    # HASHES bits a key let (1 - exp(-HASHES * n / bits)) ** HASHES through.
    root = rate ** (1 / HASHES)
    a_key = HASHES / -math.log(1 - root) if root < 1 else 0.0
    return 64 * max(1, math.ceil(n * max(BITS_PER_KEY, a_key) / 64))


def _positions(key: Column, level: int, bits: int) -> list[Column]:
    """The bits of a key: double hashing with two 64-bit hashes."""
    a, b = F.xxhash64(key, F.lit(2 * level)), F.xxhash64(key, F.lit(2 * level + 1))
    return [(F.shiftrightunsigned(a, 24) + F.lit(i) * F.shiftrightunsigned(b, 24)) % F.lit(bits) for i in range(1, HASHES + 1)]


def build_level(keys: DataFrame, level: int, bits: int) -> list[int]:
    """The bitmap of a level as longs."""
    words = keys.select(F.explode(F.array(*_positions(F.col("key"), level, bits))).alias("p")).groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("p") % 64).cast("int"))).alias("v"))
    bitmap = [0] * (bits // 64)
    for row in words.collect():
        bitmap[row["w"]] = row["v"]
    return bitmap


def passes(key: Column, level: int, bitmap: list[int]) -> Column:
    """Whether a level lets a key through."""
    words = F.array(*[F.lit(v).cast("long") for v in bitmap]) if len(bitmap) <= 64 else F.from_json(F.lit("[" + ",".join(map(str, bitmap)) + "]"), "array<bigint>")
    found = F.lit(True)
    for p in _positions(key, level, len(bitmap) * 64):
        found = found & (F.call_function("shiftrightunsigned", F.get(words, F.shiftright(p, 6).cast("int")), (p % 64).cast("int")).bitwiseAND(F.lit(1)) == 1)
    return found


def build_cascade(universe: DataFrame, listed: DataFrame) -> list[list[int]]:
    """The levels over ``universe`` (one column ``key``, distinct, a written table, which is read once) for the ``listed`` keys.

    Only the keys that a level lets through wrongly go on, so each further level
    reads a list of the listed keys' size.
    """
    kept, others = listed.select("key").distinct(), universe.join(listed.select("key"), "key", "left_anti")
    levels: list[list[int]] = []
    n, m = kept.count(), universe.count()
    while n:
        level = len(levels)
        levels.append(build_level(kept, level, bits_for(n, m)))
        through = written(others.where(passes(F.col("key"), level, levels[-1])), "cascade-keys")
        kept, others, n, m = through, kept, through.count(), n
    return levels


def is_listed(key: Column, levels: list[list[int]]) -> Column:
    """Membership of a key of the universe: the parity of the first level that rejects it."""
    out = F.lit(len(levels) % 2 == 1)
    for i in reversed(range(len(levels))):
        out = F.when(~passes(key, i, levels[i]), F.lit(i % 2 == 1)).otherwise(out)
    return out


def judge(pages: DataFrame, rules: list[Rule] | DataFrame, *, url: str = "url", keep: list[str] | None = None, default: str = "allow", shard: int = SHARD) -> DataFrame:
    """``keep`` columns with ``host``, ``path``, ``rule`` and ``verdict``.

    ``rules`` is a list or a table (key, path_length, verdict) of any length; of
    verdicts and of lengths of rules' paths there are few. The verdict of a URL
    that no rule fits is ``default``: its keys aren't listed, which the cascade
    says exactly.
    """
    spark = pages.sparkSession
    kept = carried(keep, ("host", "path", "rule", "verdict"))
    whole = F.struct(*[F.col(c) for c in kept]) if kept else F.lit(None)
    rows = pages.select(whole.alias("_kept"), url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path"))
    out = [F.col("_kept").getField(c).alias(c) for c in kept]
    if not isinstance(rules, DataFrame) and not rules:
        return rows.select(*out, "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    listed = rules if isinstance(rules, DataFrame) else rule_table(spark, rules)
    listed = written(listed.where(F.col("key").isNotNull() & F.col("verdict").isNotNull()).select("key", "path_length", "verdict").distinct(), "url-rules")
    of_verdict = {r["verdict"]: r["n"] for r in listed.groupBy("verdict").agg(F.count("*").alias("n")).collect()}
    lengths = [r[0] for r in listed.select("path_length").distinct().collect()]
    keys = candidate_keys(F.col("host"), F.col("path"), lengths)
    universe = written(rows.select("host", "path").distinct().select(F.explode(keys).alias("key")).distinct(), "url-keys")
    best = F.lit(None).cast("struct<n: int, h: int, key: string, verdict: string>")
    judged, cascades = rows.withColumn("_best", best), []
    for verdict, n in sorted(of_verdict.items()):
        shards = -(-n // shard)
        for i in range(shards):
            inside = [t.where(shard_of(F.col("key"), shards) == i) for t in (universe, listed.where(F.col("verdict") == verdict))]
            cascades.append((verdict, i, shards, build_cascade(*inside)))
    for begin in range(0, len(cascades), TOGETHER):
        if begin:
            judged = written(judged, "url-verdicts")
        found = [F.filter(keys, lambda k: (shard_of(k, shards) == i) & is_listed(k, levels)) for _, i, shards, levels in cascades[begin : begin + TOGETHER]]
        marked = [F.transform(f, lambda k: F.struct(F.char_length(k).alias("n"), F.char_length(F.substring_index(k, "/", 1)).alias("h"), k.alias("key"), F.lit(c[0]).alias("verdict"))) for f, c in zip(found, cascades[begin:])]
        judged = judged.withColumn("_best", F.array_max(F.concat(F.array("_best"), *marked)))
    return judged.select(*out, "host", "path", F.col("_best.key").alias("rule"), F.coalesce("_best.verdict", F.lit(default)).alias("verdict"))


#: The rules of the contract.
CONTRACT_RULES = [Rule("net/", "block"), Rule("example.net/en/", "allow"), Rule("example.com/de/", "block"), Rule("org/fr/", "allow")]


ORACLE_SQL = r"""
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r AS (SELECT * FROM (VALUES ('net', '/', 'net/', 'block'), ('example.net', '/en/', 'example.net/en/', 'allow'), ('example.com', '/de/', 'example.com/de/', 'block'), ('org', '/fr/', 'org/fr/', 'allow')) AS t(rhost, rpath, rule, verdict)),
m AS (SELECT page_id, rule, verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(rule) DESC) AS k
      FROM h JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT h.page_id, h.host, h.path, m.rule, coalesce(m.verdict, 'allow') AS verdict FROM h LEFT JOIN m ON h.page_id = m.page_id AND m.k = 1
"""
