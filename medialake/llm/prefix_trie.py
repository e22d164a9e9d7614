"""Trie of conversation prefixes, rolled up by pointer jumping.

A node is a distinct sequence of first turns; its key is the depth with two
64-bit digests, each the XOR of hashes of (place, turn) over the prefix, so a
prefix's digest is a running XOR and its parent's is the same without the last
turn. Rows are keyed by digests throughout; no text leaves the first step.

*Rollup.* Each node points to its parent and holds its own leaf count and
saving. In round k a node adds what the nodes that point to it hold (all those
2^k below it, each with everything less than 2^k below itself), and its pointer
moves on to its target's target. After the logarithm of the depth in rounds
every node holds its whole subtree. Sums are combined before the shuffle; only
nodes that have a further ancestor take part in the join of pointers, a plain
inner join that AQE splits where one ancestor is the target of many.

*Long conversations.* Turns are numbered by a two-level scan: rows are dealt by
ranges of (conversation, turn), numbered within a range, and what earlier ranges
of the same conversation hold is added. Running digests are made in blocks of
``BLOCK`` places and the blocks before are added. So no conversation is one task's work.

*Ends.* The ids that end in a node are joined in chunks of ``CHUNK`` consecutive
ids, which are bounded, and the chunks are fed in order to SHA-256, which is
sequential by its definition; memory is one chunk.

Defined results: null role or text is empty; turns of equal number go by role,
then text, and repeated rows are turns of their own; rows without ``conv_id`` are
left out; an empty table gives no node; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from medialake.llm.common import crc32_mod, written

BLOCK = 256
CHUNK = 4096
KEY = ["d", "x1", "x2"]


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, pos`` (from 1), ``turn_digest`` and ``chars`` of every turn."""
    rows = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long"), "turn", *[F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")])
    digest = F.sha2(F.concat(F.char_length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    dealt = written(rows.repartitionByRange("conv_id", *order, F.monotonically_increasing_id()).withColumn("range", F.spark_partition_id()), "turns")
    within = dealt.select("range", "conv_id", F.row_number().over(Window.partitionBy("range", "conv_id").orderBy(*order)).alias("pos"), digest.alias("turn_digest"), F.char_length("text").alias("chars"))
    before = Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    # A range goes on with one conversation at most, so this has at most a row for each range.
    carried = dealt.groupBy("conv_id", "range").agg(F.count("*").alias("n")).withColumn("before", F.sum("n").over(before)).where(F.col("before") > 0).select("range", "conv_id", "before")
    return within.join(F.broadcast(carried), ["range", "conv_id"], "left").select("conv_id", (F.col("pos") + F.coalesce("before", F.lit(0))).cast("long").alias("pos"), "turn_digest", F.col("chars").cast("long"))


def branched(turns: DataFrame, every: int = 100, heads: int = 6) -> DataFrame:
    """``conv_id, d, turn_digest, chars, length`` of rebuilt conversations, with a row of depth 0 for each.

    Conversation c begins with the first h turns of conversation c - c % ``every``, h being crc32 of c's digits modulo ``heads``,
    and goes on with its own turns after its first h. ``turns`` is a written table.
    """
    h = crc32_mod("conv_id", heads)
    own_length = turns.groupBy("conv_id").agg(F.max("pos").alias("n"))
    turn = F.struct("pos", "turn_digest", "chars")
    first = turns.where((F.col("pos") < heads) & (F.col("conv_id") % every == 0)).groupBy(F.col("conv_id").alias("base")).agg(F.array_sort(F.collect_list(turn)).alias("head"))
    shaped = own_length.withColumn("h", h).withColumn("base", F.col("conv_id") - F.col("conv_id") % every).join(first, "base", "left")
    shaped = shaped.withColumn("head", F.when(F.col("h") > 0, F.slice(F.coalesce("head", F.expr("array()").cast(first.schema["head"].dataType)), 1, F.greatest(F.col("h"), F.lit(1)).cast("int"))))
    shaped = shaped.withColumn("m", F.coalesce(F.size("head"), F.lit(0)).cast("long")).withColumn("m", F.greatest("m", F.lit(0).cast("long")))
    shaped = written(shaped.select("conv_id", "h", "m", "head", (F.col("m") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")), "branches")
    none = F.lit(None).cast("string")
    roots = shaped.select("conv_id", F.lit(0).cast("long").alias("d"), none.alias("turn_digest"), F.lit(0).cast("long").alias("chars"), "length")
    taken = shaped.select("conv_id", F.explode("head").alias("x"), "length").select("conv_id", F.col("x.pos").alias("d"), F.col("x.turn_digest"), F.col("x.chars"), "length")
    own = turns.where(F.col("pos") > h).join(shaped.select("conv_id", "h", "m", "length"), "conv_id").select("conv_id", (F.col("m") + F.col("pos") - F.col("h")).alias("d"), "turn_digest", "chars", "length")
    return roots.unionByName(taken).unionByName(own)


def whole(turns: DataFrame) -> DataFrame:
    """As :func:`branched`, of conversations as they are."""
    length = turns.groupBy("conv_id").agg(F.max("pos").alias("length"))
    roots = length.select("conv_id", F.lit(0).cast("long").alias("d"), F.lit(None).cast("string").alias("turn_digest"), F.lit(0).cast("long").alias("chars"), "length")
    return roots.unionByName(turns.withColumnRenamed("pos", "d").join(length, "conv_id").select("conv_id", "d", "turn_digest", "chars", "length"))


def _prefixes(rebuilt: DataFrame) -> DataFrame:
    """Each conversation's prefixes: ``conv_id``, the key ``d, x1, x2``, the parent's ``p1, p2``, ``chars`` of the last turn, whether it ``ends`` there."""

    def hashed(salt: int) -> Column:
        return F.when(F.col("d") > 0, F.xxhash64(F.lit(salt), "turn_digest", "d")).otherwise(F.lit(0).cast("long"))

    rows = rebuilt.select("conv_id", "d", F.floor(F.col("d") / BLOCK).alias("block"), hashed(1).alias("v1"), hashed(2).alias("v2"), "chars", (F.col("d") == F.col("length")).alias("ends"))
    rows = written(rows, "prefix-turns")
    running = Window.partitionBy("conv_id", "block").orderBy("d").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = rows.select("*", *[F.bit_xor(f"v{i}").over(running).alias(f"l{i}") for i in (1, 2)])
    long_ones = rows.where(F.col("block") > 0).select("conv_id").distinct()
    blocks = rows.join(long_ones, "conv_id", "left_semi").groupBy("conv_id", "block").agg(*[F.bit_xor(f"v{i}").alias(f"t{i}") for i in (1, 2)])
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.select("conv_id", "block", *[F.bit_xor(f"t{i}").over(earlier).alias(f"c{i}") for i in (1, 2)]).where(F.col("block") > 0)
    joined = local.join(carried, ["conv_id", "block"], "left")
    x = {i: F.col(f"l{i}").bitwiseXOR(F.coalesce(f"c{i}", F.lit(0).cast("long"))) for i in (1, 2)}
    return joined.select("conv_id", "d", *[x[i].alias(f"x{i}") for i in (1, 2)], *[x[i].bitwiseXOR(F.col(f"v{i}")).alias(f"p{i}") for i in (1, 2)], "chars", "ends")


def _end_digests(ends: DataFrame) -> DataFrame:
    """(key, ends_sha256) of (key, conv_id): the SHA-256 of the ids in order, joined by commas."""
    chunk = F.floor(F.col("conv_id") / CHUNK)
    chunks = ends.groupBy(*KEY, chunk.alias("chunk")).agg(F.concat_ws(",", F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string"))).alias("ids"))
    rows = chunks.repartition(*KEY).sortWithinPartitions(*KEY, "chunk").select(*KEY, "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest, done = None, None, []

        def flush() -> pa.RecordBatch:
            columns = [pa.array(c, t) for c, t in zip(zip(*done), (pa.int64(), pa.int64(), pa.int64(), pa.string()))]
            done.clear()
            return pa.RecordBatch.from_arrays(columns, names=[*KEY, "ends_sha256"])

        for batch in batches:
            for *own, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if own == key:
                    digest.update(b",")
                else:
                    if key is not None:
                        done.append((*key, digest.hexdigest()))
                    key, digest = own, hashlib.sha256()
                digest.update(ids.encode())
            if len(done) >= 10_000:
                yield flush()
        if key is not None:
            done.append((*key, digest.hexdigest()))
        if done:
            yield flush()

    return rows.mapInArrow(run, "d long, x1 long, x2 long, ends_sha256 string")


def roll_up(nodes: DataFrame, values: list[str]) -> DataFrame:
    """Sums each of ``values`` over every node's subtree, in as many rounds as the depth has binary digits.

    ``nodes`` (a written table): the key ``d, x1, x2``, the parent's ``p1, p2`` and the values.
    """
    depth = nodes.agg(F.max("d")).first()[0] or 0
    now, step = nodes.select(*KEY, F.col("p1").alias("a1"), F.col("p2").alias("a2"), *values), 1
    while step <= depth:
        to = [(F.col("d") - step).alias("d"), F.col("a1").alias("x1"), F.col("a2").alias("x2")]
        below = now.where(F.col("d") >= step).groupBy(*to).agg(*[F.sum(v).alias(f"more_{v}") for v in values])
        far = F.col("d") >= 2 * step
        ends = now.where(~far).select(*KEY, F.lit(None).cast("long").alias("a1"), F.lit(None).cast("long").alias("a2"), *values)
        target = now.where(F.col("d") >= step).select(F.col("d").alias("td"), F.col("x1").alias("t1"), F.col("x2").alias("t2"), F.col("a1").alias("b1"), F.col("a2").alias("b2"))
        on = (F.col("d") - step == F.col("td")) & (F.col("a1") == F.col("t1")) & (F.col("a2") == F.col("t2"))
        jumped = now.where(far).join(target, on).select(*KEY, F.col("b1").alias("a1"), F.col("b2").alias("a2"), *values)
        summed = ends.unionByName(jumped).join(below, KEY, "left")
        now = written(summed.select(*KEY, "a1", "a2", *[(F.col(v) + F.coalesce(f"more_{v}", F.lit(0))).alias(v) for v in values]), "rollup")
        step *= 2
    return now.select(*KEY, *values)


def trie(rebuilt: DataFrame) -> DataFrame:
    """One row per node of the trie of ``rebuilt`` conversations (see :func:`branched`, :func:`whole`)."""
    prefixes = written(_prefixes(rebuilt), "prefixes")
    nodes = written(prefixes.groupBy(*KEY).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("chars").alias("chars"), F.min("p1").alias("p1"), F.min("p2").alias("p2")), "nodes")
    below = nodes.where(F.col("d") > 0)
    children = below.groupBy((F.col("d") - 1).alias("d"), F.col("p1").alias("x1"), F.col("p2").alias("x2")).agg(F.count("*").alias("n_children"))
    known = nodes.join(children, KEY, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    known = known.withColumn("n_leaves", (F.col("n_children") == 0).cast("long")).withColumn("saved_tokens", (F.col("n_convs") - 1) * F.col("chars"))
    known = written(known, "node-facts")
    sums = roll_up(known, ["n_leaves", "saved_tokens"])
    parents = nodes.select((F.col("d") + 1).alias("d"), F.col("x1").alias("p1"), F.col("x2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    of_parent = below.select(*KEY, "p1", "p2").join(parents, ["d", "p1", "p2"]).select(*KEY, "parent_conv_id")
    ends = _end_digests(prefixes.where("ends").select(*KEY, "conv_id"))
    out = known.drop("n_leaves", "saved_tokens").join(sums, KEY).join(of_parent, KEY, "left").join(ends, KEY, "left")
    none = hashlib.sha256(b"").hexdigest()
    return out.select("conv_id", F.col("d").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))


def trie_report(conversations: DataFrame) -> DataFrame:
    """The contract's trie, of conversations that branch off every hundredth one."""
    return trie(branched(written(numbered_turns(conversations), "numbered-turns")))


ORACLE_SQL = r"""
WITH RECURSIVE t AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i,
    {'r': coalesce(role, ''), 't': coalesce(text, '')} AS x FROM conversations WHERE conv_id IS NOT NULL),
l AS (SELECT c, list(x ORDER BY i) AS xs FROM t GROUP BY c),
crc AS (
  SELECT c, c::VARCHAR AS s, 0 AS k, 4294967295::BIGINT AS v FROM l
  UNION ALL
  SELECT c, s, k + 1, CASE WHEN w % 2 = 1 THEN xor(w // 2, 3988292384::BIGINT) ELSE w // 2 END
  FROM (SELECT *, CASE WHEN k % 8 = 0 THEN xor(v, ascii(s[k // 8 + 1])::BIGINT) ELSE v END AS w FROM crc WHERE k < 8 * length(s))),
h AS (SELECT c, xor(v, 4294967295::BIGINT) % 6 AS h FROM crc WHERE k = 8 * length(s)),
b AS (SELECT l.c, list_concat(coalesce(list_slice(z.xs, 1, h), []), coalesce(list_slice(l.xs, h + 1, len(l.xs)), [])) AS xs FROM l JOIN h USING (c) LEFT JOIN l z ON z.c = l.c - l.c % 100),
p AS (SELECT c, d, list_slice(xs, 1, d) AS pre, len(xs) AS n, CASE WHEN d > 0 THEN length(xs[d].t) ELSE 0 END AS chars FROM b, unnest(range(0, len(xs) + 1)) AS r(d)),
node AS (SELECT pre, d, min(c) AS c, count(*) AS n, max(chars) AS chars, coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE n = d), '') AS ids FROM p GROUP BY pre, d),
kid AS (SELECT list_slice(pre, 1, d - 1) AS pre, count(*) AS k FROM node WHERE d > 0 GROUP BY 1),
full_ AS (SELECT node.*, coalesce(k, 0) AS k FROM node LEFT JOIN kid ON kid.pre = node.pre),
up AS (SELECT list_slice(pre, 1, e) AS pre, sum((k = 0)::BIGINT) AS leaves, sum((n - 1) * chars) AS saved FROM full_, unnest(range(0, d + 1)) AS r(e) GROUP BY 1)
SELECT f.c AS conv_id, CAST(f.d AS BIGINT) AS depth, q.c AS parent_conv_id, f.n AS n_convs, f.k AS n_children, CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(f.ids) AS ends_sha256
FROM full_ f JOIN up ON up.pre = f.pre LEFT JOIN node q ON f.d > 0 AND q.pre = list_slice(f.pre, 1, f.d - 1)
"""
