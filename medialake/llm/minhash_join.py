"""MinHash near-duplicates: documents posted under the coordinates of their signatures.

A signature has ``COORDINATES`` places; two sets agree in a place with a
probability of their Jaccard similarity. ``matches_needed`` is the largest number
of agreeing places that a pair at the threshold misses with a probability of
``MISS`` at most, so a lost link is a matter of chance once in a thousand million.

*Posting.* A class of equal sets is posted under each (place, value) pair, and
the lists are counted. A list of one class can't match anything.

*Prefix.* In order of rarity, two classes that share t of k values share one of
the first k - t + 1 of either. Lists of one come first in this order, so a class
with k - t + 1 of them has no partner, and most classes end here.

*Skipping.* Only those short lists are merged: each class meets the first of
each of its lists. The longer lists are skipped: a candidate's collisions are
counted by looking at both signatures, and pairs below t go, as do those whose
parity sketches differ in more places than the sets may. So a passage that a
third of all documents share costs nothing where the rest of a text is its own.
Lists whose members don't end in one component are gone through again (see
:func:`medialake.llm.parity_join.linked_by_keys`), counting the collisions of
pairs between components only; so members of a large group of near copies
aren't paired with each other.

What is left is confirmed on the full sets of shingles, from the texts.

Lists are counted and their first member is found by combined aggregates, and
the list joined back by a plain join, which AQE splits: no list is one task's.

Defined results: a null or wordless text has no shingles, is linked with nothing
and kept; a row without id is linked with nothing (its component is null) and
kept; rows of one id share its component, a copy of a smaller id goes as often as
it occurs; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from medialake.llm.common import written
from medialake.llm.parity_join import MEMO, PARITY, SHORT, Likeness, Shingler, digest, linked_by_keys, mix, short_sketch

WIDTH = 5
P, Q = 85, 100
COORDINATES = 48
MISS = 1e-9
#: From this many shingles on, a signature is made place by place.
WIDE = 4096

_SEEDS = mix(np.arange(1, 2 * COORDINATES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def matches_needed(p: int = P, q: int = Q, k: int = COORDINATES, miss: float = MISS) -> int:
    """The largest t such that fewer than t of k places agree with a probability of at most ``miss`` at a similarity of p / q."""
    below = 0.0
    for t in range(k + 1):
        below += comb(k, t) * (p / q) ** t * (1 - p / q) ** (k - t)
        if below > miss:
            return max(1, t)
    return k


def signature(s: np.ndarray, k: int = COORDINATES) -> np.ndarray:
    """The least hash of a set at each place, as signed 64-bit numbers."""
    flips, factors = _SEEDS[:k], _SEEDS[k : 2 * k] | np.uint64(1)
    if len(s) < WIDE:
        return ((s[None, :] ^ flips[:, None]) * factors[:, None]).min(axis=1).view(np.int64)
    return np.array([((s ^ x) * f).min() for x, f in zip(flips, factors)], np.uint64).view(np.int64)


def likeness(t: int, k: int = COORDINATES) -> Likeness:
    """Pairs whose signatures agree in ``t`` of the first ``k`` numbers of a sketch, and whose parity sketches, the numbers behind them, don't differ too much.

    The second test loses a link with a chance below 1e-9 (see :func:`medialake.llm.parity_join.short_sketch`).
    """
    agree = lambda a, b: F.size(F.filter(F.zip_with(F.slice(a, 1, k), F.slice(b, 1, k), lambda x, y: x == y), lambda z: z)) >= t

    def arrays(s: np.ndarray, i: int, near: np.ndarray, most: np.ndarray) -> np.ndarray:
        return ((s[near, :k] == s[i, :k]).sum(axis=1) >= t) & PARITY.arrays(s[:, k:], i, near, most)

    return Likeness(lambda a, b, most: agree(a, b) & PARITY.columns(F.slice(a, k + 1, SHORT), F.slice(b, k + 1, SHORT), most), arrays)


def _signed(documents: DataFrame, doc_id: str, text: str, width: int) -> DataFrame:
    """Per row: ``doc_id, n, digest, sketch`` (the signature and a parity sketch); the last is left out where the same task had it just before."""
    schema = T.StructType([T.StructField("doc_id", documents.schema[doc_id].dataType), T.StructField("n", T.LongType()), T.StructField("digest", T.LongType()), T.StructField("sketch", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        to, shingles, seen = to_arrow_schema(schema), Shingler(width), set()
        for batch in batches:
            n, digests, found = [], [], []
            for value in batch.column(1):
                s = shingles(value.as_py())
                n.append(len(s))
                digests.append(digest(s))
                new = len(s) > 0 and digests[-1] not in seen
                if new:
                    if len(seen) > MEMO:
                        seen.clear()
                    seen.add(digests[-1])
                found.append(np.concatenate([signature(s), short_sketch(s)]) if new else None)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(to.field(0).type), pa.array(n, pa.int64()), pa.array(digests, pa.int64()), pa.array(found, to.field(3).type)], schema=to)

    return documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)


def posted(classes: DataFrame, t: int, k: int = COORDINATES) -> DataFrame:
    """(key, digest): the lists of a class's prefix that hold others, too. ``classes``: ``digest`` and a ``sketch`` that begins with the signature."""
    every = classes.select("digest", F.posexplode(F.slice("sketch", 1, k)).alias("place", "value")).select("digest", F.xxhash64("place", "value").alias("key"))
    shared = every.groupBy("key").agg(F.count("*").alias("length")).where(F.col("length") > 1)
    own = every.join(shared, "key").groupBy("digest").agg(F.array_sort(F.collect_list(F.struct("length", "key"))).alias("lists"))
    alone = F.lit(k) - F.size("lists")
    prefix = own.select("digest", F.explode(F.slice("lists", F.lit(1), F.greatest(F.lit(k - t + 1) - alone, F.lit(0)))).alias("x"))
    return prefix.select(F.col("x.key").alias("key"), "digest")


def linked_classes(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, p: int = P, q: int = Q) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row."""
    t = matches_needed(p, q)
    signed = written(_signed(documents, doc_id, text, width), "signatures")
    of_ids = signed.where((F.col("n") > 0) & F.col("doc_id").isNotNull())
    # The signature of a class stands with one of its rows at least, which may be one without id.
    sketches = signed.where(F.col("sketch").isNotNull()).groupBy("digest").agg(F.first("sketch").alias("sketch"))
    ids = of_ids.groupBy("digest").agg(F.first("n").alias("n"), F.min("doc_id").alias("id"))
    classes = written(ids.join(sketches, "digest"), "classes")
    lists = written(posted(classes, t), "lists")
    first = lists.groupBy("key").agg(F.min("digest").alias("first"), F.count("*").alias("m")).where(F.col("m") > 1)
    met = written(lists.join(first, "key"), "met")
    pairs = met.where(F.col("first") != F.col("digest")).select(F.col("first").alias("a"), F.col("digest").alias("b")).distinct()
    members = met.where(F.col("m") > 2).select("key", "digest")
    out = linked_by_keys(documents, signed, classes, pairs, members, like=likeness(t), doc_id=doc_id, text=text, width=width, p=p, q=q)
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def dedup_report(documents: DataFrame) -> DataFrame:
    """The contract's classes: five words, 0.85."""
    return linked_classes(documents)


ORACLE_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) < 5 THEN ws ELSE list_slice(ws, i, i + 4) END AS g
      FROM (SELECT doc_id, ws, unnest(range(1, greatest(1, len(ws) - 4) + 1)) AS i FROM w WHERE len(ws) > 0)),
sets AS (SELECT doc_id, list(hash(g) ORDER BY hash(g)) AS gs, count(*) AS n FROM s GROUP BY doc_id),
cls AS (SELECT min(doc_id) AS rep, gs, n, list(doc_id) AS docs FROM sets GROUP BY gs, n),
e AS (SELECT rep, n, unnest(gs) AS g FROM cls),
f AS (SELECT g, count(*) AS df FROM e GROUP BY g HAVING count(*) > 1),
r AS (SELECT e.rep, e.n, e.g, row_number() OVER (PARTITION BY e.rep ORDER BY coalesce(f.df, 1), e.g) AS k FROM e LEFT JOIN f USING (g)),
pre AS (SELECT rep, n, r.g FROM r JOIN f USING (g) WHERE k <= n * 15 // 85 + 1),
cand AS (SELECT DISTINCT a.rep AS a, b.rep AS b FROM pre a JOIN pre b ON a.g = b.g AND a.rep < b.rep AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)),
lnk AS (SELECT a, b FROM (SELECT c.a, c.b, x.n + y.n AS t, len(list_intersect(x.gs, y.gs)) AS i FROM cand c JOIN cls x ON x.rep = c.a JOIN cls y ON y.rep = c.b) WHERE 100 * i >= 85 * (t - i)),
edge AS (SELECT a, b FROM lnk UNION SELECT b, a FROM lnk),
reach AS (SELECT rep AS a, rep AS b FROM cls UNION SELECT reach.a, edge.b FROM reach JOIN edge ON reach.b = edge.a),
comp AS (SELECT a AS rep, min(b) AS c FROM reach GROUP BY a),
named AS (SELECT unnest(docs) AS doc_id, n, c FROM cls JOIN comp USING (rep))
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(n.c, d.doc_id) AS component_id, coalesce(n.c, d.doc_id) = d.doc_id AS kept FROM documents d LEFT JOIN named n USING (doc_id)
"""
