"""What each filter removes in every order of the filters, by walking the trie of their permutations.

A node of the trie is a prefix of an order; what it has left depends on the *set*
of its filters only, so nodes of one set share one state: 32 states and 80 edges
for five filters instead of 206 and 325. The walk is depth-first. A state's
survivors are a persisted DataFrame, made by applying one filter to those of the
state above; one job over them counts what each remaining filter removes, part by
part, and appends the counts to a table; then the walk goes on to the children
that weren't visited before. So there are never more persisted frames than
filters, and a lost executor's partitions are made again from the frame above.
The orders are joined to the counted edges at the end.

Filters are conditions that say which rows *fail*; a null counts as no failure.
The number of orders is the factorial of the number of filters, so at most
``MOST_FILTERS`` are taken.

Defined results: an empty table gives no rows; a null text is empty, a null or
empty ``lang`` is the part ``''``; a repeated row counts as often as it occurs. A
row without id isn't a copy of any and none is a copy of it; rows of one id
aren't copies of each other. A document is good or toxic if any of its labels
says so. Columns other than those named are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from itertools import permutations
from math import factorial

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medialake.llm.common import shared_dir, written

MOST_FILTERS = 7
WORD_BREAK = r"[\x20\x09-\x0D]+"


def _edges(survivors: DataFrame, state: int, rest: Sequence[str], fails: Mapping[str, Column], marks: Sequence[str]) -> DataFrame:
    """Per part and remaining filter: how many rows the state has, how many the filter removes, and how many of those bear each mark."""
    counts, found = [F.count("*").alias("n")], []
    for i, f in enumerate(rest):
        counts += [F.count_if(fails[f]).alias(f"r{i}"), *[F.count_if(fails[f] & F.col(m)).alias(f"r{i}_{j}") for j, m in enumerate(marks)]]
        lost = [F.col(f"r{i}_{j}").alias(f"{m}_lost") for j, m in enumerate(marks)]
        found.append(F.struct(F.lit(f).alias("filter"), F.col(f"r{i}").alias("removed"), *lost))
    edges = survivors.groupBy("part").agg(*counts).select("part", F.lit(state).alias("state"), "n", F.explode(F.array(*found)).alias("x"))
    return edges.select("part", "state", "n", "x.*")


def walk(rows: DataFrame, filters: Mapping[str, Column], marks: Sequence[str] = ()) -> DataFrame:
    """The edges of the trie's shared states: ``part, state, filter, n, removed`` and ``<mark>_lost``.

    ``rows`` has ``part`` and a boolean column for each mark. ``state`` has bit i
    if the i-th filter was applied before. A part without survivors in a state has no row there.
    """
    names = list(filters)
    if not 1 <= len(names) <= MOST_FILTERS:
        raise ValueError(f"1 to {MOST_FILTERS} filters can be audited, not {len(names)}")
    fails = {f: F.coalesce(c, F.lit(False)) for f, c in filters.items()}
    spark = rows.sparkSession
    path, visited = f"{shared_dir(spark)}/filter-edges-{uuid.uuid4().hex}", set()

    def visit(survivors: DataFrame, state: int) -> None:
        visited.add(state)
        rest = [i for i in range(len(names)) if not state >> i & 1]
        if not rest:
            return
        survivors = survivors.persist(StorageLevel.MEMORY_AND_DISK)
        _edges(survivors, state, [names[i] for i in rest], fails, marks).write.mode("append").parquet(path)
        for i in rest:
            if state | 1 << i not in visited:
                visit(survivors.where(~fails[names[i]]), state | 1 << i)
        survivors.unpersist()

    visit(rows, 0)
    return spark.read.parquet(path)


def orders(edges: DataFrame, filters: Sequence[str], marks: Sequence[str] = ()) -> DataFrame:
    """One row per part, order and step, from what :func:`walk` counted.

    ``filter_order`` joins the filters' names as they're applied; ``kept`` and
    ``removed`` are counted at the step's edge; ``redundant`` rows fail the
    step's filter but went earlier; ``unique_fails`` fail no other filter;
    ``shapley`` sums the filter's removals over all orders.
    """
    spark, k, names = edges.sparkSession, len(filters), list(filters)
    every = [(s, f) for s in range(1 << k) for i, f in enumerate(names) if not s >> i & 1]
    lost = [f"{m}_lost" for m in marks]
    # Every edge for every part, with zeros where no survivor was left.
    grid = edges.select("part").distinct().select("part", F.explode(F.array(*[F.struct(F.lit(s).alias("state"), F.lit(f).alias("filter")) for s, f in every])).alias("x")).select("part", "x.*")
    full = grid.join(edges, ["part", "state", "filter"], "left").fillna(0, ["n", "removed", *lost])
    before = F.bit_count("state")
    weight = F.element_at(F.array(*[F.lit(factorial(i) * factorial(k - 1 - i)) for i in range(k)]), before + 1)
    of_filter = full.groupBy("part", "filter").agg(
        F.sum(F.when(F.col("state") == 0, F.col("removed"))).alias("fails"),
        F.sum(F.when(before == k - 1, F.col("removed"))).alias("unique_fails"),
        F.sum(F.col("removed") * weight).alias("shapley"),
    )
    steps = []
    for order in permutations(range(k)):
        state = 0
        for step, i in enumerate(order, 1):
            steps.append(("".join(names[j] for j in order), step, state, names[i]))
            state |= 1 << i
    placed = F.broadcast(spark.createDataFrame(steps, "filter_order string, step int, state int, filter string"))
    out = full.join(placed, ["state", "filter"]).join(of_filter, ["part", "filter"])
    return out.select("part", "filter_order", "step", (F.col("n") - F.col("removed")).alias("kept"), "removed", (F.col("fails") - F.col("removed")).alias("redundant"), "unique_fails", *lost, "shapley")


def audit(rows: DataFrame, filters: Mapping[str, Column], marks: Sequence[str] = ()) -> DataFrame:
    return orders(walk(rows, filters, marks), list(filters), marks)


def quality_verdicts(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, good, toxic`` and, as ``A`` to ``E``, whether a document fails: few words, repeated words, capitals, symbols, copies.

    Texts are read once; what is written has a digest in place of the text. Of
    the texts that occur under several ids the smallest id is joined back, so
    that a text held by a third of the rows adds one row to the join's right side and AQE may split its left.
    """
    text = F.coalesce("text", F.lit(""))
    words = documents.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), text.alias("t"), F.array_remove(F.split(text, WORD_BREAK), "").alias("words"))
    n = F.size("words")
    read = words.select(
        "doc_id", "part", F.sha2("t", 256).alias("digest"),
        (n < 200).alias("A"),
        (100 * F.size(F.array_distinct("words")).cast("long") < 50 * n.cast("long")).alias("B"),
        (100 * F.char_length(F.regexp_replace("t", "[^A-Z]+", "")).cast("long") > 3 * F.char_length("t").cast("long")).alias("C"),
        F.col("t").rlike(r"[#$%&*|]").alias("D"),
    )
    read = written(read, "verdicts")
    copied = read.groupBy("digest").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where(F.col("least") < F.col("most")).select("digest", "least")
    known = labels.groupBy("doc_id").agg(F.coalesce(F.bool_or(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.bool_or(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    marked = read.join(copied, "digest", "left").join(known, "doc_id", "left")
    copy = F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False))
    rows = marked.select("part", *[F.coalesce(m, F.lit(False)).alias(m) for m in ("good", "toxic")], "A", "B", "C", "D", copy.alias("E"))
    return written(rows, "filter-rows")


def interaction_report(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's audit: filters A to E on whole texts."""
    return audit(quality_verdicts(documents, labels), {f: F.col(f) for f in "ABCDE"}, ["good", "toxic"])


ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
marks AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
v AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    {'A': len(ws) < 200, 'B': 100 * len(list_distinct(ws)) < 50 * len(ws), 'C': 100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 3 * length(t),
     'D': regexp_matches(t, '[#$%&*|]'), 'E': coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)} AS f
  FROM w LEFT JOIN marks USING (doc_id)),
rows_ AS (SELECT part, good, toxic, (CASE WHEN f.A THEN 'A' ELSE '' END) || (CASE WHEN f.B THEN 'B' ELSE '' END) || (CASE WHEN f.C THEN 'C' ELSE '' END)
    || (CASE WHEN f.D THEN 'D' ELSE '' END) || (CASE WHEN f.E THEN 'E' ELSE '' END) AS failed FROM v),
cube AS (SELECT part, good, toxic, failed, count(*) AS n FROM rows_ GROUP BY ALL),
perm AS (SELECT '' AS o UNION ALL SELECT o || l FROM perm, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l) WHERE NOT contains(o, l)),
steps AS (SELECT o AS filter_order, s AS step, o[s] AS l, o[1:s - 1] AS prior FROM perm, range(1, 6) r(s) WHERE length(o) = 5),
hit AS (SELECT *, length(translate(failed, prior, '')) = length(failed) AS alive, contains(failed, l) AS fails FROM cube, steps),
c AS (
  SELECT part, filter_order, step, l, sum(CASE WHEN alive AND NOT fails THEN n ELSE 0 END) AS kept, sum(CASE WHEN alive AND fails THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN fails AND NOT alive THEN n ELSE 0 END) AS redundant, sum(CASE WHEN failed = l THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN alive AND fails AND good THEN n ELSE 0 END) AS good_lost, sum(CASE WHEN alive AND fails AND toxic THEN n ELSE 0 END) AS toxic_lost
  FROM hit GROUP BY part, filter_order, step, l)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, l) AS BIGINT) AS shapley
FROM c
"""
