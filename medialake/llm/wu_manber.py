"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The symbols of the search are words. Patterns are the distinct windows of
``window`` consecutive words of the benchmark items (an item with fewer words
is one pattern). All patterns of one length form a searcher with

* a *shift table*: from a block of ``BLOCK`` consecutive words to how far the
  search may jump when that block ends at the current position; a block that is
  in no pattern lets it jump over ``length - BLOCK + 1`` words at once;
* *suffix buckets*: for blocks that end a pattern, the patterns by their last
  block and first word;
* a direct comparison of the words, which alone decides.

Every document is searched by itself. The benchmark is dealt into blocks of
about ``block_chars`` characters by a hash of its items' ids. Each block is a
pass over the documents: the block's texts are broadcast, every worker builds
their tables once, and the broadcast is taken back before the next, so a worker
and the driver never hold more than one block. With one block there is no shuffle;
with more, each pass writes the rows it hits, and a row's hits are merged.

Defined results: a null or wordless text has no words and no hits; a null or
wordless benchmark item gives no pattern; repeated items share a pattern and
all count; a repeated document row is returned as often as it occurs; other
columns of either table are ignored, unless named in ``keep``, where one named
like an output is left out; empty tables give no rows or no hits.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from medialake.llm.common import carried, written

WINDOW = 10
BLOCK = 2
#: Characters of benchmark text whose tables are broadcast at a time (some 100 MB of tables).
BLOCK_CHARS = 4_000_000

#: A byte is part of a word if it's a digit, a letter (lower-cased) or not ASCII; any other byte separates.
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """The lower-cased words of a text, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split() if text else []


class Searcher:
    """Patterns of one length: shift table, suffix buckets and the items of each pattern."""

    def __init__(self, length: int, patterns: dict[tuple[bytes, ...], list]):
        self.length, self.block = length, min(BLOCK, length)
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.buckets: dict[tuple[bytes, ...], dict[bytes, list[tuple[list[bytes], list]]]] = {}
        for pattern, items in patterns.items():
            for end in range(self.block, length + 1):
                key = pattern[end - self.block : end]
                far = length - end
                if far < self.shift.get(key, length):
                    self.shift[key] = far
            self.buckets.setdefault(pattern[-self.block :], {}).setdefault(pattern[0], []).append((list(pattern), items))

    def search(self, words: list[bytes], hit: bytearray, items: set) -> None:
        """Marks the words inside occurrences in ``hit`` and adds the items that occur."""
        n, m, b = len(words), self.length, self.block
        if n < m:
            return
        jump, shift, buckets = m - b + 1, self.shift, self.buckets
        if b == 2:
            blocks = list(zip(words, words[1:]))
        else:
            blocks = [(w,) for w in words]
        at, last = m - b, n - b  # at: where the block that ends the window begins
        get = shift.get
        while at <= last:
            far = get(blocks[at], jump)
            if far:
                at += far
                continue
            start = at + b - m
            for pattern, owners in buckets[blocks[at]].get(words[start], ()):
                if words[start : start + m] == pattern:
                    hit[start : start + m] = b"\x01" * m
                    items.update(owners)
            at += 1


def patterns_of(items: list[tuple[object, str | None]], window: int = WINDOW) -> dict[int, dict[tuple[bytes, ...], list]]:
    """Distinct windows by length, each with the ids of the items that have it."""
    found: dict[int, dict[tuple[bytes, ...], set]] = {}
    for item, text in items:
        words = words_of(text)
        if item is None or not words:
            continue
        m = min(window, len(words))
        for i in range(len(words) - m + 1):
            found.setdefault(m, {}).setdefault(tuple(words[i : i + m]), set()).add(item)
    return {m: {p: sorted(ids) for p, ids in by.items()} for m, by in found.items()}


#: The searchers of the block that a worker has last built, by the block's name.
_BUILT: dict[str, list[Searcher]] = {}


def _searchers(name: str, items: Broadcast, window: int) -> list[Searcher]:
    if name not in _BUILT:
        _BUILT.clear()
        _BUILT[name] = [Searcher(m, by) for m, by in patterns_of(items.value, window).items()]
    return _BUILT[name]


def _passes(benchmark: DataFrame, item_id: str, item_text: str, block_chars: int) -> list[DataFrame]:
    """The benchmark's (id, text) in blocks of about ``block_chars`` characters; one empty block if it has no text."""
    items = benchmark.select(F.col(item_id).alias("item"), F.col(item_text).alias("text")).where(F.col("text").isNotNull() & F.col("item").isNotNull())
    chars = items.agg(F.sum(F.char_length("text").cast("long"))).head()[0] or 0
    n = -(-chars // block_chars) or 1
    return [items.where(F.pmod(F.xxhash64("item"), F.lit(n)) == i) for i in range(n)]


def _searched(documents: DataFrame, carried_columns: list[str], text: str, block: DataFrame, window: int, only_hits: bool) -> tuple[DataFrame, Broadcast]:
    """``carried_columns``, ``n_words``, ``n_hit``, ``items``, ``spans`` of one pass."""
    items = documents.sparkSession.sparkContext.broadcast([(r["item"], r["text"]) for r in block.toLocalIterator()])
    name = uuid.uuid4().hex
    schema = T.StructType([*[documents.schema[c] for c in carried_columns], *_outputs(block.schema["item"].dataType)])
    n = len(carried_columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        to = to_arrow_schema(schema)
        for batch in batches:
            n_words, n_hit, items_out, spans_out = [], [], [], []
            for value in batch.column(n).to_pylist():
                words = words_of(value)
                hit, found = bytearray(len(words)), set()
                for s in _searchers(name, items, window):
                    s.search(words, hit, found)
                n_words.append(len(words))
                n_hit.append(hit.count(1))
                items_out.append(sorted(found))
                spans, at = [], hit.find(1)
                while at >= 0:
                    end = hit.find(0, at)
                    end = len(hit) if end < 0 else end
                    spans.append({"start": at, "end": end})
                    at = hit.find(1, end)
                spans_out.append(spans)
            columns = [batch.column(i).cast(to.field(i).type) for i in range(n)]
            out = pa.RecordBatch.from_arrays([*columns, *[pa.array(x, to.field(n + i).type) for i, x in enumerate([n_words, n_hit, items_out, spans_out])]], schema=to)
            yield out.filter(pa.array([x > 0 for x in n_hit], pa.bool_())) if only_hits else out

    return documents.select(*carried_columns, F.col(text).alias("_text")).mapInArrow(run, schema), items


def _outputs(item_type: T.DataType) -> list[T.StructField]:
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    return [T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("items", T.ArrayType(item_type)), T.StructField("spans", T.ArrayType(span))]


def _merged(spans: Column) -> Column:
    """Spans of several passes as the spans of their union, in order."""
    grown = F.aggregate(
        F.array_sort(spans), F.array().cast("array<struct<start: bigint, end: bigint>>"),
        lambda out, s: F.when((F.size(out) > 0) & (s["start"] <= F.element_at(out, -1)["end"]), F.concat(F.slice(out, F.lit(1), F.size(out) - 1), F.array(F.struct(F.element_at(out, -1)["start"].alias("start"), F.greatest(F.element_at(out, -1)["end"], s["end"]).alias("end"))))).otherwise(F.concat(out, F.array(s))),
    )
    return F.when(F.size(spans) == 0, F.array().cast("array<struct<start: bigint, end: bigint>>")).otherwise(grown)


def find_hits(documents: DataFrame, benchmark: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_chars: int = BLOCK_CHARS, keep: list[str] | None = None) -> DataFrame:
    """Per document row: ``n_words``, ``n_hit``, ``items`` (sorted ids) and ``spans``.

    ``spans`` has the [start, end) word ranges that are hit. ``keep`` names
    further columns of ``documents`` to carry through.
    """
    names = ["n_words", "n_hit", "items", "spans"]
    kept = carried([doc_id, *(keep or [])], names)
    blocks = _passes(benchmark, item_id, item_text, block_chars)
    if len(blocks) == 1:
        return _searched(documents, kept, text, blocks[0], window, False)[0]
    rows = written(documents.select(F.struct(*kept).alias("_kept"), F.col(text).alias("_words"), F.monotonically_increasing_id().alias("_number")), "wu-manber-rows")
    found = []
    for block in blocks:
        hits, items = _searched(rows, ["_number"], "_words", block, window, True)
        found.append(written(hits, "wu-manber-hits"))
        items.unpersist(blocking=True)
    hits = reduce(DataFrame.unionByName, found).groupBy("_number").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), _merged(F.flatten(F.collect_list("spans"))).alias("spans"))
    none = _searched(rows, ["_kept", "_number"], "_words", blocks[0].limit(0), window, False)[0].select("_kept", "_number", "n_words")
    joined = none.join(hits, "_number", "left")
    items, spans = (F.coalesce(c, F.array().cast(hits.schema[c].dataType)).alias(c) for c in ("items", "spans"))
    n_hit = F.coalesce(F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"]), F.lit(0).cast("long")).alias("n_hit")
    return joined.select(*[F.col("_kept").getField(c).alias(c) for c in kept], "n_words", n_hit, items, spans)


def item_digest(items: list) -> str:
    """What ``items_sha256`` is, in plain Python."""
    return hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()


def decontamination_report(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The contract's columns, from the operator's hits."""
    hits = find_hits(documents, benchmark)
    as_text = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    return hits.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", as_text), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


ORACLE_SQL = r"""
WITH doc AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
item AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
win AS (SELECT DISTINCT item_id, least(10, len(ws)) AS m, list_slice(ws, i, i + least(10, len(ws)) - 1) AS w
        FROM (SELECT item_id, ws, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS i FROM item WHERE len(ws) > 0)),
lens AS (SELECT DISTINCT m FROM win),
dw AS (SELECT doc_id, m, i, list_slice(ws, i, i + m - 1) AS w
       FROM (SELECT doc_id, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM doc, lens WHERE len(ws) >= m)),
occ AS (SELECT doc_id, item_id, i, dw.m AS m FROM dw JOIN win ON dw.m = win.m AND dw.w = win.w),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM (SELECT DISTINCT doc_id, i, m FROM occ)) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS s FROM (SELECT DISTINCT doc_id, item_id FROM occ) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, CAST(coalesce(h.n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(t.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(t.s, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM doc d LEFT JOIN hit h USING (doc_id) LEFT JOIN its t USING (doc_id)
"""
