"""Toxicity by the nearest labelled examples, found by exact TF-IDF cosine.

1. *Examples.* At most ``EXAMPLES`` labelled documents of each class (those of
   the smallest hashes of their ids), with their whole texts.
2. *Terms.* Every word of the examples. Its document frequency is counted over
   the texts of all documents, one row a term and task before the shuffle. Its
   weight is the inverse document frequency times 1 + the square root of its
   chi-square with the class: words that tell the classes apart weigh more, none
   is left out.
3. *Index.* The examples' unit vectors in a block-max inverted index. Examples
   are put in an order that has like ones together and cut into blocks of
   ``BLOCK``. A term of few examples has a list of them with its weights; one of
   more than a ``HEAD``-th of them has its weights block by block, with each
   block's largest.
4. *Search.* The lists are added up. With the largest weights of the other terms
   they bound what a document's cosine to any example of a block can be. The
   ``AT_ONCE`` blocks of the largest bounds are scored first, then all whose bound
   reaches the ``K``-th largest cosine of those; the others are skipped. That's
   exact. ``BATCH`` documents are worked on together.
5. *Votes.* The neighbours vote with the square of their cosine, against a weak
   prior; the vote is calibrated by an isotonic curve fitted on the examples
   themselves (each without itself), weighted to the classes' true shares.

The examples are bounded by a parameter, so are their words and the index; it's
sent to every worker. Documents are scored where they're read.

Defined results: a text that is null, empty or without any term has no
neighbours and the calibrated score of the prior; without labelled examples the
score is 0, with one class alone that class' label; a repeated row is returned
as often; other columns are dropped unless named in ``keep``. A document with
several labels counts as toxic if any says so. Ties between neighbours go to the
smaller example number.
"""

from __future__ import annotations

import math
import re
import sys
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from medialake.llm.common import carried, held_out, written

EXAMPLES = 2000
K = 15
PRIOR_WEIGHT = 0.05
BLOCK, AT_ONCE, HEAD, BATCH = 8, 8, 16, 128
#: Documents whose evidence is held at once.
CHUNK = 1000

_WORD = re.compile(r"[^\W_]+")


def word_counts(text: str | None) -> Counter:
    return Counter(_WORD.findall(text.lower())) if text else Counter()


#: Numbers of terms and their values.
Vector = tuple[np.ndarray, np.ndarray]


@dataclass
class Index:
    """Block-max inverted index over unit vectors of examples; the most frequent terms have the smallest numbers."""

    terms: dict[str, int]
    weight: np.ndarray
    ids: list
    labels: np.ndarray
    #: example x frequent term, whole blocks; and frequent term x block
    head: np.ndarray
    largest: np.ndarray
    #: a rarer term's examples and weights are those from its offset to the next one's
    offsets: np.ndarray
    examples: np.ndarray
    weights: np.ndarray

    @classmethod
    def build(cls, weight: dict[str, float], frequency: dict[str, int], examples: list[tuple[object, int, list[str], np.ndarray]]) -> Index:
        """``examples``: (id, label, terms, counts); ``frequency``: in how many examples a term is."""
        order = sorted(weight, key=lambda w: (-frequency[w], w))
        terms, values = {w: i for i, w in enumerate(order)}, np.array([weight[w] for w in order])
        n_head = sum(1 for w in order if frequency[w] * HEAD > len(examples))
        made = [(x, y, unit(np.fromiter(map(terms.__getitem__, own), np.int64, len(own)), counts, values)) for x, y, own, counts in examples]
        made.sort(key=lambda m: (int(m[2][0][np.argmax(m[2][1])]) if len(m[2][0]) else -1, m[1], str(m[0])))
        blocks = -(-len(made) // BLOCK)
        head = np.zeros((blocks * BLOCK, n_head))
        for i, (_, _, (own, v)) in enumerate(made):
            often = own < n_head
            head[i, own[often]] = v[often]
        every = np.concatenate([m[2][0] for m in made] or [np.zeros(0, np.int64)])
        who = np.repeat(np.arange(len(made), dtype=np.int32), [len(m[2][0]) for m in made])
        values_of = np.concatenate([m[2][1] for m in made] or [np.zeros(0)])
        by = np.argsort(every, kind="stable")
        by = by[np.searchsorted(every[by], n_head) :]
        offsets = np.searchsorted(every[by], np.arange(n_head, len(order) + 1))
        return cls(terms, values, [m[0] for m in made], np.array([m[1] for m in made]), head, head.reshape(blocks, BLOCK, n_head).max(axis=1).T.copy(), offsets, who[by], values_of[by])

    def own_vectors(self) -> list[Vector]:
        """The examples' vectors, from the index."""
        rare = np.repeat(np.arange(len(self.offsets) - 1) + self.head.shape[1], np.diff(self.offsets))
        order = np.argsort(self.examples, kind="stable")
        edges = np.searchsorted(self.examples[order], np.arange(len(self.ids) + 1))
        out = []
        for i in range(len(self.ids)):
            often, part = np.flatnonzero(self.head[i]), order[edges[i] : edges[i + 1]]
            out.append((np.concatenate([often, rare[part]]), np.concatenate([self.head[i, often], self.weights[part]])))
        return out

    def vector(self, counts: Counter) -> Vector:
        found = [(t, n) for w, n in counts.items() if (t := self.terms.get(w)) is not None]
        own = np.array(found, np.int64).reshape(-1, 2)
        return unit(own[:, 0], own[:, 1], self.weight)

    def search(self, queries: list[Vector], k: int = K, without: list[int] | None = None) -> list[list[tuple[float, int]]]:
        """For each query the ``k`` examples of the largest positive cosine, nearest first, as (cosine, example)."""
        out = []
        (m, n_head), n_blocks = self.head.shape, len(self.head) // BLOCK
        for begin in range(0, len(queries), BATCH):
            part = queries[begin : begin + BATCH]
            q, tail = np.zeros((len(part), n_head)), np.zeros((len(part), m))
            for i, (own, v) in enumerate(part):
                often = own < n_head
                q[i, own[often]] = v[often]
                rare, v = own[~often] - n_head, v[~often]
                first, lengths = self.offsets[rare], self.offsets[rare + 1] - self.offsets[rare]
                places = np.repeat(first - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())
                tail[i] = np.bincount(self.examples[places], np.repeat(v, lengths) * self.weights[places], m)
                if without:
                    tail[i, without[begin + i]] = -np.inf
            scores = np.full(tail.shape, -np.inf)
            bounds = q @ self.largest + tail.reshape(len(part), n_blocks, BLOCK).max(axis=2)
            first = np.zeros(bounds.shape, bool)
            np.put_along_axis(first, np.argsort(-bounds, axis=1, kind="stable")[:, :AT_ONCE], True, axis=1)
            self._score(q, tail, first, scores)
            kth = np.sort(scores, axis=1)[:, -k] if k <= m else np.full(len(part), -np.inf)
            self._score(q, tail, (bounds >= kth[:, None] - 1e-9) & (bounds > 0) & ~first, scores)
            for own in scores:
                near = np.flatnonzero(own > 0)
                near = near[np.argsort(-own[near], kind="stable")][:k]
                out.append(list(zip(own[near].tolist(), near.tolist())))
        return out

    def _score(self, q: np.ndarray, tail: np.ndarray, wanted: np.ndarray, scores: np.ndarray) -> None:
        for block in np.flatnonzero(wanted.any(axis=0)).tolist():
            who, own = np.flatnonzero(wanted[:, block]), slice(block * BLOCK, (block + 1) * BLOCK)
            scores[who, own] = q[who] @ self.head[own].T + tail[who, own]

    def vote(self, found: list[tuple[float, int]], prior: float) -> float:
        weight = sum(s * s for s, _ in found)
        return (sum(s * s * self.labels[i] for s, i in found) + PRIOR_WEIGHT * prior) / (weight + PRIOR_WEIGHT)


def unit(own: np.ndarray, counts: np.ndarray, weight: np.ndarray) -> Vector:
    """A text's weighted terms as a unit vector."""
    v = (1 + np.log(counts)) * weight[own]
    return own, v / np.sqrt(v @ v) if len(v) else v


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the rising curve nearest to the points, by pooling adjacent violators."""
    pools: list[list[float]] = []
    values, where = np.unique(x, return_inverse=True)
    for v, a, b in zip(values, np.bincount(where, w * y), np.bincount(where, w)):
        pools.append([v, v, a, b])
        while len(pools) > 1 and pools[-2][2] / pools[-2][3] >= pools[-1][2] / pools[-1][3]:
            last = pools.pop()
            pools[-1] = [pools[-1][0], last[1], pools[-1][2] + last[2], pools[-1][3] + last[3]]
    # A quarter of an observation on either side keeps pure pools off 0 and 1.
    knots = [(edge, (a + 0.25 * b / max(b, 1)) / (b + 0.5)) for lo, hi, a, b in pools for edge in dict.fromkeys((lo, hi))]
    return np.array([k[0] for k in knots]), np.maximum.accumulate(np.array([k[1] for k in knots]))


@dataclass
class Model:
    index: Index | None
    prior: float
    curve: tuple[np.ndarray, np.ndarray] | None

    def judge(self, texts: list[str | None]) -> list[tuple[float, list[tuple[float, int]]]]:
        if self.index is None or self.curve is None:
            return [(self.prior, [])] * len(texts)
        found = self.index.search([self.index.vector(word_counts(t)) for t in texts])
        votes = np.interp([self.index.vote(f, self.prior) for f in found], *self.curve)
        return list(zip(np.clip(votes, 0, 1).tolist(), found))


def class_factor(a: int, b: int, n_toxic: int, n_other: int) -> float:
    """1 for a word that's as frequent in either class, more the more its frequency depends on it; ``a`` toxic and ``b`` other examples have it."""
    c, d = n_toxic - a, n_other - b
    return 1 + math.sqrt((n_toxic + n_other) * (a * d - b * c) ** 2 / max(1, (a + b) * (c + d) * n_toxic * n_other))


def document_frequencies(documents: DataFrame, text: str, terms: list[str]) -> tuple[dict[str, int], int]:
    """In how many of all documents each term is, and their number."""
    shared = documents.sparkSession.sparkContext.broadcast(frozenset(terms))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = shared.value
        found: Counter = Counter()
        n = 0
        for batch in batches:
            n += batch.num_rows
            for value in batch.column(0):
                if value.is_valid:
                    found.update(wanted.intersection(_WORD.findall(value.as_py().lower())))
        yield pa.RecordBatch.from_pydict({"term": pa.array([*found, None], pa.string()), "n": pa.array([*found.values(), n], pa.int64())})

    rows = documents.select(F.col(text)).mapInArrow(count, "term string, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    counts = dict(zip(*(rows.column(c).to_pylist() for c in ("term", "n"))))
    shared.destroy()
    total = counts.pop(None, 0)
    return counts, total


def fit(documents: DataFrame, labelled: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "label", examples: int = EXAMPLES) -> Model:
    """``labelled`` has ``doc_id`` and ``label`` (0 or 1) of the rows to learn from; their texts are in ``documents``."""
    labels = labelled.where(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("_id")).agg(F.max(label).alias("_y"))
    totals = {r["_y"]: r["count"] for r in labels.groupBy("_y").count().collect()}
    prior = totals.get(1, 0) / max(1, sum(totals.values()))
    if len(totals) < 2:
        return Model(None, prior, None)
    chosen = [labels.where(F.col("_y") == y).orderBy(F.xxhash64("_id"), "_id").limit(examples) for y in (0, 1)]
    sample = documents.select(F.col(doc_id).alias("_id"), F.col(text).alias("_t")).join(F.broadcast(chosen[0].unionByName(chosen[1])), "_id")

    # The sample is bounded: its distinct words with their counts are what reaches the driver.
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, CHUNK) for i in range(0, batch.num_rows, CHUNK)):
                words = [word_counts(t) for t in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.string()), part.column(1).cast(pa.int64()), pa.array([list(w) for w in words], pa.list_(pa.string())), pa.array([list(w.values()) for w in words], pa.list_(pa.int64()))], names=["_id", "_y", "_w", "_n"])

    vectors = written(sample.select("_id", "_y", "_t").mapInArrow(counted, "_id string, _y long, _w array<string>, _n array<long>"), "toxicity-examples")
    sizes = {r["_y"]: r["count"] for r in vectors.groupBy("_y").count().collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    words = vectors.select(F.explode("_w").alias("w"), "_y").groupBy("w").agg(F.sum("_y").alias("a"), F.count("*").alias("n")).toArrow()
    with_term = {w: (a, n - a) for w, a, n in zip(*(words.column(c).to_pylist() for c in ("w", "a", "n")))}
    df, total = document_frequencies(documents, text, list(with_term))
    weight = {w: (math.log((1 + total) / (1 + df.get(w, 0))) + 1) * class_factor(a, b, n1, n0) for w, (a, b) in with_term.items()}
    made = []
    for batch in vectors.toArrow().to_batches(max_chunksize=CHUNK):
        for i, y, own, counts in zip(*(c.to_pylist() for c in batch.columns)):
            made.append((i, y, list(map(sys.intern, own)), np.array(counts, np.int64)))
    index = Index.build(weight, {w: a + b for w, (a, b) in with_term.items()}, made)
    votes = np.array([index.vote(f, prior) for f in index.search(index.own_vectors(), without=list(range(len(made))))])
    share = {1: prior / max(n1, 1), 0: (1 - prior) / max(n0, 1)}
    weights = np.array([share[int(y)] for y in index.labels]) * len(index.ids)
    return Model(index, prior, isotonic(votes, index.labels.astype(float), weights))


def score(documents: DataFrame, model: Model, *, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns with ``score`` and ``evidence`` (the nearest examples, their cosines and labels)."""
    kept = carried(keep, ("score", "evidence"))
    evidence = T.ArrayType(T.StructType([T.StructField("example", T.StringType()), T.StructField("cosine", T.DoubleType()), T.StructField("label", T.IntegerType())]))
    schema = T.StructType([documents.schema[c] for c in kept] + [T.StructField("score", T.DoubleType()), T.StructField("evidence", evidence)])
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        to, m = to_arrow_schema(schema), shared.value
        for batch in (b.slice(i, CHUNK) for b in batches for i in range(0, b.num_rows, CHUNK)):
            judged = m.judge(batch.column(len(kept)).to_pylist())
            found = [[{"example": m.index.ids[i], "cosine": s, "label": int(m.index.labels[i])} for s, i in near] for _, near in judged]
            columns = [batch.column(i).cast(to.field(i).type) for i in range(len(kept))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([s for s, _ in judged], pa.float64()), pa.array(found, to.field(len(kept) + 1).type)], schema=to)

    return documents.select(*[F.col(c) for c in kept], F.col(text).alias("_text")).mapInArrow(run, schema)


def learn(documents: DataFrame, labels: DataFrame, *, label: str = "toxic") -> Model:
    """The model of the contract: it learns from the rows that aren't held out."""
    return fit(documents, labels.where(~held_out("doc_id", 5, 0)).select("doc_id", F.col(label).alias("label")))


def toxicity_report(documents: DataFrame, labels: DataFrame) -> DataFrame:
    scored = score(documents, learn(documents, labels), keep=["doc_id"])
    return scored.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")
