"""Approximate nearest neighbours by an adaptive scan over dimensions in probed lists.

*Index.* Centroids are fitted on at most ``SAMPLE`` vectors (those of the
smallest hashes of their ids); every vector goes to the list of its nearest
centroid. A list is kept in parts of about ``PART`` vectors by a hash of the id,
so a list that holds a third of all vectors is many parts. Vectors of each
length have an index of their own.

*Probing.* How many lists a query probes follows from the data: for ``TRIALS``
of the sampled vectors the true neighbours in the sample are found by brute
force, and so many of the nearest lists are probed that they hold ``TARGET`` of
these. Where vectors form clusters, that's a few lists; where they don't, it
has to be many.

*Search.* Vectors of a part and the queries that probe its list meet in one
group; both sides of it are bounded, since queries are dealt to parts of
``QUERIES`` too. In a group, vectors and queries are turned by one random
rotation, whose columns are then scanned in blocks of ``COLUMNS``. After each
block a hypothesis test compares a candidate's partial distance, scaled to all
columns, with the ``k``-th smallest distance so far: if it's larger by more than
chance (``EPSILON`` over the root of the columns seen) allows, the candidate is
abandoned. Survivors are measured on the original vectors in double precision.
The groups' best are merged by a ranking that keeps ``k`` rows a query in each
task before anything is shuffled.

Defined results: vectors that are null, zero, or have a null or non-finite
component take no part; vectors of different lengths aren't candidates of each
other; rows with a query's own id aren't its candidates; an id counts once among
a query's neighbours, by its nearest vector, however often its row is repeated;
a repeated query row is one query (with different vectors: their neighbours
together); with fewer than ``k`` candidates, all are found; ties go to the
smaller id; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from medialake.llm.common import written

K = 10
SAMPLE = 20_000
LIST, MAX_LISTS = 256, 4096
PART, QUERIES = 1024, 4096
COLUMNS = 16
EPSILON = 2.1
#: Sampled vectors whose neighbours in the sample are found by brute force, and the share of these that the probed lists have to hold.
TRIALS, TARGET = 256, 0.94


@dataclass
class Index:
    """``vectors`` (vec_id, list, part, vector as doubles) and what the driver knows of the lists."""

    vectors: DataFrame
    centroids: np.ndarray
    sizes: np.ndarray
    dimension: int
    probed: int


def usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(vec_id, vector) of the vectors that take part, of any length."""
    v = F.transform(F.col(embedding), lambda x: x.cast("double"))
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.select(F.col(vec_id).alias("vec_id"), v.alias("vector")).where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & F.coalesce(fine, F.lit(False)))


def k_means(x: np.ndarray, k: int, rounds: int = 8, seed: int = 11) -> np.ndarray:
    rng = np.random.default_rng(seed)
    distinct = np.unique(x, axis=0)
    c = distinct[rng.permutation(len(distinct))[:k]].copy()
    for _ in range(rounds):
        own = nearest_centroid(x, c)
        n = np.bincount(own, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


def nearest_centroid(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    norms = (c * c).sum(axis=1)
    return np.concatenate([np.argmin(norms - 2 * (x[i : i + 2048] @ c.T), axis=1) for i in range(0, len(x), 2048)]) if len(x) else np.zeros(0, np.int64)


def rotation(d: int, seed: int = 29) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d).astype(np.float64, copy=False)


def lists_to_probe(sample: np.ndarray, centroids: np.ndarray, k: int, target: float = TARGET, trials: int = TRIALS) -> int:
    """How many of a query's nearest lists hold ``target`` of the true ``k`` neighbours, measured on the sample."""
    own = nearest_centroid(sample, centroids)
    queries = sample[np.random.default_rng(5).permutation(len(sample))[:trials]]
    norms, c_norms = (sample**2).sum(axis=1), (centroids**2).sum(axis=1)
    places = []
    for q in queries:
        far = norms - 2 * (sample @ q)
        near = np.argsort(far, kind="stable")[1 : k + 1]
        place = np.empty(len(centroids), np.int64)
        place[np.argsort(c_norms - 2 * (centroids @ q), kind="stable")] = np.arange(len(centroids))
        places.append(place[own[near]])
    places = np.sort(np.concatenate(places)) if places else np.zeros(0, np.int64)
    return int(places[min(len(places) - 1, int(np.ceil(target * len(places))))]) + 1 if len(places) else len(centroids)


def build_index(vectors: DataFrame, dimension: int, n: int, *, sample: int = SAMPLE, k: int = K) -> Index:
    """Every vector of ``dimension`` (of ``usable`` vectors; there are ``n``) with its list."""
    d = dimension
    rows = vectors.where(F.size("vector") == d)
    drawn = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "vector").limit(sample).select("vector").toArrow()
    drawn = _matrix(drawn.column(0).combine_chunks(), d)
    centroids = k_means(drawn, max(1, min(MAX_LISTS, -(-n // LIST))))
    shared = vectors.sparkSession.sparkContext.broadcast(centroids)
    id_type = rows.schema["vec_id"].dataType
    schema = T.StructType([T.StructField("vec_id", id_type), T.StructField("list", T.IntegerType()), T.StructField("vector", T.ArrayType(T.DoubleType()))])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        to = to_arrow_schema(schema)
        for batch in batches:
            own = nearest_centroid(_matrix(batch.column(1), d), shared.value)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(to.field(0).type), pa.array(own, pa.int32()), batch.column(1).cast(to.field(2).type)], schema=to)

    assigned = written(rows.mapInArrow(assign, schema), "vector-lists")
    sizes = np.zeros(len(centroids), np.int64)
    for r in assigned.groupBy("list").count().collect():
        sizes[r["list"]] = r["count"]
    return Index(assigned, centroids, sizes, d, lists_to_probe(drawn, centroids, k))


def scan(ids: np.ndarray, x: np.ndarray, q_ids: np.ndarray, q: np.ndarray, k: int, turn: np.ndarray, columns: int = COLUMNS, epsilon: float = EPSILON) -> list[tuple[int, int, float]]:
    """The ``k`` nearest found of each query among the vectors of a part, as (query, place, distance)."""
    order = np.argsort(ids, kind="stable")
    ids, x = ids[order], x[order]
    d = x.shape[1]
    blocks = [(x @ turn[:, i : i + columns], q @ turn[:, i : i + columns]) for i in range(0, d, columns)]
    out = []
    for j in range(len(q)):
        alive = np.flatnonzero(ids != q_ids[j])
        # The first k candidates set the threshold, and so do those that come through.
        head, rest = alive[:k], alive[k:]
        kth = np.inf if len(head) < k else ((x[head] - q[j]) ** 2).sum(axis=1).max()
        survivors = [head]
        for begin in range(0, len(rest), 128):
            c = rest[begin : begin + 128]
            partial = np.zeros(len(c))
            for b, (xb, qb) in enumerate(blocks):
                partial += ((xb[c] - qb[j]) ** 2).sum(axis=1)
                seen = min(d, (b + 1) * columns)
                slack = 1 + epsilon / np.sqrt(seen) if seen < d else 1 + 1e-9
                near = partial * (d / seen) <= kth * slack * slack
                if not near.all():
                    c, partial = c[near], partial[near]
                if not len(c):
                    break
            if len(c):
                survivors.append(c)
                exact = ((x[np.concatenate(survivors)] - q[j]) ** 2).sum(axis=1)
                best = np.argsort(exact, kind="stable")[:k]
                survivors = [np.sort(np.concatenate(survivors)[best])]
                kth = exact[best[-1]] if len(best) == k else np.inf
        found = np.concatenate(survivors)
        exact = np.sqrt(((x[found] - q[j]) ** 2).sum(axis=1))
        out += [(j, int(order[found[i]]), float(exact[i])) for i in np.argsort(exact, kind="stable")[:k]]
    return out


def search(index: Index, queries: DataFrame, k: int = K, *, probed: int | None = None) -> DataFrame:
    """``query_id, rank, vec_id, score`` for ``queries`` (vec_id, vector); ``probed`` lists each, if given."""
    spark = queries.sparkSession
    d, least = index.dimension, probed or index.probed
    shared = spark.sparkContext.broadcast((index.centroids, index.sizes))
    id_type = index.vectors.schema["vec_id"].dataType
    probe_schema = T.StructType([T.StructField("vec_id", id_type), T.StructField("vector", T.ArrayType(T.DoubleType())), T.StructField("lists", T.ArrayType(T.IntegerType()))])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        to = to_arrow_schema(probe_schema)
        centroids, sizes = shared.value
        norms = (centroids**2).sum(axis=1)
        for batch in batches:
            far = norms - 2 * (_matrix(batch.column(1), d) @ centroids.T)
            lists = []
            for order in np.argsort(far, axis=1, kind="stable"):
                # Enough lists to hold k candidates beside the query's own row many times over.
                n = max(least, int(np.searchsorted(np.cumsum(sizes[order]), 4 * k + 1)) + 1)
                lists.append([int(i) for i in order[:n] if sizes[i]])
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(to.field(0).type), batch.column(1).cast(to.field(1).type), pa.array(lists, to.field(2).type)], schema=to)

    probes = written(queries.where(F.size("vector") == d).dropDuplicates().mapInArrow(probe, probe_schema), "query-probes").select("vec_id", "vector", F.explode("lists").alias("list"))
    wanted = {r["list"]: r["count"] for r in probes.groupBy("list").count().collect()}
    # Both sides of a list are dealt to parts; each part meets each part of the other side. At most MAX_LISTS rows.
    parts = [(i, -(-int(index.sizes[i]) // PART), -(-n // QUERIES)) for i, n in sorted(wanted.items())]
    if not parts:
        return nothing_found(spark, id_type)
    dealt = F.broadcast(spark.createDataFrame(parts, "list int, n_parts int, n_query_parts int"))
    here, there = F.pmod(F.xxhash64("vec_id"), F.col("n_parts")).cast("int"), F.pmod(F.xxhash64("vec_id"), F.col("n_query_parts")).cast("int")
    left = index.vectors.join(dealt, "list").select("list", here.alias("part"), F.explode(F.sequence(F.lit(0), F.col("n_query_parts") - 1)).alias("query_part"), "vec_id", "vector")
    right = probes.join(dealt, "list").select("list", F.explode(F.sequence(F.lit(0), F.col("n_parts") - 1)).alias("part"), there.alias("query_part"), "vec_id", "vector")
    keys = ["list", "part", "query_part"]
    found = T.StructType([T.StructField("query_id", id_type), T.StructField("vec_id", id_type), T.StructField("score", T.DoubleType())])
    turn = spark.sparkContext.broadcast(rotation(d))

    def meet(vectors: pa.Table, own: pa.Table) -> pa.Table:
        from pyspark.sql.pandas.types import to_arrow_schema

        to = to_arrow_schema(found)
        ids, q_ids = vectors.column("vec_id").combine_chunks(), own.column("vec_id").combine_chunks()
        if not len(ids) or not len(q_ids):
            return to.empty_table()
        x, q = _matrix(vectors.column("vector").combine_chunks(), d), _matrix(own.column("vector").combine_chunks(), d)
        numbers = ids.dictionary_encode().indices.to_numpy()
        kept = np.unique(np.column_stack([numbers, x]), axis=0, return_index=True)[1]  # repeated rows once
        ids, x, often = ids.take(pa.array(kept)), x[kept], int(np.bincount(numbers[kept]).max())
        # An id with several vectors counts once, so so many more rows have to be found.
        hits = scan(ids.to_numpy(zero_copy_only=False), x, q_ids.to_numpy(zero_copy_only=False), q, k * often, turn.value)
        at, places, scores = zip(*hits) if hits else ((), (), ())
        return pa.Table.from_arrays([q_ids.take(pa.array(at, pa.int64())).cast(to.field(0).type), ids.take(pa.array(places, pa.int64())).cast(to.field(1).type), pa.array(scores, pa.float64())], schema=to)

    candidates = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, found)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    once = candidates.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    return once.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nothing_found(spark: SparkSession, id_type: T.DataType) -> DataFrame:
    none = F.lit(None)
    return spark.range(0).select(none.cast(id_type).alias("query_id"), none.cast("int").alias("rank"), none.cast(id_type).alias("vec_id"), none.cast("double").alias("score"))


def neighbours(vectors: DataFrame, is_query, k: int = K, *, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score`` of the rows for whose ``vec_id`` the column function ``is_query`` holds, against all rows."""
    rows = usable(vectors, vec_id, embedding)
    found = nothing_found(vectors.sparkSession, rows.schema["vec_id"].dataType)
    lengths = rows.groupBy(F.size("vector").alias("d")).agg(F.count("*").alias("n"), F.count_if(is_query(F.col("vec_id"))).alias("q")).where("q > 0").orderBy("d").collect()
    parts = []
    for r in lengths:  # one length, as a rule
        index = build_index(rows, r["d"], r["n"], k=k)
        parts.append(search(index, index.vectors.where(is_query(F.col("vec_id"))).select("vec_id", "vector"), k))
    if len(parts) > 1:  # a query id may have vectors of several lengths
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
        merged = reduce(DataFrame.unionByName, parts).groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
        return merged.withColumn("rank", rank).where(F.col("rank") <= k).select(found.columns)
    return parts[0] if parts else found


def neighbours_report(embeddings: DataFrame) -> DataFrame:
    """The contract's queries against all rows."""
    return neighbours(embeddings, lambda i: i % 100 == 0)
