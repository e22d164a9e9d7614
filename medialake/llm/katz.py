"""Katz backoff language model: bigrams, unigrams, unknown word.

Counts of words and of pairs of words are taken over all training documents.
Counts up to ``LARGEST`` are discounted by Good and Turing's estimate; what the
pairs after a context lose goes to the words not seen after it, in proportion
to their unigram probability, by a weight that makes the context's
probabilities sum to one exactly. Larger counts stay as they are, but for a context
all of whose counts are large: it would have nothing to give, so half a count of its
total is set aside.
Unigrams lose to one unknown word in the same way. A token is evaluated recursively: the pair if it was seen, else the
context's weight times the unigram, else the unknown word.

*Unigrams* are counted first and written as a table. The ``HOT`` most frequent
at most are known to every task, with their counts: pairs of them are short,
and nothing has to be looked up for them.

*Pairs* are dealt into buckets by their context; a context with a large share of
all tokens is dealt by both words. A task sends a bucket its distinct pairs and
the rows they come from, packed, so a pair of any frequency is one entry a
chunk (at worst an entry a pair, which is what an ordinary shuffle of pairs
sends). A bucket adds up the counts, so it knows of each token whether the pair
was seen and how often, and writes what the scores still need into a table
partitioned by kind: per row, the numbers of seen tokens by count; the
contexts' sums; the contexts of the row's unseen pairs and its rare words. The
last are joined to contexts and unigrams as ordinary rows; the dealt contexts,
``HOT`` at most, are broadcast there.

Words are compared by 63-bit hashes.

Defined results: a null text is empty and is scored as the end token alone; a
repeated row is returned as often (and counts as often in training); without
training documents every word is unknown, with probability one; other columns
are ignored. Rows of the same id are told apart by a row number of their own.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type

from medialake.llm.common import held_out, shared_dir, written

LARGEST = 5
#: No word has white space in it.
END, START = " ", "  "
#: Words that every task knows, at most.
HOT = 1 << 18
#: Tokens that a task sends together, and tokens of a bucket on average.
CHUNK, BUCKET = 1_000_000, 1_000_000
#: Words whose codes a task remembers.
MEMO = 400_000

_U = np.uint64
_COLD, _START = _U(1 << 63), _U(1 << 62)
ROW, PARTIAL, CONTEXT, BACKOFF, RARE, RARE_PAIR, PAIR, HOT_BACKOFF = range(8)
_CLASSES = [f"c{r}" for r in range(1, LARGEST + 1)]


def good_turing(counts: dict[int, int], largest: int = LARGEST) -> dict[int, float]:
    """Factors for counts 1..largest from the numbers of types with each count.

    Where the estimate isn't between 0 and 1 (too few types), half a count is
    taken off instead.
    """
    n1 = counts.get(1, 0)
    rest = (largest + 1) * counts.get(largest + 1, 0) / n1 if n1 else 1.0
    out = {}
    for r in range(1, largest + 1):
        n, above = counts.get(r, 0), counts.get(r + 1, 0)
        d = ((r + 1) * above / (r * n) - rest) / (1 - rest) if n and rest < 1 else -1.0
        out[r] = d if 0 < d < 1 else 1 - 0.5 / r
    return out


@dataclass
class Model:
    """Tables ``unigrams`` (w, c, p) and ``contexts`` (h, scale, alpha), totals and discount factors; words are hashes."""

    unigrams: DataFrame
    contexts: DataFrame
    tokens: int
    types: int
    unknown: float
    factors: dict[int, float]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def _hashes(words: list[bytes]) -> np.ndarray:
    if not words:
        return np.zeros(0, np.uint64)
    return pd.util.hash_array(np.array(words, dtype=object), categorize=False) | _COLD


def _words(text: str | None) -> list[bytes]:
    """Lower-cased words and the end token."""
    return [*(text.encode().lower().split() if text else ()), END.encode()]


def count_words(documents: DataFrame, train: Column, text: str) -> DataFrame:
    """(w, c): every training word's hash and count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def flush():
            n = len(counts)
            out = pa.RecordBatch.from_arrays([pa.array(_hashes(list(counts)).view(np.int64)), pa.array(np.fromiter(counts.values(), np.int64, n))], names=["w", "c"])
            counts.clear()
            return out

        for batch in batches:
            for value in batch.column(0):
                counts.update(_words(value.as_py()))
                if len(counts) > MEMO:
                    yield flush()
        yield flush()

    rows = documents.where(F.coalesce(train, F.lit(False))).select(F.col(text).alias("text")).mapInArrow(run, "w long, c long")
    return rows.groupBy("w").agg(F.sum("c").alias("c"))


def _count_classes(table: DataFrame) -> dict[int, int]:
    return {r["c"]: r["n"] for r in table.where(F.col("c").between(1, LARGEST + 1)).groupBy("c").agg(F.count("*").alias("n")).collect()}


def _frequent(words: DataFrame) -> pd.DataFrame:
    """The most frequent words, ``HOT`` at most, by hash: all whose count lies in the upper of 8 steps an octave."""
    step = F.floor(F.log2("c") * 8).cast("int")
    sizes = sorted(((r["s"], r["n"]) for r in words.groupBy(step.alias("s")).agg(F.count("*").alias("n")).collect()), reverse=True)
    total, least = 0, None
    for s, n in sizes:
        total += n
        if total > HOT:
            break
        least = s
    found = words.where(step >= F.lit(least if least is not None else 1 << 20)).select("w", "c", "p").toPandas()
    found["w"] = found["w"].to_numpy(np.int64).view(np.uint64)
    return found.sort_values("w", ignore_index=True)


@dataclass
class Shared:
    """What every task knows: frequent words' hashes (sorted), counts and probabilities; the split contexts; totals."""

    hashes: np.ndarray
    counts: np.ndarray
    p: np.ndarray
    split: np.ndarray
    starts: int
    buckets: int
    tokens: int
    types: int

    def code(self, hashes: np.ndarray) -> np.ndarray:
        """A frequent word's place, or the hash."""
        if not len(self.hashes):
            return hashes
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, at.astype(np.uint64), hashes)

    def hash(self, codes: np.ndarray) -> np.ndarray:
        out = codes.copy()
        known = codes < len(self.hashes)
        out[known] = self.hashes[codes[known].astype(np.int64)]
        return out

    def bucket(self, h: np.ndarray, w: np.ndarray) -> np.ndarray:
        salted = np.where(np.isin(h, self.split), h ^ _mix(w), h)
        return (_mix(salted ^ _U(0x632BE59BD9B4E019)) >> _U(33)) % _U(self.buckets)


def _split_hashes(shared: Shared) -> list[int]:
    """The words' hashes of the split contexts."""
    return shared.hash(shared.split).view(np.int64).tolist()


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays by byte planes, compressed."""
    parts = []
    for a in arrays:
        a = np.ascontiguousarray(a)
        raw = a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes()
        small = pa.compress(raw, codec="zstd", asbytes=True) if raw else b""
        parts.append(np.array([len(a), len(small)], np.int64).tobytes() + small)
    return b"".join(parts)


def _unpack(blob: bytes, *kinds: type) -> list[np.ndarray]:
    out, at = [], 0
    for kind in kinds:
        n, size = np.frombuffer(blob, np.int64, 2, at).tolist()
        at += 16
        width = np.dtype(kind).itemsize
        raw = pa.decompress(blob[at : at + size], n * width, codec="zstd", asbytes=True) if n else b""
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, n).T).view(kind).reshape(n))
        at += size
    return out


_KINDS = (np.int64, np.uint8, np.uint32, np.uint32, np.uint32, np.uint32, np.uint64)


def _sent(shared: Shared, first: int, trained: list[bool], docs: np.ndarray, codes: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """(bucket, packed pairs) of a chunk: row base, training bits, context steps, words, numbers of tokens, rows, rare words."""
    begins = np.concatenate([[0], ends[:-1]])
    before = np.roll(codes, 1)
    before[begins] = _START
    hot = _U(len(shared.hashes))
    rare = np.unique(codes[codes >= hot])

    def local(c):
        out = c.astype(np.uint32)
        cold = c >= hot
        out[cold] = np.searchsorted(rare, c[cold]).astype(np.uint32) + np.uint32(hot + 1)
        out[c == _START] = np.uint32(hot)
        return out

    key = local(before).astype(np.uint64) << _U(32) | local(codes)
    order = np.argsort(key, kind="stable")
    bucket = shared.bucket(before, codes)[order].astype(np.uint32 if shared.buckets > 65535 else np.uint16)
    order = order[np.argsort(bucket, kind="stable")]
    bucket = np.sort(bucket, kind="stable")
    key, docs = key[order], docs[order]
    edges = np.flatnonzero(np.diff(bucket)) + 1
    bits = np.packbits(np.array(trained, bool))
    for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), len(bucket)]):
        k = key[lo:hi]
        heads = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        h, w = (k[heads] >> _U(32)).astype(np.uint32), k[heads].astype(np.uint32)
        used = np.unique(np.concatenate([h[h > hot], w[w > hot]]))
        for x in (h, w):
            x[x > hot] = np.searchsorted(used, x[x > hot]).astype(np.uint32) + np.uint32(hot + 1)
        steps = np.diff(h, prepend=np.uint32(0))
        times = np.diff(np.append(heads, hi - lo)).astype(np.uint32)
        yield int(bucket[lo]), _pack(np.array([first], np.int64), bits, steps, w, times, docs[lo:hi], rare[(used - np.uint32(hot + 1)).astype(np.int64)])


def _encoder(known, id_type: pa.DataType):
    """Documents (doc_id, row, train, text) to rows' own sums and the buckets' packed pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared: Shared = known.value
        memo: dict[bytes, int] = {}
        base = np.append(np.log10((shared.counts + 1) / (shared.tokens + shared.types + 1)), 0.0)
        hot = len(shared.hashes)
        ids, rows, trained, lengths, parts = [], [], [], [], []

        def flush():
            codes, n = np.concatenate(parts), np.array(lengths)
            ends = np.cumsum(n)
            docs = np.repeat(np.arange(len(n), dtype=np.uint32), n)
            place = np.minimum(codes, _U(hot)).astype(np.int64)
            sums = np.bincount(docs, base[place], len(n))
            found = np.bincount(docs[place < hot], minlength=len(n))
            size = len(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.array(rows) % shared.buckets, pa.int64()), pa.nulls(size, pa.binary()), pa.array(ids, id_type), pa.array(rows, pa.int64()), pa.array(n, pa.int64()), pa.array(found, pa.int64()), pa.array(sums)], names=["bucket", "pairs", "doc_id", "row", "n", "k", "x"])
            for b, blob in _sent(shared, rows[0], trained, docs, codes, ends):
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.int64()), pa.array([blob], pa.binary()), pa.nulls(1, id_type), *[pa.nulls(1, t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.float64())]], names=["bucket", "pairs", "doc_id", "row", "n", "k", "x"])
            for x in (ids, rows, trained, lengths, parts):
                x.clear()

        total = 0
        for batch in batches:
            for i in range(batch.num_rows):
                words = _words(batch.column(3)[i].as_py())
                new = [w for w in set(words) if w not in memo]
                if new:
                    if len(memo) > MEMO:
                        memo.clear()
                        new = list(set(words))
                    memo.update(zip(new, shared.code(_hashes(new)).tolist()))
                parts.append(np.fromiter(map(memo.__getitem__, words), np.uint64, len(words)))
                ids.append(batch.column(0)[i].as_py())
                rows.append(batch.column(1)[i].as_py())
                trained.append(batch.column(2)[i].as_py())
                lengths.append(len(words))
                total += len(words)
                if total >= CHUNK:
                    yield from flush()
                    total = 0
        if ids:
            yield from flush()

    return run


def _sums(at: np.ndarray, n: int, weights: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(at, weights, n)


def _judged(shared: Shared, blobs: list[bytes], with_pairs: bool) -> Iterator[dict]:
    """A bucket's pairs, counted, as columns of the table of kinds.

    The tokens' rows stay packed; one chunk's are unpacked at a time.
    """
    hot = len(shared.hashes)
    hs, ws, cs = [], [], []
    for blob in blobs:
        _, bits, steps, w, times, docs, rare = _unpack(blob, *_KINDS)
        h = np.cumsum(steps, dtype=np.uint32)
        train = np.unpackbits(bits)
        for local, codes in ((h, hs), (w, ws)):
            own, cold = local.astype(np.uint64), local > hot
            own[local == hot] = _START
            own[cold] = rare[(local[cold] - np.uint32(hot + 1)).astype(np.int64)]
            codes.append(own)
        begins = np.cumsum(times, dtype=np.int64) - times
        cs.append(np.add.reduceat(train[docs].astype(np.int64), begins))
    h_codes, h_at = np.unique(np.concatenate(hs), return_inverse=True)
    w_codes, w_at = np.unique(np.concatenate(ws), return_inverse=True)
    del hs, ws
    pairs, at = np.unique(h_at.astype(np.uint64) << _U(32) | w_at.astype(np.uint64), return_inverse=True)
    del h_at, w_at
    h, w = (pairs >> _U(32)).astype(np.int64), (pairs & _U(0xFFFFFFFF)).astype(np.int64)
    c = _sums(at, len(pairs), np.concatenate(cs)).astype(np.int64)
    seen = c > 0
    nh = len(h_codes)
    classes = [_sums(h[c == r], nh).astype(np.int64) for r in range(1, LARGEST + 1)]
    in_bucket = _sums(h, nh, c).astype(np.int64)
    split = np.isin(h_codes, shared.split)
    hc = in_bucket.copy()
    own = split & (h_codes < hot)
    hc[own] = shared.counts[h_codes[own].astype(np.int64)]
    hc[split & (h_codes == _START)] = shared.starts
    frequent = w_codes < hot
    p = np.zeros(len(w_codes))
    p[frequent] = shared.p[w_codes[frequent].astype(np.int64)]
    there = in_bucket > 0
    # A context without any small count sets half a count aside; a split one's small counts may lie in other buckets (see score).
    alone = (sum(classes) == 0) & ~split & there
    whole_h = shared.hash(h_codes).view(np.int64)
    whole_w = w_codes.view(np.int64)
    yield {"kind": CONTEXT, "h": whole_h[there], "n": in_bucket[there], "k": _sums(h[c == LARGEST + 1], nh).astype(np.int64)[there], "x": _sums(h[seen], nh, p[w[seen]])[there], **{k: v[there] for k, v in zip(_CLASSES, classes)}}
    rare_pair = seen & ~frequent[w]
    yield {"kind": RARE_PAIR, "h": whole_h[h[rare_pair]], "w": whole_w[w[rare_pair]]}
    if with_pairs:
        yield {"kind": PAIR, "h": whole_h[h[seen]], "w": shared.hash(w_codes[w[seen]]).view(np.int64), "n": c[seen]}
    # What a token adds by itself: the logarithm of large counts, over the context's; or of a frequent word's probability.
    total = np.maximum(hc, 1).astype(float)
    over = np.log10(np.where(alone, (total - 0.5) / total, 1.0) / total)
    with np.errstate(divide="ignore"):
        value = np.where(seen, np.where(c > LARGEST, np.log10(np.maximum(c, 1)), 0.0) + over[h], np.where(frequent[w], np.log10(p[w]), 0.0))
    level = np.where(c > LARGEST, 0, c)
    asks = ~seen & (hc > 0)[h]
    start = 0
    for blob in blobs:
        base, _, _, words, times, docs, _ = _unpack(blob, *_KINDS)
        first, n = int(base[0]), len(words)
        pair = np.repeat(at[start : start + n], times)
        start += n
        size = int(docs.max()) + 1
        by = np.bincount(docs.astype(np.int64) * (LARGEST + 1) + level[pair], minlength=size * (LARGEST + 1)).reshape(size, LARGEST + 1)
        some = np.bincount(docs, minlength=size) > 0
        yield {"kind": PARTIAL, "row": first + np.flatnonzero(some), "x": _sums(docs, size, value[pair])[some], **{k: by[some, i + 1] for i, k in enumerate(_CLASSES)}}
        for kind, wanted in ((BACKOFF, asks & ~split[h]), (HOT_BACKOFF, asks & split[h])):
            wanted = wanted[pair]
            who, back = np.unique(docs[wanted].astype(np.uint64) << _U(32) | h[pair[wanted]].astype(np.uint64), return_inverse=True)
            yield {"kind": kind, "row": first + (who >> _U(32)).astype(np.int64), "h": whole_h[(who & _U(0xFFFFFFFF)).astype(np.int64)], "n": _sums(back, len(who)).astype(np.int64)}
        cold = ~frequent[w[pair]]
        who, back = np.unique(docs[cold].astype(np.uint64) << _U(32) | w[pair[cold]].astype(np.uint64), return_inverse=True)
        yield {"kind": RARE, "row": first + (who >> _U(32)).astype(np.int64), "w": whole_w[(who & _U(0xFFFFFFFF)).astype(np.int64)], "n": _sums(back, len(who)).astype(np.int64), "k": _sums(back, len(who), ~seen[pair[cold]]).astype(np.int64)}


def _counter(known, schema: T.StructType, with_pairs: bool):
    """Rows of a bucket, one bucket after the other, to the table of kinds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to, shared = to_arrow_schema(schema), known.value

        def table(columns: dict) -> pa.RecordBatch:
            size = max(len(v) for k, v in columns.items() if k != "kind")
            made = columns | {"kind": np.full(size, columns["kind"])}
            return pa.RecordBatch.from_arrays([pa.array(made[f.name]).cast(f.type) if f.name in made else pa.nulls(size, f.type) for f in to], schema=to)

        blobs, now = [], None
        for batch in batches:
            own = batch.filter(pc.is_null(batch.column(1)))
            if own.num_rows:
                yield table({"kind": ROW, **{k: own.column(i) for i, k in ((2, "doc_id"), (3, "row"), (4, "n"), (5, "k"), (6, "x"))}})
            rest = batch.filter(pc.is_valid(batch.column(1)))
            for b, blob in zip(rest.column(0).to_pylist(), rest.column(1)):
                if b != now and blobs:
                    yield from map(table, _judged(shared, blobs, with_pairs))
                    blobs = []
                now = b
                blobs.append(blob.as_py())
        if blobs:
            yield from map(table, _judged(shared, blobs, with_pairs))

    return run


def _seen_after(rows: DataFrame, late: dict[int, float]) -> DataFrame:
    """(row, x): what the scale of the contexts ``late`` (hash: its logarithm) adds for each row's pairs that occur in training."""
    start = int(_START)  # the code by which contexts know it

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.array(sorted(late), np.int64)
        for batch in batches:
            for row, train, text in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2))):
                w = _hashes(_words(text)).view(np.int64)
                h = np.concatenate([[start], w[:-1]])
                keep = np.isin(h, wanted)
                n = int(keep.sum())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, row)), pa.array(np.full(n, train)), pa.array(h[keep]), pa.array(w[keep])], names=["row", "train", "h", "w"])

    pairs = rows.select("row", "train", "text").mapInArrow(run, "row long, train boolean, h long, w long")
    counted = pairs.groupBy("row", "train", "h", "w").agg(F.count("*").alias("n"))
    seen = pairs.where("train").select("h", "w").distinct()
    x = reduce(lambda out, h: F.when(F.col("h") == h, late[h]).otherwise(out), late, F.lit(0.0))
    return counted.join(seen, ["h", "w"]).groupBy("row").agg(F.sum(F.col("n") * x).alias("x"))


def score(documents: DataFrame, train: Column, *, doc_id: str = "doc_id", text: str = "text", pairs_too: bool = False) -> tuple[DataFrame, Model, DataFrame]:
    """``doc_id, n_tokens, n_known, base_score, score`` of every row, the model learned from the rows where ``train``, and the table of kinds.

    With ``pairs_too``, the table has each seen pair's count, too (kind ``PAIR``).
    """
    spark = documents.sparkSession
    words = written(count_words(documents, train, text), "unigrams")
    head = words.agg(F.sum("c").alias("n"), F.count("*").alias("v")).head()
    n, v = int(head["n"] or 0), int(head["v"])
    c = F.col("c").cast("double")
    classes = _count_classes(words)
    # The unknown word has what the discounts leave, or one count's share if they leave nothing.
    ones = good_turing(classes)
    left = sum((1 - ones[r]) * r * classes.get(r, 0) for r in ones) / max(n, 1)
    unknown = 1.0 if not n else left if left > 1e-12 else 1.0 / (n + 1)
    scale = 1.0 if left > 1e-12 else 1 - unknown
    p = reduce(lambda out, r: F.when(F.col("c") == r, F.lit(ones[r] * r)).otherwise(out), ones, c) / F.lit(float(max(n, 1))) * F.lit(scale)
    unigrams = words.select("w", "c", p.alias("p"))
    hot = _frequent(unigrams)
    counts, end = hot["c"].to_numpy(np.int64), _hashes([END.encode()]).view(np.int64)[0]
    starts = words.where(F.col("w") == F.lit(int(end))).agg(F.sum("c")).head()[0] or 0
    buckets = -(-n // BUCKET) or 1
    split = np.flatnonzero(counts > n / (4 * buckets)).astype(np.uint64)
    if starts > n / (4 * buckets):
        split = np.append(split, _START)
    known = spark.sparkContext.broadcast(Shared(hot["w"].to_numpy(np.uint64), counts, hot["p"].to_numpy(float), split, int(starts), int(buckets), n, v))

    id_field = T.StructField("doc_id", documents.schema[doc_id].dataType)
    rows = documents.select(F.col(doc_id).alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.coalesce(train, F.lit(False)).alias("train"), F.col(text).alias("text"))
    longs = lambda *names: [T.StructField(x, T.LongType()) for x in names]
    sent = T.StructType([*longs("bucket"), T.StructField("pairs", T.BinaryType()), id_field, *longs("row", "n", "k"), T.StructField("x", T.DoubleType())])
    kinds = T.StructType([T.StructField("kind", T.IntegerType()), id_field, *longs("row", "h", "w", "n", "k"), T.StructField("x", T.DoubleType()), *longs(*_CLASSES)])
    dealt = rows.mapInArrow(_encoder(known, to_arrow_type(id_field.dataType)), sent).repartition("bucket").sortWithinPartitions("bucket")
    path = f"{shared_dir(spark)}/katz-{uuid.uuid4().hex}"
    dealt.mapInArrow(_counter(known, kinds, pairs_too), kinds).write.partitionBy("kind").parquet(path)
    table = spark.read.schema(T.StructType([*kinds.fields[1:], kinds.fields[0]])).parquet(path)
    of = lambda kind: table.where(F.col("kind") == kind)

    # Contexts: counts of counts give the pairs' discounts; rare words' probabilities come by a join.
    stats = of(CONTEXT).select("h", "n", "x", *_CLASSES)
    counted = of(CONTEXT).agg(*[F.sum(k).alias(k) for k in [*_CLASSES, "k"]]).head()
    factors = good_turing({r: counted[k] or 0 for r, k in enumerate([*_CLASSES, "k"], 1)})
    none = [F.lit(0).cast("long").alias(k) for k in _CLASSES]
    rare = of(RARE_PAIR).select("h", "w").join(unigrams.select("w", "p"), "w").select("h", F.lit(0).cast("long").alias("n"), F.col("p").alias("x"), *none)
    sums = stats.unionByName(rare).groupBy("h").agg(*[F.sum(k).alias(k) for k in ("n", "x", *_CLASSES)])
    lost = reduce(lambda a, b: a + b, [F.col(k) * F.lit(r * (1 - factors[r])) for r, k in enumerate(_CLASSES, 1)])
    small = reduce(lambda a, b: a + b, [F.col(k) for k in _CLASSES])
    scaled = sums.withColumn("scale", F.when(small == 0, (F.col("n") - 0.5) / F.col("n")).otherwise(F.lit(1.0)))
    contexts = scaled.select("h", "scale", ((1 - F.col("scale") * (1 - lost / F.col("n"))) / (1 - F.col("x"))).alias("alpha"))
    dealt_out = spark.range(1).select(F.explode(F.from_json(F.lit(str(_split_hashes(known.value))), "array<bigint>")).alias("h"))
    few_contexts = F.broadcast(contexts.join(F.broadcast(dealt_out), "h"))
    # Split contexts that turn out to have large counts only: at most as many as were split, as a rule none.
    few_sums = stats.join(F.broadcast(dealt_out), "h").groupBy("h").agg(F.sum("n").alias("n"), *[F.sum(k).alias(k) for k in _CLASSES]).where(small == 0)
    late = {r["h"]: float(np.log10((r["n"] - 0.5) / r["n"])) for r in few_sums.select("h", "n").collect()}

    zero, nought = F.lit(0).cast("long"), F.lit(0.0)
    part = lambda df, ident, n, k, b, s: df.select("row", ident.alias("doc_id"), n.alias("n"), k.alias("k"), b.alias("b"), s.alias("s"))
    nobody = F.lit(None).cast(id_field.dataType)
    by_class = reduce(lambda a, b: a + b, [F.col(k) * F.lit(float(np.log10(r * factors[r]))) for r, k in enumerate(_CLASSES, 1)])
    backed = of(BACKOFF).select("row", "h", "n").join(contexts, "h").unionByName(of(HOT_BACKOFF).select("row", "h", "n").join(few_contexts, "h"))
    looked = of(RARE).select("row", "w", "n", "k").join(unigrams, "w", "left")
    base = F.col("n") * F.log10((F.coalesce("c", F.lit(0)) + 1) / F.lit(float(n + v + 1)))
    every = (
        part(of(ROW), F.col("doc_id"), F.col("n"), F.col("k"), F.col("x"), nought)
        .unionByName(part(of(PARTIAL), nobody, zero, zero, nought, F.col("x") + by_class))
        .unionByName(part(backed, nobody, zero, zero, nought, F.col("n") * F.log10("alpha")))
        .unionByName(part(looked, nobody, zero, F.when(F.col("c").isNotNull(), F.col("n")).otherwise(zero), base, F.col("k") * F.log10(F.coalesce("p", F.lit(unknown)))))
    )
    if late:
        every = every.unionByName(part(_seen_after(rows, late), nobody, zero, zero, nought, F.col("x")))
    out = every.groupBy("row").agg(F.first("doc_id", ignorenulls=True).alias("doc_id"), F.sum("n").alias("n_tokens"), F.sum("k").alias("n_known"), F.sum("b").alias("base_score"), F.sum("s").alias("score"))
    return out.drop("row"), Model(unigrams, contexts, n, v, unknown, factors), table


def language_model_report(documents: DataFrame) -> DataFrame:
    rows, model, _ = score(documents, ~held_out("doc_id", 7, 2))
    return rows.select("doc_id", held_out("doc_id", 7, 2).alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")
