"""N-gram Jaccard self-join by parity sketches, as classes of linked documents.

A document's set is its distinct shingles of ``width`` words (the whole sequence
if it has fewer). Two documents link when ``q * |A & B| >= p * |A | B|``, which
means that at most ``D = (q - p) * (|A| + |B|) / (q + p)`` shingles are in one
set only.

*Sketch.* Every shingle flips one bit of a very wide parity sketch, so the
Hamming distance of two sketches is at most the symmetric difference. The
sketch is cut into ``D + 1`` blocks, so sketches within ``D`` agree in a block
(pigeonhole). A block is kept as the XOR of its shingles' 64-bit hashes. ``D``
is that of a size band; sizes of linked documents lie in the same or in
neighbouring bands, so a document has the blocks of its own band and the next.
A block without shingles says little; for small ``D`` it's refined by a second
cut of the whole sketch into ``D + 1`` blocks, for others it's left out (that
all blocks two linked documents agree in are empty has a chance below 1e-9).

*Join.* Documents of equal sets are one class from the start. Classes meet in
their block keys, sorted, as a stream: each meets the first of its key. Links
are verified on the shingles, after a comparison of sizes and of a short parity
sketch. Where a key's classes don't all become one component, those of different
components are compared with each other, by sizes and short sketches inside the
key's group; a key with more than ``GROUP`` classes is too large for that, so its
classes meet again by prefix filtering: in order of rarity, sets within ``D``
share one of their ``D + 1`` rarest shingles. So no link between components is
lost, and the pairs inside a group of near copies aren't listed.

Shingles, sets and blocks are compared by 64-bit hashes.

Defined results: a null or wordless text has an empty set and is linked with
nothing (its component is its own id); a repeated row is returned as often; an
empty table gives an empty table; other columns are ignored. Ids are compared by
their own order; the smallest names the component.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from medialake.llm.common import written

WIDTH = 5
#: Similarity p / q.
P, Q = 8, 10
#: Below this D, empty blocks are refined.
REFINED = 24
#: 64-bit words of each of the two short parity sketches, of both and what is said of them, and the size from which on sets are sampled for them.
HALF, SHORT, SAMPLED = 7, 15, 512
MEMO = 400_000
#: Bits of the map of wanted ids that is sent to the workers, at least and at most (32 MB).
ID_BITS = 1 << 23, 1 << 28
#: Members of a key that are compared directly; more go by their rarest shingles.
GROUP = 1000
#: Of a key with more members, only pairs that join parts of it are verified, in ``ROUNDS`` rounds at most before all others are.
SPARE, ROUNDS = 64, 3
#: For each so many of its pairs, a class's pairs are dealt to one part more.
PAIRS = 64

_U = np.uint64
_ODD = _U(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


#: Bytes of a text that are hashed at once.
PIECE = 1 << 14
_BASE = 0xD1342543DE82EF95
_DIGITS = mix(np.arange(1, 257, dtype=np.uint64) * _ODD)
_PLACES, _DIVISORS = (np.cumprod(np.append(_U(1), np.full(PIECE - 1, x, np.uint64))) for x in (_BASE, pow(_BASE, -1, 1 << 64)))


def word_hashes(raw: bytes) -> np.ndarray:
    """A 64-bit hash of each word ``[^\\x20\\x09-\\x0D]+``, in order.

    A word's bytes are the digits of a number in an odd base, modulo 2**64. Sums of all digits by their places in the text give every word's
    number at once, and an odd base can be divided by, which takes a word's place out again.
    """
    b = np.frombuffer(raw, np.uint8)
    blank = np.ones(len(b) + 2, bool)
    blank[1:-1] = (b == 0x20) | (b - np.uint8(0x09) < 5)
    edges = np.flatnonzero(blank[1:] != blank[:-1])
    starts, sums = edges[::2], np.zeros(len(edges), np.uint64)
    factors, total, lo = _DIVISORS[starts % PIECE], 0, 0
    for at in range(0, len(b), PIECE):
        part = b[at : at + PIECE]
        c = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_DIGITS[part] * _PLACES[: len(part)], out=c[1:])
        hi = int(np.searchsorted(edges, at + PIECE, "right"))
        scale = pow(_BASE, at, 1 << 64)
        sums[lo:hi] = c[edges[lo:hi] - at] * _U(scale) + _U(total)
        total, lo = (total + scale * int(c[-1])) % (1 << 64), hi
    if len(b) > PIECE:
        factors = factors * np.array([pow(_BASE, -at, 1 << 64) for at in range(0, len(b), PIECE)], np.uint64)[starts // PIECE]
    return mix((sums[1::2] - sums[::2]) * factors)


class Shingler:
    """Distinct shingle hashes of a text."""

    def __init__(self, width: int):
        self.width = width

    def __call__(self, text: str | None) -> np.ndarray:
        h = word_hashes(text.encode().lower()) if text else np.zeros(0, np.uint64)
        if not len(h):
            return h
        n = min(self.width, len(h))
        out = np.full(len(h) - n + 1, n, np.uint64)
        for i in range(n):
            out = (out ^ (out >> _U(29))) * _ODD + h[i : i + len(out)]
        out = np.sort(mix(out))
        return out[np.append(True, out[1:] != out[:-1])]


def digest(s: np.ndarray) -> int:
    """A 64-bit hash of a set, signed."""
    if not len(s):
        return 0
    a, b = np.add.reduce(mix(s ^ _U(0x5851F42D4C957F2D))), np.bitwise_xor.reduce(mix(s ^ _U(0x14057B7EF767814F)))
    return int(mix(np.array([a ^ (b << _U(17)) ^ (b >> _U(47)) ^ _U(len(s))]))[0].astype(np.int64))


class Bands:
    """Size bands: the larger of two linked sets lies in the band of the smaller or the next."""

    def __init__(self, p: int, q: int):
        self.p, self.q, self.lows = p, q, [1]

    def reach(self, n: int) -> None:
        while self.lows[-1] <= n:
            self.lows.append(self.q * self.lows[-1] // self.p + 1)

    def of(self, n: int) -> int:
        self.reach(n)
        return int(np.searchsorted(self.lows, n, side="right")) - 1

    def errors(self, band: int) -> int:
        """The most shingles that are in one set only, if the larger set is in ``band``."""
        while len(self.lows) < band + 2:
            self.lows.append(self.q * self.lows[-1] // self.p + 1)
        return (self.q - self.p) * 2 * (self.lows[band + 1] - 1) // (self.q + self.p)


def _blocks(s: np.ndarray, n: int, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """XOR and number of the shingles in each of ``n`` blocks."""
    h = np.sort(mix(s + _U(salt * int(_ODD) & (1 << 64) - 1)))
    where = (((h >> _U(32)) * _U(n)) >> _U(32)).astype(np.int64)  # grows with the hash, so its order is theirs
    values = np.zeros(n, np.uint64)
    counts = np.bincount(where, minlength=n)
    first = np.flatnonzero(np.diff(where, prepend=-1))
    values[where[first]] = np.bitwise_xor.reduceat(h, first)
    return values, counts


def block_keys(s: np.ndarray, bands: Bands) -> np.ndarray:
    """Join keys of a set: the blocks of its own band and of the next."""
    out = []
    own = bands.of(len(s))
    for band in (own, own + 1):
        d = bands.errors(band)
        if d == 0:
            continue  # only equal sets link
        values, counts = _blocks(s, d + 1, 2 * band)
        place = np.arange(d + 1, dtype=np.uint64)
        tag = _U(band) << _U(33)
        full = counts > 0
        out.append(mix(values[full] ^ mix(place[full] | tag)))
        if d < REFINED and not full.all():
            again, n_again = _blocks(s, d + 1, 2 * band + 1)
            second = mix(again ^ mix((place << _U(16)) | (tag ^ _U(1 << 63)) | (n_again > 0).astype(np.uint64) << _U(32)))
            for j in place[~full]:
                out.append(mix(second ^ mix(np.array([j + _U(77)]))))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def short_sketch(s: np.ndarray) -> np.ndarray:
    """Parities of the shingles at each of 64 * HALF bits, for two samples of them, and a number that says which.

    A parity sketch's Hamming distance is at most the symmetric difference, which says nothing where that is larger than the sketch. So of sets from
    ``SAMPLED`` shingles on, each twice that size halves the sample (by hash, so it's the same of all sets); the second sketch has the next sample, for sets that
    begin there. Sets too small to link with one that is sampled have an empty second one. The number: twice the halvings, and one if there's a second.
    """
    h = mix(s ^ _U(0xD1B54A32D192ED03))
    level, second = (len(s) // SAMPLED).bit_length(), len(s) >= 3 * SAMPLED // 4
    parts = []
    for i in (level, level + 1) if second else (level,):
        of = h[h & _U((1 << i) - 1) == 0] >> _U(40)
        parts.append((np.bincount((of % _U(64 * HALF)).astype(np.int64), minlength=64 * HALF) & 1).astype(np.uint8))
    bits = np.concatenate([*parts, *[np.zeros(64 * HALF, np.uint8)] * (2 - len(parts))])
    return np.append(np.packbits(bits).view(np.int64), 2 * level + second)


@dataclass(frozen=True)
class Likeness:
    """Whether two sets may link by what is kept of them (``sketch``, an array of longs), so that only others' texts are fetched.

    ``columns`` is given both sketches and the most shingles that may be in one set only, as columns; ``arrays`` a group's
    sketches as rows, the place of one of them, those of others, and that number for each of the others.
    """

    columns: Callable[[Column, Column, Column], Column]
    arrays: Callable[[np.ndarray, int, np.ndarray, np.ndarray], np.ndarray]


def _differ_columns(a: Column, b: Column, most: Column) -> Column:
    la, lb = (F.shiftright(x[SHORT - 1].cast("int"), 1) for x in (a, b))
    level = F.greatest(la, lb)
    half = lambda x, own: F.slice(x, F.when(own == level, 1).otherwise(HALF + 1), F.lit(HALF))
    unknown = (level - F.least(la, lb) > 1) | (la != lb) & (F.least(a[SHORT - 1], b[SHORT - 1]) % 2 == 0)
    apart = F.aggregate(F.zip_with(half(a, la), half(b, lb), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x.cast("int"))
    mean = most / F.pow(F.lit(2.0), level)
    return unknown | (apart <= F.when(level == 0, most.cast("double")).otherwise(mean + 7 + F.sqrt(48 + 42 * mean)))


def _differ_arrays(s: np.ndarray, i: int, near: np.ndarray, most: np.ndarray) -> np.ndarray:
    tag = s[:, SHORT - 1].astype(np.int64)
    own, others = tag[i] >> 1, tag[near] >> 1
    level = np.maximum(own, others)
    unknown = (level - np.minimum(own, others) > 1) | (own != others) & (np.minimum(tag[i], tag[near]) % 2 == 0)
    a = np.where((level == own)[:, None], s[i, :HALF], s[i, HALF : 2 * HALF])
    b = np.where((level == others)[:, None], s[near, :HALF], s[near, HALF : 2 * HALF])
    mean = most / 2.0**level
    return unknown | (np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64) <= np.where(level == 0, most, mean + 7 + np.sqrt(48 + 42 * mean)))


#: By the sample that both sets have; of at most ``most`` shingles a sample has more than the limit with a chance below 1e-9 (Bernstein's bound). Sets without a common one may link.
PARITY = Likeness(_differ_columns, _differ_arrays)


def _sketched(documents: DataFrame, doc_id: str, text: str, width: int) -> DataFrame:
    """Per row: ``doc_id, n, digest, sketch``; the last once for each set and task."""
    schema = T.StructType([T.StructField("doc_id", documents.schema[doc_id].dataType), T.StructField("n", T.LongType()), T.StructField("digest", T.LongType()), T.StructField("sketch", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        to, shingles, seen = to_arrow_schema(schema), Shingler(width), set()
        for batch in batches:
            n, digests, short = [], [], []
            for value in batch.column(1):
                s = shingles(value.as_py())
                n.append(len(s))
                digests.append(digest(s))
                new = len(s) > 0 and digests[-1] not in seen
                if new:
                    seen.add(digests[-1])
                short.append(short_sketch(s) if new else None)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(to.field(0).type), pa.array(n, pa.int64()), pa.array(digests, pa.int64()), pa.array(short, to.field(3).type)], schema=to)

    return documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)


def _keyed(documents: DataFrame, text: str, width: int, p: int, q: int) -> DataFrame:
    """(key, digest): the join keys of every set, once for each task.

    They go straight into the shuffle; what is written of a document (``_sketched``) has none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, bands, seen = Shingler(width), Bands(p, q), set()
        keys, digests, held = [], [], 0

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(digests))], names=["key", "digest"])
            keys.clear()
            digests.clear()
            return out

        for batch in batches:
            for value in batch.column(0):
                s = shingles(value.as_py())
                own = digest(s)
                if not len(s) or own in seen:
                    continue
                seen.add(own)
                keys.append(block_keys(s, bands).view(np.int64))
                digests.append(np.full(len(keys[-1]), own, np.int64))
                held += len(keys[-1])
                if held > 100_000:
                    yield flush()
                    held = 0
        if keys:
            yield flush()

    return documents.select(F.col(text).alias("text")).mapInArrow(run, "key long, digest long")


def _meetings(rows: DataFrame) -> DataFrame:
    """From (key, digest) rows: ``first`` and ``other`` of each key, and all members (first null) of keys with three or more.

    ``rows`` are sorted by key within partitions that keep a key together; only
    a key's first two digests are remembered.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_key = last = pivot = second = None
        count = 0
        for batch in batches:
            key, d = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if not len(key):
                continue
            again = np.zeros(len(key), bool)
            again[1:] = (key[1:] == key[:-1]) & (d[1:] == d[:-1])
            again[0] = key[0] == last_key and d[0] == last if last_key is not None else False
            key, d = key[~again], d[~again]
            if not len(key):
                continue
            begins = np.ones(len(key), bool)
            begins[1:] = key[1:] != key[:-1]
            goes_on = last_key is not None and key[0] == last_key
            start = np.maximum.accumulate(np.where(begins, np.arange(len(key)), 0))
            pos = np.arange(len(key)) - start
            pivots = d[start]
            if goes_on:
                head = start == 0
                pos[head] += count
                pivots = np.where(head, pivot, pivots)
            seconds = np.roll(d, 1)
            if goes_on and pos[0] == 2:
                seconds[0] = second
            later, third = pos >= 1, pos == 2
            many = pos >= 2
            keys = np.concatenate([key[later], key[many], key[third], key[third]])
            firsts = np.concatenate([pivots[later], np.zeros(many.sum() + 2 * third.sum(), np.int64)])
            others = np.concatenate([d[later], d[many], pivots[third], seconds[third]])
            null = np.arange(len(keys)) >= later.sum()
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(firsts, pa.int64(), mask=null), pa.array(others)], names=["key", "first", "other"])
            end = int(start[-1])
            if not (goes_on and end == 0):
                second = None
            pivot, count = int(pivots[-1]), int(pos[-1]) + 1
            at_second = np.flatnonzero((start == end) & (pos == 1))
            if len(at_second):
                second = int(d[at_second[0]])
            last_key, last = int(key[-1]), int(d[-1])

    return rows.mapInArrow(run, "key long, first long, other long")


def may_hold(rows: DataFrame, ids: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """``rows`` in two: those whose ``column`` may be in ``ids`` (a written table with that column), and those that surely aren't.

    A map of hashed ids tells them apart where they are, so only the first, few others among them, have to be joined. The map
    has 32 bits an id within ``ID_BITS`` and is sent to the workers in pieces of 4 kB; beyond the upper bound more rows reach the join.
    """
    size = min(max(ID_BITS[0], 1 << (32 * ids.count()).bit_length()), ID_BITS[1])
    at = F.pmod(F.xxhash64(column), F.lit(size)) + 1  # these functions count from 1
    bits = ids.select(F.bitmap_bucket_number(at).alias("_piece"), F.bitmap_bit_position(at).alias("_bit")).repartition("_piece").groupBy("_piece").agg(F.bitmap_construct_agg("_bit").alias("_bits"))
    marked = rows.withColumn("_at", at).join(F.broadcast(bits), F.bitmap_bucket_number(F.col("_at")) == F.col("_piece"), "left")
    place = F.bitmap_bit_position(F.col("_at")).cast("int")
    byte = F.conv(F.hex(F.substring("_bits", F.shiftright(place, 3) + 1, F.lit(1))), 16, 10).cast("int")
    held = F.coalesce(byte.bitwiseAND(F.call_function("shiftleft", F.lit(1), place % 8)) != 0, F.lit(False))
    return marked.where(held).select(*rows.columns), marked.where(~held).select(*rows.columns)


def _texts_of(documents: DataFrame, ids: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, text) of rows whose id may be in ``ids`` (a written table), dealt out by their ids; one row an id unless its texts differ."""
    wanted, _ = may_hold(documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), ids, "doc_id")
    return wanted.repartition("doc_id").dropDuplicates()


def _verified(documents: DataFrame, classes: DataFrame, pairs: DataFrame, *, doc_id: str, text: str, width: int, p: int, q: int, like: Likeness = PARITY) -> DataFrame:
    """The pairs (a, b: digests) that link, as (a, b) of class ids.

    The pairs of an ``a`` with many are dealt to parts. ``a``'s text goes once to each of
    its parts and is followed there by the texts of its ``b``, so that no
    pair carries two texts and a class with many pairs is many tasks' work.
    """
    c = classes.select("digest", "n", "sketch", F.col("id"))
    both = pairs.join(c.toDF("a", "na", "sa", "ida"), "a").join(c.toDF("b", "nb", "sb", "idb"), "b")
    most = F.floor(F.lit(q - p) * (F.col("na") + F.col("nb")) / F.lit(q + p))
    may = written(both.where((F.abs(F.col("na") - F.col("nb")) <= most) & like.columns(F.col("sa"), F.col("sb"), most)).select("a", "b", "ida", "idb"), "jaccard-pairs")
    parts = may.groupBy("a").agg(F.count("*").alias("m")).where(F.col("m") > PAIRS).select("a", F.ceil(F.col("m") / PAIRS).alias("parts"))
    dealt = may.join(parts, "a", "left").withColumn("part", F.pmod(F.xxhash64("b"), F.coalesce("parts", F.lit(1)))).drop("parts")
    kind = documents.schema[doc_id].dataType
    pivots = dealt.select(F.col("ida").alias("doc_id"), "a", "part", F.col("a").alias("own"), "ida", F.lit(None).cast(kind).alias("idb")).distinct()
    asked = written(pivots.unionByName(dealt.select(F.col("idb").alias("doc_id"), "a", "part", F.col("b").alias("own"), "ida", "idb")), "jaccard-asked")
    # Texts are dealt out by their ids once, and from there to their pairs.
    rows = _texts_of(documents, asked, doc_id, text).join(asked, "doc_id").select("a", "part", "own", "ida", "idb", "text").repartition("a", "part").sortWithinPartitions("a", "part", F.col("idb").isNotNull())
    schema = T.StructType([rows.schema["ida"], rows.schema["idb"]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler(width)
        pivot, x = None, np.zeros(0, np.uint64)
        for batch in batches:
            a, own, there = batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(4).is_valid().to_pylist()
            keep = []
            for i in range(batch.num_rows):
                y = shingles(batch.column(5)[i].as_py())
                keep.append(False)
                if digest(y) != own[i]:
                    continue  # another text of the same id
                if not there[i]:
                    pivot, x = a[i], y
                elif pivot == a[i]:
                    same = len(np.intersect1d(x, y, assume_unique=True))
                    keep[-1] = q * same >= p * (len(x) + len(y) - same)
            yield batch.select([3, 4]).filter(pa.array(keep, pa.bool_()))

    return rows.mapInArrow(run, schema).toDF("a", "b").distinct()


def _compared(members: DataFrame, p: int, q: int, like: Likeness = PARITY, spare: int | None = SPARE) -> DataFrame:
    """(key, a, b): digests of different components that meet in a key and may link by their sizes and short sketches.

    Of a key with more than ``spare`` members, a pair is left out if others of the key join its two members, so there are fewer
    pairs than members. ``members``: (key, digest, component as long, n, sketch, never: digests that it doesn't link with), at most
    ``GROUP`` of a key, sorted by key within partitions that keep a key together.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(at: list, a: list, b: list) -> pa.RecordBatch:
            at, a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (at, a, b))
            return pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["key", "a", "b"])

        def pairs(table: pa.Table) -> Iterator[pa.RecordBatch]:
            at, a, b, held = [], [], [], 0
            keys, d, c, n = (table.column(i).to_numpy() for i in range(4))
            s = table.column(4).combine_chunks().flatten().to_numpy().astype(np.int64).view(np.uint64).reshape(len(keys), -1)
            never, edges = table.column(5), np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            for lo, hi in zip(edges.tolist(), [*edges[1:].tolist(), len(keys)]):
                part, few = c[lo:hi].copy(), spare is not None and hi - lo > spare
                for i in range(lo, hi - 1):
                    j = slice(i + 1, hi)
                    most = (q - p) * (n[i] + n[j]) // (q + p)
                    near = np.flatnonzero((part[i + 1 - lo :] != part[i - lo]) & (np.abs(n[j] - n[i]) <= most))
                    if len(near):
                        near += i + 1
                        near = near[like.arrays(s, i, near, most[near - i - 1])]
                    if len(near) and (no := never[i].as_py()):
                        near = near[~np.isin(d[near], no)]
                    if len(near) and few:
                        joined, first = np.unique(part[near - lo], return_index=True)
                        near = near[first]
                        part[np.isin(part, joined)] = part[i - lo]
                    if len(near):
                        at.append(np.full(len(near), keys[i]))
                        a.append(np.full(len(near), d[i]))
                        b.append(d[near])
                        held += len(near)
                        if held > 100_000:
                            yield found(at, a, b)
                            at, a, b, held = [], [], [], 0
            yield found(at, a, b)

        rest = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch] if rest is None else [*rest.to_batches(), batch])
            keys = table.column(0).to_numpy()
            whole = int(np.searchsorted(keys, keys[-1]))  # where the last key, which may go on, begins
            if whole:
                yield from pairs(table.slice(0, whole))
            rest = table.slice(whole)
        if rest is not None:
            yield from pairs(rest)

    return members.select("key", "digest", "component", "n", "sketch", "never").mapInArrow(run, "key long, a long, b long")


def _joined(documents: DataFrame, classes: DataFrame, labels: DataFrame, groups: DataFrame, *, like: Likeness, **how) -> DataFrame:
    """The components (id, label), from those of ``labels`` and what links in ``groups`` (key, digest, m).

    A group whose pairs all link is done: they join all that may link in it. Where some don't, the group is gone through
    again without them; the last round has all pairs that are left.
    """
    never = None
    ids = classes.select("digest", "id")
    for left in reversed(range(ROUNDS)):
        of_class = classes.join(labels, "id", "left").select("digest", "n", "sketch", F.xxhash64(F.coalesce("label", "id")).alias("component"))
        if never is None:
            of_class = of_class.withColumn("never", F.array().cast("array<long>"))
        else:  # a class's list is found once, not for each of its keys
            of_class = of_class.join(never.groupBy(F.col("a").alias("digest")).agg(F.collect_set("b").alias("never")), "digest", "left")
        members = groups.select("key", "digest").join(of_class, "digest")
        met = written(_compared(members.repartition("key").sortWithinPartitions("key"), how["p"], how["q"], like, SPARE if left else None), "compared")
        more = written(_verified(documents, classes, met.select("a", "b").distinct(), like=like, **how), "links")
        if not more.isEmpty():
            labels = _grown(labels, more)
        if not left or groups.where(F.col("m") > SPARE).isEmpty():
            break
        large = met.join(groups.where(F.col("m") > SPARE).select("key").distinct(), "key", "left_semi")
        named = large.join(ids.toDF("a", "ida"), "a").join(ids.toDF("b", "idb"), "b")
        failed = written(named.join(more.toDF("ida", "idb"), ["ida", "idb"], "left_anti").select("key", "a", "b"), "failed")
        if failed.isEmpty():
            break
        both = failed.select("a", "b").unionByName(failed.select(F.col("b").alias("a"), F.col("a").alias("b")))
        never = both if never is None else never.unionByName(both)
        groups = written(groups.join(failed.select("key").distinct(), "key", "left_semi"), "groups")
    return labels


def components(links: DataFrame) -> DataFrame:
    """(id, label): the smallest id that each id of the links (a, b) reaches.

    Labels sink along links and then jump to their labels' labels until nothing
    changes; each round is written, so lineage doesn't grow.
    """
    both = written(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = written(both.groupBy(F.col("a").alias("id")).agg(F.least(F.first("a"), F.min("b")).alias("label")), "labels")
    while True:
        lower = both.join(labels.toDF("b", "lb"), "b").groupBy(F.col("a").alias("id")).agg(F.min("lb").alias("low"))
        near = labels.join(lower, "id").select("id", F.col("label").alias("old"), F.least("label", "low").alias("label"))
        jumped = near.join(labels.toDF("label", "further"), "label").select("id", "old", F.least("label", "further").alias("label"))
        step = written(jumped, "labels")
        if step.where(F.col("old") != F.col("label")).isEmpty():
            return step.select("id", "label")
        labels = step.select("id", "label")


def _grown(labels: DataFrame, links: DataFrame) -> DataFrame:
    """The components ``labels`` (id, label) after further ``links`` (a, b), which are followed from component to component only."""
    ends = links.join(labels.toDF("a", "la"), "a", "left").join(labels.toDF("b", "lb"), "b", "left").select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b"))
    more = components(ends.where(F.col("a") != F.col("b")))
    known = labels.join(more.toDF("label", "further"), "label", "left").select("id", F.coalesce("further", "label").alias("label"))
    return written(known.unionByName(more.join(labels, "id", "left_anti")), "labels")


def linked_classes(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, p: int = P, q: int = Q) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row."""
    sketched = written(_sketched(documents, doc_id, text, width), "sketches")
    classes = written(sketched.where(F.col("n") > 0).groupBy("digest").agg(F.first("n").alias("n"), F.min("doc_id").alias("id"), F.first("sketch", ignorenulls=True).alias("sketch")), "classes")
    keyed = _keyed(documents, text, width, p, q).repartition("key").sortWithinPartitions("key", "digest")
    met = written(_meetings(keyed), "meetings")
    pairs = met.where(F.col("first").isNotNull()).select(F.col("first").alias("a"), F.col("other").alias("b")).distinct()
    members = met.where(F.col("first").isNull()).select("key", F.col("other").alias("digest"))
    return linked_by_keys(documents, sketched, classes, pairs, members, doc_id=doc_id, text=text, width=width, p=p, q=q)


def linked_by_keys(documents: DataFrame, sketched: DataFrame, classes: DataFrame, pairs: DataFrame, members: DataFrame, *, like: Likeness = PARITY, **how) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row of ``sketched``, from keys of which linked classes share one at least.

    ``pairs`` (a, b) join every class with the first of each of its keys, ``members`` (key, digest) has the keys of three or more classes.
    """
    p, q = how["p"], how["q"]
    links = written(_verified(documents, classes, pairs, like=like, **how), "links")
    labels = components(links)
    # Keys whose members aren't all of one component yet; of keys with the same members, one.
    of_class = classes.join(labels, "id", "left").select("digest", F.coalesce("label", "id").alias("component"))
    members = written(members.join(of_class, "digest"), "members")
    same = [F.bit_xor(F.xxhash64("digest", F.lit(i))).alias(f"x{i}") for i in (1, 2)]
    open_keys = members.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("m"), F.min("digest").alias("head"), *same).where(F.col("lo") != F.col("hi")).groupBy("m", "x1", "x2").agg(F.min("key").alias("key"), F.first("head").alias("head"))
    unsure = written(members.join(open_keys.select("key", "m", "head"), "key"), "unsure")
    groups = _merged(unsure.where(F.col("m") <= GROUP))
    many = written(unsure.where(F.col("m") > GROUP).select("digest", "component").distinct().join(classes, "digest"), "unsure-many")
    if not many.isEmpty():
        prefix = _prefixes(documents, many, **how)
        sizes = prefix.groupBy("shingle").agg(F.count("*").alias("m")).where(F.col("m") > 1)
        groups = groups.unionByName(_dealt(prefix.join(sizes, "shingle")))
    groups = written(groups, "groups")
    if not groups.isEmpty():
        labels = _joined(documents, classes, labels, groups, like=like, **how)
    named = classes.select("digest", "id").join(labels, "id", "left").select("digest", F.coalesce("label", "id").alias("component"))
    out = sketched.select("doc_id", "n", F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("digest")).alias("digest")).join(named, "digest", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def _merged(members: DataFrame) -> DataFrame:
    """(key, digest, m) groups from (key, digest, m, head): keys of one head, the smallest class of each, become one group.

    Near copies share hundreds of keys, few of which have the same members, and would be compared in each of them. What a head
    meets is compared once; a head of more than ``GROUP`` is dealt to parts as a shingle is, unless that makes more rows than its keys have.
    """
    each = members.groupBy("head", "digest").agg(F.count("*").alias("keys"))
    parts = F.when(F.col("size") > GROUP, F.ceil(2 * F.col("size") / GROUP)).otherwise(1)
    heads = each.groupBy("head").agg(F.count("*").alias("size"), F.sum("keys").alias("rows")).withColumn("one", F.col("size") * parts <= F.col("rows"))
    one = each.select("head", "digest").join(heads.where("one").select("head", F.col("size").alias("m")), "head")
    return _dealt(one.withColumnRenamed("head", "shingle")).unionByName(members.join(heads.where(~F.col("one")).select("head"), "head").select("key", "digest", "m"))


def _prefixes(documents: DataFrame, unsure: DataFrame, *, doc_id: str, text: str, width: int, p: int, q: int) -> DataFrame:
    """The rarest shingles of the classes, of which linked ones share one at least: ``shingle`` and the columns of ``unsure`` without ``id``."""
    ids = unsure.select(F.col("id").alias("doc_id"), "digest", "component", "n")
    texts = _texts_of(documents, ids, doc_id, text).join(ids, "doc_id").select("text", "digest", "component", "n")
    schema = T.StructType([T.StructField("digest", T.LongType()), texts.schema["component"], T.StructField("n", T.LongType()), T.StructField("shingle", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        to, shingles = to_arrow_schema(schema), Shingler(width)
        for batch in batches:
            own = batch.column(1).to_pylist()
            for i in range(batch.num_rows):
                s = shingles(batch.column(0)[i].as_py())
                if digest(s) == own[i]:
                    at = pa.array(np.full(len(s), i))
                    yield pa.RecordBatch.from_arrays([*[batch.column(j).take(at).cast(to.field(j - 1).type) for j in (1, 2, 3)], pa.array(s.view(np.int64))], schema=to)

    each = texts.mapInArrow(run, schema)
    frequency = each.groupBy("shingle").agg(F.count("*").alias("df"))
    most = F.floor(F.lit(q - p) * (F.col("n") + F.floor(F.lit(q) * F.col("n") / F.lit(p))) / F.lit(q + p)).cast("int")
    rarest = each.join(frequency.where(F.col("df") > 1), "shingle", "left").groupBy("digest", "component", "n").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(1)).alias("df"), "shingle"))).alias("s"))
    prefix = rarest.select("digest", "component", "n", F.explode(F.slice("s", F.lit(1), most + 1)).alias("x")).where(F.col("x.df") > 1).select("digest", "component", "n", F.col("x.shingle").alias("shingle"))
    return written(prefix.join(unsure.select("digest", "sketch"), "digest"), "prefixes")


def _dealt(members: DataFrame) -> DataFrame:
    """(key, digest, m) from (shingle, digest, m): a shingle of more than ``GROUP`` classes is dealt to parts of half that, of which any two make a group."""
    parts = F.when(F.col("m") > GROUP, F.ceil(2 * F.col("m") / GROUP)).otherwise(1)
    own = F.pmod(F.xxhash64("digest"), F.col("_parts"))
    at = members.withColumn("_parts", parts.cast("long")).withColumn("_own", own).withColumn("_with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1)))
    key = F.xxhash64("shingle", F.least("_own", "_with"), F.greatest("_own", "_with"))
    return at.select(key.alias("key"), "digest", F.least("m", F.lit(GROUP)).alias("m"))


def jaccard_report(documents: DataFrame) -> DataFrame:
    """The contract's join: three words, nine tenths."""
    return linked_classes(documents, width=3, p=90, q=100)


ORACLE_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) < 3 THEN ws ELSE list_slice(ws, i, i + 2) END AS g
      FROM (SELECT doc_id, ws, unnest(range(1, greatest(1, len(ws) - 2) + 1)) AS i FROM w WHERE len(ws) > 0)),
sets AS (SELECT doc_id, list(hash(g) ORDER BY hash(g)) AS gs, count(*) AS n FROM s GROUP BY doc_id),
cls AS (SELECT min(doc_id) AS rep, gs, n, list(doc_id) AS docs FROM sets GROUP BY gs, n),
e AS (SELECT rep, n, unnest(gs) AS g FROM cls),
f AS (SELECT g, count(*) AS df FROM e GROUP BY g HAVING count(*) > 1),
r AS (SELECT e.rep, e.n, e.g, row_number() OVER (PARTITION BY e.rep ORDER BY coalesce(f.df, 1), e.g) AS k FROM e LEFT JOIN f USING (g)),
pre AS (SELECT rep, n, r.g FROM r JOIN f USING (g) WHERE k <= n // 9 + 1),
cand AS (SELECT DISTINCT a.rep AS a, b.rep AS b FROM pre a JOIN pre b ON a.g = b.g AND a.rep < b.rep AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)),
lnk AS (SELECT a, b FROM (SELECT c.a, c.b, x.n + y.n AS t, len(list_intersect(x.gs, y.gs)) AS i FROM cand c JOIN cls x ON x.rep = c.a JOIN cls y ON y.rep = c.b) WHERE 100 * i >= 90 * (t - i)),
edge AS (SELECT a, b FROM lnk UNION SELECT b, a FROM lnk),
reach AS (SELECT rep AS a, rep AS b FROM cls UNION SELECT reach.a, edge.b FROM reach JOIN edge ON reach.b = edge.a),
comp AS (SELECT a AS rep, min(b) AS c FROM reach GROUP BY a),
named AS (SELECT unnest(docs) AS doc_id, n, c FROM cls JOIN comp USING (rep))
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(n.c, d.doc_id) AS component_id FROM documents d LEFT JOIN named n USING (doc_id)
"""
