"""The join against all pairs on a small fixture, and against SQL on a whole table."""

import random

import numpy as np
import pytest

from medialake.llm import parity_join as pj
from medialake.llm.common import table
from tests.oracle import SF, compare, connection


def brute(texts, width, p, q):
    """(n, component) of each id from all pairs."""
    sets = {}
    for d, t in texts:
        w = (t or "").encode().lower().split()
        n = min(width, len(w))
        sets[d] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()
    parent = {d: d for d in sets}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and q * len(x & y) >= p * len(x | y):
                ra, rb = root(a), root(b)
                parent[max(ra, rb)] = min(ra, rb)
    return {d: (len(sets[d]), root(d)) for d in sets}


def near_copies(seed, n=260):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = rng.choices(vocabulary, k=60)
    texts = []
    for base in range(20):
        words = rng.choices(vocabulary, k=rng.choice([3, 8, 14, 30, 80, 200, 700]))
        if base % 3 == 0:
            words = passage + words[:15]
        for _ in range(n // 20):
            copy = list(words)
            for _ in range(rng.randint(0, max(1, len(words) // 60))):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(" ".join(copy))
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("width,p,q", [(3, 90, 100), (5, 8, 10)])
def test_against_all_pairs(spark, width, p, q):
    texts = near_copies(width) + [(1000, None), (1001, ""), (1002, "A  b"), (1003, "a\tB"), (1004, "a b c"), (1005, None)]
    docs = spark.createDataFrame([(d, t, 1, [1]) for d, t in texts], "doc_id long, text string, n int, keys array<int>").repartition(3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in pj.linked_classes(docs, width=width, p=p, q=q).collect()}
    assert got == brute(texts, width, p, q)


def test_repeated_rows_and_no_rows(spark):
    docs = spark.createDataFrame([(5, "x y z u v"), (5, "x y z u v"), (3, "X y z u v")], "doc_id long, text string")
    assert sorted(map(tuple, pj.jaccard_report(docs).collect())) == [(3, 3, 3), (5, 3, 3), (5, 3, 3)]
    assert pj.jaccard_report(docs.limit(0)).count() == 0


def test_whole_table_against_sql(spark):
    assert compare(pj.jaccard_report(table(spark, SF, "documents")), connection(SF), pj.ORACLE_SQL) == 200


def test_sketches_bound_the_difference():
    rng = np.random.default_rng(1)
    for n in (1, 5, 40, 300):
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[: n - n // 10], rng.integers(0, 2**63, 3).astype(np.uint64)]))
        x, y = pj.short_sketch(a), pj.short_sketch(b)
        assert sum(int(v).bit_count() for v in np.bitwise_xor(x.view(np.uint64), y.view(np.uint64))) <= len(np.setxor1d(a, b))


def test_sketches_tell_large_sets_apart(spark):
    """Unrelated large sets aren't verified, linked ones are, and columns say what arrays say."""
    rng = np.random.default_rng(2)
    new = lambda n: np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
    for n in (300, 450, 500, 700, 1200, 6000, 20_000):
        a, other = new(n), new(n)
        near = np.unique(np.concatenate([a[: n - n // 9], new(n // 10)]))
        larger = np.unique(np.concatenate([a, new(n // 4)]))
        assert len(a) >= 0.8 * len(larger)
        s = np.array([pj.short_sketch(x) for x in (a, other, near, larger)]).view(np.uint64)
        most = np.array([2 * (len(a) + len(x)) // 18 for x in (other, near, larger)])
        got = pj.PARITY.arrays(s, 0, np.array([1, 2, 3]), most).tolist()
        assert got == [False, True, True]
        rows = spark.createDataFrame([(s[0].view(np.int64).tolist(), x.view(np.int64).tolist(), int(m)) for x, m in zip(s[1:], most)], "a array<long>, b array<long>, most long")
        assert [r[0] for r in rows.select(pj.PARITY.columns(rows.a, rows.b, rows.most)).collect()] == got


def test_rows_that_may_be_held_are_told_apart(spark):
    rows = spark.createDataFrame([(i, f"t{i}") for i in range(3000)] + [(None, "null")], "k long, t string")
    ids = spark.createDataFrame([(i,) for i in range(0, 3000, 7)], "k long")
    may, rest = pj.may_hold(rows, ids, "k")
    found, others = [r["k"] for r in may.collect()], [r["k"] for r in rest.collect()]
    assert sorted(found + others, key=str) == sorted([*range(3000), None], key=str)
    assert set(range(0, 3000, 7)) <= set(found) and len(found) < 600


def test_near_copies_of_long_texts(spark):
    """Links of sets that are sampled for their sketches, and of those beside them, stay."""
    rng = random.Random(5)
    base = [[f"w{rng.randrange(5000)}" for _ in range(n)] for n in (480, 560, 2000)]
    texts = [" ".join(b[: len(b) - k] + [f"x{k}_{j}" for j in range(k)]) for b in base for k in range(0, 60, 4)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in pj.linked_classes(docs).collect()}
    assert got == brute(list(enumerate(texts)), 5, 8, 10)


def test_words_are_told_apart_wherever_they_stand(monkeypatch):
    """A word's hash is that of its bytes, in texts of one piece and of many; no memory of words is kept."""
    rng = random.Random(3)
    texts = ["".join(rng.choices("abc\u00e9 \t\n\x0b\x00\x1f", k=rng.randrange(60))).encode() for _ in range(300)] + [b"", b" ", b"x" * 40]
    whole = [pj.word_hashes(raw).tolist() for raw in texts]
    known = {}
    for raw, hashes in zip(texts, whole):
        assert len(hashes) == len(raw.split())
        assert all(known.setdefault(w, h) == h for w, h in zip(raw.split(), hashes))
    assert len(set(known.values())) == len(known) > 400
    monkeypatch.setattr(pj, "PIECE", 7)
    monkeypatch.setattr(pj, "_PLACES", pj._PLACES[:7])
    monkeypatch.setattr(pj, "_DIVISORS", pj._DIVISORS[:7])
    assert [pj.word_hashes(raw).tolist() for raw in texts] == whole


@pytest.mark.parametrize("group", [1000, 16])
def test_near_copies_are_not_compared_in_each_key(spark, monkeypatch, group):
    """Copies that share many keys, of which some link and others nearly do, are few pairs, also where a head has too many."""
    rng = random.Random(7)
    base = [f"w{i}" for i in range(400)]
    texts = []
    for i in range(40):
        words = list(base)
        for at in rng.sample(range(400), 3):
            words[at] = f"x{i}_{at}"
        texts.append(" ".join(words))
    made, written = [], pj.written

    def counted(df, name):
        out = written(df, name)
        if name == "compared":
            made.append((out.count(), out.select("a", "b").distinct().count()))
        return out

    monkeypatch.setattr(pj, "written", counted)
    monkeypatch.setattr(pj, "GROUP", group)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in pj.linked_classes(docs, width=3, p=92, q=100).collect()}
    assert got == brute(list(enumerate(texts)), 3, 92, 100)
    if group == 1000:
        assert sum(rows for rows, _ in made) <= 12 * sum(pairs for _, pairs in made)


def test_components_grow(spark):
    labels = spark.createDataFrame([(1, 1), (4, 1), (5, 5), (6, 5), (9, 9), (12, 9)], "id long, label long")
    links = spark.createDataFrame([(4, 6), (12, 20), (3, 20), (30, 31), (5, 6)], "a long, b long")
    got = {r["id"]: r["label"] for r in pj._grown(labels, links).collect()}
    assert got == {1: 1, 4: 1, 5: 1, 6: 1, 9: 3, 12: 3, 20: 3, 3: 3, 30: 30, 31: 30}
