"""MinHash near-duplicates beside all pairs, and their empty, null and repeated cases."""

import random
from math import comb

import numpy as np
from pyspark.sql import functions as F

from medialake.llm import minhash_join as mj
from medialake.llm import parity_join as pj
from tests.llm.test_parity_join import brute, near_copies

SCHEMA = "doc_id long, text string, n int, digest string, key array<int>"


def report(spark, texts):
    docs = spark.createDataFrame([(d, t, 1, "x", [1]) for d, t in texts], SCHEMA).repartition(3)
    return [tuple(r) for r in mj.dedup_report(docs).collect()]


def test_against_all_pairs(spark):
    texts = near_copies(11) + [(1000, None), (1001, ""), (1002, "A  b"), (1003, "a\tB"), (1004, "a b c"), (1005, None), (1006, "word " * 200_000 + "end")]
    expected = brute(texts, 5, 85, 100)
    assert sorted(report(spark, texts)) == sorted((d, n, c, d == c) for d, (n, c) in expected.items())


def test_a_large_group_of_near_copies(spark, monkeypatch):
    """A list with more members than are compared directly, of which some link with each other but not with the first."""
    monkeypatch.setattr(pj, "GROUP", 20)
    rng = random.Random(2)
    base = [f"b{i}" for i in range(120)]
    texts = []
    for family in range(6):
        words = list(base)
        for i in rng.sample(range(120), 5 * family):
            words[i] = f"f{family}x{i}"
        for copy in range(30):
            own = list(words)
            own[rng.randrange(120)] = f"c{family}_{copy}"
            texts.append((len(texts), " ".join(own)))
    expected = brute(texts, 5, 85, 100)
    assert len({c for _, c in expected.values()}) > 1
    assert sorted(report(spark, texts)) == sorted((d, n, c, d == c) for d, (n, c) in expected.items())


def test_a_group_of_near_copies_is_joined_by_few_pairs(spark, monkeypatch):
    """Members of many components that all link: pairs of them are fewer than members, not their square; those that don't link are gone through again."""
    one = [(7, d, d, 100, [5] * 64, []) for d in range(200)]
    members = spark.createDataFrame(one, "key long, digest long, component long, n long, sketch array<long>, never array<long>").coalesce(1).sortWithinPartitions("key")
    assert pj._compared(members, 85, 100, mj.likeness(23)).count() == 199
    assert pj._compared(members, 85, 100, mj.likeness(23), None).count() == 200 * 199 // 2
    monkeypatch.setattr(pj, "SPARE", 2)
    test_a_large_group_of_near_copies(spark, monkeypatch)


def test_rows_without_id_repeated_rows_and_no_rows(spark):
    text = "one two three four five six seven"
    assert sorted(report(spark, [(5, text), (5, text), (3, text.upper())])) == [(3, 3, 3, True), (5, 3, 3, False), (5, 3, 3, False)]
    rows = report(spark, [(None, text), (None, text), (2, text), (4, text)])
    assert sorted(rows, key=str) == [(2, 3, 2, True), (4, 3, 2, False), (None, 3, None, True), (None, 3, None, True)]
    assert report(spark, [(None, text), (7, None)]) in ([(None, 3, None, True), (7, 0, 7, True)], [(7, 0, 7, True), (None, 3, None, True)])
    assert report(spark, []) == []


def test_needed_matches_and_places():
    t, k = mj.matches_needed(), mj.COORDINATES
    below = sum(comb(k, i) * 0.85**i * 0.15 ** (k - i) for i in range(t))
    assert below <= mj.MISS < below + comb(k, t) * 0.85**t * 0.15 ** (k - t)
    rng = np.random.default_rng(4)
    pool = pj.mix(rng.integers(1, 1 << 62, 1000).astype(np.uint64))
    agree = [np.mean(mj.signature(pool[:900]) == mj.signature(np.concatenate([pool[100:900], pj.mix(pool[900:] + np.uint64(j))]))) for j in range(60)]
    assert abs(np.mean(agree) - 0.8) < 0.03
    wide = pj.mix(np.arange(mj.WIDE + 5, dtype=np.uint64))
    assert (mj.signature(wide) == np.minimum(mj.signature(wide[:99]).view(np.uint64), mj.signature(wide[99:]).view(np.uint64)).view(np.int64)).all()


def test_prefix_leaves_out_what_cannot_match(spark):
    """A value shared by all classes is in no prefix where the others are a class's own."""
    k, t = mj.COORDINATES, mj.matches_needed()
    classes = spark.range(40).select(F.col("id").alias("digest"), F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda j: F.when(j < 3, F.lit(7)).otherwise(F.col("id") * 1000 + j).cast("long")).alias("sketch"))
    assert mj.posted(classes, t).count() == 0
    assert mj.posted(classes.withColumn("sketch", F.transform("sketch", lambda x: x % 1000)), t).count() == 40 * (k - t + 1)
