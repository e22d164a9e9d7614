"""Nearest neighbours against brute force."""

import numpy as np

from medialake.llm import adaptive_scan as ads
from medialake.llm.common import table
from tests.oracle import SF


def brute(ids, x, q_id, q, k=10):
    d = np.sqrt(((x - q) ** 2).sum(axis=1))
    return sorted((float(a), i) for a, i in zip(d, ids) if i != q_id)[:k]


def recall(spark, sf):
    df = table(spark, sf, "embeddings")
    rows = df.collect()
    ids, x = [r["vec_id"] for r in rows], np.array([r["embedding"] for r in rows], dtype=np.float64)
    got = {}
    for r in ads.neighbours_report(df).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["score"], r["vec_id"])
    hits = total = 0
    assert set(got) == {i for i in ids if i % 100 == 0}
    for q, own in got.items():
        want = brute(ids, x, q, x[ids.index(q)])
        assert sorted(own) == list(range(1, len(want) + 1)) and [own[i] for i in sorted(own)] == sorted(own.values())
        for s, v in own.values():
            assert abs(s - np.sqrt(((x[ids.index(v)] - x[ids.index(q)]) ** 2).sum())) < 1e-12
        hits += len({v for _, v in want} & {v for _, v in own.values()})
        total += len(want)
    return hits / total


def test_recall(spark):
    for sf in (SF, SF.replace("0.001", "0.1")):
        found = recall(spark, sf)
        print(sf, found)
        assert found >= 0.9


def test_recall_with_hundreds_of_lists(spark, monkeypatch):
    """With lists of 8 vectors, so that most aren't probed."""
    monkeypatch.setattr(ads, "LIST", 8)
    df = table(spark, SF.replace("0.001", "0.1"), "embeddings")
    rows = ads.usable(df, "vec_id", "embedding")
    index = ads.build_index(rows, 64, rows.count())
    assert len(index.centroids) >= 240 and index.probed < len(index.centroids)
    found = recall(spark, SF.replace("0.001", "0.1"))
    print(len(index.centroids), index.probed, found)
    assert found >= 0.9


def test_clusters_are_probed_selectively(spark, monkeypatch):
    monkeypatch.setattr(ads, "LIST", 16)
    rng = np.random.default_rng(3)
    x = (rng.standard_normal((40, 16)) * 20)[np.arange(4000) % 40] + rng.standard_normal((4000, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    rows = ads.usable(df, "vec_id", "embedding")
    index = ads.build_index(rows, 16, 4000)
    assert len(index.centroids) == 250 and index.probed < 30
    got = {}
    for r in ads.neighbours_report(df).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    want = {q: {i for _, i in brute(range(4000), x, q, x[q])} for q in got}
    assert len(got) == 40 and sum(len(got[q] & want[q]) for q in got) >= 0.9 * 400


def test_repeated_rows(spark):
    """A repeated query row is one query; a repeated candidate, or one with several vectors, is found once."""
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [1.0, 0.1]), (1, [1.0, 0.1]), (2, [1.0, 0.3]), (2, [1.0, 5.0]), (2, [1.0, 0.2]), (3, [1.0, 0.4]), (100, [7.0, 0.0, 0.0]), (7, [1.0, 2.0, 3.0])]
    rows += [(10 + i, [1.0, 1.0 + i]) for i in range(12)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 6)) for r in ads.neighbours_report(df).collect())
    assert got[:10] == [(0, 1, 1, 0.1), (0, 2, 2, 0.2), (0, 3, 3, 0.4)] + [(0, 4 + i, 10 + i, 1.0 + i) for i in range(7)]
    assert [g[:3] for g in got[10:]] == [(100, 1, 7)]


def test_edge_cases(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.1]), (2, [1.0, 0.1]), (3, None), (4, [0.0, 0.0]), (5, [1.0, None]), (6, [nan, 1.0]), (7, [1.0, 2.0, 3.0]), (100, [2.0, 2.0]), (200, [0.0, 0.0])]
    df = spark.createDataFrame([(i, v, 1.5) for i, v in rows], "vec_id long, embedding array<float>, score double")
    got = sorted((r["query_id"], r["rank"], r["vec_id"]) for r in ads.neighbours_report(df).collect())
    assert got == [(0, 1, 1), (0, 2, 2), (0, 3, 100), (100, 1, 1), (100, 2, 2), (100, 3, 0)]
    assert ads.neighbours_report(df.limit(0)).count() == 0


def test_a_group_of_copies_is_split(spark):
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(1500)] + [(i, [float(i), 1.0, 0.0]) for i in range(1500, 1520)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [r["vec_id"] for r in ads.neighbours_report(df).where("query_id = 0").orderBy("rank").collect()]
    assert got == list(range(1, 11))
