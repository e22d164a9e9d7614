"""Toxicity: the search against all cosines, and held-out accuracy."""

import random
from collections import Counter

import numpy as np

from medialake.llm import toxic_neighbours as tn
from medialake.llm.common import table
from tests.oracle import SF


def test_search_is_exact():
    rng = random.Random(3)
    terms = [f"t{i}" for i in range(200)]
    weight = {t: 1 + i / 10 for i, t in enumerate(terms)}
    odds = [40 if i < 12 else 1 for i in range(200)]  # some terms are in most examples
    counts = [Counter(rng.choices(terms, odds, k=rng.randint(0, 12))) for _ in range(500)]
    index = tn.Index.build(weight, Counter(t for c in counts for t in c), [(i, 0, list(c), np.array(list(c.values()), np.int64)) for i, c in enumerate(counts)])
    assert 0 < index.head.shape[1] < 100

    def plain(c):
        v = {w: (1 + np.log(n)) * weight[w] for w, n in c.items() if w in weight}
        norm = np.sqrt(sum(x * x for x in v.values()))
        return {w: x / norm for w, x in v.items()}

    vectors = [plain(counts[i]) for i in index.ids]
    for x, y in zip(index.own_vectors(), vectors):
        assert dict(zip(x[0].tolist(), x[1].tolist())) == {index.terms[w]: v for w, v in ((w, v) for w, v in y.items())} or np.allclose(sorted(x[1]), sorted(y.values()))
    queries = [Counter(rng.choices([*terms, "unknown"], [*odds, 3], k=6)) for _ in range(200)]
    for k, leave in ((tn.K, False), (1, True), (600, False)):
        every = [sorted(((sum(q[w] * v.get(w, 0) for w in q), i) for i, v in enumerate(vectors)), key=lambda x: (-x[0], x[1])) for q in map(plain, queries)]
        without = [e[0][1] for e in every] if leave else None
        found = index.search([index.vector(q) for q in queries], k, without)
        for q, e, got in zip(map(plain, queries), every, found):
            want = [x for x in e if x[0] > 0 and not (leave and x[1] == e[0][1])][:k]
            assert len(got) == len(want) and np.allclose([s for s, _ in got], [s for s, _ in want])
            assert all(abs(sum(q[w] * vectors[i].get(w, 0) for w in q) - s) < 1e-12 for s, i in got)


def test_votes_and_calibration():
    """A vote by hand; the rising curve against every rising step function on a grid, in weighted squares."""
    import itertools

    index = tn.Index.build({}, {}, [(i, y, [], np.zeros(0, np.int64)) for i, y in enumerate((1, 0, 1))])
    index.labels = np.array([1, 0, 1])
    p, c = 0.2, tn.PRIOR_WEIGHT
    assert abs(index.vote([(0.5, 0), (0.3, 1)], p) - (0.25 + c * p) / (0.34 + c)) < 1e-12 and abs(index.vote([], p) - p) < 1e-12
    rng = np.random.default_rng(2)
    for _ in range(20):
        x, y, w = rng.integers(0, 5, 9) / 5, rng.integers(0, 2, 9).astype(float), rng.random(9) + 0.1
        knots, values = tn.isotonic(x, y, w)
        assert (np.diff(values) >= 0).all() and set(knots) <= set(x)
        places = np.unique(x)
        means = [np.average(y[x == v], weights=w[x == v]) for v in places]
        cost = lambda f: sum(w[x == v].sum() * (m - z) ** 2 for v, m, z in zip(places, means, f))
        grid = np.linspace(0, 1, 9)
        least = min(cost(f) for f in itertools.product(grid, repeat=len(places)) if list(f) == sorted(f))
        # With many observations a quarter of one on either side of a pool changes nothing.
        many = tn.isotonic(x, y, w * 1e9)
        assert cost(np.interp(places, *many)) <= least + 1e-6


def test_held_out_accuracy(spark):
    sf = SF.replace("0.001", "0.1")
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    rows = tn.toxicity_report(docs, labels).where("held_out").join(labels, "doc_id").select("score", "predicted", "toxic").collect()
    good = sorted(r["score"] for r in rows if r["toxic"] == 1)
    bad = np.array(sorted(r["score"] for r in rows if r["toxic"] == 0))
    auc = np.mean([(bad < s).mean() + 0.5 * (bad == s).mean() for s in good])
    caught = np.mean([r["predicted"] for r in rows if r["toxic"] == 1])
    false = np.mean([r["predicted"] for r in rows if r["toxic"] == 0])
    print(auc, caught, false, np.mean([r["score"] for r in rows]), np.mean([r["toxic"] for r in rows]))
    assert auc > 0.8 and caught > 0.7 and false < 0.02


def test_edge_cases(spark):
    docs = spark.createDataFrame([(i, "you fool" if i % 2 else "fine day", 9) for i in range(40)] + [(40, None, 9), (40, None, 9), (41, "", 9)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    rows = tn.toxicity_report(docs, labels).collect()
    assert len(rows) == 43 and all(0 <= r["score"] <= 1 for r in rows)
    assert {r["predicted"] for r in rows if r["doc_id"] < 40 and r["doc_id"] % 2} == {1}
    assert {r["predicted"] for r in rows if r["doc_id"] < 40 and r["doc_id"] % 2 == 0} == {0}
    assert {r["score"] for r in tn.toxicity_report(docs, labels.limit(0)).collect()} == {0.0}
    assert tn.toxicity_report(docs.limit(0), labels.limit(0)).count() == 0


def test_every_word_of_the_examples_counts(spark):
    """A tell-tale word of two examples finds them, and the neighbours are those of all cosines over all words."""
    rng = random.Random(5)
    texts = [" ".join(rng.choices([f"w{j}" for j in range(60)], k=12)) for _ in range(120)] + ["quibblesnark", "quibblesnark zounds"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, "quibblesnark indeed", "unheard"])], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 9 == 0 or i >= 120)) for i in range(len(texts))], "doc_id long, label int")
    model = tn.fit(docs, labels)
    got = {r["doc_id"]: r["evidence"] for r in tn.score(docs, model, keep=["doc_id"]).collect()}
    assert {e["example"] for e in got[122]} == {"120", "121"} and all(e["label"] == 1 for e in got[122]) and got[123] == []
    counts = [tn.word_counts(r["text"]) for r in docs.orderBy("doc_id").collect()]
    words = {w for c in counts[: len(texts)] for w in c}
    toxic, n = [i % 9 == 0 or i >= 120 for i in range(len(texts))], len(texts)

    def weight(w):
        a, b = (sum(w in c for c, t in zip(counts, toxic) if t == y) for y in (True, False))
        chi2 = n * (a * (n - sum(toxic) - b) - b * (sum(toxic) - a)) ** 2 / ((a + b) * (n - a - b) * sum(toxic) * (n - sum(toxic)))
        return (np.log((1 + len(counts)) / (1 + sum(w in c for c in counts))) + 1) * (1 + np.sqrt(chi2))

    order = sorted(words)
    weights = np.array([weight(w) for w in order])
    matrix = np.array([[(1 + np.log(c[w])) if c[w] else 0 for w in order] for c in counts]) * weights
    matrix /= np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-12)
    cosines = matrix @ matrix[: len(texts)].T
    for i, row in enumerate(cosines):
        want = sorted((x for x in row if x > 0), reverse=True)[: tn.K]
        assert np.allclose([e["cosine"] for e in got[i]], want)
        assert np.allclose([row[int(e["example"])] for e in got[i]], want)
