"""Katz backoff against a plain model, and its probabilities' sums."""

import math
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from medialake.llm import katz
from medialake.llm.common import held_out, table
from tests.oracle import SF


def plain(texts):
    lines = [[katz.START, *(t or "").encode().lower().decode().split(), katz.END] for _, t in texts]
    train = [x for x, (d, _) in zip(lines, texts) if zlib.crc32(str(d).encode()) % 7 != 2]
    uni, bi = Counter(w for x in train for w in x[1:]), Counter(p for x in train for p in zip(x, x[1:]))
    n = sum(uni.values())

    def discount(counts):
        f = katz.good_turing(Counter(counts.values()))
        return {k: c * f.get(c, 1.0) for k, c in counts.items()}

    u = {w: d / n for w, d in discount(uni).items()}
    unknown = 1 - sum(u.values())
    if unknown <= 1e-12:
        unknown = 1 / (n + 1)
        m = sum(u.values())
        u = {w: p * (1 - unknown) / m for w, p in u.items()}
    by = {}
    for (h, w), d in discount(bi).items():
        by.setdefault(h, {})[w] = d
    model = {}
    for h, ds in by.items():
        hc = sum(bi[h, w] for w in ds)
        scale = (hc - 0.5) / hc if all(bi[h, w] > katz.LARGEST for w in ds) else 1.0  # nothing would be left for unseen words
        ps = {w: d * scale / hc for w, d in ds.items()}
        model[h] = (ps, (1 - sum(ps.values())) / (1 - sum(u[w] for w in ps)))
    return lines, uni, n, u, unknown, model


def p_of(h, w, u, unknown, model):
    ps, alpha = model.get(h, ({}, 1.0))
    return ps[w] if w in ps else alpha * u.get(w, unknown)


@pytest.mark.parametrize(("hot", "bucket"), [(katz.HOT, katz.BUCKET), (300, 3000)])
def test_whole_table(spark, monkeypatch, hot, bucket):
    """Also with few frequent words and many buckets, so that rare words and split contexts occur."""
    monkeypatch.setattr(katz, "HOT", hot)
    monkeypatch.setattr(katz, "BUCKET", bucket)
    docs = table(spark, SF, "documents")
    texts = [(r["doc_id"], r["text"]) for r in docs.collect()]
    lines, uni, n, u, unknown, model = plain(texts)
    for h in list(model)[:50]:
        assert abs(sum(p_of(h, w, u, unknown, model) for w in u) + p_of(h, None, u, unknown, model) - 1) < 1e-9
    got = {r["doc_id"]: r for r in katz.language_model_report(docs).collect()}
    assert len(got) == len(texts)
    for (d, _), x in zip(texts, lines):
        r = got[d]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(x) - 1, sum(w in uni for w in x[1:]), n)
        assert math.isclose(r["base_score"], sum(math.log10((uni[w] + 1) / (n + len(uni) + 1)) for w in x[1:]), rel_tol=1e-9)
        assert math.isclose(r["score"], sum(math.log10(p_of(h, w, u, unknown, model)) for h, w in zip(x, x[1:])), rel_tol=1e-9)
        assert r["held_out"] == (zlib.crc32(str(d).encode()) % 7 == 2)


@pytest.mark.parametrize("bucket", [katz.BUCKET, 60])
def test_contexts_of_large_counts_only(spark, monkeypatch, bucket):
    """They set half a count aside; also where they're split among buckets that can't see it."""
    monkeypatch.setattr(katz, "BUCKET", bucket)
    texts = [(i, "a b") for i in range(150)] + [(i, "a c" if i % 2 else "b a d") for i in range(150, 190)] + [(i, f"x{i} b b zz") for i in range(190, 200)]
    lines, _, _, u, unknown, model = plain(texts)
    assert {h for h, (ps, _) in model.items() if len(ps) < 3} >= {"d", "c"}
    got = {r["doc_id"]: r["score"] for r in katz.language_model_report(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    for (d, _), x in zip(texts, lines):
        assert math.isclose(got[d], sum(math.log10(p_of(h, w, u, unknown, model)) for h, w in zip(x, x[1:])), rel_tol=1e-9)


def test_tables(spark, monkeypatch):
    """Pair counts and contexts' weights as the plain model has them."""
    monkeypatch.setattr(katz, "HOT", 300)
    docs = table(spark, SF, "documents")
    lines, *_, model = plain([(r["doc_id"], r["text"]) for r in docs.collect()])
    _, fitted, kinds = katz.score(docs, ~held_out("doc_id", 7, 2), pairs_too=True)
    assert kinds.where(F.col("kind") == katz.PAIR).count() == sum(len(ps) for ps, _ in model.values())
    assert sorted(r["c"] for r in fitted.unigrams.collect()) == sorted(Counter(w for x, r in zip(lines, docs.collect()) if zlib.crc32(str(r["doc_id"]).encode()) % 7 != 2 for w in x[1:]).values())
    got = sorted(r["alpha"] for r in fitted.contexts.collect())
    assert len(got) == len(model) and all(math.isclose(a, b, rel_tol=1e-9) for a, b in zip(got, sorted(alpha for _, alpha in model.values())))


def test_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, 1), (1, None, 1), (2, "a  B a", 1), (3, "", 1)], "doc_id long, text string, score int")
    rows = katz.language_model_report(docs).collect()
    assert sorted((r["doc_id"], r["n_tokens"]) for r in rows) == [(1, 1), (1, 1), (2, 4), (3, 1)] and all(r["score"] <= 0 for r in rows)
    assert katz.language_model_report(docs.limit(0)).count() == 0
