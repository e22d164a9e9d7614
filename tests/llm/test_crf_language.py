"""The CRF: its recursion against all labellings, code-switched texts, held-out accuracy."""

import itertools

import numpy as np

from medialake.llm import crf_language as crf
from medialake.llm.common import table
from tests.oracle import SF


def test_marginals_against_all_labellings():
    rng = np.random.default_rng(5)
    t, s = rng.random((3, 3)) + 0.1, rng.random(3)
    lengths = [1, 5, 8, 2]
    e = rng.random((sum(lengths), 3))
    got, at = crf.marginals(e, lengths, t, s, block=3), 0
    for n in lengths:
        p = np.zeros((n, 3))
        for y in itertools.product(range(3), repeat=n):
            w = s[y[0]] * np.prod([e[at + i, y[i]] for i in range(n)]) * np.prod([t[a, b] for a, b in zip(y, y[1:])])
            for i in range(n):
                p[i, y[i]] += w
        assert np.allclose(got[at : at + n], p / p.sum(axis=1, keepdims=True))
        at += n


def test_held_out_accuracy_and_switches(spark):
    docs = table(spark, SF.replace("0.001", "0.01"), "documents")
    rows = crf.language_report(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang_pred <> 'und'").collect()
    right = np.mean([r["lang"] == r["lang_pred"] for r in rows])
    print(len(rows), right)
    assert right > 0.95 and all(0 <= r["score"] <= 1 for r in rows)
    texts = {}
    for r in docs.where("length(text) > 400").select("lang", "text").collect():
        texts.setdefault(r["lang"], r["text"])
    judge = crf.Judge(crf.fit(docs, per_language=20))
    en, fr = crf.words_of(texts["en"])[:60], crf.words_of(texts["fr"])[:60]
    f, _ = judge.factors(en + fr)
    p = crf.marginals(f, [120], judge.transitions, judge.start)
    names = judge.model.languages
    assert (p[:60].argmax(axis=1) == names.index("en")).mean() > 0.9 and (p[60:].argmax(axis=1) == names.index("fr")).mean() > 0.9


def test_edge_cases(spark):
    rows = [(1, None, "en", 0.5), (1, None, "en", 0.5), (2, "12 -- ½", "en", 0.5), (3, "the cat sat", "en", 0.5), (4, "le chat dort", None, 0.5), (6, "x" * 5000 + " le chat", "fr", 0.5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    got = crf.language_report(docs).collect()
    assert len(got) == 6 and {(r["lang_pred"], r["score"]) for r in got if r["doc_id"] < 3} == {("und", 0.0)}
    assert {r["lang_pred"] for r in got if r["doc_id"] > 2} <= {"en", "fr"}
    assert crf.language_report(docs.limit(0)).count() == 0
