"""Every stage on its own input, and the whole run."""

import random
import re

import corpus_pipeline as cp
from medialake.llm import contextual_pii, packing, wu_manber
from medialake.llm.common import table, written
from tests.llm.test_packing import check
from tests.llm.test_parity_join import brute
from tests.oracle import SF


def test_stages(spark):
    docs = table(spark, SF, "documents")
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    for name, stage in cp.STAGES[:-1]:
        out = written(stage(spark, docs, SF), name)
        assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes)
        after = {r["doc_id"]: r["text"] for r in out.collect()}
        assert set(after) <= set(before) and len(after) > 0.5 * len(before)
        if name == "near_duplicates":
            classes = brute(list(before.items()), 5, 8, 10)
            assert set(after) == {d for d, (_, c) in classes.items() if d == c}
        elif name == "decontamination":
            windows = {tuple(w) for r in table(spark, SF, "benchmark").collect() for m, ps in wu_manber.patterns_of([(r["item_id"], r["text"])]).items() for w in ps}
            def clean(t):
                ws = wu_manber.words_of(t)
                return not any(tuple(ws[i : i + m]) in windows for m in {len(w) for w in windows} for i in range(len(ws) - m + 1))
            assert set(after) == {d for d, t in before.items() if clean(t)}
        elif name == "personal_data":
            assert set(after) == set(before) and all(re.sub(r"<(?:email|ip|card|phone)>", "", t) == t or contextual_pii.base_spans(before[d]) for d, t in after.items())
            assert not any(contextual_pii.base_spans(t) for t in after.values())
        docs, before = out, after
    tokenizer = packing.tokenizer_of(packing.default_tokenizer()).tokenizer
    check(cp.packed(spark, docs, SF).collect(), list(before.items()), 2048, tokenizer)


def test_clashing_columns_and_edge_cases(spark):
    rows = [(1, None, "en", "s", 3, 0.1, 5), (2, "", "en", "s", 0, 0.1, 5), (3, "call +1 (555) 555-1234 or a@b.com " * 3, "en", "s", 9, 0.1, 5), (3, "call +1 (555) 555-1234 or a@b.com " * 3, "en", "s", 9, 0.1, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, n_hit int")
    for name, stage in cp.STAGES[:-1]:
        out = written(stage(spark, docs, SF), name)
        assert out.columns == docs.columns and out.count() == (4 if name == "toxicity" else 3)
        assert stage(spark, docs.limit(0), SF).count() == 0
        docs = out
    assert cp.packed(spark, docs, SF).select("doc_id").distinct().count() == 3


def test_near_duplicates_by_row(spark):
    """Repeated and null ids: of each group of near copies one row stays, and no other row goes."""
    rng = random.Random(4)
    words = [f"w{i}" for i in range(300)]
    base = [" ".join(rng.choices(words, k=80)) for _ in range(6)]
    near = [t + " tail" for t in base]
    rows = [(5, base[0]), (5, base[1]), (4, near[0]), (None, near[1]), (None, base[2]), (None, near[2]), (7, base[3]), (7, near[3]), (7, near[3]), (8, base[4]), (9, None), (9, None), (None, ""), (2, base[5])]
    docs = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, number int").repartition(4)
    out = cp.near_duplicates(spark, docs, SF).collect()
    groups = brute([(k, t) for k, (_, t) in enumerate(rows)], 5, 8, 10)
    members = {}
    for k, (_, c) in groups.items():
        members.setdefault(c, []).append(k)
    kept = {r["number"] for r in out}
    assert len(kept) == len(out) == len(members)
    for own in members.values():
        (k,) = kept & set(own)
        ids = [rows[i][0] for i in own]
        assert rows[k][0] == min((i for i in ids if i is not None), default=None)
