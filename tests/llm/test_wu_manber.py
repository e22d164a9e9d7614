"""The search against a plain scan for every window."""

import random

from medialake.llm import wu_manber as wm
from medialake.llm.common import table
from tests.oracle import SF, compare, connection


def plain(docs, items, window=10):
    """(n_words, n_hit, items) of each document."""
    patterns = [(i, w[k : k + m]) for i, t in items if i is not None and (w := wm.words_of(t)) for m in [min(window, len(w))] for k in range(len(w) - m + 1)]
    out = []
    for t in docs:
        w = wm.words_of(t)
        hit, found = set(), set()
        for i, p in patterns:
            for k in range(len(w) - len(p) + 1):
                if w[k : k + len(p)] == p:
                    hit.update(range(k, k + len(p)))
                    found.add(i)
        out.append((len(w), len(hit), sorted(found)))
    return out


def fixture(seed):
    rng = random.Random(seed)
    words = [*"abcde", "é", "ｗ", "x9"]
    text = lambda n: " ".join(rng.choices(words, k=n))
    items = [(i, text(rng.choice([1, 2, 3, 9, 10, 11, 25]))) for i in range(12)] + [(50, None), (51, "-- ,"), (None, "a b c"), (3, "b b b b"), (60, "a-b-a-b-a-b-a-b-a-b-a-b")]
    docs = [text(rng.choice([0, 1, 5, 40, 120])) + rng.choice([" ", "; ", "... "]) + rng.choice(items)[1 if rng.random() < 0.9 else 1].__str__() for _ in range(60)]
    docs += [" ".join(("A-B " * 30).split()), None, "", "no hit here"]
    return docs, items


def searched(spark, docs, items, **how):
    d = spark.createDataFrame([(7, t, i, 3) for i, t in enumerate(docs)], "doc_id long, text string, place int, n_hit int").repartition(3)
    b = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    rows = wm.find_hits(d, b, keep=["place", "n_hit"], **how).collect()
    for r in rows:
        assert r["n_hit"] == sum(s["end"] - s["start"] for s in r["spans"]) and all(a["end"] < b["start"] for a, b in zip(r["spans"], r["spans"][1:]))
    return [(r["n_words"], r["n_hit"], r["items"]) for r in sorted(rows, key=lambda r: r["place"])]


def test_against_every_window(spark):
    for seed in (1, 2):
        docs, items = fixture(seed)
        want = plain(docs, items)
        assert sum(n > 0 for _, n, _ in want) > 10
        assert searched(spark, docs, items) == want
        if seed == 1:  # one block after the other
            assert searched(spark, docs, items, block_chars=60) == want


def test_random_windows_without_spark():
    rng = random.Random(9)
    for _ in range(300):
        items = [(i, " ".join(rng.choices("ab", k=rng.randint(1, 14)))) for i in range(4)]
        text = " ".join(rng.choices("ab", k=60))
        words = wm.words_of(text)
        hit, found = bytearray(len(words)), set()
        for m, by in wm.patterns_of(items).items():
            wm.Searcher(m, by).search(words, hit, found)
        assert (len(words), hit.count(1), sorted(found)) == plain([text], items)[0]


def test_empty_tables_and_whole_table(spark):
    docs, bench = table(spark, SF, "documents"), table(spark, SF, "benchmark")
    assert wm.decontamination_report(docs.limit(0), bench).count() == 0
    assert wm.decontamination_report(docs, bench.limit(0)).where("n_hit > 0 or n_items > 0").count() == 0
    assert compare(wm.decontamination_report(docs, bench), connection(SF), wm.ORACLE_SQL) == 200
