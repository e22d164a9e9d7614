"""The filter audit beside a loop over all orders, and its empty, null and repeated cases."""

import random
import re
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from medialake.llm import filter_audit

DOCS = "doc_id long, text string, lang string, part string, good string, A int"
LABELS = "doc_id long, quality int, toxic int"


def plain(docs, labels):
    rows = []
    for doc_id, text, lang in docs:
        t = text or ""
        ws = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {
            "A": len(ws) < 200, "B": 100 * len(set(ws)) < 50 * len(ws), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search(r"[#$%&*|]", t)),
            "E": doc_id is not None and any(i is not None and i < doc_id and (x or "") == t for i, x, _ in docs),
        }
        own = [x for x in labels if x[0] == doc_id and doc_id is not None]
        rows.append((lang or "", fails, any(x[1] == 1 for x in own), any(x[2] == 1 for x in own)))
    out, total = {}, {}
    for part in {r[0] for r in rows}:
        of = [r for r in rows if r[0] == part]
        for order in permutations("ABCDE"):
            left = of
            for step, f in enumerate(order, 1):
                gone = [r for r in left if r[1][f]]
                kept = [r for r in left if not r[1][f]]
                redundant = sum(r[1][f] for r in of) - len(gone)
                unique = sum(r[1][f] and sum(r[1].values()) == 1 for r in of)
                out[part, "".join(order), step] = [len(kept), len(gone), redundant, unique, sum(r[2] for r in gone), sum(r[3] for r in gone)]
                total[part, f] = total.get((part, f), 0) + len(gone)
                left = kept
    return {k: (*v, total[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def report(spark, docs, labels):
    d = spark.createDataFrame([(*x, "clash", "x", 7) for x in docs], DOCS)
    rows = filter_audit.interaction_report(d, spark.createDataFrame(labels, LABELS)).collect()
    found = {(r["part"], r["filter_order"], r["step"]): (r["kept"], r["removed"], r["redundant"], r["unique_fails"], r["good_lost"], r["toxic_lost"], r["shapley"]) for r in rows}
    assert len(found) == len(rows)
    return found


def corpus():
    rng = random.Random(5)
    docs = []
    for i in range(70):
        n = rng.choice([1, 50, 199, 200, 201, 260])
        words = [f"w{rng.randrange(rng.choice([30, 400]))}" for _ in range(n)]
        words = [w.upper() if rng.random() < rng.choice([0, 0.2]) else w for w in words]
        docs.append((i, rng.choice([" ", "\t", "\x0b \n"]).join(words) + rng.choice(["", "", " #", "|", " x"]), rng.choice(["en", "de", None, ""])))
    docs += [(100 + i, docs[i % 5][1], "en") for i in range(20)] + [(5, docs[5][1], "en"), (5, docs[5][1], "en"), (200, None, None), (201, "", "fr"), (None, "", "fr"), (None, docs[0][1], "fr"), (300, "word " * 300_000, "long")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 110, 2)] + [(2, 1, 1), (2, 0, 0), (None, 1, 1)]
    return docs, labels


def test_every_order_as_a_loop_has_it(spark):
    docs, labels = corpus()
    assert report(spark, docs, labels) == plain(docs, labels)


def test_empty_tables(spark):
    assert report(spark, [], []) == {}
    assert report(spark, [(1, "a", "en")], []) == plain([(1, "a", "en")], [])


def test_states_are_visited_once(spark):
    rows = spark.range(40).select(F.lit("p").alias("part"), *[(F.col("id") % d == 0).alias(f"f{d}") for d in (2, 3, 5)])
    edges = filter_audit.walk(rows, {f: F.col(f) for f in ("f2", "f3", "f5")})
    found = edges.select("state", "filter").collect()
    assert len(found) == len(set(found)) == 3 * 4
    assert not spark.sparkContext._jsc.getPersistentRDDs() or rows.storageLevel.useMemory is False


def test_null_conditions_remove_nothing_and_too_many_filters_are_refused(spark):
    rows = spark.createDataFrame([("p", None), ("p", True)], "part string, f boolean")
    assert [r["removed"] for r in filter_audit.audit(rows, {"f": F.col("f")}).collect()] == [1]
    with pytest.raises(ValueError):
        filter_audit.walk(rows, {str(i): F.col("f") for i in range(8)})
