"""Personal data: seeds against the plain expressions, and patterns that find what no rule knows."""

import hashlib
import random
import re
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from medialake.llm import contextual_pii as pii
from medialake.llm.common import table
from tests.oracle import SF

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain(text):
    out = []
    for k, x in PLAIN.items():
        for m in re.finditer(x, text or ""):
            n = len(re.sub("[^0-9]", "", m[0]))
            if k == "ip" and max(map(int, m[0].split("."))) > 255 or k == "card" and not (12 <= n <= 19 and pii.luhn(re.sub("[^0-9]", "", m[0]))) or k == "phone" and not 9 <= n <= 15:
                continue
            out.append((m.start(), m.end(), k))
    return sorted(out, key=lambda s: (s[0], pii.KINDS.index(s[2])))


@settings(max_examples=400, deadline=None)
@given(st.text("a.@-+ 0123459(%é:", max_size=60))
def test_seeds_are_the_plain_matches(text):
    assert pii.base_spans(text) == plain(text)


def test_whole_table(spark):
    docs = table(spark, SF.replace("0.001", "0.01"), "documents")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = pii.personal_data_report(docs).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = plain(texts[r["doc_id"]])
        said = ",".join(f"{k}:{s}:{e}" for s, e, k in want)
        assert r["base_sha256"] == hashlib.sha256(said.encode()).hexdigest() and set(filter(None, said.split(","))) <= set(r["spans"].split(","))
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(x[2] == k for x in want) for k in pii.KINDS]


def plain_spans(texts):
    """All spans by a plain reading of the definition: dictionaries, whole texts, no tables."""
    mentions, totals = Counter(), Counter()
    cut = lambda t: [w[-pii.LONG_WORD :] for w in t.lower().split()]
    before = lambda t, at: ["^", "^", *cut(t[:at])][-2:]
    for t in texts:
        words = ["^", "^", *cut(t or "")]
        totals.update(words)
        totals.update(f"{a} {b}" for a, b in zip(words, words[1:]))
        seeds = pii.base_spans(t)
        for own, seed in ((seeds, 1.0), (pii.like_spans(t, seeds), 0.0)):
            for s, e, k in own:
                b = before(t, s)
                mentions.update({(b[1], k, t[s:e].lower(), seed): 1})
                mentions.update({(" ".join(b), k, t[s:e].lower(), seed): 1})
    values, edges, seeds = {}, Counter(), {}
    for (p, k, v, seed), n in mentions.items():
        values.setdefault((p, k), set()).add(v)
        edges[p, k, v] += n
        seeds[p, k, v] = max(seeds.get((p, k, v), 0.0), seed)
    edges = {x: n for x, n in edges.items() if len(values[x[:2]]) >= pii.SUPPORT}
    start = {}
    for p, k, v in edges:
        start[k, v] = max(start.get((k, v), 0.0), seeds[p, k, v])
    confidence, scores = dict(start), {}
    for _ in range(pii.ROUNDS):
        scores = {}
        for (p, k, v), n in edges.items():
            scores[p, k] = scores.get((p, k), 0.0) + n * confidence[k, v]
        scores = {(p, k): min(1.0, s / (totals[p] + 1)) for (p, k), s in scores.items()}
        confidence = dict(start)
        for p, k, v in edges:
            confidence[k, v] = max(confidence[k, v], scores[p, k])
    good = {x for x, s in scores.items() if s >= pii.CONFIDENCE}
    out = []
    for t in texts:
        own = pii.base_spans(t)
        own += [(s, e, k) for s, e, k in pii.like_spans(t, own) if (before(t, s)[1], k) in good or (" ".join(before(t, s)), k) in good]
        out.append(",".join(f"{k}:{s}:{e}" for s, e, k in sorted(own, key=lambda x: (x[0], pii.KINDS.index(x[2])))))
    return out, good


def test_spans_against_plain_bootstrap(spark):
    """Every span, also those that only the second round reaches, long words, and a place far from any white space."""
    rng = random.Random(8)
    words = ["mail:", "call", "host", "from", "the", "card", "no.", "x" * 300, "y" * 1000]
    def value():
        return rng.choice([f"u{rng.randrange(30)}@mail.example.com", f"u{rng.randrange(9)}@intranet", f"10.0.{rng.randrange(300)}.7", f"+1 555 {rng.randrange(100, 999)} 1234", f"(0{rng.randrange(10, 40)}) 555-{rng.randrange(1000, 9999)}", f"{rng.randrange(10**11, 10**12)}"])
    likely = {"mail:": lambda: rng.choice([f"u{rng.randrange(30)}@mail.example.com", f"u{rng.randrange(9)}@intranet"]), "x" * 300: lambda: f"10.0.{rng.randrange(300)}.7", "call": lambda: f"+1 555 {rng.randrange(100, 999)} 1234"}
    def pair():
        w = rng.choice(words)
        return w, likely[w]() if w in likely and rng.random() < 0.95 else rng.choice(["is", "was", value()])
    texts = ["  ".join(x for _ in range(rng.randint(0, 12)) for x in pair()) for _ in range(150)] + [None, "", "z" * 5000 + "a@b.c," + "w" * 200 + "@q"]
    want, good = plain_spans(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert set(pii.learn(docs)) == good and len(good) > 3
    assert [r["spans"] for r in sorted(pii.personal_data_report(docs).collect(), key=lambda r: r["doc_id"])] == want
    assert sum(w.count(",") for w in want) > sum(max(0, len(pii.base_spans(t)) - 1) for t in texts)


def test_patterns_discover_and_spare(spark):
    rows = [(i, f"Hello there. Reach me under mail: user{i}@mail.example.com or the office.") for i in range(6)]
    rows += [(10, "Reach me under mail: someone@intranet please"), (11, "see someone@there now"), (12, None), (13, ""), (13, "")]
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, spans string")
    got = sorted(((r["doc_id"], r["spans"]) for r in pii.personal_data_report(docs).collect()))
    assert (10, "email:21:37") in got and (11, "") in got and got.count((13, "")) == 2 and (12, "") in got
    assert pii.personal_data_report(docs.limit(0)).count() == 0
    assert pii.mask_text("a b@c.d e", [(2, 7, "email", True)]) == "a <email> e"


def test_no_supported_pattern_is_dropped(spark):
    """A pattern without seeds of its own, reached by shared instances, is scored beside 20,100 with seeds."""
    rows = [(d, " ".join(f"w{i} u{i}{x}@h.co" for i in range(d * 201, d * 201 + 201) for x in "abc")) for d in range(100)]
    rows += [(1000 + i, f"reach s{i}@mail.co") for i in range(30)]
    rows += [(2000 + i, f"reach n{i}@intranet") for i in range(9)] + [(3000 + i, f"zz: n{i}@intranet") for i in range(9)]
    rows += [(4000, "zz: other@host")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in pii.personal_data_report(docs.where("doc_id >= 100")).collect()}
    assert got[4000] == "email:4:14"
    model = pii.learn(docs)
    assert ("zz:", "email") in model and sum(p[0].startswith("w") for p in model) == 20_100
    assert abs(model["w7", "email"] - 3 / 4) < 1e-9
