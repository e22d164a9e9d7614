"""The prefix trie beside a plain dictionary of prefixes."""

import hashlib
import random
import zlib

from medialake.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, d int, x1 string"


def plain(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [x[2:] for x in sorted(v)] for c, v in convs.items()}
    built = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        built[c] = tuple(turns.get(base, [])[:h] + own[h:])
    members = {}
    for c, xs in built.items():
        for d in range(len(xs) + 1):
            members.setdefault(xs[:d], []).append(c)
    kids, leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for x in members:
        if x:
            kids[x[:-1]] += 1
    for x, m in members.items():
        own = (len(m) - 1) * len(x[-1][1]) if x else 0
        for d in range(len(x) + 1):
            leaves[x[:d]] += kids[x] == 0
            saved[x[:d]] += own
    ends = {x: ",".join(str(c) for c in sorted(m) if len(built[c]) == len(x)) for x, m in members.items()}
    return sorted((min(m), len(x), min(members[x[:-1]]) if x else -1, len(m), kids[x], leaves[x], saved[x], hashlib.sha256(ends[x].encode()).hexdigest()) for x, m in members.items())


def report(spark, rows):
    df = spark.createDataFrame([(*r, 3, "clash") for r in rows], SCHEMA)
    out = prefix_trie.trie_report(df)
    assert out.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(tuple(-1 if v is None else v for v in r) for r in out.collect())


def test_random_conversations(spark):
    rng = random.Random(3)
    rows = []
    for c in [*range(0, 12), *range(95, 130), *range(200, 203), 555, 599, -3, -150, -200]:
        for t in range(rng.choice([1, 1, 2, 5, 8])):
            rows.append((c, t, rng.choice(["user", "bot", None]), rng.choice(["hi", "yes é", "no", None, "long " * 9])))
    rows += [(101, None, "user", "before all"), (101, 0, "user", "tie a"), (101, 0, "bot", "tie b"), (7, 1, "user", "hi"), (7, 1, "user", "hi"), (None, 1, "user", "hi")]
    rng.shuffle(rows)
    assert report(spark, rows) == plain(rows)


def test_long_and_hot_conversations(spark, monkeypatch):
    """One conversation of many turns and one shared by many, with blocks and chunks far smaller than they are."""
    monkeypatch.setattr(prefix_trie, "BLOCK", 4)
    monkeypatch.setattr(prefix_trie, "CHUNK", 8)
    rows = [(0, t, "user", f"turn {t % 7}") for t in range(300)] + [(50_000, t, "user", f"turn {t % 7}") for t in range(290)]
    rows += [(c, t, "user", ("same " * t).strip()) for c in range(1000, 1100) for t in range(4)]
    assert report(spark, rows) == plain(rows)


def test_empty_and_turnless(spark):
    assert report(spark, []) == []
    few = [(c, 1, "user", "only") for c in (3, 104, 205, 306)]  # each has one turn, which a shared head may replace
    assert report(spark, few) == plain(few)


def test_conversations_as_they_are(spark):
    rows = spark.createDataFrame([(1, 1, "u", "a"), (1, 2, "b", "bb"), (2, 1, "u", "a"), (2, 2, "b", "c")], "conv_id long, turn long, role string, text string")
    turns = prefix_trie.written(prefix_trie.numbered_turns(rows), "test-turns")
    out = {(r["depth"], r["conv_id"]): r for r in prefix_trie.trie(prefix_trie.whole(turns)).collect()}
    assert set(out) == {(0, 1), (1, 1), (2, 1), (2, 2)}
    assert out[0, 1]["n_leaves"] == 2 and out[0, 1]["saved_tokens"] == 1
