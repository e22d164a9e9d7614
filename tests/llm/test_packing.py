"""Packing against the tokenizer itself, as an exact round trip."""

import array
import zlib

from medialake.llm import packing
from medialake.llm.common import table
from tests.oracle import SF


def check(pieces, texts, capacity, tokenizer):
    sequences, docs = {}, {}
    for p in pieces:
        sequences.setdefault(p["sequence_id"], []).append(p)
        docs.setdefault(p["doc_id"], []).append(p)
    for own in sequences.values():
        at = 0
        for p in sorted(own, key=lambda p: p["offset"]):
            assert p["offset"] == at and p["length"] > 0
            at += p["length"]
        assert at <= capacity
    assert set(docs) == {d for d, _ in texts}
    for d, t in texts:
        ids = array.array("I", tokenizer.encode(t or "", add_special_tokens=False).ids + [1]).tobytes()
        at = 0
        for p in sorted(docs[d], key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] * 4 == len(ids)
            at += p["length"]
            assert zlib.crc32(ids[4 * p["start"] : 4 * at]) == p["ids_crc32"]
        assert at * 4 == len(ids)
    return len(sequences)


def test_round_trip_whole_table(spark):
    docs = table(spark, SF, "documents")
    texts = [(r["doc_id"], r["text"]) for r in docs.collect()]
    tokenizer = packing.tokenizer_of(packing.default_tokenizer()).tokenizer
    pieces = packing.packing_report(docs).collect()
    n = check(pieces, texts, 2048, tokenizer)
    total = sum(p["length"] for p in pieces)
    assert n <= -(-total // 2048) + docs.rdd.getNumPartitions()


def test_edge_cases(spark):
    texts = [(1, None), (2, ""), (3, "a"), (4, "İstanbul ΣΑΣ é 日本 it's <|endoftext|> 1²"), (5, "x " * 9000), (6, "don't!! we'll\t\n(12.5)")]
    docs = spark.createDataFrame([(d, t, 0, "z") for d, t in texts], "doc_id long, text string, tokens int, sequence_id string")
    tokenizer = packing.tokenizer_of(packing.default_tokenizer()).tokenizer
    check(packing.packing_report(docs).collect(), texts, 2048, tokenizer)
    assert packing.packing_report(docs.limit(0)).count() == 0


def test_level_choice_is_the_least_sum_of_squares():
    levels = packing.LevelArray(10)
    for level in (3, 3, 3, 6, 7, 7):
        levels.put(level, [])
    for size in range(1, 10):
        def cost(level):
            after = levels.counts.copy()
            if level:
                after[level] -= 1
            if level + size < 10:
                after[level + size] += 1
            return int((after[1:10] ** 2).sum())
        options = [0] + [x for x in range(1, 10) if levels.counts[x] and x + size <= 10]
        assert cost(levels.best_level(size)) == min(map(cost, options))


def test_words_are_remembered_once_and_for_the_task_only(spark):
    words = [a + b + c for a in "bcdfghklmn" for b in "aeiou" for c in ("zq", "xv", "wj")]
    own = packing.WordTokenizer(packing.default_tokenizer())
    own(" ".join([*words, "baz-bazq"]))
    held = [x for x in [own.words, *[c.cell_contents for c in own.words.make.__closure__]] if isinstance(x, dict) and "bazq" in x]
    assert len(held) == 1 and set(words) <= set(held[0])

    def remembered(batches):
        import pyarrow as pa

        for _ in batches:
            yield pa.RecordBatch.from_pydict({"n": [sum(len(t.words) for t in packing._tokenizers.values())]})

    packing.packing_report(spark.createDataFrame([(i, " ".join(words)) for i in range(8)], "doc_id long, text string").repartition(4)).collect()
    assert {r["n"] for r in spark.range(0, 8, 1, 4).mapInArrow(remembered, "n long").collect()} == {0}
