"""Personal data by patterns of context bootstrapped from seed entities.

1. *Seeds.* E-mail addresses, IP addresses, card and phone numbers of a plain
   form (``BASE``). They're always found.
2. *Instances.* Seeds, and whatever has a similar shape without being one (an
   address without a dot, a number with other separators or a wrong check
   digit).
3. *Patterns.* The word before an instance, and the two words before it, with
   the instance's kind; those with at least ``SUPPORT`` different instances.
4. *Scores.* Spark scores the graph of patterns and instances in ``ROUNDS``
   rounds. A seed counts 1. A pattern's confidence is the sum of its occurrences
   before instances, each with the instance's confidence, over all occurrences
   of its words in the corpus (plus one). An instance's confidence is that of
   its best pattern.
5. *Discovery.* An instance after a pattern of ``CONFIDENCE`` or more is found,
   though no seed rule knows it. All supported patterns are scored; the confident
   ones, however many, make the model that is sent to the workers.

Counts are added up in each task before they're shuffled; texts are never.

Defined results: a null text is empty; a repeated row is returned as often; an
empty table gives an empty table; other columns are dropped unless named in
``keep``. A discovered span that overlaps a seed's is dropped; of two that
overlap, the one that begins first stays, then the longer.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from medialake.llm.common import carried, written

KINDS = ("email", "ip", "card", "phone")
SUPPORT, ROUNDS, CONFIDENCE = 3, 3, 0.6
#: Bits of the filter by which a task leaves out words that are in no pattern.
FILTER_BITS = 1 << 24

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*\Z")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Shapes like those of the seeds, wider.
_LIKE = {
    "email": re.compile(r"[^\s@<>()\[\]]{1,64}(?:@|\(at\)|\[at\])[^\s@<>()\[\],;]{1,128}"),
    "ip": re.compile(r"(?<![0-9a-fA-F.:])(?:[0-9]{1,5}(?:\.[0-9]{1,5}){3}|(?:[0-9a-fA-F]{1,4}:){3,7}[0-9a-fA-F]{1,4})(?![0-9a-fA-F.:])"),
    "card": re.compile(r"(?<![0-9])[0-9](?:[\x20./_-]?[0-9]){11,18}(?![0-9])"),
    "phone": re.compile(r"(?<![0-9A-Za-z])\(?[0-9]{2,5}[)./\x20-]{1,2}[0-9]{2,5}(?:[./\x20-][0-9]{2,6}){1,4}(?![0-9A-Za-z])"),
}
_DIGIT, _NOT_WHITE = re.compile("[0-9]"), re.compile(r"\S+")
#: Characters at its end that a very long word is known by.
LONG_WORD = 256


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def base_spans(text: str | None) -> list[tuple[int, int, str]]:
    """The seeds: (start, end, kind) by start, then kind."""
    if not text:
        return []
    out: list[tuple[int, int, str]] = []
    at, end = text.find("@"), 0
    while at >= 0:
        # What may stand before @ begins as far left as it goes, but not inside the last address.
        begin = at
        while begin > end:
            piece = text[max(end, begin - 256) : begin]
            start = begin - len(piece) + _LOCAL.search(piece).start()
            if start == begin - len(piece) and start > end:
                begin = start
                continue
            begin = start
            break
        if begin < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            out.append((begin, end, "email"))
            at = text.find("@", end)
        else:
            at = text.find("@", at + 1)
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                out.append((m.start(), m.end(), "ip"))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12:
                digits = m[0].replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), m.end(), "card"))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                    out.append((m.start(), m.end(), "phone"))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def like_spans(text: str | None, seeds: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Spans shaped like seeds that aren't and don't overlap any."""
    if not text:
        return []
    found = []
    digits = _DIGIT.search(text)
    if "@" in text or "(at)" in text or "[at]" in text:
        found += [(m.start(), m.end(), "email") for m in _LIKE["email"].finditer(text)]
    if digits:
        found += [(m.start(), m.end(), k) for k in KINDS[1:] for m in _LIKE[k].finditer(text)]
    taken = sorted((s, e) for s, e, _ in seeds)
    out, i, last = [], 0, 0
    for s, e, k in sorted(found, key=lambda x: (x[0], -x[1], KINDS.index(x[2]))):
        while i < len(taken) and taken[i][1] <= s:
            i += 1
        # Seeds may overlap each other, so those that begin before e are looked at up to the first beyond it.
        if s < last or any(a < e and s < b for a, b in taken[max(0, i - 4) : i + 4]):
            continue
        out.append((s, e, k))
        last = e
    return out


def contexts(text: str, starts: list[int]) -> list[list[str]]:
    """The patterns at each place: the word before it, and the two words before it.

    A word goes up to the place itself; one of more than ``LONG_WORD``
    characters is known by its last ones, so that a text without white space
    isn't copied for every place in it.
    """
    if not starts:
        return []
    words = [(m.start(), m.end()) for m in _NOT_WHITE.finditer(text)]
    begins = [b for b, _ in words]
    out = []
    for at in starts:
        i = bisect_left(begins, at)  # words that begin before the place
        own = [_known_by(text[max(b, min(e, at) - LONG_WORD) : min(e, at)].lower()) for b, e in words[max(0, i - 2) : i]]
        two = ["^", "^", *own][-2:]
        out.append([own[-1] if own else "^", " ".join(two)])
    return out


def _known_by(word: str) -> str:
    return word[-LONG_WORD:]


def _mentions(documents: DataFrame, text: str) -> DataFrame:
    """(pattern, kind, value, seed, n): patterns before instances, counted in each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def flush() -> pa.RecordBatch:
            rows = list(counts)
            out = pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.string(), pa.bool_()))] + [pa.array(counts.values(), pa.int64())], names=["pattern", "kind", "value", "seed", "n"])
            counts.clear()
            return out

        for batch in batches:
            for value in batch.column(0).to_pylist():
                seeds = base_spans(value)
                for own, seed in ((seeds, True), (like_spans(value, seeds), False)):
                    for (s, e, k), patterns in zip(own, contexts(value, [x[0] for x in own])):
                        counts.update((p, k, value[s:e].lower(), seed) for p in patterns)
            if len(counts) > 200_000:
                yield flush()
        yield flush()

    found = documents.select(F.col(text)).mapInArrow(run, "pattern string, kind string, value string, seed boolean, n long")
    return found.groupBy("pattern", "kind", "value").agg(F.max("seed").alias("seed"), F.sum("n").alias("n"))


def _occurrences(documents: DataFrame, text: str, patterns: DataFrame) -> DataFrame:
    """(pattern, total): how often the words of each pattern occur in all texts.

    Tasks count the words and pairs that pass a filter of fixed size, which lets
    every pattern through and few others; the join leaves those out.
    """
    bit = (F.crc32(F.col("pattern").cast("binary")) % FILTER_BITS).cast("int").alias("bit")
    bits = np.zeros(FILTER_BITS // 8, np.uint8)
    at = patterns.select(bit).distinct().toArrow().column(0).to_numpy()
    np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
    shared = documents.sparkSession.sparkContext.broadcast(bits.tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value

        def passes(words: str) -> bool:
            b = zlib.crc32(words.encode()) % FILTER_BITS
            return bool(own[b >> 3] >> (b & 7) & 1)

        known: dict[str, bool] = {}
        counts: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["pattern", "total"])
            counts.clear()
            return out

        for batch in batches:
            for value in batch.column(0).to_pylist():
                words = ["^", "^", *map(_known_by, (value or "").lower().split())]
                here = Counter(words)
                if len(known) > 100_000:
                    known.clear()
                for w in here:
                    if w not in known:
                        known[w] = passes(w)
                ones = {w: n for w, n in here.items() if known[w]}
                counts.update(ones)
                # Whatever stands after a pair stands after its second word, so that is a pattern with as much support.
                counts.update(p for a, b in zip(words, words[1:]) if b in ones and passes(p := f"{a} {b}"))
                if len(counts) > 200_000:
                    yield flush()
        yield flush()

    counted = documents.select(F.col(text)).mapInArrow(run, "pattern string, total long").groupBy("pattern").agg(F.sum("total").alias("total"))
    return counted.join(patterns, "pattern", "left_semi")


def learn(documents: DataFrame, *, text: str = "text", support: int = SUPPORT, rounds: int = ROUNDS, confidence: float = CONFIDENCE) -> dict[tuple[str, str], float]:
    """Confident patterns: (words, kind) -> confidence."""
    mentions = written(_mentions(documents, text), "pii-mentions")
    supported = mentions.groupBy("pattern", "kind").agg(F.count("*").alias("values")).where(F.col("values") >= support).select("pattern", "kind")
    supported = written(supported, "pii-patterns")
    if supported.isEmpty():
        return {}
    totals = _occurrences(documents, text, supported.select("pattern").distinct())
    edges = mentions.join(supported, ["pattern", "kind"]).join(totals, "pattern")
    edges = written(edges, "pii-edges")
    instances = edges.groupBy("kind", "value").agg(F.max("seed").alias("seed")).select("kind", "value", F.col("seed").cast("double").alias("confidence"))
    scored = None
    for _ in range(rounds):
        scored = edges.join(instances, ["kind", "value"]).groupBy("pattern", "kind").agg(F.least(F.lit(1.0), F.sum(F.col("n") * F.col("confidence")) / (F.first("total") + 1)).alias("score"))
        scored = written(scored, "pii-scores")
        instances = edges.join(scored, ["pattern", "kind"]).groupBy("kind", "value").agg(F.greatest(F.max(F.col("seed").cast("double")), F.max("score")).alias("confidence"))
    return {(r["pattern"], r["kind"]): r["score"] for r in scored.where(F.col("score") >= confidence).collect()}


def find(documents: DataFrame, model: dict[tuple[str, str], float], *, text: str = "text", keep: list[str] | None = None, mask: bool = False) -> DataFrame:
    """``keep`` columns with ``spans`` (start, end, kind, seed; by start, then kind) and, with ``mask``, ``masked``: the text with ``<kind>`` for each run of spans."""
    kept = carried(keep, ("spans", "masked"))
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("kind", T.StringType()), T.StructField("seed", T.BooleanType())])
    schema = T.StructType([documents.schema[c] for c in kept] + [T.StructField("spans", T.ArrayType(span))] + [T.StructField("masked", T.StringType())] * mask)
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        to, known = to_arrow_schema(schema), shared.value
        for batch in batches:
            spans, masked = [], []
            for value in batch.column(len(kept)).to_pylist():
                seeds = base_spans(value)
                like = like_spans(value, seeds) if known else []
                more = [s for s, own in zip(like, contexts(value, [x[0] for x in like])) if any((p, s[2]) in known for p in own)]
                own = sorted([(*s, True) for s in seeds] + [(*s, False) for s in more], key=lambda s: (s[0], KINDS.index(s[2])))
                spans.append([{"start": s, "end": e, "kind": k, "seed": seed} for s, e, k, seed in own])
                if mask:
                    masked.append(mask_text(value, own))
            columns = [batch.column(i).cast(to.field(i).type) for i in range(len(kept))] + [pa.array(spans, to.field(len(kept)).type)]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(masked, pa.string())] * mask, schema=to)

    return documents.select(*[F.col(c) for c in kept], F.col(text).alias("_text")).mapInArrow(run, schema)


def mask_text(text: str | None, spans: list[tuple[int, int, str, bool]]) -> str | None:
    """Overlapping spans are masked together, by the name of the first."""
    if text is None:
        return None
    out, at, i = [], 0, 0
    while i < len(spans):
        start, end, kind = spans[i][:3]
        i += 1
        while i < len(spans) and spans[i][0] < end:
            end = max(end, spans[i][1])
            i += 1
        out += [text[at:start], f"<{kind}>"]
        at = end
    return "".join([*out, text[at:]])


def personal_data_report(documents: DataFrame) -> DataFrame:
    found = find(documents, learn(documents), keep=["doc_id"])
    base = F.filter("spans", lambda s: s["seed"])
    joined = lambda spans: F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
    kinds = F.transform(base, lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
