"""Language of words and texts by a linear-chain conditional random field.

The chain runs over the words (runs of letters, lower-cased) of a text; a word's
label is its language. Features of a word are its letter n-grams of one to four
letters with word edges (those at an edge are its affixes), the word itself, and
what a lexicon says of it; all but the lexicon are hashed to ``TABLE`` rows. The
weights and the transitions between labels are learned together by maximising
the likelihood of training chains, which switch between languages: spans of
training documents of different languages follow each other, so the transitions
learn how sticky a language is without forbidding a switch.

A text's words are labelled by the marginals of the forward-backward recursion
over the whole text. Long texts are cut into blocks whose transfer matrices are
multiplied first, so the recursion is exact and runs as array operations over
all blocks of a batch. The language of a text is that with the largest expected
number of letters; its share is the score.

The model is fitted on at most ``DOCUMENTS`` documents of each language (those
of the smallest hashes of their ids; half of them make the lexicon, half the
chains), so it's bounded by parameters and is sent to every worker. Texts are
judged where they're read.

Defined results: a text that is null or has no letter is ``und`` with score 0; so
is every text if there is nothing to learn from; a repeated row is returned as
often; other columns are dropped unless named in ``keep``. Ties go to the
alphabetically first language.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from medialake.llm.common import carried, held_out

DOCUMENTS = 200
TABLE = 1 << 16
LONGEST = 4
CHAIN, CHAINS, STEPS = 32, 64, 250
RATE, DECAY = 0.3, 1e-4
#: Words whose scores a worker remembers; when there are more, it starts anew.
MEMO = 1_000_000
#: Words of a block, and of the blocks that are worked on at once.
BLOCK, AT_ONCE = 64, 200_000
FLOOR = -25.0

_WORD, _WIDE = re.compile("[a-z]+"), regex.compile(r"\p{L}[\p{L}\p{M}]*+")


def words_of(text: str | None) -> list[str]:
    """The words of a text, letters with their combining marks; none if it has no letter."""
    if not text:
        return []
    text = text.lower()
    return (_WORD if text.isascii() else _WIDE).findall(text)


def feature_rows(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of words: (table rows, word numbers), one after another."""
    rows, owners = [], []
    lengths = np.array([len(w) for w in words])
    bounds = [0, 8, 16, 32, 64, 128]
    bounds += [2 ** (b + 1) for b in range(7, int(lengths.max(initial=1)).bit_length())]
    for lo, hi in zip(bounds, bounds[1:]):
        own = np.flatnonzero((lengths > lo) & (lengths <= hi))
        if not len(own):
            continue
        longest = int(lengths[own].max())
        codes = np.zeros((len(own), longest + 2), np.uint64)
        codes[:, 1 : longest + 1] = np.array([words[i] for i in own], f"<U{longest}").view(np.uint32).reshape(len(own), longest)
        codes[:, 0] = 2
        codes[np.arange(len(own)), lengths[own] + 1] = 3
        size = lengths[own] + 2
        whole = np.full(len(own), 7, np.uint64)
        for i in range(longest + 2):
            whole = np.where(i < size, whole * np.uint64(0x100000001B3) + codes[:, i], whole)
        rows.append(_slot(whole * np.uint64(31) + np.uint64(5)))
        owners.append(own)
        gram = np.zeros_like(codes)
        for n in range(1, LONGEST + 1):
            wide = longest + 3 - n
            if wide <= 0:
                break
            gram = gram[:, :wide] * np.uint64(0x9E3779B97F4A7C15) + codes[:, n - 1 : n - 1 + wide] + np.uint64(1)
            there = np.arange(wide)[None, :] <= (size - n)[:, None]
            where = np.nonzero(there)
            rows.append(_slot(gram[where] * np.uint64(8) + np.uint64(n)))
            owners.append(own[where[0]])
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(rows), np.concatenate(owners)


def _slot(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((h ^ (h >> np.uint64(32))) % np.uint64(TABLE)).astype(np.int64)


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # TABLE x languages
    lexicon: dict[str, int]  # word -> the language it speaks for
    lexicon_weights: np.ndarray  # (languages + 1) x languages; the last row is for words that aren't in it
    transitions: np.ndarray
    start: np.ndarray

    def emissions(self, words: list[str]) -> np.ndarray:
        """Scores of each word and language, the best of a word 0."""
        k = len(self.languages)
        rows, owners = feature_rows(words)
        out = np.empty((len(words), k), np.float64)
        for j in range(k):
            out[:, j] = np.bincount(owners, self.weights[rows, j], minlength=len(words))
        out += self.lexicon_weights[[self.lexicon.get(w, k) for w in words]]
        return np.maximum(out - out.max(axis=1, keepdims=True), FLOOR)


def marginals(e: np.ndarray, lengths: list[int], transitions: np.ndarray, start: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """Label probabilities of all words of several chains.

    ``e`` has the words' factors (not logarithms) of one chain after another.
    """
    k = e.shape[1]
    lengths_ = np.asarray(lengths)
    n_blocks = -(-lengths_ // block)
    first = np.concatenate([[0], np.cumsum(n_blocks)])
    total = int(first[-1])
    word = np.arange(len(e))
    chain = np.repeat(np.arange(len(lengths_)), lengths_)
    place = word - np.repeat(np.concatenate([[0], np.cumsum(lengths_)])[:-1], lengths_)
    at = (first[chain] + place // block, place % block)
    factors = np.ones((total, block, k))
    factors[at] = e
    there = np.zeros((total, block, 1, 1), bool)
    there[at] = True
    full = there.reshape(total, block).all(axis=0)
    begins = np.zeros(total, bool)
    begins[first[:-1][n_blocks > 0]] = True
    # Transfer matrices of the blocks.
    m = np.broadcast_to(np.eye(k), (total, k, k)).copy()
    for t in range(block):
        step = (m.reshape(-1, k) @ transitions).reshape(total, k, k)
        if t == 0:
            step[begins] = m[begins].sum(axis=2, keepdims=True) * start
        step *= factors[:, t, None, :]
        step /= step.max(axis=(1, 2), keepdims=True)
        m = step if full[t] else np.where(there[:, t], step, m)
    # Along the blocks of each chain.
    before, after = np.full((total, k), 1.0 / k), np.ones((total, k))
    for j in range(1, int(n_blocks.max(initial=0))):
        own = first[:-1][n_blocks > j] + j
        v = np.einsum("bi,bij->bj", before[own - 1], m[own - 1])
        before[own] = v / v.sum(axis=1, keepdims=True)
    for j in range(int(n_blocks.max(initial=0)) - 2, -1, -1):
        own = first[:-1][n_blocks > j + 1] + j
        v = np.einsum("bij,bj->bi", m[own + 1], after[own + 1])
        after[own] = v / v.max(axis=1, keepdims=True)
    # Within the blocks.
    forward = np.empty((total, block, k))
    a = before
    for t in range(block):
        step = a @ transitions
        if t == 0:
            step[begins] = start
        step *= factors[:, t]
        step /= step.sum(axis=1, keepdims=True)
        a = step if full[t] else np.where(there[:, t, 0], step, a)
        forward[:, t] = a
    b = after
    for t in range(block - 1, -1, -1):
        forward[:, t] *= b
        if t:
            step = (factors[:, t] * b) @ transitions.T
            step /= step.max(axis=1, keepdims=True)
            b = step if full[t] else np.where(there[:, t, 0], step, b)
    out = forward[at]
    return out / out.sum(axis=1, keepdims=True)


def train(texts: list[tuple[str, str]], seed: int = 17) -> Model | None:
    """Fits the weights on (language, text) rows."""
    languages = sorted({lang for lang, _ in texts})
    k = len(languages)
    if not k:
        return None
    number = {lang: i for i, lang in enumerate(languages)}
    halves: list[list[list[list[str]]]] = [[[] for _ in languages] for _ in range(2)]
    seen = Counter()
    for lang, text in texts:
        if words := words_of(text):
            halves[seen[lang] % 2][number[lang]].append(words)
            seen[lang] += 1
    for i in range(k):  # a language of one document learns from it in both ways
        for a, b in ((0, 1), (1, 0)):
            halves[a][i] = halves[a][i] or halves[b][i]
    counts: dict[str, np.ndarray] = {}
    sums = np.ones(k)
    for i, docs in enumerate(halves[0]):
        for words in docs:
            sums[i] += len(words)
            for w in words:
                if w not in counts:
                    counts[w] = np.zeros(k)
                counts[w][i] += 1
    lexicon = {}
    for w, c in counts.items():
        share = c / sums
        if c.sum() >= 2 and share.max() >= 0.7 * share.sum():
            lexicon[w] = int(share.argmax())
    model = Model(languages, np.zeros((TABLE, k)), lexicon, np.zeros((k + 1, k)), np.zeros((k, k)), np.zeros(k))
    spoken = [i for i in range(k) if halves[1][i]]
    if not spoken:
        return None
    rng = np.random.default_rng(seed)
    vocabulary = {w: n for n, w in enumerate(sorted({w for docs in halves[1] for d in docs for w in d}))}
    rows, owners = feature_rows(list(vocabulary))
    order = np.argsort(owners, kind="stable")
    rows, begin = rows[order], np.searchsorted(owners[order], np.arange(len(vocabulary) + 1))
    lex = np.array([lexicon.get(w, k) for w in vocabulary])
    coded = [[np.array([vocabulary[w] for w in d]) for d in docs] for docs in halves[1]]
    squares = [np.full_like(p, 1e-6) for p in (model.weights, model.lexicon_weights, model.transitions, model.start)]
    for _ in range(STEPS):
        x, y = np.empty((CHAINS, CHAIN), np.int64), np.empty((CHAINS, CHAIN), np.int64)
        for c in range(CHAINS):
            t = 0
            while t < CHAIN:
                i = spoken[rng.integers(len(spoken))]
                d = coded[i][rng.integers(len(coded[i]))]
                n = min(CHAIN - t, int(rng.geometric(1 / 12)), len(d))
                s = int(rng.integers(len(d) - n + 1))
                x[c, t : t + n], y[c, t : t + n] = d[s : s + n], i
                t += n
        used, where = np.unique(x, return_inverse=True)
        n_rows = begin[used + 1] - begin[used]
        owner = np.repeat(np.arange(len(used)), n_rows)
        own = rows[np.repeat(begin[used] - np.concatenate([[0], np.cumsum(n_rows)[:-1]]), n_rows) + np.arange(n_rows.sum())]
        e = np.stack([np.bincount(owner, model.weights[own, j], minlength=len(used)) for j in range(k)], axis=1) + model.lexicon_weights[lex[used]]
        e = e[where.reshape(x.shape)]
        p, pair = _expect(e, model.transitions, model.start)
        node = np.zeros_like(p)
        np.put_along_axis(node, y[:, :, None], 1.0, axis=2)
        node -= p
        by_word = np.stack([np.bincount(where.ravel(), node[:, :, j].ravel(), minlength=len(used)) for j in range(k)], axis=1)
        g = np.stack([np.bincount(own, by_word[owner, j], minlength=TABLE) for j in range(k)], axis=1)
        g_lex = np.stack([np.bincount(lex[used], by_word[:, j], minlength=k + 1) for j in range(k)], axis=1)
        g_t = np.zeros((k, k))
        np.add.at(g_t, (y[:, :-1].ravel(), y[:, 1:].ravel()), 1.0)
        g_t -= pair
        for p_, g_, q in zip((model.weights, model.lexicon_weights, model.transitions, model.start), (g, g_lex, g_t, node[:, 0].sum(axis=0)), squares):
            g_ = g_ / CHAINS - DECAY * p_
            q += g_ * g_
            p_ += RATE * g_ / np.sqrt(q)
    return model


def _expect(e: np.ndarray, transitions: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of labels [chain, word, label] and the expected number of each transition."""
    f = np.exp(e - e.max(axis=2, keepdims=True))
    t = np.exp(transitions - transitions.max())
    alpha, beta = np.empty_like(f), np.ones_like(f)
    alpha[:, 0] = np.exp(start - start.max()) * f[:, 0]
    alpha[:, 0] /= alpha[:, 0].sum(axis=1, keepdims=True)
    for i in range(1, e.shape[1]):
        a = (alpha[:, i - 1] @ t) * f[:, i]
        alpha[:, i] = a / a.sum(axis=1, keepdims=True)
    for i in range(e.shape[1] - 2, -1, -1):
        b = (f[:, i + 1] * beta[:, i + 1]) @ t.T
        beta[:, i] = b / b.sum(axis=1, keepdims=True)
    p = alpha * beta
    p /= p.sum(axis=2, keepdims=True)
    joint = alpha[:, :-1, :, None] * t * (f[:, 1:] * beta[:, 1:])[:, :, None, :]
    joint /= joint.sum(axis=(2, 3), keepdims=True)
    return p, joint.sum(axis=(0, 1))


class Judge:
    """A model with what it remembers of words."""

    def __init__(self, model: Model):
        self.model, self.k = model, len(model.languages)
        self.transitions = np.exp(model.transitions - model.transitions.max())
        self.start = np.exp(model.start - model.start.max())
        self.known: dict[str, int] = {}
        self.scores = np.empty((1 << 16, self.k))

    def factors(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The words' factors and letters."""
        if len(self.known) > MEMO:
            self.known.clear()
        known = self.known
        new = [w for w in set(words) if w not in known]
        if new:
            at = len(known)
            while at + len(new) > len(self.scores):
                self.scores = np.concatenate([self.scores, np.empty_like(self.scores)])
            for i in range(0, len(new), 50_000):
                part = new[i : i + 50_000]
                self.scores[at + i : at + i + len(part)] = np.exp(self.model.emissions(part))
            known.update(zip(new, range(at, at + len(new))))
        return self.scores[np.fromiter(map(known.__getitem__, words), np.int64, len(words))], np.fromiter(map(len, words), np.float64, len(words))

    def judge(self, chains: list[list[str]]) -> list[np.ndarray]:
        """The expected letters of each language, for each chain of words."""
        full = [c for c in chains if c]
        if not full:
            return [np.zeros(self.k) for _ in chains]
        f, letters = self.factors([w for c in full for w in c])
        p = marginals(f, [len(c) for c in full], self.transitions, self.start) * letters[:, None]
        sums = iter(np.add.reduceat(p, np.concatenate([[0], np.cumsum([len(c) for c in full])[:-1]])))
        return [next(sums) if c else np.zeros(self.k) for c in chains]


def sample(documents: DataFrame, doc_id: str, text: str, lang: str, per_language: int) -> list[tuple[str, str]]:
    """At most ``per_language`` documents of each language, those of the smallest hashes of their ids.

    Ids alone are ranked, in one pass that keeps ``per_language`` a language in
    each task; then the chosen texts are fetched. Languages are labels of which
    there are few: the sample and the model hold each of them.
    """
    rows = documents.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & (F.col(text) != "")).select(F.col(lang).alias("l"), F.xxhash64(doc_id).alias("h"), F.col(doc_id).cast("string").alias("d"), F.col(text).alias("t"))
    rank = F.row_number().over(Window.partitionBy("l").orderBy("h", "d"))
    chosen = rows.select("l", "h", "d").withColumn("k", rank).where(F.col("k") <= per_language).select("l", "h", F.coalesce("d", F.lit("")).alias("e")).distinct()
    found = rows.withColumn("e", F.coalesce("d", F.lit(""))).join(F.broadcast(chosen), ["l", "h", "e"], "left_semi")
    rank = F.row_number().over(Window.partitionBy("l").orderBy("h", "d", "t"))
    return [(r["l"], r["t"]) for r in found.withColumn("k", rank).where(F.col("k") <= per_language).orderBy("l", "k").select("l", "t").collect()]


def fit(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = DOCUMENTS) -> Model | None:
    return train(sample(documents, doc_id, text, lang, per_language))


def label(documents: DataFrame, model: Model | None, *, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns with ``lang_pred``, ``score`` and ``letters`` (expected letters of each language)."""
    kept = carried(keep, ("lang_pred", "score", "letters"))
    schema = T.StructType([documents.schema[c] for c in kept] + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("letters", T.MapType(T.StringType(), T.DoubleType()))])
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        to, m = to_arrow_schema(schema), shared.value
        judge = Judge(m) if m else None
        for batch in batches:
            out: list[np.ndarray] = []
            part: list[list[str]] = []
            held = 0
            if judge:
                for value in batch.column(len(kept)).to_pylist():
                    part.append(words_of(value))
                    held += len(part[-1])
                    if held >= AT_ONCE:
                        out += judge.judge(part)
                        part, held = [], 0
                out += judge.judge(part)
            else:
                out = [np.zeros(0)] * batch.num_rows
            best = [(m.languages[int(s.argmax())], min(1.0, float(s.max() / s.sum())), [(lang, float(v)) for lang, v in zip(m.languages, s)]) if s.sum() > 0 else ("und", 0.0, []) for s in out]
            columns = [batch.column(i).cast(to.field(i).type) for i in range(len(kept))]
            yield pa.RecordBatch.from_arrays([*columns, *[pa.array([b[i] for b in best], to.field(len(kept) + i).type) for i in range(3)]], schema=to)

    return documents.select(*[F.col(c) for c in kept], F.col(text).alias("_text")).mapInArrow(run, schema)


def language_report(documents: DataFrame) -> DataFrame:
    model = fit(documents.where(~held_out("doc_id", 5, 0)))
    return label(documents, model, keep=["doc_id"]).select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "lang_pred", "score")
