"""Sum-of-squares online packing of tokenised documents into windows.

Every input partition is packed by itself, in the order its rows are read, so
nothing is shuffled and a lost task is redone alike. A document is tokenised
and gets an end id. What exceeds a whole window is cut off as full windows; the
rest goes to the *fill level* that minimises the sum of squared counts of
partially filled windows (a level array has the count of every level): a window
at that level is filled further, or a new one is opened. When the partition
ends, the windows that are still open are closed by moving pieces from the
emptiest into the gaps of the fullest, cut where they must be, so at most one
window of a partition is padded. Memory holds the open windows only.

Defined results: a null text is empty and so is its end id alone; a repeated row
is packed as often; an empty table gives an empty table; other columns are
ignored. Texts are whole, however long. Ties between levels go to the fuller.
"""

from __future__ import annotations

import array
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CAPACITY = 2048
END_ID = 1
#: Words and pieces whose ids a task remembers; when there are more, it starts anew.
MEMO = 200_000
FLUSH_BYTES = 2 << 20

#: Texts of these characters alone are split at white space and looked up word by word.
_PLAIN = re.compile(r"[\t\n\r -~À-ÖØ-öø-ÿ]*")
#: How the tokenizer splits what is between white space, for those characters.
_PIECE = re.compile(r"'(?:s|t|re|ve|m|ll|d)|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_letters() -> dict[int, str]:
    """The printable stand-ins of bytes in a byte-level vocabulary."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = (b for b in range(256) if b not in printable)
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


class _Memo(dict):
    def __init__(self, make):
        self.make = make

    def __missing__(self, key):
        if len(self) >= MEMO:
            self.clear()
        value = self[key] = self.make(key)
        return value


class WordTokenizer:
    """Ids of the ``tokenizers`` file, as little-endian 32-bit bytes.

    White space separates what the model sees, so the ids of a text are those of
    its words one after another, and those of a repeated word are looked up.
    Texts with other than plain Latin characters take the library's own way.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        model, letters = self.tokenizer.model, _byte_letters()

        def word(w: str) -> bytes:
            found = _PIECE.findall(w)
            if len(found) > 1:
                return b"".join(map(self.words.__getitem__, found))
            return array.array("I", [t.id for t in model.tokenize(w.encode().decode("latin-1").translate(letters))]).tobytes()

        # A piece is a word of one piece, so one memory serves both.
        self.words = _Memo(word)

    def __call__(self, text: str) -> bytes:
        if "<|" in text or not _PLAIN.fullmatch(text):
            return array.array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        return b"".join(map(self.words.__getitem__, text.lower().split()))


_tokenizers: dict[str, WordTokenizer] = {}


def tokenizer_of(path: str) -> WordTokenizer:
    """One tokenizer for each Python worker, which lives on after the task."""
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


class LevelArray:
    """Counts of partially filled windows by fill level, with the windows themselves."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.counts = np.zeros(capacity + 1, np.int64)
        self.windows: dict[int, list] = {}

    def best_level(self, size: int) -> int:
        """The level (0: a new window) where ``size`` more costs the least."""
        top = self.capacity - size
        n = self.counts
        costs = 2 * (n[size : top + size + 1] - n[: top + 1]) + 2
        costs[0] = 2 * n[size] + 1
        costs[top] = 1 - 2 * n[top] if top else costs[0]
        costs[1:][n[1 : top + 1] == 0] = np.iinfo(np.int64).max
        return top - int(np.argmin(costs[::-1]))

    def take(self, level: int):
        self.counts[level] -= 1
        return self.windows[level].pop()

    def put(self, level: int, window) -> None:
        self.counts[level] += 1
        self.windows.setdefault(level, []).append(window)

    def rest(self) -> list:
        return [w for level in sorted(self.windows, reverse=True) for w in self.windows[level]]


def close_windows(windows: list[list], capacity: int) -> list[list]:
    """Fills the fullest windows (first) with pieces of the emptiest (last); all but one are then full.

    A piece is (key, start, tokens, doc_tokens).
    """
    fills = [sum(len(p[2]) // 4 for p in w) for w in windows]
    i, j = 0, len(windows) - 1
    while i < j:
        gap = capacity - fills[i]
        if not gap:
            i += 1
            continue
        if not windows[j]:
            j -= 1
            continue
        key, start, tokens, total = windows[j].pop()
        n = min(gap, len(tokens) // 4)
        windows[i].append((key, start, tokens[: 4 * n], total))
        if n < len(tokens) // 4:
            windows[j].append((key, start + n, tokens[4 * n :], total))
        fills[i] += n
        fills[j] -= n
    return [w for w in windows if w]


def pack_rows(rows, tokenize, capacity: int = CAPACITY, end_id: int = END_ID) -> Iterator[list]:
    """Windows, each a list of pieces, from (key, text) rows: those filled first come first."""
    levels = LevelArray(capacity)
    end = array.array("I", [end_id]).tobytes()
    for key, text in rows:
        tokens = (tokenize(text) if text else b"") + end
        total = len(tokens) // 4
        whole = total - total % capacity
        for start in range(0, whole, capacity):
            yield [(key, start, tokens[4 * start : 4 * (start + capacity)], total)]
        size = total - whole
        if not size:
            continue
        piece = (key, whole, tokens[4 * whole :], total)
        level = levels.best_level(size)
        window = levels.take(level) if level else []
        window.append(piece)
        if level + size == capacity:
            yield window
        else:
            levels.put(level + size, window)
    yield from close_windows(levels.rest(), capacity)


def pack(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """A row for each piece: ``doc_id, start, length, tokens, doc_tokens, sequence_id, offset``.

    ``tokens`` has the ids as little-endian unsigned 32-bit numbers; pieces of a
    sequence lie one after another from offset 0.
    """
    long = T.LongType()
    schema = T.StructType([T.StructField("doc_id", documents.schema[doc_id].dataType), T.StructField("start", long), T.StructField("length", long), T.StructField("tokens", T.BinaryType()), T.StructField("doc_tokens", long), T.StructField("sequence_id", long), T.StructField("offset", long)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        to = to_arrow_schema(schema)
        first = TaskContext.get().partitionId() << 40

        def rows():
            for batch in batches:
                yield from zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())

        out, held = [], 0
        tokenize = tokenizer_of(tokenizer or default_tokenizer())
        try:
            for i, window in enumerate(pack_rows(rows(), tokenize, capacity, end_id)):
                offset = 0
                for key, start, tokens, total in window:
                    out.append((key, start, len(tokens) // 4, tokens, total, first + i, offset))
                    offset += len(tokens) // 4
                    held += len(tokens) + 64
                if held >= FLUSH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), to)], schema=to)
                    out, held = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), to)], schema=to)
        finally:
            tokenize.words.clear()  # the worker goes on to other tasks, which may need the memory

    return documents.select(F.col(doc_id), F.col(text)).mapInArrow(run, schema)


def packing_report(documents: DataFrame) -> DataFrame:
    """The contract's columns, from the operator's pieces."""
    return pack(documents).select("doc_id", "start", "length", F.crc32("tokens").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
