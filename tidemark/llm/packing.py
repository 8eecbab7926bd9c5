"""Sequence packing: shortest-pack-first over the length histogram.

Tokenised documents are cut into pieces of at most ``max_len`` ids. Only the histogram of piece lengths (at
most ``max_len`` counts) reaches the driver. There the lengths are placed longest first, each into the
shortest pack that still has room, whole counts at a time: a *pattern* is a multiset of lengths with the
number of packs that have it. A length leaves at most three patterns more than there were before it, so the patterns are bounded by a small multiple of ``max_len`` whatever the corpus. Patterns are then joined back to
the pieces by rank: the r-th piece of a length takes the r-th slot of that length.

Defined results: a null or empty text is the closing id alone; repeated rows are packed each; other columns
of the pieces pass through ``pack``; equal lengths are ranked by the place of their row in the saved
pieces. An empty table gives an empty result.
"""

from __future__ import annotations

import functools
import os
import unicodedata
from bisect import insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import arrow_map, free_name, mapped, named, saved
from tidemark.llm.words import WordTable, grouped

#: Words that a Python worker remembers with their ids.
REMEMBERED = 400_000
#: Words encoded by one call.
_JOINED = 4096


class WordIds:
    """Token ids of texts, word by word.

    White space never lies inside a token of this vocabulary and normalisation doesn't cross it, so the ids of a
    text are the ids of its words in order. New words that are plain lower-case letters (and may end in one
    mark) are encoded many at a time, joined by spaces, as each is one unit whose last token alone ends a word."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.ends[i] = token.endswith("</w>")
        self.table = WordTable(self._learn, REMEMBERED)
        self.marks = {m: self._one(m) for m in ".,;:!?"}

    def _one(self, word: str) -> bytes:
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    @staticmethod
    def _plain(word: str) -> bool:
        return word.isalpha() and word == word.lower() and unicodedata.is_normalized("NFC", word)

    @staticmethod
    def _lower(word: str) -> str:
        """Lower case where it is one letter for another, whatever stands beside it."""
        low = word.lower()
        return low if len(low) == len(word) and "\u03a3" not in word and unicodedata.is_normalized("NFC", word) else word

    @staticmethod
    def _splits(stem: str) -> bool:
        """Whether a mark after this stem is a unit of its own: after a letter or digit, not after other marks."""
        return stem.isascii() and stem[-1:].isalnum() or WordIds._plain(stem)

    def _together(self, words: list[str]) -> list[bytes]:
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) != len(words):  # a letter that the two Unicode tables see differently
            return [self._one(w) for w in words]
        data, cuts = ids.tobytes(), (4 * np.concatenate(([0], ends))).tolist()
        return [data[a:b] for a, b in zip(cuts, cuts[1:])]

    def _learn(self, words: list[str]) -> list[bytes]:
        stems = [self._lower(w[:-1] if w[-1:] in self.marks else w) for w in words]
        known: dict[str, bytes] = {"": b""} | {s: v for s, v in zip(stems, self.table.find(stems)) if v is not None and self._splits(s)}
        plain = list({s for s in stems if s not in known and self._plain(s)})
        for k in range(0, len(plain), _JOINED):
            part = plain[k : k + _JOINED]
            known |= zip(part, self._together(part))
        return [(known[s] + self.marks.get(w[-1:], b"")) if s in known and (s or not w) else self._one(w) for s, w in zip(stems, words)]

    def encode(self, texts: pa.StringArray) -> Iterator[memoryview]:
        # A-Z may go first, as the vocabulary has lower case only, unless a mark could join them
        marked = pc.match_substring_regex(texts, "[\u0300-\u036f]")
        return self.table.encode(pc.ascii_split_whitespace(pc.if_else(marked, texts, pc.ascii_lower(texts))))


@functools.cache
def _word_ids(path: str) -> WordIds:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return WordIds(path)


class _Numbers:
    """A task's own number, and the ranks of its rows among its rows of the same length."""

    names = ("_part", "_local")

    def __init__(self, max_len: int):
        self.part, self.seen = TaskContext.get().partitionId(), np.zeros(max_len + 1, np.int64)

    def of(self, lengths: np.ndarray) -> list[pa.Array]:
        order = np.argsort(lengths, kind="stable")
        ordered = lengths[order]
        new = np.flatnonzero(np.diff(ordered, prepend=-1))
        ranks = np.empty(len(lengths), np.int64)
        ranks[order] = np.arange(len(lengths)) - np.repeat(new, np.diff(new, append=len(lengths)))
        ranks += self.seen[lengths]
        self.seen += np.bincount(lengths, minlength=len(self.seen))
        return [pa.array(np.full(len(lengths), self.part, np.int64)), pa.array(ranks)]


def pieces(docs: DataFrame, tokenizer_path: str, max_len: int = 4096, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, start, length, doc_tokens, ids)``: each document's ids and the closing id, cut every ``max_len``;
    ``ids`` are little-endian unsigned 32-bit numbers. The two columns more that ``pack`` would add, a row's
    partition and rank there, are taken down in the same pass."""
    kind = dict(docs.dtypes)[id_col]
    end, width = np.array([end_id], "<u4").tobytes(), 4 * max_len

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = _Numbers(max_len)
        for batch in grouped(batches, 1):
            row, start, total, ids = [], [], [], []
            for k, data in enumerate(_word_ids(tokenizer_path).encode(batch.column(1))):
                encoded = bytes(data) + end
                cuts = range(0, len(encoded), width)
                row += [k] * len(cuts)
                start += [c // 4 for c in cuts]
                total += [len(encoded) // 4] * len(cuts)
                ids += [encoded[c : c + width] for c in cuts]
            columns = [batch.column(0).take(pa.array(row, pa.int64())), pa.array(start, pa.int64()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(total, pa.int64()), pa.array(ids, pa.binary())]
            more = numbers.of(columns[2].to_numpy())
            yield pa.RecordBatch.from_arrays([*columns, *more], ["doc_id", "start", "length", "doc_tokens", "ids", *numbers.names])

    doc_id, text = named([id_col, text_col])
    return mapped(docs.select(doc_id.alias("doc_id"), F.coalesce(text, F.lit("")).alias("text")), run, f"doc_id {kind}, start long, length long, doc_tokens long, ids binary, _part long, _local long")


Pattern = tuple[tuple[int, int], ...]


def patterns(histogram: dict[int, int], max_len: int) -> list[tuple[Pattern, int]]:
    """``(pattern, packs)`` with a pattern as ``(length, copies)``, longest first."""
    room: list[int] = []  # free space of the packs that have any, ascending
    open_packs: dict[int, list[tuple[Pattern, int]]] = {}
    full: list[tuple[Pattern, int]] = []

    def put(pattern: Pattern, packs: int, free: int) -> None:
        if not free:
            full.append((pattern, packs))
            return
        if free not in open_packs:
            insort(room, free)
        open_packs.setdefault(free, []).append((pattern, packs))

    def added(pattern: Pattern, length: int, copies: int) -> Pattern:
        if pattern and pattern[-1][0] == length:
            return (*pattern[:-1], (length, pattern[-1][1] + copies))
        return (*pattern, (length, copies))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            if not room or room[-1] < length:  # no pack has room: new ones, each filled as far as it goes
                fit = min(max_len // length, left)
                packs = left // fit
                put(((length, fit),), packs, max_len - fit * length)
                left -= packs * fit
                continue
            free = room[-1]
            pattern, packs = open_packs[free].pop()
            if not open_packs[free]:
                del open_packs[free]
                room.pop()
            used = min(packs, left)
            left -= used
            if packs > used:
                put(pattern, packs - used, free)
            put(added(pattern, length, 1), used, free - length)
    return full + [p for free in room for p in open_packs[free]]


class Slots:
    """For each length, the slots of the patterns that have it, in order of rank."""

    def __init__(self, found: list[tuple[Pattern, int]]):
        by_length: dict[int, list[tuple[int, int, int, int]]] = {}
        first = 0
        for pattern, packs in found:
            offset = 0
            for length, copies in pattern:
                by_length.setdefault(length, []).append((packs * copies, copies, first, offset))
                offset += length * copies
            first += packs
        self.sequences = first
        self.by_length = {}
        for length, rows in by_length.items():
            slots, copies, seq, offset = np.array(rows, np.int64).T
            self.by_length[length] = (np.cumsum(slots) - slots, copies, seq, offset)

    def place(self, length: int, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of the pieces of this length with these ranks."""
        low, copies, seq, offset = self.by_length[length]
        at = np.searchsorted(low, rank, "right") - 1
        inside = rank - low[at]
        return seq[at] + inside // copies[at], offset[at] + inside % copies[at] * length


def pack(cut: DataFrame, max_len: int = 4096, length_col: str = "length") -> DataFrame:
    """``cut`` with ``sequence_id`` and ``offset`` for each row, by its length (1 to ``max_len``). Columns of ``cut`` with these names
    give way to them. What ``pieces`` has taken down is used if ``cut`` has both of its columns, as numbers.

    The rows are saved once with their partition and their rank among that partition's rows of the same
    length; ranks over all rows follow from the counts by partition and length. So no group of equal
    lengths, however large, is sorted or gathered anywhere."""
    spark = cut.sparkSession
    part, local = _Numbers.names
    cut = cut.drop(*[c for c in cut.columns if c.lower() in ("sequence_id", "offset")])
    if {(part, "bigint"), (local, "bigint")} - set(cut.dtypes):
        part, local = free_name(cut, "_task"), free_name(cut, "_rank")
        at = cut.columns.index(length_col)

        def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            numbers = _Numbers(max_len)
            for batch in batches:
                more = numbers.of(batch.column(at).to_numpy(zero_copy_only=False).astype(np.int64))
                yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, part, local])

        longs = [T.StructField(c, T.LongType()) for c in (part, local)]
        cut = mapped(cut, number, T.StructType([*cut.schema.fields, *longs]))
    numbered = saved(cut, "pieces")
    own = [c for c in cut.columns if c not in (part, local)]
    at, base = own.index(length_col), free_name(cut, "_base")
    counts = numbered.groupBy(part, length_col).agg(F.count("*").alias("n"))
    histogram = dict(numbered.groupBy(length_col).count().collect())  # at most max_len rows
    slots = spark.sparkContext.broadcast(Slots(patterns(histogram, max_len)))  # bounded by max_len
    before = Window.partitionBy(length_col).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(part, length_col, F.coalesce(F.sum("n").over(before), F.lit(0)).alias(base))
    ranked = numbered.join(bases, [part, length_col]).select(*named(own), (F.col(base) + F.col(local)).alias(local))

    def place(batch: pa.RecordBatch) -> pa.RecordBatch:
        lengths, ranks = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (at, batch.num_columns - 1))
        seq, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
        for length in np.unique(lengths).tolist():
            rows = lengths == length
            seq[rows], offset[rows] = slots.value.place(length, ranks[rows])
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(seq), pa.array(offset)], [*batch.schema.names[:-1], "sequence_id", "offset"])

    longs = [T.StructField(c, T.LongType()) for c in ("sequence_id", "offset")]
    # written down here, where batches are small: a sequence's ids are 16 kB, and a caller's batches may have any size
    return saved(arrow_map(ranked, place, T.StructType([*[cut.schema[c] for c in own], *longs])), "packed", instead_of=[numbered])
