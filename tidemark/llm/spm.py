"""SentencePiece encoding and decoding by a batched numpy Viterbi.

Words of equal length advance together. Rolling hashes of all their substrings are looked up among the sorted
hashes of the pieces; for each end, the candidates of every piece length stand side by side, a vectorised
maximum chooses one, and backpointers are followed for all words at once.

A unigram model scores a path by the sum of its pieces. For a BPE model, whose encoding is defined by merges,
a path is allowed if every two neighbouring pieces are what the merges make of their joined text. Exactly one
path is: merges inside a piece don't depend on what stands beyond a border that is never merged, so the
encoding of a text is the only way to cut it in which no border would be merged. Whether a border would be is
found by undoing the two pieces' own merges, the latest first, and asking at each step whether the two parts
at the border join earlier than the undone merge.

A text's spaces become the mark U+2581, one more is put in front, and a piece has the mark only in front, so a
text is encoded word by word. Characters that the model hasn't got become bytes. Where several marks stand before a
word, all but the last are a run, whose pieces follow from its length; the last is part of the word, unless the word's
path leaves it alone, and then it belongs to the run.

A very long word is cut into chunks that overlap, which are words of equal length. Two chunks' paths join where
both have the same piece before the same border: every border then stands, so the joined path is the one.

Defined results: a null or empty text has no ids; repeated rows each keep a row; the mark itself, standing in
a text, decodes to a space, as in the library; other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import functools
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import arrow_map, mapped, named
from tidemark.llm.words import WordTable, grouped

MARK = "▁"
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Characters of equally long words that advance at once.
_STEP_CHARS = 1 << 17
#: Words, and parts of words, that a Python worker remembers with their ids.
REMEMBERED = 300_000
_UNKNOWN = -1
#: Characters of a chunk of a long word, and those that the next chunk repeats; words of more than LONG are cut.
CHUNK, OVERLAP, LONG = 256, 64, 512


class _Keys:
    """Sorted hashes and what they stand for. A bit for the first 20 bits of each hash rules most others out before the
    search."""

    def __init__(self, hashes: np.ndarray, ids: np.ndarray):
        order = np.argsort(hashes, kind="stable")
        self.keys, self.ids = hashes[order], ids[order]
        if (self.keys[1:] == self.keys[:-1]).any():
            raise ValueError("two pieces have the same hash")
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(hashes >> np.uint64(44)).astype(np.int64)] = True

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """The piece with each hash, or -2."""
        out = np.full(wanted.shape, -2)
        at = np.nonzero(self.seen[(wanted >> np.uint64(44)).astype(np.int64)])
        some = wanted[at]
        near = np.minimum(np.searchsorted(self.keys, some), len(self.keys) - 1)
        out[at] = np.where(self.keys[near] == some, self.ids[near], -2)
        return out


class Model:
    """Pieces with ids and scores. ``kind`` is ``bpe`` or ``unigram``."""

    def __init__(self, path: str, kind: str = "bpe"):
        import sentencepiece

        lib = sentencepiece.SentencePieceProcessor(model_file=path)
        self.kind = kind
        size = lib.vocab_size()
        self.text = [lib.id_to_piece(i) for i in range(size)]
        special = [lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) or lib.is_unused(i) for i in range(size)]
        self.byte_ids = {int(self.text[i][3:5], 16): i for i in range(size) if lib.is_byte(i)}
        self.unknown_id = lib.unk_id()
        self.ids = {t: i for i, t in enumerate(self.text) if not special[i]}
        self.score = np.array([lib.get_score(i) for i in range(size)], np.float64)
        self.unknown_score = min(self.score[i] for i in self.ids.values()) - 10
        self.longest = max(map(len, self.ids))
        if any(MARK in t.lstrip(MARK) for t in self.ids):
            raise ValueError("a piece of this model crosses words")
        power = np.ones(self.longest + 1, np.uint64)
        with np.errstate(over="ignore"):
            for k in range(1, len(power)):
                power[k] = power[k - 1] * _BASE
        self.power = power
        self.length = np.array([len(t) for t in self.text], np.int64)
        self.hash = np.zeros(size, np.uint64)
        for t, i in self.ids.items():
            self.hash[i] = self._hash(t)
        usable = np.array(sorted(self.ids.values()))
        if kind == "bpe":
            usable = self._split_tables(usable)
        self.usable = _Keys(self.hash[usable], usable)
        every = np.array(sorted(self.ids.values()))
        self.every = _Keys(self.hash[every], every)
        self.inside = np.unique([ord(a) << 21 | ord(b) for t in self.ids for a, b in zip(t, t[1:])])
        self.decoded = [bytes([int(t[3:5], 16)]) if i in set(self.byte_ids.values()) else b"" if special[i] else t.replace(MARK, " ").encode() for i, t in enumerate(self.text)]
        self.decoded[self.unknown_id] = " ⁇ ".encode()
        self.table = WordTable(self._learn, REMEMBERED)
        self.parts = WordTable(self.encode_parts, REMEMBERED)

    def _hash(self, text: str) -> np.uint64:
        out = 0
        for c in text:
            out = (out * int(_BASE) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
        return np.uint64(out)

    def merge(self, text: str) -> tuple[list[str], tuple[str, str] | None]:
        """The merges' encoding of a text, the best pair first and of equal ones the left, and the last pair that was
        merged."""
        parts: list[str] = list(text)
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        queue: list[tuple[float, int, str, int]] = []

        def offer(k: int) -> None:
            if k >= 0 and after[k] < len(parts):
                whole = parts[k] + parts[after[k]]
                if whole in self.ids:
                    heapq.heappush(queue, (-self.score[self.ids[whole]], k, whole, after[k]))

        for k in range(len(parts)):
            offer(k)
        last = None
        while queue:
            _, k, whole, right = heapq.heappop(queue)
            if not parts[k] or after[k] != right or parts[k] + parts[right] != whole:
                continue  # one of the two has been merged since
            last = (parts[k], parts[right])
            parts[k], parts[right] = whole, ""
            after[k] = after[right]
            if after[k] < len(parts):
                before[after[k]] = k
            offer(before[k])
            offer(k)
        return [p for p in parts if p], last

    def _run(self, n: int) -> bytes:
        """The ids of ``n`` marks. Merges of runs are all equal, so the leftmost possible one always comes next: a stack of
        pieces takes one mark after the other, and its last two join whenever they can."""
        known = self.known_runs.get(n)
        if known is None:
            stack: list[int] = []
            for _ in range(n):
                stack.append(1)
                while len(stack) > 1 and stack[-2] + stack[-1] in self.run_ids:
                    stack[-2:] = [stack[-2] + stack[-1]]
            known = np.array([self.run_ids[k] for k in stack], "<u4").tobytes()
            if len(self.known_runs) < 4096 and n <= 4096:
                self.known_runs[n] = known
        return known

    def _split_tables(self, ids: np.ndarray) -> np.ndarray:
        """For each piece its last merge, and the pieces that merges ever make. Runs of marks are set apart: their
        scores don't fall with each merge, as those of all other pieces do."""
        self.left, self.right = np.full(len(self.text), -1), np.full(len(self.text), -1)
        made = []
        self.runs = {t for t in self.ids if len(t) > 1 and not t.strip(MARK)}
        self.rank = self.score.copy()
        for i in ids.tolist():
            text = self.text[i]
            if len(text) == 1:
                self.rank[i] = np.inf  # there from the start
                made.append(i)
            elif text not in self.runs:
                parts, last = self.merge(text)
                if parts == [text]:
                    self.left[i], self.right[i] = self.ids[last[0]], self.ids[last[1]]
                    made.append(i)
        made_array = np.array(made)
        long = made_array[self.length[made_array] > 1]
        for side in (self.left, self.right):
            if not (self.rank[side[long]] > self.rank[long]).all():
                raise ValueError("a piece is merged before its parts")
        # runs of marks are simple if their merges are equal and come after all others
        self.run_ids = {len(t): self.ids[t] for t in self.runs | {MARK} if t in self.ids}
        scores = {self.score[self.ids[t]] for t in self.runs}
        self.simple_runs = 1 in self.run_ids and len(scores) <= 1 and all(self.score[long].min() > s for s in scores)
        self.known_runs: dict[int, bytes] = {}
        return made_array

    def stands(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the border between pieces ``a`` and ``b`` would never be merged."""
        ok = np.ones(len(a), bool)
        open_ = np.arange(len(a))
        a, b = a.copy(), b.copy()
        limit = np.full(len(a), -np.inf)
        tie = np.zeros(len(a), bool)  # the undone merge stands to the right: at equal rank the border goes first
        while len(open_):
            length = self.length[b]
            with np.errstate(over="ignore"):
                joined = self.hash[a] * self.power[np.minimum(length, self.longest)] + self.hash[b]
            whole = np.where(self.length[a] + length <= self.longest, self.every.find(joined), -2)
            rank = np.where(whole >= 0, self.score[whole], -np.inf)
            merged = (whole >= 0) & ((rank > limit) | (tie & (rank == limit)))
            ok[open_[merged]] = False
            undo_a = self.rank[a] < self.rank[b]
            undo_b = ~undo_a & np.isfinite(self.rank[b])  # of equal ones the right was made later
            on = ~merged & (undo_a | undo_b)
            limit = np.where(undo_a, self.rank[a], self.rank[b])
            tie = undo_b
            a, b = np.where(undo_a, self.right[a], a), np.where(undo_b, self.left[b], b)
            open_, a, b, limit, tie = open_[on], a[on], b[on], limit[on], tie[on]
        return ok

    def viterbi(self, words: list[str]) -> list[np.ndarray]:
        """Ids of words of one length, _UNKNOWN for a character the model hasn't got."""
        n, size = len(words), len(words[0])
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(n, size).astype(np.uint64)
        prefix = np.zeros((n, size + 1), np.uint64)
        with np.errstate(over="ignore"):
            for k in range(size):
                prefix[:, k + 1] = prefix[:, k] * _BASE + codes[:, k] + np.uint64(1)
        back = np.zeros((n, size + 1), np.int64)
        last = np.full((n, size + 1), -2)
        best = np.full((n, size + 1), -np.inf)
        best[:, 0] = 0
        for end in range(1, size + 1):
            reach = min(end, self.longest)
            starts = np.arange(end - 1, end - reach - 1, -1)  # piece lengths 1, 2, ...
            with np.errstate(over="ignore"):
                wanted = prefix[:, end : end + 1] - prefix[:, starts] * self.power[1 : reach + 1]
            piece = self.usable.find(wanted)
            before = best[:, starts]
            unknown = (piece[:, 0] == -2) & (self.every.find(wanted[:, 0]) == -2)
            if self.kind == "bpe":
                score = np.where((piece >= 0) & (before == 0), 0.0, -np.inf)
                previous = last[:, starts]
                row, column = np.nonzero((score == 0) & (previous >= 0))
                stands = self.stands(previous[row, column], piece[row, column])
                score[row[~stands], column[~stands]] = -np.inf
                score[unknown, 0] = np.where(before[unknown, 0] == 0, 0.0, -np.inf)
            else:
                score = np.where(piece >= 0, before + self.score[piece], -np.inf)
                score[unknown, 0] = before[unknown, 0] + self.unknown_score
            piece[unknown, 0] = _UNKNOWN
            choice = score.argmax(axis=1)
            rows = np.arange(n)
            best[:, end] = score[rows, choice]
            back[:, end] = choice + 1
            last[:, end] = piece[rows, choice]
        if not np.isfinite(best[:, size]).all():
            raise ValueError("a word has no encoding")
        found, at, rows = [], np.full(n, size), np.arange(n)
        while at.any():
            found.append(np.where(at > 0, last[rows, at], -2))
            at = at - back[rows, at]
        paths = np.array(found[::-1]).T
        return [p[p != -2] for p in paths]

    def _bytes_of(self, path: np.ndarray, word: str) -> bytes:
        """Little-endian 32-bit ids, unknown characters as bytes where the model has them."""
        if (path != _UNKNOWN).all():
            return path.astype("<u4").tobytes()
        ids, at = [], 0
        for i in path.tolist():
            if i == _UNKNOWN:
                ids += [self.byte_ids[b] for b in word[at].encode("utf-8", "surrogatepass")] if self.byte_ids else [self.unknown_id]
                at += 1
            else:
                ids.append(i)
                at += len(self.text[i])
        return np.array(ids, "<u4").tobytes()

    def encode_parts(self, parts: list[str]) -> list[bytes]:
        """Ids of words, or parts of words, with one mark in front at most."""
        known: dict[str, bytes] = {"": b""}
        by_length: dict[int, list[str]] = {}
        for u in dict.fromkeys(parts):
            if self.kind == "bpe" and len(u) > LONG:
                known[u] = self._bytes_of(self._long(u), u)
            elif u:
                by_length.setdefault(len(u), []).append(u)
        for words, paths in self._paths(by_length):
            known |= {w: self._bytes_of(p, w) for w, p in zip(words, paths)}
        return [known[u] for u in parts]

    def _paths(self, by_length: dict[int, list[str]]) -> Iterator[tuple[list[str], list[np.ndarray]]]:
        for length, words in by_length.items():
            step = max(1, _STEP_CHARS // length)
            for k in range(0, len(words), step):
                yield words[k : k + step], self.viterbi(words[k : k + step])

    def _long(self, word: str) -> np.ndarray:
        """Ids of a long part of a word, by chunks. Its characters are all in the model."""
        known: dict[str, np.ndarray] = {}

        def learn(chunks: list[str]) -> None:
            fresh: dict[int, list[str]] = {}
            for c in dict.fromkeys(chunks):
                if c not in known:
                    fresh.setdefault(len(c), []).append(c)
            for words, paths in self._paths(fresh):
                known.update(zip(words, paths))

        def placed(start: int) -> tuple[np.ndarray, np.ndarray]:
            chunk = word[start : start + CHUNK]
            learn([chunk])
            return known[chunk], start + np.cumsum(self.length[known[chunk]])

        starts = list(range(0, max(1, len(word) - OVERLAP), CHUNK - OVERLAP))
        learn([word[s : s + CHUNK] for s in starts])
        out: list[np.ndarray] = []
        path, ends = placed(0)
        while ends[-1] < len(word):
            # the planned chunk that starts in this one's last part, or one that starts at a border of it
            start = starts[min(len(starts) - 1, -(-(int(ends[-1]) - OVERLAP) // (CHUNK - OVERLAP)))]
            joined = None
            if start < ends[-1]:
                more, more_ends = placed(start)
                _, mine, theirs = np.intersect1d(ends, more_ends, assume_unique=True, return_indices=True)
                same = np.flatnonzero(path[mine] == more[theirs])
                if len(same):
                    at = same[(len(same) - 1) // 2]
                    joined = mine[at] + 1, more[theirs[at] + 1 :], more_ends[theirs[at] + 1 :]
            for k in range(len(path) - 2, -1, -1) if joined is None else ():
                if ends[k] <= ends[-1] - self.longest:
                    more, more_ends = placed(int(ends[k]))
                    if self.stands(path[k : k + 1], more[:1])[0]:
                        joined = k + 1, more, more_ends
                        break
            if joined is None:
                return self.viterbi([word])[0]
            out.append(path[: joined[0]])
            path, ends = joined[1:]
        return np.concatenate([*out, path])

    def _cut(self, words: list[str]) -> list[list[str]]:
        """Each word cut where two characters meet that meet in no piece: nothing is ever joined there."""
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        meet = codes[:-1] << 21 | codes[1:]
        at = np.minimum(np.searchsorted(self.inside, meet), len(self.inside) - 1)
        borders = np.zeros(len(codes) + 1, bool)
        borders[1:-1] = self.inside[at] != meet
        ends = np.cumsum([len(w) for w in words])
        borders[ends] = borders[0] = True
        cuts = np.flatnonzero(borders)
        firsts = np.searchsorted(cuts, np.concatenate(([0], ends))).tolist()
        text, cuts = "".join(words), cuts.tolist()
        parts = [text[a:b] for a, b in zip(cuts, cuts[1:])]
        return [parts[a:b] for a, b in zip(firsts, firsts[1:])]

    def _learn(self, words: list[str]) -> list[bytes]:
        """Ids of words with a mark in front, and any marks more that they begin with."""
        bare = [w.lstrip(MARK) for w in words]
        cut = self._cut([MARK + w for w in bare])
        parts = list({p for c in cut for p in c})
        known = dict(zip(parts, self.parts.look_up(parts)))
        return [self._after_run(w, len(w) - len(b), b"".join([known[p] for p in c])) if len(w) > len(b) else b"".join([known[p] for p in c]) for w, b, c in zip(words, bare, cut)]

    def _after_run(self, word: str, marks: int, ids: bytes) -> bytes:
        """``ids``, those of the bare word with one mark, after a run of ``marks`` marks more."""
        if self.kind != "bpe":
            return self._bytes_of(self.viterbi([MARK + word])[0], MARK + word)
        if not self.simple_runs:
            return self._bytes_of(np.array([self.ids.get(p, _UNKNOWN) for p in self.merge(MARK + word)[0]]), MARK + word)
        alone = ids[:4] == np.array([self.run_ids[1]], "<u4").tobytes()
        return self._run(marks + 1) + ids[4:] if alone else self._run(marks) + ids

    def encode(self, texts: pa.StringArray) -> Iterator[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit numbers."""
        odd = pc.match_substring_regex(texts, f"^ |  |{MARK}")
        if pc.any(odd).as_py():
            # of several marks the first ends a word, and the others begin the next one
            marked = pc.replace_substring(texts.filter(odd), " ", MARK)
            texts = pc.replace_with_mask(texts, odd, pc.replace_substring_regex(marked, f"([^{MARK}]){MARK}", r"\1 "))
        empty = pc.equal(texts, "").to_numpy(zero_copy_only=False).tolist()
        for data, none in zip(self.table.encode(pc.split_pattern(texts, " ")), empty):
            yield b"" if none else bytes(data)

    def decode(self, data: bytes) -> str:
        text = b"".join(map(self.decoded.__getitem__, np.frombuffer(data, "<u4").tolist())).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


@functools.cache
def model(path: str, kind: str) -> Model:
    return Model(path, kind)


def encode(docs: DataFrame, model_path: str, kind: str = "bpe", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, ids)``: ``ids`` are little-endian unsigned 32-bit numbers."""
    return _mapped(docs, model_path, kind, id_col, text_col, False).drop("decoded", "text")


def encode_and_decode(docs: DataFrame, model_path: str, kind: str = "bpe", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, text, ids, decoded)``, a null text as an empty one."""
    return _mapped(docs, model_path, kind, id_col, text_col, True)


def _mapped(docs: DataFrame, model_path: str, kind: str, id_col: str, text_col: str, decoding: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model(model_path, kind)
        for batch in grouped(batches, 1):
            ids = list(own.encode(batch.column(1)))
            texts = [batch.column(1), pa.array([own.decode(d) for d in ids], pa.string())] if decoding else [pa.nulls(len(ids), pa.string())] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), texts[0], pa.array(ids, pa.binary()), texts[1]], ["doc_id", "text", "ids", "decoded"])

    doc_id, text = named([id_col, text_col])
    return mapped(docs.select(doc_id.alias("doc_id"), F.coalesce(text, F.lit("")).alias("text")), run, f"doc_id {dict(docs.dtypes)[id_col]}, text string, ids binary, decoded string")


def decode(encoded: DataFrame, model_path: str, kind: str = "bpe", ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``encoded`` with the text of its ids, null ids as none."""
    at = encoded.columns.index(ids_col)

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = pa.array([model(model_path, kind).decode(d or b"") for d in batch.column(at).to_pylist()], pa.string())
        return pa.RecordBatch.from_arrays([*batch.columns, texts], [*batch.schema.names, out_col])

    return arrow_map(encoded, make, T.StructType([*encoded.schema.fields, T.StructField(out_col, T.StringType())]))
