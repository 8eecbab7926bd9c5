"""Encoding texts word by word with a remembered table: words are split and told apart by Arrow's kernels, so
Python sees each different word of a group of texts once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text whose words are told apart at once.
GROUP_BYTES = 4 << 20


def grouped(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[pa.RecordBatch]:
    """Batches joined until their texts, in column ``at``, have GROUP_BYTES."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.column(at).nbytes
        if size >= GROUP_BYTES:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


class WordTable:
    """The bytes that stand for each word. ``learn`` gives them for new words; when more than ``limit`` words are known, the
    table starts anew. Words and bytes are Arrow arrays, a few dozen bytes a word: Spark may keep several Python
    workers, and each has its own table."""

    def __init__(self, learn: Callable[[list[str]], list[bytes]], limit: int):
        self.learn, self.limit = learn, limit
        self._clear()

    def _clear(self) -> None:
        self.words, self.values = pa.array([], pa.string()), pa.array([], pa.large_binary())

    def find(self, words: list[str]) -> list[bytes | None]:
        """What is known of the words."""
        return self.values.take(pc.index_in(pa.array(words, pa.string()), value_set=self.words)).to_pylist()

    def values_of(self, words: pa.StringArray) -> pa.LargeBinaryArray:
        """The bytes of different words."""
        at = pc.index_in(words, value_set=self.words)
        missing = pc.is_null(at)
        fresh = words.filter(missing)
        if not len(fresh):
            return self.values.take(at)
        values = pa.concat_arrays([self.values, pa.array(self.learn(fresh.to_numpy(zero_copy_only=False).tolist()), pa.large_binary())])
        place = at.fill_null(0).to_numpy().astype(np.int64)
        place[missing.to_numpy(zero_copy_only=False)] = len(self.values) + np.arange(len(fresh))
        out = values.take(pa.array(place))
        if len(values) > self.limit:
            self._clear()
        else:
            self.words, self.values = pa.concat_arrays([self.words, fresh]), values
        return out

    def look_up(self, words: list[str]) -> list[bytes]:
        return self.values_of(pa.array(words, pa.string())).to_pylist()

    def encode(self, lists: pa.ListArray) -> Iterator[memoryview]:
        """For each list of words, their bytes in order."""
        told = lists.flatten().dictionary_encode()
        joined = self.values_of(told.dictionary).take(told.indices)
        ends = np.concatenate(([0], np.cumsum(_counts(lists))))
        offsets = np.frombuffer(joined.buffers()[1], np.int64)[joined.offset : joined.offset + len(joined) + 1] if len(joined) else np.zeros(1, np.int64)
        data = memoryview(joined.buffers()[2] or b"") if len(joined) else memoryview(b"")
        for start, end in zip(offsets[ends[:-1]].tolist(), offsets[ends[1:]].tolist()):
            yield data[start:end]


def _counts(lists: pa.ListArray) -> np.ndarray:
    return lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
