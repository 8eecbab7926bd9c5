import random
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tidemark.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return t


def test_words_encode_like_texts(tokenizer):
    rng = random.Random(2)
    letters = "abcABC's're 12 ,.!é́̇ẛΣσς  \x1c\x85\tİıﬁ漢字🙂<|endoftext|>\ņE"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(5000)] + ["<|endoftext|> x", "a" * 500, "", ",", " "]
    for t, ids in zip(texts, packing.WordIds(PATH).encode(pa.array(texts))):
        assert list(memoryview(bytes(ids)).cast("I")) == tokenizer.encode(t, add_special_tokens=False).ids, t


def test_known_words_before_a_mark(tokenizer):
    """A word that ends in a mark or symbol forms one unit with the mark after it, though it was learned alone."""
    own = packing.WordIds(PATH)
    words = ["foo)", "!!", "..", '"yes"', "(x)", "100%", "###", "c++", "\u0130", "\ufb1d", "x\u0301", "don't", "a1", "\u00e9t\u00e9"]
    for texts in (words, [w + m for w in words for m in ".,;:!?"], ["foo) !", "foo). !!"]):
        assert [list(memoryview(bytes(b)).cast("I")) for b in own.encode(pa.array(texts))] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_small_memory_of_words(tokenizer):
    own = packing.WordIds(PATH)
    own.table.limit = 3
    texts = ["one two three four", "five six one two", "one one one"]
    for _ in range(2):
        assert [list(memoryview(bytes(b)).cast("I")) for b in own.encode(pa.array(texts))] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("seed", range(20))
def test_patterns_place_each_piece_once(seed):
    import numpy as np

    rng = np.random.default_rng(seed)
    most = int(rng.integers(1, 50))
    histogram = {int(k): int(rng.integers(1, 300)) for k in rng.integers(1, most + 1, 10)}
    found = packing.patterns(histogram, most)
    placed = Counter()
    for pattern, packs in found:
        assert sum(length * n for length, n in pattern) <= most and packs > 0
        for length, n in pattern:
            placed[length] += n * packs
    assert placed == histogram
    slots, used = packing.Slots(found), defaultdict(list)
    for length, n in histogram.items():
        for s, o in zip(*map(list, slots.place(length, np.arange(n)))):
            used[s].append((o, length))
    assert sorted(used) == list(range(slots.sequences))
    for parts in used.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length


def test_one_hot_length_is_paired():
    assert packing.patterns({2048: 1001}, 4096) == [(((2048, 2),), 500), (((2048, 1),), 1)]
    assert sum(n for _, n in packing.patterns({1: 4096 * 3}, 4096)) == 3


@pytest.mark.parametrize("max_len", [4096, 64])
def test_packed(docs, plain_rows, tokenizer, max_len):
    rows = packing.pack(packing.pieces(docs, PATH, max_len), max_len).collect()
    want = Counter()
    for i, t in plain_rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [2]
        for s in range(0, len(ids), max_len):
            data = b"".join(x.to_bytes(4, "little") for x in ids[s : s + max_len])
            want[i, s, len(data) // 4, len(ids), zlib.crc32(data)] += 1
    assert Counter((r["doc_id"], r["start"], r["length"], r["doc_tokens"], zlib.crc32(r["ids"])) for r in rows) == want
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= max_len
    assert sorted(sequences) == list(range(len(sequences)))
    assert len(sequences) <= sum(r["length"] for r in rows) / max_len * 1.05 + 2


def test_pack_any_table(spark):
    from pyspark.sql import functions as F

    df = spark.range(5000).select("id", (F.col("id") % 7 + 1).alias("length"), F.lit(1).alias("_base"), F.lit("x").alias("a.b"))
    rows = packing.pack(df, 16).collect()
    assert {r["id"] for r in rows} == set(range(5000)) and all(r["_base"] == 1 for r in rows)
    assert Counter((r["sequence_id"], r["offset"]) for r in rows).most_common(1)[0][1] == 1


def test_empty(docs):
    assert packing.pack(packing.pieces(docs.limit(0), PATH)).collect() == []


def test_columns_of_its_own_names(spark):
    """Columns that are named like the operator's own are the caller's, but for those that it gives."""
    rows = [(k, 1 + k % 7, f"p{k}", 5, "x", "y") for k in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, length long, _part string, _local long, Offset string, sequence_id string")
    out = packing.pack(df, max_len=16)
    assert out.columns == ["doc_id", "length", "_part", "_local", "sequence_id", "offset"]
    got = out.collect()
    assert {(r["doc_id"], r["_part"], r["_local"]) for r in got} == {(k, f"p{k}", 5) for k in range(200)}
    held = defaultdict(list)
    for r in got:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in held.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 16
