import random
import time
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece

from tidemark.llm import spm

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def texts(library):
    rng = random.Random(5)
    letters = "abcdeeettaaoiin  \n.,ÉéüñA漢字🙂0123'-_▁\t"
    out = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    out += ["".join(library.id_to_piece(rng.randrange(300, 32_000)) for _ in range(rng.randint(1, 6))).replace("▁", " ") for _ in range(3000)]
    return out + ["a" * 300, "ab" * 200, " " * 40, "   x", "xxxxxxxxyyyyyyy", "the the  the", "============----", "<s> <0x41> <unk>", "", "\x00", "\U0010ffff"]


def test_like_the_library(library, texts):
    model = spm.Model(PATH)
    for t, data in zip(texts, model.encode(pa.array(texts))):
        ids = np.frombuffer(data, "<u4").tolist()
        assert ids == library.encode(t), t
        assert model.decode(data) == library.decode(ids)
        assert "▁" in t or model.decode(data) == t


def slow_unigram(model, word):
    """The best path by all cuts, shorter last pieces first among equals."""
    best = [(0.0, [])]
    for end in range(1, len(word) + 1):
        ways = []
        for size in range(1, min(end, model.longest) + 1):
            piece = word[end - size : end]
            i = model.ids.get(piece)
            if i is None and size == 1:
                ways.append((best[end - 1][0] + model.unknown_score, [*best[end - 1][1], -1]))
            elif i is not None:
                ways.append((best[end - size][0] + model.score[i], [*best[end - size][1], i]))
        best.append(max(ways, key=lambda w: w[0]))
    return best[-1][1]


def test_unigram_against_all_paths(texts):
    model = spm.Model(PATH, "unigram")
    words = sorted({w for t in texts[:600] for w in t.split() if w and "▁" not in w}, key=len)
    for size in {len(w) for w in words}:
        same = [w for w in words if len(w) == size]
        assert [p.tolist() for p in model.viterbi(same)] == [slow_unigram(model, w) for w in same]


def test_bpe_borders_against_merges():
    """A border stands if, and only if, the merges of the two pieces' text leave just the two."""
    model = spm.Model(PATH)
    rng = random.Random(1)
    usable = np.sort(model.usable.ids)[:6000].tolist()
    pairs = [(rng.choice(usable), rng.choice(usable)) for _ in range(3000)]
    pairs = [(a, b) for a, b in pairs if not model.text[b].startswith("▁")]
    got = model.stands(*map(np.array, zip(*pairs)))
    assert got.tolist() == [model.merge(model.text[a] + model.text[b])[0] == [model.text[a], model.text[b]] for a, b in pairs]


def test_frames(docs, plain_rows, library):
    both = spm.encode_and_decode(docs, PATH).collect()
    assert Counter((r["doc_id"], r["text"], tuple(np.frombuffer(r["ids"], "<u4"))) for r in both) == Counter((i, t or "", tuple(library.encode(t or ""))) for i, t in plain_rows)
    assert all(r["decoded"] == r["text"] for r in both if "▁" not in r["text"])
    again = spm.decode(spm.encode(docs, PATH).selectExpr("*", "'x' as `a.b`"), PATH, out_col="back")
    assert Counter(r["back"] for r in again.collect()) == Counter(r["decoded"] for r in both)
    assert spm.encode(docs.limit(0), PATH).collect() == []


@pytest.mark.parametrize("text", [
    " " * 10**6, "  " + "a" * 10**6, "x  " + "abc" * 300_000 + "  y", "   " + "".join(random.Random(9).choices("abcdeeettaaoiin-=.", k=10**6)), " " * 999 + "é漢" * 1000 + " " * 77,
])
def test_long_runs_and_words(library, text):
    """In a time that grows with the length, and with the library's ids."""
    model, start = spm.Model(PATH), time.time()
    (data,) = model.encode(pa.array([text]))
    assert time.time() - start < 20 and np.frombuffer(data, "<u4").tolist() == library.encode(text)
    assert model.decode(data) == text


def test_runs_by_merges(library):
    """The pieces of a run, by its length and by the merges themselves."""
    model = spm.Model(PATH)
    assert model.simple_runs
    for n in range(1, 120):
        assert np.frombuffer(model._run(n), "<u4").tolist() == [model.ids[p] for p in model.merge("▁" * n)[0]]
