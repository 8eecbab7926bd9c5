import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from test_pii import brute as private
from test_quality import brute as counted
from test_simhash import jaccard_components
from tokenizers import Tokenizer

import corpus_pipeline
from tidemark.llm import pii, quality, simhash

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, docs, tmp_path_factory):
    """What each stage takes and gives, written and read again as the driver does."""
    out, now = [], docs.drop("a.b")
    for k, (name, f) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(k))
        f(spark, now, SMALL).write.parquet(path)
        made = spark.read.parquet(path)
        out.append((name, now, made))
        now = made
    return out


def test_columns(stages):
    assert [n for n, _, _ in stages] == ["quality rules", "SimHash near-dedup", "PII", "packing"]
    for _, given, made in stages[:-1]:
        assert made.columns == given.columns and made.count() > 0


def test_each_stage_acts(spark, stages):
    (_, a, b), (_, _, c), (_, _, d), (_, _, packed) = stages
    kept = [r["doc_id"] for r in quality.judge(a, ["doc_id"], quality.fit(a, spark.read.parquet(f"{SMALL}/labels.parquet"))).where("quality.kept").collect()]
    assert sorted(map(str, kept)) == sorted(str(r["doc_id"]) for r in b.collect())
    want = simhash.deduplicated(b, **corpus_pipeline.NEAR)
    assert sorted(str(r["text"]) for r in want.collect()) == sorted(str(r["text"]) for r in c.collect())
    assert sorted(pii.redacted(r["text"] or "") for r in c.collect()) == sorted(r["text"] or "" for r in d.collect())
    assert all(r["n_chars"] == len(r["text"]) for r in d.collect())
    assert {r["doc_id"] for r in packed.collect()} == {r["doc_id"] for r in d.collect()}


def test_run(spark):
    rows = corpus_pipeline.run(spark, SMALL).collect()
    assert rows and len({(r["sequence_id"], r["offset"]) for r in rows}) == len(rows)


def js(p, q):
    p, q = np.array(p, float), np.array(q, float)
    m = (p + q) / 2
    part = lambda x: sum(a * math.log2(a / b) for a, b in zip(x, m) if a > 0)
    return math.sqrt(max(0.0, part(p) + part(q)) / 2)


def classes_of(text):
    out = [0] * 7
    for c in text:
        out[0 if c in " \t\n\x0b\x0c\r" else 1 if c in "#*$%&|<>" else 2 if "a" <= c <= "z" else 3 if "A" <= c <= "Z" else 4 if "0" <= c <= "9" else 5 if c.isalpha() else 6] += 1
    return out


def kept_by_quality(rows, references):
    refs = {r.lang: r for r in references}
    limit = lambda n, bins, least: math.sqrt(least**2 + (bins + 7 * math.sqrt(2 * bins)) / (8 * math.log(2)) / max(1, n))
    for row in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", row["text"] or "")
        if counted(row["text"])[-1]:
            continue
        found, classes, n = Counter(words), classes_of(row["text"] or ""), len(words)
        known = [refs[row["lang"]]] if row["lang"] in refs else list(refs.values())
        chars = min((js(np.array(classes) / max(1, sum(classes)), r.classes) for r in known), default=0.0)
        if row["lang"] is not None and row["lang"] not in refs:
            known = []
        common = min((js([*[found[w] / n for w in r.words], 1 - sum(found[w] for w in r.words) / n], [*r.shares, 1 - sum(r.shares)]) for r in known), default=0.0)
        if (n < 50 or chars <= limit(n, 7, 0.2)) and (n < 100 or common <= limit(n, max(len(r.words) for r in references), 0.05)):
            yield row


def test_whole_run_against_brute_force(spark):
    """Every stage by a plain version: rules and distances in numpy, all pairs that share a shingle, the patterns, and the
    tokenizer; then the pieces are held together."""
    table = spark.read.parquet(f"{SMALL}/documents.parquet")
    references = quality.fit(table, spark.read.parquet(f"{SMALL}/labels.parquet"))
    rows = list(kept_by_quality(table.collect(), references))
    ids, linked = jaccard_components([(r["doc_id"], r["text"]) for r in rows], 0.8)
    least = list(range(len(ids)))

    def root(k):
        while least[k] != k:
            k = least[k]
        return k

    for a, b in linked:
        a, b = sorted((root(a), root(b)), key=lambda k: ids[k])
        least[b] = a
    texts = {r["doc_id"]: pii.redacted(r["text"]) for k, r in enumerate(rows) if root(k) == k}
    assert not any(private(t) for t in texts.values())
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tokenizer.encode_special_tokens = True
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in corpus_pipeline.run(spark, SMALL).collect():
        pieces[r["doc_id"]].append((r["start"], bytes(r["ids"])))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(pieces) == set(texts)
    for doc_id, text in texts.items():
        got = b"".join(ids for _, ids in sorted(pieces[doc_id]))
        assert zlib.crc32(got) == zlib.crc32(np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 2], "<u4").tobytes())
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
