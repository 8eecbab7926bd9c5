import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidemark.llm import quality

REFERENCES = [quality.Reference("en", (0.17, 0.0, 0.79, 0.014, 0.001, 0.0, 0.025), ("the", "of", "a|b"), (0.06, 0.03, 0.01)), quality.Reference("fr", (0.17, 0.0, 0.7, 0.01, 0.001, 0.09, 0.029), ("de", "la"), (0.05, 0.04))]


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
    n = Counter(windows)
    covered = {p for k, w in enumerate(windows) if n[w] > 1 for p in range(k, k + 8)}
    counts = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))
    return (*counts, counts[0] < 20 or 100 * counts[4] > 30 * counts[0])


def test_counts(docs, plain_rows):
    rows = quality.judge(docs, ["doc_id"], REFERENCES).select("doc_id", "quality.*").collect()
    assert Counter((r["doc_id"], *(r[c] for c in quality.BASE)) for r in rows) == Counter((i, *brute(t)) for i, t in plain_rows)
    assert all(not (r["base_failed"] and r["kept"]) for r in rows)


def test_windows(spark):
    w = [f"w{k}" for k in range(40)]
    texts = ["", "a", " ".join(["x"] * 30), " ".join(w + w[:8]), " ".join(w + w[:7]), " ".join(w[:10] * 3 + w), "a b c d e f g h\n" * 4, "l\nl\n\n \nl\r\nm", "# $ % | < > & * ()", "á\x85b   c\x1cd"] + [" ".join(w[k : k + 9] + w[k : k + 9]) for k in range(3)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("lang", F.lit("en"))
    got = {r["doc_id"]: tuple(r[c] for c in quality.BASE) for r in quality.judge(df, ["doc_id"], REFERENCES).select("doc_id", "quality.*").collect()}
    assert got == {k: brute(t) for k, t in enumerate(texts)}


def invented(rng, lang, n):
    """Prose of an invented language: a third common words, the rest drawn from very many."""
    common = [f"{lang}{k}" for k in range(40)]
    weights = [1 / (k + 1) for k in range(40)]
    return " ".join(rng.choices(common, weights)[0] if rng.random() < 0.35 else lang + "".join(rng.choices("abcdefgh", k=rng.randint(5, 10))) for _ in range(n))


@pytest.fixture(scope="module")
def fitted(spark):
    import random

    rng = random.Random(1)
    rows = [(k, invented(rng, "q" if k % 3 else "z", rng.randint(60, 600)), "qq" if k % 3 else "zz") for k in range(300)]
    rows += [(k, invented(rng, "x", 100), "xx") for k in range(300, 310)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = docs.selectExpr("doc_id", "if(doc_id % 2 = 0, 1, 0) as quality")
    return quality.fit(docs, labels.union(labels))


def test_fit(fitted):
    """Languages with enough documents, each with its most frequent words."""
    assert [r.lang for r in fitted] == ["qq", "zz"] and all(len(r.words) == 50 for r in fitted)
    assert fitted[0].words[:2] == ("q0", "q1") and fitted[0].shares == tuple(sorted(fitted[0].shares, reverse=True))
    assert all(abs(sum(r.classes) - 1) < 1e-9 for r in fitted)


def test_fit_against_brute_force(spark):
    """The labelled good documents that pass the base rules, all of a small table."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    good = {r["doc_id"] for r in labels.collect() if r["quality"] == 1}
    texts = {}
    for r in docs.collect():
        if r["doc_id"] in good and not brute(r["text"])[-1]:
            texts.setdefault(r["lang"], []).append(r["text"])
    want = {lang: Counter(w for t in v for w in re.findall(r"[^\x20\x09-\x0D]+", t)) for lang, v in texts.items() if len(v) >= 5}
    got = quality.fit(docs, labels, min_docs=5, n_words=7)
    assert {r.lang for r in got} == set(want) and len(got) > 1
    for r in got:
        top = sorted(want[r.lang].items(), key=lambda x: (-x[1], x[0]))[:7]
        assert list(zip(r.words, r.shares)) == [(w, n / want[r.lang].total()) for w, n in top]
    assert quality.fit(docs, labels.limit(0)) == [] == quality.fit(docs.limit(0), labels)


def test_distance_rejects_junk_and_keeps_prose(spark, fitted):
    import random

    rng = random.Random(2)
    clean = [(invented(rng, lang[0], n), lang) for lang in ("qq", "zz") for n in (20, 60, 100, 101, 130, 200, 1000, 5000) for _ in range(20)]
    fifth = [(invented(rng, "w", 400), "ww") for _ in range(20)]
    junk = [("### $$$ %%% &&& " * 3 + " ".join(f"x{k}" for k in range(100)) + " ### && | <> " * 40, "qq"), (" ".join(f"Q{k}Q{k * 7}" for k in range(200)), "zz"), (" ".join(f"qword{k}" for k in range(400)), "qq"), (invented(rng, "z", 400), "qq")]
    nowhere = [(invented(rng, "z", 400), None), (" ".join(f"qword{k}" for k in range(400)), None)]
    rows = [(k, *r) for k, r in enumerate(clean + fifth + junk + nowhere)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = quality.judge(df, ["doc_id"], fitted).select("doc_id", "quality.*").collect()
    kept = [r["kept"] for r in sorted(out, key=lambda r: r["doc_id"])]
    assert all(kept[: len(clean) + len(fifth)]) and not any(kept[len(clean) + len(fifth) : -2]) and kept[-2:] == [True, False]
    assert all(r["kept"] != r["base_failed"] for r in quality.judge(df, ["doc_id"], []).select("quality.*").collect())


def test_allowed(spark):
    """Texts drawn from a reference itself are hardly ever further off than is allowed."""
    import numpy as np

    rng = np.random.default_rng(3)
    q = np.append(0.08 / np.arange(1, 51), 0)
    q[-1] = 1 - q.sum()
    for n in (20, 100, 1000):
        p = rng.multinomial(n, q, 20_000) / n
        m = (p + q) / 2
        with np.errstate(divide="ignore", invalid="ignore"):
            js = np.sqrt((np.where(p > 0, p * np.log2(p / m), 0) + q * np.log2(q / m)).sum(1) / 2)
        limit = spark.range(1).select(quality.allowed(F.lit(n), 50, 0.05)).first()[0]
        assert (js > limit).mean() < 1e-3 and np.median(js) < 0.8 * limit


def test_js_distance(spark):
    import math

    df = spark.sql("select array(3L, 1L, 0L) as c, 4.0D as n")
    q = [0.25, 0.25, 0.5]
    got = df.select(quality.js_distance(F.col("c"), F.col("n"), q).alias("d")).first()["d"]
    p = [0.75, 0.25, 0.0]
    m = [(a + b) / 2 for a, b in zip(p, q)]
    kl = lambda x: sum(a * math.log2(a / b) for a, b in zip(x, m) if a)
    assert abs(got - math.sqrt((kl(p) + kl(q)) / 2)) < 1e-12


def test_edges(docs):
    out = quality.judge(docs, docs.columns, REFERENCES, out_col="verdict")
    assert out.columns == [*docs.columns, "verdict"] and out.count() == docs.count()
    assert quality.judge(docs.limit(0), ["doc_id"], REFERENCES).collect() == []
    assert quality.judge(docs, docs.columns, REFERENCES, out_col="Quality").columns == [*[c for c in docs.columns if c != "quality"], "Quality"]


def test_a_filter_copies_nothing(docs):
    """The counts are made once, and no Python has a part in it."""
    plan = quality.judge(docs, docs.columns, REFERENCES, out_col="verdict").where("verdict.kept").drop("verdict")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") < 8 and not any(x in plan for x in ("Python", "Arrow", "Pandas"))


def test_common_words_are_counted_whole(spark):
    """Words between, inside and beside others, and ones with marks in them."""
    df = spark.createDataFrame([(1, "the the a|b theof of the of xthe a b " * 3)], "doc_id long, text string")
    common = quality.counts(df, ["doc_id"], vocabulary=("the", "of", "a|b")).select("q.common").first()[0]
    assert Counter(common.split()) == {"the": 9, "of": 6, "a|b": 3}
