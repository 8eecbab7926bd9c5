from __future__ import annotations

import random

import pytest

#: Columns that clash with names the operators use themselves.
EXTRA = ("fp", "code", "row", "keep", "spans", "q", "_keep", "_t", "ids", "length", "start", "judged", "quality", "component", "_part", "a.b", "host")


def prose(rng: random.Random, n: int) -> str:
    words = "the of and to in is that was river stone cloud walks under bright city seven oak lamp quiet paper".split()
    return " ".join(rng.choice(words) + rng.choice(["", "", "", ".", ","]) for _ in range(n))


@pytest.fixture(scope="session")
def docs(spark):
    """Null and repeated ids, null, empty, white and very long texts, copies, near copies, and clashing columns."""
    rng = random.Random(3)
    base = [prose(rng, rng.randint(30, 300)) for _ in range(40)]
    texts = [*base, None, "", " \t\n ", "one", "a\x1cb c", prose(rng, 60_000), base[0], base[0], base[1] + " tail", *[base[2].replace("river", "brook", k) for k in range(1, 4)]]
    texts += ["Ünïcödé ﬁ 漢字 🙂 \U0001d518 <|endoftext|> it's  don't ▁ x", "write to jo.doe+x@mail.example.org or +1 (988) 555-2485, 4387513035237269 from 55.63.178.142"]
    rows = [(k, t, rng.choice(["en", "fr", None, "xx"]), "src0", len(t or "")) for k, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, base[0], None, None, None), (None, "alone and without an id", "en", None, 5), (7, "another text of a repeated id", "en", "s", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for c in EXTRA:
        from pyspark.sql import functions as F

        df = df.withColumn(c, F.lit(f"own {c}"))
    return df.repartition(5)


@pytest.fixture(scope="session")
def plain_rows(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
