"""Quality rules: Heuristic counts, and the divergence of a document from language references.

Only DataFrame functions are used. ``fit`` takes the references from documents that are labelled good: for each
language the shares of the character classes, and of its most frequent words. ``judge`` makes one pass over the texts and
saves nothing: it turns each document into counts of words, symbols, repeated lines and windows, a histogram of
character classes and one of the common words of its language, and rejects it when it fails a base rule, or
when it is long enough to judge and its Jensen-Shannon distance to its own language's reference exceeds what is
allowed, for character classes or for common words.

What is allowed depends on the length: the histogram of an ``n``-word sample of the reference itself is at a squared
distance of (k + z sqrt(2k)) / (8 n ln 2) on average for z = 0, and hardly ever at more for z = 7 (k bins; a sum of
squared normal errors). To that the square of a distance is added that a clean text's subject may make at any length.

Defined results: a null text has no words and fails the word minimum; repeated rows each keep a row; a document of no
language is judged by the nearest reference; one of a language without a reference is judged by character classes alone,
by the nearest reference; without any reference only the base rules hold. Other columns are kept if named in ``keep`` and never
read; one named like ``out_col`` gives way to it. An empty table gives an empty result.
"""

from __future__ import annotations

import dataclasses
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import named, saved

#: Character classes, in the order of the histogram.
CHAR_CLASSES = ("space", "symbol", "lower", "upper", "digit", "letter", "other")

_SYMBOLS = "#*$%&|<>"
_NOT_SPACE = r"[^\x20\x09-\x0D]"
WINDOW = 8

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")

def _n(c: Column | str) -> Column:
    return F.length(c).cast("long")


def _without(c: Column | str, pattern: str) -> Column:
    return F.regexp_replace(c, pattern, "")


@dataclasses.dataclass(frozen=True)
class Reference:
    """A language: the shares of the character classes, its most frequent words, and their shares."""

    lang: str
    classes: tuple[float, ...]
    words: tuple[str, ...]
    shares: tuple[float, ...]


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")


def counts(docs: DataFrame, keep: list[str], text_col: str = "text", vocabulary: tuple[str, ...] = ()) -> DataFrame:
    """``keep`` as one struct, and the struct ``q`` of all counts, for every row. ``common`` has the text's words that are in the
    vocabulary, each between spaces."""
    t = F.col("_t")
    step = docs.select(F.struct(*named(keep)).alias("keep"), F.coalesce(*named([text_col]), F.lit("")).alias("_t"))
    step = step.select("keep", "_t", _words(t).alias("_w"), F.filter(F.split(t, "\n"), lambda x: x.rlike(_NOT_SPACE)).alias("_lines"), _without(t, r"[\x20\x09-\x0D]+").alias("_solid"))
    step = step.select("*", F.size("_w").cast("long").alias("_n"), F.transform("_w", lambda w: F.xxhash64(w)).alias("_hashes"), F.translate("_solid", _SYMBOLS, "").alias("_c1"))
    # words are hashed once; a window is the hash of its words' hashes
    window = lambda i: F.xxhash64(*[F.get("_hashes", i + k) for k in range(WINDOW)])
    found = F.filter("_w", lambda w: w.isin(*vocabulary)) if vocabulary else F.array().cast("array<string>")
    step = step.select(
        *[c for c in step.columns if c not in ("_hashes", "_w")],
        F.when(F.size("_w") >= WINDOW, F.transform(F.sequence(F.lit(0), F.size("_w") - WINDOW), window)).otherwise(F.array().cast("array<bigint>")).alias("_h"),
        F.array_join(F.transform(found, lambda w: F.concat(F.lit(" "), w, F.lit(" "))), "").alias("_common"),
    )
    # windows found twice or more: hashes sorted with their places, kept where a neighbour is equal
    step = step.select(
        *[c for c in step.columns if c != "_h"],
        F.when(F.size(F.array_distinct("_h")) < F.size("_h"), F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("_sorted"),
        _without("_c1", "[a-z]+").alias("_c2"),
    )
    near = lambda x, k: F.coalesce(F.get("_sorted", k)["h"] == x["h"], F.lit(False))
    step = step.select(
        *[c for c in step.columns if c != "_sorted"],
        F.sort_array(F.transform(F.filter("_sorted", lambda x, k: near(x, k - 1) | near(x, k + 1)), lambda x: x["i"])).alias("_at"),
        _without("_c2", "[A-Z]+").alias("_c3"),
    )
    covered = F.aggregate(F.transform("_at", lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get("_at", k + 1) - p, F.lit(WINDOW)))), F.lit(0).cast("long"), lambda a, x: a + x)
    step = step.select(*[c for c in step.columns if c != "_at"], F.coalesce(covered, F.lit(0).cast("long")).alias("_repeat"), _without("_c3", "[0-9]+").alias("_c4"))
    step = step.select("*", _without("_c4", r"\p{L}+").alias("_c5"))
    chain = ["_t", "_solid", "_c1", "_c2", "_c3", "_c4", "_c5"]
    classes = [_n(a) - _n(b) for a, b in zip(chain, chain[1:])] + [_n("_c5")]
    q = F.struct(
        F.col("_n").alias("n_words"),
        _n("_solid").alias("word_chars"),
        (_n("_solid") - _n("_c1")).alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.col("_repeat").alias("n_repeat_words"),
        ((F.col("_n") < 20) | (100 * F.col("_repeat") > 30 * F.col("_n"))).alias("base_failed"),
        F.array(*classes).alias("classes"),
        F.col("_common").alias("common"),
    )
    # a condition that is always true, but not known to be: a filter above is not pushed below with copies of all this
    return step.select("keep", F.when(F.monotonically_increasing_id() >= 0, q).alias("q"))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", label_col: str = "quality", max_rows: int = 10_000, n_words: int = 50, min_docs: int = 20, max_languages: int = 16) -> list[Reference]:
    """The references of the languages that have ``min_docs`` or more of the documents labelled good that pass the base
    rules, the most frequent first. ``max_rows`` bounds the labelled ids that are looked at (those whose MD5 is least),
    and with them what is broadcast; ``max_languages * n_words`` words reach the driver."""
    doc_id, text, lang = named([id_col, text_col, lang_col])
    label_id, label = named([id_col, label_col])
    good = labels.where(label == 1).select(label_id.alias("id")).where("id is not null").distinct()
    good = good.orderBy(F.md5(F.col("id").cast("string").cast("binary")), "id").limit(max_rows)
    known = docs.select(doc_id.alias("id"), text.alias("text"), lang.alias("lang")).where("lang is not null").join(F.broadcast(good), "id", "left_semi")
    counted = counts(known, ["lang", "text"]).where("not q.base_failed")
    sample = saved(counted.select("keep.lang", "keep.text", "q.classes", "q.n_words"), "quality-sample")
    sums = [F.sum(F.col("classes")[k]).alias(f"c{k}") for k in range(len(CHAR_CLASSES))]
    found = sample.groupBy("lang").agg(F.count("*").alias("docs"), F.sum("n_words").alias("n"), *sums).where(F.col("docs") >= min_docs)
    langs = found.orderBy(F.desc("docs"), "lang").limit(max_languages).collect()
    words = sample.where(F.col("lang").isin([r["lang"] for r in langs])).select("lang", F.explode(_words(F.col("text"))).alias("word")).groupBy("lang", "word").count()
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("count"), "word"))
    top: dict[str, list[tuple[str, int]]] = {r["lang"]: [] for r in langs}
    for r in words.withColumn("rank", rank).where(F.col("rank") <= n_words).orderBy("lang", "rank").collect():
        top[r["lang"]].append((r["word"], r["count"]))
    out = []
    for r in langs:
        chars = [r[f"c{k}"] for k in range(len(CHAR_CLASSES))]
        out.append(Reference(r["lang"], tuple(c / sum(chars) for c in chars), tuple(w for w, _ in top[r["lang"]]), tuple(n / r["n"] for _, n in top[r["lang"]])))
    return out


def js_distance(doc: Column, total: Column, reference: list[float]) -> Column:
    """The Jensen-Shannon distance, to the base 2, between an array of counts and shares. Where both are 0 the
    term is 0, and so is p log p at p = 0."""

    def part(x: Column, mean: Column) -> Column:
        return F.when(x > 0, x * F.log2(x / mean)).otherwise(F.lit(0.0))

    def term(c: Column, q: Column) -> Column:
        p = c / total
        return part(p, (p + q) / 2) + part(q, (p + q) / 2)

    terms = F.zip_with(doc, F.array(*map(F.lit, reference)), term)
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda a, x: a + x) / 2))


def allowed(n_words: Column, bins: int, any_length: float, z: float = 7.0) -> Column:
    """The distance that a clean text of so many words may have."""
    chance = (bins + z * math.sqrt(2 * bins)) / (8 * math.log(2))
    return F.sqrt(F.lit(any_length**2) + F.lit(chance) / F.greatest(n_words, F.lit(1)))


def _by_language(lang: Column, distances: dict[str, Column], no_reference: Column, no_language: Column) -> Column:
    out = F.when(lang.isNull(), no_language)
    for name, distance in distances.items():
        out = out.when(lang == name, distance)
    return out.otherwise(no_reference)


def judge(docs: DataFrame, keep: list[str], references: list[Reference], text_col: str = "text", lang_col: str = "lang", min_words: int = 50, max_char_distance: float = 0.2, min_words_common: int = 100, max_word_distance: float = 0.05, out_col: str = "quality") -> DataFrame:
    """``keep``, then ``out_col``: a struct of the base counts, ``base_failed``, the distances ``char_distance`` and
    ``word_distance``, and ``kept``. Texts under ``min_words`` are not judged by character classes, texts under
    ``min_words_common`` not by common words; the distances that are allowed at any length are ``max_char_distance`` and
    ``max_word_distance``."""
    keep = [c for c in keep if c.lower() != out_col.lower()]
    held = list(dict.fromkeys([*keep, lang_col]))
    vocabulary = tuple(dict.fromkeys(w for r in references for w in r.words))
    counted = counts(docs, held, text_col, vocabulary)
    q, lang, zero = F.col("q"), F.col("keep").getField(lang_col), F.lit(0.0)
    chars = F.greatest(F.aggregate(q["classes"], F.lit(0).cast("long"), lambda a, x: a + x).cast("double"), F.lit(1.0))
    n = F.greatest(q["n_words"].cast("double"), F.lit(1.0))

    def word_distance(r: Reference) -> Column:
        size = F.octet_length(q["common"])
        own = F.transform(F.array(*[F.lit(f" {w} ") for w in r.words]), lambda w: (size - F.octet_length(F.replace(q["common"], w))) / F.octet_length(w))
        # as the variable of a function the counts are made once, though they are used twice
        whole = F.transform(F.array(own), lambda c: F.concat(c, F.array(q["n_words"] - F.aggregate(c, zero, lambda a, x: a + x))))
        return F.get(F.transform(whole, lambda c: js_distance(c, n, [*r.shares, 1 - sum(r.shares)])), F.lit(0))

    def nearest(distances: dict[str, Column]) -> Column:
        return F.least(*distances.values()) if len(distances) > 1 else next(iter(distances.values()), zero)

    by_chars = {r.lang: js_distance(q["classes"], chars, list(r.classes)) for r in references}
    by_words = {r.lang: word_distance(r) for r in references}
    measured = counted.select("keep", "q", _by_language(lang, by_chars, nearest(by_chars), nearest(by_chars)).alias("_chars"), _by_language(lang, by_words, zero, nearest(by_words)).alias("_words"))
    bins = max((len(r.words) for r in references), default=0)
    close = ((q["n_words"] < min_words) | (F.col("_chars") <= allowed(q["n_words"], len(CHAR_CLASSES), max_char_distance))) & ((q["n_words"] < min_words_common) | (F.col("_words") <= allowed(q["n_words"], bins, max_word_distance)))
    return measured.select(*[F.col("keep").getField(c).alias(c) for c in keep], F.struct(*[q[c].alias(c) for c in BASE], F.col("_chars").alias("char_distance"), F.col("_words").alias("word_distance"), (~q["base_failed"] & close).alias("kept")).alias(out_col))
