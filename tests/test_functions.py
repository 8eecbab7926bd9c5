import math

import pytest
from pyspark.sql import functions as F

from tidemark.functions import labels, levels, spans

ROWS = [("a", 10, 20, 5), ("b", 10, None, 5), ("c", 20, 10, 5), ("d", 10, 10, 5), ("e", None, None, 5), ("f", None, None, None), ("g", None, 90, None), ("h", 0, 200, 1)]


@pytest.mark.parametrize(
    "policy,want",
    [
        ("suppress_tag", {"a": (10, 20), "b": (10, 510), "c": (10, 20), "d": (10, 10), "e": (5, 505), "h": (0, 200)}),
        ("suppress_candidate", {"a": (10, 20), "b": (10, 10), "c": (10, 20), "d": (10, 10), "e": (5, 5), "f": (0, 0), "g": (0, 90), "h": (0, 200)}),
        ("evaluate", {"a": (10, 20), "b": (10, 510), "c": (20, 520), "d": (10, 510), "e": (5, 505), "h": (0, 200)}),
        ("cluster_tag", {"b": (10, 310), "e": (0, 300), "f": (0, 300), "h": (0, 200)}),
        ("cluster_annotation", {"b": (10, 310), "e": (5, 305), "f": (0, 300), "h": (0, 200)}),
        ("asr", {"a": (10, 90), "b": (10, 310), "c": (10, 90), "d": (10, 90), "e": (5, 305), "f": (0, 300), "g": (0, 90), "h": (0, 200)}),
        ("list", {"a": (10, 20), "b": (10, 10), "c": (10, 20), "d": (10, 10), "e": (0, 0), "f": (0, 0), "g": (0, 90), "h": (0, 200)}),
        ("create", {"a": (10, 20), "b": (10, 10), "c": (20, 10), "d": (10, 10), "e": (0, 0), "f": (0, 0), "g": (0, 90), "h": (0, 200)}),
    ],
)
def test_span_policies(spark, policy, want):
    df = spark.createDataFrame(ROWS, "k string, start_ms long, end_ms long, t_ms long")
    got = {r["k"]: (r["start_ms"], r["end_ms"]) for r in spans.normalize_spans(df, policy).collect()}
    assert got == want


def one(spark, *columns):
    return tuple(spark.range(1).select(*[c.alias(f"c{k}") for k, c in enumerate(columns)]).first())


def lits(*values):
    return [F.lit(v) for v in values]


def test_span_arithmetic(spark):
    assert one(spark, spans.overlap(*lits(0, 10, 5, 20)), spans.overlap(*lits(0, 5, 5, 9)), spans.overlap(*lits(0, 1, 5, 9))) == (5, 0, 0)
    assert one(spark, spans.iou(*lits(0, 10, 5, 20)), spans.iou(*lits(3, 3, 3, 3))) == (0.25, 0.0)
    # touching once widened: gaps below twice the margin
    assert one(spark, *[spans.overlaps_within(*lits(0, 100, 100 + gap, 300)) for gap in (149, 150, 151)]) == (True, False, False)


def test_levels(spark):
    assert one(spark, *[levels.bin_of(F.lit(x), 50) for x in (24.9, 25.0, 75.0, -25.0, -26.0)]) == (0, 50, 100, 0, -50)
    assert one(spark, levels.db_to_amplitude(F.lit(-160.0)), levels.db_to_amplitude(F.lit(6.0)), levels.db_to_amplitude(F.lit(-20.0))) == (0.0, 1.0, pytest.approx(0.1))
    for n in (1, 19, 20, 21, 40):
        want = sorted(range(n))[min(n - 1, math.floor(n * 0.95))]
        assert one(spark, levels.nearest_rank(F.array(*lits(*range(n))))) == (want,)
    assert one(spark, levels.nearest_rank(F.array().cast("array<int>"))) == (None,)
    assert one(spark, *[levels.playback_floor(F.lit(x).cast("double")) for x in (None, -5.0, -10.0, -30.0)]) == (-45.0, -45.0, -50.0, -55.0)
    assert one(spark, *[levels.nice_step(F.lit(x)) for x in (8.0, 9.0, 20.0, 70.0)]) == (1.0, 2.0, 5.0, 10.0)
    assert one(spark, levels.tick_label(F.lit(65_250)), levels.bipolar_scale(F.lit(0.4)), levels.db_to_height(F.lit(float("nan")), F.lit(-60.0), F.lit(0.0))) == ("1:05.3", 0.5, 0.0)
    assert one(spark, *[levels.db_to_height(F.lit(x), F.lit(-60.0), F.lit(0.0)) for x in (-42.0, -41.0, 5.0, float("-inf"))]) == (0.0, 19 / 60, 1.0, 0.0)


def test_labels(spark):
    assert one(spark, labels.compose_label(*lits(" a ", "", "x", "w", "n")), labels.compose_label(*lits("", " ", "", "", "")), labels.compose_label(F.lit("a"), F.lit(None).cast("string"), F.lit(""), F.lit(""), F.lit("n"))) == ("a · x · w", "untitled", "a · n")
    assert one(spark, labels.note_from_label(*lits("a · b · note", "a · b")), labels.note_from_label(*lits("a · b", "a · b")), labels.note_from_label(*lits("else", "a"))) == ("note", "", "else")
    assert one(spark, labels.label_words(*lits("Word", "x y")), labels.label_words(*lits(" ", "Änteli's 2 go"))) == (["word"], ["nteli's", "2", "go"])
    assert one(spark, *[labels.normalize_source(F.lit(x).cast("string")) for x in (None, "user", "ml_confirmed", "vad_v0")]) == ("user", "user", "ml_confirmed", "ml")
    assert one(spark, *[labels.normalize_status(F.lit(x).cast("string")) for x in (None, "provisional", "odd")]) == ("confirmed", "provisional", "confirmed")
    assert one(spark, *[labels.is_open(F.lit(x).cast("string")) for x in (None, "provisional", "dismissed")]) == (True, True, False)
    assert one(spark, labels.kit_folder(F.lit(0), F.lit("My é name! " + "x" * 60)), labels.session_stamp(F.lit(0)), labels.backup_folder(F.lit(0))) == ("1970-01-01T00-00-00-000Z_My_name_" + "x" * 32, "70_01_01__00:00:00", "1970-01-01_0000")
    assert one(spark, labels.import_name(*lits("dir/My talk.m4a", 3)), labels.import_name(*lits("123.wav", 3)), labels.extension(F.lit("a/b.WAV"))) == ("My talk", "Imported-3", "wav")
    assert one(spark, labels.taxonomy_error(*lits("x", "w")), labels.taxonomy_error(*lits("verbal vocalization", " ")), labels.taxonomy_error(*lits("non-verbal vocalization", ""))) == ("category required", "word required for verbal vocalization", None)
    assert one(spark, labels.number_or(F.lit("x"), 2), labels.number_or(F.lit("3.5"), 2), labels.language_code(F.lit("Spanish")), labels.importable_url(F.lit("file:///a/b.M4A"))) == (2.0, 3.5, "es", True)
    assert one(spark, labels.nonspeech_reason(*lits(0.5, 0.4, 0.9)), labels.nonspeech_reason(*lits(0.1, 0.9, 0.9))) == ("low-frequency rumble, little energy in the voice band", "weakly voice-like overall")
    empty = F.array().cast("array<string>")
    assert one(spark, labels.jaccard(empty, empty), labels.jaccard(F.array(*lits("a", "b")), F.array(*lits("b", "c")))) == (1.0, pytest.approx(1 / 3))
    assert one(spark, labels.short_label(*lits("", " ", "n", "l")), labels.display_name(*lits(" ", "f")), labels.is_label_locked(*lits("", "x")), labels.is_machine_made(F.lit("ml"))) == ("n", "f", True, True)
