"""Label, name and taxonomy functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The taxonomy.
CATEGORIES = ("verbal vocalization", "non-verbal vocalization", "non-vocal vegetative sound")
LANGUAGES = ("Swiss German dialect", "Spanish", "English")
LANGUAGE_CODES = {"Swiss German dialect": "de", "Spanish": "es", "English": "en"}
AUDIO_EXTENSIONS = ("m4a", "wav", "mp3", "aac", "caf", "aif", "aiff", "flac", "mp4")


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def normalize_category(c: Column) -> Column:
    return F.when(F.trim(c).isin(*CATEGORIES), F.trim(c)).otherwise(F.lit(""))


def normalize_language(c: Column) -> Column:
    return F.when(F.trim(c).isin(*LANGUAGES), F.trim(c)).otherwise(F.lit(""))


def compose_label(category: Column, speaker: Column, language: Column, word: Column, note: Column) -> Column:
    """The parts that aren't blank, joined by `` · ``; the word stands for the note if both are there."""
    parts = F.concat_ws(" · ", blank_to_null(category), blank_to_null(speaker), blank_to_null(language), F.coalesce(blank_to_null(word), blank_to_null(note)))
    return F.when(parts == "", "untitled").otherwise(parts)


def note_from_label(label: Column, composed_without_note: Column) -> Column:
    """What a composed label has after its known parts, or the whole label where it doesn't begin with them."""
    lead = F.concat(composed_without_note, F.lit(" · "))
    return F.when(label.startswith(lead), F.substring(label, F.length(lead) + 1, F.length(label))).when(label == composed_without_note, F.lit("")).otherwise(label)


def taxonomy_error(category: Column, word: Column) -> Column:
    """Why a tag's fields are not valid, or null."""
    known = normalize_category(category)
    return F.when(F.coalesce(known, F.lit("")) == "", "category required").when((known == CATEGORIES[0]) & blank_to_null(word).isNull(), "word required for verbal vocalization")


def short_label(word: Column, phonetic: Column, note: Column, label: Column) -> Column:
    return F.coalesce(blank_to_null(word), blank_to_null(phonetic), blank_to_null(note), blank_to_null(label), F.lit("untitled"))


def display_name(session_name: Column, filename: Column) -> Column:
    return F.coalesce(blank_to_null(session_name), blank_to_null(filename), F.lit("Untitled"))


def label_words(word: Column, label: Column) -> Column:
    """The word if there is one, else the label's runs of ASCII letters, digits and apostrophes, in lower case."""
    own = F.lower(blank_to_null(word))
    return F.when(own.isNotNull(), F.array(own)).otherwise(F.regexp_extract_all(F.lower(F.coalesce(label, F.lit(""))), F.lit("([a-z0-9']+)"), F.lit(1)))


def session_stamp(epoch_ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(epoch_ms), "yy_MM_dd__HH:mm:ss")


def backup_folder(epoch_ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(epoch_ms), "yyyy-MM-dd_HHmm")


def utc_stamp(epoch_ms: Column) -> Column:
    """ISO date and time in UTC, to the millisecond. By numbers, so the session's time zone has no part in it."""
    day, rest = F.floor(epoch_ms / 86_400_000), F.pmod(epoch_ms, F.lit(86_400_000))
    parts = [F.lpad(F.floor(rest / unit % of).cast("string"), width, "0") for unit, of, width in ((3_600_000, 24, 2), (60_000, 60, 2), (1000, 60, 2), (1, 1000, 3))]
    return F.concat(F.date_from_unix_date(day.cast("int")).cast("string"), F.lit("T"), F.concat_ws(":", *parts[:3]), F.lit("."), parts[3], F.lit("Z"))


def kit_folder(epoch_ms: Column, name: Column) -> Column:
    """An ISO stamp in UTC without ``:`` and ``.``, and the name in ASCII word characters, 40 at most."""
    stamp = F.regexp_replace(utc_stamp(epoch_ms), "[:.]", "-")
    slug = F.substring(F.regexp_replace(F.coalesce(blank_to_null(name), F.lit("session")), r"[^\w\-]+", "_"), 1, 40)
    return F.concat_ws("_", stamp, slug)


def import_name(filename: Column, number: Column) -> Column:
    """A session's name from a file's: without the extension, unless nothing or a bare number is left."""
    stem = F.regexp_replace(basename(filename), r"\.[^.]+$", "")
    return F.when(stem.rlike(r"^\s*$|^[0-9]+$"), F.concat(F.lit("Imported-"), number.cast("string"))).otherwise(F.trim(stem))


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def importable_url(url: Column) -> Column:
    return url.rlike(r"(?i)^(file|content)://.*\.(" + "|".join(AUDIO_EXTENSIONS) + r")([?#].*)?$")


def normalize_source(c: Column) -> Column:
    """An unknown source counts as machine-made, a missing one as the user's."""
    known = F.coalesce(c, F.lit("user"))
    return F.when(known.isin("user", "ml", "ml_confirmed"), known).otherwise("ml")


def normalize_status(c: Column) -> Column:
    return F.when(F.coalesce(c, F.lit("confirmed")) == "provisional", "provisional").otherwise("confirmed")


def is_machine_made(source: Column) -> Column:
    return source.isNotNull() & (source != "user")


def is_open(status: Column) -> Column:
    return ~F.coalesce(status, F.lit("")).isin("confirmed", "dismissed")


def is_label_locked(*labels: Column) -> Column:
    """Whether a cluster has any label of its own."""
    out = F.lit(False)
    for c in labels:
        out = out | blank_to_null(c).isNotNull()
    return out


def language_code(c: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, code in LANGUAGE_CODES.items():
        out = F.when(F.trim(c) == name, code).otherwise(out)
    return out


def number_or(c: Column, default: float) -> Column:
    return F.coalesce(c.try_cast("double"), F.lit(float(default)))


def duration_or_last(duration_ms: Column, samples: Column, bar_ms: Column, known: Column | None = None) -> Column:
    """A recording's duration, else the end of its last level sample. A duration counts where it is above 0, or where ``known``
    says so."""
    counts = duration_ms > 0 if known is None else known
    return F.coalesce(F.when(counts, duration_ms.cast("double")), F.element_at(samples, -1)["tMs"] + bar_ms)


def waveform_outdated(version: Column, samples: Column, current: int = 3) -> Column:
    """Whether a level series is of an older kind, or has samples without amplitudes."""
    return (F.coalesce(version, F.lit(0)) < current) | F.exists(samples, lambda s: s["minAmp"].isNull() | s["maxAmp"].isNull())


def nonspeech_reason(low_band: Column, speech_band: Column, voicing: Column) -> Column:
    reasons = F.concat_ws(", ", F.when(low_band >= 0.45, "low-frequency rumble"), F.when(speech_band < 0.45, "little energy in the voice band"), F.when(voicing < 0.40, "not periodic/voiced"))
    return F.when(reasons == "", "weakly voice-like overall").otherwise(reasons)


def jaccard(a: Column, b: Column) -> Column:
    """Shared over joint members of two sets, 1 for two empty ones."""
    joint = F.size(F.array_union(a, b))
    return F.when(joint == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / joint)
