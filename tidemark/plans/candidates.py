"""The candidate pipeline: from recordings to proposed spans. What a later step uses more than once is written down first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.labels import nonspeech_reason
from tidemark.operators import diarize, intervals, merge, segments, signal, stats
from tidemark.session import materialized

REGION_REJECT, REJECT, WEAK = 0.42, 0.55, 0.68
SHORT_MS, NOISE_Z = 700, 1.0


def speech_regions(audio: DataFrame) -> DataFrame:
    """Loud stretches, without those that hardly sound like speech, nor short ones that sound like a bang beside the recording's
    others. ``region`` numbers them."""
    level = materialized(signal.frames(audio), "frames")
    found = materialized(segments.regions(segments.voice_runs(level, ["kit"]), ["kit"]).select("kit", "start_ms", "end_ms", "score"), "regions")
    scored = found.join(signal.span_speech(found, audio), ["kit", "start_ms", "end_ms"]).where(F.col("speech_score") >= REGION_REJECT)
    scored = materialized(scored.withColumn("spikiness", 1 - F.col("sustain_ratio")), "scored")
    marked = stats.zscores(scored, ["kit"], ["flatness", "zcr", "spikiness"])
    bang = (F.col("end_ms") - F.col("start_ms") <= SHORT_MS) & (F.coalesce("z", F.lit(float("-inf"))) >= NOISE_Z)
    return merge.numbered(marked.where(~bang).select("kit", "start_ms", "end_ms", "score"), ["kit"], ["start_ms", "end_ms"], "region").withColumn("region", F.col("region").cast("long"))


def gated(pieces: DataFrame, audio: DataFrame, reject: bool = True) -> DataFrame:
    """Pieces that don't sound like speech go, or score 0.3 at most where ``reject`` is off; weak ones score 0.5 at most. Both
    are flagged."""
    spans = pieces.select("kit", "start_ms", "end_ms").distinct()
    scored = pieces.join(signal.span_speech(spans, audio), ["kit", "start_ms", "end_ms"])
    return judged(scored.withColumn("_reason", nonspeech_reason(F.col("low_band_ratio"), F.col("speech_band_ratio"), F.col("voicing_peak"))), reject).drop("_reason")


def judged(scored: DataFrame, reject: bool = True) -> DataFrame:
    """The gate's rule for pieces with ``speech_score``, ``score``, ``flags`` and ``_reason``."""
    weak, none = F.col("speech_score") < WEAK, F.col("speech_score") < REJECT
    most = F.when(none, 0.3).when(weak, 0.5)
    rows = scored.where(~none) if reject else scored
    return rows.withColumns({"score": F.least(F.col("score"), most), "flags": F.when(weak, F.array_append("flags", "possible_non_speech")).otherwise(F.col("flags")), "non_speech_reason": F.when(weak, F.col("_reason"))})


def candidates(audio: DataFrame, tags: DataFrame | None = None, speakers: int | None = None, backend: str = "melstats") -> DataFrame:
    """Candidate rows of each recording, those that a tag touches left out. With backend ``none`` nothing is cut by speaker."""
    regions = materialized(speech_regions(audio), "speech")
    pieces = materialized(diarize.speaker_pieces(regions, audio, speakers, backend), "pieces")
    cut = signal.pause_split(pieces, signal.frames(audio))
    own = pieces.select("kit", F.col("start_ms").alias("parent_start"), "score", "speaker_cluster", "speaker_confidence", F.col("split_by").alias("_split")).dropDuplicates(["kit", "parent_start"])
    parts = materialized(cut.join(own, ["kit", "parent_start"]).withColumn("split_by", F.coalesce("split_by", "_split")), "parts")
    words = signal.span_parts(parts.select("kit", "start_ms", "end_ms").distinct(), audio)
    fine = words.withColumnRenamed("split_by", "_word").join(parts.select("kit", F.col("start_ms").alias("parent_start"), "score", "speaker_cluster", "speaker_confidence", "split_by", "hard_capped").dropDuplicates(["kit", "parent_start"]), ["kit", "parent_start"])
    fine = fine.withColumns({"split_by": F.coalesce("_word", "split_by"), "flags": F.when(F.col("hard_capped"), F.array(F.lit("hard_capped"))).otherwise(F.array().cast("array<string>"))})
    kept = gated(materialized(fine, "fine"), audio)
    rows = kept.select(
        "kit", F.sha2(F.concat_ws(":", "kit", "start_ms", "end_ms"), 256).alias("uuid"), F.lit("").alias("label"), F.round("start_ms").cast("long").alias("start_ms"), F.round("end_ms").cast("long").alias("end_ms"),
        F.round("start_ms").cast("long").alias("t_ms"), F.lit("vad_v0").alias("source"), F.lit("provisional").alias("status"), F.round("score", 3).alias("score"), "split_by", "flags", F.round("speech_score", 3).alias("speech_score"),
        "non_speech_reason", F.when(F.col("f0") > 0, F.round("f0").cast("int")).alias("f0_med"), "speaker_cluster", "speaker_confidence",
    )
    return rows if tags is None else intervals.suppressed(rows, tags, ["kit"])
