"""Data quality: one row for each violation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def violations(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """``(key, rule)`` for each rule a row breaks; one pass over the table for all rules."""
    broken = F.filter(F.array(*[F.when(bad, F.lit(name)) for name, bad in rules.items()]), lambda r: r.isNotNull())
    return df.select(key, F.explode(broken).alias("rule"))


def kit_violations(kits: DataFrame, manifests: DataFrame, audio: DataFrame, tags: DataFrame, required: tuple[str, ...], min_audio_bytes: int = 100) -> DataFrame:
    """Rules of a well-formed kit: a manifest with its required fields, an audio file of some size, a duration, and tags with uuid
    and label. ``audio`` is (kit, size)."""
    base = kits.select("kit").join(manifests.withColumn("_m", F.lit(True)), "kit", "left").join(audio.groupBy("kit").agg(F.max("size").alias("_size")), "kit", "left")
    has = F.coalesce("_m", F.lit(False))
    missing = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in required])
    rules = {
        "missing manifest": ~has, "manifest incomplete": has & missing, "missing audio": has & F.col("_size").isNull(), "audio too small": has & (F.col("_size") < min_audio_bytes),
        "no duration": has & (F.coalesce("durationMs", F.lit(0)) <= 0),
    }
    bad_tags = tags.where(F.col("uuid").isNull() | F.col("label").isNull()).select("kit").distinct().withColumn("rule", F.lit("tag without uuid or label"))
    return violations(base, "kit", rules).unionByName(bad_tags)


def pipeline_counters(audio: DataFrame, regions: DataFrame, pieces: DataFrame, kept: DataFrame, flag: str = "possible_non_speech") -> DataFrame:
    """What became of each recording in the candidate pipeline: its regions, pieces, candidates that were kept, rejected and
    flagged. Each table is counted on its own, so no join sees more than one row a kit."""
    def n(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("kit").agg(F.count("*").alias(name))

    flagged = kept.where(F.array_contains(F.coalesce("flags", F.array().cast("array<string>")), flag))
    out = audio.select("kit").distinct()
    names = ("n_regions", "n_pieces", "n_candidates", "n_flagged")
    for df, name in zip((regions, pieces, kept, flagged), names):
        out = out.join(n(df, name), "kit", "left")
    return out.fillna(0, list(names)).withColumn("n_rejected", F.greatest(F.lit(0), F.col("n_pieces") - F.col("n_candidates")))


def sync_totals(pulled: DataFrame, pushed: DataFrame) -> DataFrame:
    """One row: kits pulled, kits pushed, and the tags of the latter."""
    sent = pushed.agg(F.count("*").alias("n_pushed"), F.coalesce(F.sum("tag_count"), F.lit(0)).alias("n_tags"))
    return pulled.agg(F.count("*").alias("n_pulled")).crossJoin(F.broadcast(sent))  # one row each


def tag_density(manifests: DataFrame, tags: DataFrame) -> DataFrame:
    """Tags per minute of each kit."""
    n = tags.groupBy("kit").agg(F.count("*").alias("n_tags"))
    joined = manifests.join(n, "kit", "left").fillna(0, ["n_tags"])
    minutes = F.col("durationMs") / 60000
    return joined.select("kit", "n_tags", F.when(F.col("durationMs") > 0, F.col("n_tags") / minutes).otherwise(F.lit(0.0)).alias("per_minute"))
