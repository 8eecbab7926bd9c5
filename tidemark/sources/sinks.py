"""Writes of interchange folders and reports. Files are text, written by Spark's own writers below the target."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.labels import backup_folder, kit_folder


def manifest_json(recordings: DataFrame, exported_at: Column) -> DataFrame:
    """``(kit, json)``: the manifest of each recording."""
    m = F.struct(
        F.lit(1).alias("schemaVersion"), F.col("id").alias("recordingId"), F.col("uuid").alias("recordingUuid"), F.col("session_name").alias("sessionName"), "filename", F.lit("audio.wav").alias("audioFile"),
        F.col("duration_ms").alias("durationMs"), F.col("created_at").alias("createdAt"), F.lit("pcm").alias("codec"), F.lit(44100).alias("sampleRate"), F.lit(16).alias("bitDepth"), F.lit(1).alias("channels"),
        F.col("audio_content_hash").alias("audioContentHash"), exported_at.alias("exportedAt"),
    )
    return recordings.select(kit_folder(F.col("created_at"), F.col("session_name")).alias("kit"), F.to_json(m).alias("json"))


def kit_tag(tags: DataFrame) -> Column:
    start = F.coalesce("start_ms", "timestamp_ms")
    return F.struct("uuid", "label", start.alias("startMs"), F.col("end_ms").alias("endMs"), start.alias("tMs"), F.coalesce("source", F.lit("user")).alias("source"), F.coalesce("status", F.lit("confirmed")).alias("status"))


def tag_files(tags: DataFrame, kit: str = "kit") -> tuple[DataFrame, DataFrame]:
    """``(kit, json)`` of the users' tags and of all others."""
    users = F.coalesce("source", F.lit("user")) == "user"

    def packed(rows: DataFrame, name: str) -> DataFrame:
        item = F.struct(F.coalesce("start_ms", "timestamp_ms").alias("at"), F.col("id"), kit_tag(rows).alias("item"))
        return rows.groupBy(kit).agg(F.transform(F.sort_array(F.collect_list(item)), lambda x: x["item"]).alias(name)).select(kit, F.to_json(F.struct(name)).alias("json"))

    return packed(tags.where(users), "tags"), packed(tags.where(~users), "annotations")


def batch_manifest(manifests: DataFrame, exported_at: Column, max_kits: int = 10_000) -> DataFrame:
    """The manifest of a batch of kits that a user exports together, with their names in order. A batch of more than
    ``max_kits`` is an error, as it would be one unbounded row."""
    counted = manifests.agg(F.count("*").alias("_n"))
    few = F.when(F.col("_n") <= max_kits, F.col("kit")).otherwise(F.raise_error(F.concat(F.lit("too many kits for a batch: "), F.col("_n").cast("string"))))
    sessions = manifests.select("kit").crossJoin(F.broadcast(counted)).select(few.alias("kit")).agg(F.sort_array(F.collect_list("kit")).alias("sessions"))  # one row
    return sessions.select(F.to_json(F.struct(F.lit(1).alias("schemaVersion"), exported_at.alias("exportedAt"), "sessions")).alias("json"))


def waveform_json(recordings: DataFrame) -> DataFrame:
    """``(kit, json)``: the level series that a shared kit may have beside its audio, of recordings that have one."""
    name = kit_folder(F.col("created_at"), F.col("session_name")).alias("kit")
    return recordings.where(F.coalesce("waveform_data", F.lit("")) != "").select(name, F.col("waveform_data").alias("json"))


def write_backup(table: DataFrame, root: str, epoch_ms: int) -> str:
    """A table below a folder that is named by the time of the backup."""
    spark = table.sparkSession
    name = spark.range(1).select(backup_folder(F.lit(epoch_ms).cast("long"))).first()[0]
    path = f"{root.rstrip('/')}/{name}"
    table.write.mode("overwrite").parquet(path)
    return path


def sync_state_json(state: DataFrame, last_sync: Column, max_kits: int = 100_000) -> DataFrame:
    """The document of what has been pushed, ``(json)``, of ``(kit, fingerprint, pushed, pushed_at, tag_count, audio_content_hash)``. It is
    the state of one device's library; of more than ``max_kits`` kits it is an error."""
    counted = state.agg(F.count("*").alias("_n"))
    entry = F.struct("kit", F.struct(F.col("fingerprint").alias("tagsFingerprint"), "pushed", F.col("pushed_at").alias("pushedAt"), F.col("tag_count").alias("tagCount"), F.col("audio_content_hash").alias("audioContentHash")))
    few = F.when(F.col("_n") <= max_kits, entry).otherwise(F.raise_error(F.concat(F.lit("too many kits for a state file: "), F.col("_n").cast("string"))))
    kits = state.crossJoin(F.broadcast(counted)).agg(F.map_from_entries(F.sort_array(F.collect_list(few))).alias("kits"))  # one row
    return kits.select(F.to_json(F.struct("kits", last_sync.alias("lastSyncAt"))).alias("json"))


def write_kits(documents: DataFrame, path: str, kit: str = "kit") -> None:
    """``(kit, json)`` as text, a folder ``kit=...`` for each; ``documents`` may have several rows for one."""
    documents.select(kit, F.col("json").alias("value")).repartition(kit).write.mode("overwrite").partitionBy(kit).text(path)


def write_versioned(table: DataFrame, root: str, stamp: str) -> str:
    """A new version beside the older ones."""
    path = f"{root.rstrip('/')}/version={stamp}"
    table.write.mode("overwrite").parquet(path)
    return path


def versions_to_drop(versions: DataFrame, keep: int = 8) -> DataFrame:
    """All but the newest versions; versions are few."""
    kept = versions.orderBy(F.col("version").desc()).limit(keep)
    return versions.join(kept, "version", "left_anti")


def seeded(library: DataFrame, samples: DataFrame, key: str = "kit") -> DataFrame:
    """The library with the sample kits that it hasn't got."""
    return library.unionByName(samples.join(library.select(key), key, "left_anti"), allowMissingColumns=True)


def tags_filled(tags: DataFrame, other: DataFrame, key: str = "kit") -> DataFrame:
    """Tags, and another source's for kits without any."""
    return tags.unionByName(other.join(tags.select(key).distinct(), key, "left_anti"), allowMissingColumns=True)
