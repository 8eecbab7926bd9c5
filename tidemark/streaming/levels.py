"""Level samples and imports as streams.

The batch form of binning accepts a sample however late. A stream must bound what it remembers, so here a sample
of a bin that the watermark has passed is dropped: the one deviation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.functions.labels import AUDIO_EXTENSIONS, basename, extension, import_name
from tidemark.sources.kits import OWN_PREFIXES


def file_stream(spark: SparkSession, path: str, schema: str, max_files: int = 8, clean: str = "off") -> DataFrame:
    """New Parquet files of a folder, in turns; ``clean`` may be ``delete`` for files that were imported."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files)
    return (reader.option("cleanSource", clean) if clean != "off" else reader).parquet(path)


def binned(events: DataFrame, keys: list[str], event_time: str, width: str, half: str, aggs: list[Column], watermark: str = "1 minute") -> DataFrame:
    """Aggregates by bin, ``(keys, bin_start, bin, bin_end)``: event-time windows of ``width`` that begin ``half`` a width off, so each
    is centred on a multiple of the width, ``bin``. A window's state ends, and later samples of it are dropped, when the
    watermark passes its end."""
    windows = events.withWatermark(event_time, watermark).groupBy(*keys, F.window(event_time, width, width, half).alias("_w")).agg(*aggs)
    middle = F.timestamp_micros(((F.unix_micros("_w.start") + F.unix_micros("_w.end")) / 2).cast("long"))
    rest = [c for c in windows.columns if c not in (*keys, "_w")]
    return windows.select(*keys, F.col("_w.start").alias("bin_start"), middle.alias("bin"), F.col("_w.end").alias("bin_end"), *rest)


def sessions(events: DataFrame, keys: list[str], event_time: str, gap: str, aggs: list[Column], watermark: str = "1 minute") -> DataFrame:
    """Groups of instants that follow each other within ``gap``."""
    return events.withWatermark(event_time, watermark).groupBy(*keys, F.session_window(event_time, gap)).agg(*aggs)


def into(query: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None], mode: str = "update", every: str | None = None) -> StreamingQuery:
    """Runs each batch through ``each``: all there is now, or on and on at an interval."""
    writer = query.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(each)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def once_per_key(events: DataFrame, key: str, event_time: str, watermark: str = "10 minutes") -> DataFrame:
    """The first event of each key within the watermark: an alert isn't repeated."""
    return events.withWatermark(event_time, watermark).dropDuplicatesWithinWatermark([key])


def _versions(spark: SparkSession, state_path: str) -> list[int]:
    """The numbers of a table's versions."""
    at = spark._jvm.org.apache.hadoop.fs.Path(state_path)
    store = at.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in store.listStatus(at)] if store.exists(at) else []
    return sorted(int(n.removeprefix("version=")) for n in names if n.removeprefix("version=").isdigit())


def newest_version(spark: SparkSession, state_path: str, before: int | None = None) -> str:
    """The path of the newest version (below ``before``), or of the base table."""
    known = [v for v in _versions(spark, state_path) if before is None or v < before]
    return f"{state_path}/version={known[-1] if known else 'base'}"


def idempotent_upsert(state_path: str, merge: Callable[[DataFrame, DataFrame], DataFrame], keep: int = 2) -> Callable[[DataFrame, int], None]:
    """A batch function that merges each batch into the newest version of a table before it and writes it as the version of
    the batch's number; a batch that is run again gives the same version again. The newest ``keep`` versions stay."""

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        base = spark.read.parquet(newest_version(spark, state_path, number))
        merge(base, batch).write.mode("overwrite").parquet(f"{state_path}/version={number}")
        for old in [v for v in _versions(spark, state_path) if v < number][: -(keep - 1) or None]:
            at = spark._jvm.org.apache.hadoop.fs.Path(f"{state_path}/version={old}")
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)

    return each


def audio_stream(spark: SparkSession, inbox: str, max_files: int = 64, clean: str = "off") -> DataFrame:
    """Audio files that arrive in a folder, as ``(path, name, number, extension, size, modified, content)``: those that can be
    imported. ``clean`` may be ``delete`` for files whose batch has been written."""
    reader = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("maxFilesPerTrigger", max_files).option("recursiveFileLookup", "true")
    found = (reader.option("cleanSource", clean) if clean != "off" else reader).load(inbox)
    own = F.lit(False)
    for p in OWN_PREFIXES:
        own = own | basename(F.col("path")).startswith(p)
    kept = found.where(extension(F.col("path")).isin(*AUDIO_EXTENSIONS) & ~own)
    return kept.select("path", basename(F.col("path")).alias("filename"), extension(F.col("path")).alias("extension"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), "content")


def imported(files: DataFrame, number: Column) -> DataFrame:
    """New recordings of audio files, ``(filename, session_name, created_at, audio_content_hash)``, files of equal content once."""
    rows = files.select("filename", import_name(F.col("filename"), number).alias("session_name"), F.unix_millis("modified").alias("created_at"), F.sha2("content", 256).alias("audio_content_hash"))
    return rows.groupBy("audio_content_hash").agg(F.min(F.struct("created_at", "filename", "session_name")).alias("f")).select("f.*", "audio_content_hash")


def replaced_samples(metering: DataFrame, from_file: DataFrame, keys: list[str]) -> DataFrame:
    """File-derived samples where a recording has any, else the metered ones."""
    return from_file.unionByName(metering.join(from_file.select(*keys).distinct(), keys, "left_anti"), allowMissingColumns=True)
