"""Reads of interchange folders (kits): a folder with ``manifest.json``, ``tags.json``, ``annotations.json``, ``clusters.json`` and
an audio file. All go through Spark's file sources, so any store that Spark reads will do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.labels import AUDIO_EXTENSIONS, basename, extension
from tidemark.functions.levels import SILENCE_DB, finite
from tidemark.sources import schemas

#: Prefixes of files the recorder wrote itself.
OWN_PREFIXES = ("recording_", "imported_")
CURRENT_VERSION = 3


def files(spark: SparkSession, root: str, pattern: str, recursive: bool = True) -> DataFrame:
    """``(path, kit, text)`` of the files of this name below a root; ``kit`` is the folder's name."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", pattern)
    if recursive:
        reader = reader.option("recursiveFileLookup", "true")
    return reader.load(root).select("path", F.element_at(F.split("path", "/"), -2).alias("kit"), F.decode("content", "utf-8").alias("text"))


def manifest_paths(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "manifest.json").option("recursiveFileLookup", "true").load(root).select("path")


def kit_names(spark: SparkSession, root: str, levels: int = 1) -> DataFrame:
    """Kits at the root or up to ``levels`` folders below it, in order."""
    top = F.size(F.split(F.regexp_replace(F.lit(root), r"^[a-z0-9]+:/+|/+$", ""), "/"))
    own = F.size(F.split(F.regexp_replace("path", r"^[a-z0-9]+:/+", ""), "/"))
    return manifest_paths(spark, root).withColumn("_d", own - top - 1).where(F.col("_d") <= levels).select(F.element_at(F.split("path", "/"), -2).alias("kit"), "path").orderBy("kit")


def manifests(spark: SparkSession, root: str) -> DataFrame:
    """Manifest fields by kit; a file that is no JSON object gives nulls."""
    return files(spark, root, "manifest.json").select("kit", F.from_json("text", schemas.MANIFEST).alias("m")).select("kit", "m.*")


def items_of(text: Column, name: str, item: str) -> Column:
    """The array under ``name`` of a JSON object, or the JSON array itself; null for anything else."""
    wrapped = F.from_json(text, f"struct<{name}:array<struct<{item}>>>")[name]
    bare = F.when(F.ltrim(text).startswith("["), F.from_json(text, f"array<struct<{item}>>"))
    return F.coalesce(wrapped, bare)


def _items(spark: SparkSession, root: str, pattern: str, name: str, item: str) -> DataFrame:
    found = files(spark, root, pattern).select("kit", F.posexplode(items_of(F.col("text"), name, item)).alias("pos", "i"))
    snake = {c: _snake(c) for c in [p.split(":")[0] for p in _fields(item)]}
    return found.select("kit", "pos", *[F.col("i")[c].alias(s) for c, s in snake.items()])


def _fields(item: str) -> list[str]:
    out, depth, start = [], 0, 0
    for k, c in enumerate(item):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(item[start:k])
            start = k + 1
    return [*out, item[start:]]


def _snake(name: str) -> str:
    return "".join("_" + c.lower() if c.isupper() else c for c in name)


def tags(spark: SparkSession, root: str) -> DataFrame:
    return _items(spark, root, "tags.json", "tags", schemas.TAG_ITEM)


def annotations(spark: SparkSession, root: str) -> DataFrame:
    return _items(spark, root, "annotations.json", "annotations", schemas.ANNOTATION_ITEM)


def clusters(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """Cluster documents, flattened to clusters and members."""
    rows = files(spark, root, "clusters.json").select("kit", F.explode(F.from_json("text", schemas.CLUSTERS)["clusters"]).alias("c"))
    labels = [F.col("c")[n].alias(_snake(n)) for n in ("word", "phonetic", "language", "category", "note", "conceptIds", "curated", "locked")]
    heads = rows.select("kit", F.col("c.id").alias("cluster_id"), "c.confidence.*", *labels)
    members = rows.select("kit", F.col("c.id").alias("cluster_id"), F.explode("c.members").alias("m"))
    return heads, members.select("kit", "cluster_id", *[F.col("m")[n].alias(_snake(n)) for n in ("memberId", "refType", "uuid", "startMs", "endMs", "speaker", "source", "status", "outlier")])


def sync_state(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.format("binaryFile").load(path).select(F.from_json(F.decode("content", "utf-8"), schemas.SYNC_STATE).alias("s"))
    return rows.select(F.explode("s.kits").alias("kit", "v")).select("kit", F.col("v.tagsFingerprint").alias("fingerprint"), "v.pushed", F.col("v.pushedAt").alias("pushed_at"), F.col("v.tagCount").alias("tag_count"), F.col("v.audioContentHash").alias("audio_content_hash"))


def _number(value: Column) -> Column:
    """What a JSON value counts as: null and blank text as 0, other text as the number it holds; null where it holds none."""
    number = F.trim(value).try_cast("double")
    return F.when(value.isNull() | (F.trim(value) == ""), F.lit(0.0)).when(finite(number), number)


def _field(item: Column, name: str) -> Column:
    """The number in a field, null where the field is missing or no number."""
    return F.when(F.map_contains_key(item, name), _number(item[name]))


def waveform(text: Column) -> Column:
    """A level series from its JSON: the current form, or an older array of heights from 0 to 1 at 50 ms; anything else is
    empty. A missing time is 0, a missing level silence; amplitudes may be missing; heights are held within 0 and 1, and 0
    is silence; a version or a bar's duration that is missing or 0 is the current one."""
    now = F.from_json(text, f"struct<{', '.join(f.replace(' ', ':', 1) for f in schemas.WAVEFORM.split(', '))}>")
    old = F.when(F.ltrim(text).startswith("["), F.from_json(text, "array<string>"))
    none, silence = F.lit(None).cast("double"), F.lit(SILENCE_DB)

    def level(height: Column) -> Column:
        h = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(_number(height), F.lit(0.0))))
        return F.when(h <= 0, silence).otherwise(h * 60 - 60)

    heights = F.transform(old, lambda h, k: F.struct((k * 50).cast("double").alias("tMs"), level(h).alias("avgDb"), level(h).alias("peakDb"), none.alias("minAmp"), none.alias("maxAmp")))
    current = F.transform(now["samples"], lambda s: F.struct(F.coalesce(_field(s, "tMs"), F.lit(0.0)).alias("tMs"), *[F.coalesce(_field(s, c), silence).alias(c) for c in ("avgDb", "peakDb")], *[_field(s, c).alias(c) for c in ("minAmp", "maxAmp")]))
    whole = now["samples"].isNotNull()

    def or_default(c: str, default: int) -> Column:
        given = F.coalesce(_number(now[c]), F.lit(0.0)).cast("int")
        return F.when(whole & (given != 0), given).otherwise(F.lit(default))

    version = F.when(old.isNotNull(), F.lit(1)).otherwise(or_default("version", CURRENT_VERSION))
    source = F.when(old.isNotNull(), "metering").when(whole & now["source"].isin("file", "metering"), now["source"])
    return F.struct(version.alias("version"), or_default("barDurationMs", 50).alias("barDurationMs"), source.alias("source"), F.coalesce(current, heights, F.array().cast(f"array<{schemas.SAMPLE}>")).alias("samples"))


def samples(recordings: DataFrame) -> DataFrame:
    """Level samples as rows ``(id, pos, tMs, avgDb, peakDb, minAmp, maxAmp)``."""
    return recordings.select("id", F.posexplode(waveform(F.col("waveform_data"))["samples"]).alias("pos", "s")).select("id", "pos", "s.*")


def audio_files(spark: SparkSession, root: str, own_prefixes: tuple[str, ...] = OWN_PREFIXES) -> DataFrame:
    """Audio files that could be imported: ``(path, name, size)``."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", F.col("length").alias("size"))
    name = basename(F.col("path"))
    own = F.lit(False)
    for p in own_prefixes:
        own = own | name.startswith(p)
    return listed.where(extension(F.col("path")).isin(*AUDIO_EXTENSIONS) & ~own).select("path", name.alias("name"), "size")


def audio(spark: SparkSession, root: str) -> DataFrame:
    """``(kit, path, content)`` of kits' WAV files."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").option("recursiveFileLookup", "true").load(root)
    return found.select(F.element_at(F.split("path", "/"), -2).alias("kit"), "path", "content")


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def first_existing(wanted: DataFrame, listed: DataFrame, candidates: list[str]) -> DataFrame:
    """``wanted`` with ``path``: the first of its candidate columns that is among the listed paths."""
    out, there = wanted, []
    for k, c in enumerate(candidates):
        out = out.join(listed.select(F.col("path").alias(f"_p{k}")).distinct(), F.col(c) == F.col(f"_p{k}"), "left")
        there.append(f"_p{k}")
    return out.withColumn("path", F.coalesce(*there)).drop(*there)


def cached_embeddings(members: DataFrame, cache: DataFrame) -> DataFrame:
    """Members with what the embedding cache holds for them (the first, where it holds several), the others left out."""
    known = cache.where(F.col("embedding").isNotNull()).groupBy("member_id").agg(F.first("embedding").alias("embedding"))
    return members.join(known, "member_id")


def missing_embeddings(members: DataFrame, cache: DataFrame) -> DataFrame:
    """Members that the embedding cache hasn't got."""
    return members.join(cache.select("member_id"), "member_id", "left_anti")
