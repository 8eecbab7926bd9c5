"""Reads of the relational store: recordings and tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.labels import is_open, label_words

#: The list's orders.
SORTS = {
    "newest": (("created_at", False),),
    "oldest": (("created_at", True),),
    "longest": (("duration_ms", False),),
    "shortest": (("duration_ms", True),),
}


def _order(sort: str, key: str) -> list[Column]:
    return [F.col(c).asc() if up else F.col(c).desc() for c, up in SORTS[sort]] + [F.col(key).asc()]


def all_recordings(recordings: DataFrame, sort: str = "newest", key: str = "id") -> DataFrame:
    return recordings.orderBy(*_order(sort, key))


def lookup(recordings: DataFrame, column: str, value: object, key: str = "id") -> DataFrame:
    """The row with this value, the least key among several."""
    return recordings.where(F.col(column) == F.lit(value)).orderBy(key).limit(1)


def waveform_of(recordings: DataFrame, recording_id: int) -> DataFrame:
    return recordings.where(F.col("id") == recording_id).select("duration_ms", "waveform_data").limit(1)


def has_column(df: DataFrame, name: str) -> bool:
    return name in df.columns


def search_by_tag(recordings: DataFrame, tags: DataFrame, query: str, key: str = "id", tag_key: str = "recording_id", label: str = "label") -> DataFrame:
    """Recordings that have a tag whose label holds the text, ``%`` and ``_`` as wildcards; each once."""
    hits = tags.where(F.lower(label).like(f"%{query.strip().lower()}%")).select(F.col(tag_key).alias(key))
    return recordings.join(hits, key, "left_semi")


def search_text(df: DataFrame, columns: list[str], query: str, order: list[str], limit: int | None = None) -> DataFrame:
    """Rows that hold the text in any of the columns, no wildcards; blank columns count for nothing."""
    text = F.lower(F.concat_ws(" ", *[F.nullif(F.col(c), F.lit("")) for c in columns]))
    found = df.where(F.instr(text, query.strip().lower()) > 0).orderBy(*order)
    return found.limit(limit) if limit else found


def first_with_word(df: DataFrame, label: str, word: str, position: str) -> DataFrame:
    """The first row whose label has the word whole, else the first that holds its letters."""
    low = F.lower(label)
    whole = low.rlike(rf"(^|[^a-z0-9'])\Q{word.lower()}\E($|[^a-z0-9'])")
    ranked = df.where(F.instr(low, word.lower()) > 0).withColumn("_rank", F.when(whole, 0).otherwise(1))
    return ranked.orderBy("_rank", position).limit(1).drop("_rank")


def created_since_midnight(recordings: DataFrame, now_ms: Column, column: str = "created_at") -> DataFrame:
    """Recordings since the last midnight of the session's time zone before ``now_ms``."""
    midnight = F.unix_millis(F.date_trunc("day", F.timestamp_millis(now_ms)))
    return recordings.where(F.col(column) >= midnight)


def by_day(recordings: DataFrame, epoch_ms: str) -> DataFrame:
    """Dates, newest first, as ``day``, ``title`` and ``n``."""
    day = F.to_date(F.timestamp_millis(epoch_ms))
    return recordings.groupBy(day.alias("day")).agg(F.count("*").alias("n")).select("day", F.date_format("day", "EEEE, MMMM d, yyyy").alias("title"), "n").orderBy(F.col("day").desc())


def day_items(recordings: DataFrame, epoch_ms: str) -> DataFrame:
    """Recordings with their date's title, in the order in which they are listed below it: a row for each, as a day may have
    any number."""
    at = F.timestamp_millis(epoch_ms)
    return recordings.withColumns({"day": F.to_date(at), "title": F.date_format(at, "EEEE, MMMM d, yyyy")}).orderBy(F.col("day").desc(), F.col(epoch_ms).desc())


def by_month(kits: DataFrame, epoch_ms: str, tags: DataFrame, annotations: DataFrame, key: str = "kit") -> DataFrame:
    """Kits by year and month with their tags and open candidates; a missing time is a group of its own."""
    n_tags = tags.groupBy(key).agg(F.count("*").alias("n_tags"))
    n_open = annotations.where(is_open(F.col("status"))).groupBy(key).agg(F.count("*").alias("n_open"))
    at = F.timestamp_millis(epoch_ms)
    joined = kits.join(n_tags, key, "left").join(n_open, key, "left").fillna(0, ["n_tags", "n_open"])
    return joined.groupBy(F.year(at).alias("year"), F.month(at).alias("month")).agg(F.count("*").alias("n_kits"), F.sum("n_tags").alias("n_tags"), F.sum("n_open").alias("n_open"))


def tags_of(tags: DataFrame, recording_id: int) -> DataFrame:
    return tags.where(F.col("recording_id") == recording_id).orderBy(F.coalesce("start_ms", "timestamp_ms"), "id")


def tag_words(tags: DataFrame) -> DataFrame:
    return tags.select("*", F.explode(label_words(F.col("word"), F.col("label"))).alias("token"))


def first_rows(df: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """The first ``n`` rows of each key. Ranks are cut off within each task before rows are shuffled."""
    if not keys:
        return df.orderBy(*order).limit(n)
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_r", rank).where(F.col("_r") <= n).drop("_r")


def within_window(tags: DataFrame, end_ms: Column, window_ms: int, column: str = "timestamp_ms") -> DataFrame:
    """Tags whose time is in the window that ends at ``end_ms`` and is ``window_ms`` long, from 0 at the earliest."""
    return tags.where(F.col(column).between(F.greatest(F.lit(0), end_ms - window_ms), end_ms))


def kits_by_month(kits: DataFrame, epoch_ms: str) -> DataFrame:
    """Kits with their year and month, the newest first; ones without a time come last."""
    at = F.timestamp_millis(epoch_ms)
    return kits.withColumns({"year": F.year(at), "month": F.month(at)}).orderBy(F.col("year").desc_nulls_last(), F.col("month").desc_nulls_last(), F.col(epoch_ms).desc_nulls_last())


def latest(df: DataFrame, keys: list[str], order: str, n: int) -> DataFrame:
    """The ``n`` newest rows of each key."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(order).desc()))
    return df.withColumn("_r", rank).where(F.col("_r") <= n).drop("_r")


def library(manifests: DataFrame, tags: DataFrame, annotations: DataFrame, key: str = "kit") -> DataFrame:
    """Each kit with its tags in order of time and its annotations in file order, as arrays of structs."""
    def packed(rows: DataFrame, order: list[str], name: str) -> DataFrame:
        fields = [c for c in rows.columns if c != key]
        return rows.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*order, F.struct(*fields).alias("item")))).alias(name)).withColumn(name, F.transform(name, lambda x: x["item"]))

    return manifests.join(packed(tags, ["start_ms", "pos"], "tags"), key, "left").join(packed(annotations, ["pos"], "annotations"), key, "left")
