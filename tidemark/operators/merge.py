"""Writes to the relational store, as tables derived from tables: inserts, keyed updates, cascading deletes, the
conflict-resolving upsert, and unions with a priority."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.labels import blank_to_null, compose_label, normalize_category, normalize_language, normalize_source, normalize_status


def appended(table: DataFrame, rows: DataFrame) -> DataFrame:
    return table.unionByName(rows, allowMissingColumns=True)


def new_recordings(rows: DataFrame, now_ms: Column, uuid: Column) -> DataFrame:
    return rows.withColumns({"created_at": F.coalesce("created_at", now_ms) if "created_at" in rows.columns else now_ms, "uuid": uuid})


def new_tags(rows: DataFrame, uuid: Column) -> DataFrame:
    """A tag's time is its start, too."""
    return rows.withColumns({"uuid": uuid, "start_ms": F.col("timestamp_ms")})


def updated(table: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """``table`` with the columns of ``changes`` put in where its key is there and the new value isn't null."""
    names = [c for c in changes.columns if c != key]
    new = changes.select(key, *[F.col(c).alias(f"_new_{c}") for c in names])
    joined = table.join(new, key, "left")
    return joined.select(*[F.coalesce(f"_new_{c}", c).alias(c) if c in names else c for c in table.columns])


def tri_state(old: Column, new: Column) -> Column:
    """A missing value keeps the old one, a blank one clears it."""
    return F.when(new.isNull(), old).when(F.trim(new) == "", F.lit(None)).otherwise(F.trim(new))


def renamed(manifests: DataFrame, names: DataFrame, key: str = "kit") -> DataFrame:
    """New session names, the first name kept as the original one."""
    joined = manifests.join(names.select(key, F.col("session_name").alias("_new")), key, "left")
    changed = F.col("_new").isNotNull()
    return joined.withColumns({"original_session_name": F.when(changed, F.coalesce("original_session_name", "session_name")).otherwise(F.col("original_session_name")), "session_name": F.coalesce("_new", "session_name")}).drop("_new")


def deleted(recordings: DataFrame, tags: DataFrame, gone: DataFrame, key: str = "id", tag_key: str = "recording_id") -> tuple[DataFrame, DataFrame]:
    """Recordings and tags without those of ``gone``'s keys."""
    ids = gone.select(F.col(key))
    return recordings.join(ids, key, "left_anti"), tags.join(ids.withColumnRenamed(key, tag_key), tag_key, "left_anti")


def without(table: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return table.join(gone.select(*keys), keys, "left_anti")


def migrated(table: DataFrame, columns: dict[str, str], uuid: Column, start: tuple[str, str] | None = ("start_ms", "timestamp_ms")) -> DataFrame:
    """Missing columns added, blank uuids filled, and a missing start taken from the mark's time."""
    added = table.withColumns({c: F.lit(None).cast(t) for c, t in columns.items() if c not in table.columns})
    if "uuid" in added.columns:
        added = added.withColumn("uuid", F.coalesce(blank_to_null(F.col("uuid")), uuid))
    if start and all(c in added.columns for c in start):
        added = added.withColumn(start[0], F.coalesce(*start))
    return added


def repeated_keys(table: DataFrame, key: str) -> DataFrame:
    """Keys that stand in several rows, which a unique index would refuse."""
    return table.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def may_replace(old_source: Column, old_status: Column, source: Column, status: Column) -> Column:
    """Whether an incoming row takes a stored row's place: nothing takes a user's but the user's, and what is provisional
    never takes a confirmed one's."""
    users = (old_source == "user") & (source != "user")
    return ~(users | ((old_status == "confirmed") & (status == "provisional")))


def upserted(base: DataFrame, incoming: DataFrame, key: str = "uuid", seq: str = "seq") -> DataFrame:
    """``base`` after the incoming rows, each key's in order of ``seq``, with ``actions``: what became of each of them. Both have
    ``source`` and ``status``; incoming ones are normalised first and dismissed ones and ones without a key left out.

    A key's rows are folded together, so several for one key in one batch are right, too. An insert is an absent
    state; one key's rows in a batch are the revisions of one tag."""
    fields = [c for c in base.columns if c != key]
    rows = incoming.where(F.col(key).isNotNull() & ~F.coalesce(F.col("status"), F.lit("")).eqNullSafe("dismissed"))
    rows = rows.withColumns({"source": normalize_source(F.col("source")), "status": normalize_status(F.col("status"))})
    item = F.struct(*[F.col(c).cast(base.schema[c].dataType).alias(c) for c in fields])
    batch = rows.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(F.col(seq).alias("seq"), item.alias("item")))).alias("_rows"))
    joined = base.select(key, F.struct(*fields).alias("_old")).join(batch, key, "full")
    item_type = joined.schema["_old"].dataType.simpleString()
    start = F.struct(F.col("_old").alias("now"), F.array().cast("array<string>").alias("actions")).cast(f"struct<now:{item_type},actions:array<string>>")

    def step(state: Column, row: Column) -> Column:
        old, new = state["now"], row["item"]
        takes = old.isNull() | may_replace(F.coalesce(old["source"], F.lit("")), F.coalesce(old["status"], F.lit("")), new["source"], new["status"])
        action = F.when(old.isNull(), "inserted").when(takes, "updated").otherwise("skipped")
        return F.struct(F.when(takes, new).otherwise(old).alias("now"), F.concat(state["actions"], F.array(action)).alias("actions")).cast(f"struct<now:{item_type},actions:array<string>>")

    folded = joined.select(key, F.aggregate(F.coalesce("_rows", F.array().cast(joined.schema["_rows"].dataType)), start, step).alias("_s"))
    return folded.select(key, *[F.col("_s.now")[c].alias(c) for c in fields], F.col("_s.actions").alias("actions"))


def upsert_summary(result: DataFrame) -> DataFrame:
    return result.select(F.explode("actions").alias("action")).groupBy("action").agg(F.count("*").alias("n"))


def linked(kits: DataFrame, recordings: DataFrame, hash_col: str = "audio_content_hash", uuid_col: str = "uuid") -> DataFrame:
    """Each kit's recording: by content hash (the least id), else by uuid."""
    by_hash = recordings.where(F.col(hash_col).isNotNull()).groupBy(F.col(hash_col).alias("_h")).agg(F.min("id").alias("_by_hash"))
    by_uuid = recordings.where(F.col(uuid_col).isNotNull()).groupBy(F.col(uuid_col).alias("_u")).agg(F.min("id").alias("_by_uuid"))
    joined = kits.join(by_hash, F.col(hash_col) == F.col("_h"), "left").join(by_uuid, F.col(uuid_col) == F.col("_u"), "left")
    return joined.withColumn("recording_id", F.coalesce("_by_hash", "_by_uuid")).drop("_h", "_u", "_by_hash", "_by_uuid")


def missing_kits(recordings: DataFrame, kits: DataFrame, keys: list[tuple[str, str]]) -> DataFrame:
    """Recordings without a kit by any of the key pairs: one anti-join each, so that every one is a hash or merge join."""
    out = recordings
    for own, other in keys:
        out = out.join(kits.where(F.col(other).isNotNull()).select(F.col(other).alias("_k")), F.col(own) == F.col("_k"), "left_anti")
    return out


def replaced_provisional(existing: DataFrame, fresh: DataFrame, source: str) -> DataFrame:
    """Existing rows but the open ones of this source, and the fresh ones."""
    open_ = (F.coalesce(F.col("source"), F.lit("")) == source) & ~F.coalesce(F.col("status"), F.lit("")).isin("confirmed", "dismissed")
    return existing.where(~open_).unionByName(fresh, allowMissingColumns=True)


def prioritized(tables: list[DataFrame], key: list[str], position: str | None = None) -> DataFrame:
    """The union of tables, the first table's row for each key (and the least ``position`` there). Partial sums pick it, so a
    repeated key costs a task one row."""
    ranked = [t.withColumn("_rank", F.lit(k)) for k, t in enumerate(tables)]
    union = ranked[0]
    for t in ranked[1:]:
        union = union.unionByName(t, allowMissingColumns=True)
    rest = [c for c in union.columns if c not in (*key, "_rank")]
    order = F.struct("_rank", *([position] if position else []))
    return union.groupBy(*key).agg(F.min_by(F.struct(*rest), order).alias("_r")).select(*key, "_r.*")


def applied_taxonomy(items: DataFrame, changes: DataFrame, key: str = "uuid") -> DataFrame:
    """Items with the category, speaker, language, word, phonetic and note of ``changes``, and the label composed of them: only
    vocal ones have a language, only verbal ones a word, all others a note."""
    c = changes.select(key, *[F.col(f).alias(f"_{f}") for f in ("category", "speaker", "language", "word", "phonetic", "note")])
    joined = items.join(c.withColumn("_there", F.lit(True)), key, "left")
    category = normalize_category(F.col("_category"))
    vocal = category.isin("verbal vocalization", "non-verbal vocalization")
    verbal = category == "verbal vocalization"
    language = F.when(vocal, F.coalesce(F.nullif(normalize_language(F.col("_language")), F.lit("")), F.lit("Swiss German dialect")))
    new = {
        "category": F.nullif(category, F.lit("")), "speaker": blank_to_null(F.col("_speaker")), "language": language,
        "word": F.when(verbal, blank_to_null(F.col("_word"))), "phonetic": F.when(vocal, blank_to_null(F.col("_phonetic"))), "note": F.when(~verbal, blank_to_null(F.col("_note"))),
    }
    new["label"] = compose_label(new["category"], new["speaker"], new["language"], new["word"], new["note"])
    out = joined.withColumns({k: F.when(F.col("_there"), v).otherwise(F.col(k)) for k, v in new.items()})
    return out.select(*items.columns)


def confirmed(tags: DataFrame, annotations: DataFrame, accepted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted candidates, promoted to tags (keyed by uuid, without their language) and marked; a tag of the uuid is replaced."""
    chosen = annotations.join(accepted.select("uuid"), "uuid", "left_semi")
    promoted = chosen.withColumns({"source": F.lit("ml_confirmed"), "status": F.lit("confirmed"), "language": F.lit(None).cast("string")})
    promoted = promoted.select(*[c for c in tags.columns if c in promoted.columns])
    marked = annotations.join(accepted.select("uuid", F.lit(True).alias("_yes")), "uuid", "left").withColumn("status", F.when(F.col("_yes"), "confirmed").otherwise(F.col("status")))
    return without(tags, accepted, ["uuid"]).unionByName(promoted, allowMissingColumns=True), marked.select(*annotations.columns)


def dismissed(annotations: DataFrame, gone: DataFrame) -> DataFrame:
    marked = annotations.join(gone.select("uuid", F.lit(True).alias("_yes")), "uuid", "left").withColumn("status", F.when(F.col("_yes"), "dismissed").otherwise(F.col("status")))
    return marked.select(*annotations.columns)


def with_asr(annotations: DataFrame, results: DataFrame) -> DataFrame:
    """Annotations with the newest recognised text of their uuid as the struct ``asr`` (``text``, ``language``, ``model``, ``source``,
    ``updatedAt``, ``startMs``, ``endMs``); where there is none, what they had."""
    fields = ("text", "language", "model", "source", "updatedAt", "startMs", "endMs")
    newest = results.groupBy("uuid").agg(F.max_by(F.struct(*fields), F.struct("updatedAt", "text")).alias("_asr"))
    joined = annotations.join(newest, "uuid", "left")
    return joined.withColumn("asr", F.coalesce("_asr", "asr") if "asr" in annotations.columns else F.col("_asr")).drop("_asr")


def uuid_of(*parts: Column) -> Column:
    """A uuid that follows from its parts, in the form of version 4: the same rows get the same one when a task is run again."""
    h = F.sha2(F.concat_ws("\u0000", *parts), 256)
    variant = F.substring(F.lit("89ab"), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4) + 1, F.lit(1))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-4"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def found_by_uuid(annotations: DataFrame, tags: DataFrame, uuids: DataFrame) -> DataFrame:
    """Spans by uuid, an annotation before a tag."""
    both = prioritized([annotations.withColumn("ref_type", F.lit("annotation")), tags.withColumn("ref_type", F.lit("tag"))], ["uuid"])
    return both.join(uuids.select("uuid"), "uuid", "left_semi")


def sync_status(remote: DataFrame, local: DataFrame) -> DataFrame:
    """What a pull does with each kit: equal audio is skipped (its missing tags are filled in), a new or changed one copied, and
    one whose remote hash is missing is copied whole but keeps the local tags."""
    joined = remote.select("kit", F.col("audio_content_hash").alias("remote_hash"), F.lit(True).alias("_remote")).join(local.select("kit", F.col("audio_content_hash").alias("local_hash"), "has_tags", F.lit(True).alias("_local")), "kit", "full")
    same = F.col("_local") & F.col("_remote") & F.col("remote_hash").isNotNull() & (F.col("remote_hash") == F.col("local_hash"))
    action = (
        F.when(F.col("_remote").isNull(), "local-only").when(F.col("_local").isNull(), "pull").when(F.coalesce(same, F.lit(False)) & F.col("has_tags"), "skip")
        .when(F.coalesce(same, F.lit(False)), "tags-from-phone").otherwise("pull-keep-tags")
    )
    return joined.select("kit", "remote_hash", "local_hash", action.alias("action"))


def changed_kits(kits: DataFrame, state: DataFrame, fingerprint: str = "fingerprint") -> DataFrame:
    """Kits whose fingerprint isn't the one that was pushed last."""
    saved = state.select("kit", F.col(fingerprint).alias("_saved"))
    return kits.join(saved, "kit", "left").where(~F.col(fingerprint).eqNullSafe(F.col("_saved"))).drop("_saved")


def numbered(df: DataFrame, keys: list[str], order: list[str], out: str = "pos") -> DataFrame:
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
