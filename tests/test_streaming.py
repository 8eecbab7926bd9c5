"""Streams whose state ends, versions that are bounded, and imports of audio files."""

import datetime as dt
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tidemark.streaming import levels as stream

SCHEMA = "user string, at timestamp, value double"


def at(second):
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=second)


def test_bins_end_with_the_watermark(spark, tmp_path):
    """Each bin is centred on a multiple of its width; after the watermark its state is gone and a late sample is dropped."""
    inbox, out, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))
    rng = random.Random(1)
    batches = [[(u, at(base + rng.random() * 100), rng.random()) for u in "ab" for _ in range(50)] for base in (1000, 2000, 3000)] + [[("a", at(1001), 99.0), ("a", at(3500), 0.5)]]
    states = []
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(inbox)
        bins = stream.binned(stream.file_stream(spark, inbox, SCHEMA), ["user"], "at", "10 seconds", "5 seconds", [F.max("value").alias("peak"), F.count("*").alias("n")], "30 seconds")
        q = stream.into(bins, cp, lambda batch, number, k=k: batch.write.mode("overwrite").parquet(f"{out}/batch={k * 10 + number}"))
        q.awaitTermination()
        states.append(sum(o.numRowsTotal for o in q.lastProgress.stateOperators))
    got = {(r["user"], r["bin"]): (r["peak"], r["n"]) for r in spark.read.parquet(out).groupBy("user", "bin").agg(F.max("peak").alias("peak"), F.max("n").alias("n")).collect()}
    want = {}
    for u, t, v in sum(batches[:3], []) + [("a", at(3500), 0.5)]:
        place = u, at(round((t - at(0)).total_seconds() / 10 + 1e-9) * 10)
        peak, n = want.get(place, (0.0, 0))
        want[place] = max(peak, v), n + 1
    assert got == want
    assert max(states) < 30 and states[-1] <= 8  # three batches have over 60 bins


def test_versions_are_bounded(spark, tmp_path):
    path = str(tmp_path / "state")
    spark.createDataFrame([(0,)], "x int").write.parquet(f"{path}/version=base")
    each = stream.idempotent_upsert(path, lambda old, batch: old.unionByName(batch))
    for k in (0, 1, 2, 5, 5, 6):
        each(spark.createDataFrame([(k + 1,)], "x int"), k)
    assert stream._versions(spark, path) == [5, 6]
    assert sorted(r["x"] for r in spark.read.parquet(stream.newest_version(spark, path)).collect()) == [0, 1, 2, 3, 6, 7]


def test_audio_files_arrive(spark, tmp_path):
    """Files of known kinds become recordings, those of equal content one; the recorder's own are left alone."""
    inbox = tmp_path / "inbox"
    inbox.mkdir()
    for name, data in {"Talk one.WAV": b"a" * 100, "copy.m4a": b"a" * 100, "12.mp3": b"b", "note.txt": b"c", "recording_1.wav": b"d"}.items():
        (inbox / name).write_bytes(data)
    out = str(tmp_path / "out")
    rows = stream.audio_stream(spark, str(inbox))
    stream.into(rows, str(tmp_path / "cp"), lambda batch, number: stream.imported(batch, F.lit(7)).write.mode("append").parquet(out), "append").awaitTermination()
    got = {r["audio_content_hash"]: r["session_name"] for r in spark.read.parquet(out).collect()}
    assert set(got) == {hashlib.sha256(x).hexdigest() for x in (b"a" * 100, b"b")}
    assert got[hashlib.sha256(b"b").hexdigest()] == "Imported-7" and got[hashlib.sha256(b"a" * 100).hexdigest()] in ("Talk one", "copy")


def test_once_per_key(spark, tmp_path):
    inbox = str(tmp_path / "in")
    spark.createDataFrame([("a", at(1), 1.0), ("a", at(5), 2.0), ("b", at(2), 3.0)], SCHEMA).coalesce(1).write.parquet(inbox)
    once = stream.once_per_key(stream.file_stream(spark, inbox, SCHEMA), "user", "at")
    stream.into(once, str(tmp_path / "cp"), lambda batch, number: batch.write.mode("append").parquet(str(tmp_path / "out")), "append").awaitTermination()
    assert sorted(r["user"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b"]


@pytest.mark.parametrize("zone", ["UTC", "Asia/Kolkata", "America/New_York"])
def test_folder_names_are_in_utc(spark, zone):
    from tidemark.functions import labels

    own = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        for ms in (0, 1_710_054_000_123, 1_711_843_199_999, -1):
            want = (dt.datetime(1970, 1, 1) + dt.timedelta(milliseconds=ms)).isoformat(timespec="milliseconds") + "Z"
            assert spark.range(1).select(labels.utc_stamp(F.lit(ms).cast("long"))).first()[0] == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", own)
