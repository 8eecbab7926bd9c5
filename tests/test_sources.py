import json
import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import levels
from tidemark.operators import checks, store
from tidemark.sources import kits, schemas, sinks
from tidemark.streaming import levels as stream


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    top = tmp_path_factory.mktemp("library")

    def put(kit, name, value):
        (top / kit).mkdir(exist_ok=True)
        (top / kit / name).write_text(value if isinstance(value, str) else json.dumps(value))

    put("k1", "manifest.json", {"schemaVersion": 1, "recordingId": 7, "recordingUuid": "u", "filename": "f", "audioFile": "audio.wav", "durationMs": 60000, "createdAt": 1, "sampleRate": 44100, "audioContentHash": "h", "unknown": [1]})
    put("k1", "tags.json", {"tags": [{"uuid": "a", "label": "x", "startMs": 5, "endMs": None, "status": None}, {"uuid": "b", "startMs": 9, "speaker": "Baby"}]})
    put("k1", "annotations.json", [{"uuid": "c", "startMs": 1, "endMs": 4, "score": 0.5, "flags": ["f"], "asr": {"text": "hi"}}])
    put("k1", "audio.wav", "x" * 200)
    put("k2", "manifest.json", "not json")
    put("k2", "tags.json", "")
    put("k3", "manifest.json", {"durationMs": 0})
    put("k3", "clusters.json", {"clusters": [{"id": "c1", "members": [{"memberId": "m", "outlier": True}], "confidence": {"tightness": 0.5, "size": 1}, "word": "w", "conceptIds": ["1"]}]})
    put("k3", "recording_1.m4a", "x")
    put("k3", "Talk.M4A", "x")
    return str(top)


def test_reads(spark, root):
    assert [r["kit"] for r in kits.kit_names(spark, root).collect()] == ["k1", "k2", "k3"]
    m = {r["kit"]: r for r in kits.manifests(spark, root).collect()}
    assert m["k1"]["durationMs"] == 60000 and m["k2"]["durationMs"] is None
    tags = {r["uuid"]: r for r in kits.tags(spark, root).collect()}
    assert tags["a"]["end_ms"] is None and tags["b"]["speaker"] == "Baby" and len(tags) == 2
    anns = kits.annotations(spark, root).collect()
    assert [(r["uuid"], r["score"], r["flags"], r["asr"]["text"], r["pos"]) for r in anns] == [("c", 0.5, ["f"], "hi", 0)]
    heads, members = kits.clusters(spark, root)
    assert heads.first()["concept_ids"] == ["1"] and members.first()["outlier"] is True
    assert [r["name"] for r in kits.audio_files(spark, root).orderBy("name").collect()] == ["Talk.M4A", "audio.wav"]
    assert kits.audio(spark, root).select("kit").first()["kit"] == "k1"
    packed = {r["kit"]: r for r in store.library(kits.manifests(spark, root), kits.tags(spark, root), kits.annotations(spark, root)).collect()}
    assert [t["uuid"] for t in packed["k1"]["tags"]] == ["a", "b"] and packed["k3"]["tags"] is None


def test_validation(spark, root):
    manifests = kits.manifests(spark, root).where("durationMs is not null")
    size = spark.createDataFrame([("k1", 200), ("k3", 5)], "kit string, size long")
    names = spark.createDataFrame([("k1",), ("k2",), ("k3",)], "kit string")
    got = {tuple(r) for r in checks.kit_violations(names, manifests, size, kits.tags(spark, root), schemas.REQUIRED_MANIFEST).collect()}
    assert got == {("k2", "missing manifest"), ("k3", "manifest incomplete"), ("k3", "audio too small"), ("k3", "no duration"), ("k1", "tag without uuid or label")}


def test_waveforms(spark):
    texts = ['{"version": 2, "barDurationMs": 7, "source": "file", "samples": [{"tMs": 5, "avgDb": -30, "peakDb": "-20", "minAmp": -0.5}, {"avgDb": null, "peakDb": "x", "maxAmp": null}]}', "[0, 0.5, 1, 1.5, -2, null]", "junk", None, '{"version": 1}', '{"samples": [{"tMs": "50"}], "source": "other"}', '{"samples": 3}', "[]"]
    rows = [r["w"] for r in spark.createDataFrame(list(enumerate(texts)), "id int, t string").select("id", kits.waveform(F.col("t")).alias("w")).orderBy("id").collect()]
    assert [(w["version"], w["barDurationMs"], w["source"], len(w["samples"])) for w in rows] == [(2, 7, "file", 2), (1, 50, "metering", 6), (3, 50, None, 0), (3, 50, None, 0), (3, 50, None, 0), (3, 50, None, 1), (3, 50, None, 0), (1, 50, "metering", 0)]
    assert [tuple(s) for s in rows[0]["samples"]] == [(5.0, -30.0, -20.0, -0.5, None), (0.0, 0.0, -160.0, None, 0.0)]
    assert [s["avgDb"] for s in rows[1]["samples"]] == [-160.0, -30.0, 0.0, 0.0, -160.0, -160.0] and rows[1]["samples"][2]["tMs"] == 100.0
    assert tuple(rows[5]["samples"][0]) == (50.0, -160.0, -160.0, None, None)
    p = spark.createDataFrame([(0, texts[1])], "id int, waveform_data string")
    assert kits.samples(p).count() == 6


def test_scales_of_series(spark):
    """Ranks by plain lists: peaks above -159 dB, and both amplitudes that aren't next to nothing."""
    rng = random.Random(3)
    for n in (0, 1, 19, 20, 21, 200):
        series = [{"tMs": k * 50, "avgDb": -50, "peakDb": rng.choice([-160, -159, -158.5, rng.uniform(-60, 0)]), "minAmp": -rng.random() / 2, "maxAmp": rng.choice([0, 1e-7, rng.random()])} for k in range(n)]
        w = kits.waveform(F.lit(json.dumps({"samples": series})))["samples"]
        got = spark.range(1).select(levels.playback_range(w).alias("r"), levels.amplitude_scale(w).alias("a")).first()
        heard, amps = sorted(s["peakDb"] for s in series if s["peakDb"] > -159), sorted(a for s in series for a in (abs(s["minAmp"]), abs(s["maxAmp"])) if a > 1e-6)
        p = heard[min(len(heard) - 1, int(len(heard) * 0.95))] if heard else None
        assert got["r"]["minDb"] == pytest.approx(-45 if p is None else min(-45, max(-55, 5 * p))) and got["r"]["maxDb"] == 0
        assert got["a"] == pytest.approx(amps[min(len(amps) - 1, int(len(amps) * 0.95))] / 0.8 if amps else 1.0)


def test_round_trip_of_kits(spark, tmp_path):
    recs = spark.createDataFrame([(1, "f.wav", "My talk", 0, 1000, None, "u1", "h")], schemas.RECORDINGS)
    tags = spark.createDataFrame([(1, 1, 5, "a", "t1", None, None, None, None, None), (2, 1, 2, "b", "t2", 2, 9, "ml_confirmed", "confirmed", None), (3, 1, 1, "c", "t3", 1, 3, "user", "confirmed", None)], schemas.TAGS).withColumn("kit", F.lit("k"))
    m = sinks.manifest_json(recs, F.lit("now"))
    assert json.loads(m.first()["json"])["recordingUuid"] == "u1" and m.first()["kit"].endswith("_My_talk")
    users, machine = sinks.tag_files(tags)
    assert [t["uuid"] for t in json.loads(users.first()["json"])["tags"]] == ["t3", "t1"] and json.loads(machine.first()["json"])["annotations"][0]["endMs"] == 9
    sinks.write_kits(users, str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).first()["kit"] == "k"
    assert json.loads(sinks.batch_manifest(m, F.lit("now")).first()["json"])["schemaVersion"] == 1
    v = spark.createDataFrame([(f"v{k:02d}",) for k in range(11)], "version string")
    assert {r["version"] for r in sinks.versions_to_drop(v).collect()} == {"v00", "v01", "v02"}
    lib = spark.createDataFrame([("a", 1)], "kit string, x int")
    assert sinks.seeded(lib, spark.createDataFrame([("a", 2), ("b", 2)], "kit string, x int")).count() == 2
    assert sinks.tags_filled(lib, spark.createDataFrame([("a", 2), ("b", 2)], "kit string, x int")).count() == 2
    wanted = spark.createDataFrame([(1, "no", "p1"), (2, "no", "nope")], "id int, c1 string, c2 string")
    assert {(r["id"], r["path"]) for r in kits.first_existing(wanted, spark.createDataFrame([("p1",)], "path string"), ["c1", "c2"]).collect()} == {(1, "p1"), (2, None)}


def test_streams(spark, tmp_path):
    from tidemark.operators import merge

    schema = "seq long, uuid string, source string, status string, label string"
    base, inbox = tmp_path / "state", tmp_path / "inbox"
    spark.createDataFrame([("a", "user", "confirmed", "base")], "uuid string, source string, status string, label string").write.parquet(str(base / "version=base"))
    inbox.mkdir()
    apply = lambda old, batch: merge.upserted(old, batch).drop("actions")
    each = stream.idempotent_upsert(str(base), apply)
    for k, rows in enumerate([[(1, "a", "ml", "confirmed", "no"), (2, "b", "ml", "provisional", "one")], [(3, "b", "user", "confirmed", "two"), (4, "c", "ml", "confirmed", "three")]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(inbox))
        stream.into(stream.file_stream(spark, str(inbox), schema, 1), str(tmp_path / "cp"), each, "append").awaitTermination()
        assert (base / f"version={k}").exists()
    got = {r["uuid"]: r["label"] for r in spark.read.parquet(str(base / "version=1")).collect()}
    assert got == {"a": "base", "b": "two", "c": "three"}
    each(spark.createDataFrame([(3, "b", "user", "confirmed", "two"), (4, "c", "ml", "confirmed", "three")], schema), 1)
    assert {r["uuid"]: r["label"] for r in spark.read.parquet(str(base / "version=1")).collect()} == got
    a = spark.createDataFrame([("k1", 1), ("k2", 2)], "kit string, x int")
    assert stream.replaced_samples(a, spark.createDataFrame([("k1", 9)], "kit string, x int"), ["kit"]).count() == 2
