"""Signal operators on synthetic tones."""

import io
import math
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import diarize, signal
from tidemark.plans.candidates import candidates, speech_regions

RATE = 16_000


def wav(x, rate=RATE):
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes((np.clip(x, -1, 1) * 32767).astype("<i2").tobytes())
    return out.getvalue()


def voice(seconds, pitch, seed=0):
    """A buzz of harmonics with a slow envelope: periodic, with energy in the voice band."""
    t = np.arange(int(seconds * RATE)) / RATE
    x = sum(np.sin(2 * math.pi * pitch * k * t) / (1 + abs(k * pitch - 900) / 600) for k in range(1, 14))
    return 0.15 * x * (0.75 + 0.25 * np.sin(2 * math.pi * 3 * t))


def silence(seconds, seed=1):
    return np.random.default_rng(seed).standard_normal(int(seconds * RATE)) * 1e-4


@pytest.fixture(scope="module")
def audio(spark):
    rng = np.random.default_rng(2)
    talk = np.concatenate([silence(1), voice(1.2, 140), silence(1.5), voice(2.5, 260), silence(0.1), voice(2.5, 130), silence(2), rng.standard_normal(int(0.4 * RATE)) * 0.3, silence(1)])
    rows = [("talk", bytearray(wav(talk))), ("quiet", bytearray(wav(silence(2)))), ("short", bytearray(wav(silence(0.01)))), ("none", bytearray(wav(np.zeros(0))))]
    return spark.createDataFrame(rows, "kit string, content binary")


def test_decoding():
    x = np.sin(np.arange(1000) / 10) * 0.5
    back, rate = signal.decode_wav(wav(x, 8000))
    assert rate == 8000 and np.abs(back - x).max() < 1e-4


def test_level_frames_against_a_loop():
    x = np.random.default_rng(1).standard_normal(5000) * 0.1
    t, db = signal.level_frames(x, RATE)
    want = [20 * math.log10(math.sqrt(np.mean(x[k : k + 480] ** 2)) + 1e-12) for k in range(0, len(x) - 480 + 1, 160)]
    assert np.allclose(db, want) and np.allclose(t, 10.0 * np.arange(len(want)))
    t, db = signal.level_frames(x, RATE, frame_ms=20, legacy_tail=True)
    assert len(t) == len(range(0, max(1, len(x) - 320), 160))
    assert len(signal.level_frames(np.zeros(0), RATE)[0]) == 1 and len(signal.level_frames(np.ones(5), RATE)[0]) == 1


def test_speech_likeness_tells_voice_from_noise():
    good = signal.speech_score(signal.speech_features(voice(1, 180), RATE))
    noise = signal.speech_score(signal.speech_features(np.random.default_rng(3).standard_normal(RATE) * 0.1, RATE))
    rumble = signal.speech_score(signal.speech_features(np.sin(2 * math.pi * 50 * np.arange(RATE) / RATE), RATE))
    assert good > 0.68 > noise and rumble < 0.55
    assert abs(signal.speech_features(voice(1, 180), RATE)["f0"] - 180) < 5
    assert signal.speech_features(np.zeros(3), RATE)["low_band_ratio"] == 1.0


def test_vectors():
    a, b, c = signal.fingerprint(voice(0.8, 150), RATE), signal.fingerprint(voice(0.8, 152) * 0.3, RATE), signal.fingerprint(np.random.default_rng(1).standard_normal(12_800), RATE)
    assert a.shape == (1281,) and abs(np.linalg.norm(a) - 1) < 1e-9 and a @ b > a @ c
    assert signal.mfcc_statistics(voice(0.5, 150), RATE).shape == (57,) and signal.mfcc_statistics(np.zeros(3), RATE).shape == (57,)
    m = signal.mel_filters(RATE, 512, 40)
    assert m.shape == (40, 257) and (m.max(axis=1) > 0).all()


def test_splitting():
    t = np.arange(0, 9000, 10.0)
    db = -20 - 30 * np.exp(-(((t - 3000) / 100) ** 2)) - 20 * np.exp(-(((t - 6000) / 100) ** 2))
    parts = signal.split_span(0, 9000, t, db, 4000, 600, 5.0, 6, True, "pause")
    assert [p[2] for p in parts] == [None, "pause", "pause"] and [round(p[0] / 100) for p in parts] == [0, 30, 60]
    assert signal.split_span(0, 9000, t, db, 4000, 600, 5.0, 0, True, "pause") == [(0, 9000, None)]
    assert signal.split_span(0, 9000, t, np.full(len(t), -20.0), 4000, 600, 5.0, 6, False, "pause") == [(0, 9000, None)]
    x = np.concatenate([voice(0.6, 150), silence(0.35), voice(0.6, 150), silence(0.35), voice(0.6, 150)])
    words = signal.resegmented(x, RATE)
    assert len(words) >= 3 and all(e - s >= 300 for s, e, _ in words) and all(a[1] <= b[0] + 1e-6 for a, b in zip(words, words[1:]))
    assert words[-1][2] == "syllable" and not any(s < 700 < e for s, e, _ in words)
    assert signal.resegmented(x[:8000], RATE) == [(0.0, 500.0, None)]


def test_frames_and_series(spark, audio):
    f = signal.frames(audio)
    assert f.where("kit = 'talk'").count() > 1000 and f.where("kit = 'none'").count() == 1
    s = signal.level_series(audio).where("kit = 'talk'").orderBy("tMs").limit(2).collect()
    assert [r["tMs"] for r in s] == [0.0, 50.0] and all(r["minAmp"] <= 0 <= r["maxAmp"] for r in s)


def test_regions_and_candidates(spark, audio):
    regions = sorted((r["start_ms"], r["end_ms"]) for r in speech_regions(audio).where("kit = 'talk'").collect())
    assert any(s < 1100 and 2000 < e < 2600 for s, e in regions)
    assert not any(s > 10_500 for s, _ in regions)  # the burst of noise
    found = candidates(audio).where("kit = 'talk'").collect()
    assert found and all(r["status"] == "provisional" and r["end_ms"] > r["start_ms"] and 0 <= r["score"] <= 1 for r in found)
    tags = spark.createDataFrame([("talk", 900, 2500, 900)], "kit string, start_ms long, end_ms long, t_ms long")
    assert all(r["start_ms"] > 2500 for r in candidates(audio, tags).where("kit = 'talk'").collect())


def test_diarization(spark, audio):
    regions = spark.createDataFrame([("talk", 1, 3700.0, 6200.0), ("talk", 2, 6300.0, 8800.0)], "kit string, region long, start_ms double, end_ms double")
    turns = diarize.diarized(regions, audio, speakers=2).orderBy("start_ms").collect()
    assert {r["speaker"] for r in turns} == {"SPEAKER_00", "SPEAKER_01"} and turns[0]["speaker"] == "SPEAKER_00"
    assert turns[0]["start_ms"] == 3700.0 and turns[-1]["end_ms"] == 8800.0
    df = spark.createDataFrame([tuple(r) for r in turns], "kit string, region long, start_ms double, end_ms double, speaker string, confidence double")
    pieces = diarize.split_by_speaker(regions.unionByName(spark.createDataFrame([("talk", 3, 9000.0, 9500.0)], regions.schema)), df).collect()
    assert len(pieces) == len(turns) + 1 and sum(r["speaker_cluster"] is None for r in pieces) == 1
    clipped = diarize.clipped_turns(spark.createDataFrame([("talk", 6000.0, 6500.0, "x")], "kit string, start_ms double, end_ms double, speaker string"), regions)
    assert sorted((r["start_ms"], r["end_ms"]) for r in clipped.collect()) == [(6000.0, 6200.0), (6300.0, 6500.0)]


def test_short_turns_join_the_longer_neighbour(spark):
    labels = [0] * 10 + [1] * 3 + [0] * 2 + [1] * 12
    df = spark.createDataFrame([("k", 1, 0.0, 2700.0, k, x, 1.0) for k, x in enumerate(labels)], "kit string, region long, r0 double, r1 double, point int, label long, confidence double")
    got = sorted((r["start_ms"], r["end_ms"], r["label"]) for r in diarize.turns_of_grid(df).collect())
    assert got == [(0.0, 1000.0, 0), (1000.0, 2700.0, 1)]


def test_embeddings_of_spans(spark, audio):
    spans = spark.createDataFrame([("talk", 1000.0, 2200.0), ("talk", 0.0, 10.0), ("quiet", 100.0, 400.0)], "kit string, start_ms double, end_ms double")
    for kind, size in (("fingerprint", 1281), ("mfcc", 57)):
        rows = signal.span_embeddings(spans, audio, kind).select(F.size("embedding").alias("n"), "start_ms").collect()
        assert {r["n"] for r in rows} == {size} and {r["start_ms"] for r in rows} == {1000.0, 0.0, 100.0}
    assert signal.span_mel(spans, audio).select(F.max(F.size("mel")).alias("n")).first()["n"] <= 80


def test_broken_recordings_and_no_backend(spark, audio):
    """What can't be decoded has no candidates and harms no other; without a backend nothing is cut by speaker."""
    both = audio.where("kit in ('talk', 'quiet')").unionByName(spark.createDataFrame([("bad", bytearray(b"RIFF....")), ("empty", bytearray())], "kit string, content binary"))
    assert {r["kit"]: r["n"] for r in signal.frames(both).groupBy("kit").agg(F.count("*").alias("n")).collect() if r["kit"] in ("bad", "empty")} == {"bad": 1, "empty": 1}
    found = candidates(both, backend="none").collect()
    assert {r["kit"] for r in found} == {"talk"} and all(r["speaker_cluster"] is None for r in found)
