"""Ordered operators against plain loops on random series."""

import random

import pytest

from tidemark.operators import segments


def voice_loop(db, delta=6.0, low=3.0, extend=12, pad=80.0, frame=30.0):
    s = sorted(db)
    at = 0.25 * (len(s) - 1)
    k = int(at)
    floor = s[k] + (s[min(k + 1, len(s) - 1)] - s[k]) * (at - k)
    on = [x >= floor + delta for x in db]
    up = [x >= floor + delta - low for x in db]
    out, end, i = [], 0, 0
    while i < len(db):
        if not on[i]:
            i += 1
            continue
        j = i
        while j < len(db) and on[j]:
            j += 1
        a = i
        while a > max(end, i - extend, 0) and up[a - 1]:
            a -= 1
        b = j
        while b < min(len(db), j + extend) and up[b]:
            b += 1
        out.append((10.0 * a - pad, 10.0 * (b - 1) + frame + pad, min(1.0, max(0.0, (max(db[i:j]) - floor - delta) / 18))))
        end, i = b, j
    return out


def merge_loop(runs, gap):
    out = []
    for s, e, x in runs:
        if out and s - out[-1][1] <= gap:
            out[-1] = (out[-1][0], max(e, out[-1][1]), max(x, out[-1][2]))
        else:
            out.append((s, e, x))
    return out


def series(spark, seed, kits=4):
    rng = random.Random(seed)
    data = {}
    for k in range(kits):
        level, db = -50.0, []
        for _ in range(rng.randint(1, 400)):
            level = max(-60.0, min(-10.0, level + rng.uniform(-7, 7)))
            db.append(round(level, 2))
        data[f"k{k}"] = db
    rows = [(k, i, 10.0 * i, x) for k, db in data.items() for i, x in enumerate(db)]
    return data, spark.createDataFrame(rows, "kit string, frame_idx long, t_ms double, db double").repartition(3)


def close(got, want):
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a == pytest.approx(b)


@pytest.mark.parametrize("seed", [1, 2])
def test_voice_runs_and_regions(spark, seed):
    data, frames = series(spark, seed)
    runs = segments.voice_runs(frames, ["kit"])
    regions = segments.regions(runs, ["kit"])
    for kit, db in data.items():
        want = voice_loop(db)
        close(sorted((r["start_ms"], r["end_ms"], r["score"]) for r in runs.where(runs.kit == kit).collect()), want)
        merged = [(max(0.0, s), e, x) for s, e, x in merge_loop(want, 200) if e - max(0.0, s) >= 300]
        close(sorted((r["start_ms"], r["end_ms"], r["score"]) for r in regions.where(regions.kit == kit).collect()), merged)


def test_legacy_events(spark):
    data, frames = series(spark, 7)
    got = segments.legacy_events(frames, ["kit"], delta_db=4.0)
    for kit, db in data.items():
        s = sorted(db)
        floor = (s[(len(s) - 1) // 2] + s[len(s) // 2]) / 2
        runs, i = [], 0
        while i < len(db):
            if db[i] < floor + 4.0:
                i += 1
                continue
            j = i
            while j < len(db) and db[j] >= floor + 4.0:
                j += 1
            a, b = 10.0 * i, 10.0 * min(j, len(db) - 1)
            if 80 <= b - a <= 2500:
                runs.append((a, b, min(1.0, max(0.0, (max(db[i:j]) - floor - 4.0) / 20))))
            i = j
        close(sorted((r["start_ms"], r["end_ms"], r["score"]) for r in got.where(got.kit == kit).collect()), merge_loop(runs, 120))


def test_gap_merge_edges(spark):
    rows = [("a", 0, 100), ("a", 299, 400), ("a", 600, 700), ("a", 901, 950), ("a", 910, 920), ("b", 0, 1000), ("b", 10, 20), ("b", 1200, 1300)]
    got = sorted((r["kit"], r["s"], r["e"], r["n"]) for r in segments.gap_merge(spark.createDataFrame(rows, "kit string, s long, e long"), ["kit"], "s", "e", 200).collect())
    assert got == [("a", 0, 700, 3), ("a", 901, 950, 2), ("b", 0, 1300, 3)]


def test_windows_and_hops(spark):
    df = spark.createDataFrame([("a", 1, 0.0, 1400.0), ("a", 2, 0.0, 2100.0), ("a", 3, 100.0, 1850.0)], "kit string, region long, start_ms double, end_ms double")
    got = sorted((r["region"], r["start_ms"], r["end_ms"]) for r in segments.sliding_windows(df, ["kit"]).collect())
    assert got == [(1, 0, 1400), (2, 0, 1500), (2, 250, 1750), (2, 500, 2000), (2, 600, 2100), (3, 100, 1600), (3, 350, 1850)]
    assert segments.adaptive_hop(df, ["kit"]).first()["hop_ms"] == 250.0
    assert segments.adaptive_hop(df, ["kit"], most=2).first()["hop_ms"] > 250.0


def test_trim_to_active(spark):
    spans = spark.createDataFrame([("a", 0.0, 2000.0, -20.0), ("a", 3000.0, 3500.0, -20.0), ("a", 4000.0, 4100.0, -20.0), ("a", 5000.0, 5900.0, -20.0)], "kit string, start_ms double, end_ms double, threshold double")
    frames = spark.createDataFrame([("a", 700.0, -10.0), ("a", 1400.0, -10.0), ("a", 100.0, -30.0), ("a", 5400.0, -5.0)], "kit string, t_ms double, db double")
    got = sorted((r["start_ms"], r["end_ms"]) for r in segments.trimmed_to_active(spans, frames, ["kit"], "start_ms").collect())
    assert got == [(660.0, 1450.0), (3000.0, 3500.0), (5195.0, 5615.0)]


def test_densify_and_tail(spark):
    bins = spark.createDataFrame([("a", 0, 1.0), ("a", 150, 2.0), ("b", 50, 3.0)], "k string, bin long, peak double")
    got = sorted(map(tuple, segments.densify(bins, ["k"], 50, {"peak": -160.0}).collect()))
    assert got == [("a", 0, 1.0), ("a", 50, -160.0), ("a", 100, -160.0), ("a", 150, 2.0), ("b", 50, 3.0)]
    tail = segments.visible_window(bins, ["k"], 50, 3, {"peak": -160.0})
    assert tail.where("k = 'a'").count() == 60
