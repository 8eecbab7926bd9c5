"""The cluster driver and the edits of clusters, on vectors with known groups."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import cluster, diarize, evaluate, intervals, stats
from tidemark.plans.candidates import judged

CLUSTERS = "kit string, cluster_id string, word string, phonetic string, language string, category string, note string, concept_ids array<string>, curated boolean"
MEMBERS = "kit string, cluster_id string, member_id string, ref_type string, start_ms long, end_ms long, speaker string, source string"


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((3, 16)) * 3
    return {f"m{k:02d}": (centres[k % 3] + rng.standard_normal(16) * 0.3).tolist() for k in range(18)}


def test_driver_keeps_labelled_clusters(spark, vectors):
    clusters = spark.createDataFrame([("k", "locked", "mama", None, None, None, None, [], True), ("k", "loose", None, None, None, None, None, [], False)], CLUSTERS)
    rows = [("k", "locked" if m in ("m00", "m01") else "loose", m, "tag", 0, 500, None, "user") for m in sorted(vectors)]
    members = spark.createDataFrame(rows, MEMBERS)
    spans = members.drop("cluster_id")
    embeddings = spark.createDataFrame([("k", m, v) for m, v in vectors.items()], "kit string, member_id string, embedding array<double>")
    heads, out = cluster.driven(clusters, members, spans, embeddings)
    groups = {}
    for r in out.collect():
        groups.setdefault(r["cluster_id"], set()).add(r["member_id"])
    want = {frozenset(m for m in vectors if int(m[1:]) % 3 == g and m not in ("m00", "m01")) for g in range(3)}
    assert groups.pop("locked") == {"m00", "m01"} and {frozenset(g) for g in groups.values()} == want
    figures = {r["cluster_id"]: r for r in heads.collect()}
    assert set(figures) == {"locked", *groups} and figures["locked"]["word"] == "mama" and figures["locked"]["tightness"] < min(figures[g]["tightness"] for g in groups)
    again_heads, again = cluster.driven(clusters, members, spans, embeddings, singletons=False)
    assert {r["member_id"] for r in again.collect()} == set(vectors)
    for cid, ids in groups.items():  # separation and tightness by hand
        unit = {m: np.array(v) / np.linalg.norm(v) for m, v in vectors.items()}
        cents = {c: (lambda x: x / np.linalg.norm(x))(np.mean([unit[m] for m in g], axis=0)) for c, g in {**groups, "locked": {"m00", "m01"}}.items()}
        d = np.array([1 - unit[m] @ cents[cid] for m in ids])
        assert figures[cid]["tightness"] == pytest.approx(1 - d.mean()) and figures[cid]["separation"] == pytest.approx(min(1.0, min(1 - cents[cid] @ cents[o] for o in cents if o != cid)))


def test_a_symmetric_pair_has_one_outlier(spark):
    rows = [("k", "c", "a", [1.0, 0.0]), ("k", "c", "b", [-0.9, 0.5]), ("k", "d", "x", [2.0, 0.0]), ("k", "d", "y", [0.0, 2.0]), ("k", "d2", "z", [1.0, 1.0])]
    df = spark.createDataFrame(rows, "kit string, cluster_id string, member_id string, embedding array<double>")
    got = {r["member_id"]: r["outlier"] for r in cluster.confidence(df, ["kit"], "cluster_id", "embedding")[1].collect()}
    assert got["a"] + got["b"] == 1 and not got["z"] and not got["x"] and not got["y"]
    exact = spark.createDataFrame([("k", "c", "p", [1.0, 0.0]), ("k", "c", "q", [-1.0, 0.0])], df.schema)
    assert {r["member_id"]: r["outlier"] for r in cluster.confidence(exact, ["kit"], "cluster_id", "embedding")[1].collect()} == {"p": True, "q": False}


def test_nearest_window_by_all_pairs(spark):
    rng = random.Random(4)
    points = [("k", i, float(rng.randrange(0, 4000))) for i in range(150)]
    windows = [("k", s, s + rng.randrange(1, 120), rng.randrange(3)) for s in (float(rng.randrange(0, 3500)) for _ in range(40))]
    got = intervals.window_votes(spark.createDataFrame(points, "kit string, i int, t_ms double"), spark.createDataFrame(windows, "kit string, start_ms double, end_ms double, label int"), ["kit"], bucket=100.0)
    rows = {r["i"]: (r["label"], round(r["confidence"], 9)) for r in got.collect()}
    for _, i, t in points:
        held = {}
        for _, s, e, label in windows:
            if s <= t <= e:
                held[label] = held.get(label, 0) + 1 / (1 + abs(t - (s + e) / 2) / 500)
        if held:
            best = max(held, key=lambda x: (held[x], -x))
            want = best, round(held[best] / sum(held.values()), 9)
        else:
            want = min((abs(t - (s + e) / 2), label) for _, s, e, label in windows)[1], 0.5
        assert rows[i] == want
    assert len(rows) == len(points)


@pytest.mark.parametrize("keys", [[], ["g"]])
def test_exact_ranks(spark, keys):
    """Quantiles, ranks and AUC by plain lists; null groups, ties and single rows among them."""
    rng = random.Random(6)
    rows = [(rng.choice(["a", "b", None]), rng.choice([rng.randint(0, 9), rng.random() * 10, None]), rng.random() < 0.4) for _ in range(3000)] + [("single", 3.5, True)]
    rows = [(g, None if v is None else float(v), p) for g, v, p in rows]
    df = spark.createDataFrame(rows, "g string, v double, p boolean").repartition(7)
    groups = {}
    for g, v, p in rows:
        if v is not None:
            groups.setdefault(g if keys else None, []).append((v, p))
    key = lambda r: r["g"] if keys else None
    for r in stats.quantile_summary(df, keys, "v").collect():
        values = [v for v, _ in groups[key(r)]]
        assert r["n"] == len(values) and [r["p10"], r["median"], r["p90"]] == pytest.approx(np.quantile(values, [0.1, 0.5, 0.9]).tolist())
    for r in stats.nearest_rank_by_rows(df, keys, "v").collect():
        values = sorted(v for v, _ in groups[key(r)])
        assert r["p"] == values[min(len(values) - 1, int(len(values) * 0.95))]
    out = {key(r): r["auc"] for r in stats.auc(df, "v", F.col("p"), keys).collect()}
    for g, pairs in groups.items():
        pos, neg = [v for v, p in pairs if p], [v for v, p in pairs if not p]
        want = sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg)) if pos and neg else None
        assert out[g] == (pytest.approx(want) if want is not None else None)


def test_gate_arms(spark):
    rows = [(s / 100, 0.9, ["x"], "why") for s in (10, 54, 55, 67, 68, 99)]
    df = spark.createDataFrame(rows, "speech_score double, score double, flags array<string>, _reason string")
    got = [(r["score"], r["flags"][-1], r["non_speech_reason"]) for r in judged(df, reject=False).orderBy("speech_score").collect()]
    assert got == [(0.3, "possible_non_speech", "why")] * 2 + [(0.5, "possible_non_speech", "why")] * 2 + [(0.9, "x", None)] * 2
    assert judged(df).count() == 4


def test_backends():
    names = [b["name"] for b in diarize.backend_status()]
    assert names == ["pyannote", "ecapa", "melstats"] and diarize.resolve_backend("melstats") == "melstats" and diarize.resolve_backend("nothing") == "none" and diarize.resolve_backend("auto") in ("ecapa", "melstats")


def test_eligible_spans(spark):
    columns = "kit string, uuid string, start_ms long, end_ms long, t_ms long, speaker string, source string, status string, pos int"
    tags = spark.createDataFrame([("k", "a", 0, 500, 0, " me ", None, None, 0), ("k", "a", 9, 900, 0, None, None, None, 1), ("k", " ", 0, 500, 0, None, None, None, 2), ("k", "s", 500, 100, 0, None, "ml", None, 3), ("k", "t", 0, 119, 0, None, None, None, 4), ("k", "n", None, None, 70, None, None, None, 5)], columns)
    anns = spark.createDataFrame([("k", "a", 7, 700, 0, None, None, None, 0), ("k", "d", 0, 500, 0, None, None, "dismissed", 1), ("k", "m", None, None, 40, None, None, None, 2)], columns)
    got = {r["member_id"]: (r["ref_type"], r["start_ms"], r["end_ms"], r["speaker"], r["source"], r["status"]) for r in cluster.eligible_spans(tags, anns).collect()}
    assert got == {"a": ("tag", 0, 500, "me", "user", None), "s": ("tag", 100, 500, None, "ml", None), "n": ("tag", 0, 300, None, "user", None), "m": ("annotation", 40, 340, None, "vad_v0", "provisional")}


def test_reports_of_nothing(spark):
    none = spark.createDataFrame([], "uuid string, source string, start_ms long, end_ms long")
    marks = spark.createDataFrame([], "uuid string, start_ms long, end_ms long, pos int")
    assert tuple(evaluate.edit_summary(evaluate.confirm_edits(none, marks)).first()) == (0, 0, 0, None, None)
