import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import cluster, evaluate, intervals, merge, stats, store

ITEM = "uuid string, source string, status string, label string"


def fold(base, incoming):
    state, actions = {r[0]: r[1:] for r in base}, {}
    for _, uuid, source, status, label in sorted(incoming, key=lambda r: r[0]):
        if uuid is None or status == "dismissed":
            continue
        source = source if source in ("user", "ml_confirmed", "ml") else "user" if source is None else "ml"
        status = "provisional" if status == "provisional" else "confirmed"
        old = state.get(uuid)
        if old is None:
            what = "inserted"
        elif old[0] == "user" and source != "user" or old[1] == "confirmed" and status == "provisional":
            what = "skipped"
        else:
            what = "updated"
        actions.setdefault(uuid, []).append(what)
        if what != "skipped":
            state[uuid] = (source, status, label)
    return {u: (*v, actions.get(u, [])) for u, v in state.items()}


def test_upsert_folds_in_order(spark):
    rng = random.Random(1)
    kinds, states = ["user", "ml", "ml_confirmed", None, "vad_v0"], ["confirmed", "provisional", "dismissed", None]
    base = [(f"u{k}", rng.choice(kinds[:3]), rng.choice(states[:2]), f"base {k}") for k in range(20)]
    incoming = [(k, rng.choice([f"u{rng.randrange(30)}", None]) if k % 9 == 0 else f"u{rng.randrange(30)}", rng.choice(kinds), rng.choice(states), f"in {k}") for k in range(120)]
    out = merge.upserted(spark.createDataFrame(base, ITEM), spark.createDataFrame(incoming, "seq long, " + ITEM))
    got = {r["uuid"]: (r["source"], r["status"], r["label"], r["actions"]) for r in out.collect()}
    assert got == fold(base, incoming)
    summary = dict(map(tuple, merge.upsert_summary(out).collect()))
    assert sum(summary.values()) == sum(1 for r in incoming if r[1] is not None and r[3] != "dismissed")


def test_keyed_writes(spark):
    t = spark.createDataFrame([(1, "a", "n1"), (2, "b", None)], "id long, label string, note string")
    assert sorted(map(tuple, merge.updated(t, spark.createDataFrame([(2, "B")], "id long, label string"), "id").collect())) == [(1, "a", "n1"), (2, "B", None)]
    recs = spark.createDataFrame([(1,), (2,)], "id long")
    tags = spark.createDataFrame([(10, 1), (11, 2)], "id long, recording_id long")
    r, g = merge.deleted(recs, tags, recs.where("id = 1"))
    assert [x[0] for x in r.collect()] == [2] and [x["id"] for x in g.collect()] == [11]
    old = spark.createDataFrame([("x", ""), ("y", "u1"), ("y", "u1")], "k string, uuid string").withColumn("timestamp_ms", F.lit(5)).withColumn("start_ms", F.lit(None).cast("long"))
    new = merge.migrated(old, {"source": "string"}, F.concat(F.lit("new-"), "k")).collect()
    assert {(r["uuid"], r["start_ms"], r["source"]) for r in new} == {("new-x", 5, None), ("u1", 5, None)}
    assert [tuple(r) for r in merge.repeated_keys(old.where("uuid <> ''"), "uuid").collect()] == [("u1", 2)]
    tri = spark.createDataFrame([("old", None), ("old", " "), ("old", " new ")], "o string, n string").select(merge.tri_state(F.col("o"), F.col("n")).alias("v"))
    assert [r["v"] for r in tri.collect()] == ["old", None, "new"]
    m = spark.createDataFrame([("a", "first", None), ("b", "keep", None)], "kit string, session_name string, original_session_name string")
    again = merge.renamed(merge.renamed(m, spark.createDataFrame([("a", "2")], "kit string, session_name string")), spark.createDataFrame([("a", "3")], "kit string, session_name string"))
    assert {tuple(r) for r in again.select("kit", "session_name", "original_session_name").collect()} == {("a", "3", "first"), ("b", "keep", None)}


def test_confirm_and_sync(spark):
    cols = "uuid string, label string, start_ms long, end_ms long, source string, status string, language string"
    tags = spark.createDataFrame([("t", "l", 0, 1, "user", "confirmed", "x")], cols)
    anns = spark.createDataFrame([("a", "l2", 5, 9, "vad_v0", "provisional", "x"), ("b", "l3", 6, 8, "vad_v0", None, None)], cols)
    t, a = merge.confirmed(tags, anns, spark.createDataFrame([("a",)], "uuid string"))
    assert {(r["uuid"], r["source"], r["language"]) for r in t.collect()} == {("t", "user", "x"), ("a", "ml_confirmed", None)}
    assert {(r["uuid"], r["status"]) for r in a.collect()} == {("a", "confirmed"), ("b", None)}
    assert {(r["uuid"], r["status"]) for r in merge.dismissed(anns, spark.createDataFrame([("b",)], "uuid string")).collect()} == {("a", "provisional"), ("b", "dismissed")}
    remote = spark.createDataFrame([("same", "h"), ("fill", "h2"), ("new", "h3"), ("nohash", None), ("changed", "h5")], "kit string, audio_content_hash string")
    local = spark.createDataFrame([("same", "h", True), ("fill", "h2", False), ("nohash", "h4", True), ("changed", "h6", True), ("mine", "h7", True)], "kit string, audio_content_hash string, has_tags boolean")
    assert dict((r["kit"], r["action"]) for r in merge.sync_status(remote, local).collect()) == {"same": "skip", "fill": "tags-from-phone", "new": "pull", "nohash": "pull-keep-tags", "changed": "pull-keep-tags", "mine": "local-only"}
    kits = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", None)], "kit string, fingerprint string")
    state = spark.createDataFrame([("a", "1"), ("b", "x"), ("c", None)], "kit string, fingerprint string")
    assert [r["kit"] for r in merge.changed_kits(kits, state).collect()] == ["b"]
    items = spark.createDataFrame([("u", None, None, None, None, None, "old", "untitled"), ("v", None, None, None, "w", None, None, "w")], "uuid string, category string, speaker string, language string, word string, phonetic string, note string, label string")
    change = spark.createDataFrame([("u", "verbal vocalization", " Baby ", "", "hi", "", "n")], "uuid string, category string, speaker string, language string, word string, phonetic string, note string")
    got = {r["uuid"]: (r["label"], r["note"], r["language"]) for r in merge.applied_taxonomy(items, change).collect()}
    assert got == {"u": ("verbal vocalization · Baby · Swiss German dialect · hi", None, "Swiss German dialect"), "v": ("w", None, None)}


def test_intervals_with_and_without_buckets(spark):
    rng = random.Random(3)
    spans = lambda n: [(rng.choice("ab"), k, s := rng.randint(-50, 300), s + rng.choice([0, 1, 5, 40, 150])) for k in range(n)]
    a, b = spans(80), spans(60)
    left, right = spark.createDataFrame(a, "k string, i long, s long, e long"), spark.createDataFrame(b, "k string, j long, x long, y long")
    want = {(p[1], q[1]) for p in a for q in b if p[0] == q[0] and min(p[3], q[3]) > max(p[2], q[2])}
    near = {p[1] for p in a for q in b if p[0] == q[0] and p[2] - 3 < q[3] + 3 and q[2] - 3 < p[3] + 3}
    for bucket in (None, 7, 100):
        got = [(r["i"], r["j"]) for r in intervals.overlap_pairs(left, right, ["k"], "s", "e", "x", "y", bucket).collect()]
        assert len(got) == len(set(got)) and set(got) == want
        assert {r["i"] for r in intervals.overlap_semi(left, right, ["k"], "s", "e", "x", "y", 3, bucket).collect()} == near
        assert {r["i"] for r in intervals.overlap_anti(left, right, ["k"], "s", "e", "x", "y", 3, bucket).collect()} == {p[1] for p in a} - near
    whole = intervals.overlap_pairs(left, right, ["k"], "s", "e", "x", "y", 7, "left")
    assert {r["i"] for r in whole.collect()} == {p[1] for p in a}


def test_edits_and_signature(spark):
    tags = spark.createDataFrame([("u", "ml_confirmed", 10, 20), ("v", "ml_confirmed", 5, 6), ("w", "user", 0, 1)], "uuid string, source string, start_ms long, end_ms long")
    anns = spark.createDataFrame([("u", 0, 1, 1), ("u", 10, 40, 2), ("v", 5, 7, 3)], "uuid string, start_ms long, end_ms long, pos long")
    got = evaluate.edit_summary(evaluate.confirm_edits(tags, anns)).first()
    assert (got["n"], got["n_edited"], got["n_shrunk"], got["d_end"]) == (2, 1, 1, -20.0)
    assert [r["json"] for r in evaluate.report(spark.createDataFrame([(1, 2)], "a long, _b long")).collect()] == ['{"a":1}']


def test_auc_and_histogram_edges(spark):
    make = lambda rows: spark.createDataFrame(rows, "s double, p boolean")
    assert stats.auc(make([(1.0, True), (1.0, False), (0.5, False)]), "s", F.col("p")).first()["auc"] == 0.75
    assert stats.auc(make([(1.0, True)]), "s", F.col("p")).first()["auc"] is None
    got = [tuple(r) for r in stats.histogram(make([(1.0, True), (2.0, True), (5.0, True)]), "s", [1.0, 2.0, 3.0]).orderBy("bucket").collect()]
    assert got == [(0, None, 1.0, 0), (1, 1.0, 2.0, 1), (2, 2.0, 3.0, 1), (3, 3.0, None, 1)]
    assert stats.quantile_summary(make([]), [], "s").first()["n"] == 0


def slow_linkage(x, distance):
    import numpy as np

    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    groups = [[k] for k in range(len(x))]
    while len(groups) > 1:
        d, a, b = min((float(np.mean([1 - u[i] @ u[j] for i in groups[a] for j in groups[b]])), a, b) for a in range(len(groups)) for b in range(a + 1, len(groups)))
        if d >= distance:
            break
        groups[a] += groups.pop(b)
    return {frozenset(g) for g in groups}


@pytest.mark.parametrize("seed", range(6))
def test_average_linkage(seed):
    import numpy as np

    x = np.random.default_rng(seed).standard_normal((25, 4))
    labels = cluster.average_linkage(x, 0.45)
    assert {frozenset(np.flatnonzero(labels == k).tolist()) for k in set(labels.tolist())} == slow_linkage(x, 0.45)
    assert len(set(cluster.average_linkage(x, k=3).tolist())) == 3


def test_cluster_edits(spark):
    labels = ", ".join(f"{c} string" for c in cluster.LABELS)
    heads = spark.createDataFrame([("k", "a", "word", None, None, None, None, ["1"], True), ("k", "b", None, "ph", None, None, None, ["2", "1"], False), ("k", "c", None, None, None, None, None, None, False)], f"kit string, cluster_id string, {labels}, concept_ids array<string>, curated boolean")
    members = spark.createDataFrame([("k", "a", "m1", 1), ("k", "b", "m1", 2), ("k", "b", "m2", 3), ("k", "c", "m3", 4)], "kit string, cluster_id string, member_id string, start_ms long")
    h, m = cluster.merged(heads, members, spark.createDataFrame([("k", "a", "b")], "kit string, keep_id string, gone_id string"))
    assert {(r["cluster_id"], r["word"], r["phonetic"], tuple(r["concept_ids"])) for r in h.collect()} == {("a", "word", "ph", ("1", "2")), ("c", None, None, ())}
    assert {(r["cluster_id"], r["member_id"], r["start_ms"]) for r in m.collect()} == {("a", "m1", 1), ("a", "m2", 3), ("c", "m3", 4)}
    h, m = cluster.regrouped(heads, members, spark.createDataFrame([("k", "m1", "n1"), ("k", "m3", "n2"), ("k", "m4", "n2")], "kit string, member_id string, cluster_id string"))
    assert {(r["cluster_id"], r["member_id"]) for r in m.collect()} == {("a", "m1"), ("b", "m1"), ("b", "m2"), ("n2", "m3"), ("n2", "m4")}
    moved = cluster.added(members, spark.createDataFrame([("k", "c", "m1")], "kit string, cluster_id string, member_id string"))
    assert {(r["cluster_id"], r["member_id"]) for r in moved.collect()} == {("b", "m2"), ("c", "m3"), ("c", "m1")}
    old = spark.createDataFrame([("k", "o1", ["a", "b"]), ("k", "o2", ["c"])], "kit string, cluster_id string, member_ids array<string>")
    new = spark.createDataFrame([("k", "n1", ["a", "b", "c"]), ("k", "n2", ["c"])], "kit string, cluster_id string, member_ids array<string>")
    assert {(r["old_id"], r["new_id"]) for r in cluster.matched_clusters(old, new).collect()} == {("o1", "n1"), ("o2", "n2")}
    changed = cluster.relabelled(heads, spark.createDataFrame([("k", "c", "new")], "kit string, cluster_id string, word string"))
    assert {(r["cluster_id"], r["word"], r["curated"]) for r in changed.collect()} == {("a", "word", True), ("b", None, False), ("c", "new", True)}


def test_store_reads(spark):
    tags = spark.createDataFrame([(1, 5, "Ab_c", None, 9), (2, 5, "x", 3, 9), (3, 6, "ABXC", 1, 1)], "id long, recording_id long, label string, start_ms long, timestamp_ms long")
    recs = spark.createDataFrame([(5, 10, 100), (6, 20, 50)], "id long, created_at long, duration_ms long")
    assert {r["id"] for r in store.search_by_tag(recs, tags, " b_c ").collect()} == {5, 6}
    assert [r["id"] for r in store.tags_of(tags, 5).collect()] == [2, 1]
    assert [r["id"] for r in store.all_recordings(recs, "oldest").collect()] == [5, 6] and [r["id"] for r in store.all_recordings(recs, "shortest").collect()] == [6, 5]
    words = spark.createDataFrame([("oneself", 1), ("my one", 2), ("one", 3)], "label string, pos long")
    assert store.first_with_word(words, "label", "One", "pos").first()["pos"] == 2
    assert store.first_with_word(words, "label", "self", "pos").first()["pos"] == 1
