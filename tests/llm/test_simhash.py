import random
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import simhash
from tidemark.llm.components import components


def slow_fingerprint(text, shingle):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for s in "\t\n\x0b\x0c\r":
        text = text.replace(s, " ")
    words = [w for w in text.split(" ") if w]
    if not words:
        return 0
    parts = [" ".join(words[k : k + shingle]) for k in range(max(1, len(words) - shingle + 1))]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(fps, ids, linked):
    parent = list(range(len(fps)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(fps)):
        for b in range(a):
            if linked(fps[a], fps[b]):
                parent[root(a)] = root(b)
    least = {}
    for k, i in enumerate(ids):
        if i is not None:
            least[root(k)] = min(least.get(root(k), i), i)
    return [(root(k), least.get(root(k))) for k in range(len(fps))]


@pytest.mark.parametrize("shingle,distance", [(4, 4), (2, 11), (4, 0)])
def test_against_brute_force(docs, plain_rows, shingle, distance):
    got = Counter(map(tuple, simhash.near_duplicates(docs, shingle=shingle, max_distance=distance).select("doc_id", simhash.hex_fingerprint(F.col("code")[0]), "component_id").collect()))
    fps = [slow_fingerprint(t, shingle) for _, t in plain_rows]
    ids = [i for i, _ in plain_rows]
    want = slow_components(fps, ids, lambda a, b: (a ^ b).bit_count() <= distance)
    assert got == Counter((i, f"{f:016x}", c) for i, f, (_, c) in zip(ids, fps, want))


def signed(v):
    return v - (1 << 64) if v >> 63 else v


@pytest.mark.parametrize("distance,segments", [(4, 3), (4, 2), (7, 4), (2, 3), (0, 2)])
def test_lookups_are_complete_and_single(spark, distance, segments):
    """All pairs of different parts within the distance, each once; with a part so large that it is looked up apart."""
    rng = random.Random(distance)
    values = {rng.getrandbits(64) for _ in range(60)}
    for v in list(values):
        for _ in range(4):
            values.add(v ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, distance + 2))))
    centre = rng.getrandbits(64)
    hot = {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))) for _ in range(80)}
    rows = [(k, [signed(v)], (k if v not in hot else -1 - k % 3), v in hot) for k, v in enumerate(sorted(values | hot))]
    df = spark.createDataFrame(rows, "node long, code array<long>, part long, large boolean")
    got, lookups = [], simhash.Lookups(simhash.segment_plan(distance, segments), 1, distance)
    for part in lookups.rounds():
        got += [frozenset(r) for r in lookups.across(df, part).select("a", "b").collect()]
    want = {frozenset((a, b)) for a, (x,), p, _ in rows for b, (y,), q, _ in rows if a < b and p != q and ((x ^ y) & (1 << 64) - 1).bit_count() <= distance}
    assert len(got) == len(set(got)) and set(got) == want


def test_plans():
    """Narrow segments for few values, wide ones for many; a likely plan keeps what it promises."""
    few, many = simhash.complete_plan(1000, 4), simhash.complete_plan(10**9, 4)
    assert min(s.width for s in few) < min(s.width for s in many)
    widths = set()
    for n, count in ((10**3, 12), (10**6, 12), (10**9, 64)):
        plan = simhash.likely_plan(n, count, 0.8, 0.03)
        q, w = 1 - simhash.differing(0.8), plan[0].width
        assert (1 - q**w - w * (1 - q) * q ** (w - 1)) ** len(plan) <= 0.03
        covers = Counter()
        for s in plan:
            assert 0 <= s.word < count and s.low + s.width <= 64
            covers.update((s.word, b) for b in range(s.low, s.low + s.width))
        assert max(covers.values()) == 1
        widths.add(w)
    assert len(widths) == 2
    with pytest.raises(ValueError):
        simhash.likely_plan(10**9, 4, 0.8, 0.03)
    rng, q = random.Random(1), simhash.differing(0.8)
    most = simhash.most_differing(12, 0.8, 0.95)
    assert 0.93 < sum(sum(rng.random() < q for _ in range(768)) <= most for _ in range(2000)) / 2000 < 0.97


def test_fingerprints_together():
    """Texts of any length, counted together or alone, and all further fingerprints."""
    rng = random.Random(6)
    texts = [" ".join(str(rng.randrange(50)) for _ in range(n)) for n in (0, 1, 3, 4, 258, 259, 0, 513, 300_000, 7, 2000)]
    for count, repeats in ((1, True), (3, True), (3, False)):
        got = simhash.fingerprints_of([t.encode() for t in texts], 4, count, repeats)
        assert got.shape == (len(texts), count)
        if repeats:
            assert [int(f) & (1 << 64) - 1 for f in got[:, 0]] == [slow_fingerprint(t, 4) for t in texts]
        for t, row in zip(texts, got.tolist()):
            assert simhash.fingerprints_of([t.encode()], 4, count, repeats)[0].tolist() == row
    assert simhash.fingerprints_of([], 4, 2).shape == (0, 2)
    twice, once = (simhash.fingerprints_of([t], 2, 2, False).tolist() for t in (b"a b c a b c a b c d", b"a b c a b c d"))
    assert twice == once


def jaccard_components(rows, least, shingle=5):
    """Brute force over the different texts: components of the pairs with an exact similarity of ``least`` or more."""
    def parts(text):
        words = (text or "").encode().lower().split()
        return frozenset(tuple(words[k : k + shingle]) for k in range(max(1, len(words) - shingle + 1))) if words else frozenset()

    sets = [parts(t) for _, t in rows]
    ids = [i for i, _ in rows]
    index = {}
    for k, s in enumerate(sets):
        for x in s:
            index.setdefault(x, []).append(k)
    def near(a, b):
        both = len(sets[a] & sets[b])
        return sets[a] == sets[b] or both >= least * (len(sets[a]) + len(sets[b]) - both)

    pairs = {(a, b) for rows_of in index.values() if len(rows_of) > 1 for a in rows_of for b in rows_of if b < a}
    empty = [k for k, s in enumerate(sets) if not s]
    pairs |= {(a, b) for a in empty for b in empty if b < a}
    return ids, [(a, b) for a, b in pairs if near(a, b)]


def test_deduplicated_against_exact_jaccard(spark):
    """The whole small table: nothing links below 0.8, and at least 98 % of what brute force removes goes."""
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in table.select("doc_id", "text").collect()]
    kept = {r["doc_id"] for r in simhash.deduplicated(table).select("doc_id").collect()}
    ids, linked = jaccard_components(rows, 0.8)
    parent = list(range(len(ids)))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in linked:
        a, b = root(a), root(b)
        low, high = sorted((a, b), key=lambda k: ids[k])
        parent[high] = low
    want = {ids[k] for k in range(len(ids)) if root(k) == k}
    gone = set(ids) - want
    assert len(gone) > 50 and want <= kept and len(kept - want) <= 0.02 * len(gone)


def test_pairs_about_the_threshold(spark):
    """Of pairs with a five-word-shingle similarity somewhat above 0.8 the second goes, of those below both stay."""
    import corpus_pipeline

    rng = random.Random(8)
    rows, above, below = [], set(), set()
    for k in range(120):
        words = [f"w{rng.randrange(10**6)}" for _ in range(400)]
        parts = {tuple(words[i : i + 5]) for i in range(396)}
        changed = list(words)
        goal = 0.815 if k % 2 else 0.77
        while True:
            changed[rng.randrange(400)] = f"x{rng.randrange(10**6)}"
            other = {tuple(changed[i : i + 5]) for i in range(396)}
            if (alike := len(parts & other) / len(parts | other)) < goal + 0.015:
                break
        (above if alike >= 0.8 else below).add(2 * k + 1)
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(changed))]
    kept = {r["doc_id"] for r in simhash.deduplicated(spark.createDataFrame(rows, "doc_id long, text string"), **corpus_pipeline.NEAR).collect()}
    assert len(above) > 40 and len(below) > 40 and kept >= set(range(0, 240, 2))
    assert len(above & kept) <= 0.1 * len(above) and len(below - kept) <= 0.02 * len(below)


def test_deduplicated_keeps_least_id(docs, plain_rows):
    kept = simhash.deduplicated(docs)
    assert kept.schema.simpleString() == docs.schema.simpleString()
    got = sorted(((r["doc_id"], r["text"]) for r in kept.select("doc_id", "text").collect()), key=str)
    ids, linked = jaccard_components(plain_rows, 0.8)
    component = slow_components(list(range(len(ids))), ids, lambda a, b: (a, b) in pairs) if (pairs := set(linked)) else []
    assert Counter(i for i, _ in got) == Counter(c for _, c in set(component))


def test_empty(docs):
    assert simhash.near_duplicates(docs.limit(0)).collect() == []
    assert simhash.deduplicated(docs.limit(0)).collect() == []


def test_components(spark):
    rng = random.Random(1)
    for n, m in ((40, 30), (200, 150), (60, 0)):
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]
        if n == 200:
            edges += [(k, k + 1) for k in range(300, 400)] + [(500, k) for k in range(501, 560)] + [(None, 3), (4, None)]
        got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
        parent = {}

        def root(x):
            parent.setdefault(x, x)
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in edges:
            if a is not None and b is not None and a != b:
                a, b = root(a), root(b)
                parent[max(a, b)] = min(a, b)
        assert got == {x: root(x) for x in parent}


def test_saved_tables_and_settings(spark):
    """Tables that are replaced go at once, and the session's settings are as they were; a cluster needs a shared folder."""
    import os
    from types import SimpleNamespace

    from tidemark.llm import common

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    own = spark.conf.get(key)
    first = common.saved(spark.range(10), "first")
    path = common._folders[first].removeprefix("file://")
    second = common.saved(first.where("id > 3"), "second", instead_of=[first])
    assert not os.path.exists(path) and second.count() == 6 and spark.conf.get(key) == own
    cluster = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077"))
    with pytest.raises(ValueError):
        common.shared_folder(cluster)


def test_spread_join(spark):
    """Like a plain join, also where one key has most rows."""
    from tidemark.llm.common import spread_join

    rows = spark.range(5000).selectExpr("id", "if(id % 3 = 0, id % 50, 7) as k")
    keyed = spark.range(40).selectExpr("id as k", "id * 2 as v")
    for how in ("inner", "left"):
        assert sorted(map(str, spread_join(rows, keyed, "k", "id", how).select("id", "k", "v").collect())) == sorted(map(str, rows.join(keyed, "k", how).select("id", "k", "v").collect()))
