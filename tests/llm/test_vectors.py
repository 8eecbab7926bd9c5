import math
import random

import numpy as np
import pytest

from tidemark.llm import vectors


def make(seed, n=220, dim=24):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((n, dim))
    rows = [(k, v.tolist()) for k, v in enumerate(base)]
    for k in range(60):
        rows.append((1000 + k, (base[k % 7] + rng.standard_normal(dim) * rng.uniform(0.05, 0.4)).tolist()))
    rows += [(2000, None), (2001, []), (2002, [0.0] * dim), (2003, [math.nan] * dim), (2004, [math.inf] + [1.0] * (dim - 1)), (2005, [None] + [1.0] * (dim - 1)), (2006, [1.0, 0.0]), (2007, [2.0, 0.0]), (2008, [0.9, 0.1, 0.0])]
    rows += [(3000 + k, base[1].tolist()) for k in range(5)] + [(3, base[3].tolist()), (None, base[1].tolist()), (4000, (base[2] * 7).tolist())]
    random.Random(seed).shuffle(rows)
    return rows


def brute(rows, cosine):
    good = [v is not None and len(v) > 0 and all(c is not None and math.isfinite(c) for c in v) and any(v) for _, v in rows]
    x = [np.array(v, np.float32).astype(float) if g else None for (_, v), g in zip(rows, good)]
    n = len(rows)
    links, parent = [0] * n, list(range(n))

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in range(n):
        for b in range(a):
            if good[a] and good[b] and len(x[a]) == len(x[b]) and x[a] @ x[b] / (np.linalg.norm(x[a]) * np.linalg.norm(x[b])) >= cosine:
                links[a] += 1
                links[b] += 1
                parent[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[root(k)] = min(least.get(root(k), i), i)
    return sorted(((i, links[k], least.get(root(k), i), i == least.get(root(k), i)) for k, (i, _) in enumerate(rows)), key=str)


@pytest.mark.parametrize("seed,cosine,block_dims,chunk", [(1, 0.9, 16, 16_384), (2, 0.9, 4, 50), (3, 0.7, 8, 30), (4, 0.97, 24, 64)])
def test_against_brute_force(spark, monkeypatch, seed, cosine, block_dims, chunk):
    monkeypatch.setattr(vectors, "CHUNK_ROWS", chunk)
    rows = make(seed)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as label", "'x' as node", "2 as `a.b`").repartition(3)
    got = sorted((tuple(r) for r in vectors.near_duplicates(df, cosine=cosine, block_dims=block_dims).select("vec_id", "n_links", "component_id", "kept").collect()), key=str)
    assert got == brute(rows, cosine)


def test_a_large_tight_group(spark):
    rng = np.random.default_rng(5)
    centre = rng.standard_normal(32)
    rows = [(k, (centre + rng.standard_normal(32) * 0.02).tolist()) for k in range(1500)]
    got = vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert {(r["n_links"], r["component_id"]) for r in got} == {(1499, 0)} and sum(r["kept"] for r in got) == 1


def test_empty(spark):
    assert vectors.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []
    one = vectors.near_duplicates(spark.createDataFrame([(5, None)], "vec_id long, embedding array<float>")).collect()
    assert [tuple(r) for r in one] == [(5, 0, 5, True)]
