import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import urlfilter
from tidemark.llm.queries import RULES

LISTED = ["bad.example.com", "net", "worse.org", "", None, "bad.example.com"]


def brute(url, rules, listed):
    after = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", after).group()
    path = re.match(r"[^?#]*", after[len(host) :]).group()
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fit = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    if fit:
        best = max(fit, key=lambda r: len(r.name))
        return host, path, best.name, best.verdict
    return host, path, None, "block" if any(d and (host == d or host.endswith("." + d)) for d in listed) else "allow"


@pytest.fixture(scope="module")
def urls():
    rng = random.Random(1)
    hosts = ["example.com", "Bad.Example.COM", "x.bad.example.com", "notbad.example.com", "example.net", "a.b.net", "worse.org", "es.org", "com", "", ".", "a..net", "ÄÉ.org", "example.com:80", "u@worse.org"]
    paths = ["", "/", "/en/", "/en/7", "/en/71", "/en", "/de/8", "/de/", "/es/x", "?q=/en/", "#/en/", "/en/\n7"]
    out = [f"{rng.choice(['http', 'HTTPS', ''])}://{rng.choice(hosts)}{rng.choice(paths)}{rng.choice(['', '?a=1', '#t', '://x'])}" for _ in range(800)]
    return out + [None, "", "no scheme", "://", "://://", "http:/x.com/en/", *["http://hot.example.com/en/1"] * 500, "http://long.net/" + "a" * 100_000]


def test_against_brute_force(spark, urls):
    df = spark.createDataFrame([(k, u, "own") for k, u in enumerate(urls)], "page_id long, url string, host string").selectExpr("*", "'x' as judged", "1 as hit", "2 as `a.b`").repartition(4)
    listed = spark.createDataFrame([(d,) for d in LISTED], "key string")
    rows = urlfilter.judge(df, RULES, listed, out_col="verdict_of").collect()
    assert {r["page_id"]: tuple(r["verdict_of"]) for r in rows} == {k: brute(u, RULES, LISTED) for k, u in enumerate(urls)}
    assert len(rows) == len(urls) and all(r["host"] == "own" and r["judged"] == "x" for r in rows)


def test_cascade_is_exact(spark):
    """With small filters, several levels are needed; membership over the universe is exact all the same."""
    universe = spark.range(6000).select(F.concat(F.lit("k"), "id").alias("key"))
    listed = universe.where("cast(substr(key, 2) as int) % 5 = 0").union(spark.createDataFrame([("elsewhere",)], "key string"))
    inside, outside = urlfilter._hashed(listed), urlfilter._hashed(universe)
    found = urlfilter.cascade(inside, outside, bits_per_key=4, hashes=2)
    assert len(found.levels) > 3
    hashed = universe.select("key", *[h.alias(f"h{k}") for k, h in enumerate(urlfilter.key_hashes(F.col("key")), 1)]).toPandas()
    got = found.has(hashed["h1"].to_numpy().view(np.uint64), hashed["h2"].to_numpy().view(np.uint64))
    assert (got == (hashed["key"].str[1:].astype(int) % 5 == 0).to_numpy()).all()
    with pytest.raises(urlfilter.TooLarge):
        urlfilter.cascade(inside, outside, max_bytes=100)


def test_a_million_listed_keys(spark):
    """A list beyond the bound is judged in parts; a third of the hosts are listed, some by a parent domain, and the
    filters let others through, which the next levels tell apart."""
    listed = spark.range(1_000_000).selectExpr("concat('h', id * 3, '.example.com') as key").union(spark.range(50).selectExpr("concat('up', id, '.example.net')"))
    pages = spark.range(200_000).selectExpr("id as page_id", "concat('http://', if(id % 7 = 0, concat('www.up', id % 100, '.example.net'), concat('h', id, '.example.com')), '/x') as url")
    got = urlfilter.judge(pages, [], listed, max_bytes=500_000)
    want = "if(page_id % 7 = 0, page_id % 100 < 50, page_id % 3 = 0)"
    assert got.where(f"(judged.verdict = 'block') <> ({want})").count() == 0 and got.count() == 200_000
    assert got.where(want).count() > 60_000
    universe = pages.select(F.explode(urlfilter.domain_keys(urlfilter.host(F.col("url")))).alias("key"))
    made = list(urlfilter.parts(universe, listed, 500_000))
    assert len(made) >= 4 and sum(2.0**-p.bits for p in made) == 1
    assert all(sum(b.words.nbytes for b in p.cascade.levels) <= 510_000 for p in made) and max(len(p.cascade.levels) for p in made) >= 2


def test_an_input_column_of_the_result_s_name(spark):
    one = spark.createDataFrame([(1, "http://x.org/", "own", "y")], "page_id long, url string, Judged string, _none string")
    (row,) = urlfilter.judge(one, [], spark.createDataFrame([("org",)], "key string")).collect()
    assert row.asDict()["judged"]["verdict"] == "block" and set(row.asDict()) == {"page_id", "url", "_none", "judged"}


def test_empty(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    none = spark.createDataFrame([], "key string")
    assert urlfilter.judge(pages, RULES, none).collect() == []
    one = spark.createDataFrame([(1, "http://x.org/")], "page_id long, url string")
    assert Counter(r["judged"]["verdict"] for r in urlfilter.judge(one, [], none).collect()) == {"allow": 1}
