"""Exact statistics by group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import materialized

QUANTILES = {"p10": 0.1, "p25": 0.25, "median": 0.5, "p75": 0.75, "p90": 0.9}


def running(df: DataFrame, keys: list[str], value: str, sums: dict[str, Column]) -> DataFrame:
    """``(keys, value)``, each once, with its ``sums`` and, as ``before_`` and the name, the same over all smaller values of its keys.

    Rows are summed up by value first; values are sorted over range partitions, which cut a large group wherever
    they fill, and running sums within a partition are added to those of the group's partitions before it. So no task
    has more than a partition, however few the groups are. Null values are left out."""
    by_value = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    order = [*keys, value]
    placed = materialized(by_value.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()), "running")
    whole = placed.groupBy(*keys, "_part").agg(*[F.sum(n).alias(n) for n in sums])
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = whole.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_part").alias("_p"), *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"_base_{n}") for n in sums])
    inside = Window.partitionBy(*keys, "_part").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    local = placed.select("*", *[F.coalesce(F.sum(n).over(inside), F.lit(0)).alias(f"_local_{n}") for n in sums])
    joined = local.join(bases, (F.col("_part") == F.col("_p")) & _same(keys))
    return joined.select(*order, *sums, *[(F.col(f"_base_{n}") + F.col(f"_local_{n}")).alias(f"before_{n}") for n in sums])


def quantiles(df: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """``n`` and exact interpolated quantiles of each group that has values, by name."""
    ranked = running(df, keys, value, {"n": F.lit(1)})
    total = ranked.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.sum("n").alias("_all"))
    joined = ranked.join(total, _same(keys)) if keys else ranked.crossJoin(F.broadcast(total))  # one row
    ends = []
    for name, share in shares.items():
        at = share * (F.col("_all") - 1)
        for side, place in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            ends.append(F.max(F.when((F.col("before_n") <= place) & (place < F.col("before_n") + F.col("n")), F.col(value))).alias(f"_{side}_{name}"))
    found = joined.groupBy(*keys).agg(F.max("_all").alias("_all"), *ends)
    between = {name: F.col(f"_lo_{name}") + (F.col(f"_hi_{name}") - F.col(f"_lo_{name}")) * (share * (F.col("_all") - 1) - F.floor(share * (F.col("_all") - 1))) for name, share in shares.items()}
    return found.select(*keys, F.coalesce("_all", F.lit(0)).alias("n"), *[c.cast("double").alias(name) for name, c in between.items()])


def quantile_summary(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``n``, ``min``, interpolated quantiles, ``max`` and ``mean`` of each group; groups without values are not there."""
    rows = df.where(F.col(value).isNotNull())
    ends = rows.groupBy(*keys).agg(F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("mean"))
    found = quantiles(rows, keys, value, QUANTILES)
    if not keys:
        joined = found.crossJoin(F.broadcast(ends))  # one row each
    else:
        joined = found.join(ends.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "min", "max", "mean"), _same(keys))
    return joined.select(*keys, "n", "min", *QUANTILES, "max", "mean")


def _same(keys: list[str]) -> Column:
    out = F.lit(True)
    for i, k in enumerate(keys):
        out = out & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return out


def nearest_rank_by_rows(df: DataFrame, keys: list[str], value: str, share: float = 0.95) -> DataFrame:
    """The value of rank floor(n * share) + 1 (n at most) of each group."""
    ranked = running(df, keys, value, {"n": F.lit(1)})
    total = ranked.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.sum("n").alias("_all"))
    joined = ranked.join(total, _same(keys)) if keys else ranked.crossJoin(F.broadcast(total))  # one row
    rank = F.least(F.col("_all"), F.floor(F.col("_all") * F.lit(share)) + 1)
    return joined.where((F.col("before_n") < rank) & (rank <= F.col("before_n") + F.col("n"))).select(*keys, F.col("_all").alias("n"), F.col(value).alias("p"))


def histogram(df: DataFrame, value: str, edges: list[float], keys: list[str] | None = None) -> DataFrame:
    """Rows by half-open bucket with open tails; buckets that have none show zero. The buckets are few, a parameter."""
    spark, keys = df.sparkSession, keys or []
    bounds = list(zip([None, *edges], [*edges, None]))
    bucket = F.lit(0)
    for k, edge in enumerate(edges):
        bucket = F.when(F.col(value) >= edge, k + 1).otherwise(bucket)
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, bucket.alias("bucket")).agg(F.count("*").alias("n"))
    grid = spark.createDataFrame([(k, lo, hi) for k, (lo, hi) in enumerate(bounds)], "bucket int, lo double, hi double")
    if keys:
        grid = df.select(*keys).distinct().withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(len(edges))))).join(F.broadcast(grid), "bucket")
    return grid.join(counts, [*keys, "bucket"], "left").select(*keys, "bucket", "lo", "hi", F.coalesce("n", F.lit(0)).alias("n"))


def tally(df: DataFrame, value: str, keys: list[str] | None = None, position: str | None = None) -> DataFrame:
    """Rows by value, blank and null as ``(none)``. With ``position``, the most frequent first, of equal ones that which is
    seen first, and that place as ``first_seen``."""
    name = F.coalesce(F.nullif(F.col(value).cast("string"), F.lit("")), F.lit("(none)")).alias(value)
    seen = [F.min(position).alias("first_seen")] if position else []
    out = df.groupBy(*(keys or []), name).agg(F.count("*").alias("n"), *seen)
    return out.orderBy(*(keys or []), F.desc("n"), "first_seen") if position else out


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, 100.0 * part / whole).otherwise(F.lit(0.0))


def auc(df: DataFrame, score: str, positive: Column, keys: list[str] | None = None) -> DataFrame:
    """The chance that a positive row outscores a negative one, ties counting half; null if one side is empty."""
    keys = keys or []
    by_score = running(df, keys, score, {"p": F.when(positive, 1).otherwise(0), "q": F.when(positive, 0).otherwise(1)})
    ranked = by_score.withColumn("_wins", F.col("p") * (F.col("before_q") + F.col("q") / 2))
    sums = ranked.groupBy(*keys).agg(F.coalesce(F.sum("p"), F.lit(0)).alias("n_pos"), F.coalesce(F.sum("q"), F.lit(0)).alias("n_neg"), F.sum("_wins").alias("_wins"))
    return sums.select(*keys, "n_pos", "n_neg", F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0), F.col("_wins") / (F.col("n_pos") * F.col("n_neg"))).alias("auc"))


def zscores(df: DataFrame, keys: list[str], values: list[str], least_rows: int = 5) -> DataFrame:
    """``df`` with ``z``, the mean of the values' z-scores within their group (population deviation; 0 where it is tiny);
    null in groups of under ``least_rows``."""
    stats = df.groupBy(*keys).agg(F.count("*").alias("_n"), *[f(v).alias(f"_{name}_{v}") for v in values for name, f in (("m", F.avg), ("s", F.stddev_pop))])
    terms = [F.when(F.col(f"_s_{v}") < 1e-9, F.lit(0.0)).otherwise((F.col(v) - F.col(f"_m_{v}")) / F.col(f"_s_{v}")) for v in values]
    joined = df.join(stats, keys).withColumn("z", F.when(F.col("_n") >= least_rows, sum(terms[1:], terms[0]) / len(values)))
    return joined.drop("_n", *[f"_{name}_{v}" for v in values for name in "ms"])


def scaled_by_range(df: DataFrame, value: str, out: str, lo: float, hi: float) -> DataFrame:
    """``df`` with the value mapped from its range over all rows to ``lo``..``hi``; the middle where all are equal."""
    bounds = df.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    spread = F.col("_hi") - F.col("_lo")
    joined = df.crossJoin(F.broadcast(bounds))  # one row
    return joined.withColumn(out, F.when(spread > 0, lo + (F.col(value) - F.col("_lo")) / spread * (hi - lo)).otherwise(F.lit((lo + hi) / 2))).drop("_lo", "_hi")


def word_counts(df: DataFrame, words: Column) -> DataFrame:
    return df.select(F.explode(words).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def word_list(df: DataFrame, words: Column, limit: int | None = None) -> DataFrame:
    """Words by count, the most frequent first, equal ones in binary order."""
    out = word_counts(df, words).orderBy(F.desc("n"), "word")
    return out.limit(limit) if limit else out


def vocabulary(df: DataFrame, words: Column) -> DataFrame:
    """One row: different words, all words, rows."""
    totals = word_counts(df, words).agg(F.count("*").alias("n_different"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_words"))
    return totals.crossJoin(F.broadcast(df.agg(F.count("*").alias("n_rows"))))  # one row each


def word_timeline(df: DataFrame, words: Column, day: Column) -> DataFrame:
    """Word counts by day; beyond what the service shows."""
    return df.select(day.alias("day"), F.explode(words).alias("word")).groupBy("day", "word").agg(F.count("*").alias("n"))
