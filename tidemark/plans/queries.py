"""The operators bound to the driver's tables, each with the same result as DuckDB SQL where SQL can express it.

Roles: a session is a user of ``events``, a level its value, a label its type. An event's span lasts 600 s for each unit
of its value; purchases are tags, views are candidates. Times are microseconds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import labels, levels
from tidemark.functions.spans import iou, overlap
from tidemark.operators import checks, cluster, evaluate, intervals, merge, segments, stats, store
from tidemark.streaming import levels as stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

HOUR, DAY = 3_600_000_000, 86_400_000_000
#: Buckets of the interval joins: several times a usual span.
BUCKET = 12 * HOUR
#: Grid of the trim search.
TRIM_STARTS, TRIM_ENDS = [k * HOUR for k in range(0, 5)], [k * HOUR for k in range(0, 6)]
EDGES = [5.0, 10.0, 20.0, 30.0, 40.0, 60.0]

_E = "e AS (SELECT event_id, user_id, event_type, value, epoch_us(ts) AS t, epoch_us(ts) + CAST(floor(value * 600000000) AS BIGINT) AS t_end FROM events)"
_TAGS = "tags AS (SELECT user_id, event_id AS tag_id, t AS ts, t_end AS te, CASE WHEN value < 20 THEN 'ml_confirmed' ELSE 'user' END AS source FROM e WHERE event_type = 'purchase')"
_CANDS = "cands AS (SELECT user_id, event_id AS cand_id, t AS cs, t_end AS ce FROM e WHERE event_type = 'view')"
_PAIRS = """pairs AS (SELECT user_id, tag_id, ts, te, source, cand_id, cs, ce, least(te, ce) - greatest(ts, cs) AS overlap_ms,
  CASE WHEN (te - ts) + (ce - cs) - (least(te, ce) - greatest(ts, cs)) > 0 THEN CAST(least(te, ce) - greatest(ts, cs) AS DOUBLE) / ((te - ts) + (ce - cs) - (least(te, ce) - greatest(ts, cs))) ELSE 0 END AS iou
  FROM tags JOIN cands USING (user_id) WHERE least(te, ce) > greatest(ts, cs))"""
_BEST = """best AS (SELECT *, CASE WHEN te > ts THEN overlap_ms / CAST(te - ts AS DOUBLE) ELSE 0 END AS tag_share, CASE WHEN te > ts THEN CAST(ce - cs AS DOUBLE) / (te - ts) ELSE 0 END AS dur_ratio, ts - cs AS d_start, te - ce AS d_end
  FROM (SELECT *, row_number() OVER (PARTITION BY tag_id ORDER BY iou DESC, cand_id) AS rn, count(*) OVER (PARTITION BY tag_id) AS n_candidates FROM pairs) WHERE rn = 1)"""
_COVERED = """covered AS (SELECT c.user_id, c.cand_id, c.cs, c.ce, count(p.tag_id) AS n_tags, coalesce(max(p.iou), 0) AS best_iou,
  CASE WHEN c.ce > c.cs THEN least(1.0, coalesce(sum(p.overlap_ms), 0) / CAST(c.ce - c.cs AS DOUBLE)) ELSE 0 END AS covered, count(DISTINCT p.source) AS n_sources
  FROM cands c LEFT JOIN pairs p ON c.cand_id = p.cand_id GROUP BY c.user_id, c.cand_id, c.cs, c.ce)"""
_MATCHED = f"WITH {_E}, {_TAGS}, {_CANDS}, {_PAIRS}, {_BEST}"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", t.alias("t"))
    return e.withColumn("t_end", F.col("t") + F.floor(F.col("value") * 600_000_000))


def tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).where("event_type = 'purchase'")
    return e.select("user_id", F.col("event_id").alias("tag_id"), F.col("t").alias("ts"), F.col("t_end").alias("te"), F.when(F.col("value") < 20, "ml_confirmed").otherwise("user").alias("source"))


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).where("event_type = 'view'")
    return e.select("user_id", F.col("event_id").alias("cand_id"), F.col("t").alias("cs"), F.col("t_end").alias("ce"))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.overlap_pairs(tags(spark, sf_dir), candidates(spark, sf_dir), ["user_id"], "ts", "te", "cs", "ce", BUCKET)


def matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = intervals.best_match(pairs(spark, sf_dir), ["user_id", "tag_id"], "ts", "te", "cs", "ce", "cand_id")
    return evaluate.deltas(best, "ts", "te", "cs", "ce")


def covered(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = candidates(spark, sf_dir)
    return intervals.coverage_of(own, pairs(spark, sf_dir), ["user_id", "cand_id", "cs", "ce"], "cs", "ce", "ts", "te", "source")


# The store


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND lower(l_returnflag) LIKE '%r%')")
def tag_search_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = store.search_by_tag(table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem"), "R", "o_orderkey", "l_orderkey", "l_returnflag")
    return found.select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey AS id, o_totalprice AS duration_ms FROM orders ORDER BY duration_ms DESC, id")
def sessions_sorted_longest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.all_recordings(table(spark, sf_dir, "orders").selectExpr("o_orderkey as id", "o_totalprice as duration_ms"), "longest")


@query("SELECT o_orderkey AS id, o_orderpriority AS filename, o_totalprice AS duration_ms FROM orders WHERE o_orderpriority = '1-URGENT' ORDER BY id LIMIT 1")
def lookup_by_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.lookup(table(spark, sf_dir, "orders").selectExpr("o_orderkey as id", "o_orderpriority as filename", "o_totalprice as duration_ms"), "filename", "1-URGENT")


@query(
    "WITH t AS (SELECT l_orderkey, count(*) AS n, count(*) FILTER (WHERE l_returnflag = 'N') AS o FROM lineitem GROUP BY 1) "
    "SELECT CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS month, count(*) AS n_kits, CAST(sum(coalesce(n, 0)) AS BIGINT) AS n_tags, CAST(sum(coalesce(o, 0)) AS BIGINT) AS n_open FROM orders LEFT JOIN t ON o_orderkey = l_orderkey GROUP BY 1, 2"
)
def sessions_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    kits = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("kit"), F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("created_at"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("kit"), F.when(F.col("l_returnflag") == "A", "confirmed").when(F.col("l_returnflag") == "R", "dismissed").alias("status"))
    return store.by_month(kits, "created_at", lines, lines)


@query("SELECT CAST(ts AS DATE) AS day, strftime(CAST(ts AS DATE), '%A, %B %-d, %Y') AS title, count(*) AS n FROM events GROUP BY 1, 2")
def sessions_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).withColumn("ms", F.floor(F.col("t") / 1000))
    return store.by_day(e, "ms")


@query("SELECT count(*) AS n FROM events WHERE ts >= (SELECT date_trunc('day', max(ts)) FROM events)")
def today_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).select(F.floor(F.col("t") / 1000).alias("created_at"))
    now = e.agg(F.max("created_at").alias("now"))
    return store.created_since_midnight(e.crossJoin(F.broadcast(now)), F.col("now")).agg(F.count("*").alias("n"))  # one row


@query("SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z0-9'']+')) AS word FROM documents) GROUP BY word")
def word_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.word_counts(table(spark, sf_dir, "documents"), labels.label_words(F.lit(None).cast("string"), F.col("text")))


@query("WITH w AS (SELECT unnest(regexp_extract_all(lower(text), '[a-z0-9'']+')) AS word FROM documents) SELECT count(DISTINCT word) AS n_different, count(*) AS n_words, (SELECT count(*) FROM documents) AS n_rows FROM w")
def vocabulary_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.vocabulary(table(spark, sf_dir, "documents"), labels.label_words(F.lit(None).cast("string"), F.col("text")))


@query(
    "WITH w AS (SELECT p_type, count(*) AS n FROM part GROUP BY 1) SELECT p_type, n, round(12 + CASE WHEN (SELECT max(n) - min(n) FROM w) > 0 THEN (n - (SELECT min(n) FROM w)) / CAST((SELECT max(n) - min(n) FROM w) AS DOUBLE) * 36 ELSE 18 END, 6) AS size FROM w"
)
def word_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = table(spark, sf_dir, "part").groupBy("p_type").agg(F.count("*").alias("n"))
    return stats.scaled_by_range(counted, "n", "size", 12.0, 48.0).withColumn("size", F.round("size", 6))


@query("SELECT p_partkey, p_name, p_brand, p_type FROM part WHERE contains(lower(concat_ws(' ', nullif(p_name, ''), nullif(p_brand, ''), nullif(p_type, ''))), 'an') ORDER BY p_partkey LIMIT 80")
def search_text_any_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.search_text(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type"), ["p_name", "p_brand", "p_type"], "an", ["p_partkey"], 80)


@query("SELECT event_id, user_id FROM (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r <= 8")
def newest_eight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.latest(events(spark, sf_dir).select("event_id", "user_id"), ["user_id"], "event_id", 8)


@query("SELECT l_orderkey AS kit, count(*) AS n_tags, round(count(*) / (max(o_totalprice) / 60000), 6) AS per_minute FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1")
def tag_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    kits = table(spark, sf_dir, "orders").selectExpr("o_orderkey as kit", "o_totalprice as durationMs")
    lines = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey as kit")
    return checks.tag_density(kits, lines).where("n_tags > 0").withColumn("per_minute", F.round("per_minute", 6))


# Levels


_BINS = f"bins AS (SELECT user_id, CAST(floor(t / {HOUR}.0 + 0.5) AS BIGINT) * {HOUR} AS bin, max(value) AS peak, min(value) AS trough FROM e GROUP BY 1, 2)"


@query(f"WITH {_E}, {_BINS} SELECT * FROM bins")
def level_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).withColumns({"peak": F.col("value"), "trough": F.col("value")})
    return segments.level_bins(e, ["user_id"], "t", HOUR, ["peak"], ["trough"])


@query(f"WITH {_E}, {_BINS} SELECT * FROM bins")
def level_bins_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from a file stream that is read to its end."""
    from tidemark.session import scratch

    source = table(spark, sf_dir, "events")
    # a pattern, as the table may be a file or a folder
    raw = stream.file_stream(spark, f"{sf_dir}/[e]vents.parquet", source.schema)
    e = raw.select("user_id", "value", F.col("ts").cast("timestamp").alias("at"))
    # the files' rows are in no order of time, so the watermark stands far back
    bins = stream.binned(e, ["user_id"], "at", "1 hour", "30 minutes", [F.max("value").alias("peak"), F.min("value").alias("trough")], "3650 days")
    place = scratch(spark, "level-bins")
    # each batch's bins beside the others: a bin's last state has its greatest peak and least trough
    stream.into(bins, f"{place}/checkpoint", lambda batch, number: batch.write.mode("overwrite").parquet(f"{place}/out/batch={number}")).awaitTermination()
    out = spark.read.parquet(f"{place}/out").groupBy("user_id", "bin").agg(F.max("peak").alias("peak"), F.min("trough").alias("trough"))
    return out.withColumn("bin", F.unix_micros("bin"))


@query(
    f"WITH {_E}, b AS (SELECT user_id, CAST(floor(t / {DAY}.0 + 0.5) AS BIGINT) * {DAY} AS bin, max(value) AS peak FROM e GROUP BY 1, 2), s AS (SELECT user_id, unnest(generate_series(min(bin), max(bin), {DAY})) AS bin FROM b GROUP BY 1) "
    "SELECT s.user_id, s.bin, coalesce(peak, -160.0) AS peak FROM s LEFT JOIN b ON s.user_id = b.user_id AND s.bin = b.bin"
)
def level_densify(spark: SparkSession, sf_dir: str) -> DataFrame:
    bins = segments.level_bins(events(spark, sf_dir).withColumn("peak", F.col("value")), ["user_id"], "t", DAY, ["peak"])
    return segments.densify(bins, ["user_id"], DAY, {"peak": -160.0})


@query(
    f"WITH {_E}, b AS (SELECT user_id, CAST(floor(t / {HOUR}.0 + 0.5) AS BIGINT) * {HOUR} AS bin, max(value) AS peak FROM e GROUP BY 1, 2), s AS (SELECT user_id, unnest(generate_series(max(bin) - 35 * {HOUR}, max(bin), {HOUR})) AS bin FROM b GROUP BY 1) "
    "SELECT s.user_id, s.bin, coalesce(peak, -160.0) AS peak FROM s LEFT JOIN b ON s.user_id = b.user_id AND s.bin = b.bin"
)
def level_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last 36 bins of each series."""
    bins = segments.level_bins(events(spark, sf_dir).withColumn("peak", F.col("value")), ["user_id"], "t", HOUR, ["peak"])
    return segments.visible_window(bins, ["user_id"], HOUR, 36 * HOUR // 1000, {"peak": -160.0})


@query(f"WITH {_E} SELECT user_id, bucket, min(value) AS lo, max(value) AS hi, count(*) AS n FROM (SELECT user_id, value, CAST(floor((row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) - 1) / 50.0) AS BIGINT) AS bucket FROM e) GROUP BY 1, 2")
def level_downsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.downsample(events(spark, sf_dir), ["user_id"], ["t", "event_id"], "value", 50)


@query(
    "SELECT event_id, round(CASE WHEN value - 150 <= -160 THEN 0.0 ELSE least(1.0, pow(10.0, (value - 150) / 20)) END, 9) AS amplitude, round(CASE WHEN value - 150 > -42 THEN least(1.0, greatest(0.0, (value - 150 + 60) / 60)) ELSE 0.0 END, 9) AS height, round(least(1.0, greatest(0.0, (value - 100) / 18)), 9) AS score FROM events"
)
def level_scales(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = F.col("value") - 150
    return table(spark, sf_dir, "events").select("event_id", F.round(levels.db_to_amplitude(db), 9).alias("amplitude"), F.round(levels.db_to_height(db, F.lit(-60.0), F.lit(0.0)), 9).alias("height"), F.round(levels.score_from_peak(F.col("value"), F.lit(100.0)), 9).alias("score"))


@query("SELECT user_id, round(quantile_cont(value, 0.25), 9) AS p25, round(quantile_cont(value, 0.5), 9) AS median FROM events GROUP BY 1")
def noise_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = [segments.noise_threshold(events(spark, sf_dir), ["user_id"], "value", share, 0.0).groupBy("user_id").agg(F.first("floor").alias(name)) for share, name in ((0.25, "p25"), (0.5, "median"))]
    return both[0].join(both[1], "user_id").select("user_id", F.round("p25", 9).alias("p25"), F.round("median", 9).alias("median"))


@query(
    f"WITH {_E}, f AS (SELECT user_id, quantile_cont(value, 0.25) + 20 AS threshold FROM e GROUP BY 1), a AS (SELECT e.*, value >= threshold AS up, lag(value >= threshold) OVER w AS was FROM e JOIN f USING (user_id) WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)), "
    "r AS (SELECT *, sum(CASE WHEN up AND NOT coalesce(was, false) THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS run FROM a) SELECT user_id, CAST(run AS BIGINT) AS run, count(*) AS n, min(t) AS first, max(t) AS last, max(value) AS peak FROM r WHERE up GROUP BY 1, 2"
)
def threshold_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = segments.noise_threshold(events(spark, sf_dir), ["user_id"], "value", 0.25, 20.0)
    return segments.threshold_runs(e, ["user_id"], ["t", "event_id"], "value", "threshold")


@query(
    f"WITH {_E}, a AS (SELECT *, max(t_end) OVER (PARTITION BY user_id ORDER BY t, t_end, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM e), "
    "g AS (SELECT *, sum(CASE WHEN reach IS NULL OR t - reach > 200000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t, t_end, event_id ROWS UNBOUNDED PRECEDING) AS grp FROM a) "
    'SELECT user_id, CAST(grp AS BIGINT) AS "group", min(t) AS t, max(t_end) AS t_end, count(*) AS n, max(value) AS score FROM g GROUP BY 1, 2'
)
def gap_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.gap_merge(events(spark, sf_dir), ["user_id"], "t", "t_end", 200_000_000, [F.max("value").alias("score")], ["event_id"])


@query(
    f"WITH {_E}, a AS (SELECT *, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY t, event_id) THEN 1 ELSE 0 END AS c FROM e), "
    "r AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS run FROM a) SELECT user_id, CAST(run AS BIGINT) AS run, event_type, count(*) AS n, min(t) AS first, max(t) AS last FROM r GROUP BY 1, 2, 3"
)
def label_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.label_runs(events(spark, sf_dir), ["user_id"], ["t", "event_id"], "event_type")


@query(
    f"WITH {_E}, a AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) <= {HOUR} THEN 0 ELSE 1 END AS c FROM e), r AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS s FROM a) "
    f"SELECT user_id, min(t) AS t, max(t) + {HOUR} AS t_end, count(*) AS n FROM r GROUP BY user_id, s"
)
def inactivity_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("at"))
    grouped = stream.sessions(e, ["user_id"], "at", "1 hour", [F.count("*").alias("n")])
    return grouped.select("user_id", F.unix_micros("session_window.start").alias("t"), F.unix_micros("session_window.end").alias("t_end"), "n")


@query(f"WITH {_E} SELECT event_id, user_id, round((coalesce(lag(value) OVER w, 0) + value + coalesce(lead(value) OVER w, 0)) / 3, 6) AS smooth FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)")
def smoothed_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.smoothed(events(spark, sf_dir), ["user_id"], ["t", "event_id"], "value", "smooth").select("event_id", "user_id", F.round("smooth", 6).alias("smooth"))


@query(
    f"WITH {_E}, a AS (SELECT *, lag(value) OVER w AS p, lead(value) OVER w AS x, least(max(value) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING), max(value) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) - value AS prominence FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)) "
    "SELECT event_id, user_id, round(prominence, 6) AS prominence FROM a WHERE value <= p AND value <= x"
)
def level_valleys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.valleys(events(spark, sf_dir), ["user_id"], ["t", "event_id"], "value").select("event_id", "user_id", F.round("prominence", 6).alias("prominence"))


@query(f"WITH {_E}, a AS (SELECT *, lag(value) OVER w AS p, lead(value) OVER w AS x FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)) SELECT event_id, user_id FROM a WHERE value >= p AND value > x")
def level_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.peaks(events(spark, sf_dir), ["user_id"], ["t", "event_id"], "value").select("event_id", "user_id")


@query(
    f"WITH {_E}, {_CANDS}, w AS (SELECT user_id, cand_id, cs, ce, unnest(CASE WHEN ce - cs <= {2 * HOUR} THEN [0] ELSE generate_series(0, CAST(floor((ce - cs - {2 * HOUR} + 1e-6) / {HOUR}) AS BIGINT)) END) AS k FROM cands), "
    f"f AS (SELECT user_id, cand_id, CAST(cs + k * {HOUR} AS DOUBLE) AS start_ms, CASE WHEN ce - cs <= {2 * HOUR} THEN CAST(ce AS DOUBLE) ELSE CAST(cs + k * {HOUR} + {2 * HOUR} AS DOUBLE) END AS end_ms, ce FROM w), "
    f"t AS (SELECT user_id, cand_id, CAST(max(ce) - {2 * HOUR} AS DOUBLE) AS start_ms, CAST(max(ce) AS DOUBLE) AS end_ms FROM f GROUP BY 1, 2 HAVING max(end_ms) < max(ce)) SELECT user_id, cand_id, start_ms, end_ms FROM f UNION ALL SELECT * FROM t"
)
def sliding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = candidates(spark, sf_dir).withColumnsRenamed({"cs": "start_ms", "ce": "end_ms"})
    return segments.sliding_windows(spans, ["user_id"], float(2 * HOUR), float(HOUR)).drop("window")


@query(f"WITH {_E}, f AS (SELECT user_id, event_type, min(t) AS first FROM e GROUP BY 1, 2) SELECT user_id, event_type, 'SPEAKER_' || lpad(CAST(row_number() OVER (PARTITION BY user_id ORDER BY first, event_type) - 1 AS VARCHAR), 2, '0') AS speaker FROM f")
def first_appearance_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.first_appearance_names(events(spark, sf_dir), ["user_id"], "event_type", "t").select("user_id", "event_type", "speaker").distinct()


# Spans


@query(f"WITH {_E}, {_TAGS}, {_CANDS}, {_PAIRS} SELECT tag_id, cand_id, overlap_ms AS overlap_us, round(iou, 9) AS iou FROM pairs")
def overlap_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    sides = [F.col(c) for c in ("ts", "te", "cs", "ce")]
    return pairs(spark, sf_dir).select("tag_id", "cand_id", overlap(*sides).alias("overlap_us"), F.round(iou(*sides), 9).alias("iou"))


@query(f"{_MATCHED} SELECT user_id, tag_id, cand_id, overlap_ms AS overlap_us, round(iou, 9) AS iou, n_candidates FROM best")
def best_match_iou(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matched(spark, sf_dir).select("user_id", "tag_id", "cand_id", F.col("overlap_ms").alias("overlap_us"), F.round("iou", 9).alias("iou"), "n_candidates")


_NEAR = "EXISTS (SELECT 1 FROM tags WHERE tags.user_id = cands.user_id AND cs - 75000000 < te + 75000000 AND ts - 75000000 < ce + 75000000)"


@query(f"WITH {_E}, {_TAGS}, {_CANDS} SELECT cand_id FROM cands WHERE NOT {_NEAR}")
def overlap_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.overlap_anti(candidates(spark, sf_dir), tags(spark, sf_dir), ["user_id"], "cs", "ce", "ts", "te", 75_000_000, BUCKET).select("cand_id")


@query(f"WITH {_E}, {_TAGS}, {_CANDS} SELECT cand_id FROM cands WHERE {_NEAR}")
def overlap_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.overlap_semi(candidates(spark, sf_dir), tags(spark, sf_dir), ["user_id"], "cs", "ce", "ts", "te", 75_000_000, BUCKET).select("cand_id")


@query(f"WITH {_E}, {_CANDS} SELECT e.event_id, min(cand_id) AS cand_id FROM e JOIN cands ON e.user_id = cands.user_id AND cs <= t AND t <= ce WHERE event_type = 'click' GROUP BY 1")
def owner_of_click(spark: SparkSession, sf_dir: str) -> DataFrame:
    clicks = events(spark, sf_dir).where("event_type = 'click'").select("event_id", "user_id", "t")
    return intervals.owner_of_points(clicks, candidates(spark, sf_dir), ["user_id"], "t", "cs", "ce", "cand_id", 0, BUCKET).select("event_id", "cand_id")


@query(f"WITH {_E}, {_TAGS}, {_CANDS}, {_PAIRS} SELECT tag_id, cand_id, greatest(ts, cs) AS clip_start, least(te, ce) AS clip_end FROM pairs")
def clipped_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.clip(pairs(spark, sf_dir), "ts", "te", "cs", "ce").select("tag_id", "cand_id", "clip_start", "clip_end")


_COVERAGE = "count(*) AS n_tags, count(b.tag_id) AS matched, count(*) FILTER (WHERE b.iou >= 0.5) AS iou50, count(*) FILTER (WHERE b.iou >= 0.7) AS iou70, count(*) FILTER (WHERE b.tag_share >= 0.5) AS contains50, count(*) FILTER (WHERE b.tag_share >= 0.9) AS contains90, count(*) - count(b.tag_id) AS missed, round(100.0 * count(b.tag_id) / count(*), 6) AS matched_pct FROM tags LEFT JOIN best b ON tags.tag_id = b.tag_id"


@query(f"{_MATCHED} SELECT tags.user_id, {_COVERAGE} GROUP BY 1")
def coverage_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.coverage(tags(spark, sf_dir), matched(spark, sf_dir), ["user_id"]).withColumn("matched_pct", F.round("matched_pct", 6))


@query(f"{_MATCHED} SELECT {_COVERAGE}")
def pooled_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.coverage(tags(spark, sf_dir), matched(spark, sf_dir), []).withColumn("matched_pct", F.round("matched_pct", 6))


@query(
    f"{_MATCHED} SELECT user_id, count(*) AS n, count(*) FILTER (WHERE d_start < -600000000) AS late_start, count(*) FILTER (WHERE d_start > 600000000) AS early_start, count(*) FILTER (WHERE d_end > 600000000) AS early_end, count(*) FILTER (WHERE d_end < -600000000) AS late_end, "
    "count(*) FILTER (WHERE dur_ratio >= 2) AS ratio_2, count(*) FILTER (WHERE dur_ratio >= 4) AS ratio_4, count(*) FILTER (WHERE dur_ratio < 0.8) AS ratio_short FROM best GROUP BY 1"
)
def boundary_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.boundaries(matched(spark, sf_dir), ["user_id"], 600_000_000)


@query(f"{_MATCHED} SELECT count(*) AS n, min(d_start) AS min, round(quantile_cont(d_start, 0.1), 3) AS p10, round(quantile_cont(d_start, 0.25), 3) AS p25, round(quantile_cont(d_start, 0.5), 3) AS median, round(quantile_cont(d_start, 0.75), 3) AS p75, round(quantile_cont(d_start, 0.9), 3) AS p90, max(d_start) AS max, round(avg(d_start), 3) AS mean FROM best")
def boundary_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evaluate.boundary_quantiles(matched(spark, sf_dir), [], "d_start")
    return out.withColumns({c: F.round(c, 3) for c in ("p10", "p25", "median", "p75", "p90", "mean")})


@query(f"WITH {_E}, {_TAGS}, {_CANDS}, {_PAIRS}, {_COVERED} SELECT cand_id, n_tags, round(covered, 9) AS covered, round(best_iou, 9) AS best_iou, n_sources FROM covered")
def candidate_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covered(spark, sf_dir).select("cand_id", "n_tags", F.round("covered", 9).alias("covered"), F.round("best_iou", 9).alias("best_iou"), F.coalesce(F.size("speakers"), F.lit(0)).cast("long").alias("n_sources"))


@query(f"WITH {_E}, {_TAGS}, {_CANDS}, {_PAIRS}, {_COVERED} SELECT user_id, count(*) AS n_candidates, count(*) FILTER (WHERE n_tags = 0) AS false_positives FROM covered GROUP BY 1")
def false_positives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.false_positives(covered(spark, sf_dir), ["user_id"]).drop("false_positive_pct")


@query(f"{_MATCHED} SELECT tag_id FROM tags WHERE tag_id NOT IN (SELECT tag_id FROM best)")
def missed_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.misses(tags(spark, sf_dir), matched(spark, sf_dir), ["tag_id"]).select("tag_id")


@query(
    f"{_MATCHED}, {_COVERED} SELECT (SELECT count(*) FROM best WHERE n_candidates > 1) AS split_tags, (SELECT max(n_candidates) FROM best) AS most_candidates, count(*) FILTER (WHERE n_tags > 1) AS joined_candidates, max(n_tags) AS most_tags, count(*) FILTER (WHERE n_sources > 1) AS many_speakers FROM covered"
)
def fragmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.fragmentation(matched(spark, sf_dir), covered(spark, sf_dir), [])


@query(f"{_MATCHED} SELECT CASE WHEN tags.source = 'ml_confirmed' THEN 'mlConfirmed' ELSE 'manual' END AS kind, count(*) AS n_tags, count(b.tag_id) AS n_matched, count(*) FILTER (WHERE b.iou >= 0.5) AS iou50, count(*) FILTER (WHERE b.tag_share >= 0.9) AS contains90 FROM tags LEFT JOIN best b ON tags.tag_id = b.tag_id GROUP BY 1")
def by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.by_source(tags(spark, sf_dir), matched(spark, sf_dir), [])


_GRID = (
    f"{_MATCHED}, g AS (SELECT a.k * {HOUR} AS trim_start, b.k * {HOUR} AS trim_end FROM (SELECT unnest(range({len(TRIM_STARTS)})) AS k) a, (SELECT unnest(range({len(TRIM_ENDS)})) AS k) b), "
    "m AS (SELECT ts, te, cs + trim_start AS s, ce - trim_end AS x, trim_start, trim_end FROM best, g), i AS (SELECT *, greatest(0, least(te, x) - greatest(ts, s)) AS o FROM m), "
    "r AS (SELECT trim_start, trim_end, CASE WHEN x > s AND (te - ts) + (x - s) - o > 0 THEN CAST(o AS DOUBLE) / ((te - ts) + (x - s) - o) ELSE 0 END AS iou FROM i), "
    "grid AS (SELECT trim_start, trim_end, quantile_cont(iou, 0.5) AS median_iou, count(*) FILTER (WHERE iou >= 0.5) AS iou50, count(*) AS n FROM r GROUP BY 1, 2)"
)


@query(f"{_GRID} SELECT trim_start, trim_end, round(median_iou, 9) AS median_iou, iou50, n FROM grid")
def trim_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.trim_grid(matched(spark, sf_dir), "ts", "te", "cs", "ce", TRIM_STARTS, TRIM_ENDS).withColumn("median_iou", F.round("median_iou", 9))


@query(f"{_GRID} SELECT trim_start, trim_end, round(median_iou, 9) AS median_iou, iou50 FROM grid ORDER BY grid.median_iou DESC, trim_start, trim_end LIMIT 1")
def best_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = evaluate.trim_grid(matched(spark, sf_dir), "ts", "te", "cs", "ce", TRIM_STARTS, TRIM_ENDS)
    return evaluate.best_trim(grid).withColumn("median_iou", F.round("median_iou", 9))


# Statistics


@query(
    "SELECT l_returnflag, count(*) AS n, min(l_extendedprice) AS min, round(quantile_cont(l_extendedprice, 0.1), 6) AS p10, round(quantile_cont(l_extendedprice, 0.25), 6) AS p25, round(quantile_cont(l_extendedprice, 0.5), 6) AS median, "
    "round(quantile_cont(l_extendedprice, 0.75), 6) AS p75, round(quantile_cont(l_extendedprice, 0.9), 6) AS p90, max(l_extendedprice) AS max, round(avg(l_extendedprice), 4) AS mean FROM lineitem GROUP BY 1"
)
def quantile_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stats.quantile_summary(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice")
    return out.withColumns({c: F.round(c, 6) for c in ("p10", "p25", "median", "p75", "p90")} | {"mean": F.round("mean", 4)})


@query("SELECT user_id, count(*) AS n, list_sort(list(value))[least(count(*), CAST(floor(count(*) * 0.95) AS BIGINT) + 1)] AS p FROM events GROUP BY 1")
def nearest_rank_p95(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.nearest_rank_by_rows(events(spark, sf_dir), ["user_id"], "value")


@query(
    f"WITH b AS (SELECT unnest(range({len(EDGES) + 1})) AS bucket), c AS (SELECT {' + '.join(f'CAST(l_quantity >= {e} AS INTEGER)' for e in EDGES)} AS bucket, count(*) AS n FROM lineitem GROUP BY 1) "
    f"SELECT CAST(b.bucket AS INTEGER) AS bucket, [NULL, {', '.join(map(str, EDGES))}][b.bucket + 1] AS lo, [{', '.join(map(str, EDGES))}, NULL][b.bucket + 1] AS hi, coalesce(n, 0) AS n FROM b LEFT JOIN c ON b.bucket = c.bucket"
)
def duration_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stats.histogram(table(spark, sf_dir, "lineitem"), "l_quantity", EDGES)
    return out


@query("SELECT coalesce(CAST(quality AS VARCHAR), '(none)') AS quality, count(*) AS n FROM documents LEFT JOIN labels ON documents.doc_id = labels.doc_id GROUP BY 1")
def tally_with_none(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.tally(table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left"), "quality")


@query(
    "WITH s AS (SELECT n_chars, quality = 1 AS pos, rank() OVER (ORDER BY n_chars) + (count(*) OVER (PARTITION BY n_chars) - 1) / 2.0 AS mid FROM documents JOIN labels USING (doc_id)) "
    "SELECT count(*) FILTER (WHERE pos) AS n_pos, count(*) FILTER (WHERE NOT pos) AS n_neg, round((sum(mid) FILTER (WHERE pos) - count(*) FILTER (WHERE pos) * (count(*) FILTER (WHERE pos) + 1) / 2.0) / (count(*) FILTER (WHERE pos) * count(*) FILTER (WHERE NOT pos)), 9) AS auc FROM s"
)
def score_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return stats.auc(both, "n_chars", F.col("quality") == 1).withColumn("auc", F.round("auc", 9))


@query(
    f"WITH {_E}, d AS (SELECT event_id, user_id, value, CAST(t % {DAY} AS DOUBLE) AS clock FROM e), s AS (SELECT user_id, count(*) AS n, avg(value) AS mv, stddev_pop(value) AS sv, avg(clock) AS mc, stddev_pop(clock) AS sc FROM d GROUP BY 1) "
    "SELECT event_id, CASE WHEN n >= 5 THEN round((CASE WHEN sv < 1e-9 THEN 0 ELSE (value - mv) / sv END + CASE WHEN sc < 1e-9 THEN 0 ELSE (clock - mc) / sc END) / 2, 6) END AS z FROM d JOIN s USING (user_id)"
)
def zscore_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).withColumn("clock", (F.col("t") % DAY).cast("double"))
    return stats.zscores(e, ["user_id"], ["value", "clock"]).select("event_id", F.round("z", 6).alias("z"))


@query("SELECT CAST(ts AS DATE) AS day, event_type AS word, count(*) AS n FROM events GROUP BY 1, 2")
def word_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return stats.word_timeline(e, F.array("event_type"), F.to_date("ts"))


# Merging


_BASE = "base AS (SELECT o_orderkey AS uuid, CASE WHEN o_orderpriority LIKE '1%' THEN 'user' ELSE 'ml' END AS source, CASE WHEN o_orderstatus = 'F' THEN 'confirmed' ELSE 'provisional' END AS status, o_totalprice AS value FROM orders)"


def _base(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("uuid"), F.when(F.col("o_orderpriority").startswith("1"), "user").otherwise("ml").alias("source"), F.when(F.col("o_orderstatus") == "F", "confirmed").otherwise("provisional").alias("status"), F.col("o_totalprice").alias("value"))


@query(
    f"WITH {_BASE}, m AS (SELECT l_orderkey, min(struct_pack(n := l_linenumber, v := l_extendedprice, f := l_returnflag, s := l_linestatus)) AS m FROM lineitem GROUP BY 1), one AS (SELECT l_orderkey, m.f AS f, m.s AS s, m.v AS v FROM m), "
    "inc AS (SELECT l_orderkey AS uuid, CASE f WHEN 'R' THEN 'ml_confirmed' WHEN 'A' THEN 'user' ELSE 'ml' END AS source, CASE s WHEN 'F' THEN 'confirmed' ELSE 'provisional' END AS status, v AS value FROM one), "
    "j AS (SELECT coalesce(b.uuid, i.uuid) AS uuid, b.source AS bs, b.status AS bt, b.value AS bv, i.source AS s, i.status AS t, i.value AS v, CASE WHEN i.uuid IS NULL THEN NULL WHEN b.uuid IS NULL THEN 'inserted' WHEN (b.source = 'user' AND i.source <> 'user') OR (b.status = 'confirmed' AND i.status = 'provisional') THEN 'skipped' ELSE 'updated' END AS action FROM base b FULL JOIN inc i ON b.uuid = i.uuid) "
    "SELECT uuid, CASE WHEN action IN ('inserted', 'updated') THEN s ELSE bs END AS source, CASE WHEN action IN ('inserted', 'updated') THEN t ELSE bt END AS status, CASE WHEN action IN ('inserted', 'updated') THEN v ELSE bv END AS value, action FROM j"
)
def upsert_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    first = lines.groupBy(F.col("l_orderkey").alias("uuid")).agg(F.min(F.struct("l_linenumber", "l_extendedprice", "l_returnflag", "l_linestatus")).alias("l"))
    source = F.when(F.col("l.l_returnflag") == "R", "ml_confirmed").when(F.col("l.l_returnflag") == "A", "user").otherwise("other")
    incoming = first.select("uuid", F.lit(0).alias("seq"), source.alias("source"), F.when(F.col("l.l_linestatus") == "F", "confirmed").otherwise("provisional").alias("status"), F.col("l.l_extendedprice").alias("value"))
    return merge.upserted(_base(spark, sf_dir), incoming).select("uuid", "source", "status", "value", F.get("actions", F.lit(0)).alias("action"))


@query(f"WITH {_BASE} SELECT uuid, source, status FROM base WHERE NOT (source = 'ml' AND status NOT IN ('confirmed', 'dismissed')) UNION ALL SELECT -c_custkey, 'ml', 'provisional' FROM customer")
def replace_provisional(spark: SparkSession, sf_dir: str) -> DataFrame:
    fresh = table(spark, sf_dir, "customer").select((-F.col("c_custkey")).alias("uuid"), F.lit("ml").alias("source"), F.lit("provisional").alias("status"))
    return merge.replaced_provisional(_base(spark, sf_dir).drop("value"), fresh, "ml")


@query("SELECT doc_id AS id, 'documents' AS origin, n_chars FROM documents UNION ALL SELECT item_id, 'benchmark', length(text) FROM benchmark WHERE item_id NOT IN (SELECT doc_id FROM documents)")
def union_dedup_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.lit("documents").alias("origin"), "n_chars")
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.lit("benchmark").alias("origin"), F.length("text").cast("long").alias("n_chars"))
    return merge.prioritized([docs, items], ["id"])


@query("SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) AND NOT EXISTS (SELECT 1 FROM benchmark b WHERE b.text = d.text)")
def missing_kits_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kits = table(spark, sf_dir, "labels").select("doc_id", F.lit(None).cast("string").alias("text")).unionByName(table(spark, sf_dir, "benchmark").select(F.lit(None).cast("long").alias("doc_id"), "text"))
    named = kits.withColumnsRenamed({"doc_id": "kit_id", "text": "kit_text"})
    return merge.missing_kits(docs, named, [("doc_id", "kit_id"), ("text", "kit_text")]).select("doc_id")


@query(
    "WITH h AS (SELECT md5(n_name) AS h, min(n_nationkey) AS id FROM nation GROUP BY 1), u AS (SELECT CAST(n_nationkey AS VARCHAR) AS u, min(n_nationkey) AS id FROM nation GROUP BY 1) "
    "SELECT c_custkey, coalesce(h.id, u.id) AS recording_id FROM customer LEFT JOIN h ON md5(c_mktsegment) = h.h LEFT JOIN u ON CAST(c_nationkey AS VARCHAR) = u.u"
)
def resolve_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    kits = table(spark, sf_dir, "customer").select("c_custkey", F.md5("c_mktsegment").alias("audio_content_hash"), F.col("c_nationkey").cast("string").alias("uuid"))
    recordings = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.md5("n_name").alias("audio_content_hash"), F.col("n_nationkey").cast("string").alias("uuid"))
    return merge.linked(kits, recordings).select("c_custkey", "recording_id")


# Clusters


_CENT = (
    "x AS (SELECT vec_id, label, unnest(range(1, len(embedding) + 1)) AS i, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings), m AS (SELECT label, i, avg(v) AS v FROM x GROUP BY 1, 2), n AS (SELECT label, sqrt(sum(v * v)) + 1e-12 AS n FROM m GROUP BY 1), "
    "c AS (SELECT m.label, i, v / n AS v FROM m JOIN n USING (label)), d AS (SELECT x.vec_id, x.label, 1 - sum(x.v * c.v) AS d FROM x JOIN c ON x.label = c.label AND x.i = c.i GROUP BY 1, 2), "
    "s AS (SELECT a.label, min(dist) AS sep FROM (SELECT a.label, b.label AS o, 1 - sum(a.v * b.v) AS dist FROM c a JOIN c b ON a.i = b.i AND a.label <> b.label GROUP BY 1, 2) a GROUP BY 1), "
    "t AS (SELECT label, count(*) AS size, avg(d) AS mean_distance, stddev_pop(d) AS sd FROM d GROUP BY 1)"
)


@query(f"WITH {_CENT} SELECT t.label, size, round(mean_distance, 6) AS mean_distance, round(greatest(0.0, least(1.0, 1 - mean_distance)), 6) AS tightness, round(greatest(0.0, least(1.0, coalesce(sep, 1.0))), 6) AS separation FROM t LEFT JOIN s ON t.label = s.label")
def cluster_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = cluster.confidence(table(spark, sf_dir, "embeddings"), [], "label", "embedding", "vec_id")
    return rows.select("label", "size", *[F.round(c, 6).alias(c) for c in ("mean_distance", "tightness", "separation")])


@query(f"WITH {_CENT} SELECT vec_id, CASE WHEN size >= 3 THEN d > mean_distance + 1.5 * sd ELSE false END AS outlier FROM d JOIN t USING (label)")
def cluster_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, members = cluster.confidence(table(spark, sf_dir, "embeddings"), [], "label", "embedding", "vec_id")
    return members.select("vec_id", "outlier")


@query()
def cluster_average_linkage(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").withColumnRenamed("label", "kit")
    return cluster.clustered(v, "kit", "vec_id", "embedding", 0.45)


@query(
    "WITH s AS (SELECT o_custkey, coalesce(list(DISTINCT l_suppkey) FILTER (WHERE l_returnflag = 'R'), []) AS a, coalesce(list(DISTINCT l_suppkey) FILTER (WHERE l_returnflag = 'N'), []) AS b FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1) "
    "SELECT o_custkey, round(CASE WHEN len(list_distinct(list_concat(a, b))) = 0 THEN 1.0 ELSE len(list_intersect(a, b)) / CAST(len(list_distinct(list_concat(a, b))) AS DOUBLE) END, 9) AS jaccard FROM s"
)
def jaccard_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    sets = lines.groupBy("o_custkey").agg(*[F.collect_set(F.when(F.col("l_returnflag") == f, F.col("l_suppkey"))).alias(n) for f, n in (("R", "a"), ("N", "b"))])
    return sets.select("o_custkey", F.round(labels.jaccard(F.col("a"), F.col("b")), 9).alias("jaccard"))


# Quality and labels


@query(
    "SELECT doc_id, unnest(list_filter([CASE WHEN text IS NULL OR text = '' THEN 'empty' END, CASE WHEN length(text) <> n_chars THEN 'wrong length' END, CASE WHEN lang IS NULL OR lang NOT IN ('en', 'fr') THEN 'other language' END, CASE WHEN source IS NULL OR source = 'src0' THEN 'hot source' END], lambda r: r IS NOT NULL)) AS rule FROM documents"
)
def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = {
        "empty": F.col("text").isNull() | (F.col("text") == ""), "wrong length": F.length("text") != F.col("n_chars"), "other language": F.col("lang").isNull() | ~F.col("lang").isin("en", "fr"),
        "hot source": F.col("source").isNull() | (F.col("source") == "src0"),
    }
    return checks.violations(table(spark, sf_dir, "documents"), "doc_id", rules)


@query("SELECT p_partkey, CASE WHEN l = '' THEN 'untitled' ELSE l END AS label FROM (SELECT p_partkey, concat_ws(' · ', nullif(trim(p_brand), ''), nullif(trim(p_type), ''), CASE WHEN p_size > 25 THEN 'English' END, nullif(trim(p_name), '')) AS l FROM part)")
def composed_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = labels.compose_label(F.col("p_brand"), F.col("p_type"), F.when(F.col("p_size") > 25, "English").otherwise(""), F.lit(None).cast("string"), F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", label.alias("label"))


@query(
    r"SELECT o_orderkey, regexp_replace(strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%gZ'), '[:.]', '-', 'g') || '_' || substr(regexp_replace(o_orderpriority, '[^\w\-]+', '_', 'g'), 1, 40) AS kit, strftime(o_orderdate, '%y_%m_%d__%H:%M:%S') AS stamp, strftime(o_orderdate, '%Y-%m-%d_%H%M') AS backup FROM orders"
)
def kit_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").withColumn("ms", F.unix_millis(F.col("o_orderdate").cast("timestamp")))
    return o.select("o_orderkey", labels.kit_folder(F.col("ms"), F.col("o_orderpriority")).alias("kit"), labels.session_stamp(F.col("ms")).alias("stamp"), labels.backup_folder(F.col("ms")).alias("backup"))


from tidemark.plans import entries as _entries  # noqa: E402,F401  registers its queries, too
