"""Ordered operations on time series and spans: runs, gap merging, bins, regular grids, downsampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.levels import bin_of, score_from_peak


#: A stretch of time that frames and spans are dealt to before they are joined.
STRETCH_MS = 60_000.0


def islands(df: DataFrame, keys: list[str], order: list[str], starts: Column, out: str) -> DataFrame:
    """``df`` with the number of the island each row is in; ``starts`` says which rows begin one."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(out, F.sum(F.when(starts, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def threshold_runs(frames: DataFrame, keys: list[str], order: list[str], value: str, threshold: str) -> DataFrame:
    """Runs of consecutive rows at or above their threshold: keys, ``run``, ``n``, the first and last ``order[0]`` and the
    peak."""
    w = Window.partitionBy(*keys).orderBy(*order)
    active = frames.withColumn("_on", F.col(value) >= F.col(threshold))
    begins = F.col("_on") & ~F.coalesce(F.lag("_on").over(w), F.lit(False))
    numbered = islands(active.withColumn("_begins", begins), keys, order, F.col("_begins"), "run").where("_on")
    return numbered.groupBy(*keys, "run").agg(F.count("*").alias("n"), F.min(order[0]).alias("first"), F.max(order[0]).alias("last"), F.max(value).alias("peak"))


def noise_threshold(frames: DataFrame, keys: list[str], value: str, share: float, delta: float) -> DataFrame:
    """``frames`` with ``floor`` (an exact percentile of each key's values) and ``threshold``."""
    floors = percentile(frames, keys, value, share, "floor")
    return frames.join(floors, keys).withColumn("threshold", F.col("floor") + delta)


def percentile(rows: DataFrame, keys: list[str], value: str, share: float, out: str) -> DataFrame:
    """Keys and the exact interpolated percentile of their values, null where all are null.

    Between two values ``lo`` and ``hi`` it is ``fma(lo, 1 - part, hi * part)``, to the last bit what DuckDB's ``quantile_cont``
    gives: rows that lie on a threshold made of it are told apart by that bit. ``F.percentile`` rounds once more."""
    by_value = rows.groupBy(*keys, value).agg(F.count(value).alias("_n"))  # null: none
    w = Window.partitionBy(*keys)
    upto = F.sum("_n").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    at = share * (F.sum("_n").over(w) - 1)
    placed = by_value.withColumns({"_upto": upto, "_at": at})
    ends = [F.min(F.when(F.col("_upto") > place, F.col(value))).cast("double").alias(name) for name, place in (("_lo", F.floor("_at")), ("_hi", F.ceil("_at")))]
    found = placed.groupBy(*keys).agg(*ends, F.first("_at").alias("_at"))
    part = F.col("_at") - F.floor("_at")
    between = F.java_method(F.lit("java.lang.Math"), F.lit("fma"), F.col("_lo"), 1 - part, F.col("_hi") * part).cast("double")
    return found.select(*keys, F.when(part > 0, F.when(F.col("_hi").isNotNull(), between)).otherwise(F.col("_lo")).alias(out))


def voice_runs(frames: DataFrame, keys: list[str], delta_db: float = 6.0, low_delta_db: float = 3.0, extend_frames: int = 12, pad_ms: float = 80.0, frame_ms: float = 30.0) -> DataFrame:
    """Padded runs of loud frames (``frame_idx``, ``t_ms``, ``db``), each edge moved out over the frames next to it that are
    still above a lower threshold, by ``extend_frames`` at most and not into the run before.

    A run begins no earlier than the frame after the one where the run before it ends, its tail included."""
    by = Window.partitionBy(*keys).orderBy("frame_idx")
    f = noise_threshold(frames, keys, "db", 0.25, delta_db)
    f = f.withColumns({"_on": F.col("db") >= F.col("threshold"), "_up": F.col("db") >= F.col("floor") + max(0.0, delta_db - low_delta_db)})
    # of each frame: the last frame before it, and the first after it, that isn't elevated
    f = f.withColumns({
        "_low_before": F.coalesce(F.max(F.when(~F.col("_up"), F.col("frame_idx"))).over(by.rowsBetween(Window.unboundedPreceding, 0)), F.lit(-1)),
        "_low_after": F.min(F.when(~F.col("_up"), F.col("frame_idx"))).over(by.rowsBetween(0, Window.unboundedFollowing)),
        "_begins": F.col("_on") & ~F.coalesce(F.lag("_on").over(by), F.lit(False)),
        "_last": F.max("frame_idx").over(Window.partitionBy(*keys)),
    })
    runs = islands(f, keys, ["frame_idx"], F.col("_begins"), "run").where("_on").groupBy(*keys, "run")
    runs = runs.agg(F.min("frame_idx").alias("_i"), F.max("frame_idx").alias("_j"), F.max("db").alias("peak"), F.first("threshold").alias("threshold"), F.min("_low_before").alias("_b"), F.max(F.coalesce("_low_after", F.col("_last") + 1)).alias("_a"), F.first("_last").alias("_n"))
    order = Window.partitionBy(*keys).orderBy("_i")
    runs = runs.withColumn("_to", F.least(F.col("_a") - 1, F.col("_j") + extend_frames, F.col("_n")))
    runs = runs.withColumn("_from", F.least(F.col("_i"), F.greatest(F.col("_b") + 1, F.col("_i") - extend_frames, F.coalesce(F.lag("_to").over(order) + 1, F.lit(0)))))
    times = frames.select(*keys, "frame_idx", "t_ms")
    first, last = times.withColumnsRenamed({"frame_idx": "_from", "t_ms": "_t0"}), times.withColumnsRenamed({"frame_idx": "_to", "t_ms": "_t1"})
    placed = runs.join(first, [*keys, "_from"]).join(last, [*keys, "_to"])
    return placed.select(*keys, (F.col("_t0") - pad_ms).alias("start_ms"), (F.col("_t1") + frame_ms + pad_ms).alias("end_ms"), score_from_peak(F.col("peak"), F.col("threshold")).alias("score"))


def gap_merge(spans: DataFrame, keys: list[str], start: str, end: str, max_gap: float, aggs: list[Column] | None = None, tie: list[str] | None = None) -> DataFrame:
    """Spans joined while the next starts within ``max_gap`` of the furthest end so far: keys, ``group``, the joint span, ``n``
    and further aggregates."""
    order = [start, end, *(tie or [])]
    w = Window.partitionBy(*keys).orderBy(*order)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    numbered = islands(spans.withColumn("_reach", reach), keys, order, F.col("_reach").isNull() | (F.col(start) - F.col("_reach") > max_gap), "group")
    return numbered.groupBy(*keys, "group").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n"), *(aggs or []))


def regions(runs: DataFrame, keys: list[str], merge_gap_ms: float = 200.0, min_ms: float = 300.0) -> DataFrame:
    """Merged runs, started at 0 at the earliest, without the short ones."""
    merged = gap_merge(runs, keys, "start_ms", "end_ms", merge_gap_ms, [F.max("score").alias("score")])
    out = merged.withColumn("start_ms", F.greatest(F.col("start_ms"), F.lit(0.0))).withColumn("end_ms", F.greatest("start_ms", "end_ms"))
    return out.where(F.col("end_ms") - F.col("start_ms") >= min_ms)


def legacy_events(frames: DataFrame, keys: list[str], delta_db: float = 8.0, min_ms: float = 80.0, max_ms: float = 2500.0, merge_gap_ms: float = 120.0) -> DataFrame:
    """Runs above the median plus ``delta_db``, those of a fitting length only, then merged (so that a merged one may be
    longer). A run ends where the next frame begins."""
    by = Window.partitionBy(*keys).orderBy("frame_idx")
    f = noise_threshold(frames, keys, "db", 0.5, delta_db).withColumn("_next", F.coalesce(F.lead("t_ms").over(by), F.col("t_ms")))
    f = f.withColumn("_on", F.col("db") >= F.col("threshold"))
    f = f.withColumn("_begins", F.col("_on") & ~F.coalesce(F.lag("_on").over(by), F.lit(False)))
    runs = islands(f, keys, ["frame_idx"], F.col("_begins"), "run").where("_on").groupBy(*keys, "run")
    runs = runs.agg(F.min("t_ms").alias("start_ms"), F.max("_next").alias("end_ms"), score_from_peak(F.max("db"), F.first("threshold"), 20.0).alias("score"))
    fit = runs.where((F.col("end_ms") - F.col("start_ms")).between(min_ms, max_ms))
    return gap_merge(fit, keys, "start_ms", "end_ms", merge_gap_ms, [F.max("score").alias("score")])


def label_runs(rows: DataFrame, keys: list[str], order: list[str], label: str) -> DataFrame:
    """Runs of consecutive rows with one label: keys, ``run``, the label, ``n``, and the first and last ``order[0]``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    changed = ~F.col(label).eqNullSafe(F.lag(label).over(w)) | (F.row_number().over(w) == 1)
    numbered = islands(rows.withColumn("_changed", changed), keys, order, F.col("_changed"), "run")
    return numbered.groupBy(*keys, "run", label).agg(F.count("*").alias("n"), F.min(order[0]).alias("first"), F.max(order[0]).alias("last"))


def level_bins(samples: DataFrame, keys: list[str], t: str, width: int, peaks: list[str], troughs: list[str] | None = None) -> DataFrame:
    """Samples by bin, centred on multiples of ``width``: the greatest of each peak column and the least of each trough."""
    aggs = [F.max(c).alias(c) for c in peaks] + [F.min(c).alias(c) for c in troughs or []]
    return samples.withColumn("bin", bin_of(F.col(t), width)).groupBy(*keys, "bin").agg(*aggs)


def densify(bins: DataFrame, keys: list[str], width: int, defaults: dict[str, float], lo: Column | None = None, hi: Column | None = None) -> DataFrame:
    """A row for every bin from each key's first to its last (or from ``lo`` to ``hi``), defaults where there was none."""
    spine = bins.groupBy(*keys).agg(F.min("bin").alias("_lo"), F.max("bin").alias("_hi"))
    bounds = F.sequence(lo if lo is not None else F.col("_lo"), hi if hi is not None else F.col("_hi"), F.lit(width).cast("long"))
    grid = spine.select(*keys, F.explode(bounds).alias("bin"))
    return grid.join(bins, [*keys, "bin"], "left").fillna(defaults)


def visible_window(bins: DataFrame, keys: list[str], width: int, seconds: int, defaults: dict[str, float], now: Column | None = None) -> DataFrame:
    """The last ``seconds`` of each series up to its newest bin (or ``now``), padded to the left."""
    end = now if now is not None else F.col("_hi")
    return densify(bins, keys, width, defaults, end - seconds * 1000 + width, end)


def downsample(rows: DataFrame, keys: list[str], order: list[str], value: str, bucket: int) -> DataFrame:
    """Least and greatest value of each ``bucket`` consecutive rows."""
    w = Window.partitionBy(*keys).orderBy(*order)
    at = F.floor((F.row_number().over(w) - 1) / bucket)
    return rows.withColumn("bucket", at).groupBy(*keys, "bucket").agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.count("*").alias("n"))


def sliding_windows(spans: DataFrame, keys: list[str], window: float = 1500.0, hop: float | str = 250.0) -> DataFrame:
    """Windows over each span, one at its very end if the last hop falls short, or the span itself if it is shorter. ``hop`` is a
    number, or the column that has each span's."""
    s, e = F.col("start_ms"), F.col("end_ms")
    rest = [c for c in spans.columns if c not in ("start_ms", "end_ms", hop)]
    hop = F.col(hop) if isinstance(hop, str) else F.lit(float(hop))
    n = F.floor((e - s - window + 1e-6) / hop).cast("int")
    steps = F.transform(F.sequence(F.lit(0), n), lambda k: F.struct((s + k * hop).cast("double").alias("start_ms"), (s + k * hop + window).cast("double").alias("end_ms")))
    tail = F.when(s + n * hop + window < e - 1e-6, F.array(F.struct(F.greatest(s, e - window).cast("double").alias("start_ms"), e.cast("double").alias("end_ms")))).otherwise(F.array().cast("array<struct<start_ms:double,end_ms:double>>"))
    whole = F.array(F.struct(s.cast("double").alias("start_ms"), e.cast("double").alias("end_ms")))
    all_ = F.when(e - s <= window, whole).otherwise(F.concat(steps, tail))
    return spans.select(*rest, F.posexplode(all_).alias("window", "_w")).select(*rest, "window", "_w.*")


def adaptive_hop(spans: DataFrame, keys: list[str], hop: float = 250.0, most: int = 4000) -> DataFrame:
    """Per key, the hop at which its spans would have ``most`` windows, and ``hop`` where that gives fewer anyway."""
    length = F.sum(F.greatest(F.lit(0.0), F.col("end_ms") - F.col("start_ms")))
    return spans.groupBy(*keys).agg(F.greatest(F.lit(hop), length / most).alias("hop_ms"))


def smoothed(rows: DataFrame, keys: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """Three-tap moving average; beyond the ends stand zeros."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-1, 1)
    return rows.withColumn(out, F.sum(value).over(w) / 3)


def valleys(rows: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Inner local minima with their ``prominence``: the lower of the highest points on both sides, over the value."""
    w = Window.partitionBy(*keys).orderBy(*order)
    prev, nxt = F.lag(value).over(w), F.lead(value).over(w)
    left = F.max(value).over(w.rowsBetween(Window.unboundedPreceding, 0))
    right = F.max(value).over(w.rowsBetween(0, Window.unboundedFollowing))
    out = rows.withColumns({"_p": prev, "_n": nxt, "prominence": F.least(left, right) - F.col(value)})
    return out.where((F.col(value) <= F.col("_p")) & (F.col(value) <= F.col("_n"))).drop("_p", "_n")


def peaks(rows: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Inner local maxima: not below the row before, above the row after."""
    w = Window.partitionBy(*keys).orderBy(*order)
    out = rows.withColumns({"_p": F.lag(value).over(w), "_n": F.lead(value).over(w)})
    return out.where((F.col(value) >= F.col("_p")) & (F.col(value) > F.col("_n"))).drop("_p", "_n")


def first_appearance_names(turns: DataFrame, keys: list[str], cluster: str, start: str = "start_ms", prefix: str = "SPEAKER_") -> DataFrame:
    """``turns`` with a name for each cluster by the order in which clusters are first heard."""
    first = turns.groupBy(*keys, cluster).agg(F.min(start).alias("_first"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("_first", cluster)) - 1
    return turns.join(first.select(*keys, cluster, F.concat(F.lit(prefix), F.lpad(rank.cast("string"), 2, "0")).alias("speaker")), [*keys, cluster])


def trimmed_to_active(spans: DataFrame, frames: DataFrame, keys: list[str], span_key: str, pad_ms: float = 40.0, hop_ms: float = 10.0, min_ms: float = 420.0, stretch_ms: float = STRETCH_MS) -> DataFrame:
    """Spans cut down to their frames at or above ``threshold``, padded within the span. One that gets too short is widened
    about its middle if the span has room for four fifths of ``min_ms``, else dropped; one without such a frame stays
    whole if it is long enough."""
    # frames meet the spans of their stretch of time only; a span is in each stretch that it touches
    stretches = spans.withColumn("_stretch", F.explode(F.sequence(F.floor(F.col("start_ms") / stretch_ms), F.floor(F.greatest("start_ms", "end_ms") / stretch_ms))))
    loud = frames.select(*keys, "t_ms", "db", F.floor(F.col("t_ms") / stretch_ms).alias("_stretch"))
    held = stretches.join(loud, [*keys, "_stretch"]).where((F.col("t_ms") >= F.col("start_ms")) & (F.col("t_ms") <= F.col("end_ms")) & (F.col("db") >= F.col("threshold")))
    ends = held.groupBy(*spans.columns).agg(F.min("t_ms").alias("_t0"), F.max("t_ms").alias("_t1"))
    found = spans.join(ends, spans.columns, "left")
    t0, t1 = F.greatest(F.col("start_ms"), F.col("_t0") - pad_ms), F.least(F.col("end_ms"), F.col("_t1") + hop_ms + pad_ms)
    short = t1 - t0 < min_ms
    w0 = F.when(short, F.greatest(F.col("start_ms"), t0 - (min_ms - (t1 - t0)) / 2)).otherwise(t0)
    w1 = F.when(short, F.least(F.col("end_ms"), w0 + min_ms)).otherwise(t1)
    none = F.col("_t0").isNull()
    out = found.withColumns({"_s": F.when(none, F.col("start_ms")).otherwise(w0), "_e": F.when(none, F.col("end_ms")).otherwise(w1)})
    keep = F.when(none, F.col("end_ms") - F.col("start_ms") >= min_ms).otherwise(~short | (F.col("_e") - F.col("_s") >= 0.8 * min_ms))
    rest = [c for c in spans.columns if c not in ("start_ms", "end_ms")]
    return out.where(keep).select(*rest, F.col("_s").alias("start_ms"), F.col("_e").alias("end_ms"))
