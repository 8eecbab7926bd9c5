"""Joins of spans. All join on key columns first. With ``bucket``, time is cut into buckets too, so that one
key's many spans are dealt over many tasks: each span goes to the buckets it touches, and a pair is made in
the bucket where its later start lies, hence once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.spans import iou, overlap


def _dealt(df: DataFrame, start: str, end: str, bucket: int | None, margin: float) -> DataFrame:
    if not bucket:
        return df
    first, last = F.floor((F.col(start) - margin) / bucket), F.floor((F.col(end) + margin) / bucket)
    return df.withColumn("_bucket", F.explode(F.sequence(first, last)))


def overlap_pairs(left: DataFrame, right: DataFrame, keys: list[str], ls: str, le: str, rs: str, re: str, bucket: int | None = None, how: str = "inner") -> DataFrame:
    """Pairs of spans with the same keys that share more than a moment. Other column names must differ."""
    if how not in ("inner", "left"):
        raise ValueError("use overlap_semi or overlap_anti")
    on = [*keys, "_bucket"] if bucket else keys
    a, b = _dealt(left, ls, le, bucket, 0).alias("a"), _dealt(right, rs, re, bucket, 0).alias("b")
    meet = (F.col(ls) < F.col(re)) & (F.col(rs) < F.col(le)) & (F.least(le, re) > F.greatest(ls, rs))
    for k in on:
        meet = meet & (F.col(f"a.{k}") == F.col(f"b.{k}"))
    if bucket:
        meet = meet & (F.floor(F.greatest(ls, rs) / bucket) == F.col("a._bucket"))
    own = [F.col(f"a.{c}") for c in left.columns]
    out = a.join(b, meet, "inner").select(*own, *[F.col(f"b.{c}") for c in right.columns if c not in keys])
    return out if how == "inner" else _with_unmatched(left, out, right, keys)


def _with_unmatched(left: DataFrame, pairs: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    rest = left.join(pairs.select(*left.columns).distinct(), left.columns, "left_anti")
    nulls = [F.lit(None).cast(right.schema[c].dataType).alias(c) for c in right.columns if c not in keys]
    return pairs.unionByName(rest.select(*left.columns, *nulls))


def _near(left: DataFrame, right: DataFrame, keys: list[str], ls: str, le: str, rs: str, re: str, margin: float, bucket: int | None, how: str) -> DataFrame:
    a = left.alias("a")
    if bucket:
        # which left spans have a match at all, by bucket; then a join on the rows' own columns
        hit = _dealt(left, ls, le, bucket, margin).alias("a").join(_dealt(right, rs, re, bucket, margin).alias("b"), _meet(keys + ["_bucket"], ls, le, rs, re, margin), "left_semi")
        return left.join(hit.select(*left.columns).distinct(), left.columns, how)
    return a.join(right.alias("b"), _meet(keys, ls, le, rs, re, margin), how)


def _meet(keys: list[str], ls: str, le: str, rs: str, re: str, margin: float) -> Column:
    out = (F.col(f"a.{ls}") - margin < F.col(f"b.{re}") + margin) & (F.col(f"b.{rs}") - margin < F.col(f"a.{le}") + margin)
    for k in keys:
        out = out & (F.col(f"a.{k}") == F.col(f"b.{k}"))
    return out


def overlap_semi(left: DataFrame, right: DataFrame, keys: list[str], ls: str, le: str, rs: str, re: str, margin: float = 0.0, bucket: int | None = None) -> DataFrame:
    """Rows of ``left`` that meet a span of ``right``, both widened by ``margin``."""
    return _near(left, right, keys, ls, le, rs, re, margin, bucket, "left_semi")


def overlap_anti(left: DataFrame, right: DataFrame, keys: list[str], ls: str, le: str, rs: str, re: str, margin: float = 75.0, bucket: int | None = None) -> DataFrame:
    """Rows of ``left`` that meet no span of ``right``, both widened by ``margin``."""
    return _near(left, right, keys, ls, le, rs, re, margin, bucket, "left_anti")


def best_match(pairs: DataFrame, by: list[str], ls: str, le: str, rs: str, re: str, position: str) -> DataFrame:
    """The pair with the greatest overlap ratio for each row of the left side, the first position among equals, with
    ``iou``, ``overlap_ms`` and the number of candidates ``n_candidates``. One pass of partial sums, no sort."""
    ratio = iou(F.col(ls), F.col(le), F.col(rs), F.col(re))
    scored = pairs.withColumns({"iou": ratio, "overlap_ms": overlap(F.col(ls), F.col(le), F.col(rs), F.col(re))})
    rest = [c for c in scored.columns if c not in by]
    best = F.max_by(F.struct(*rest), F.struct(F.col("iou"), (-F.col(position)).alias("first")))
    return scored.groupBy(*by).agg(best.alias("best"), F.count("*").alias("n_candidates")).select(*by, "best.*", "n_candidates")


def owner_of_points(points: DataFrame, spans: DataFrame, keys: list[str], point: str, start: str, end: str, position: str, slack: float = 1e-6, bucket: float | None = None) -> DataFrame:
    """Each point with the first span that holds it; points outside of all spans go."""
    a, b = points, spans
    if bucket:  # a point is in one bucket, a span in each that it touches
        a, b = points.withColumn("_bucket", F.floor(F.col(point) / bucket)), _dealt(spans, start, end, bucket, slack)
    a, b = a.alias("a"), b.alias("b")
    inside = (F.col(f"b.{start}") - slack <= F.col(f"a.{point}")) & (F.col(f"a.{point}") <= F.col(f"b.{end}") + slack)
    for k in [*keys, "_bucket"] if bucket else keys:
        inside = inside & (F.col(f"a.{k}") == F.col(f"b.{k}"))
    held = a.join(b, inside).select(*[F.col(f"a.{c}") for c in points.columns], *[F.col(f"b.{c}") for c in spans.columns if c not in keys])
    first = F.min_by(F.struct(*[c for c in spans.columns if c not in keys]), F.col(position))
    return held.groupBy(*points.columns).agg(first.alias("o")).select(*points.columns, "o.*")


def clip(pairs: DataFrame, ls: str, le: str, rs: str, re: str) -> DataFrame:
    """Pairs with ``clip_start`` and ``clip_end``, the part that both spans have."""
    return pairs.withColumns({"clip_start": F.greatest(ls, rs), "clip_end": F.least(le, re)}).where("clip_end > clip_start")


def coverage_of(candidates: DataFrame, pairs: DataFrame, by: list[str], cs: str, ce: str, ts: str, te: str, speaker: str | None = None) -> DataFrame:
    """For each candidate: how many tags it meets, the share of it that they cover (1 at most), the best overlap ratio, and
    who speaks in them; zeros where it meets none."""
    more = [F.sort_array(F.collect_set(speaker)).alias("speakers")] if speaker else []
    met = pairs.groupBy(*by).agg(F.count("*").alias("n_tags"), F.sum(overlap(F.col(cs), F.col(ce), F.col(ts), F.col(te))).alias("_covered"), F.max(iou(F.col(cs), F.col(ce), F.col(ts), F.col(te))).alias("best_iou"), *more)
    out = candidates.join(met, by, "left")
    length = F.col(ce) - F.col(cs)
    out = out.withColumns({"n_tags": F.coalesce("n_tags", F.lit(0)), "best_iou": F.coalesce("best_iou", F.lit(0.0)), "covered": F.when(length > 0, F.least(F.lit(1.0), F.coalesce("_covered", F.lit(0)) / length)).otherwise(F.lit(0.0))})
    return out.drop("_covered")


def suppressed(candidates: DataFrame, tags: DataFrame, keys: list[str], margin: float = 75.0, bucket: int | None = None) -> DataFrame:
    """Candidates that no tag touches: both sides' ``start_ms`` and ``end_ms`` are read by their own policy first."""
    from tidemark.functions.spans import normalize_spans

    return overlap_anti(normalize_spans(candidates, "suppress_candidate"), normalize_spans(tags, "suppress_tag"), keys, "start_ms", "end_ms", "start_ms", "end_ms", margin, bucket)


def window_votes(points: DataFrame, windows: DataFrame, keys: list[str], point: str = "t_ms", slack: float = 1e-6, bucket: float = 60_000.0) -> DataFrame:
    """Each grid point's label by the windows (``start_ms``, ``end_ms``, ``label``) that hold it, each weighted by
    1 / (1 + d / 500) for its centre's distance d; where none does, the nearest window's label at confidence 0.5.

    Points and windows meet by stretches of time. The few points that no window holds look for the nearest centre among
    all windows of their keys, by one ordered pass over both."""
    of = points.columns
    a = points.withColumn("_bucket", F.floor(F.col(point) / bucket))
    b = _dealt(windows.select(*keys, "start_ms", "end_ms", "label"), "start_ms", "end_ms", bucket, slack)
    d = F.abs(F.col(point) - (F.col("start_ms") + F.col("end_ms")) / 2)
    held = a.join(b, [*keys, "_bucket"]).where((F.col("start_ms") - slack <= F.col(point)) & (F.col(point) <= F.col("end_ms") + slack))
    by_label = held.groupBy(*of, "label").agg(F.sum(1 / (1 + d / 500)).alias("_w"))
    voted = by_label.groupBy(*of).agg(F.max_by("label", F.struct(F.col("_w"), (-F.col("label")).alias("l"))).alias("label"), (F.max("_w") / F.sum("_w")).alias("confidence"))
    alone = points.join(voted.select(*of), of, "left_anti")
    centres = windows.select(*keys, ((F.col("start_ms") + F.col("end_ms")) / 2).alias("_at"), "label").groupBy(*keys, "_at").agg(F.min("label").alias("label"))
    both = alone.select(*keys, F.struct(*of).alias("_point"), F.col(point).cast("double").alias("_at"), F.lit(None).cast(windows.schema["label"].dataType).alias("label")).unionByName(centres.withColumn("_point", F.lit(None)), allowMissingColumns=True)
    line = Window.partitionBy(*keys).orderBy("_at", F.col("_point").isNotNull())
    centre = F.when(F.col("_point").isNull(), F.struct("_at", "label"))
    placed = both.withColumns({"_before": F.last(centre, True).over(line.rowsBetween(Window.unboundedPreceding, 0)), "_after": F.first(centre, True).over(line.rowsBetween(0, Window.unboundedFollowing))}).where("_point is not null")
    far = {side: F.abs(F.col("_at") - F.col(f"{side}._at")) for side in ("_before", "_after")}
    ranked = F.array_min(F.filter(F.array(*[F.when(F.col(side).isNotNull(), F.struct(far[side].alias("d"), F.col(f"{side}.label").alias("label"))) for side in far]), lambda x: x.isNotNull()))
    return voted.unionByName(placed.select("_point.*", ranked["label"].alias("label"), F.lit(0.5).alias("confidence")))


def stitched(turns: DataFrame, keys: list[str], max_gap_ms: float) -> DataFrame:
    """Turns whose gap to the next is at most ``max_gap_ms`` meet it in the middle."""
    w = Window.partitionBy(*keys).orderBy("start_ms")
    after, before = F.lead("start_ms").over(w) - F.col("end_ms"), F.col("start_ms") - F.lag("end_ms").over(w)
    near = lambda gap: (gap > 0) & (gap <= max_gap_ms)
    return turns.withColumns({"_after": after, "_before": before}).withColumns({"end_ms": F.when(near(F.col("_after")), F.col("end_ms") + F.col("_after") / 2).otherwise(F.col("end_ms")), "start_ms": F.when(near(F.col("_before")), F.col("start_ms") - F.col("_before") / 2).otherwise(F.col("start_ms"))}).drop("_after", "_before")
