"""Evaluation of machine-proposed spans (candidates) against labelled ones (tags): matched rows in, metric rows
out. Grouping by a key gives one row per recording, grouping by none pools them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.spans import iou
from tidemark.operators.stats import auc, percent, quantile_summary, quantiles
from tidemark.operators.store import first_rows
from tidemark.session import materialized


def _n(c: Column) -> Column:
    return F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0))


def deltas(matches: DataFrame, ts: str, te: str, cs: str, ce: str) -> DataFrame:
    """Best matches with boundary differences, durations and their ratio, and the share of the tag that is covered."""
    length = F.col(te) - F.col(ts)
    return matches.withColumns({
        "d_start": F.col(ts) - F.col(cs), "d_end": F.col(te) - F.col(ce), "tag_dur": length, "cand_dur": F.col(ce) - F.col(cs),
        "dur_ratio": F.when(length > 0, (F.col(ce) - F.col(cs)) / length).otherwise(F.lit(0.0)), "tag_share": F.when(length > 0, F.col("overlap_ms") / length).otherwise(F.lit(0.0)),
    })


def coverage(tags: DataFrame, matched: DataFrame, keys: list[str]) -> DataFrame:
    """Tags in all and by how well their best candidate fits."""
    hit = matched.groupBy(*keys).agg(F.count("*").alias("matched"), *[_n(F.col("iou") >= x / 100).alias(f"iou{x}") for x in (50, 70)], *[_n(F.col("tag_share") >= x / 100).alias(f"contains{x}") for x in (50, 90)])
    counts = ["matched", "iou50", "iou70", "contains50", "contains90"]
    total = tags.groupBy(*keys).agg(F.count("*").alias("n_tags"))
    joined = total.join(hit, keys, "left") if keys else total.crossJoin(hit)  # one row each
    joined = joined.fillna(0, counts)
    return joined.select(*keys, "n_tags", *counts, (F.col("n_tags") - F.col("matched")).alias("missed"), percent(F.col("matched"), F.col("n_tags")).alias("matched_pct"))


def boundaries(matched: DataFrame, keys: list[str], late: float = 200.0) -> DataFrame:
    """How often candidates start early or end late, and are far too long or short."""
    return matched.groupBy(*keys).agg(
        F.count("*").alias("n"), _n(F.col("d_start") < -late).alias("late_start"), _n(F.col("d_start") > late).alias("early_start"), _n(F.col("d_end") > late).alias("early_end"), _n(F.col("d_end") < -late).alias("late_end"),
        _n(F.col("dur_ratio") >= 2).alias("ratio_2"), _n(F.col("dur_ratio") >= 4).alias("ratio_4"), _n(F.col("dur_ratio") < 0.8).alias("ratio_short"),
    )


def false_positives(covered: DataFrame, keys: list[str], status: str | None = None, reason: str | None = None) -> DataFrame:
    """Candidates that meet no tag, their share, how many of them were dismissed, and how many of all are marked as no
    speech."""
    none = F.col("n_tags") == 0
    aggs = [F.count("*").alias("n_candidates"), _n(none).alias("false_positives"), percent(_n(none), F.count("*")).alias("false_positive_pct")]
    if status:
        aggs.append(_n(none & (F.col(status) == "dismissed")).alias("dismissed"))
    if reason:
        aggs.append(_n(F.coalesce(F.col(reason), F.lit("")) != "").alias("flagged"))
    return covered.groupBy(*keys).agg(*aggs)


def hit_and_miss(covered: DataFrame, value: str, keys: list[str] | None = None) -> DataFrame:
    """Quantiles of a candidate's value (a score, a duration), apart for those that meet a tag and those that meet none."""
    side = F.when(F.col("n_tags") > 0, "hit").otherwise("miss")
    return quantile_summary(covered.withColumn("side", side), [*(keys or []), "side"], value)


def misses(tags: DataFrame, matched: DataFrame, by: list[str]) -> DataFrame:
    """Tags without a candidate."""
    return tags.join(matched.select(*by), by, "left_anti")


def miss_examples(missed: DataFrame, keys: list[str], order: list[str], n: int = 12) -> DataFrame:
    """The first ``n`` misses of each group."""
    return first_rows(missed, keys, order, n)


def missed_share(tags: DataFrame, missed: DataFrame, keys: list[str]) -> DataFrame:
    """How many tags of each group are missed, and their share of all."""
    total, gone = tags.groupBy(*keys).agg(F.count("*").alias("n_tags")), missed.groupBy(*keys).agg(F.count("*").alias("n_missed"))
    joined = (total.join(gone, keys, "left") if keys else total.crossJoin(F.broadcast(gone))).fillna(0, ["n_missed"])  # one row each
    return joined.withColumn("missed_pct", percent(F.col("n_missed"), F.col("n_tags")))


def fragmentation(matched: DataFrame, covered: DataFrame, keys: list[str]) -> DataFrame:
    """Tags spread over several candidates and candidates over several tags or speakers."""
    tags = matched.groupBy(*keys).agg(_n(F.col("n_candidates") > 1).alias("split_tags"), F.max("n_candidates").alias("most_candidates"))
    more = [_n(F.size("speakers") > 1).alias("many_speakers")] if "speakers" in covered.columns else []
    cands = covered.groupBy(*keys).agg(_n(F.col("n_tags") > 1).alias("joined_candidates"), F.max("n_tags").alias("most_tags"), *more)
    return tags.join(cands, keys, "full") if keys else tags.crossJoin(cands)  # one row each


def by_source(tags: DataFrame, matched: DataFrame, keys: list[str], source: str = "source", id_col: str = "tag_id") -> DataFrame:
    """Coverage of tags drawn by hand and of those confirmed from a candidate. ``n_tags`` counts all tags, ``n_matched`` those
    with a candidate; a pooled report that divides by the latter overstates coverage, so both are given."""
    kind = F.when(F.col(source) == "ml_confirmed", "mlConfirmed").otherwise("manual").alias("kind")
    total = tags.groupBy(*keys, kind).agg(F.count("*").alias("n_tags"))
    hit = matched.groupBy(*keys, kind).agg(F.count("*").alias("n_matched"), _n(F.col("iou") >= 0.5).alias("iou50"), _n(F.col("tag_share") >= 0.9).alias("contains90"))
    return total.join(hit, [*keys, "kind"], "left").fillna(0, ["n_matched", "iou50", "contains90"])


def score_auc(covered: DataFrame, score: str, keys: list[str] | None = None) -> DataFrame:
    return auc(covered, score, F.col("n_tags") > 0, keys)


def trim_grid(matched: DataFrame, ts: str, te: str, cs: str, ce: str, starts: list[int], ends: list[int]) -> DataFrame:
    """For each trim of every candidate's start and end by constants: the median overlap ratio and the share at 0.5 or more.
    The grid is a parameter of fixed size; each match gives a row for each of its points."""
    grid = F.explode(F.array(*[F.struct(F.lit(a).alias("trim_start"), F.lit(b).alias("trim_end")) for a in starts for b in ends])).alias("g")
    rows = matched.select(ts, te, cs, ce, grid).select("*", "g.*")
    s, e = F.col(cs) + F.col("trim_start"), F.col(ce) - F.col("trim_end")
    ratio = F.when(e > s, iou(F.col(ts), F.col(te), s, e)).otherwise(F.lit(0.0))
    point = ["trim_start", "trim_end"]
    scored = materialized(rows.select(*point, ratio.alias("iou")), "trims")
    medians = quantiles(scored, point, "iou", {"median_iou": 0.5}).drop("n")
    return medians.join(scored.groupBy(*point).agg(_n(F.col("iou") >= 0.5).alias("iou50"), F.count("*").alias("n")), point)


def best_trim(grid: DataFrame) -> DataFrame:
    """The grid's point of the highest median, the smallest trims among equals."""
    return grid.agg(F.max_by(F.struct("trim_start", "trim_end", "median_iou", "iou50"), F.struct("median_iou", -F.col("trim_start"), -F.col("trim_end"))).alias("b")).select("b.*")


def confirm_edits(tags: DataFrame, annotations: DataFrame, position: str = "pos") -> DataFrame:
    """Bounds of confirmed tags against the annotation of the same uuid (the last, where there are several)."""
    last = annotations.groupBy("uuid").agg(F.max_by(F.struct(F.col("start_ms").alias("a_start"), F.col("end_ms").alias("a_end")), position).alias("a")).select("uuid", "a.*")
    both = tags.where("source = 'ml_confirmed'").join(last, "uuid")
    both = both.withColumns({"d_start": F.col("start_ms") - F.col("a_start"), "d_end": F.col("end_ms") - F.col("a_end")})
    return both.withColumn("edited", (F.abs("d_start") > 1) | (F.abs("d_end") > 1))


def edit_summary(edits: DataFrame) -> DataFrame:
    shrunk = F.col("edited") & (F.col("end_ms") - F.col("start_ms") < F.col("a_end") - F.col("a_start"))
    out = edits.agg(F.count("*").alias("n"), _n(F.col("edited")).alias("n_edited"), _n(shrunk).alias("n_shrunk"))
    for c in ("d_start", "d_end"):  # one row each; none where nothing was edited
        out = out.join(F.broadcast(quantiles(edits.where("edited"), [], c, {c: 0.5}).drop("n")), F.lit(True), "left")
    return out


def workflow_signature(tags: DataFrame, rescued: DataFrame, dismissed: DataFrame, keys: list[str]) -> DataFrame:
    """Tags by how they came about. ``rescued`` has the manual tags that overlap a dismissed candidate."""
    made = F.coalesce(F.col("source"), F.lit("")) == "ml_confirmed"
    out = tags.groupBy(*keys).agg(F.count("*").alias("n_tags"), _n(~made).alias("n_manual"), _n(made).alias("n_confirmed"))
    out = out.join(rescued.groupBy(*keys).agg(F.count("*").alias("n_rescued")), keys, "left").join(dismissed.groupBy(*keys).agg(F.count("*").alias("n_dismissed")), keys, "left")
    return out.fillna(0, ["n_rescued", "n_dismissed"]).withColumn("n_no_candidate", F.col("n_manual") - F.col("n_rescued"))


def vintage(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """Which fields a recording's candidates have, as a sign of what made them."""
    return candidates.groupBy(*keys).agg(F.count("*").alias("n"), F.count("speech_score").alias("with_speech_score"), F.count("speaker_cluster").alias("with_speaker"), F.count("split_by").alias("with_split"), F.max(F.coalesce(F.col("status") == "dismissed", F.lit(False))).alias("curated"))


#: Sources of candidates that a machine has made, whatever became of them.
MACHINE_SOURCES = ("vad_v0", "ml_v0", "ml_confirmed")


def archival(annotations: DataFrame, sources: tuple[str, ...] = MACHINE_SOURCES) -> DataFrame:
    """Annotations of the machine's sources."""
    return annotations.where(F.col("source").isin(*sources))


def eligible_kits(tags: DataFrame, candidates: DataFrame, key: str, least_tags: int, fresh: bool = False) -> DataFrame:
    """Recordings with enough tags, and with candidates unless fresh ones are to be made."""
    counted = tags.groupBy(key).agg(F.count("*").alias("n_tags")).join(candidates.groupBy(key).agg(F.count("*").alias("n_candidates")), key, "left").fillna(0, ["n_candidates"])
    return counted.where((F.col("n_tags") >= least_tags) & (F.lit(fresh) | (F.col("n_candidates") > 0)))


def boundary_quantiles(matched: DataFrame, keys: list[str], column: str) -> DataFrame:
    return quantile_summary(matched, keys, column)


def report(metrics: DataFrame) -> DataFrame:
    """Metric rows as JSON text, columns that begin with ``_`` left out."""
    return metrics.select(F.to_json(F.struct(*[c for c in metrics.columns if not c.startswith("_")])).alias("json"))
