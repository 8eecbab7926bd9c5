"""Who speaks when: windows over speech regions, their vectors clustered, votes on a grid, and turns."""

from __future__ import annotations

import importlib.util
import os

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import cluster, segments, signal
from tidemark.operators.intervals import clip, owner_of_points, window_votes
from tidemark.session import materialized

GRID_MS, MIN_TURN_MS, MAX_SPEAKERS = 100.0, 600.0, 8


def standardized(vectors: DataFrame, key: str, embedding: str) -> DataFrame:
    """Each number of the vectors less its mean over the recording, over its deviation, at unit length."""
    flat = vectors.select("*", F.posexplode(embedding).alias("_i", "_x"))
    stats = flat.groupBy(key, "_i").agg(F.avg("_x").alias("_m"), (F.stddev_pop("_x") + 1e-9).alias("_s"))
    packed = stats.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("_i", "_m", "_s"))).alias("_st"))
    scaled = vectors.join(packed, key).withColumn(embedding, F.zip_with(embedding, "_st", lambda x, s: (x - s["_m"]) / s["_s"])).drop("_st")
    scaled = scaled.withColumn("_len", F.sqrt(F.aggregate(embedding, F.lit(0.0), lambda a, x: a + x * x)) + 1e-12)
    return scaled.withColumn(embedding, F.transform(embedding, lambda x: x / F.col("_len"))).drop("_len")


def speaker_labels(windows: DataFrame, distance: float, speakers: int | None = None) -> DataFrame:
    """``(kit, window_id, embedding, label)``: clustered by distance and folded to MAX_SPEAKERS if there are more, clusters of few
    windows given to the nearest; or exactly as many as are asked for."""
    if speakers:
        return windows.join(cluster.clustered(windows, "kit", "window_id", "embedding", k=speakers), ["kit", "window_id"])
    by_distance = materialized(windows.join(cluster.clustered(windows, "kit", "window_id", "embedding", distance), ["kit", "window_id"]), "labels")
    many = by_distance.groupBy("kit").agg(F.count_distinct("label").alias("n")).where(F.col("n") > MAX_SPEAKERS).select("kit")
    folded = windows.join(many, "kit", "left_semi")
    folded = folded.join(cluster.clustered(folded, "kit", "window_id", "embedding", k=MAX_SPEAKERS), ["kit", "window_id"])
    labelled = by_distance.join(many, "kit", "left_anti").unionByName(folded)
    return cluster.without_tiny(labelled, ["kit"], "label", "embedding")


def grid(regions: DataFrame, step: float = GRID_MS) -> DataFrame:
    """Grid points in the middle of each step of a region."""
    n = F.greatest(F.lit(1), F.ceil((F.col("end_ms") - F.col("start_ms")) / step).cast("int"))
    points = regions.select("kit", "region", F.col("start_ms").alias("r0"), F.col("end_ms").alias("r1"), F.posexplode(F.sequence(F.lit(0), n - 1)).alias("point", "_k"))
    return points.withColumn("t_ms", F.col("r0") + (F.col("_k") + 0.5) * step).drop("_k")


def turns_of_grid(votes: DataFrame, step: float = GRID_MS, least_ms: float = MIN_TURN_MS) -> DataFrame:
    """Runs of one label in each region, the shortest given to its longer neighbour until none is too short or eight were."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("point")
        runs = [[int(a), int(len(g)), g.confidence.sum()] for _, g in pdf.groupby((pdf.label != pdf.label.shift()).cumsum()) for a in [g.label.iloc[0]]]
        for _ in range(8):
            k = min(range(len(runs)), key=lambda i: runs[i][1])
            if len(runs) < 2 or runs[k][1] >= max(1, round(least_ms / step)):
                break
            near = [i for i in (k - 1, k + 1) if 0 <= i < len(runs)]
            runs[k][0] = runs[max(near, key=lambda i: (runs[i][1], -i))][0]
            joined = [runs[0]]
            for r in runs[1:]:
                if r[0] == joined[-1][0]:
                    joined[-1] = [r[0], joined[-1][1] + r[1], joined[-1][2] + r[2]]
                else:
                    joined.append(r)
            runs = joined
        r0, r1, at, rows = pdf.r0.iloc[0], pdf.r1.iloc[0], 0, []
        for label, n, total in runs:
            rows.append((pdf.kit.iloc[0], pdf.region.iloc[0], r0 + at * step, min(r1, r0 + (at + n) * step), label, total / n))
            at += n
        rows[-1] = (*rows[-1][:3], r1, *rows[-1][4:])
        return pd.DataFrame(rows, columns=["kit", "region", "start_ms", "end_ms", "label", "confidence"])

    return votes.groupBy("kit", "region").applyInPandas(run, "kit string, region long, start_ms double, end_ms double, label long, confidence double")


def diarized(regions: DataFrame, audio: DataFrame, distance: float = 1.0, speakers: int | None = None) -> DataFrame:
    """Turns ``(kit, region, start_ms, end_ms, speaker, confidence)`` of ``regions(kit, region, start_ms, end_ms)``."""
    # a long recording takes larger hops, so that its windows (whose distances all meet in one task) stay near 4000
    hops = segments.adaptive_hop(regions, ["kit"])
    windows = segments.sliding_windows(regions.join(hops, "kit"), ["kit"], hop="hop_ms").withColumn("window_id", F.concat_ws(":", "region", F.lpad(F.col("window").cast("string"), 9, "0")))
    vectors = signal.span_embeddings(windows, audio, "mfcc").dropDuplicates(["kit", "start_ms", "end_ms"])
    embedded = materialized(standardized(windows.join(vectors, ["kit", "start_ms", "end_ms"]), "kit", "embedding"), "windows")
    labels = speaker_labels(embedded.select("kit", "window_id", "embedding"), distance, speakers).select("kit", "window_id", "label")
    placed = windows.join(labels, ["kit", "window_id"]).select("kit", "region", "start_ms", "end_ms", "label")
    turns = materialized(turns_of_grid(window_votes(grid(regions), placed, ["kit", "region"])), "grid-turns")
    return segments.first_appearance_names(turns, ["kit"], "label").select("kit", "region", "start_ms", "end_ms", "speaker", "confidence")


def split_by_speaker(regions: DataFrame, turns: DataFrame) -> DataFrame:
    """Regions cut where the speaker changes. A turn belongs to the first region that holds its middle; a region without turns
    stays as it is."""
    middles = turns.select("kit", F.col("start_ms").alias("t0"), F.col("end_ms").alias("t1"), "speaker", "confidence", ((F.col("start_ms") + F.col("end_ms")) / 2).alias("mid"))
    owned = owner_of_points(middles, regions, ["kit"], "mid", "start_ms", "end_ms", "region")
    rest = [c for c in regions.columns if c not in ("kit", "start_ms", "end_ms")]
    numbered = owned.withColumn("_first", F.min("t0").over(_by_region()))
    cut = numbered.select("kit", *rest, F.col("t0").alias("start_ms"), F.col("t1").alias("end_ms"), F.col("speaker").alias("speaker_cluster"), F.round("confidence", 3).alias("speaker_confidence"), F.when(F.col("t0") > F.col("_first"), "speaker_change").alias("split_by"))
    whole = regions.join(owned.select("kit", "region").distinct(), ["kit", "region"], "left_anti")
    return cut.unionByName(whole.select("kit", *rest, "start_ms", "end_ms"), allowMissingColumns=True)


def speaker_pieces(regions: DataFrame, audio: DataFrame, speakers: int | None = None, backend: str = "auto") -> DataFrame:
    """Regions cut where the speaker changes, or as they are where no backend can be used that is built in."""
    if resolve_backend(backend) != "melstats":
        return regions.withColumns({"speaker_cluster": F.lit(None).cast("string"), "speaker_confidence": F.lit(None).cast("double"), "split_by": F.lit(None).cast("string")})
    turns = materialized(diarized(regions.select("kit", "region", "start_ms", "end_ms"), audio, speakers=speakers), "turns")
    return split_by_speaker(regions, turns)


def _by_region():
    from pyspark.sql import Window

    return Window.partitionBy("kit", "region")


#: Backends by preference, and what each needs.
BACKENDS = (("pyannote", ("torch", "pyannote.audio"), "HF_TOKEN"), ("ecapa", ("torch", "speechbrain"), None), ("melstats", (), None))


def backend_status() -> list[dict[str, object]]:
    """Each backend with whether its modules, and its token where it needs one, are there."""
    def there(module: str) -> bool:
        try:
            return importlib.util.find_spec(module) is not None
        except ModuleNotFoundError:
            return False

    return [{"name": name, "available": all(map(there, modules)) and (token is None or bool(os.environ.get(token)))} for name, modules, token in BACKENDS]


def resolve_backend(prefer: str | None = None) -> str:
    """The backend asked for if it can be used, else none; for ``auto``, the first of the embedded ones that can."""
    usable = {b["name"] for b in backend_status() if b["available"]}
    if prefer and prefer != "auto":
        return prefer if prefer in usable else "none"
    return next((name for name in ("ecapa", "melstats") if name in usable), "none")


def clipped_turns(turns: DataFrame, regions: DataFrame) -> DataFrame:
    """The parts of foreign turns that lie in a region."""
    a = turns.select("kit", F.col("start_ms").alias("t0"), F.col("end_ms").alias("t1"), "speaker")
    pairs = a.join(regions.select("kit", "region", F.col("start_ms").alias("r0"), F.col("end_ms").alias("r1")), "kit").where((F.col("t0") < F.col("r1")) & (F.col("r0") < F.col("t1")))
    return clip(pairs, "t0", "t1", "r0", "r1").select("kit", "region", F.col("clip_start").alias("start_ms"), F.col("clip_end").alias("end_ms"), "speaker")
