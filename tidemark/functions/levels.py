"""Level, time and scale functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(x: Column) -> Column:
    """The nearest whole number, halves towards positive infinity."""
    return F.floor(x + 0.5)


def bin_of(t: Column, width: int) -> Column:
    """The centre of the bin, a multiple of ``width``, that a time falls in."""
    return (half_up(t / width) * width).cast("long")


def clamp01(x: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))


#: The least level that is captured and the level up to which a bar has no height, in dB.
SILENCE_DB, NOISE_FLOOR_DB = -160.0, -42.0


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def db_to_height(db: Column, min_db: Column, max_db: Column) -> Column:
    """A bar's height from 0 to 1; a level that is no number, or not above the noise floor, has none."""
    return F.when(finite(db) & (db > NOISE_FLOOR_DB), clamp01((db - min_db) / F.greatest(F.lit(1e-6), max_db - min_db))).otherwise(F.lit(0.0))


def db_to_amplitude(db: Column) -> Column:
    """10^(dB/20), at most 1; -160 dB and below are silent."""
    return F.when(db <= -160, F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.pow(F.lit(10.0), db / 20)))


def nearest_rank(values: Column, share: float = 0.95) -> Column:
    """The value at index floor(n * share), from 0, of the sorted array; null if it is empty."""
    n = F.size(values)
    at = F.least(n, F.floor(n * F.lit(share)).cast("int") + 1)
    return F.when(n > 0, F.element_at(F.sort_array(values), F.greatest(at, F.lit(1))))


def playback_floor(p95: Column) -> Column:
    """The lower end of the playback range: five times the 95th percentile, within -55 and -45 dB."""
    return F.when(p95.isNull(), F.lit(-45.0)).otherwise(F.least(F.lit(-45.0), F.greatest(F.lit(-55.0), p95 * 5)))


def playback_range(samples: Column) -> Column:
    """The range of a series' playback: its floor from the peaks that are heard, up to 0 dB."""
    heard = F.filter(F.transform(samples, lambda s: s["peakDb"]), lambda p: finite(p) & (p > SILENCE_DB + 1))
    return F.struct(playback_floor(nearest_rank(heard)).alias("minDb"), F.lit(0.0).alias("maxDb"))


def bipolar_scale(p95: Column) -> Column:
    """What amplitudes are divided by, so that their 95th percentile comes to 0.8; 1 where there is none."""
    return F.when(p95.isNotNull(), F.greatest(F.lit(1e-6), p95 / 0.8)).otherwise(F.lit(1.0))


def amplitude_scale(samples: Column) -> Column:
    """The same for a series, by both amplitudes of its samples that aren't next to nothing."""
    sides = F.flatten(F.transform(samples, lambda s: F.array(F.abs(F.coalesce(s["minAmp"], F.lit(0.0))), F.abs(F.coalesce(s["maxAmp"], F.lit(0.0))))))
    return bipolar_scale(nearest_rank(F.filter(sides, lambda a: a > 1e-6)))


def nice_step(span: Column, ticks: int = 8) -> Column:
    """The smallest of 1, 2, 5, 10 times a power of ten that gives at most ``ticks`` steps."""
    raw = F.greatest(span / ticks, F.lit(1e-9))
    power = F.pow(F.lit(10.0), F.floor(F.log10(raw)))
    lead = raw / power
    return power * F.when(lead <= 1, 1).when(lead <= 2, 2).when(lead <= 5, 5).otherwise(10)


def tick_label(ms: Column) -> Column:
    """Minutes and seconds, as ``m:ss.d``."""
    seconds = ms / 1000
    return F.concat(F.floor(seconds / 60).cast("string"), F.lit(":"), F.lpad(F.format_string("%.1f", seconds - F.floor(seconds / 60) * 60), 4, "0"))


def map_linear(x: Column, x0: float, x1: float, y0: float, y1: float) -> Column:
    return F.lit(y0) + (x - x0) * ((y1 - y0) / (x1 - x0))


def score_from_peak(peak: Column, threshold: Column, span_db: float = 18.0) -> Column:
    return clamp01((peak - threshold) / span_db)
