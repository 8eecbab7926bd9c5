"""Span arithmetic. A span has a start and an end in milliseconds; what a missing or odd end means depends on
the caller, so every reading of it is a named policy."""

from __future__ import annotations

import dataclasses

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclasses.dataclass(frozen=True)
class SpanPolicy:
    """``point_ms`` stands in for a missing end. ``on_swapped``: ``swap``, ``point`` (as if the end were missing) or
    ``keep``. ``t_fallback``: a missing start is the mark's time. ``zero_start``: then 0, else the row goes.
    ``point_if_equal``: an end equal to the start counts as missing. ``min_ms``: shorter spans go (or, with
    ``widen``, are widened to it)."""

    point_ms: float
    on_swapped: str = "swap"
    t_fallback: bool = True
    zero_start: bool = False
    point_if_equal: bool = False
    min_ms: float = 0.0
    widen: bool = False


#: The readings in use, by caller.
POLICIES = {
    "suppress_tag": SpanPolicy(500),
    "suppress_candidate": SpanPolicy(0, zero_start=True),
    "evaluate": SpanPolicy(500, on_swapped="point", point_if_equal=True),
    "cluster_tag": SpanPolicy(300, t_fallback=False, zero_start=True, min_ms=120),
    "cluster_annotation": SpanPolicy(300, zero_start=True, min_ms=120),
    "asr": SpanPolicy(300, zero_start=True, min_ms=80, widen=True),
    "list": SpanPolicy(0, t_fallback=False, zero_start=True),
    "create": SpanPolicy(0, on_swapped="keep", t_fallback=False, zero_start=True),
}


def normalize_spans(df: DataFrame, policy: str | SpanPolicy, start: str = "start_ms", end: str = "end_ms", t: str | None = "t_ms") -> DataFrame:
    """``df`` with ``start`` and ``end`` read under a policy; rows that it drops are gone."""
    p = POLICIES[policy] if isinstance(policy, str) else policy
    s = F.col(start)
    if p.t_fallback and t and t in df.columns:
        s = F.coalesce(s, F.col(t))
    if p.zero_start:
        s = F.coalesce(s, F.lit(0).cast(df.schema[start].dataType))
    point = s + F.lit(p.point_ms).cast(df.schema[start].dataType)
    e = F.coalesce(F.col(end), point)
    if p.on_swapped == "swap":
        # without a start there is no span, whatever the end
        s, e = F.when(s.isNotNull(), F.least(s, e)), F.greatest(s, e)
    elif p.on_swapped == "point":
        e = F.when(e < s, point).otherwise(e)
    if p.point_if_equal:
        e = F.when(e == s, point).otherwise(e)
    if p.widen:
        e = F.greatest(e, s + F.lit(p.min_ms).cast(df.schema[start].dataType))
    out = df.withColumns({start: s, end: e}).where(F.col(start).isNotNull())
    return out if p.widen or not p.min_ms else out.where(F.col(end) - F.col(start) >= p.min_ms)


def overlap(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Shared length, 0 if none."""
    shared = F.least(e1, e2) - F.greatest(s1, s2)
    return F.when(shared > 0, shared).otherwise(shared - shared)


def iou(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Shared length over joint length, 0 where the joint length is 0."""
    shared = overlap(s1, e1, s2, e2).cast("double")
    joint = (e1 - s1) + (e2 - s2) - shared
    return F.when(joint > 0, shared / joint).otherwise(F.lit(0.0))


def overlaps_within(s1: Column, e1: Column, s2: Column, e2: Column, margin: float = 75.0) -> Column:
    """Whether spans overlap once both are widened by ``margin`` at either end."""
    return (s1 - margin < e2 + margin) & (s2 - margin < e1 + margin)
