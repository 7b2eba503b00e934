"""Morphology of ink masks. A mask table is dense: image_id, w, h, x, y, ink."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lithoframe.operators.grid import column

C = F.col


def half_widths(radius: float) -> dict[int, int]:
    """For each row offset of a disc, how far it reaches to either side."""
    top = int(math.floor(radius))
    return {dy: int(math.floor(math.sqrt(radius * radius - dy * dy))) for dy in range(-top, top + 1)}


def _any_within(df: DataFrame, flag: Column, radius: float, name: str) -> DataFrame:
    """Whether a pixel with the flag lies in the disc: a running maximum along rows for each width, then rows looked up along columns. Two local sorts, no join."""
    df = df.withColumn("_f", flag.cast("int"))
    reach = half_widths(radius)
    widths = sorted(set(reach.values()))
    near = lambda k: F.max("_f").over(Window.partitionBy("image_id", "y").orderBy("x").rowsBetween(-k, k))
    df = df.withColumns({f"_near{k}": near(k) if k else C("_f") for k in widths})
    seen = []
    for dy, k in reach.items():
        c = f"_near{k}"
        seen.append(C(c) if not dy else (F.lag(c, -dy) if dy < 0 else F.lead(c, dy)).over(column()))
    hit = F.greatest(*(F.coalesce(s, F.lit(0)) for s in seen)) if len(seen) > 1 else seen[0]
    return df.withColumn(name, hit == 1).drop("_f", *(f"_near{k}" for k in widths))


def dilate(mask: DataFrame, radius: float) -> DataFrame:
    """Ink grows by a Euclidean disc, which may have a fractional radius; below 0.05 nothing changes."""
    return mask if radius < 0.05 else _any_within(mask, C("ink"), radius, "ink")


def erode(mask: DataFrame, radius: float, edge: str = "outside_off") -> DataFrame:
    """Ink stays where the whole disc is ink. edge='frame': a whole radius of at least 1, and a band of that width along the frame goes; 'outside_off': what lies outside is no ink."""
    if edge == "frame":
        r: float = max(1, math.floor(radius + 0.5))
        inside = (C("x") >= r) & (C("y") >= r) & (C("x") < C("w") - r) & (C("y") < C("h") - r)
    elif radius < 0.05:
        return mask
    else:
        r = radius
        k = int(math.floor(r))
        inside = (C("x") >= k) & (C("y") >= k) & (C("x") < C("w") - k) & (C("y") < C("h") - k)
    gone = _any_within(mask, ~C("ink"), r, "_gone")
    return gone.withColumn("ink", ~C("_gone") & inside).drop("_gone")


def close_mask(mask: DataFrame, radius: float) -> DataFrame:
    return erode(dilate(mask, radius), radius)


def stroke_walls(mask: DataFrame, radius: int = 1) -> DataFrame:
    """mask with wall: ink that erosion would remove."""
    thin = erode(mask.withColumn("_ink", C("ink")), max(1, radius), "frame")
    return thin.withColumn("wall", C("_ink") & ~C("ink")).withColumn("ink", C("_ink")).drop("_ink")


__all__ = ["close_mask", "dilate", "erode", "half_widths", "stroke_walls"]
