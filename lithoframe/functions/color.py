"""Colour maths as column expressions. Channels are 0 to 255; all arithmetic is in doubles, and rounding is floor(v + 0.5).

What depends on the channels of one pixel by plain arithmetic takes numpy arrays too, for tasks that work on whole lines of pixels.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

C = F.col


def rounded(v: Column) -> Column:
    return F.floor(v + F.lit(0.5)).cast("int")


def luminance(r: Column, g: Column, b: Column) -> Column:
    return 0.2126 * r + 0.7152 * g + 0.0722 * b


def chroma(r: Column, g: Column, b: Column) -> Column:
    if isinstance(r, np.ndarray):
        return np.maximum(np.maximum(r, g), b) - np.minimum(np.minimum(r, g), b)
    return F.greatest(r, g, b) - F.least(r, g, b)


def is_skin_tone(r: Column, g: Column, b: Column) -> Column:
    """Warm, neither dark nor white, and not a pure red."""
    light, ch = luminance(r, g, b), chroma(r, g, b)
    red = (ch > 100) & (g < r * 0.45)
    return (light >= 48) & (light <= 248) & (ch >= 16) & (ch <= 130) & (r >= g + 6) & (b <= g + 12) & ((r - b) / 255.0 >= 0.07) & ~red


def skin_score(r: Column, g: Column, b: Column) -> Column:
    if isinstance(r, np.ndarray):
        score = (r - b) / 255.0 * (1 - np.abs(luminance(r, g, b) - 185) / 185.0) * np.minimum(1.0, chroma(r, g, b) / 70.0)
        return np.where(is_skin_tone(r, g, b), score, 0.0)
    warm = (r - b) / F.lit(255.0)
    score = warm * (1 - F.abs(luminance(r, g, b) - 185) / F.lit(185.0)) * F.least(F.lit(1.0), chroma(r, g, b) / F.lit(70.0))
    return F.when(is_skin_tone(r, g, b), score).otherwise(F.lit(0.0))


def is_neutral(r: Column, g: Column, b: Column) -> Column:
    return chroma(r, g, b) < 28


def is_accent(r: Column, g: Column, b: Column) -> Column:
    return (chroma(r, g, b) >= 45) | (skin_score(r, g, b) > 0.12)


def is_leftover_backdrop(r: Column, g: Column, b: Column) -> Column:
    return (luminance(r, g, b) >= 248) & (chroma(r, g, b) <= 12) & ~is_skin_tone(r, g, b)


def rgb_to_hex(r: Column, g: Column, b: Column) -> Column:
    return F.format_string("#%02x%02x%02x", r.cast("int"), g.cast("int"), b.cast("int"))


def hex_to_rgb(text: Column) -> Column:
    """A struct r, g, b of '#rrggbb' or '#rgb', with or without the '#'; null where a digit is none."""
    bare = F.regexp_replace(F.trim(text), "^#", "")
    full = F.when(F.length(bare) == 3, F.regexp_replace(bare, "(.)", "$1$1")).otherwise(bare)
    good = full.rlike("^[0-9a-fA-F]{6}$")
    part = lambda k: F.when(good, F.conv(F.substring(full, k, 2), 16, 10).cast("int"))
    return F.struct(part(1).alias("r"), part(3).alias("g"), part(5).alias("b"))


def dist2(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    return sum(((x - y) * (x - y) for x, y in zip(a, b, strict=True)), F.lit(0))


def color_distance(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    return F.sqrt(dist2(a, b).cast("double"))


def rgb_to_lab(r: Column, g: Column, b: Column) -> Column:
    """CIE Lab under D65, as a struct l, a, b."""

    def linear(v: Column) -> Column:
        v = v / F.lit(255.0)
        return F.when(v > 0.04045, F.pow((v + 0.055) / 1.055, F.lit(2.4))).otherwise(v / 12.92)

    def bent(t: Column) -> Column:
        return F.when(t > 0.008856, F.cbrt(t)).otherwise(7.787 * t + 16 / 116)

    lr, lg, lb = (linear(v) for v in (r, g, b))
    # The rows of the sRGB to XYZ matrix, and the white point.
    x = bent((lr * 0.4124 + lg * 0.3576 + lb * 0.1805) / 0.95047)
    y = bent(lr * 0.2126 + lg * 0.7152 + lb * 0.0722)
    z = bent((lr * 0.0193 + lg * 0.1192 + lb * 0.9505) / 1.08883)
    return F.struct((116 * y - 16).alias("l"), (500 * (x - y)).alias("a"), (200 * (y - z)).alias("b"))


def delta_e76(p: Column, q: Column) -> Column:
    """Distance of two Lab structs."""
    d = [p[k] - q[k] for k in ("l", "a", "b")]
    return F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])
