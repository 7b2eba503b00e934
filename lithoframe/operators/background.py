"""Studio backdrops: the colour at the border, the pixels that match it, and what of them the border reaches."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithoframe.functions.color import chroma, is_skin_tone, luminance, rounded
from lithoframe.operators.match import RGB
from lithoframe.operators.packed import LINE, SIDES, SQUARE, Lines, as_rows, channels, found, map_lines, touching_frame

C = F.col


def edge_samples(pixels: DataFrame) -> DataFrame:
    """A pixel table, or rows with px -> image_id, r, g, b: up to twelve pixels near the border, those in the image with an alpha of 16 at least; a place that is named twice counts twice. Samples are picked within lines."""

    def run(lines: Lines) -> dict[str, np.ndarray]:
        w, h, y = (v.astype(np.int64) for v in (lines.w, lines.h, lines.y))
        two = np.full(len(w), 2)
        places = [(two, two), (w - 3, two), (two, h - 3), (w - 3, h - 3), (w // 2, two), (w // 2, h - 3), (two, h // 2), (w - 3, h // 2), (w // 4, two), (w * 3 // 4, two), (two + 2, two + 2), (w - 5, two + 2)]
        line = [np.nonzero((y == at_y) & (x >= 0) & (x < w))[0] for x, at_y in places]
        at = np.concatenate([lines.ends[k] + x[k] for k, (x, _y) in zip(line, places, strict=True)])
        r, g, b, a = channels(lines.values["px"][at])
        on = a >= 16
        return {"image_id": lines.image_id[np.concatenate(line)][on], "r": r[on], "g": g[on], "b": b[on]}

    return found(as_rows(pixels), run, ["px"], "image_id long, r int, g int, b int", False)


def backdrop_color(samples: DataFrame) -> DataFrame:
    """image_id, r, g, b: the upper median of each channel; images with fewer than three samples have none."""
    middle = lambda k: F.element_at(F.sort_array(F.collect_list(k)), (F.floor(F.count("*") / 2) + 1).cast("int")).alias(k)
    return samples.groupBy("image_id").agg(F.count("*").alias("n"), *(middle(k) for k in RGB)).filter("n >= 3").drop("n")


def _backdrop(lines: Lines, tolerance: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple[np.ndarray, ...]]:
    """(is backdrop, the image has a backdrop, it is light, channels) by place. Near the backdrop, by rules for light, dark and other backdrops; skin never is, nor are accents on a grey backdrop."""
    tol = float(max(4, min(100, tolerance)))
    told = [lines.extra[f"_bg_{k}"] for k in RGB]
    has = ~np.isnan(told[0].to_numpy(zero_copy_only=False).astype(float))[lines.line]
    bg = tuple(np.nan_to_num(v.to_numpy(zero_copy_only=False).astype(float))[lines.line] for v in told)
    r, g, b, a = channels(lines.values["px"])
    light, ch, skin = luminance(r, g, b), chroma(r, g, b), is_skin_tone(r, g, b)
    bg_l, bg_c, far = luminance(*bg), chroma(*bg), (r - bg[0]) ** 2 + (g - bg[1]) ** 2 + (b - bg[2]) ** 2
    pale, dark = (bg_l > 200) & (bg_c < 30), bg_l < 40
    accent = (bg_c < 25) & (ch > np.maximum(35, bg_c + 22))
    white = ((light >= 232) & (ch <= 18)) | ((light >= bg_l - 14) & (ch <= 20) & (far <= (tol * 1.35) ** 2)) | (far <= tol * tol)
    warm = (r > g + 10) & (r > b + 15) & (ch > 14)
    bright = np.zeros(len(a), bool)
    for dx, dy in SIDES:
        bright |= (lines.beside(a, dx, dy, 0) >= 16) & ((lines.beside(light, dx, dy, 0.0) - light > 48) | lines.beside(skin, dx, dy, False))
    near = np.where(pale, white & ~warm, (far <= tol * tol) & (~dark | ((light <= 42) & ~bright)))
    return has & ((a < 16) | (near & ~skin & ~accent)), has, pale, (r, g, b, a)


def _with_backdrop(rows: DataFrame, backdrop: DataFrame) -> DataFrame:
    return rows.join(backdrop.select("image_id", *(C(k).alias(f"_bg_{k}") for k in RGB)).hint("merge"), "image_id", "left")


_BG = [f"_bg_{k}" for k in RGB]


def is_backdrop_pixel(rows: DataFrame, backdrop: DataFrame, tolerance: float = 42) -> DataFrame:
    """Rows with px, dealt by image -> with is_backdrop, an array of 1 and 0; null without a backdrop."""

    def run(lines: Lines) -> dict[str, np.ndarray]:
        found, has, *_ = _backdrop(lines, tolerance)
        return {"is_backdrop": np.where(has, found, -1).astype(np.int32)}

    return map_lines(_with_backdrop(rows, backdrop), run, ["px"], {"is_backdrop": "int"}, extra=_BG)


def haloes(lines: Lines, fit: np.ndarray, clear: np.ndarray, passes: int = 4) -> np.ndarray:
    """Of the places that fit those that go, visited in raster order and in place, `passes` times at most: one goes if a side of it is clear or has gone.

    In a pass a place sees what goes above it and to its left, so what begins beside something clear spreads to the right and down; each place is
    looked at once a pass, however long the way.
    """
    gone = np.zeros(len(fit), bool)
    for _ in range(passes):
        open_ = clear | gone
        new = np.nonzero(fit & ~gone & np.logical_or.reduce([lines.beside(open_, dx, dy, False) for dx, dy in SIDES]))[0]
        if not len(new):
            break
        while len(new):
            gone[new] = True
            right = new[lines.x[new] < lines.wide[new] - 1] + 1
            down = new[lines.y[lines.line[new]] < lines.h[lines.line[new]] - 1]
            new = np.unique(np.concatenate([right, down + lines.wide[down]]))
            new = new[fit[new] & ~gone[new]]
    return gone


def lone(lines: Lines, fit: np.ndarray, opaque: np.ndarray) -> np.ndarray:
    """Of the places that fit those that go, visited in raster order and in place, once: one goes if at most one of its eight opaque neighbours is left."""
    left = sum(lines.beside(opaque, dx, dy, False).astype(np.int8) for dx, dy in SQUARE if dx or dy)
    gone = np.zeros(len(fit), bool)
    new = np.nonzero(fit & (left <= 1))[0]
    while len(new):
        gone[new] = True
        later = []
        for dx, dy in ((1, 0), (-1, 1), (0, 1), (1, 1)):
            x, y = lines.x[new] + dx, lines.y[lines.line[new]] + dy
            later.append((new + dx + dy * lines.wide[new])[(x >= 0) & (x < lines.wide[new]) & (y < lines.h[lines.line[new]])])
        later = np.concatenate(later)
        np.subtract.at(left, later, 1)
        new = np.unique(later)
        new = new[fit[new] & ~gone[new] & (left[new] <= 1)]
    return gone


def _halo_fit(lines: Lines, rgba: tuple[np.ndarray, ...], pale: np.ndarray, bg_l: np.ndarray) -> np.ndarray:
    r, g, b, a = rgba
    return pale & lines.inner & (a >= 128) & ~is_skin_tone(r, g, b) & (luminance(r, g, b) >= np.maximum(236.0, bg_l - 8)) & (chroma(r, g, b) <= 18)


def clear_halos(rows: DataFrame, backdrop: DataFrame) -> DataFrame:
    """Rows with px -> the near-white fringe of clear areas cleared, on light backdrops: raster order, in place, at most four times."""

    def run(lines: Lines) -> dict[str, np.ndarray]:
        _f, has, pale, rgba = _backdrop(lines, 42)
        bg_l = luminance(*(np.nan_to_num(lines.extra[k].to_numpy(zero_copy_only=False).astype(float))[lines.line] for k in _BG))
        gone = haloes(lines, _halo_fit(lines, rgba, pale & has, bg_l), rgba[3] < 16)
        return {"px": cleared(lines.values["px"], gone)}

    return map_lines(_with_backdrop(rows, backdrop), run, ["px"], {"px": "px"}, extra=_BG)


def despeckle(rows: DataFrame) -> DataFrame:
    """Rows with px -> interior opaque places, but skin, that have at most one opaque neighbour of eight cleared: raster order, in place, once."""

    def run(lines: Lines) -> dict[str, np.ndarray]:
        r, g, b, a = channels(lines.values["px"])
        return {"px": cleared(lines.values["px"], lone(lines, lines.inner & (a >= 128) & ~is_skin_tone(r, g, b), a >= 128))}

    return map_lines(rows, run, ["px"], {"px": "px"})


def cleared(px: np.ndarray, gone: np.ndarray) -> np.ndarray:
    """Packed colours with an alpha of 0 where they have gone."""
    return np.where(gone, px & 0xFFFFFF, px)


def remove_background(rows: DataFrame, tolerance: float = 42) -> DataFrame:
    """Rows with px -> with px cleared, cleared (an array: gone by the flood or as halo) and bg, the backdrop's colour.

    The predicate doesn't depend on what is cleared already, so the flood is what the frame reaches through backdrop pixels. Halos are cleared on light
    backdrops, then lone pixels; images without a backdrop, or whose frame has no backdrop pixel, stay as they are. Each image is read once.
    """
    edge = rows.filter(C("y").isin(2, 4) | (C("y") == C("h") - 3) | (C("y") == F.floor(C("h") / 2)))
    known = backdrop_color(edge_samples(edge))

    def run(lines: Lines) -> dict[str, np.ndarray]:
        found, has, pale, (r, g, b, a) = _backdrop(lines, tolerance)
        flood = touching_frame(lines, found)
        images, image = np.unique(lines.image_id, return_inverse=True)
        some = np.zeros(len(images), bool)
        some[image[lines.line[flood]]] = True
        hit = some[image][lines.line]
        bg_l = luminance(*(np.nan_to_num(lines.extra[k].to_numpy(zero_copy_only=False).astype(float))[lines.line] for k in _BG))
        now = np.where(flood, 0, a)
        halo = haloes(lines, _halo_fit(lines, (r, g, b, now), pale & has & hit, bg_l), now < 16)
        now = np.where(halo, 0, now)
        specks = lone(lines, hit & lines.inner & (now >= 128) & ~is_skin_tone(r, g, b), now >= 128)
        return {"px": cleared(lines.values["px"], flood | halo | specks), "cleared": (flood | halo) & (a != 0)}

    out = _with_backdrop(rows, known).withColumn("bg", F.when(C("_bg_r").isNotNull(), F.struct(*(C(f"_bg_{k}").alias(k) for k in RGB))))
    keep = [c for c in rows.columns if c not in (*LINE, "px")] + ["bg"]
    return map_lines(out, run, ["px"], {"px": "px", "cleared": "boolean"}, keep=keep, extra=_BG)


def white_paper(rows: DataFrame) -> DataFrame:
    """Rows with px -> laid on white paper, as composite_on_white() does."""

    def run(lines: Lines) -> dict[str, np.ndarray]:
        *rgb, a = channels(lines.values["px"])
        t = a / 255.0
        r, g, b = (np.where(a == 255, c, np.where(a == 0, 255, np.floor(c * t + 255 * (1 - t) + 0.5))).astype(np.int64) for c in rgb)
        return {"px": (255 << 24 | r << 16 | g << 8 | b).astype(np.uint32).view(np.int32)}

    return map_lines(rows, run, ["px"], {"px": "px"}, images=False)


def composite_on_white(pixels: DataFrame) -> DataFrame:
    """pixels laid on white paper, with filled: whether the pixel was not opaque."""
    t = C("a") / F.lit(255.0)
    over = lambda k: F.when(C("a") == 255, C(k)).when(C("a") == 0, 255).otherwise(rounded(C(k) * t + 255 * (1 - t)))
    out = pixels.withColumn("filled", C("a") != 255)
    return out.withColumns({**{k: over(k).cast("int") for k in RGB}, "a": F.lit(255)})


def cleared_count(rows: DataFrame) -> DataFrame:
    """image_id, cleared, bg of remove_background()'s result. Lone pixels removed at the end don't count."""
    return rows.groupBy("image_id").agg(F.sum(F.size(F.filter("cleared", lambda v: v))).alias("cleared"), F.first("bg").alias("bg"))
