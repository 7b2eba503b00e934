"""Outline cells: areas between ink lines, each flooded with its main colour."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lithoframe.operators.packed import Lines, channels, components, dilated, eroded, map_lines, pack_color, pack_rows, snapped, touching_frame, unpack_rows, with_slots

C = F.col


def dominant_cell_color(cells: DataFrame, least_share: float = 0.04) -> DataFrame:
    """cells(image_id, cell, label, a) pixels -> image_id, cell, label, colours: the most frequent label of the cell's pixels with an alpha over 96, the lowest among equals, of those with a share of 4 % at least; cells without one are left out."""
    counts = cells.filter("cell is not null and a > 96 and label is not null").groupBy("image_id", "cell", "label").agg(F.count("*").alias("n"))
    counts = counts.withColumn("share", C("n") / F.sum("n").over(Window.partitionBy("image_id", "cell"))).filter(C("share") >= least_share)
    return counts.groupBy("image_id", "cell").agg(F.max_by("label", F.struct("n", -C("label"))).alias("label"), F.count("*").alias("colours"))


def cell_counts(dominant: DataFrame) -> DataFrame:
    """image_id, cell_count, cells_fixed: how many cells have a colour, and how many have more than one."""
    return dominant.groupBy("image_id").agg(F.count("*").alias("cell_count"), F.count_if(C("colours") > 1).alias("cells_fixed"))


def flooded(lines: Lines, label: np.ndarray, ink: np.ndarray, alpha: np.ndarray, least_share: float = 0.04) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(label, cell_count, cells_fixed) of whole images: each place's cell takes its main colour, as in dominant_cell_color(); the counts are by image. A cell is a component of what is neither ink nor exterior; all of it, clear places too, takes its main colour."""
    cell = components(lines, np.where(ink | touching_frame(lines, (alpha <= 96) & ~ink), -1, 0))
    at = np.nonzero((cell >= 0) & (alpha > 96) & (label >= 0))[0]
    wide, cells_ = int(label.max(initial=0)) + 1, int(cell.max(initial=-1)) + 1
    keys, n = np.unique(cell[at] * wide + label[at], return_counts=True)
    part, colour = np.divmod(keys, wide)
    fit = n / np.bincount(part, n, cells_)[part] >= least_share
    part, colour, n = part[fit], colour[fit], n[fit]
    order = np.lexsort((-colour, n, part))  # the best of a cell comes last
    best, colours = np.full(cells_ + 1, -1), np.bincount(part, minlength=cells_)
    best[part[order]] = colour[order]
    image, first = np.concatenate([[0], np.cumsum(lines.image_id[1:] != lines.image_id[:-1])]), np.unique(cell, return_index=True)[1][-cells_ or len(cell) + 1 :]
    of = image[lines.line[first]]
    count = lambda v: np.bincount(of, v, int(image[-1]) + 1).astype(np.int64)
    return best[cell].astype(np.int32), count(colours > 0), count(colours > 1)


def filled(lines: Lines, label: np.ndarray, ink: np.ndarray, alpha: np.ndarray) -> np.ndarray:
    """Labels of whole images with unlabelled pockets inside the subject labelled. The subject, closed by 4 px, bounds what is outside; only images with pockets reach the ordered helper."""
    subject = ink | (label >= 0) | (alpha > 96)
    closed = eroded(lines, dilated(lines, subject, 4.0), 4.0)
    hole = components(lines, np.where((label < 0) & ~ink & ~touching_frame(lines, ~closed), 0, -1))
    new = label.copy()
    first = np.nonzero(np.append(True, lines.image_id[1:] != lines.image_id[:-1]))[0]
    ends = lines.ends[np.append(first, len(lines.y))]
    for k in np.unique(np.searchsorted(ends, np.nonzero(hole >= 0)[0], "right") - 1).tolist():
        own, shape = np.s_[ends[k] : ends[k + 1]], (-1, int(lines.w[first[k]]))
        mine = hole[own].reshape(shape)
        new[own] = np.where(mine < 0, label[own].reshape(shape), _fill(label[own].reshape(shape), ink[own].reshape(shape), mine + 1)).reshape(-1)
    return new


def snapped_labels(lines: Lines) -> np.ndarray:
    """The nearest slot of each place's colour; without a palette, the rank of its 12-step colour bin within its image."""
    if "_palette" in lines.extra:
        return snapped(lines)
    image = np.concatenate([[0], np.cumsum(lines.image_id[1:] != lines.image_id[:-1])])[lines.line].astype(np.int64)
    r, g, b, _a = channels(lines.values["px"])
    keys, back = np.unique(((image * 22 + r // 12) * 22 + g // 12) * 22 + b // 12, return_inverse=True)
    first = np.searchsorted(keys, np.arange(int(image[-1]) + 1) * 22**3)
    return (back - first[image]).astype(np.int32)


def map_cells(rows: DataFrame, palette: DataFrame | None, f: Callable[..., tuple[np.ndarray, ...]], extra: list[str] | None = None) -> DataFrame:
    """Rows with px and ink -> with label and, by image, cell_count and cells_fixed (null where no cell has a colour); f(lines, labels snapped to the palette, ink, alpha) gives these. `extra` as in packed.map_lines()."""

    def run(lines: Lines) -> dict[str, np.ndarray]:
        ink, alpha = lines.values["ink"].astype(bool), channels(lines.values["px"])[3]
        label, count, fixed = f(lines, snapped_labels(lines), ink, alpha)
        image = np.concatenate([[0], np.cumsum(lines.image_id[1:] != lines.image_id[:-1])])
        return {"label": label, **{k: np.where(count > 0, v, -1)[image] for k, v in (("cell_count", count), ("cells_fixed", fixed))}}

    rows = rows if palette is None else with_slots(rows, palette, ["idx", "r", "g", "b"])
    return map_lines(rows, run, ["px", "ink"], {"label": "int", "cell_count": "by line", "cells_fixed": "by line"}, keep=[], extra=[*(extra or []), *([] if palette is None else ["_palette"])])


def flood_dominant_cells(rows: DataFrame, palette: DataFrame | None = None) -> DataFrame:
    """Rows with px and ink -> rows with label, cell_count and cells_fixed, as flooded() finds them."""
    return map_cells(rows, palette, flooded)


def counts_of(rows: DataFrame) -> DataFrame:
    """image_id, cell_count, cells_fixed of map_cells()' rows, for images with coloured cells."""
    return rows.groupBy("image_id").agg(*(F.first(k).alias(k) for k in ("cell_count", "cells_fixed"))).filter("cell_count is not null")


def _fill(labels: np.ndarray, ink: np.ndarray, hole: np.ndarray) -> np.ndarray:
    """Labels (-1 for none) of one image with its holes (numbered from 1) filled, in the order of their first pixels; each takes the label most frequent around its pixels within 1, 2, 4, 8 or 14."""
    out = labels.copy()
    ys, xs = np.nonzero(hole)
    order = np.argsort(hole[ys, xs], kind="stable")
    ys, xs = ys[order], xs[order]
    number, first = np.unique(hole[ys, xs], return_index=True)
    for k, y, x in zip(number, np.split(ys, first[1:]), np.split(xs, first[1:]), strict=True):
        for radius in (1, 2, 4, 8, 14):
            # All that the hole's pixels see lies in one box; the labels in it are counted in squares by sums over the box.
            top, left = max(0, y.min() - radius), max(0, x.min() - radius)
            box = np.s_[top : y.max() + radius + 1, left : x.max() + radius + 1]
            near = np.where((hole[box] != k) & ~ink[box], out[box], -1)
            h, w = near.shape
            y0, y1, x0, x1 = np.maximum(y - top - radius, 0), np.minimum(y - top + radius + 1, h), np.maximum(x - left - radius, 0), np.minimum(x - left + radius + 1, w)
            votes = {}
            for v in np.unique(near[near >= 0]).tolist():
                sums = np.zeros((h + 1, w + 1), np.int64)
                sums[1:, 1:] = (near == v).cumsum(0).cumsum(1)
                votes[v] = int((sums[y1, x1] - sums[y0, x1] - sums[y1, x0] + sums[y0, x0]).sum())
            votes = {v: n for v, n in votes.items() if n}
            if votes:
                out[y, x] = min(votes, key=lambda v: (-votes[v], v))
                break
    return out


def fill_enclosed(pixels: DataFrame) -> DataFrame:
    """A pixel table (a, ink, label) with unlabelled pockets inside the subject labelled, as filled() does."""
    rows = pack_rows(pixels, {"px": pack_color(F.lit(0), F.lit(0), F.lit(0), C("a")), "ink": C("ink"), "label": C("label")})

    def run(lines: Lines) -> dict[str, np.ndarray]:
        return {"label": filled(lines, lines.values["label"], lines.values["ink"].astype(bool), channels(lines.values["px"])[3])}

    out = unpack_rows(map_lines(rows, run, ["px", "ink", "label"], {"label": "int"}, keep=["px", "ink"]), ["px", "ink", "label"])
    return out.select("image_id", "w", "h", "x", "y", "a", "ink", "label")
