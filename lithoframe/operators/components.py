"""Connected components of pixels, found on runs.

Spark reduces each image to runs; one grouped task an image unites overlapping runs of neighbouring rows. An image of the largest size allowed here
has some thousand to a million runs, so it fits a task; a corpus is dealt by image_id.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lithoframe.operators.grid import KEY, by_image, interior, region_borders
from lithoframe.operators.runs import color_runs, with_run_start
from lithoframe.staging import stage

C = F.col


def unite(y: np.ndarray, x0: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """The component of each run, runs being sorted by (y, x0): the number of the run that is first in it. Runs of equal keys that share a side are one component."""
    wide = int((x0 + size).max(initial=0)) + 1
    start, stop = y.astype(np.int64) * wide + x0, y.astype(np.int64) * wide + x0 + size
    low, high = np.searchsorted(stop, start + wide, "right"), np.searchsorted(start, stop + wide, "left")
    count = np.maximum(high - low, 0)
    a = np.repeat(np.arange(len(y)), count)
    b = np.arange(len(a)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)
    same = key[a] == key[b]
    a, b, label = a[same], b[same], np.arange(len(y))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def connected_components(runs: DataFrame, key: str = "label") -> DataFrame:
    """runs(image_id, y, x0, len, key) -> with region: components numbered from 0 by their first pixel in row-major order."""

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["y", "x0"], ignore_index=True)
        codes = pd.factorize(frame[key])[0]
        root = unite(frame["y"].to_numpy(), frame["x0"].to_numpy(), frame["len"].to_numpy(), codes)
        return frame.assign(region=np.unique(root, return_inverse=True)[1].astype(np.int64))

    schema = f"image_id long, y int, x0 int, len int, {key} {runs.schema[key].dataType.simpleString()}, region long"
    return runs.select("image_id", "y", "x0", "len", key).groupBy("image_id").applyInPandas(one, schema)


def with_regions(df: DataFrame, key: str = "label", name: str = "region") -> DataFrame:
    """df, a dense grid, with the component of each pixel whose key is not null, and its `{name}_area`."""
    df = stage(with_run_start(df, key, "_x0"), "runs")
    runs = df.filter(C(key).isNotNull()).groupBy("image_id", "y", "_x0").agg(F.count("*").cast("int").alias("len"), F.first(key).alias(key))
    found = connected_components(runs.withColumnRenamed("_x0", "x0"), key)
    area = F.sum("len").over(Window.partitionBy("image_id", "region"))
    found = found.select("image_id", "y", C("x0").alias("_x0"), C("region").alias(name), area.alias(f"{name}_area"))
    out = df.join(found, ["image_id", "y", "_x0"], "left").drop("_x0")
    hit = C(key).isNotNull()
    return out.withColumns({c: F.when(hit, C(c)) for c in (name, f"{name}_area")})


def label_regions(labels: DataFrame) -> DataFrame:
    """image_id, region, label, area. Runs are enough for it: no pixel meets its region."""
    found = connected_components(color_runs(by_image(labels)))
    return found.groupBy("image_id", "region").agg(F.first("label").alias("label"), F.sum("len").alias("area"))


def drop_speck_islands(labels: DataFrame, min_area: int | str) -> DataFrame:
    """Regions smaller than min_area (a number or a column) take the label that most of their sides touch, the lowest among equals, or become transparent. All decide on the state before."""
    least = F.lit(min_area) if isinstance(min_area, int) else C(min_area)
    labels = labels.withColumn("_least", least)
    found = by_image(stage(with_regions(labels), "regions"))
    small = found.filter(C("region_area") < C("_least")).select("image_id", "region").distinct()
    votes = region_borders(found.select("image_id", "x", "y", "region", "label")).join(small, ["image_id", "region"], "left_semi")
    votes = votes.groupBy("image_id", "region", "other_label").agg(F.sum("sides").alias("n"))
    best = votes.groupBy("image_id", "region").agg(F.max_by("other_label", F.struct("n", -C("other_label"))).alias("_new"))
    out = found.join(best, ["image_id", "region"], "left")
    return out.withColumn("label", F.when(C("region_area") < C("_least"), C("_new")).otherwise(C("label"))).drop("_new", "_least", "region", "region_area")


def remove_small_components(mask: DataFrame, min_area: int | str) -> DataFrame:
    """Ink components smaller than min_area go."""
    least = F.lit(min_area) if isinstance(min_area, int) else C(min_area)
    found = with_regions(mask.withColumn("_key", F.when(C("ink"), 1)), "_key", "_part")
    return found.withColumn("ink", C("ink") & (C("_part_area") >= least)).withColumn("ink", F.coalesce("ink", F.lit(False))).drop("_key", "_part", "_part_area")


def touching_frame(df: DataFrame, free: str, name: str) -> DataFrame:
    """df with a boolean: whether the pixel is free and reaches the image's frame through free pixels."""
    found = with_regions(df.withColumn("_key", F.when(C(free), 1)), "_key", "_part")
    edge = (C("x") == 0) | (C("y") == 0) | (C("x") == C("w") - 1) | (C("y") == C("h") - 1)
    reaches = F.max(edge).over(Window.partitionBy("image_id", "_part"))
    return found.withColumn(name, C("_part").isNotNull() & reaches).drop("_key", "_part", "_part_area")


def mark_exterior(pixels: DataFrame) -> DataFrame:
    """pixels with a and ink -> with exterior: clear (a of 96 at most), without ink, and connected to the frame."""
    return touching_frame(pixels.withColumn("_free", (C("a") <= 96) & ~C("ink")), "_free", "exterior").drop("_free")


def hole_rings(mask: DataFrame, walls: str = "wall") -> DataFrame:
    """Ink that has a hole, not connected to the frame, in its 3x3 square becomes wall too."""
    from lithoframe.operators.grid import with_square

    found = touching_frame(mask.withColumn("_free", ~C("ink")), "_free", "_outside").withColumn("_hole", (~C("ink") & ~C("_outside")).cast("int"))
    found = with_square(by_image(found), "_hole", "_h9")
    beside = F.exists("_h9", lambda v: F.coalesce(v == 1, F.lit(False)))
    return found.withColumn(walls, C(walls) | (C("ink") & beside)).drop("_free", "_outside", "_hole", "_h9")


__all__ = ["KEY", "connected_components", "drop_speck_islands", "hole_rings", "interior", "label_regions", "mark_exterior", "remove_small_components", "touching_frame", "unite", "with_regions"]
