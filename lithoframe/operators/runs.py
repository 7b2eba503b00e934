"""Runs of equal values in rows, and rectangles of equal runs: gaps and islands over windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lithoframe.operators.grid import row

C = F.col


def with_run_start(df: DataFrame, key: str = "label", name: str = "x0") -> DataFrame:
    """The x at which the run of equal keys that holds a pixel begins. Null is a key as any other."""
    new = F.coalesce(~F.lag(key).over(row()).eqNullSafe(C(key)), F.lit(True)) | (C("x") == 0)
    df = df.withColumn(name, F.when(new, C("x")))
    return df.withColumn(name, F.max(name).over(row().rowsBetween(Window.unboundedPreceding, 0)))


def color_runs(labels: DataFrame, key: str = "label") -> DataFrame:
    """image_id, y, x0, len, key: the maximal horizontal runs of pixels whose key is not null."""
    runs = with_run_start(labels, key).filter(C(key).isNotNull())
    return runs.groupBy("image_id", "y", "x0").agg(F.count("*").cast("int").alias("len"), F.first(key).alias(key))


def color_rects(labels: DataFrame, key: str = "label") -> DataFrame:
    """image_id, key, x, y, w, h: runs of one key, place and width on neighbouring rows, joined."""
    return stacked_runs(color_runs(labels, key), key)


def stacked_runs(runs: DataFrame, key: str = "label") -> DataFrame:
    """Runs (image_id, y, x0, len, key) -> rectangles (image_id, key, x, y, w, h)."""
    same = Window.partitionBy("image_id", key, "x0", "len").orderBy("y")
    runs = runs.withColumn("stack", C("y") - F.row_number().over(same))
    rects = runs.groupBy("image_id", key, "x0", "len", "stack").agg(F.min("y").alias("y"), F.count("*").cast("int").alias("h"))
    return rects.select("image_id", key, C("x0").alias("x"), "y", C("len").alias("w"), "h")


def joined_runs(runs: DataFrame, key: str = "label") -> DataFrame:
    """Runs of which neighbours may have come to hold one key (as labels were merged) -> maximal runs."""
    line = Window.partitionBy("image_id", "y").orderBy("x0")
    goes_on = C(key).eqNullSafe(F.lag(key).over(line)) & (C("x0") == F.lag(C("x0") + C("len")).over(line))
    runs = runs.withColumn("_first", F.when(~F.coalesce(goes_on, F.lit(False)), C("x0")))
    runs = runs.withColumn("_first", F.max("_first").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("image_id", "y", C("_first").alias("x0")).agg(F.sum("len").cast("int").alias("len"), F.first(key).alias(key))


def silhouette_rects(labels: DataFrame) -> DataFrame:
    """color_rects() of all opaque pixels as one key, 0."""
    return color_rects(labels.withColumn("label", F.when(C("label").isNotNull(), 0)))
