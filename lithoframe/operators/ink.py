"""Ink masks: what of an image is drawn line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lithoframe.functions.color import chroma, luminance
from lithoframe.operators.grid import interior, with_square
from lithoframe.operators.match import rgb

C = F.col


def float_luminance() -> Column:
    """Luminance stored in single precision, 255 where alpha is under 128, compared in double."""
    return F.when(C("a") < 128, 255.0).otherwise(luminance(*rgb()).cast("float").cast("double"))


def ink_stats(pixels: DataFrame) -> DataFrame:
    """image_id, opaque, darkish, lightish, avg_chroma, line_art, pure_mask, pure_binary, treat_as_color. Of the two shares of middle greys, the mask's reads single precision, the other double."""
    on = C("a") >= 128
    l64, l32 = luminance(*rgb()), float_luminance()
    share = lambda c: F.coalesce(F.count_if(on & c) / F.count_if(on), F.lit(0.0))
    out = pixels.groupBy("image_id").agg(
        F.count_if(on).alias("opaque"), F.count_if(on & (l64 < 70)).alias("darkish"), F.count_if(on & (l64 > 200)).alias("lightish"),
        F.coalesce(F.avg(F.when(on, chroma(*rgb()))), F.lit(0.0)).alias("avg_chroma"), share(l32.between(40, 215)).alias("_mid32"), share(l64.between(40, 215)).alias("_mid64"))
    line = (C("opaque") > 0) & (C("avg_chroma") < 28) & (C("darkish") / C("opaque") > 0.08) & ((C("darkish") + C("lightish")) / C("opaque") > 0.82)
    out = out.withColumn("line_art", F.coalesce(line, F.lit(False)))
    some = C("opaque") > 0
    return out.withColumns({"pure_mask": C("line_art") & some & (C("_mid32") < 0.002), "pure_binary": some & (C("_mid64") < 0.002), "treat_as_color": ~C("line_art") | (C("avg_chroma") >= 14)}).drop("_mid32", "_mid64")


def ink_mask(pixels: DataFrame, sensitivity: float = 60) -> DataFrame:
    """pixels with ink and the flags of ink_stats(): dark pixels by thresholds that depend on the image; pure black and white is copied; other art also gets the ring of its silhouette and the outer edge of dark fills."""
    t = max(0.0, min(100.0, float(sensitivity))) / 100
    stats = ink_stats(pixels).select("image_id", "line_art", "avg_chroma", "pure_mask", "pure_binary", "treat_as_color")
    rows = pixels.join(stats, "image_id").withColumns({"_l": float_luminance(), "_c": chroma(*rgb())})
    rows = with_square(rows, F.struct(C("_l").alias("l"), C("a").alias("a")), "_n")
    on, line, light = C("a") >= 128, C("line_art"), C("_l")
    ceiling, least = F.when(line, 55 + t * 100).otherwise(28 + t * 55), F.when(line, 6 + (1 - t) * 14).otherwise(14 + (1 - t) * 22)
    around = lambda ks: F.array(*(C("_n")[k] for k in ks))
    eight, four = around((0, 1, 2, 3, 5, 6, 7, 8)), around((1, 3, 5, 7))
    contrast = F.array_max(F.transform(eight, lambda v: v["l"])) - light
    dark = ((light <= ceiling * 0.55) & (C("_c") < 35)) | ((light <= ceiling) & (contrast >= least)) | (light <= 22) | (line & (light <= ceiling) & (C("_c") < 40)) | ((light <= 55 + t * 50) & (C("_c") >= 16))
    ink = F.when(C("pure_mask"), on & (light <= 40 + t * 80)).otherwise(interior() & on & (light <= ceiling + 40) & dark)
    ring = (light <= 210) & F.exists(four, lambda v: (v["a"] < 128) | (v["l"] >= 225))
    edge = (light <= 55 + t * 50) & F.exists(eight, lambda v: (v["a"] < 128) | (v["l"] >= 200) | (v["l"] - light >= 45))
    rows = rows.withColumns({"_base": F.coalesce(ink, F.lit(False)), "ring": F.coalesce(interior() & on & C("treat_as_color") & ring, F.lit(False)), "contour": F.coalesce(interior() & on & C("treat_as_color") & edge, F.lit(False))})
    return rows.withColumn("ink", C("_base") | C("ring") | C("contour")).drop("_l", "_c", "_n", "_base")
