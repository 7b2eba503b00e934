"""Rasters derived from the driver's tables by integer arithmetic, so that another engine derives the same."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

C = F.col
#: Base colours of the kinds of pixels in a derived raster.
KINDS = {0: (10, 10, 14), 1: (250, 250, 250), 2: (232, 14, 43), 3: (243, 209, 176), 4: (134, 98, 84), 5: (20, 40, 110), 6: (255, 208, 19), 8: (226, 224, 231), 9: (0, 0, 0), 10: (250, 250, 250), 11: (14, 14, 14), 12: (64, 140, 200)}
#: Kinds that make the test palette, in the order of idx.
PALETTE = (0, 1, 2, 3, 4, 5, 6, 12)


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One image per part: image_id, name, w, h, aspect and the settings of its pin."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    key, size = C("p_partkey").cast("long"), C("p_size").cast("int")
    out = part.select(key.alias("image_id"), C("p_name").alias("name"), (16 + size % 17).cast("int").alias("w"), (16 + size * 7 % 17).cast("int").alias("h"), (10 + size).alias("pin_width_mm"), F.when(key % 3 != 0, 10 + key % 20).cast("int").alias("pin_height_mm"), (150 + 50 * (key % 6)).cast("int").alias("dpi"))
    return out.withColumn("aspect", C("w") / C("h"))


def _base(channel: int) -> Column:
    return F.element_at(F.create_map(*(F.lit(v) for k, c in KINDS.items() for v in (k, c[channel]))), C("kind"))


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id, w, h, x, y, r, g, b, a: dense rasters of 16 to 32 px a side."""
    grid = images(spark, sf_dir).select("image_id", "w", "h", F.explode(F.sequence(F.lit(0), C("h") - 1)).alias("y"))
    grid = grid.select("image_id", "w", "h", F.explode(F.sequence(F.lit(0), C("w") - 1)).alias("x"), "y")
    n = (C("x") * 73 + C("y") * 151 + C("image_id") * 197 + C("x") * C("y") * 31) % 97
    grid = grid.withColumns({"n": n.cast("int"), "dx": C("x") - F.floor(C("w") / 2).cast("int"), "dy": C("y") - F.floor(C("h") / 2).cast("int"), "rad": (F.floor(F.least("w", "h") / 2) - 2).cast("int"), "q": (C("image_id") % 4).cast("int")})
    far = C("dx") * C("dx") + C("dy") * C("dy")
    kind = (
        F.when((C("n") == 1) & (C("q") == 0), 9)
        .when(far > C("rad") * C("rad"), F.when(C("n") == 3, 8).otherwise(10 + (C("image_id") % 3).cast("int")))
        .when(far > (C("rad") - 2) * (C("rad") - 2), 0)
        .when((C("dx") - 2) * (C("dx") - 2) + (C("dy") + 2) * (C("dy") + 2) <= 2, 1)
        .when(C("n") == 0, 6)
        .otherwise(2 + ((C("dx") >= 0).cast("int") + 2 * (C("dy") >= 0).cast("int") + C("q")) % 4)
    )
    grid = grid.withColumn("kind", kind)
    shade = lambda k: F.greatest(F.lit(0), F.least(F.lit(255), _base(k) + C("n") % 5 - 2)).alias("rgb"[k])
    alpha = F.when(C("kind") == 9, 0).when((C("n") == 2) & (C("q") == 0), 90).otherwise(255)
    return grid.select("image_id", "w", "h", "x", "y", shade(0), shade(1), shade(2), alpha.alias("a"))


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rasters, packed: image_id, w, h, y and px, an array of 0xAARRGGBB for each line of pixels; the lines of an image lie in one task."""
    shown = np.array([KINDS.get(k, (0, 0, 0)) for k in range(max(KINDS) + 1)], np.int64)
    # The packed colour of each kind under each of the five shades.
    tones = sum(np.clip(shown[:, None, k] + np.arange(5) - 2, 0, 255) << shift for k, shift in enumerate((16, 8, 0)))

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            image, w, h, y = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("image_id", "w", "h", "y"))
            ends = np.concatenate([[0], np.cumsum(w)])
            line = np.repeat(np.arange(len(w)), w)
            x, of = np.arange(ends[-1]) - ends[line], lambda v: v[line]  # what depends on the line alone is computed by line
            n = (x * of((73 + y * 31) % 97) + of((y * 151 + image * 197) % 97)) % 97
            dx, q, dy, rad = x - of(w // 2), of(image % 4), y - h // 2, np.minimum(w, h) // 2 - 2
            far = dx * dx + of(dy * dy)
            tests = [(n == 1) & (q == 0), far > of(rad * rad), far > of((rad - 2) ** 2), (dx - 2) ** 2 + of((dy + 2) ** 2) <= 2, n == 0]
            kind = np.select(tests, [9, np.where(n == 3, 8, of(10 + image % 3)), 0, 1, 6], 2 + ((dx >= 0) + of(2 * (dy >= 0) + image % 4)) % 4)
            alpha = np.where(kind == 9, 0, np.where((n == 2) & (q == 0), 90, 255))
            px = (alpha << 24 | tones[kind, n % 5]).astype(np.uint32).view(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(px))], ["image_id", "w", "h", "y", "px"])

    # Images are dealt out before they are drawn: a table of few files would be drawn in few tasks, and pixels are not shuffled.
    dealt = images(spark, sf_dir).select("image_id", "w", "h").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "image_id")
    lines = dealt.select("image_id", "w", "h", F.explode(F.sequence(F.lit(0), C("h") - 1)).alias("y"))
    return lines.mapInArrow(draw, "image_id long, w int, h int, y int, px array<int>")


def palette(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id, idx, r, g, b: the same eight colours for every image."""
    colours = F.array(*(F.struct(F.lit(i).alias("idx"), *(F.lit(v).alias(k) for k, v in zip("rgb", KINDS[kind], strict=True))) for i, kind in enumerate(PALETTE)))
    return images(spark, sf_dir).select("image_id", F.explode(colours).alias("c")).select("image_id", "c.idx", "c.r", "c.g", "c.b")


def merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id, seq, a, b: a pair for even images, a chain, and pairs that are out of range or name one slot twice."""
    pairs = F.array(*(F.struct(F.lit(s).alias("seq"), F.lit(a).alias("a"), F.lit(b).alias("b")) for s, (a, b) in enumerate([(3, 4), (1, 2), (2, 3), (0, 99), (5, 5)])))
    return images(spark, sf_dir).select("image_id", F.explode(pairs).alias("m")).select("image_id", "m.seq", "m.a", "m.b").filter((C("seq") > 0) | (C("image_id") % 2 == 0))


def disabled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id, idx: none, some or all slots by image."""
    slots = F.when(C("image_id") % 3 == 0, F.array().cast("array<int>")).when(C("image_id") % 3 == 1, F.array(F.lit(2), F.lit(4))).otherwise(F.array(*map(F.lit, range(len(PALETTE)))))
    return images(spark, sf_dir).select("image_id", F.explode(slots).alias("idx"))


def overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id, idx, code: chart codes as people write them, and one that the chart lacks."""
    codes = F.array(*(F.struct(F.lit(i).alias("idx"), F.lit(c).alias("code")) for i, c in enumerate(["pms 185 c", "PANTONE 185C", " Black 6 C ", "999 ZZ"])))
    return images(spark, sf_dir).select("image_id", F.explode(codes).alias("o")).select("image_id", "o.idx", "o.code")
