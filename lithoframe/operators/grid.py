"""Neighbourhoods on dense pixel grids.

A table holds every pixel of an image (image_id, w, h, x, y and values), transparent ones as rows with null labels. Neighbours come from windows over
rows and columns; both are satisfied by one exchange on image_id, which by_image() makes. No operator joins shifted copies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

C = F.col
KEY = ["image_id", "x", "y"]


def row() -> WindowSpec:
    return Window.partitionBy("image_id", "y").orderBy("x")


def column() -> WindowSpec:
    return Window.partitionBy("image_id", "x").orderBy("y")


def by_image(df: DataFrame) -> DataFrame:
    """The table dealt by image_id, once, before any chain of grid operators."""
    return df.repartition("image_id")


def interior() -> Column:
    return (C("x") > 0) & (C("y") > 0) & (C("x") < C("w") - 1) & (C("y") < C("h") - 1)


def with_square(df: DataFrame, value: str | Column, name: str = "_n") -> DataFrame:
    """An array of the 3x3 values in row-major order; null outside the image."""
    v = C(value) if isinstance(value, str) else value
    df = df.withColumn("_v", v)
    df = df.withColumn("_row", F.array(F.lag("_v").over(row()), C("_v"), F.lead("_v").over(row())))
    gap = F.array(*[F.lit(None).cast(df.schema["_v"].dataType)] * 3)
    up, down = (F.coalesce(f("_row").over(column()), gap) for f in (F.lag, F.lead))
    return df.withColumn(name, F.concat(up, C("_row"), down)).drop("_v", "_row")


def with_sides(df: DataFrame, value: str, name: str = "_s") -> DataFrame:
    """An array of the values above, to the left, to the right and below; null outside the image."""
    return df.withColumn(name, F.array(F.lag(value).over(column()), F.lag(value).over(row()), F.lead(value).over(row()), F.lead(value).over(column())))


def most_frequent(values: list[Column]) -> tuple[Column, Column]:
    """(value, times) of the most frequent of some non-negative numbers, the first among equals; times is 0 if all are null. Pairs are compared in generated code."""
    shown = [F.coalesce(v, F.lit(-1 - k)) for k, v in enumerate(values)]  # nulls equal nothing
    n = len(shown)
    same = {(j, k): (shown[j] == shown[k]).cast("int") for k in range(n) for j in range(k)}
    times = [F.lit(1) + sum((same[min(j, k), max(j, k)] for j in range(n) if j != k), F.lit(0)) for k in range(n)]
    best = F.greatest(*(F.when(v >= 0, t * n + (n - 1 - k)).otherwise(k - n) for k, (v, t) in enumerate(zip(shown, times, strict=True))))
    return F.element_at(F.array(*values), n - F.pmod(best, F.lit(n)).cast("int")), F.greatest(F.floor(best / n).cast("int"), F.lit(0))


def with_label_square(labels: DataFrame) -> DataFrame:
    """labels with the 3x3 labels in row-major order as columns _n0 to _n8; null outside the image. A row of three is packed into one long on its way to the rows beside it, 20 bits a label: labels must be under a million."""
    none, wide = F.lit(0).cast("long"), 1 << 20
    out = labels.withColumn("_c", F.coalesce(C("label").cast("long") + 1, none))
    out = out.withColumn("_row", F.coalesce(F.lag("_c").over(row()), none) * (wide * wide) + C("_c") * wide + F.coalesce(F.lead("_c").over(row()), none))
    out = out.withColumns({"_up": F.coalesce(F.lag("_row").over(column()), none), "_down": F.coalesce(F.lead("_row").over(column()), none)})
    part = lambda c, k: (F.nullif(F.shiftright(c, 40 - 20 * k).bitwiseAND(wide - 1), none) - 1).cast("int")
    return out.withColumns({f"_n{3 * j + k}": part(C(c), k) for j, c in enumerate(("_up", "_row", "_down")) for k in range(3)}).drop("_c", "_row", "_up", "_down")


_NINE = [f"_n{k}" for k in range(9)]


def denoise_labels(labels: DataFrame, passes: int = 1) -> DataFrame:
    """Interior opaque pixels take the most frequent label of their 3x3 square, the first in row-major order among equals."""
    for _ in range(passes):
        labels = with_label_square(labels)
        value, _times = most_frequent([C(k) for k in _NINE])
        mixed = ~(C("_n0").eqNullSafe(C("_n4")) & C("_n1").eqNullSafe(C("_n4")) & C("_n2").eqNullSafe(C("_n4")) & C("_n3").eqNullSafe(C("_n4")) & C("_n5").eqNullSafe(C("_n4")) & C("_n6").eqNullSafe(C("_n4")) & C("_n7").eqNullSafe(C("_n4")) & C("_n8").eqNullSafe(C("_n4")))
        labels = labels.withColumn("label", F.when(C("label").isNotNull() & interior() & mixed, value).otherwise(C("label"))).drop(*_NINE)
    return labels


def smooth_label_boundaries(labels: DataFrame, passes: int = 2) -> DataFrame:
    """Interior opaque pixels beside a different value take a label that holds five of their nine places."""
    for _ in range(passes):
        labels = with_label_square(labels)
        edge = ~(C("_n1").eqNullSafe(C("label")) & C("_n3").eqNullSafe(C("label")) & C("_n5").eqNullSafe(C("label")) & C("_n7").eqNullSafe(C("label")))
        value, times = most_frequent([C(k) for k in _NINE])
        labels = labels.withColumn("label", F.when(C("label").isNotNull() & interior() & edge & (times >= 5), value).otherwise(C("label"))).drop(*_NINE)
    return labels


def overlap_adjacent_fills(labels: DataFrame) -> DataFrame:
    """An opaque pixel takes another label that two or more of its sides hold; up, left, right, down decide between equals."""
    sides = {"_up": F.lag("label").over(column()), "_left": F.lag("label").over(row()), "_right": F.lead("label").over(row()), "_down": F.lead("label").over(column())}
    labels = labels.withColumns(sides)
    value, times = most_frequent([F.when(C(k) != C("label"), C(k)) for k in sides])
    return labels.withColumn("label", F.when(C("label").isNotNull() & (times >= 2), value).otherwise(C("label"))).drop(*sides)


def remove_isolated_ink(mask: DataFrame, max_on: int = 2) -> DataFrame:
    """Interior ink with at most max_on ink pixels in its square, itself included, goes."""
    mask = with_square(mask, C("ink").cast("int"), "_i")
    on = sum((F.coalesce(C("_i")[k], F.lit(0)) for k in range(9)), F.lit(0))
    return mask.withColumn("ink", C("ink") & ~(interior() & (on <= max_on))).drop("_i")


def metal_segments(labels: DataFrame) -> DataFrame:
    """image_id, x1, y1, x2, y2: the unit segment between two opaque neighbours of different labels, smaller end first."""
    labels = labels.withColumns({"_r": F.lead("label").over(row()), "_d": F.lead("label").over(column())})
    wall = lambda c, x1, y1, x2, y2: F.when(C("label") != C(c), F.struct(x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2")))
    x, y = C("x"), C("y")
    both = F.array_compact(F.array(wall("_r", x + 1, y, x + 1, y + 1), wall("_d", x, y + 1, x + 1, y + 1)))
    return labels.select("image_id", F.explode(both).alias("s")).select("image_id", "s.*")


def dedupe_segments(segments: DataFrame) -> DataFrame:
    """Segments whichever way they point, each once, smaller end first."""
    a, b = F.struct(C("x1").alias("x"), C("y1").alias("y")), F.struct(C("x2").alias("x"), C("y2").alias("y"))
    low, high = F.least(a, b), F.greatest(a, b)
    return segments.select("image_id", low["x"].alias("x1"), low["y"].alias("y1"), high["x"].alias("x2"), high["y"].alias("y2")).dropDuplicates()


def region_borders(regions: DataFrame) -> DataFrame:
    """image_id, region, label, other, other_label, sides: how many pixel sides two regions share, in both directions. Rows need region and label."""
    own = F.struct("region", "label")
    rows = regions.withColumns({"_o": F.when(C("region").isNotNull(), own)})
    rows = rows.withColumns({"_r": F.lead("_o").over(row()), "_d": F.lead("_o").over(column())})
    touch = F.filter(F.array("_r", "_d"), lambda o: o["region"] != C("region"))
    pairs = rows.select("image_id", C("_o"), F.explode(touch).alias("t")).select("image_id", F.explode(F.array(F.struct(C("_o").alias("p"), C("t").alias("q")), F.struct(C("t").alias("p"), C("_o").alias("q")))).alias("s"))
    both = pairs.groupBy("image_id", "s.p", "s.q").agg(F.count("*").alias("sides"))
    return both.select("image_id", "p.region", "p.label", C("q.region").alias("other"), C("q.label").alias("other_label"), "sides")


def resample_nearest(raster: DataFrame, dims: DataFrame, values: list[str]) -> DataFrame:
    """raster(image_id, w, h, x, y, values) and dims(image_id, w, h) -> the raster at the new size; each new pixel takes the one below its centre."""
    new = dims.select("image_id", C("w").alias("nw"), C("h").alias("nh"))
    source = raster.groupBy("image_id").agg(F.first("w").alias("sw"), F.first("h").alias("sh"))
    grid = new.join(source, "image_id").select("*", F.explode(F.sequence(F.lit(0), C("nh") - 1)).alias("ny"))
    grid = grid.select("*", F.explode(F.sequence(F.lit(0), C("nw") - 1)).alias("nx"))
    at = lambda v, s, n: F.least(C(s) - 1, F.floor((C(v) + 0.5) * C(s) / C(n)).cast("int"))
    grid = grid.select("image_id", "nw", "nh", "nx", "ny", at("nx", "sw", "nw").alias("x"), at("ny", "sh", "nh").alias("y"))
    out = grid.join(raster.select(*KEY, *values), KEY)
    return out.select("image_id", C("nw").alias("w"), C("nh").alias("h"), C("nx").alias("x"), C("ny").alias("y"), *values)
