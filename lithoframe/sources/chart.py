"""The spot-colour chart as a table of fixed size."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lithoframe.functions.color import rgb_to_hex
from lithoframe.sources.chart_rows import ROWS

_RAW = "ord int, code string, r int, g int, b int, lab_l double, lab_a double, lab_b double"


def _named(rows: DataFrame) -> DataFrame:
    return rows.select("ord", "code", F.concat(F.lit("PMS "), "code").alias("name"), "r", "g", "b", rgb_to_hex(F.col("r"), F.col("g"), F.col("b")).alias("hex"), "lab_l", "lab_a", "lab_b")


def chart_tuples() -> list[tuple]:
    return [(k, c[0], *map(int, c[1:4]), *map(float, c[4:7])) for k, line in enumerate(ROWS.splitlines()) if (c := line.split(","))]


def pms_chart(spark: SparkSession) -> DataFrame:
    """ord, code, name, r, g, b, hex and the stored Lab of the packaged chart."""
    return _named(spark.createDataFrame(chart_tuples(), _RAW))


def read_pms_chart(spark: SparkSession, path: str) -> DataFrame:
    """A chart from JSON with `colors` as rows of code, r, g, b, l, a, b; chart order is kept as ord."""
    rows = spark.read.json(path, multiLine=True).select(F.posexplode("colors").alias("ord", "c"))
    cells = [F.col("c")[k] for k in range(7)]
    kinds = ["string", *["int"] * 3, *["double"] * 3]
    return _named(rows.select("ord", *(c.cast(t).alias(n) for c, t, n in zip(cells, kinds, ["code", "r", "g", "b", "lab_l", "lab_a", "lab_b"], strict=True))))


def chart_note(spark: SparkSession, path: str) -> DataFrame:
    """The size of a chart file and the note in it."""
    return spark.read.json(path, multiLine=True).select(F.size("colors").alias("size"), "note")
