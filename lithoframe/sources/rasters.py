"""Images in, plates and label states out."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

C = F.col


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """image_id, name, w, h, channels, data of the image files under a path; files that are none are left out. The name is the file's, without its ending; image_id a hash of its origin."""
    rows = spark.read.format("image").option("dropInvalid", True).load(path).select("image.*")
    name = F.regexp_replace(F.regexp_extract("origin", r"([^/]+)$", 1), r"\.[^.]+$", "")
    return rows.select(F.xxhash64("origin").alias("image_id"), F.coalesce(F.nullif(name, F.lit("")), F.lit("artwork")).alias("name"), C("width").alias("w"), C("height").alias("h"), C("nChannels").alias("channels"), "data")


def image_pixels(images: DataFrame) -> DataFrame:
    """image_id, w, h, x, y, r, g, b, a of decoded images. Bytes are reshaped in Arrow batches, one image at a time; an image without alpha is opaque."""
    names = ["image_id", "w", "h", "x", "y", "r", "g", "b", "a"]

    def run(batches):
        for batch in batches:
            for image_id, w, h, channels, data in zip(*(batch.column(k).to_pylist() for k in ("image_id", "w", "h", "channels", "data")), strict=True):
                raw = np.frombuffer(data, np.uint8).reshape(h * w, channels).astype(np.int32)
                colour = raw[:, [2, 1, 0]] if channels >= 3 else np.repeat(raw[:, :1], 3, 1)
                alpha = raw[:, 3] if channels == 4 else np.full(h * w, 255, np.int32)
                y, x = np.divmod(np.arange(h * w, dtype=np.int32), w)
                columns = [np.full(h * w, image_id, np.int64), *(np.full(h * w, v, np.int32) for v in (w, h)), x, y, *colour.T, alpha]
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], names)

    return images.select("image_id", "w", "h", "channels", "data").mapInArrow(run, "image_id long, " + ", ".join(f"{k} int" for k in names[1:]))


def png(w: int, h: int, px: np.ndarray) -> bytes:
    """A PNG file of packed colours (0xAARRGGBB), row by row."""
    rgba = (((px.astype(np.int64) & 0xFFFFFF) << 8) | ((px.astype(np.int64) >> 24) & 255)).astype(">u4").view(np.uint8).reshape(h, w * 4)
    lines = np.hstack([np.zeros((h, 1), np.uint8), rgba]).tobytes()
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def write_images(rows: DataFrame, folder: str) -> None:
    """Rows with px, dealt by image -> one PNG an image, {image_id}.png, under a folder that all executors reach. A task that is run again writes the same files."""
    from lithoframe.operators.packed import Lines, whole_images

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        for batch in whole_images(batches):
            lines = Lines(batch, ["px"])
            first = np.nonzero(np.append(True, lines.image_id[1:] != lines.image_id[:-1]))[0]
            for at, end in zip(first, [*first[1:], len(lines.y)], strict=True):
                with store.open_output_stream(f"{root}/{lines.image_id[at]}.png", compression=None) as out:
                    out.write(png(int(lines.w[at]), int(end - at), lines.values["px"][lines.ends[at] : lines.ends[end]]))
            yield pa.RecordBatch.from_arrays([pa.array(lines.image_id[first], pa.int64())], ["image_id"])

    rows.select("image_id", "w", "h", "y", "px").sortWithinPartitions("image_id", "y").mapInArrow(run, "image_id long").write.format("noop").mode("overwrite").save()


def image_rows(images: DataFrame) -> DataFrame:
    """read_images()'s rows -> packed rows (image_id, w, h, y, px), straight from the decoded bytes: no pixel becomes a row of its own. An image without alpha is opaque."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for image_id, w, h, channels, data in zip(*(batch.column(k).to_pylist() for k in ("image_id", "w", "h", "channels", "data")), strict=True):
                raw = np.frombuffer(data, np.uint8).reshape(h * w, channels).astype(np.uint32)
                b, g, r = (raw[:, 0], raw[:, 1], raw[:, 2]) if channels >= 3 else (raw[:, 0],) * 3
                px = ((raw[:, 3] if channels == 4 else np.uint32(255)) << 24 | r << 16 | g << 8 | b).astype(np.uint32).view(np.int32)
                ends = pa.array(np.arange(h + 1, dtype=np.int32) * w)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(h, image_id, np.int64)), *(pa.array(np.full(h, v, np.int32)) for v in (w, h)), pa.array(np.arange(h, dtype=np.int32)), pa.ListArray.from_arrays(ends, pa.array(px))], ["image_id", "w", "h", "y", "px"])

    return images.select("image_id", "w", "h", "channels", "data").mapInArrow(run, "image_id long, w int, h int, y int, px array<int>")


def write_plates(plates: DataFrame, path: str) -> None:
    """plates(image_id, name, plate, svg) as Parquet by plate, with a file name each: {name}-{plate}.svg."""
    plates.withColumn("file_name", F.concat("name", F.lit("-"), "plate", F.lit(".svg"))).write.partitionBy("plate").parquet(path)


def _state_table(path: str, name: str) -> str:
    return f"state_{hashlib.sha256(path.encode()).hexdigest()[:24]}_{name}"


def write_state(labels: DataFrame, palette: DataFrame, path: str, buckets: int = 64) -> None:
    """Labels (rows, or pixels) and the palette before merging, so that a change of palette need not quantise again.

    Both are tables bucketed by image_id, one file a bucket, so that steps by image need no exchange when they are read again. What a reader must know to
    find the buckets lies beside them.
    """
    spark = labels.sparkSession
    line = [c for c in ("y", "x") if c in labels.columns]
    for name, df, order in (("labels", labels, line), ("palette", palette.select("image_id", "idx", "r", "g", "b"), ["idx"])):
        dealt = df.repartition(buckets, "image_id").write.bucketBy(buckets, "image_id").sortBy("image_id", *order)
        dealt.option("path", f"{path}/{name}").mode("errorifexists").saveAsTable(_state_table(path, name))
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
        spark.createDataFrame([(columns, ", ".join(["image_id", *order]), buckets)], "columns string, sorted string, buckets int").coalesce(1).write.json(f"{path}/{name}-layout")


def read_state(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(labels, palette) of write_state(), from any session: the tables are made known to it where they aren't."""
    out = []
    for name in ("labels", "palette"):
        layout, table = spark.read.json(f"{path}/{name}-layout").first(), _state_table(path, name)
        spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({layout['columns']}) USING parquet CLUSTERED BY (image_id) SORTED BY ({layout['sorted']}) INTO {layout['buckets']} BUCKETS LOCATION '{path}/{name}'")
        out.append(spark.table(table))
    return out[0], out[1]
