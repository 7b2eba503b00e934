"""Connected components for images of any size: no step holds an image, or a component, in one task.

Runs are cut at tiles of x and united within blocks of tiles and lines. Parts of neighbouring blocks touch where a run was cut or where pieces of one key overlap;
that join is dealt by line and tile. Components then grow by rounds in which each part hooks to its least neighbour, chains of hooks are halved until all point to
their ends, and links within a part go. Rounds are written tables, so plans stay short and lost executors lose nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lithoframe.operators.components import unite
from lithoframe.operators.packed import whole_images
from lithoframe.staging import Scratch

C = F.col


_BLOCK = ("image_id", "_by", "_bx")


def blocks(runs: DataFrame, key: str, tile: int, whole: bool) -> DataFrame:
    """runs(image_id, y, x0, len, key) cut at tiles of x and united within blocks of tile by tile places -> image_id, part, key and

    of each part of a block (whole=False) its area; of each piece of a run (those at the border of a block only, unless whole=True) y, x0, len, whether it goes on to the
    left and right, and size, its run's length, where the run begins. A part is named by its first piece (y * 2**31 + x0), so the least part of a component by its
    first pixel. A task holds one block at a time, of at most tile * tile runs.
    """
    first, last = F.floor(C("x0") / tile).cast("int"), F.floor((C("x0") + C("len") - 1) / tile).cast("int")
    cut = runs.select("image_id", "y", C("x0").alias("_a"), (C("x0") + C("len")).alias("_b"), key, F.explode(F.sequence(first, last)).alias("_bx"), F.floor(C("y") / tile).cast("int").alias("_by"))
    cut = cut.select(*_BLOCK, "y", F.greatest("_a", C("_bx") * tile).alias("x0"), F.least("_b", (C("_bx") + 1) * tile).alias("_end"), key, "_a", "_b")
    cut = cut.repartition(*_BLOCK).sortWithinPartitions(*_BLOCK, "y", "x0")
    names = ["image_id", "part", key, "area", "y", "x0", "len", "left", "right", "size"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole_images(batches, _BLOCK):
            image, by, bx, y, x0, end, a, b = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (*_BLOCK, "y", "x0", "_end", "_a", "_b"))
            number = np.concatenate([[0], np.cumsum((image[1:] != image[:-1]) | (by[1:] != by[:-1]) | (bx[1:] != bx[:-1]))])
            code = batch.column(key).dictionary_encode().indices.to_numpy(zero_copy_only=False)
            # Blocks are stacked with a line between them.
            root = unite(y % tile + number * (tile + 1), x0 - bx * tile, end - x0, code)
            part, left, right = (y[root] << 31) + x0[root], x0 > a, end < b
            at = np.arange(len(y)) if whole else np.flatnonzero((y % tile == 0) | (y % tile == tile - 1) | left | right)
            own = np.zeros(0, np.int64) if whole else np.unique(root)
            area = np.bincount(root, end - x0, len(root)).astype(np.int64)
            none = lambda kind: pa.nulls(len(own), kind)
            both = lambda v, kind, mask=None: pa.concat_arrays([none(kind), pa.array(v[at], kind, mask=mask)])
            rows = pa.array(np.concatenate([own, at]))
            pieces = [both(v, pa.int32()) for v in (y, x0, end - x0)] + [both(v, pa.bool_()) for v in (left, right)]
            yield pa.RecordBatch.from_arrays([batch.column("image_id").take(rows), pa.array(part[np.concatenate([own, at])]), batch.column(key).take(rows), pa.concat_arrays([pa.array(area[own]), pa.nulls(len(at), pa.int64())]), *pieces, both(b - a, pa.int32(), left[at])], names)

    kind = runs.schema[key].dataType.simpleString()
    return cut.mapInArrow(run, f"image_id long, part long, `{key}` {kind}, area long, y int, x0 int, len int, left boolean, right boolean, size int")


def links_of(pieces: DataFrame, key: str, tile: int) -> DataFrame:
    """image_id, a, b: parts that meet where a run was cut, and across the lines between blocks, where pieces of one key overlap; both within tiles of x."""
    goes_on = pieces.filter("right").select("image_id", "y", (C("x0") + C("len")).alias("x0"), C("part").alias("a"))
    cut = goes_on.join(pieces.filter("left").select("image_id", "y", "x0", C("part").alias("b")), ["image_id", "y", "x0"])
    at = F.floor(C("x0") / tile).cast("int").alias("_bx")
    end = lambda n: (C("x0") + C("len")).alias(n)
    up = pieces.filter((C("y") % tile) == tile - 1).select("image_id", (C("y") + 1).alias("y"), at, key, C("x0").alias("a0"), end("a1"), C("part").alias("a"))
    down = pieces.filter((C("y") % tile) == 0).select("image_id", "y", at, key, C("x0").alias("b0"), end("b1"), C("part").alias("b"))
    met = up.join(down, ["image_id", "y", "_bx", key]).filter((C("a0") < C("b1")) & (C("b0") < C("a1")))
    return cut.select("image_id", "a", "b").unionByName(met.select("image_id", "a", "b")).distinct()


def least_reachable(nodes: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """nodes(image_id, node), links(image_id, a, b) -> image_id, node, root: the least node that links reach, however many rounds that takes. Each round at least halves the parts that still have links."""
    roots = scratch.stage(nodes.select("image_id", "node", C("node").alias("root")), "roots")
    links = scratch.stage(links.filter("a <> b"), "links")
    while not links.isEmpty():
        both = links.select("image_id", "a", "b").unionByName(links.select("image_id", C("b").alias("a"), C("a").alias("b")))
        hooks = scratch.stage(both.groupBy("image_id", C("a").alias("part")).agg(F.min("b").alias("to")).withColumn("to", F.least("part", "to")), "hooks")
        while True:  # chains of hooks point ever lower: half their length each time
            far = hooks.select("image_id", C("part").alias("to"), C("to").alias("far"))
            new = scratch.stage(hooks.join(far, ["image_id", "to"]).select("image_id", "part", C("far").alias("to"), (C("far") != C("to")).alias("moved")), "hooks")
            done = new.filter("moved").isEmpty()
            scratch.drop(hooks)
            hooks = new.drop("moved")
            scratch.rename(new, hooks)
            if done:
                break
        moved = scratch.stage(roots.join(hooks.withColumnRenamed("part", "root"), ["image_id", "root"], "left").select("image_id", "node", F.coalesce("to", "root").alias("root")), "roots")
        end = lambda k: hooks.select("image_id", C("part").alias(k), C("to").alias(f"_{k}"))
        left = links.join(end("a"), ["image_id", "a"]).join(end("b"), ["image_id", "b"]).select("image_id", F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b"))
        fewer = scratch.stage(left.filter("a <> b").distinct(), "links")
        scratch.drop(roots, links, hooks)
        roots, links = moved, fewer
    scratch.drop(links)
    return roots


def ranked(df: DataFrame, group: str, by: str, name: str, scratch: Scratch) -> DataFrame:
    """Distinct rows (group, by) with their rank from 0 within the group. Rows are ranged over tasks and counted there; what the tasks before hold of the same group is added, so that a group of any size spreads."""
    ranged = df.repartitionByRange(group, by).sortWithinPartitions(group, by).withColumn("_block", F.spark_partition_id()).withColumn("_place", F.monotonically_increasing_id())
    rows = scratch.stage(ranged, "ranged")
    first = rows.groupBy(group, "_block").agg(F.min("_place").alias("_first"), F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.join(first.withColumn("_before", before), [group, "_block"]).withColumn(name, C("_before") + C("_place") - C("_first")).drop("_block", "_place", "_first", "_n", "_before")


def _numbered(parts: DataFrame, pieces: DataFrame, key: str, tile: int, scratch: Scratch) -> DataFrame:
    """image_id, part, region of parts(image_id, part)."""
    roots = least_reachable(parts.select("image_id", C("part").alias("node")), links_of(pieces, key, tile), scratch)
    numbers = ranked(roots.select("image_id", "root").distinct(), "image_id", "root", "region", scratch)
    return roots.join(numbers, ["image_id", "root"]).select("image_id", C("node").alias("part"), "region")


def connected_components(runs: DataFrame, key: str = "label", tile: int = 1024) -> DataFrame:
    """runs(image_id, y, x0, len, key) -> with region, as components.connected_components() numbers them: from 0 in each image by first pixels in row-major order. Sides of images are under two thousand million."""
    scratch = Scratch(runs.sparkSession)
    pieces = scratch.stage(blocks(runs, key, tile, True), "pieces")
    named = pieces.filter(F.shiftleft(C("y").cast("long"), 31) + C("x0") == C("part"))
    regions = _numbered(named, pieces, key, tile, scratch)
    return pieces.filter("size is not null").join(regions, ["image_id", "part"]).select("image_id", "y", "x0", C("size").alias("len"), key, "region")


def label_regions(runs: DataFrame, key: str = "label", tile: int = 1024) -> DataFrame:
    """image_id, region, key, area of the components of runs. Of a block only the areas of its parts and the pieces at its border are kept."""
    scratch = Scratch(runs.sparkSession)
    found = scratch.stage(blocks(runs, key, tile, False), "parts")
    parts, pieces = found.filter("area is not null"), found.filter("area is null")
    regions = _numbered(parts, pieces, key, tile, scratch)
    return parts.join(regions, ["image_id", "part"]).groupBy("image_id", "region").agg(F.first(key).alias(key), F.sum("area").alias("area"))
