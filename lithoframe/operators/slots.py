"""Steps over the slots of palettes, many images at a time in numpy: an image's slots are gathered in one row, so no step calls Python for each image."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithoframe.sources.chart import chart_tuples

_KINDS = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string()}
CHART = chart_tuples()
CHART_LAB = np.array([c[5:8] for c in CHART])
CHART_RGB = np.array([c[2:5] for c in CHART])
CHART_CODE = pa.array([c[1] for c in CHART])
CHART_NAME = pa.array([f"PMS {c[1]}" for c in CHART])


class Slots:
    """The slots of some images as tables of images by places, sorted by idx: `there` where a slot is, and of each named value its table, 0 elsewhere; `image` and `place` say where each slot is."""

    def __init__(self, lists: pa.ListArray, most: int = 1):
        size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = lists.flatten()
        flat = {f.name: flat.field(n).to_numpy(zero_copy_only=False) for n, f in enumerate(flat.type)}
        self.image = np.repeat(np.arange(len(size)), size)
        order = np.lexsort((flat["idx"], self.image))
        self.place = np.arange(len(order)) - np.repeat(np.cumsum(size) - size, size)
        self.there = np.zeros((len(size), max(most, int(size.max(initial=0)))), bool)
        self.there[self.image, self.place] = True
        self.flat = {k: v[order] for k, v in flat.items()}

    def table(self, name: str, none: object = 0) -> np.ndarray:
        out = np.full(self.there.shape, none, np.result_type(self.flat[name].dtype, type(none)))
        out[self.image, self.place] = self.flat[name]
        return out

    def position(self, idx: np.ndarray) -> np.ndarray:
        """The place of the slot with this idx in each image; -1 where there is none."""
        same = self.there & (self.table("idx") == idx[:, None])
        return np.where(same.any(1), same.argmax(1), -1)


def map_slots(slots: DataFrame, names: list[str], f: Callable[[Slots, pa.RecordBatch], dict[str, np.ndarray]], schema: str, beside: DataFrame | None = None) -> DataFrame:
    """slots(image_id, idx, and the named columns) -> what f finds, as columns of the schema; f gets the slots of a thousand images. The rows of `beside` (image_id, columns) come along, one an image."""
    lists = slots.groupBy("image_id").agg(F.collect_list(F.struct("idx", *names)).alias("_slots"))
    lists = lists if beside is None else lists.join(beside.hint("merge"), "image_id", "left")
    fields = [part.split() for part in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                new = f(Slots(part.column("_slots")), part)
                yield pa.RecordBatch.from_arrays([v if isinstance(v := new[k], pa.Array) else pa.array(v, _KINDS[kind]) for k, kind in fields], [k for k, _ in fields])

    return lists.mapInArrow(run, schema)


def ids(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("image_id").to_numpy(zero_copy_only=False)


def chart_distance(lab: np.ndarray) -> np.ndarray:
    """Lab distance of some colours (by row) to each chart colour."""
    out = np.zeros((len(lab), len(CHART)))
    for k in range(3):
        out += (lab[:, k, None] - CHART_LAB[:, k]) ** 2
    return np.sqrt(out)


def nearest_chart(lab: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ord, distance) of the nearest chart colour of each colour, the first in the chart among equals; equal colours are matched once."""
    own, back = np.unique(lab, axis=0, return_inverse=True)
    best, far = np.zeros(len(own), np.int64), np.zeros(len(own))
    for at in range(0, len(own), 4096):
        de = chart_distance(own[at : at + 4096])
        best[at : at + 4096] = de.argmin(1)
        far[at : at + 4096] = de.min(1)
    return best[back.reshape(-1)], far[back.reshape(-1)]
