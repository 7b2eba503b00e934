"""Helpers that decide in raster order, against plain loops over pixels."""

import numpy as np
import pyarrow as pa

from lithoframe.operators import background, cells, packed


def raster(alpha, colours):
    """Rows with px of one image."""
    h, w = alpha.shape
    px = ((alpha.astype(np.int64) << 24) | colours).astype(np.uint32).view(np.int32)
    return [(1, w, h, y, px[y].tolist()) for y in range(h)]


class _Grid:
    """The geometry of one image, as tasks see it."""

    def __new__(cls, h, w):
        batch = pa.RecordBatch.from_arrays([pa.array([1] * h, pa.int64()), pa.array([w] * h, pa.int32()), pa.array([h] * h, pa.int32()), pa.array(range(h), pa.int32()), pa.array([[0] * w] * h, pa.list_(pa.int32()))], [*packed.LINE, "px"])
        return packed.Lines(batch, ["px"])


def test_haloes_and_lone_pixels_match_plain_loops():
    rng = np.random.default_rng(0)
    for _ in range(150):
        h, w = rng.integers(1, 14, 2)
        fit, clear, opaque = rng.random((h, w)) < rng.choice([0.4, 0.7, 0.95]), rng.random((h, w)) < 0.1, rng.random((h, w)) < rng.choice([0.3, 0.6])
        gone = np.zeros((h, w), bool)
        for _pass in range(4):
            for y in range(h):
                for x in range(w):
                    sides = [(y - 1, x), (y + 1, x), (y, x - 1), (y, x + 1)]
                    if fit[y, x] and not gone[y, x] and any(0 <= b < h and 0 <= a < w and (clear[b, a] or gone[b, a]) for b, a in sides):
                        gone[y, x] = True
        lines = _Grid(h, w)
        assert (background.haloes(lines, fit.ravel(), clear.ravel()) == gone.ravel()).all()
        left, want = opaque.copy(), np.zeros((h, w), bool)
        for y in range(h):
            for x in range(w):
                if fit[y, x] and opaque[y, x] and left[max(0, y - 1) : y + 2, max(0, x - 1) : x + 2].sum() - left[y, x] <= 1:
                    left[y, x], want[y, x] = False, True
        assert (background.lone(lines, (fit & opaque).ravel(), opaque.ravel()) == want.ravel()).all()


def filled(labels, ink, hole):
    out = labels.copy()
    h, w = out.shape
    for k in range(1, int(hole.max(initial=0)) + 1):
        places = list(zip(*np.nonzero(hole == k)))
        for radius in (1, 2, 4, 8, 14):
            votes = {}
            for y, x in places:
                for b in range(max(0, y - radius), min(h, y + radius + 1)):
                    for a in range(max(0, x - radius), min(w, x + radius + 1)):
                        if hole[b, a] != k and not ink[b, a] and out[b, a] >= 0:
                            votes[out[b, a]] = votes.get(out[b, a], 0) + 1
            if votes:
                for y, x in places:
                    out[y, x] = min(votes, key=lambda v: (-votes[v], v))
                break
    return out


def test_pockets_match_a_plain_loop():
    rng = np.random.default_rng(1)
    for _ in range(25):
        h, w = rng.integers(3, 16, 2)
        labels, hole = rng.integers(-1, 4, (h, w)), np.where(rng.random((h, w)) < 0.2, rng.integers(1, 5, (h, w)), 0)
        labels[hole > 0] = -1
        ink = rng.random((h, w)) < 0.3
        assert (filled(labels, ink, hole) == cells._fill(labels, ink, hole)).all()


def test_halos_and_lone_pixels_go_through_spark(spark):
    """Candidates reach the helpers as Spark hands them over."""
    rng = np.random.default_rng(3)
    rows, want = [], {}
    for image in range(6):
        h, w = 9 + image, 12
        alpha = np.where(rng.random((h, w)) < 0.25, 0, 255)
        light = rng.random((h, w)) < 0.7
        rows += [(image, *line[1:]) for line in raster(alpha, np.where(light, 0xF5F5F5, 0x1428C8))]
        now = alpha.copy()
        for _ in range(4):
            for y in range(1, h - 1):
                for x in range(1, w - 1):
                    if light[y, x] and now[y, x] and 0 in (now[y - 1, x], now[y + 1, x], now[y, x - 1], now[y, x + 1]):
                        now[y, x] = 0
        want[image] = now.copy()
        for y in range(1, h - 1):
            for x in range(1, w - 1):
                if now[y, x] and (now[y - 1 : y + 2, x - 1 : x + 2] > 0).sum() - 1 <= 1:
                    now[y, x] = 0
        want[image, "lone"] = now
    lines = packed.by_image(spark.createDataFrame(rows, "image_id long, w int, h int, y int, px array<int>"))
    known = spark.createDataFrame([(image, 250, 250, 250) for image in range(6)], "image_id long, r int, g int, b int")
    clear = background.clear_halos(lines, known)
    for found, name in ((clear, lambda k: k), (background.despeckle(clear), lambda k: (k, "lone"))):
        seen = {(r.image_id, r.y, r.x): r.a for r in packed.unpack_rows(found, ["px"]).collect()}
        assert len(seen) == sum(len(r[-1]) for r in rows)
        assert all(seen[k, y, x] == want[name(k)][y, x] for k, y, x in seen)
    assert any((want[k] != want[k, "lone"]).any() for k in range(6))
