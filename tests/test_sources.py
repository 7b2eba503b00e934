"""Images and charts in, plates and states out, and the jobs that write in steps."""

import json
import struct
import zlib

import pytest
from rasters import drawn

from lithoframe.operators import svg
from lithoframe.plans import jobs
from lithoframe.sources import chart, rasters


def png(path, rows, channels):
    """A PNG file out of rows of colour tuples, written by hand."""
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", len(rows[0]), len(rows), 8, 6 if channels == 4 else 2, 0, 0, 0)
    data = zlib.compress(b"".join(b"\0" + bytes(v for px in row for v in px) for row in rows))
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + part(b"IHDR", head) + part(b"IDAT", data) + part(b"IEND", b""))


def test_images_become_pixels(spark, tmp_path):
    colour, clear = [[(1, 2, 3), (4, 5, 6)], [(7, 8, 9), (250, 251, 252)], [(0, 0, 0), (9, 9, 9)]], [[(10, 20, 30, 0), (40, 50, 60, 128)]]
    png(tmp_path / "flat art.png", colour, 3)
    png(tmp_path / "b.png", clear, 4)
    (tmp_path / "no.png").write_text("not an image")
    images = rasters.read_images(spark, str(tmp_path))
    size = {r.name: (r.w, r.h) for r in images.collect()}
    assert size == {"flat%20art": (2, 3), "b": (2, 1)} or size == {"flat art": (2, 3), "b": (2, 1)}
    names = {r.image_id: r.w * r.h for r in images.collect()}
    for image_id, n in names.items():
        got = {(r.x, r.y): (r.r, r.g, r.b, r.a) for r in rasters.image_pixels(images).filter(f"image_id = {image_id}").collect()}
        want = {(x, y): (*px, 255) for y, row in enumerate(colour) for x, px in enumerate(row)} if n == 6 else {(x, 0): px for x, px in enumerate(clear[0])}
        assert got == want


def test_charts_are_read_in_order(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"book": "b", "note": "n", "colors": [["9 C", 1, 2, 3, 4, 5, 6], ["Black 6 C", 16, 24, 32, 9, 0, -1]]}))
    got = [(r.ord, r.code, r.name, r.hex, r.lab_b) for r in chart.read_pms_chart(spark, str(tmp_path / "c.json")).orderBy("ord").collect()]
    assert got == [(0, "9 C", "PMS 9 C", "#010203", 6.0), (1, "Black 6 C", "PMS Black 6 C", "#101820", -1.0)]


def test_plates_and_states_come_back(spark, tmp_path):
    plates = spark.createDataFrame([(1, "dog", "vector", "<svg/>"), (1, "dog", "outline", "<svg>o</svg>")], "image_id long, name string, plate string, svg string")
    rasters.write_plates(plates, str(tmp_path / "plates"))
    assert {(r.file_name, r.plate, r.svg) for r in spark.read.parquet(str(tmp_path / "plates")).collect()} == {("dog-vector.svg", "vector", "<svg/>"), ("dog-outline.svg", "outline", "<svg>o</svg>")}
    labels = drawn(spark, "112 .12")
    palette = spark.createDataFrame([(1, 1, 9, 8, 7), (1, 2, 6, 5, 4)], "image_id long, idx int, r int, g int, b int")
    rasters.write_state(labels, palette, str(tmp_path / "state"))
    back, slots = rasters.read_state(spark, str(tmp_path / "state"))
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert rows(back.select("x", "y", "label")) == rows(labels.select("x", "y", "label")) and rows(slots) == rows(palette)


@pytest.fixture
def art(spark):
    """A picture of a ring around two fills on white."""
    rows = []
    for y in range(24):
        for x in range(24):
            d = (x - 11.5) ** 2 + (y - 11.5) ** 2
            c = (250, 250, 250) if d > 110 else (8, 8, 12) if d > 80 else (220, 20, 40) if x < 12 else (20, 40, 120)
            rows.append((1, 24, 24, x, y, *c, 255))
    return spark.createDataFrame(rows, "image_id long, w int, h int, x int, y int, r int, g int, b int, a int")


def empty(spark):
    return {"merges": spark.createDataFrame([], "image_id long, seq int, a int, b int"), "overrides": spark.createDataFrame([], "image_id long, idx int, code string"), "disabled": spark.createDataFrame([], "image_id long, idx int"), "chart": chart.pms_chart(spark)}


def test_outline_plate_and_proof_are_published_in_steps(spark, art, tmp_path):
    got = {r.plate: r.svg for r in jobs.dual_outputs(art, str(tmp_path / "a"), **empty(spark)).collect()}
    assert set(got) == {"outline", "vector", "proof"} and 'viewBox="0 0 24 24"' in got["vector"]
    plates = spark.createDataFrame([(1, k, got[k]) for k in ("outline", "vector")], "image_id long, plate string, svg string")
    assert svg.compose_proof(plates).first().svg == got["proof"]


def test_an_outline_outlives_a_failed_plate(spark, art, tmp_path):
    with pytest.raises(Exception):  # noqa: B017  (whatever the plate fails with)
        jobs.dual_outputs(art, str(tmp_path / "c"), **empty(spark) | {"merges": spark.createDataFrame([], "odd int")})
    assert spark.read.parquet(str(tmp_path / "c" / "plate=outline")).first().svg.count("<path") == 1


def test_pin_plates_are_in_millimetres(spark, art):
    pins = spark.createDataFrame([(1, 24, 24, 10, None, 100)], "image_id long, w int, h int, pin_width_mm int, pin_height_mm int, dpi int")
    plates, used = jobs.pin_plate(art, pins, colors=6)
    text = plates.first().svg
    # 10 mm at 100 dots an inch are 39 px
    assert 'viewBox="0 0 39 39" width="10mm" height="10mm" data-enamel="soft"' in text and '<g id="enamel-fills">' in text
    assert 'id="metal-outlines" fill="none" stroke="#1a1a1a"' in text and 'stroke-width="1.37"' in text and used.count() >= 3


def test_a_proof_is_cleaned_up_and_laid_under_its_outline(spark, art):
    labels = art.selectExpr("image_id", "w", "h", "x", "y", "case when (x - 11.5) * (x - 11.5) + (y - 11.5) * (y - 11.5) > 110 then null when x = 5 and y = 11 then 1 when x < 12 then 0 else 1 end as label")
    fills = spark.createDataFrame([(1, 0, 220, 20, 40), (1, 1, 20, 40, 120)], "image_id long, idx int, r int, g int, b int")
    outline = art.selectExpr("image_id", "w", "h", "x", "y", "case when r < 20 and b < 20 or x in (11, 12) and r < 240 then 255 else 0 end as a")
    plates, counts = jobs.clean_up_proof(labels, fills, outline)
    got = {r.plate: r.svg for r in plates.collect()}
    assert set(got) == {"vector", "proof"} and 'viewBox="0 0 32 32"' in got["vector"] and "proof-outline" in got["proof"]
    row = counts.first()
    assert row.cell_count == 2
