import math

from pyspark.sql import functions as F

from lithoframe.functions import color, settings, text
from lithoframe.operators import background, match, packed, palette, svg
from lithoframe.sources import chart


def slots(spark, *colors):
    return spark.createDataFrame([(1, k, *c) for k, c in enumerate(colors)], "image_id long, idx int, r int, g int, b int")


def test_nearest_chart_color_by_a_plain_loop(spark):
    def lab(c):
        lin = [v / 255 / 12.92 if v / 255 <= 0.04045 else ((v / 255 + 0.055) / 1.055) ** 2.4 for v in c]
        rows = ((0.4124, 0.3576, 0.1805), (0.2126, 0.7152, 0.0722), (0.0193, 0.1192, 0.9505))
        x, y, z = (sum(a * b for a, b in zip(r, lin)) / w for r, w in zip(rows, (0.95047, 1, 1.08883)))
        x, y, z = (t ** (1 / 3) if t > 0.008856 else 7.787 * t + 16 / 116 for t in (x, y, z))
        return 116 * y - 16, 500 * (x - y), 200 * (y - z)

    colors = [(232, 14, 43), (0, 0, 0), (255, 255, 255), (12, 90, 200)]
    want = [min(chart.chart_tuples(), key=lambda r: (math.dist(lab(c), r[5:8]), r[0]))[1] for c in colors]
    got = match.nearest_pms(slots(spark, *colors)).orderBy("idx").select("pms.code").collect()
    assert [r.code for r in got] == want


def test_chart_search_and_codes(spark):
    c = chart.pms_chart(spark)
    assert c.count() == 150 and match.search_pms(c, "", 3).count() == 3
    codes = spark.createDataFrame([("pms 185 c",), ("PANTONE 185C",), ("nope",)], "code string")
    assert [r.chart_code for r in match.find_pms_by_code(codes, c).collect()] == ["185 C"] * 2


def test_merge_map_puts_the_first_under_the_second(spark):
    pal = slots(spark, *[(k, k, k) for k in range(4)])
    pairs = spark.createDataFrame([(1, 1, 0, 1), (1, 2, 1, 3), (1, 3, 9, 0)], "image_id long, seq int, a int, b int")
    got = palette.build_merge_map(pal, pairs).orderBy("idx").collect()
    assert [r.root for r in got] == [3, 3, 2, 3]


def test_unique_snapping_gives_each_slot_a_code(spark):
    pal = slots(spark, (230, 14, 43), (231, 15, 44))
    area = spark.createDataFrame([(1, 0, 5), (1, 1, 9)], "image_id long, idx int, area long")
    got = palette.snap_palette_to_pms(pal, area).orderBy("idx").collect()
    assert got[1].pms_code == "185 C" and got[0].pms_code != "185 C"


def test_background_is_flooded_and_skin_stays(spark):
    rows = []
    for y in range(12):
        for x in range(12):
            inside = 4 <= x <= 7 and 4 <= y <= 7
            rows.append((1, 12, 12, x, y, *((243, 209, 176) if inside else (250, 250, 250)), 255))
    px = spark.createDataFrame(rows, "image_id long, w int, h int, x int, y int, r int, g int, b int, a int")
    out = background.remove_background(packed.by_image(packed.as_rows(px)), 42)
    assert packed.unpack_rows(out, ["px"]).filter("a = 255").count() == 16 and background.cleared_count(out).first().cleared == 128


def test_hex_both_ways(spark):
    got = spark.range(1).select(color.hex_to_rgb(F.lit("#0f8")).alias("a"), color.hex_to_rgb(F.lit("10ff80")).alias("b"), color.hex_to_rgb(F.lit("zz")).alias("c")).first()
    assert tuple(got.a) == (0, 255, 136) and tuple(got.b) == (16, 255, 128) and tuple(got.c) == (None, None, None)


def test_paths(spark):
    square = F.expr("array(named_struct('x', 0D, 'y', 0D), named_struct('x', 2D, 'y', 0D), named_struct('x', 2D, 'y', 1.5D))")
    got = spark.range(1).select(svg.path_to_svg(square).alias("d"), F.size(svg.smooth_path(square, 2)).alias("n")).first()
    assert got.d == "M 0 0 L 2 0 L 2 1.5 Z" and got.n == 12


def test_stacked_proof_scales_the_outline(spark):
    plates = spark.createDataFrame([(1, "vector", '<svg viewBox="0 0 10 20"><a/></svg>'), (1, "outline", '<svg width="20" height="40"><b/></svg>')], "image_id long, plate string, svg string")
    s = svg.compose_proof(plates).first().svg
    assert 'viewBox="0 0 10 20"' in s and "scale(0.5 0.5)" in s and "<a/>" in s and "<b/>" in s


def test_settings_check_each_field(spark):
    rows = [(1, '{"backgroundTolerance": 500, "outline": {"thickness": 0, "sensitivity": "9"}}'), (2, None), (3, "[]")]
    got = {r.job_id: r.settings for r in settings.read_job_settings(spark.createDataFrame(rows, "job_id long, settings_json string")).collect()}
    assert got[1].background_tolerance == 80 and got[1].outline.thickness == 0.1 and got[1].outline.sensitivity == 60
    assert got[2] == got[3] and got[2].vector.color_count == 12


def test_slugs(spark):
    got = spark.createDataFrame([("  Hello, World! ",), ("",), (None,), ("a" * 60,)], "t string").select(text.slugify(F.col("t")).alias("s")).collect()
    assert [r.s for r in got] == ["hello-world", "ai-artwork", "ai-artwork", "a" * 48]
