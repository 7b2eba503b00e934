import pytest
from pyspark.sql.functions import col as C
from rasters import drawn, shown

from lithoframe.operators import cells, components, grid, morph, regions, runs


def test_majority_takes_the_first_of_equals_and_leaves_the_border(spark):
    assert shown(grid.denoise_labels(drawn(spark, "112 132 222"))) == ["112", "122", "222"]
    assert shown(grid.denoise_labels(drawn(spark, "111 1.1 111"))) == ["111", "1.1", "111"]


def test_large_labels_are_votes_too(spark):
    big = drawn(spark, "112 132 222").withColumn("label", C("label") * 100_000 + 7)
    got = {(r.x, r.y): r.label for r in grid.denoise_labels(big).collect()}
    assert got[1, 1] == 200_007 and got[0, 0] == 100_007


def test_boundaries_need_five_of_nine(spark):
    assert shown(grid.smooth_label_boundaries(drawn(spark, "111 121 222"), 1)) == ["111", "111", "222"]
    assert shown(grid.smooth_label_boundaries(drawn(spark, "11. 12. 22."), 1)) == ["11.", "12.", "22."]


def test_overlap_needs_two_sides(spark):
    assert shown(grid.overlap_adjacent_fills(drawn(spark, "121 111"))) == ["111", "111"]
    assert shown(grid.overlap_adjacent_fills(drawn(spark, "12 12"))) == ["12", "12"]


def test_runs_and_rectangles(spark):
    got = {(r.label, r.x, r.y, r.w, r.h) for r in runs.color_rects(drawn(spark, "112 112 1..")).collect()}
    assert got == {(1, 0, 0, 2, 2), (2, 2, 0, 1, 2), (1, 0, 2, 1, 1)}


def test_segments_are_undirected(spark):
    rows = spark.createDataFrame([(1, 1, 0, 1, 1), (1, 1, 1, 1, 0)], "image_id long, x1 int, y1 int, x2 int, y2 int")
    assert [tuple(r) for r in grid.dedupe_segments(rows).collect()] == [(1, 1, 0, 1, 1)]


@pytest.mark.parametrize("radius", [1, 1.25, 1.49, 2])
def test_discs_match_a_plain_loop(spark, radius):
    text = "....... ..#.... ....... ....##. ....... #......"
    rows = text.split()
    ink = {(x, y) for y, r in enumerate(rows) for x, c in enumerate(r) if c == "#"}
    near = lambda x, y: any((x - a) ** 2 + (y - b) ** 2 <= radius**2 for a, b in ink)
    want = ["".join("#" if near(x, y) else "." for x in range(7)) for y in range(6)]
    assert shown(morph.dilate(drawn(spark, text, "ink"), radius), "ink") == want


def test_close_keeps_the_frame_rule(spark):
    assert shown(morph.close_mask(drawn(spark, "..... .#.#. .#.#. .....", "ink"), 1), "ink") == [".....", ".#.#.", ".#.#.", "....."]
    assert shown(morph.erode(drawn(spark, "### ### ###", "ink"), 1, "frame"), "ink") == ["...", ".#.", "..."]


def plain_regions(rows):
    seen, out = {}, 0
    for y, r in enumerate(rows):
        for x, c in enumerate(r):
            if c == "." or (x, y) in seen:
                continue
            todo, seen[x, y] = [(x, y)], out
            while todo:
                a, b = todo.pop()
                for p in ((a + 1, b), (a - 1, b), (a, b + 1), (a, b - 1)):
                    if p not in seen and 0 <= p[1] < len(rows) and 0 <= p[0] < len(r) and rows[p[1]][p[0]] == c:
                        seen[p] = out
                        todo.append(p)
            out += 1
    return seen


def test_components_match_a_plain_flood(spark):
    text = "1121.2 2122.2 11.212 2.1112 221..1"
    got = {(r.x, r.y): r.region for r in components.with_regions(drawn(spark, text)).filter("region is not null").collect()}
    assert got == plain_regions(text.split())


def test_small_regions_and_specks(spark):
    assert shown(regions.merge_small_regions(drawn(spark, "1111 1211 1111"), 2)) == ["1111"] * 3
    assert shown(components.drop_speck_islands(drawn(spark, "1113 1211 .... ...2"), 2)) == ["1111", "1111", "....", "...."]


def test_small_ink_goes_and_holes_get_rings(spark):
    assert shown(components.remove_small_components(drawn(spark, "##.# #...", "ink"), 2), "ink") == ["##..", "#..."]
    mask = drawn(spark, "##### ##### ##.## ##### #####", "ink")
    walls = components.hole_rings(morph.stroke_walls(mask, 1))
    assert shown(walls, "wall") == ["#####", "#####", "##.##", "#####", "#####"]


def test_resampling_takes_the_pixel_below_the_centre(spark):
    dims = spark.createDataFrame([(1, 4, 2)], "image_id long, w int, h int")
    assert shown(grid.resample_nearest(drawn(spark, "12 34"), dims, ["label"])) == ["1122", "3344"]


def test_pockets_take_the_most_frequent_neighbour(spark):
    from pyspark.sql import functions as F

    side = ["1" * 14] * 6
    holed = [*side, "111111..111111", *["2" * 14] * 7]
    rows = drawn(spark, " ".join(holed)).withColumns({"a": F.lit(255), "ink": F.lit(False)})
    assert shown(cells.fill_enclosed(rows)) == [*side, "1" * 14, *["2" * 14] * 7]
