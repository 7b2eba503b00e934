"""Plans that hold at the size of a corpus: pixels stay in lines, nothing that grows with the corpus is broadcast, and images are not handed to Python one by one."""

import re

import pytest
from pyspark.sql import functions as F

from lithoframe.operators import packed, plates, spread, svg
from lithoframe.plans import jobs, queries
from lithoframe.sources import fixtures

TABLES = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [
    "hole_ring_walls",
    "backdrop_colors",
    "border_samples",
    "refined_palette",
    "merged_labels",
    "posterized",
    "plain_nearest_slots",
    "extracted_palette",
    "dominant_cells",
    "pockets_filled",
    "plate_metrics",
    "stacked_proofs",
    "wall_polylines",
])
def test_lines_are_not_taken_apart_into_pixels(spark, name):
    said = plan(queries.queries()[name](spark, TABLES))
    assert "posexplode" not in said and ("Window" not in said or name == "merged_labels")
    assert "FlatMapGroupsInPandas" not in said and not re.search(r"explode\(sequence\(0, \(w#", said)


def test_rasters_are_dealt_out_before_they_are_drawn(spark):
    said = plan(fixtures.rows(spark, TABLES))
    assert said.index("MapInArrow") < said.index("hashpartitioning")


@pytest.mark.parametrize("name", [
    "snapped_palette",
    "automatic_merges",
    "disabled_slots",
    "merge_suggestions",
    "merged_palette",
    "slot_usage",
    "refined_palette",
    "resolved_palette",
    "merge_map",
    "cleanup_job",
    "cleanup_proof_job",
    "vector_summary",
    "remerge_job",
])
def test_slots_are_not_broadcast_nor_handed_over_image_by_image(spark, name):
    said = plan(queries.queries()[name](spark, TABLES))
    assert "FlatMapGroupsInPandas" not in said and "element_at(array(named_struct" not in said
    # The chart alone may be broadcast.
    assert said.count("+- BroadcastExchange") <= (name == "resolved_palette")
    assert "array_min(transform(array(named_struct" not in said


def test_outlines_are_drawn_without_windows_over_runs(spark):
    # dual_outputs_job
    said = plan(jobs.outline_plates(queries._ink_rows(spark, TABLES)))
    assert "Window" not in said and said.count("MapInArrow") >= 2


def test_walls_of_many_images_equal_those_stitched_one_by_one(spark):
    rows = queries._label_rows(spark, TABLES)
    for smoothness, epsilon in ((0, 0.3), (1, 0.8), (2, 1.2)):
        lines = svg.process_contour(svg.stitch_polylines(packed.metal_segments(rows)), smoothness, epsilon)
        want = lines.select("image_id", "line", svg.path_to_svg(F.col("points"), False).alias("d"))
        got = plates.wall_paths(rows, smoothness, epsilon)
        assert want.exceptAll(got).isEmpty() and got.exceptAll(want).isEmpty()


def test_pins_are_made_at_their_whole_size(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(jobs, "pin_plate", lambda *_args, **options: seen.update(options) or 1 / 0)
    with pytest.raises(ZeroDivisionError):
        queries.pin_plate_job(spark, TABLES)
    assert "cap" not in seen


def test_pin_rasters_are_neither_shuffled_nor_taken_apart(spark):
    images = fixtures.images(spark, TABLES).filter("image_id < 3")
    out, used = jobs.pin_plate(fixtures.rows(spark, TABLES), images)
    assert out.count() == images.count() and used.count() > 0
    # What is drawn has been staged by one pass: no walls, rims or fills of it are gathered afterwards.
    assert "Exchange" not in plan(out) and "Exchange" not in plan(used)


def test_runs_are_united_in_blocks_before_components_grow_in_rounds(spark):
    # region_areas_spread
    lines = queries._label_rows(spark, TABLES).filter("image_id < 20")
    found = spread.blocks(packed.color_runs(lines), "label", 64, False)
    parts = found.filter("area is not null").select("image_id", "label", "area")
    want = packed.label_regions(lines).select("image_id", "label", "area")
    assert parts.exceptAll(want).isEmpty() and want.exceptAll(parts).isEmpty()
    assert spread.links_of(found.filter("area is null"), "label", 64).isEmpty()
