"""The registered queries on the driver's tables, and the SQL that says the same where SQL can.

Results on pixels are digests by image (counts and place-weighted sums over all pixels), so that every pixel counts while results stay small.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lithoframe.functions import color, layout, settings, text
from lithoframe.operators import background, cells, grid, ink, match, morph, packed, palette, plates, spread, svg
from lithoframe.operators.grid import by_image
from lithoframe.plans import jobs
from lithoframe.plans import sql as Q
from lithoframe.sources import chart, fixtures, rasters
from lithoframe.staging import shared_dir, stage

C = F.col
_RUN: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        _RUN[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_RUN)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def digest(df: DataFrame, value: str = "label") -> DataFrame:
    v = C(value).cast("long")
    return df.groupBy("image_id").agg(F.count(v).alias("n"), F.sum(v).alias("total"), F.sum(v * (C("x") * 31 + C("y") * 17)).alias("placed"))


def ink_digest(df: DataFrame, value: str = "ink") -> DataFrame:
    v = C(value).cast("long")
    return df.groupBy("image_id").agg(F.sum(v).alias("n"), F.sum(v * (C("x") * 31 + C("y") * 17)).alias("placed"))


def _ink_sums(rows: DataFrame, name: str = "ink") -> DataFrame:
    return packed.sums(rows, name).select("image_id", C("total").alias("n"), "placed")


def _pixels(s: SparkSession, d: str) -> DataFrame:
    return fixtures.pixels(s, d)


def _raster(s: SparkSession, d: str) -> DataFrame:
    """The pixels as a written table, for jobs that read them more than once or use each channel many times."""
    return stage(_pixels(s, d), "pixels")


def _labels(s: SparkSession, d: str) -> DataFrame:
    return packed.unpack_rows(_label_rows(s, d), ["label"])


def _rows(s: SparkSession, d: str) -> DataFrame:
    return fixtures.rows(s, d)


def _label_rows(s: SparkSession, d: str) -> DataFrame:
    return packed.quantize(_rows(s, d), fixtures.palette(s, d))


def _mask(s: SparkSession, d: str) -> DataFrame:
    light = color.luminance(C("r"), C("g"), C("b"))
    return by_image(_pixels(s, d)).select("image_id", "w", "h", "x", "y", "a", "r", "g", "b", ((light < 30) & (C("a") >= 128)).alias("ink"))


def _ink_rows(s: SparkSession, d: str) -> DataFrame:
    return packed.dark(_rows(s, d), 30)


def _colors(s: SparkSession, d: str) -> DataFrame:
    return _pixels(s, d).groupBy("r", "g", "b").agg(F.count("*").alias("n"))


def _usage(s: SparkSession, d: str) -> DataFrame:
    return match.label_usage(packed.label_counts(_label_rows(s, d)), fixtures.palette(s, d))


def _rgb() -> tuple[Column, Column, Column]:
    return match.rgb()


# ---- sources, projections and predicates

_NEAREST = f"""WITH {Q.PIXELS}, {Q.CHART}, cols AS (SELECT r, g, b, count(*) AS n FROM px GROUP BY r, g, b),
labs AS (SELECT r, g, b, n, {Q.lab()} AS lab FROM cols),
best AS (SELECT l.r, l.g, l.b, any_value(l.n) AS n, min({{'d': {Q.delta("lab", "{'l': ll, 'a': la, 'b': lb}")}, 'o': ord, 'c': code}}) AS m FROM labs l, chart GROUP BY l.r, l.g, l.b)"""


@query(_NEAREST + " SELECT m.c AS code, count(*) AS colors, sum(n)::BIGINT AS pixels FROM best GROUP BY 1")
def chart_fill_counts(s, d):
    near = match.nearest_pms(_colors(s, d))
    return near.groupBy(C("pms.code").alias("code")).agg(F.count("*").alias("colors"), F.sum("n").alias("pixels"))


@query(_NEAREST + " SELECT r, g, b, m.c AS code, round(m.d, 4) AS delta_e FROM best")
def nearest_chart_colors(s, d):
    return match.nearest_pms(_colors(s, d)).select("r", "g", "b", C("pms.code").alias("code"), F.round("pms.de", 4).alias("delta_e"))


@query(f"WITH {Q.PIXELS} SELECT image_id, count(*) AS n, sum(3*r+5*g+7*b+11*a+13*x+17*y)::BIGINT AS weighted, sum((a >= 128)::INT)::BIGINT AS opaque, sum((a < 16)::INT)::BIGINT AS clear, sum((a <= 96)::INT)::BIGINT AS faint FROM px GROUP BY image_id")
def pixel_sums(s, d):
    v = 3 * C("r") + 5 * C("g") + 7 * C("b") + 11 * C("a") + 13 * C("x") + 17 * C("y")
    return _pixels(s, d).groupBy("image_id").agg(F.count("*").alias("n"), F.sum(v).alias("weighted"), F.count_if(C("a") >= 128).alias("opaque"), F.count_if(C("a") < 16).alias("clear"), F.count_if(C("a") <= 96).alias("faint"))


@query(_SQL["pixel_sums"].replace("SELECT image_id, count(*)", "SELECT image_id, any_value(w) AS w, any_value(h) AS h, count(*)"))
def images_from_files(s, d):
    """The rasters written as PNG files and read by the image source."""
    folder = f"{shared_dir(s)}/images-{uuid.uuid4().hex}"
    rasters.write_images(_rows(s, d), folder)
    images = rasters.read_images(s, folder).withColumn("image_id", C("name").cast("long"))
    v = 3 * C("r") + 5 * C("g") + 7 * C("b") + 11 * C("a") + 13 * C("x") + 17 * C("y")
    px = packed.unpack_rows(rasters.image_rows(images), ["px"])
    return px.groupBy("image_id").agg(F.first("w").alias("w"), F.first("h").alias("h"), F.count("*").alias("n"), F.sum(v).alias("weighted"), F.count_if(C("a") >= 128).alias("opaque"), F.count_if(C("a") < 16).alias("clear"), F.count_if(C("a") <= 96).alias("faint"))


@query(f"WITH {Q.PIXELS}, c AS (SELECT DISTINCT r, g, b FROM px) SELECT r, g, b, round({Q.lum()}, 6) AS light, {Q.chroma()} AS chroma, {Q.skin()} AS skin, round({Q.skin_score()}, 9) AS score, {Q.chroma()} < 28 AS neutral, {Q.chroma()} >= 45 OR {Q.skin_score()} > 0.12::DOUBLE AS accent, {Q.leftover()} AS leftover, printf('#%02x%02x%02x', r, g, b) AS hex FROM c")
def color_flags(s, d):
    c = _rgb()
    return _colors(s, d).select("r", "g", "b", F.round(color.luminance(*c), 6).alias("light"), color.chroma(*c).alias("chroma"), color.is_skin_tone(*c).alias("skin"), F.round(color.skin_score(*c), 9).alias("score"), color.is_neutral(*c).alias("neutral"), color.is_accent(*c).alias("accent"), color.is_leftover_backdrop(*c).alias("leftover"), color.rgb_to_hex(*c).alias("hex"))


@query(f"WITH {Q.PIXELS}, c AS (SELECT DISTINCT r, g, b, {Q.lab()} AS lab FROM px) SELECT printf('#%02x%02x%02x', r, g, b) AS hex, r, g, b, round(lab.l, 4) AS l, round(lab.a, 4) AS a, round(lab.b, 4) AS lab_b, round({Q.delta('lab', chr(123) + chr(39) + 'l' + chr(39) + ': 50.0, ' + chr(39) + 'a' + chr(39) + ': 10.0, ' + chr(39) + 'b' + chr(39) + ': -10.0' + chr(125))}, 4) AS de FROM c")
def lab_of_hex(s, d):
    hexes = _colors(s, d).select(color.rgb_to_hex(*_rgb()).alias("hex")).withColumn("c", color.hex_to_rgb(C("hex"))).select("hex", "c.*")
    fixed = F.struct(F.lit(50.0).alias("l"), F.lit(10.0).alias("a"), F.lit(-10.0).alias("b"))
    out = hexes.withColumn("lab", color.rgb_to_lab(*_rgb()))
    return out.select("hex", "r", "g", "b", F.round("lab.l", 4).alias("l"), F.round("lab.a", 4).alias("a"), F.round("lab.b", 4).alias("lab_b"), F.round(color.delta_e76(C("lab"), fixed), 4).alias("de"))


@query(f"""WITH {Q.IMAGES}, mm AS (SELECT *, pin_width_mm::DOUBLE AS width_mm, coalesce(pin_height_mm::DOUBLE, pin_width_mm::DOUBLE / (w::DOUBLE / h)) AS height_mm FROM im),
p AS (SELECT *, greatest(32, floor(width_mm / 25.4::DOUBLE * dpi + 0.5))::INT AS a, greatest(32, floor(height_mm / 25.4::DOUBLE * dpi + 0.5))::INT AS b FROM mm)
SELECT image_id, round(height_mm, 6) AS height_mm, CASE WHEN greatest(a, b) > 1200 THEN greatest(32, floor(a * (1200.0::DOUBLE / greatest(a, b)) + 0.5))::INT ELSE a END AS width_px,
CASE WHEN greatest(a, b) > 1200 THEN greatest(32, floor(b * (1200.0::DOUBLE / greatest(a, b)) + 0.5))::INT ELSE b END AS height_px FROM p""")
def pin_sizes(s, d):
    return layout.pin_dims(fixtures.images(s, d)).select("image_id", F.round("height_mm", 6).alias("height_mm"), "width_px", "height_px")


@query(f"""WITH {Q.IMAGES}, t AS (SELECT *, (image_id % 101) / 100.0::DOUBLE AS t, least(1.0::DOUBLE, 20.0::DOUBLE / greatest(w, h)) AS sc FROM im), k AS (SELECT *, 0.0022::DOUBLE * (1 - t) + 0.00005::DOUBLE * t AS ratio FROM t),
m AS (SELECT *, greatest(8, floor((w * h)::DOUBLE * ratio + 0.5))::INT AS min_region FROM k)
SELECT image_id, greatest(1, floor(w * sc + 0.5))::INT AS fit_w, greatest(1, floor(h * sc + 0.5))::INT AS fit_h, round(ratio, 9) AS ratio, CASE WHEN t >= 0.75 THEN 1 WHEN t >= 0.4 THEN 2 ELSE 3 END AS denoise, CASE WHEN t >= 0.7 THEN 1 WHEN t >= 0.4 THEN 2 ELSE 3 END AS boundary,
round(0.35::DOUBLE + (1 - t) * 0.85::DOUBLE, 9) AS speck_scale, floor(greatest(0, least(100, (0.0022::DOUBLE - ratio) / (0.0022::DOUBLE - 0.00005::DOUBLE) * 100)) + 0.5)::INT AS back, min_region, greatest(12, floor(min_region * (0.35::DOUBLE + (1 - t) * 0.85::DOUBLE) + 0.5))::INT AS speck FROM m""")
def detail_parameters(s, d):
    im = fixtures.images(s, d).withColumn("detail", (C("image_id") % 101).cast("double"))
    p, fit, area = layout.detail_retention_params(C("detail")), layout.fit_dims(C("w"), C("h"), 20, 1), layout.derived_areas(C("w"), C("h"), C("detail"))
    return im.select("image_id", fit["w"].alias("fit_w"), fit["h"].alias("fit_h"), F.round(p["min_region_ratio"], 9).alias("ratio"), p["denoise_passes"].alias("denoise"), p["boundary_passes"].alias("boundary"), F.round(p["speck_scale"], 9).alias("speck_scale"), layout.retention_from_min_region_ratio(p["min_region_ratio"]).alias("back"), area["min_region"].alias("min_region"), area["speck"].alias("speck"))


@query(f"""WITH {Q.PIXELS}, o AS (SELECT image_id, a <> 255 AS f, CASE WHEN a = 255 THEN r WHEN a = 0 THEN 255 ELSE floor(r * (a / 255.0::DOUBLE) + 255 * (1 - a / 255.0::DOUBLE) + 0.5)::INT END AS r,
CASE WHEN a = 255 THEN g WHEN a = 0 THEN 255 ELSE floor(g * (a / 255.0::DOUBLE) + 255 * (1 - a / 255.0::DOUBLE) + 0.5)::INT END AS g FROM px)
SELECT image_id, sum(f::INT)::BIGINT AS filled, sum(r)::BIGINT AS red, sum(g)::BIGINT AS green FROM o GROUP BY image_id""")
def on_white_paper(s, d):
    return background.composite_on_white(_pixels(s, d)).groupBy("image_id").agg(F.count_if("filled").alias("filled"), F.sum("r").alias("red"), F.sum("g").alias("green"))


_SAMPLES = f"""WITH {Q.PIXELS}, pts AS (SELECT image_id, unnest([{{'x': 2, 'y': 2}}, {{'x': w-3, 'y': 2}}, {{'x': 2, 'y': h-3}}, {{'x': w-3, 'y': h-3}}, {{'x': w//2, 'y': 2}}, {{'x': w//2, 'y': h-3}}, {{'x': 2, 'y': h//2}}, {{'x': w-3, 'y': h//2}}, {{'x': w//4, 'y': 2}}, {{'x': w*3//4, 'y': 2}}, {{'x': 4, 'y': 4}}, {{'x': w-5, 'y': 4}}]) AS p FROM im),
smp AS (SELECT px.image_id, r, g, b FROM pts JOIN px ON px.image_id = pts.image_id AND px.x = p.x AND px.y = p.y AND a >= 16)"""
_BACKDROP = _SAMPLES + ", bd AS (SELECT image_id, list_sort(list(r))[count(*) // 2 + 1] AS r, list_sort(list(g))[count(*) // 2 + 1] AS g, list_sort(list(b))[count(*) // 2 + 1] AS b FROM smp GROUP BY image_id HAVING count(*) >= 3)"


@query(_SAMPLES + " SELECT image_id, count(*) AS n, sum(r)::BIGINT AS red, sum(g)::BIGINT AS green, sum(b)::BIGINT AS blue FROM smp GROUP BY image_id")
def border_samples(s, d):
    return background.edge_samples(_rows(s, d)).groupBy("image_id").agg(F.count("*").alias("n"), F.sum("r").alias("red"), F.sum("g").alias("green"), F.sum("b").alias("blue"))


@query(_BACKDROP + " SELECT * FROM bd")
def backdrop_colors(s, d):
    return background.backdrop_color(background.edge_samples(_rows(s, d)))


_BG_LUM, _BG_C = "(0.2126::DOUBLE * br + 0.7152::DOUBLE * bg + 0.0722::DOUBLE * bb)", "(greatest(br, bg, bb) - least(br, bg, bb))"




def _judged(tol: int) -> str:
    """CTEs up to f: pixels with label (backdrop or not, null without a backdrop), their backdrop's colour, lightness l, chroma c and skin sk."""
    return f""", j AS (SELECT px.*, bd.r AS br, bd.g AS bg, bd.b AS bb, {Q.lum("px.")} AS l, {Q.chroma("px.")} AS c, {Q.skin("px.")} AS sk FROM px LEFT JOIN bd USING (image_id)),
n AS (SELECT *, {{'a': a, 'l': l, 's': sk}} AS o FROM j),
k AS (SELECT *, [lag(o) OVER (PARTITION BY image_id, x ORDER BY y), lag(o) OVER (PARTITION BY image_id, y ORDER BY x), lead(o) OVER (PARTITION BY image_id, y ORDER BY x), lead(o) OVER (PARTITION BY image_id, x ORDER BY y)] AS ns,
 (r-br)*(r-br)+(g-bg)*(g-bg)+(b-bb)*(b-bb) AS far FROM n),
f AS (SELECT *, CASE WHEN br IS NULL THEN NULL WHEN a < 16 THEN true WHEN sk OR ({_BG_C} < 25 AND c > greatest(35, {_BG_C} + 22)) THEN false
 WHEN {_BG_LUM} > 200 AND {_BG_C} < 30 THEN ((l >= 232 AND c <= 18) OR (l >= {_BG_LUM} - 14 AND c <= 20 AND far <= {(tol * 1.35) ** 2!r}::DOUBLE) OR far <= {tol * tol}) AND NOT (r > g + 10 AND r > b + 15 AND c > 14)
 ELSE far <= {tol * tol} AND ({_BG_LUM} >= 40 OR (l <= 42 AND len(list_filter(ns, lambda s: s IS NOT NULL AND s.a >= 16 AND (s.l - l > 48 OR s.s))) = 0)) END AS label FROM k)"""


@query(_BACKDROP + _judged(42) + """
SELECT image_id, count(label) AS n, sum(label::INT)::BIGINT AS total, sum(label::INT * (x * 31 + y * 17))::BIGINT AS placed FROM f GROUP BY image_id""")
def backdrop_pixels(s, d):
    rows = _rows(s, d)
    known = background.backdrop_color(background.edge_samples(rows))
    return packed.sums(background.is_backdrop_pixel(rows, known, 42), "is_backdrop")


@query(_NEAREST + " SELECT c.ord, c.code, coalesce(sum(n), 0)::BIGINT AS pixels FROM (SELECT * FROM chart WHERE contains(lower(code), '18') OR contains(lower('PMS ' || code), '18') OR contains(printf('#%02x%02x%02x', r, g, b), '18') ORDER BY ord LIMIT 160) c LEFT JOIN best ON best.m.c = c.code GROUP BY 1, 2")
def chart_search_usage(s, d):
    used = stage(chart_fill_counts(s, d).withColumnRenamed("pixels", "n"), "used")
    hits = match.search_pms(chart.pms_chart(s), " 18 ")
    return hits.join(used, "code", "left").groupBy("ord", "code").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("pixels"))


@query(f"""WITH {Q.IMAGES}, {Q.CHART}, o AS (SELECT image_id, unnest([{{'idx': 0, 'code': 'pms 185 c'}}, {{'idx': 1, 'code': 'PANTONE 185C'}}, {{'idx': 2, 'code': ' Black 6 C '}}, {{'idx': 3, 'code': '999 ZZ'}}]) AS u FROM im)
SELECT image_id, u.idx AS idx, u.code AS code, chart.code AS chart_code, r, g, b FROM o JOIN chart ON replace(upper(chart.code), ' ', '') = replace(upper(regexp_replace(regexp_replace(trim(u.code), '^pms\\s+', '', 'i'), '^pantone\\s+', '', 'i')), ' ', '')""")
def codes_in_chart(s, d):
    return match.find_pms_by_code(fixtures.overrides(s, d), chart.pms_chart(s)).select("image_id", "idx", "code", "chart_code", "r", "g", "b")


# ---- joins to palettes

@query(f"WITH {Q.LABELS} " + Q.DIGEST.format(t="lb"))
def quantize_labels(s, d):
    return packed.sums(_label_rows(s, d))


@query(f"""WITH {Q.PIXELS}, {Q.PAL}, c AS (SELECT image_id, r, g, b, count(*) AS n FROM px WHERE a >= 128 GROUP BY ALL),
m AS (SELECT image_id, n, r, g, b, min({{'d': (r-pr)*(r-pr)+(g-pg)*(g-pg)+(b-pb)*(b-pb) + CASE WHEN greatest(pr,pg,pb)-least(pr,pg,pb) < 28 AND {Q.chroma()} > 40 THEN 324 ELSE 0 END, 'i': idx}}).i AS idx FROM c, slots GROUP BY image_id, n, r, g, b),
a AS (SELECT image_id, idx, sum(r*n)::DOUBLE / sum(n) AS r, sum(g*n)::DOUBLE / sum(n) AS g, sum(b*n)::DOUBLE / sum(n) AS b FROM m GROUP BY image_id, idx)
SELECT im.image_id, slots.idx, coalesce(floor(a.r + 0.5)::INT, pr) AS r, coalesce(floor(a.g + 0.5)::INT, pg) AS g, coalesce(floor(a.b + 0.5)::INT, pb) AS b FROM im CROSS JOIN slots LEFT JOIN a ON a.image_id = im.image_id AND a.idx = slots.idx""")
def refined_palette(s, d):
    return packed.refine_palette(_rows(s, d), fixtures.palette(s, d))


_USAGE = f"WITH {Q.LABELS}, us AS (SELECT im.image_id, slots.idx, count(lb.label) AS area FROM im CROSS JOIN slots LEFT JOIN lb ON lb.image_id = im.image_id AND lb.label = slots.idx GROUP BY ALL)"


@query(_USAGE + " SELECT * FROM us")
def slot_usage(s, d):
    return _usage(s, d)


@query(f"WITH {Q.LABELS} SELECT DISTINCT image_id, label FROM lb WHERE label IS NOT NULL")
def labels_in_use(s, d):
    return match.used_labels(_labels(s, d))


@query(f"""WITH {Q.IMAGES}, m AS (SELECT image_id, unnest([{{'seq': 0, 'a': 3, 'b': 4}}, {{'seq': 1, 'a': 1, 'b': 2}}, {{'seq': 2, 'a': 2, 'b': 3}}]) AS p FROM im)
SELECT image_id, row_number() OVER (PARTITION BY image_id ORDER BY p.seq)::INT AS seq, p.a AS a, p.b AS b FROM m WHERE p.seq > 0 OR image_id % 2 = 0""")
def combined_merges(s, d):
    none = fixtures.merges(s, d).filter("false")
    return match.combine_merges(none, fixtures.merges(s, d), fixtures.palette(s, d))


_ROOTS = f"""mm AS (SELECT image_id, idx, CASE WHEN image_id % 2 = 0 AND idx IN (1, 2, 3) THEN 4 WHEN image_id % 2 = 1 AND idx IN (1, 2) THEN 3 ELSE idx END AS root FROM im CROSS JOIN slots)"""


@query(f"WITH {Q.IMAGES}, {Q.PAL}, {_ROOTS} SELECT image_id, idx, root FROM mm")
def merge_map(s, d):
    pal = fixtures.palette(s, d)
    return palette.build_merge_map(pal, match.combine_merges(fixtures.merges(s, d).filter("false"), fixtures.merges(s, d), pal))


@query(f"WITH {Q.LABELS}, {_ROOTS}, t AS (SELECT lb.image_id, x, y, root AS label FROM lb LEFT JOIN mm ON mm.image_id = lb.image_id AND mm.idx = lb.label) " + Q.DIGEST.format(t="t"))
def merged_labels(s, d):
    return packed.sums(packed.apply_merge_map(_label_rows(s, d), merge_map(s, d)))


@query(_USAGE + f""", {_ROOTS}, j AS (SELECT us.image_id, root, area, pr, pg, pb FROM us JOIN mm USING (image_id, idx) JOIN slots USING (idx)),
a AS (SELECT image_id, root AS idx, CASE WHEN sum(area) > 0 THEN sum(pr*area)::DOUBLE / sum(area) ELSE avg(pr) END AS r, CASE WHEN sum(area) > 0 THEN sum(pg*area)::DOUBLE / sum(area) ELSE avg(pg) END AS g, CASE WHEN sum(area) > 0 THEN sum(pb*area)::DOUBLE / sum(area) ELSE avg(pb) END AS b FROM j GROUP BY ALL)
SELECT us.image_id, us.idx, coalesce(floor(r + 0.5)::INT, pr) AS r, coalesce(floor(g + 0.5)::INT, pg) AS g, coalesce(floor(b + 0.5)::INT, pb) AS b FROM us JOIN slots USING (idx) LEFT JOIN a USING (image_id, idx)""")
def merged_palette(s, d):
    return match.average_merged_palette(fixtures.palette(s, d), _usage(s, d), merge_map(s, d))


@query(_USAGE + f""", offs AS (SELECT image_id, unnest(CASE WHEN image_id % 3 = 0 THEN []::INT[] WHEN image_id % 3 = 1 THEN [2, 4] ELSE [0, 1, 2, 3, 4, 5, 6, 7] END) AS idx FROM im),
u AS (SELECT us.image_id, us.idx, area, offs.idx IS NOT NULL AS off, {Q.lab("pr", "pg", "pb")} AS lab FROM us JOIN slots USING (idx) LEFT JOIN offs ON offs.image_id = us.image_id AND offs.idx = us.idx WHERE area > 0),
one AS (SELECT image_id, arg_max(idx, {{'a': area, 'k': -idx}}) AS keep, bool_and(off) AS none FROM u GROUP BY image_id),
e AS (SELECT u.*, CASE WHEN none THEN idx = keep ELSE NOT off END AS lit FROM u JOIN one USING (image_id))
SELECT p.image_id, p.idx, min({{'d': {Q.delta("p.lab", "q.lab")}, 'i': q.idx}}).i AS root FROM e p JOIN e q ON q.image_id = p.image_id AND q.lit WHERE p.off AND NOT p.lit GROUP BY p.image_id, p.idx""")
def disabled_slots(s, d):
    return match.remap_disabled(_labels(s, d), fixtures.palette(s, d), _usage(s, d), fixtures.disabled(s, d))[1]


@query(f"WITH {Q.IMAGES}, {Q.PAL} SELECT image_id, p.idx AS a, q.idx AS b, round(sqrt(((p.pr-q.pr)*(p.pr-q.pr)+(p.pg-q.pg)*(p.pg-q.pg)+(p.pb-q.pb)*(p.pb-q.pb))::DOUBLE), 6) AS distance FROM im, slots p, slots q WHERE p.idx < q.idx")
def merge_suggestions(s, d):
    return match.suggest_merges(fixtures.palette(s, d)).withColumn("distance", F.round("distance", 6))


@query(f"WITH {Q.PIXELS}, {Q.PAL}, c AS (SELECT DISTINCT r, g, b FROM px), m AS (SELECT r, g, b, min({{'d': (r-pr)*(r-pr)+(g-pg)*(g-pg)+(b-pb)*(b-pb), 'i': idx}}).i AS label FROM c, slots GROUP BY r, g, b), t AS (SELECT image_id, x, y, label FROM px JOIN m USING (r, g, b)) " + Q.DIGEST.format(t="t"))
def plain_nearest_slots(s, d):
    return packed.sums(packed.snap_to_palette(_rows(s, d), fixtures.palette(s, d)))


@query(f"WITH {Q.PIXELS}, t AS (SELECT image_id, x, y, dense_rank() OVER (PARTITION BY image_id ORDER BY r // 12, g // 12, b // 12) - 1 AS label FROM px) " + Q.DIGEST.format(t="t"))
def color_bins(s, d):
    return digest(match.snap_cells_to_palette(by_image(_pixels(s, d))))


@query(f"""WITH {Q.LABELS}, dst AS (SELECT image_id, w AS sw, h AS sh, w + image_id::INT % 7 AS nw, greatest(1, h - 3) AS nh FROM im), ry AS (SELECT *, unnest(range(nh)) AS y FROM dst), rx AS (SELECT *, unnest(range(nw)) AS x FROM ry),
t AS (SELECT rx.image_id, rx.x, rx.y, lb.label FROM rx JOIN lb ON lb.image_id = rx.image_id AND lb.x = least(sw - 1, floor((rx.x + 0.5::DOUBLE) * sw / nw)) AND lb.y = least(sh - 1, floor((rx.y + 0.5::DOUBLE) * sh / nh))) """ + Q.DIGEST.format(t="t"))
def resampled_labels(s, d):
    dims = fixtures.images(s, d).select("image_id", (C("w") + (C("image_id") % 7).cast("int")).alias("w"), F.greatest(F.lit(1), C("h") - 3).alias("h"))
    return packed.sums(packed.resample_nearest(_label_rows(s, d), dims, ["label"]))


@query(f"WITH {Q.LABELS} SELECT image_id, sum(coalesce(pr, 0))::BIGINT AS red, sum(coalesce(pg, 0) * (x + 1))::BIGINT AS green, sum(coalesce(pb, 0) * (y + 1))::BIGINT AS blue, sum(CASE WHEN label IS NULL THEN 0 ELSE 255 END)::BIGINT AS alpha FROM lb LEFT JOIN slots ON idx = label GROUP BY image_id")
def posterized(s, d):
    def run(lines):
        red, green, blue, alpha = packed.channels(lines.values["px"])
        return {"red": red, "green": green * (lines.x + 1), "blue": blue * (lines.y[lines.line].astype("int64") + 1), "alpha": alpha}

    return packed.line_sums(packed.labels_to_rgba(_label_rows(s, d), fixtures.palette(s, d)), run, ["px"], ["red", "green", "blue", "alpha"])


@query(f"WITH {Q.MASK} SELECT image_id, sum(CASE WHEN ink THEN 255 ELSE 0 END)::BIGINT AS alpha, sum(CASE WHEN ink THEN 255 ELSE 0 END)::BIGINT AS white FROM mk GROUP BY image_id")
def ink_plate(s, d):
    return match.mask_to_rgba(_mask(s, d), invert=True).groupBy("image_id").agg(F.sum("a").alias("alpha"), F.sum("r").alias("white"))


# ---- aggregates

@query(f"""WITH {Q.PIXELS}, t AS (SELECT image_id, any_value(w) AS w, any_value(h) AS h, coalesce(avg(x) FILTER (a >= 128 AND x % 2 = 0 AND y % 2 = 0), any_value(w) / 2) AS cx, coalesce(avg(y) FILTER (a >= 128 AND x % 2 = 0 AND y % 2 = 0), any_value(h) / 2) AS cy FROM px GROUP BY image_id)
SELECT image_id, round(cx, 6) AS cx, round(cy, 6) AS cy, round(sqrt(pow(greatest(cx, w - cx), 2) + pow(greatest(cy, h - cy), 2)), 6) AS max_dist FROM t""")
def subject_middle(s, d):
    return palette.opaque_centroid(_raster(s, d)).select("image_id", *(F.round(c, 6).alias(c) for c in ("cx", "cy", "max_dist")))


@query(f"""WITH {Q.PIXELS}, t AS (SELECT image_id, any_value(w) AS w, any_value(h) AS h, avg(x) FILTER (a >= 128 AND x % 2 = 0 AND y % 2 = 0) AS cx, avg(y) FILTER (a >= 128 AND x % 2 = 0 AND y % 2 = 0) AS cy FROM px GROUP BY image_id),
c AS (SELECT image_id, cx, cy, sqrt(pow(greatest(cx, w - cx), 2) + pow(greatest(cy, h - cy), 2)) AS far FROM t),
p AS (SELECT px.image_id, r, g, b, ((r * 24 // 256) * 24 + g * 24 // 256) * 24 + b * 24 // 256 AS bin, (0.55::DOUBLE + 0.45::DOUBLE * (1 - sqrt(pow(x - cx, 2) + pow(y - cy, 2)) / far)) * (1 + 4.2::DOUBLE * pow({Q.chroma()} / 255.0::DOUBLE, 2) + 5.5::DOUBLE * {Q.skin_score()}) AS wt FROM px JOIN c USING (image_id) WHERE a >= 128 AND NOT {Q.leftover()}),
s AS (SELECT image_id, bin, count(*) AS n, floor(avg(r) + 0.5)::INT AS r, floor(avg(g) + 0.5)::INT AS g, floor(avg(b) + 0.5)::INT AS b, sum(wt) AS wt FROM p GROUP BY ALL)
SELECT image_id, bin::INT AS bin, n, r, g, b, round(wt / sum(wt) OVER (PARTITION BY image_id), 6) AS score, {Q.chroma()} AS chroma, round({Q.skin_score()}, 9) AS skin FROM s""")
def histogram_bins(s, d):
    return palette.color_histogram(_raster(s, d)).withColumns({"score": F.round("score", 6), "skin": F.round("skin", 9)})


@query(f"""WITH {Q.PIXELS}, t AS (SELECT *, {Q.lum()} AS l, {Q.lum()}::FLOAT::DOUBLE AS f FROM px WHERE a >= 128),
q AS (SELECT image_id, count(*) AS opaque, sum((l < 70)::INT)::BIGINT AS darkish, sum((l > 200)::INT)::BIGINT AS lightish, avg({Q.chroma()}) AS avg_chroma, avg((f BETWEEN 40 AND 215)::INT) AS m32, avg((l BETWEEN 40 AND 215)::INT) AS m64 FROM t GROUP BY image_id),
z AS (SELECT *, avg_chroma < 28 AND darkish / opaque > 0.08 AND (darkish + lightish) / opaque > 0.82 AS line_art FROM q)
SELECT image_id, opaque, darkish, lightish, round(avg_chroma, 6) AS avg_chroma, line_art, line_art AND m32 < 0.002 AS pure_mask, m64 < 0.002 AS pure_binary, NOT line_art OR avg_chroma >= 14 AS treat_as_color FROM z""")
def ink_statistics(s, d):
    return ink.ink_stats(_pixels(s, d)).withColumn("avg_chroma", F.round("avg_chroma", 6))


# ---- windows on the grid

_PASS1 = Q.SQUARE + ", cnt AS (SELECT image_id, x, y, v, count(*) AS n, min(k) AS k FROM sq WHERE v IS NOT NULL GROUP BY image_id, x, y, v), win AS (SELECT image_id, x, y, arg_max(v, {'n': n, 'k': -k}) AS v, max(n) AS n FROM cnt GROUP BY image_id, x, y)"


@query(f"WITH {Q.LABELS}, {_PASS1}, t AS (SELECT lb.image_id, lb.x, lb.y, CASE WHEN label IS NOT NULL AND lb.x > 0 AND lb.y > 0 AND lb.x < w - 1 AND lb.y < h - 1 THEN v ELSE label END AS label FROM lb LEFT JOIN win ON win.image_id = lb.image_id AND win.x = lb.x AND win.y = lb.y) " + Q.DIGEST.format(t="t"))
def denoised_labels(s, d):
    return packed.sums(packed.denoise_labels(_label_rows(s, d)))


_SIDES = "sd AS (SELECT *, lag(label) OVER (PARTITION BY image_id, x ORDER BY y) AS up, lag(label) OVER (PARTITION BY image_id, y ORDER BY x) AS lf, lead(label) OVER (PARTITION BY image_id, y ORDER BY x) AS rt, lead(label) OVER (PARTITION BY image_id, x ORDER BY y) AS dn FROM lb)"


@query(f"WITH {Q.LABELS}, {_PASS1}, {_SIDES}, t AS (SELECT sd.image_id, sd.x, sd.y, CASE WHEN label IS NOT NULL AND sd.x > 0 AND sd.y > 0 AND sd.x < w - 1 AND sd.y < h - 1 AND (up IS DISTINCT FROM label OR lf IS DISTINCT FROM label OR rt IS DISTINCT FROM label OR dn IS DISTINCT FROM label) AND n >= 5 THEN v ELSE label END AS label FROM sd LEFT JOIN win ON win.image_id = sd.image_id AND win.x = sd.x AND win.y = sd.y) " + Q.DIGEST.format(t="t"))
def smoothed_boundaries(s, d):
    return packed.sums(packed.smooth_label_boundaries(_label_rows(s, d), 1))


@query(f"""WITH {Q.LABELS}, {_SIDES}, v AS (SELECT image_id, x, y, label, unnest([{{'v': up, 'k': 0}}, {{'v': lf, 'k': 1}}, {{'v': rt, 'k': 2}}, {{'v': dn, 'k': 3}}]) AS o FROM sd WHERE label IS NOT NULL),
c AS (SELECT image_id, x, y, o.v AS v, count(*) AS n, min(o.k) AS k FROM v WHERE o.v <> label GROUP BY ALL), b AS (SELECT image_id, x, y, arg_max(v, {{'n': n, 'k': -k}}) AS v, max(n) AS n FROM c GROUP BY ALL),
t AS (SELECT lb.image_id, lb.x, lb.y, CASE WHEN n >= 2 THEN v ELSE label END AS label FROM lb LEFT JOIN b ON b.image_id = lb.image_id AND b.x = lb.x AND b.y = lb.y) """ + Q.DIGEST.format(t="t"))
def overlapped_fills(s, d):
    return packed.sums(packed.overlap_adjacent_fills(_label_rows(s, d)))


@query(f"WITH {Q.MASK}, o AS (SELECT m.image_id, m.x, m.y, m.ink AND NOT (m.x > 0 AND m.y > 0 AND m.x < m.w - 1 AND m.y < m.h - 1 AND sum(n.ink::INT) <= 2) AS ink FROM mk m, (SELECT unnest(range(-1, 2)) AS dx) dxs, (SELECT unnest(range(-1, 2)) AS dy) dys, mk n WHERE n.image_id = m.image_id AND n.x = m.x + dx AND n.y = m.y + dy GROUP BY m.image_id, m.x, m.y, m.w, m.h, m.ink) " + Q.MASK_DIGEST.format(t="o"))
def without_lone_ink(s, d):
    return _ink_sums(packed.remove_isolated_ink(_ink_rows(s, d), 2))


@query(f"""WITH {Q.LABELS}, {_SIDES}, g AS (SELECT image_id, x + 1 AS x1, y AS y1, x + 1 AS x2, y + 1 AS y2 FROM sd WHERE label <> rt UNION ALL SELECT image_id, x, y + 1, x + 1, y + 1 FROM sd WHERE label <> dn)
SELECT image_id, count(*) AS n, sum(x1 + 3 * y1 + 5 * x2 + 7 * y2)::BIGINT AS placed FROM g GROUP BY image_id""")
def wall_segments(s, d):
    out = grid.dedupe_segments(packed.metal_segments(_label_rows(s, d)))
    return out.groupBy("image_id").agg(F.count("*").alias("n"), F.sum(C("x1") + 3 * C("y1") + 5 * C("x2") + 7 * C("y2")).alias("placed"))


_RUNS = "s0 AS (SELECT *, CASE WHEN label IS DISTINCT FROM lag(label) OVER (PARTITION BY image_id, y ORDER BY x) OR x = 0 THEN 1 ELSE 0 END AS f FROM lb), s1 AS (SELECT *, sum(f) OVER (PARTITION BY image_id, y ORDER BY x) AS k FROM s0), rn AS (SELECT image_id, y, min(x) AS x0, count(*) AS len, any_value(label) AS label FROM s1 WHERE label IS NOT NULL GROUP BY image_id, y, k)"


@query(f"WITH {Q.LABELS}, {_RUNS} SELECT image_id, count(*) AS n, sum(label)::BIGINT AS total, sum(x0 * 31 + y * 17 + len * 7)::BIGINT AS placed FROM rn GROUP BY image_id")
def horizontal_runs(s, d):
    r = packed.color_runs(_label_rows(s, d))
    return r.groupBy("image_id").agg(F.count("*").alias("n"), F.sum("label").alias("total"), F.sum(C("x0") * 31 + C("y") * 17 + C("len") * 7).alias("placed"))


_RECTS = _RUNS + ", r1 AS (SELECT *, y - row_number() OVER (PARTITION BY image_id, label, x0, len ORDER BY y) AS st FROM rn), rc AS (SELECT image_id, label, x0 AS x, min(y) AS y, len AS w, count(*) AS h FROM r1 GROUP BY image_id, label, x0, len, st)"


@query(f"WITH {Q.LABELS}, {_RECTS} SELECT image_id, label, count(*) AS n, sum(w * h)::BIGINT AS area, sum(x * 31 + y * 17 + w * 7 + h * 5)::BIGINT AS placed FROM rc GROUP BY image_id, label")
def fill_rectangles(s, d):
    r = packed.color_rects(_label_rows(s, d))
    return r.groupBy("image_id", "label").agg(F.count("*").alias("n"), F.sum(C("w") * C("h")).alias("area"), F.sum(C("x") * 31 + C("y") * 17 + C("w") * 7 + C("h") * 5).alias("placed"))


@query(f"WITH {Q.LABELS}, {_RECTS} SELECT image_id, label, string_agg(printf('M %d %d L %d %d L %d %d L %d %d Z', x, y, x + w, y, x + w, y + h, x, y + h), ' ' ORDER BY y, x) AS d FROM rc GROUP BY image_id, label")
def rectangle_paths(s, d):
    return svg.rects_to_svg_path(packed.color_rects(_label_rows(s, d)))


@query(f"WITH {Q.LABELS}, {_RECTS} SELECT image_id, string_agg(label::VARCHAR, ',' ORDER BY w * h DESC, label, y, x) AS layers FROM rc GROUP BY image_id")
def layer_order(s, d):
    out = svg.order_layers(packed.color_rects(_label_rows(s, d)))
    return out.select("image_id", F.array_join(F.transform("shapes", lambda x: x["label"].cast("string")), ",").alias("layers"))


@query(f"WITH {Q.MASK}, o AS {Q.dilated('mk', 1.49)} " + Q.MASK_DIGEST.format(t="o"))
def dilated_ink(s, d):
    return ink_digest(morph.dilate(_mask(s, d), 1.49))


@query(f"WITH {Q.MASK}, o AS {Q.eroded('mk', 1, 'm.x >= 1 AND m.y >= 1 AND m.x < m.w - 1 AND m.y < m.h - 1')}, t AS (SELECT mk.image_id, mk.x, mk.y, mk.ink AND NOT o.ink AS ink FROM mk JOIN o USING (image_id, x, y)) " + Q.MASK_DIGEST.format(t="t"))
def ink_walls(s, d):
    return ink_digest(morph.stroke_walls(_mask(s, d), 1), "wall")


@query(f"WITH {Q.MASK}, da AS {Q.dilated('mk', 1.25)}, o AS {Q.eroded('da', 1.25, 'm.x >= 1 AND m.y >= 1 AND m.x < m.w - 1 AND m.y < m.h - 1')} " + Q.MASK_DIGEST.format(t="o"))
def closed_ink(s, d):
    return ink_digest(morph.close_mask(_mask(s, d), 1.25))


def _inked(source: str) -> str:
    """CTEs up to ik: image_id, w, h, x, y, base, ring, contour, bw (pure black and white), colour, at a sensitivity of 60."""
    return f"""if_ AS (SELECT image_id, w, h, x, y, a, {Q.lum()} AS d, CASE WHEN a < 128 THEN 255 ELSE {Q.lum()}::FLOAT::DOUBLE END AS l, {Q.chroma()} AS c FROM {source}),
ist AS (SELECT image_id, avg(c) AS ac, sum((d < 70)::INT) / count(*) AS dk, (sum((d < 70)::INT) + sum((d > 200)::INT)) / count(*) AS ends, avg((l BETWEEN 40 AND 215)::INT) AS m32, avg((d BETWEEN 40 AND 215)::INT) AS m64 FROM if_ WHERE a >= 128 GROUP BY image_id),
ifg AS (SELECT image_id, ac < 28 AND dk > 0.08 AND ends > 0.82 AS line, ac, m32, m64 FROM ist),
inb AS (SELECT m.image_id, m.x, m.y, max(n.l) AS mx, bool_or(abs(dx) + abs(dy) = 1 AND (n.a < 128 OR n.l >= 225)) AS four, bool_or(n.a < 128 OR n.l >= 200 OR n.l - m.l >= 45) AS eight
 FROM if_ m, (SELECT unnest(range(-1, 2)) AS dx) dxs, (SELECT unnest(range(-1, 2)) AS dy) dys, if_ n WHERE (dx <> 0 OR dy <> 0) AND n.image_id = m.image_id AND n.x = m.x + dx AND n.y = m.y + dy GROUP BY ALL),
ij AS (SELECT if_.*, line, line AND m32 < 0.002 AS pure, m64 < 0.002 AS bw, NOT line OR ac >= 14 AS colour, mx, four, eight, a >= 128 AS o, {Q.INTERIOR} AS i, CASE WHEN line THEN 115.0 ELSE 61.0 END AS top, CASE WHEN line THEN 11.6 ELSE 22.8 END AS step FROM if_ JOIN inb USING (image_id, x, y) JOIN ifg USING (image_id)),
ik AS (SELECT image_id, w, h, x, y, bw, colour, CASE WHEN pure THEN o AND l <= 88 ELSE i AND o AND l <= top + 40 AND ((l <= top * 0.55 AND c < 35) OR (l <= top AND mx - l >= step) OR l <= 22 OR (line AND l <= top AND c < 40) OR (l <= 85 AND c >= 16)) END AS base,
 i AND o AND colour AND l <= 210 AND four AS ring, i AND o AND colour AND l <= 85 AND eight AS contour FROM ij)"""


@query(f"""WITH {Q.PIXELS}, {_inked("px")}
SELECT image_id, sum((base OR ring OR contour)::INT)::BIGINT AS ink, sum(ring::INT)::BIGINT AS ring, sum(contour::INT)::BIGINT AS contour FROM ik GROUP BY image_id""")
def ink_mask_colors(s, d):
    flags = ink.ink_stats(packed.unpack_rows(fixtures.rows(s, d), ["px"])).select("image_id", "line_art", "pure_mask", "treat_as_color")
    out = packed.ink_mask(_rows(s, d).join(flags, "image_id"), 60)
    return out.groupBy("image_id").agg(*(F.sum(F.size(F.filter(c, lambda v: v)).cast("long")).alias(c) for c in ("ink", "ring", "contour")))


# ---- components, regions and cells; what is greedy is checked by plain loops in the tests

_REGIONS = f"WITH RECURSIVE {Q.LABELS}, {Q.regions('lb', 'label')}"
_NUMBERED = "nu AS (SELECT image_id, c, row_number() OVER (PARTITION BY image_id ORDER BY c) - 1 AS region FROM (SELECT DISTINCT image_id, c FROM gpx WHERE c IS NOT NULL))"


@query(f"{_REGIONS}, {_NUMBERED} SELECT nu.image_id, region, any_value(label) AS label, count(*) AS area FROM gpx JOIN nu USING (image_id, c) GROUP BY nu.image_id, region")
def region_areas(s, d):
    return packed.label_regions(_label_rows(s, d))


@query(f"{_REGIONS}, {_NUMBERED} SELECT nu.image_id, region, any_value(label) AS label, count(*) AS area FROM gpx JOIN nu USING (image_id, c) GROUP BY nu.image_id, region")
def region_areas_spread(s, d):
    """The same regions, found without a task that holds an image; tiles of 8 px so that runs cross them here."""
    return spread.label_regions(packed.color_runs(_label_rows(s, d)), tile=8)


@query(f"{_REGIONS}, {_NUMBERED}, {Q.SIDES} SELECT s.image_id, a.region, key_ AS label, b.region AS other, ok AS other_label, sides FROM sides s JOIN nu a ON a.image_id = s.image_id AND a.c = s.c JOIN nu b ON b.image_id = s.image_id AND b.c = s.oc")
def region_sides(s, d):
    return packed.region_borders(_label_rows(s, d))


def _merged(least: int) -> str:
    """CTEs up to mg: image_id, x, y, label after small regions of gpx have joined their neighbours. State is a map of what was recoloured so far; a step decides one region (then one component) of each image, in order."""

    def vote(of: str) -> str:
        """The label that most sides of list `of` touch under the map m, the lowest among equals; null for no sides."""
        now = "coalesce(m[s.o], s.k)"
        return f"""list_sort(list_transform(list_distinct(list_transform({of}, lambda s: {now})), lambda v: {{'n': -list_sum(list_transform(list_filter({of}, lambda s: {now} = v), lambda s: s.n)), 'v': v}}))[1].v"""

    none = "MAP {}::MAP(BIGINT, INT)"
    put = "CASE WHEN v IS NULL THEN m ELSE map_concat(m, MAP {r: v}) END"
    return f"""mr AS MATERIALIZED (SELECT image_id, c AS r, any_value(key_)::INT AS k, count(*) AS area FROM gpx WHERE c IS NOT NULL GROUP BY image_id, c),
ms AS MATERIALIZED (SELECT image_id, c AS r, list({{'o': oc, 'k': ok::INT, 'n': sides}}) AS l FROM sides GROUP BY image_id, c),
m1 AS MATERIALIZED (SELECT mr.image_id, r, coalesce(l, []) AS l, row_number() OVER (PARTITION BY mr.image_id ORDER BY area, r) AS q FROM mr LEFT JOIN ms USING (image_id, r) WHERE area < {least}),
w1 AS (SELECT DISTINCT image_id, 0::BIGINT AS q, {none} AS m FROM mr UNION ALL SELECT image_id, q, {put} FROM (SELECT w1.image_id, m1.q, m1.r, m, {vote("m1.l")} AS v FROM w1 JOIN m1 ON m1.image_id = w1.image_id AND m1.q = w1.q + 1) z),
f1 AS MATERIALIZED (SELECT image_id, arg_max(m, q) AS m FROM w1 GROUP BY image_id),
n1 AS MATERIALIZED (SELECT mr.image_id, r, coalesce(m[r], k) AS k, area FROM mr JOIN f1 USING (image_id)),
e1 AS MATERIALIZED (SELECT s.image_id, s.c AS a, s.oc AS b, s.sides AS n, x.k = y.k AS same FROM sides s JOIN n1 x ON x.image_id = s.image_id AND x.r = s.c JOIN n1 y ON y.image_id = s.image_id AND y.r = s.oc),
hd(id, c) USING KEY (id) AS (SELECT r, r FROM n1 UNION SELECT e1.b, min(hd.c) FROM hd JOIN e1 ON e1.same AND e1.a = hd.id JOIN recurring.hd AS k ON k.id = e1.b WHERE hd.c < k.c GROUP BY e1.b),
hh AS MATERIALIZED (SELECT n1.*, hd.c AS h FROM n1 JOIN hd ON hd.id = n1.r),
h2 AS MATERIALIZED (SELECT image_id, h AS r, any_value(k) AS k, sum(area) AS area FROM hh GROUP BY image_id, h),
g2 AS (SELECT e1.image_id, p.h AS a, q.h AS b, sum(e1.n) AS n FROM e1 JOIN hh p ON p.image_id = e1.image_id AND p.r = e1.a JOIN hh q ON q.image_id = e1.image_id AND q.r = e1.b WHERE p.h <> q.h GROUP BY ALL),
l2 AS MATERIALIZED (SELECT g2.image_id, g2.a AS r, list({{'o': g2.b, 'k': h2.k, 'n': g2.n}}) AS l FROM g2 JOIN h2 ON h2.image_id = g2.image_id AND h2.r = g2.b GROUP BY g2.image_id, g2.a),
m2 AS MATERIALIZED (SELECT h2.image_id, r, coalesce(l, []) AS l, row_number() OVER (PARTITION BY h2.image_id ORDER BY r) AS q FROM h2 LEFT JOIN l2 USING (image_id, r) WHERE area < {least}),
w2 AS (SELECT DISTINCT image_id, 0::BIGINT AS q, {none} AS m FROM h2 UNION ALL SELECT image_id, q, {put} FROM (SELECT w2.image_id, m2.q, m2.r, m, {vote("m2.l")} AS v FROM w2 JOIN m2 ON m2.image_id = w2.image_id AND m2.q = w2.q + 1) z),
f2 AS (SELECT image_id, arg_max(m, q) AS m FROM w2 GROUP BY image_id), n2 AS MATERIALIZED (SELECT hh.image_id, hh.r, coalesce(m[h], k) AS k FROM hh JOIN f2 USING (image_id)),
mg AS (SELECT gpx.image_id, x, y, n2.k AS label FROM gpx LEFT JOIN n2 ON n2.image_id = gpx.image_id AND n2.r = gpx.c)"""


@query(f"{_REGIONS}, {Q.SIDES}, {_merged(8)} " + Q.DIGEST.format(t="mg"))
def small_regions_merged(s, d):
    return packed.sums(packed.merge_small_regions(_label_rows(s, d), 8))


@query(f"""{_REGIONS}, {Q.SIDES}, ar AS (SELECT image_id, c, count(*) AS area FROM gpx WHERE c IS NOT NULL GROUP BY ALL), vo AS (SELECT image_id, c, ok, sum(sides) AS n FROM sides GROUP BY ALL),
be AS (SELECT image_id, c, arg_max(ok, {{'n': n, 'k': -ok}}) AS best FROM vo GROUP BY ALL),
t AS (SELECT g.image_id, g.x, g.y, CASE WHEN area < 12 THEN best ELSE g.label END AS label FROM gpx g LEFT JOIN ar ON ar.image_id = g.image_id AND ar.c = g.c LEFT JOIN be ON be.image_id = g.image_id AND be.c = g.c) """ + Q.DIGEST.format(t="t"))
def specks_dropped(s, d):
    return packed.sums(packed.drop_speck_islands(_label_rows(s, d), 12))


@query(f"WITH RECURSIVE {Q.MASK}, {Q.regions('mk', 'CASE WHEN ink THEN 1 END')}, t AS (SELECT image_id, x, y, ink AND count(*) OVER (PARTITION BY image_id, c) >= 12 AS ink FROM gpx) " + Q.MASK_DIGEST.format(t="t"))
def small_ink_removed(s, d):
    return _ink_sums(packed.remove_small_components(_ink_rows(s, d), 12))


@query(f"""WITH RECURSIVE {Q.MASK}, er AS {Q.eroded('mk', 1, 'm.x >= 1 AND m.y >= 1 AND m.x < m.w - 1 AND m.y < m.h - 1')}, {Q.regions('mk', 'CASE WHEN NOT ink THEN 1 END')}, {Q.touching()}, ho AS (SELECT image_id, x, y FROM gt WHERE NOT ink AND NOT t),
ri AS (SELECT DISTINCT image_id, x + dx AS x, y + dy AS y FROM ho, (SELECT unnest(range(-1, 2)) AS dx) dxs, (SELECT unnest(range(-1, 2)) AS dy) dys),
t AS (SELECT mk.image_id, mk.x, mk.y, mk.ink AND (NOT er.ink OR ri.x IS NOT NULL) AS ink FROM mk JOIN er USING (image_id, x, y) LEFT JOIN ri USING (image_id, x, y)) """ + Q.MASK_DIGEST.format(t="t"))
def hole_ring_walls(s, d):
    return _ink_sums(packed.map_ink(_ink_rows(s, d).select(*packed.LINE, "ink"), packed.hole_ring_walls))


@query(f"WITH RECURSIVE {Q.PIXELS}, mk AS (SELECT image_id, w, h, x, y, a, {Q.lum()} < 30 AND a >= 128 AS ink FROM px), {Q.regions('mk', 'CASE WHEN a <= 96 AND NOT ink THEN 1 END')}, {Q.touching()}, t AS (SELECT image_id, x, y, t AS ink FROM gt) " + Q.MASK_DIGEST.format(t="t"))
def exterior_pixels(s, d):
    return _ink_sums(packed.mark_exterior(_ink_rows(s, d)), "exterior")


#: Halo passes spread to the right and down from what lies beside clear pixels; a pass sees the pass before on all sides.
_BESIDE = "((c.x = p.x + 1 AND c.y = p.y) OR (c.x = p.x - 1 AND c.y = p.y) OR (c.x = p.x AND c.y = p.y + 1) OR (c.x = p.x AND c.y = p.y - 1))"
_ONWARD = "((c.x = p.x + 1 AND c.y = p.y) OR (c.x = p.x AND c.y = p.y + 1))"


def _removed(tol: int) -> str:
    """CTEs up to rb: image_id, w, h, x, y, r, g, b, a0 (alpha before), t (flooded), halo, a (alpha at the end). Lone pixels go in rounds, each seeing what the round before took of the pixels above and to the left; ten rounds reach the end on these rasters."""
    passes = "".join(
        f""", hs{k} AS MATERIALIZED (SELECT DISTINCT c.* FROM ca c {'WHERE open' if k == 1 else f'JOIN hh{k - 1} p ON c.image_id = p.image_id AND {_BESIDE} WHERE NOT EXISTS (SELECT 1 FROM hh{k - 1} q WHERE q.image_id = c.image_id AND q.x = c.x AND q.y = c.y)'}),
hp{k} AS (SELECT image_id, x, y FROM hs{k} UNION SELECT c.image_id, c.x, c.y FROM hp{k} p JOIN ca c ON c.image_id = p.image_id AND {_ONWARD}),
hh{k} AS MATERIALIZED (SELECT image_id, x, y FROM hp{k}{f' UNION SELECT * FROM hh{k - 1}' if k > 1 else ''})"""
        for k in range(1, 5)
    )
    rounds = "".join(
        f""", lo{k} AS MATERIALIZED (SELECT c.image_id, c.x, c.y, any_value(c.near) AS near FROM lc c LEFT JOIN {'(SELECT image_id, x, y FROM lc WHERE false)' if k == 1 else f'lo{k - 1}'} p ON p.image_id = c.image_id AND ((p.y = c.y - 1 AND p.x BETWEEN c.x - 1 AND c.x + 1) OR (p.y = c.y AND p.x = c.x - 1))
 GROUP BY c.image_id, c.x, c.y HAVING any_value(c.near) - count(p.x) <= 1)"""
        for k in range(1, 11)
    )
    return f""", fj AS (SELECT * RENAME (c AS chro) FROM f), {Q.regions('fj', 'CASE WHEN label THEN 1 END')}, {Q.touching()}, fl AS MATERIALIZED (SELECT *, CASE WHEN t THEN 0 ELSE a END AS a1, bool_or(t) OVER (PARTITION BY image_id) AS hit FROM gt),
sd AS (SELECT *, coalesce(least(lag(a1) OVER (PARTITION BY image_id, x ORDER BY y), lag(a1) OVER (PARTITION BY image_id, y ORDER BY x), lead(a1) OVER (PARTITION BY image_id, y ORDER BY x), lead(a1) OVER (PARTITION BY image_id, x ORDER BY y)) < 16, false) AS open FROM fl),
ca AS MATERIALIZED (SELECT image_id, x, y, open FROM sd WHERE hit AND {_BG_LUM} > 200 AND {_BG_C} < 30 AND {Q.INTERIOR} AND a1 >= 128 AND NOT sk AND l >= greatest(236, {_BG_LUM} - 8) AND chro <= 18){passes},
af AS MATERIALIZED (SELECT fl.*, p.x IS NOT NULL AS halo, CASE WHEN p.x IS NOT NULL THEN 0 ELSE a1 END AS a2 FROM fl LEFT JOIN hh4 p ON p.image_id = fl.image_id AND p.x = fl.x AND p.y = fl.y),
r3 AS (SELECT *, (a2 >= 128)::INT + coalesce(lag(a2 >= 128) OVER (PARTITION BY image_id, y ORDER BY x)::INT, 0) + coalesce(lead(a2 >= 128) OVER (PARTITION BY image_id, y ORDER BY x)::INT, 0) AS three FROM af),
r9 AS (SELECT *, three + coalesce(lag(three) OVER (PARTITION BY image_id, x ORDER BY y), 0) + coalesce(lead(three) OVER (PARTITION BY image_id, x ORDER BY y), 0) - (a2 >= 128)::INT AS near FROM r3),
lc AS MATERIALIZED (SELECT image_id, x, y, near FROM r9 WHERE hit AND {Q.INTERIOR} AND a2 >= 128 AND NOT sk AND near <= 5){rounds},
rb AS (SELECT af.image_id, w, h, af.x, af.y, r, g, b, br, bg, bb, a AS a0, t, halo, CASE WHEN q.x IS NOT NULL THEN 0 ELSE a2 END AS a FROM af LEFT JOIN lo10 q ON q.image_id = af.image_id AND q.x = af.x AND q.y = af.y)"""


_REMOVED = _BACKDROP.replace("WITH ", "WITH RECURSIVE ", 1) + _judged(50) + _removed(50)


@query(_REMOVED + """ SELECT image_id, count(*) FILTER ((t OR halo) AND a0 <> 0) AS cleared, any_value(br)::INT AS r, any_value(bg)::INT AS g, any_value(bb)::INT AS b,
 count(*) FILTER (a >= 128) AS opaque, coalesce(sum(x * 31 + y * 17) FILTER (a >= 128), 0)::BIGINT AS placed FROM rb GROUP BY image_id""")
def background_removed(s, d):
    out = stage(background.remove_background(_rows(s, d), 50), "cleared")
    left = packed.unpack_rows(out, ["px"]).groupBy("image_id").agg(F.count_if(C("a") >= 128).alias("opaque"), F.coalesce(F.sum(F.when(C("a") >= 128, C("x") * 31 + C("y") * 17)), F.lit(0)).alias("placed"))
    return background.cleared_count(out).select("image_id", "cleared", "bg.r", "bg.g", "bg.b").join(left, "image_id")


@query(f"""WITH RECURSIVE {Q.PIXELS}, {Q.PAL}, mk AS (SELECT image_id, w, h, x, y, r, g, b, a, {Q.lum()} < 30 AND a >= 128 AS ink FROM px), {Q.regions('mk', 'CASE WHEN a <= 96 AND NOT ink THEN 1 END', 'e')}, {Q.touching('e')},
ins AS (SELECT image_id, w, h, x, y, r, g, b, a, ink, t FROM et), {Q.regions('ins', 'CASE WHEN NOT ink AND NOT t THEN 1 END')},
se AS (SELECT DISTINCT r, g, b FROM px), nl AS (SELECT r, g, b, min({{'d': (r - pr) * (r - pr) + (g - pg) * (g - pg) + (b - pb) * (b - pb), 'i': idx}}).i AS label FROM se, slots GROUP BY r, g, b),
co AS (SELECT image_id, c, nl.label, count(*) AS n FROM gpx JOIN nl USING (r, g, b) WHERE c IS NOT NULL AND a > 96 GROUP BY ALL), sh AS (SELECT *, n / sum(n) OVER (PARTITION BY image_id, c) AS s FROM co),
be AS (SELECT image_id, c, arg_max(label, {{'n': n, 'k': -label}}) AS label, count(*) AS colours FROM sh WHERE s >= 0.04 GROUP BY image_id, c),
cc AS (SELECT image_id, count(*) AS cell_count, sum((colours > 1)::INT)::BIGINT AS cells_fixed FROM be GROUP BY image_id),
t AS (SELECT gpx.image_id, x, y, be.label FROM gpx LEFT JOIN be ON be.image_id = gpx.image_id AND be.c = gpx.c), dg AS ({Q.DIGEST.format(t="t")})
SELECT dg.*, cell_count, cells_fixed FROM dg LEFT JOIN cc USING (image_id)""")
def dominant_cells(s, d):
    return packed.sums(cells.flood_dominant_cells(_ink_rows(s, d), fixtures.palette(s, d)), keep=["cell_count", "cells_fixed"])


@query()
def pockets_filled(s, d):
    def fill(lines, label, ink_, alpha):
        label, count, fixed = cells.flooded(lines, label, ink_, alpha)
        return cells.filled(lines, label, ink_, alpha), count, fixed

    return packed.sums(cells.map_cells(_ink_rows(s, d), fixtures.palette(s, d), fill))


@query()
def extracted_palette(s, d):
    return palette.extract_palette(_rows(s, d), 12)


_SLOTS = f"""{Q.LABELS}, {Q.CHART}, sl AS (SELECT idx, pr AS r, pg AS g, pb AS b, {Q.lab("pr", "pg", "pb")} AS lab FROM slots),
nr AS (SELECT idx, sl.r, sl.g, sl.b, any_value(lab) AS lab, min({{'d': {Q.delta("lab", "{'l': ll, 'a': la, 'b': lb}")}, 'o': ord, 'c': code, 'r': chart.r, 'g': chart.g, 'b': chart.b}}) AS m FROM sl, chart GROUP BY ALL),
ua AS (SELECT image_id, label AS idx, count(*) AS area FROM lb WHERE label IS NOT NULL GROUP BY ALL)"""


@query(f"""WITH RECURSIVE {_SLOTS}, ca AS (SELECT idx, sl.r, sl.g, sl.b, list({{'d': {Q.delta("lab", "{'l': ll, 'a': la, 'b': lb}")}, 'o': ord, 'c': code, 'r': chart.r, 'g': chart.g, 'b': chart.b}}) AS l FROM sl, chart GROUP BY ALL), cs AS MATERIALIZED (SELECT idx, r, g, b, list_sort(l) AS l FROM ca),
al AS (SELECT im.image_id, sl.idx, coalesce(area, 0) AS area FROM im CROSS JOIN sl LEFT JOIN ua USING (image_id, idx)), rk AS MATERIALIZED (SELECT image_id, idx, row_number() OVER (PARTITION BY image_id ORDER BY area DESC, idx) AS k FROM al),
pk AS (SELECT image_id, 0::BIGINT AS k, []::INT[] AS used, -1 AS idx, NULL::STRUCT(d DOUBLE, o INT, c VARCHAR, r INT, g INT, b INT) AS m FROM im
 UNION ALL SELECT image_id, k, list_append(used, m.o), idx, m FROM (SELECT pk.image_id, rk.k, pk.used, rk.idx, CASE WHEN f IS NOT NULL AND (f.d <= 22 OR f.d <= l[1].d + 6) THEN f ELSE l[1] END AS m
  FROM pk JOIN rk ON rk.image_id = pk.image_id AND rk.k = pk.k + 1 JOIN (SELECT idx, l FROM cs) q ON q.idx = rk.idx, LATERAL (SELECT list_filter(q.l, lambda c: NOT list_contains(pk.used, c.o))[1] AS f) z)),
ow AS (SELECT image_id, idx, cs.r, cs.g, cs.b, m, m.d > 22 OR (greatest(cs.r, cs.g, cs.b) - least(cs.r, cs.g, cs.b) >= 40 AND greatest(m.r, m.g, m.b) - least(m.r, m.g, m.b) < (greatest(cs.r, cs.g, cs.b) - least(cs.r, cs.g, cs.b)) * 0.55) AS own FROM pk JOIN cs USING (idx) WHERE k > 0)
SELECT image_id, idx, CASE WHEN own THEN r ELSE m.r END AS r, CASE WHEN own THEN g ELSE m.g END AS g, CASE WHEN own THEN b ELSE m.b END AS b, m.c AS pms_code, 'PMS ' || m.c AS pms_name, round(m.d, 4) AS pms_delta_e FROM ow""")
def snapped_palette(s, d):
    return palette.snap_palette_to_pms(fixtures.palette(s, d), _usage(s, d)).withColumn("pms_delta_e", F.round("pms_delta_e", 4))


@query(f"""WITH {_SLOTS}, mu AS (SELECT *, m.d > 20 OR (greatest(r, g, b) - least(r, g, b) >= 40 AND greatest(m.r, m.g, m.b) - least(m.r, m.g, m.b) < (greatest(r, g, b) - least(r, g, b)) * 0.55) AS own FROM nr),
ov(idx, code) AS (VALUES (0, '185 C'), (1, '185 C'), (2, 'Black 6 C')), fx AS (SELECT ov.idx, chart.code, chart.r, chart.g, chart.b FROM ov JOIN chart USING (code))
SELECT image_id, idx, coalesce(fx.r, CASE WHEN own THEN mu.r ELSE m.r END)::INT AS r, coalesce(fx.g, CASE WHEN own THEN mu.g ELSE m.g END)::INT AS g, coalesce(fx.b, CASE WHEN own THEN mu.b ELSE m.b END)::INT AS b, coalesce(fx.code, m.c) AS pms_code, 'PMS ' || coalesce(fx.code, m.c) AS pms_name,
CASE WHEN fx.code IS NULL THEN floor(m.d * 10 + 0.5) / 10 ELSE 0 END AS pms_delta_e, printf('#%02x%02x%02x', coalesce(fx.r, CASE WHEN own THEN mu.r ELSE m.r END)::INT, coalesce(fx.g, CASE WHEN own THEN mu.g ELSE m.g END)::INT, coalesce(fx.b, CASE WHEN own THEN mu.b ELSE m.b END)::INT) AS hex FROM ua JOIN mu USING (idx) LEFT JOIN fx USING (idx)""")
def resolved_palette(s, d):
    return match.resolve_palette(fixtures.palette(s, d), _usage(s, d), fixtures.overrides(s, d), chart.pms_chart(s))


@query(f"""WITH RECURSIVE {_SLOTS}, ne AS (SELECT p.idx AS a, q.idx AS b FROM nr p, nr q WHERE {Q.delta("p.lab", "q.lab")} <= 45 OR (p.m.c = q.m.c AND p.m.d <= 45 AND q.m.d <= 45)),
re AS (SELECT a, b FROM ne UNION SELECT re.a, ne.b FROM re JOIN ne ON ne.a = re.b), al AS (SELECT im.image_id, sl.idx, coalesce(area, 0) AS area FROM im CROSS JOIN sl LEFT JOIN ua USING (image_id, idx)),
ro AS (SELECT image_id, a, arg_max(b, {{'n': area, 'k': -b}}) AS b FROM re JOIN al ON al.idx = re.b GROUP BY image_id, a) SELECT image_id, a AS seq, a, b FROM ro WHERE a <> b""")
def automatic_merges(s, d):
    return palette.auto_merge_close_colors(fixtures.palette(s, d), _usage(s, d), 45)


@query()
def wall_polylines(s, d):
    return plates.wall_paths(_label_rows(s, d), 1, 0.8)


def _plate_pairs(s, d):
    """image_id, vector, outline: the plates of each image, drawn in one pass; no outline without ink."""

    def run(lines):
        images, first = plates.image_ids(lines), plates.paths(lines, np.where(lines.values["ink"].astype(bool), 0, -1))
        wide = dict(zip(lines.image_id.tolist(), zip(lines.w.tolist(), lines.h.tolist(), strict=True), strict=True))
        outline = [None] * len(images)
        for k, path in zip(first[0].tolist(), first[3], strict=True):
            (w, h), zoom = wide[int(images[k])], 2 if images[k] % 2 == 0 else 1
            outline[k] = f'<svg viewBox="0 0 {w * zoom} {h * zoom}"><path d="{path}"/></svg>'
        return {"image_id": images, "vector": pa.array(plates.fill_plates(lines, lines.values["label"], plates.fills_of(lines)), pa.string()), "outline": pa.array(outline, pa.string())}

    fills = fixtures.palette(s, d).withColumn("hex", color.rgb_to_hex(*_rgb()))
    rows = packed.quantize(_ink_rows(s, d), fixtures.palette(s, d)).select(*packed.LINE, "ink", "label")
    return packed.found(packed.with_slots(rows, fills, ["idx", "hex"]), run, ["label", "ink"], "image_id long, vector string, outline string", True, ["_palette"])


def _plates(s, d):
    """A colour plate and an outline plate of each image."""
    both = F.array(*(F.struct(F.lit(k).alias("plate"), C(k).alias("svg")) for k in ("vector", "outline")))
    return _plate_pairs(s, d).select("image_id", F.explode(both).alias("p")).select("image_id", "p.*").filter("svg is not null")


_PLATES = f"""{Q.LABELS}, {_RECTS}, ar AS (SELECT image_id, label, sum(w * h) AS area, string_agg(printf('M %d %d L %d %d L %d %d L %d %d Z', x, y, x + w, y, x + w, y + h, x, y + h), ' ' ORDER BY y, x) AS d FROM rc GROUP BY ALL),
fi AS (SELECT image_id, string_agg(printf('<path fill="#%02x%02x%02x" stroke="none" d="', pr, pg, pb) || d || '" />', chr(10) ORDER BY -area, label) AS paths FROM ar JOIN slots ON idx = label GROUP BY image_id),
mk AS (SELECT image_id, w, h, x, y, CASE WHEN {Q.lum()} < 30 AND a >= 128 THEN 0 END AS label FROM px),
m0 AS (SELECT *, CASE WHEN label IS DISTINCT FROM lag(label) OVER (PARTITION BY image_id, y ORDER BY x) OR x = 0 THEN 1 ELSE 0 END AS f FROM mk), m1 AS (SELECT *, sum(f) OVER (PARTITION BY image_id, y ORDER BY x) AS k FROM m0),
mr AS (SELECT image_id, y, min(x) AS x, count(*) AS w FROM m1 WHERE label IS NOT NULL GROUP BY image_id, y, k), m2 AS (SELECT *, y - row_number() OVER (PARTITION BY image_id, x, w ORDER BY y) AS st FROM mr), mc AS (SELECT image_id, x, min(y) AS y, w, count(*) AS h FROM m2 GROUP BY image_id, x, w, st),
ou AS (SELECT image_id, string_agg(printf('M %d %d L %d %d L %d %d L %d %d Z', x, y, x + w, y, x + w, y + h, x, y + h), ' ' ORDER BY y, x) AS d FROM mc GROUP BY image_id),
zo AS (SELECT image_id, w, h, CASE WHEN image_id % 2 = 0 THEN 2 ELSE 1 END AS z FROM im),
pl AS (SELECT image_id, 'outline' AS plate, printf('<svg viewBox="0 0 %d %d">', w * z, h * z) || '<path d="' || d || '"/></svg>' AS svg FROM ou JOIN zo USING (image_id)
 UNION ALL SELECT image_id, 'vector', printf('<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 %d %d" width="%d" height="%d">', w, h, w, h) || chr(10) || coalesce(paths || chr(10), '') || '</svg>' FROM zo LEFT JOIN fi USING (image_id))"""
_METRICS = """SELECT image_id, plate, strlen(svg)::INT AS bytes, len(regexp_extract_all(svg, '(?i)<path\\b'))::INT AS paths, regexp_matches(svg, 'd="[^"]*[CcQq]') AS has_curves, regexp_matches(svg, '(?i)<rect\\b') AS has_background, regexp_extract(svg, 'fill="([^"]+)"', 1) AS first_fill, left(svg, 280) AS head FROM """


@query(f"""WITH {_PLATES}, pr AS (SELECT image_id, 'proof' AS plate, printf('<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 %d %d" width="%d" height="%d" shape-rendering="geometricPrecision">', w, h, w, h) || chr(10) || '{svg.REMARK}' || chr(10) || '<g id="proof-vector">' || coalesce(paths, '') || '</g>' || chr(10)
 || '<g id="proof-outline"' || CASE WHEN z = 2 THEN ' transform="translate(0 0) scale(0.5 0.5)"' ELSE '' END || '><path d="' || d || '"/></g>' || chr(10) || '</svg>' AS svg FROM zo JOIN ou USING (image_id) LEFT JOIN fi USING (image_id)) """ + _METRICS + "pr")
def stacked_proofs(s, d):
    boxes = lambda k: (svg.view_box(C(k)), svg.inner_svg(C(k)))
    (v, vi), (o, oi) = boxes("vector"), boxes("outline")
    pairs = _plate_pairs(s, d).filter("outline is not null").select("image_id", v.alias("v"), vi.alias("vi"), o.alias("o"), oi.alias("oi"))
    return svg.svg_metrics(svg.composed(pairs))


@query(f"WITH {_PLATES} " + _METRICS + "pl")
def plate_metrics(s, d):
    return svg.svg_metrics(_plates(s, d))


def _nothing(s, d):
    return {"merges": fixtures.merges(s, d).select("image_id", "seq", "a", "b").filter("false"), "overrides": fixtures.overrides(s, d), "disabled": fixtures.disabled(s, d), "chart": chart.pms_chart(s)}


@query()
def vector_summary(s, d):
    drawn, shown, labels, _ = jobs.vectorize_colors(_rows(s, d), **_nothing(s, d))
    area = packed.label_regions(packed.by_image(labels)).groupBy("image_id").agg(F.count("*").alias("regions"))
    out = shown.groupBy("image_id").agg(F.count("*").alias("colors"), F.count_if("enabled").alias("on"), F.countDistinct("pms_code").alias("pms_fills"))
    return out.join(area.hint("merge"), "image_id").join(drawn.select("image_id", F.length("svg").alias("svg_chars")).hint("merge"), "image_id")


_WHITE = ", ".join(f"CASE WHEN a = 255 THEN {k} WHEN a = 0 THEN 255 ELSE floor({k} * (a / 255.0::DOUBLE) + 255 * (1 - a / 255.0::DOUBLE) + 0.5)::INT END AS {k}" for k in "rgb")
_LEAST = "CASE WHEN bw THEN 0 WHEN colour THEN greatest(12, floor(w * h * 4e-5::DOUBLE + 0.5)) ELSE greatest(2, floor(w * h * 2e-6::DOUBLE + 0.5)) END"
#: Neighbours by windows: joins of shifted pixels take ten times as long.
_ROW, _COL = "OVER (PARTITION BY image_id, y ORDER BY x)", "OVER (PARTITION BY image_id, x ORDER BY y)"


def _three(f: str, v: str, over: str) -> str:
    """f of v and its two neighbours along a window."""
    parts = [f"coalesce(lag({v}) {over}, 0)", v, f"coalesce(lead({v}) {over}, 0)"]
    return " + ".join(parts) if f == "sum" else f"{f}({', '.join(parts)})"


_OUTLINE = f"""{_REMOVED}, wp AS MATERIALIZED (SELECT image_id, w, h, x, y, {_WHITE}, 255 AS a FROM rb), {_inked("wp")},
o0 AS MATERIALIZED (SELECT image_id, w, h, x, y, bw, colour, base OR ring OR contour AS ink FROM ik), {Q.regions("o0", "CASE WHEN ink THEN 1 END", "p")},
o1 AS MATERIALIZED (SELECT image_id, w, h, x, y, bw, colour, (ink AND count(*) OVER (PARTITION BY image_id, c) >= {_LEAST})::INT AS ink FROM ppx), {Q.regions("o1", "CASE WHEN ink = 0 THEN 1 END", "q")}, {Q.touching("q")},
oh AS (SELECT *, {_three("least", "ink", _ROW)} AS lr, {_three("least", "ink", _COL)} AS lc, (ink = 0 AND NOT t)::INT AS hole FROM qt), oi AS (SELECT *, {_three("greatest", "hole", _ROW)} AS hr FROM oh), oj AS (SELECT *, {_three("greatest", "hr", _COL)} AS ho FROM oi),
o2 AS (SELECT image_id, w, h, x, y, bw, colour, CASE WHEN colour THEN (ink = 1 AND (lr = 0 OR lc = 0 OR ho = 1))::INT ELSE ink END AS ink FROM oj),
ok_ AS (SELECT *, {_three("sum", "ink", _ROW)} AS s3 FROM o2), ol AS (SELECT *, {_three("sum", "s3", _COL)} AS s9 FROM ok_),
o3 AS MATERIALIZED (SELECT image_id, w, h, x, y, colour, ink = 1 AND NOT ({Q.INTERIOR} AND s9 <= CASE WHEN colour THEN 2 WHEN bw THEN 0 ELSE 1 END) AS ink FROM ol),
{Q.regions("o3", "CASE WHEN ink THEN 1 END", "v")}, o4 AS (SELECT image_id, w, h, x, y, (ink AND (NOT colour OR count(*) OVER (PARTITION BY image_id, c) >= greatest(4, floor(w * h * 1e-5::DOUBLE + 0.5))))::INT AS ink FROM vpx),
o5 AS (SELECT *, {_three("greatest", "ink", _ROW)} AS i3 FROM o4), o6 AS (SELECT image_id, x, y, {_three("greatest", "i3", _COL)} = 1 AS ink FROM o5) """


@query(_OUTLINE + Q.MASK_DIGEST.format(t="o6"))
def outline_job(s, d):
    return _ink_sums(jobs.extract_outline(_rows(s, d)))


@query()
def cleanup_job(s, d):
    rows, _counts = jobs.clean_up_cells(_ink_rows(s, d), fixtures.palette(s, d))
    return packed.sums(rows, keep=["cell_count", "cells_fixed"])


@query()
def remerge_job(s, d):
    out, shown = jobs.remerge(*_state(s, d), fixtures.merges(s, d), fixtures.overrides(s, d), fixtures.disabled(s, d), chart.pms_chart(s))
    return shown.join(out.select("image_id", F.length("svg").alias("svg_chars")).hint("merge"), "image_id")


@query()
def pin_plate_job(s, d):
    drawn, used = jobs.pin_plate(_rows(s, d), fixtures.images(s, d))
    return drawn.join(used.groupBy("image_id").agg(F.count("*").alias("colors")).hint("merge"), "image_id", "left").select("image_id", "colors", F.length("svg").alias("svg_chars"), F.sha2("svg", 256).alias("digest"))


@query()
def cleanup_proof_job(s, d):
    out, counts = jobs.clean_up_proof(_label_rows(s, d), fixtures.palette(s, d), _ink_rows(s, d))
    return svg.svg_metrics(out).drop("head").join(counts.hint("merge"), "image_id", "left")


@query()
def dual_outputs_job(s, d):
    return svg.svg_metrics(jobs.dual_outputs(_rows(s, d), f"{shared_dir(s)}/dual-{uuid.uuid4().hex}", **_nothing(s, d))).drop("head")


def _state(s, d):
    """Labels and palette, written and read again."""
    folder = f"{shared_dir(s)}/state-{uuid.uuid4().hex}"
    rasters.write_state(_label_rows(s, d).select(*packed.LINE, "label"), fixtures.palette(s, d), folder, 8)
    return rasters.read_state(s, folder)


@query(f"WITH {Q.LABELS}, dg AS ({Q.DIGEST.format(t='lb')}), pa AS (SELECT count(*) AS slots, sum(idx * 1000 + pr * 3 + pg * 5 + pb * 7)::BIGINT AS colors FROM slots) SELECT dg.*, slots, colors FROM dg CROSS JOIN pa")
def saved_state(s, d):
    labels, colours = _state(s, d)
    return packed.sums(labels).join(colours.groupBy("image_id").agg(F.count("*").alias("slots"), F.sum(C("idx") * 1000 + C("r") * 3 + C("g") * 5 + C("b") * 7).alias("colors")), "image_id")


@query(f"WITH {_PLATES} SELECT image_id, p_name || '-vector.svg' AS file_name, strlen(svg) AS bytes, md5(svg) AS digest FROM pl JOIN part ON p_partkey = image_id WHERE plate = 'vector'")
def written_plates(s, d):
    folder = f"{shared_dir(s)}/plates-{uuid.uuid4().hex}"
    fills = fixtures.palette(s, d).withColumn("hex", color.rgb_to_hex(*_rgb()))
    lines = _label_rows(s, d)
    drawn = svg.plate_of_rects(packed.color_rects(lines), fixtures.images(s, d).select("image_id", "w", "h"), fills).join(fixtures.images(s, d).select("image_id", "name"), "image_id").withColumn("plate", F.lit("vector"))
    rasters.write_plates(drawn, folder)
    return s.read.parquet(folder).select("image_id", "file_name", F.octet_length("svg").cast("long").alias("bytes"), F.md5("svg").alias("digest"))


# ---- text

@query("SELECT doc_id, coalesce(nullif(left(regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g'), 48), ''), 'ai-artwork') AS slug FROM documents")
def document_slugs(s, d):
    return s.read.parquet(f"{d}/documents.parquet").select("doc_id", text.slugify(C("text")).alias("slug"))


@query(f"""WITH {Q.IMAGES}, t AS (SELECT image_id, trim(name) || ', themes: ' AS p, CASE image_id % 4 WHEN 0 THEN ['attitude'] WHEN 1 THEN ['attitude', 'horror'] WHEN 2 THEN ['attitude'] ELSE ['sports', 'attitude'] END AS th FROM im),
hints(k, v) AS (VALUES {", ".join(f"('{k}', '{v}')" for k, v in text.THEME_HINTS.items())}), u AS (SELECT image_id, p, unnest(th) AS k, unnest(range(len(th))) AS o FROM t)
SELECT image_id, any_value(p) || string_agg(v, '; ' ORDER BY o) || ', {text.ENDING}' AS prompt FROM u JOIN hints USING (k) GROUP BY image_id""")
def prompts(s, d):
    q = C("image_id") % 4
    word = lambda *w: F.array(*map(F.lit, w))
    themes = F.when(q == 0, F.array().cast("array<string>")).when(q == 1, word("horror", "horror")).when(q == 2, word("attitude", "attitude")).otherwise(word("sports", "attitude"))
    return fixtures.images(s, d).select("image_id", text.build_prompt(C("name"), themes).alias("prompt"))


@query(f"""WITH {Q.IMAGES}, u AS (SELECT image_id, name, CASE WHEN image_id % 11 = 0 THEN 'x' ELSE '' END || 'data:image/' || CASE WHEN image_id % 7 = 0 THEN 'gif' WHEN image_id % 2 = 0 THEN 'jpeg' ELSE 'png' END || ';base64,' || to_base64(name::BLOB) AS u FROM im),
k AS (SELECT *, regexp_matches(u, '^data:image/(png|jpeg);base64,(.+)$') AS ok FROM u)
SELECT image_id, CASE WHEN ok THEN strlen(name) END AS bytes, CASE WHEN ok THEN CASE WHEN image_id % 2 = 0 THEN 'jpg' ELSE 'png' END END AS ext,
CASE WHEN ok THEN '2024-01-02T03-04-05-000Z-' || left(regexp_replace(regexp_replace(lower(name), '[^a-z0-9_-]+', '-', 'g'), '^-|-$', '', 'g'), 40) || CASE WHEN image_id % 2 = 0 THEN '.jpg' ELSE '.png' END END AS file_name,
CASE WHEN ok THEN NULL WHEN starts_with(u, 'data:image/') THEN 'Unsupported image dataUrl' ELSE 'Expected dataUrl image' END AS error FROM k""")
def embedded_images(s, d):
    k = C("image_id")
    kind = F.when(k % 7 == 0, "gif").when(k % 2 == 0, "jpeg").otherwise("png")
    urls = fixtures.images(s, d).select("image_id", C("name").alias("label"), F.concat(F.when(k % 11 == 0, "x").otherwise(""), F.lit("data:image/"), kind, F.lit(";base64,"), F.base64(C("name").cast("binary"))).alias("data_url"))
    out = text.decode_data_url(urls, stamp=F.lit("2024-01-02 03:04:05").cast("timestamp"))
    return out.select("image_id", F.octet_length("content").cast("long").alias("bytes"), "ext", "file_name", "error")


@query("""WITH e AS (SELECT event_id AS job_id, event_id % 5 AS k, floor(value) AS v FROM events)
SELECT job_id, CASE WHEN k = 3 OR k = 4 THEN 50 ELSE greatest(8, least(80, v))::INT END AS tolerance, CASE WHEN k = 0 THEN greatest(0.1, least(6, CASE WHEN v = 0 THEN 0.1 ELSE v END))::DOUBLE ELSE 1.49::DOUBLE END AS thickness,
CASE WHEN k = 1 THEN greatest(4, least(32, v))::INT ELSE 12 END AS colors, CASE WHEN k = 2 THEN true ELSE false END AS invert FROM e""")
def job_settings(s, d):
    k, v = C("event_id") % 5, F.floor("value").cast("string")
    json = F.when(k == 0, F.concat(F.lit('{"backgroundTolerance": '), v, F.lit(', "outline": {"thickness": '), v, F.lit("}}")))
    json = json.when(k == 1, F.concat(F.lit('{"backgroundTolerance": '), v, F.lit(', "vector": {"colorCount": '), v, F.lit("}}")))
    json = json.when(k == 2, F.concat(F.lit('{"backgroundTolerance": '), v, F.lit(', "outline": {"invert": true, "thickness": "3"}}')))
    json = json.when(k == 3, F.concat(F.lit('{"backgroundTolerance": "'), v, F.lit('"}'))).otherwise(F.lit("no json"))
    jobs_ = s.read.parquet(f"{d}/events.parquet").select(C("event_id").alias("job_id"), json.alias("settings_json"))
    st = settings.read_job_settings(jobs_)
    return st.select("job_id", C("settings.background_tolerance").alias("tolerance"), C("settings.outline.thickness").alias("thickness"), C("settings.vector.color_count").alias("colors"), C("settings.outline.invert").alias("invert"))


__all__ = ["oracle_sql", "queries", "rasters"]
