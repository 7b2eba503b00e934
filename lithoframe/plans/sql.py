"""SQL that another engine runs on the same tables: common table expressions and what the queries add to them."""

from __future__ import annotations

from lithoframe.sources.chart import chart_tuples
from lithoframe.sources.fixtures import KINDS, PALETTE

IMAGES = """im AS (SELECT p_partkey::BIGINT AS image_id, p_name AS name, (16 + p_size % 17)::INT AS w, (16 + p_size * 7 % 17)::INT AS h,
 (10 + p_size)::INT AS pin_width_mm, CASE WHEN p_partkey % 3 <> 0 THEN (10 + p_partkey % 20)::INT END AS pin_height_mm, (150 + 50 * (p_partkey % 6))::INT AS dpi FROM part)"""

PIXELS = f"""{IMAGES},
kinds(kind, br, bg, bb) AS (VALUES {", ".join(f"({k}, {r}, {g}, {b})" for k, (r, g, b) in KINDS.items())}),
rows_ AS (SELECT image_id, w, h, unnest(range(h))::INT AS y FROM im),
grid AS (SELECT image_id, w, h, y, unnest(range(w))::INT AS x FROM rows_),
nums AS (SELECT *, ((x * 73 + y * 151 + image_id * 197 + x * y * 31) % 97)::INT AS n, x - w // 2 AS dx, y - h // 2 AS dy, least(w, h) // 2 - 2 AS rad, (image_id % 4)::INT AS q FROM grid),
kinded AS (SELECT *, CASE WHEN n = 1 AND q = 0 THEN 9 WHEN dx * dx + dy * dy > rad * rad THEN CASE WHEN n = 3 THEN 8 ELSE 10 + (image_id % 3)::INT END
 WHEN dx * dx + dy * dy > (rad - 2) * (rad - 2) THEN 0 WHEN (dx - 2) * (dx - 2) + (dy + 2) * (dy + 2) <= 2 THEN 1 WHEN n = 0 THEN 6
 ELSE 2 + ((dx >= 0)::INT + 2 * (dy >= 0)::INT + q) % 4 END AS kind FROM nums),
px AS (SELECT image_id, w, h, x, y, greatest(0, least(255, br + n % 5 - 2))::INT AS r, greatest(0, least(255, bg + n % 5 - 2))::INT AS g, greatest(0, least(255, bb + n % 5 - 2))::INT AS b,
 CASE WHEN kind = 9 THEN 0 WHEN n = 2 AND q = 0 THEN 90 ELSE 255 END AS a FROM kinded JOIN kinds USING (kind))"""

PAL = f"""slots(idx, pr, pg, pb) AS (VALUES {", ".join(f"({i}, {', '.join(map(str, KINDS[k]))})" for i, k in enumerate(PALETTE))})"""
CHART = f"""chart(ord, code, r, g, b, ll, la, lb) AS (VALUES {", ".join(f"({o}, '{c}', {r}, {g}, {b}, {x}, {y}, {z})" for o, c, r, g, b, x, y, z in chart_tuples())})"""


def lum(p: str = "") -> str:
    return f"(0.2126::DOUBLE * {p}r + 0.7152::DOUBLE * {p}g + 0.0722::DOUBLE * {p}b)"


def chroma(p: str = "") -> str:
    return f"(greatest({p}r, {p}g, {p}b) - least({p}r, {p}g, {p}b))"


def skin(p: str = "") -> str:
    return f"({lum(p)} BETWEEN 48 AND 248 AND {chroma(p)} BETWEEN 16 AND 130 AND {p}r >= {p}g + 6 AND {p}b <= {p}g + 12 AND ({p}r - {p}b) / 255.0::DOUBLE >= 0.07::DOUBLE AND NOT ({chroma(p)} > 100 AND {p}g < {p}r * 0.45::DOUBLE))"


def skin_score(p: str = "") -> str:
    return f"(CASE WHEN {skin(p)} THEN ({p}r - {p}b) / 255.0::DOUBLE * (1 - abs({lum(p)} - 185) / 185.0::DOUBLE) * least(1.0::DOUBLE, {chroma(p)} / 70.0::DOUBLE) ELSE 0 END)"


def leftover(p: str = "") -> str:
    return f"({lum(p)} >= 248 AND {chroma(p)} <= 12 AND NOT {skin(p)})"


def lab(r: str = "r", g: str = "g", b: str = "b") -> str:
    """A struct l, a, b. Sub-expressions are written out."""
    lin = lambda v: f"(CASE WHEN {v} / 255.0::DOUBLE > 0.04045::DOUBLE THEN pow(({v} / 255.0::DOUBLE + 0.055::DOUBLE) / 1.055::DOUBLE, 2.4::DOUBLE) ELSE {v} / 255.0::DOUBLE / 12.92::DOUBLE END)"
    x = f"(({lin(r)} * 0.4124::DOUBLE + {lin(g)} * 0.3576::DOUBLE + {lin(b)} * 0.1805::DOUBLE) / 0.95047::DOUBLE)"
    y = f"({lin(r)} * 0.2126::DOUBLE + {lin(g)} * 0.7152::DOUBLE + {lin(b)} * 0.0722::DOUBLE)"
    z = f"(({lin(r)} * 0.0193::DOUBLE + {lin(g)} * 0.1192::DOUBLE + {lin(b)} * 0.9505::DOUBLE) / 1.08883::DOUBLE)"
    f = lambda t: f"(CASE WHEN {t} > 0.008856::DOUBLE THEN cbrt({t}) ELSE 7.787::DOUBLE * {t} + 16 / 116.0::DOUBLE END)"
    return f"{{'l': 116 * {f(y)} - 16, 'a': 500 * ({f(x)} - {f(y)}), 'b': 200 * ({f(y)} - {f(z)})}}"


def delta(p: str, q: str) -> str:
    return f"sqrt(pow({p}.l - {q}.l, 2) + pow({p}.a - {q}.a, 2) + pow({p}.b - {q}.b, 2))"


LABELS = f"""{PIXELS}, {PAL},
seen AS (SELECT DISTINCT r, g, b FROM px),
costs AS (SELECT s.r, s.g, s.b, idx, sqrt(((s.r - pr) * (s.r - pr) + (s.g - pg) * (s.g - pg) + (s.b - pb) * (s.b - pb))::DOUBLE)
 + CASE WHEN greatest(pr, pg, pb) - least(pr, pg, pb) < 28 AND ({chroma("s.")} > 40 OR {skin("s.")}) THEN 28 ELSE 0 END
 + CASE WHEN {skin("s.")} AND NOT ps AND greatest(pr, pg, pb) - least(pr, pg, pb) < 35 THEN 35 ELSE 0 END AS d
 FROM seen s, (SELECT idx, pr, pg, pb, {skin("t.")} AS ps FROM (SELECT *, pr AS r, pg AS g, pb AS b FROM slots) t)),
lut AS (SELECT r, g, b, min({{'d': d, 'i': idx}}).i AS idx FROM costs GROUP BY r, g, b),
lb AS (SELECT image_id, w, h, x, y, px.r, px.g, px.b, a, CASE WHEN a >= 128 AND NOT {leftover("px.")} THEN lut.idx END AS label FROM px JOIN lut USING (r, g, b))"""

DIGEST = "SELECT image_id, count(label) AS n, sum(label)::BIGINT AS total, sum(label * (x * 31 + y * 17))::BIGINT AS placed FROM {t} GROUP BY image_id"
SQUARE = """sq AS (SELECT c.image_id, c.x, c.y, c.w, c.h, c.label, n.label AS v, dy * 3 + dx + 4 AS k
 FROM lb c, (SELECT unnest(range(-1, 2)) AS dx) dxs, (SELECT unnest(range(-1, 2)) AS dy) dys, lb n
 WHERE n.image_id = c.image_id AND n.x = c.x + dx AND n.y = c.y + dy)"""
INTERIOR = "x > 0 AND y > 0 AND x < w - 1 AND y < h - 1"
MASK = f"""{PIXELS}, mk AS (SELECT image_id, w, h, x, y, {lum()} < 30 AND a >= 128 AS ink FROM px)"""
MASK_DIGEST = "SELECT image_id, sum(ink::INT)::BIGINT AS n, sum(ink::INT * (x * 31 + y * 17))::BIGINT AS placed FROM {t} GROUP BY image_id"


def disc(radius: float) -> str:
    k = int(radius)
    return "(VALUES " + ", ".join(f"({dx}, {dy})" for dx in range(-k, k + 1) for dy in range(-k, k + 1) if dx * dx + dy * dy <= radius * radius) + ") o(dx, dy)"


def dilated(source: str, radius: float) -> str:
    return f"(SELECT m.image_id, m.w, m.h, m.x, m.y, max(n.ink::INT) = 1 AS ink FROM {source} m, {disc(radius)}, {source} n WHERE n.image_id = m.image_id AND n.x = m.x + dx AND n.y = m.y + dy GROUP BY ALL)"


def eroded(source: str, radius: float, inside: str) -> str:
    return f"(SELECT m.image_id, m.w, m.h, m.x, m.y, min(n.ink::INT) = 1 AND bool_and({inside}) AS ink FROM {source} m, {disc(radius)}, {source} n WHERE n.image_id = m.image_id AND n.x = m.x + dx AND n.y = m.y + dy GROUP BY ALL)"


def regions(source: str, key: str, p: str = "g") -> str:
    """CTEs (for WITH RECURSIVE) that give {p}px: source with key_ and c, the components of equal keys that are not null, named by their first run. Runs travel to the least name that reaches them."""
    return f"""{p}f AS (SELECT *, {key} AS key_ FROM {source}),
{p}s AS (SELECT *, CASE WHEN x = 0 OR key_ IS DISTINCT FROM lag(key_) OVER (PARTITION BY image_id, y ORDER BY x) THEN x END AS st FROM {p}f),
{p}r AS MATERIALIZED (SELECT * EXCLUDE (st), image_id * 1048576 + y * 1024 + max(st) OVER (PARTITION BY image_id, y ORDER BY x) AS id FROM {p}s),
{p}u AS MATERIALIZED (SELECT image_id, y, id, any_value(key_) AS key_, min(x) AS x0, max(x) AS x1 FROM {p}r WHERE key_ IS NOT NULL GROUP BY image_id, y, id),
{p}e AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM {p}u a JOIN {p}u b ON a.image_id = b.image_id AND b.y = a.y + 1 AND a.key_ = b.key_ AND a.x0 <= b.x1 AND b.x0 <= a.x1),
{p}b AS MATERIALIZED (SELECT a, b FROM {p}e UNION ALL SELECT b, a FROM {p}e),
{p}c(id, c) USING KEY (id) AS (SELECT id, id FROM {p}u UNION SELECT {p}b.b, min({p}c.c) FROM {p}c JOIN {p}b ON {p}b.a = {p}c.id JOIN recurring.{p}c AS k ON k.id = {p}b.b WHERE {p}c.c < k.c GROUP BY {p}b.b),
{p}px AS MATERIALIZED (SELECT r.*, k.c FROM {p}r r LEFT JOIN {p}c k ON r.key_ IS NOT NULL AND k.id = r.id)"""


def touching(p: str = "g") -> str:
    """Whether a pixel of {p}px lies in a component that reaches the frame, as {p}t.t."""
    return f"{p}t AS (SELECT *, c IS NOT NULL AND coalesce(bool_or(x = 0 OR y = 0 OR x = w - 1 OR y = h - 1) OVER (PARTITION BY image_id, c), false) AS t FROM {p}px)"


SIDES = """nb AS (SELECT *, lead(c) OVER (PARTITION BY image_id, y ORDER BY x) AS rc, lead(key_) OVER (PARTITION BY image_id, y ORDER BY x) AS rk,
 lead(c) OVER (PARTITION BY image_id, x ORDER BY y) AS dc, lead(key_) OVER (PARTITION BY image_id, x ORDER BY y) AS dk FROM gpx),
one AS (SELECT image_id, c, key_, rc AS oc, rk AS ok FROM nb WHERE c <> rc UNION ALL SELECT image_id, c, key_, dc, dk FROM nb WHERE c <> dc),
sides AS (SELECT image_id, c, key_, oc, ok, count(*) AS sides FROM (SELECT * FROM one UNION ALL SELECT image_id, oc, ok, c, key_ FROM one) GROUP BY ALL)"""
