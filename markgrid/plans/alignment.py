"""Queries that align pages: the quad of each page, the projective map to the printed page, and points under it, with
their SQL.

Of three ways the first that a page offers is taken: the quad of its anchor marks, the outer corners of what is on it
(if they span enough of the page), or the whole image.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import geometry as geo
from ..operators import projective
from ..sources.marks import CIRCLES_SQL, circles
from . import layout
from .shapes import ORDERS_A_PAGE

WIDTH, HEIGHT, INSET = 750, 1060, 10
# Fixed values of the sheet format: where the anchors are printed, and how sure each way is.
PRINTED, EDGES = (36, 36, 714, 1024), (0, 0, WIDTH - 1, HEIGHT - 1)
SURE = {"anchor-based": 0.95, "contour": 0.60, "full-image": 0.25}
LEAST_SPAN = 0.35 * WIDTH * HEIGHT
CORNERS = ("tl", "tr", "br", "bl")
WHOLE = dict(zip(CORNERS, ((INSET, INSET), (WIDTH - INSET, INSET), (WIDTH - INSET, HEIGHT - INSET), (INSET, HEIGHT - INSET))))


def paged(spark, d):
    return circles(spark, d).withColumn("page", F.floor(F.col("sheet") / ORDERS_A_PAGE))


def map_of(prefix):
    return projective.square_map(*[(F.col(f"{prefix}{c}_x"), F.col(f"{prefix}{c}_y")) for c in CORNERS])


def page_maps(spark, d):
    """page, method, confidence, m (to the unit square), left, top, right, bottom: a row a page."""
    anchors = layout.anchor_quad(spark, d).select("page", map_of("").alias("m1"))
    outer = geo.corners(paged(spark, d), ["page"])
    cross = lambda a, b: F.col(f"{a}_x") * F.col(f"{b}_y") - F.col(f"{b}_x") * F.col(f"{a}_y")
    span = F.abs(cross("tl", "tr") + cross("tr", "br") + cross("br", "bl") + cross("bl", "tl")) / F.lit(2.0)
    both = outer.select("page", F.when(span >= LEAST_SPAN, map_of("")).alias("m2")).join(anchors, "page", "left")
    m3 = projective.square_map(*[(F.lit(x), F.lit(y)) for x, y in WHOLE.values()])
    method = F.when(F.col("m1").isNotNull(), "anchor-based").when(F.col("m2").isNotNull(), "contour").otherwise("full-image")
    named = both.select("page", method.alias("method"), F.coalesce("m1", "m2", m3).alias("m"))
    sure = F.coalesce(*[F.when(F.col("method") == k, F.lit(v)) for k, v in SURE.items()])
    sides = [F.when(F.col("method") == "anchor-based", p).otherwise(e).alias(n) for n, p, e in zip(("left", "top", "right", "bottom"), PRINTED, EDGES)]
    return named.select("page", "method", sure.alias("confidence"), "m", *sides)


def taken(x, y):
    return projective.mapped(F.col("m"), x, y, tuple(F.col(c).cast("double") for c in ("left", "top", "right", "bottom")))


def page_alignment(spark, d):
    """How each page is aligned, and where the centre of its image comes to lie."""
    x, y = taken(F.lit(WIDTH / 2), F.lit(HEIGHT / 2))
    return page_maps(spark, d).select("page", "method", "confidence", x.alias("centre_x"), y.alias("centre_y"))


def aligned_circles(spark, d):
    """The circles of each page on the aligned page."""
    x, y = taken(F.col("cx"), F.col("cy"))
    rows = paged(spark, d).select("page", "sheet", "q", "cx", "cy").repartition("page").distinct()  # dealt once, for the join too
    return rows.join(page_maps(spark, d), "page").select("sheet", "q", "cx", "cy", x.alias("x"), y.alias("y"))


QUERIES = {f.__name__: f for f in (page_alignment, aligned_circles)}


def _map_sql(source: str, name: str) -> str:
    """name: source (page, tl_x .. bl_y) with ma..mi, where no three corners are in line."""
    d = lambda i, j, a: f"({CORNERS[i]}_{a} - {CORNERS[j]}_{a})::DOUBLE"
    s = lambda a: f"(tl_{a} - tr_{a} + br_{a} - bl_{a})::DOUBLE"
    turn = lambda i, j, k: f"(({CORNERS[j]}_x - {CORNERS[i]}_x) * ({CORNERS[k]}_y - {CORNERS[i]}_y) - ({CORNERS[j]}_y - {CORNERS[i]}_y) * ({CORNERS[k]}_x - {CORNERS[i]}_x)) <> 0"
    usable = " AND ".join(turn(i, (i + 1) % 4, (i + 2) % 4) for i in range(4))
    return f"""{name}1 AS (SELECT *, {d(1, 2, "x")} * {d(3, 2, "y")} - {d(3, 2, "x")} * {d(1, 2, "y")} AS den, {s("x")} * {d(3, 2, "y")} - {d(3, 2, "x")} * {s("y")} AS g0, {d(1, 2, "x")} * {s("y")} - {s("x")} * {d(1, 2, "y")} AS h0 FROM {source} WHERE {usable}),
{name}2 AS (SELECT page, den, g0, h0, {d(1, 0, "x")} * den + g0 * tr_x AS a0, {d(3, 0, "x")} * den + h0 * bl_x AS b0, tl_x * den AS c0, {d(1, 0, "y")} * den + g0 * tr_y AS d0, {d(3, 0, "y")} * den + h0 * bl_y AS e0, tl_y * den AS f0 FROM {name}1),
{name} AS (SELECT page, e0 * den - f0 * h0 AS ma, c0 * h0 - b0 * den AS mb, b0 * f0 - c0 * e0 AS mc, f0 * g0 - d0 * den AS md, a0 * den - c0 * g0 AS me, c0 * d0 - a0 * f0 AS mf, d0 * h0 - e0 * g0 AS mg, b0 * g0 - a0 * h0 AS mh, a0 * e0 - b0 * d0 AS mi FROM {name}2)"""


_M = [f"m{c}" for c in projective.NAMES]
_PICK = ", ".join(f"CASE WHEN a.page IS NOT NULL THEN a.{c} WHEN o.page IS NOT NULL THEN o.{c} ELSE f.{c} END AS {c}" for c in _M)
_SIDES = ", ".join(f"CASE WHEN a.page IS NOT NULL THEN {p} ELSE {e} END AS {n}" for n, p, e in zip(("l", "t", "r", "b"), PRINTED, EDGES))
_WHOLE = ", ".join(f"{v}::BIGINT AS {c}_{a}" for c, xy in WHOLE.items() for a, v in zip("xy", xy))
_SPAN = "abs(tl_x * tr_y - tr_x * tl_y + tr_x * br_y - br_x * tr_y + br_x * bl_y - bl_x * br_y + bl_x * tl_y - tl_x * bl_y) / 2::DOUBLE"
_MAPS = f"""c AS ({CIRCLES_SQL}), p AS (SELECT *, sheet // {ORDERS_A_PAGE} AS page FROM c), quad AS ({layout.ORACLES["anchor_quad"]}),
k AS (SELECT page, {", ".join(f"arg_min({{'x': cx, 'y': cy}}, ({e})::BIGINT * 100000000 + cx * 10000 + cy) AS {n}" for n, e in (("tl", "cx + cy"), ("tr", "cy - cx"), ("br", "-(cx + cy)"), ("bl", "cx - cy")))} FROM p GROUP BY page),
outer0 AS (SELECT page, {", ".join(f"{c}.{a}::BIGINT AS {c}_{a}" for c in CORNERS for a in "xy")} FROM k), outer1 AS (SELECT * FROM outer0 WHERE {_SPAN} >= {LEAST_SPAN}::DOUBLE), whole AS (SELECT -1 AS page, {_WHOLE}),
{_map_sql("quad", "ma_")}, {_map_sql("outer1", "mo_")}, {_map_sql("whole", "mf_")},
maps AS (SELECT outer0.page, CASE WHEN a.page IS NOT NULL THEN 'anchor-based' WHEN o.page IS NOT NULL THEN 'contour' ELSE 'full-image' END AS method, {_PICK}, {_SIDES} FROM outer0 LEFT JOIN ma_ a ON a.page = outer0.page LEFT JOIN mo_ o ON o.page = outer0.page, mf_ f)"""
_AT = lambda x, y: f"l + (r - l)::DOUBLE * ((ma * {x} + mb * {y} + mc) / nullif(mg * {x} + mh * {y} + mi, 0)) AS {{}}, t + (b - t)::DOUBLE * ((md * {x} + me * {y} + mf) / nullif(mg * {x} + mh * {y} + mi, 0)) AS {{}}"
ORACLES = {
    "page_alignment": f"WITH {_MAPS} SELECT page, method, CASE method {' '.join(f'''WHEN '{k}' THEN {v}::DOUBLE''' for k, v in SURE.items())} END AS confidence, {_AT(f'{WIDTH / 2}::DOUBLE', f'{HEIGHT / 2}::DOUBLE').format('centre_x', 'centre_y')} FROM maps",
    "aligned_circles": f"WITH {_MAPS}, e AS (SELECT DISTINCT page, sheet, q, cx, cy FROM p) SELECT sheet, q, cx, cy, {_AT('cx::DOUBLE', 'cy::DOUBLE').format('x', 'y')} FROM e JOIN maps ON maps.page = e.page",
}
