"""Queries over sheet geometry and detected positions, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import geometry as geo
from ..sources import templates as t
from ..sources.marks import CIRCLES_SQL, circles, read
from . import shapes


def sheets(spark, d):
    """order, template attributes: a sheet's template is its order number modulo their count."""
    orders = read(spark, d, "orders").select(F.col("o_orderkey").alias("sheet"), F.col("o_custkey").alias("student"), (F.col("o_orderkey") % 40).cast("int").alias("position"))
    return orders.join(F.broadcast(t.numbered(spark)), "position")


def template_registry(spark, d):
    names = ["template_id", "n_questions", "n_choices", "n_cols", "rtl", "rows_per_col", "n_hdr_rows", "visual_rows", "col_w", "row_h", "bub_r"]
    return sheets(spark, d).groupBy(*names).agg(F.count("*").alias("sheets"), F.countDistinct("student").alias("students"))


def template_geometry(spark, d):
    row = (F.col("student") % F.col("rows_per_col")).cast("int")
    return sheets(spark, d).withColumn("row_idx", row).select("sheet", "template_id", "row_idx", t.row_y(F.col("row_idx")).alias("row_y"), t.header_y(F.floor(F.col("row_idx") / t.HEADER_EVERY)).alias("header_y"))


def bubble_positions(spark, d):
    """Every bubble position of the templates in use, with the number of sheets that have it."""
    used = sheets(spark, d).groupBy("position").agg(F.count("*").alias("sheets"))
    return used.join(F.broadcast(t.grid(t.numbered(spark))), "position").select("template_id", "q", "choice_rank", "col_idx", "row_idx", "cx", "cy", "r", "sheets")


def question_numbering(spark, d):
    """The question and choice that an order's supplier-like position on its sheet stands for."""
    col, row = (F.col("student") % F.col("n_cols")).cast("int"), (F.col("student") % F.col("rows_per_col")).cast("int")
    return sheets(spark, d).withColumns({"col_idx": col, "row_idx": row}).withColumn("q", t.question_at(F.col("col_idx"), F.col("row_idx")).cast("int")).where("q <= n_questions").select("sheet", "template_id", "col_idx", "row_idx", "q")


def column_points(spark, d):
    return circles(spark, d).withColumns({"col_idx": F.floor(F.col("cx") / 188).cast("int"), "choice_rank": (F.col("cy") % 5).cast("int")})


def regularize_median_x(spark, d):
    return geo.regularize(column_points(spark, d).groupBy("col_idx", "choice_rank", "cx").agg(F.count("*").alias("n")), ["col_idx", "choice_rank"], "cx")


def col_mean_center(spark, d):
    """Mean x of each column of a page, and its shift from the printed column centre."""
    rows = column_points(spark, d).groupBy("q", "col_idx").agg((F.sum("cx") / F.count("*")).alias("mean_x"))
    return rows.withColumn("dx", F.bround(F.col("mean_x") - (F.col("col_idx") * 188 + 94), 0).cast("int"))


def rank_within_row(spark, d):
    """Choice ranks of a row's circles from right to left."""
    distinct = circles(spark, d).select("sheet", "q", "cx", "cy").distinct()
    return geo.rank_within(distinct, ["sheet", "q"], [F.desc("cx"), F.asc("cy")], "choice_rank")


def argmax_cell(spark, d):
    return geo.arg_max_cell(circles(spark, d).withColumns({"gx": F.floor(F.col("cx") / 50).cast("int"), "gy": F.floor(F.col("cy") / 50).cast("int")}), ["gx", "gy"], "dark", ["cx", "cy"])


def profile(spark, d):
    """Page and y of rows with more than three dark circles: a projection profile."""
    return circles(spark, d).where("dark > 30").groupBy("q", F.col("cy").alias("y0")).agg(F.count("*").alias("n")).where("n > 1").select("q", (F.col("y0") / 7).cast("int").alias("y"))


def bands(spark, d):
    return geo.bands(profile(spark, d).distinct(), ["q"], "y")


def rle_bands(spark, d):
    return bands(spark, d)


def merge_bands(spark, d):
    return geo.merge_bands(bands(spark, d), ["q"], 3)


def trim_tallest_bands(spark, d):
    return geo.tallest(bands(spark, d).select("q", "start", "stop"), ["q"], 5)


def positions(spark, d):
    return circles(spark, d).select("sheet", "cx").distinct()


def gap_cluster_1d(spark, d):
    return geo.gap_clusters(positions(spark, d), ["sheet"], "cx", 12)


def pitch_median(spark, d):
    return geo.pitch(positions(spark, d), ["sheet"], "cx")


def nearest_lattice(spark, d):
    """Circles' y snapped to their page's row lattice."""
    at = F.col("cy")
    return circles(spark, d).select("sheet", "q", "cx", "cy", geo.snap(at, F.lit(239.0), F.lit(760.0 / 30), 12).alias("y")).distinct()


def nearest_centroid(spark, d):
    return circles(spark, d).withColumn("column", geo.nearest(F.col("cx"), [94.0, 282.0, 470.0, 658.0])).groupBy("q", "column").agg(F.count("*").alias("n"), F.min("cx").alias("lo"), F.max("cx").alias("hi"))


def anchor_fallback(spark, d):
    """Each sheet's corner anchors: a dark circle in the corner's region, else the printed place."""
    corner = F.when((F.col("cx") < 150) & (F.col("cy") < 200), "TL").when((F.col("cx") > 600) & (F.col("cy") < 200), "TR").when((F.col("cx") < 150) & (F.col("cy") > 860), "BL").when((F.col("cx") > 600) & (F.col("cy") > 860), "BR")
    found = circles(spark, d).withColumn("corner", corner).where("corner IS NOT NULL AND dark >= 20")
    best = found.groupBy("sheet", "corner").agg(F.max(F.struct("dark", (-F.col("cx")).alias("x"), (-F.col("cy")).alias("y"))).alias("b"))
    printed = {"TL": (36, 36), "TR": (714, 36), "BL": (36, 1024), "BR": (714, 1024)}
    got = {c: F.max(F.when(F.col("corner") == c, F.struct((-F.col("b.x")).alias("x"), (-F.col("b.y")).alias("y")))).alias(c) for c in printed}
    seen = best.groupBy("sheet").agg(*got.values())
    every = read(spark, d, "orders").select(F.col("o_orderkey").alias("sheet")).distinct().join(seen, "sheet", "left")
    items = [F.struct(F.lit(c).alias("corner"), F.coalesce(F.col(f"{c}.x"), F.lit(x)).alias("x"), F.coalesce(F.col(f"{c}.y"), F.lit(y)).alias("y"), F.col(c).isNotNull().alias("found")) for c, (x, y) in printed.items()]
    return every.select("sheet", F.inline(F.array(*items)))


def boxes(spark, d):
    """Boxes of a second detector (even lines) with confidence: bubbles of 0.25, layout parts (every fourth) of 0.30 or more."""
    conf, part = F.col("fill") / 100.0, F.col("q") % 4 == 0
    c = circles(spark, d).where("q % 2 = 0").select("sheet", "cx", "cy", conf.alias("conf"), F.when(part, "layout").otherwise("bubble").alias("kind"))
    return c.where(F.col("conf") >= F.when(F.col("kind") == "layout", 0.30).otherwise(0.25))


def yolo_overlay(spark, d):
    """Circles joined with boxes of a second detector on their sheet within 140 pixels; the surest box counts."""
    c = circles(spark, d).where("q % 2 = 1").select("sheet", "cx", "cy").distinct()
    found = boxes(spark, d).select("sheet", F.col("cx").alias("ox"), F.col("cy").alias("oy"), "conf").groupBy("sheet", "ox", "oy").agg(F.max("conf").alias("conf"))
    return geo.within_reach(c, found, ["sheet"], 140).groupBy("sheet", "cx", "cy").agg(F.max("conf").alias("conf"), F.count("*").alias("boxes"))


def union_detections(spark, d):
    """Detections of two sources in one table, with what only one of them has left null, counted by sheet."""
    one = circles(spark, d).where("q % 2 = 1").select("sheet", "cx", "cy", F.lit("circle").alias("kind"), F.col("r"))
    return one.unionByName(boxes(spark, d), allowMissingColumns=True).groupBy("sheet", "kind").agg(F.count("*").alias("n"), F.count("r").alias("with_radius"), F.max("conf").alias("conf"))


def anchor_candidates_top12(spark, d):
    """The 12 largest blobs of each page (32 order numbers) that pass the anchor filter: size, squareness, and how much of the hull is dark."""
    found = shapes.anchor_marks(spark, d).select("page", "cx", "cy", "area")
    return geo.top_within(found, ["page"], [F.desc("area"), F.asc("cx"), F.asc("cy")], 12, "place")


def corner_order(spark, d):
    return geo.corners(circles(spark, d), ["sheet"])


QUERIES = {f.__name__: f for f in (
    template_registry, template_geometry, bubble_positions, question_numbering, regularize_median_x, col_mean_center, rank_within_row, argmax_cell, rle_bands, merge_bands, trim_tallest_bands,
    gap_cluster_1d, pitch_median, nearest_lattice, nearest_centroid, anchor_fallback, yolo_overlay, union_detections, anchor_candidates_top12, corner_order,
)}

_T = """tq AS (SELECT * FROM (VALUES (0, 10), (1, 15), (2, 18), (3, 20), (4, 30), (5, 40), (6, 50), (7, 60), (8, 80), (9, 100)) v(i, n_questions)),
t0 AS (SELECT i * 4 + n_choices - 2 AS position, 'Q' || n_questions || '_' || n_choices || 'ch' AS template_id, n_questions, n_choices, CASE WHEN n_questions <= 20 THEN 2 ELSE 4 END AS n_cols,
  CASE WHEN n_questions <= 20 THEN 26 WHEN n_questions <= 50 THEN 20 ELSE 18 END AS css, CASE WHEN n_questions = 20 THEN 0.138::DOUBLE ELSE 0.1::DOUBLE END AS li, CASE WHEN n_questions = 20 THEN 48::DOUBLE ELSE 37::DOUBLE END AS rb
  FROM tq, (VALUES (2), (3), (4), (5)) c(n_choices)),
t1 AS (SELECT *, ceil(n_questions / n_cols)::INT AS rows_per_col FROM t0),
t AS (SELECT *, ceil(rows_per_col / 5)::INT AS n_hdr_rows, (rows_per_col + ceil(rows_per_col / 5))::INT AS visual_rows, 622 // n_cols AS col_w, 760::DOUBLE / (rows_per_col + ceil(rows_per_col / 5)) AS row_h,
  greatest(6, round_even(css * (25.4::DOUBLE / 96::DOUBLE) * (750::DOUBLE / 210::DOUBLE) / 2, 0))::INT AS bub_r FROM t1),
s AS (SELECT o_orderkey AS sheet, o_custkey AS student, t.* FROM orders JOIN t ON t.position = o_orderkey % 40)"""
_ROWY = "round_even(239 + (row_idx + row_idx // 5 + 1.5::DOUBLE) * row_h, 0)::INT"
_C = f"c AS ({CIRCLES_SQL})"
_BANDS = f"""{_C}, p AS (SELECT DISTINCT q, cy // 7 AS y FROM (SELECT q, cy, count(*) AS n FROM c WHERE dark > 30 GROUP BY q, cy) WHERE n > 1),
bands AS (SELECT q, min(y) AS start, max(y) AS stop, count(*) AS size FROM (SELECT q, y, y - row_number() OVER (PARTITION BY q ORDER BY y) AS g FROM p) GROUP BY q, g)"""
_POS = f"{_C}, pos AS (SELECT DISTINCT sheet, cx FROM c)"

ORACLES = {
    "template_registry": f"WITH {_T} SELECT template_id, n_questions, n_choices, n_cols, true AS rtl, rows_per_col, n_hdr_rows, visual_rows, col_w, row_h, bub_r, count(*) AS sheets, count(DISTINCT student) AS students FROM s GROUP BY ALL",
    "template_geometry": f"WITH {_T}, r AS (SELECT *, (student % rows_per_col)::INT AS row_idx FROM s) SELECT sheet, template_id, row_idx, {_ROWY} AS row_y, round_even(239 + (row_idx // 5 * 6 + 0.5::DOUBLE) * row_h, 0)::INT AS header_y FROM r",
    "bubble_positions": f"""WITH {_T}, u AS (SELECT position, count(*) AS sheets FROM s GROUP BY 1),
g AS (SELECT t.*, sheets, unnest(range(n_cols)) AS col_idx FROM t JOIN u USING (position)), h AS (SELECT *, unnest(range(rows_per_col)) AS row_idx FROM g),
k AS (SELECT *, ((n_cols - 1 - col_idx) * rows_per_col + row_idx + 1)::INT AS q, unnest(range(n_choices)) AS choice_rank FROM h),
x AS (SELECT *, 64 + col_idx * col_w + col_w * li AS l, 64 + col_idx * col_w + col_w - (rb + col_w * 0.089::DOUBLE) AS rr FROM k WHERE q <= n_questions)
SELECT template_id, q, choice_rank::INT AS choice_rank, col_idx::INT AS col_idx, row_idx::INT AS row_idx, round_even(l + (n_choices - 1 - choice_rank) * ((rr - l) / (n_choices - 1)), 0)::INT AS cx, {_ROWY} AS cy, bub_r AS r, sheets FROM x""",
    "question_numbering": f"""WITH {_T}, r AS (SELECT *, (student % n_cols)::INT AS col_idx, (student % rows_per_col)::INT AS row_idx FROM s)
SELECT sheet, template_id, col_idx, row_idx, ((n_cols - 1 - col_idx) * rows_per_col + row_idx + 1)::INT AS q FROM r WHERE (n_cols - 1 - col_idx) * rows_per_col + row_idx + 1 <= n_questions""",
    "regularize_median_x": f"""WITH {_C}, p AS (SELECT cx // 188 AS col_idx, cy % 5 AS choice_rank, cx, count(*) AS n FROM c GROUP BY ALL)
SELECT *, round_even(median(cx) OVER (PARTITION BY col_idx, choice_rank), 0)::INT AS cx_median FROM p""",
    "col_mean_center": f"WITH {_C} SELECT q, cx // 188 AS col_idx, sum(cx)::DOUBLE / count(*) AS mean_x, round_even(sum(cx)::DOUBLE / count(*) - (cx // 188 * 188 + 94), 0)::INT AS dx FROM c GROUP BY q, cx // 188",
    "rank_within_row": f"WITH {_C} SELECT *, (row_number() OVER (PARTITION BY sheet, q ORDER BY cx DESC, cy) - 1)::INT AS choice_rank FROM (SELECT DISTINCT sheet, q, cx, cy FROM c)",
    "argmax_cell": f"""WITH {_C}, r AS (SELECT *, cx // 50 AS gx, cy // 50 AS gy, row_number() OVER (PARTITION BY cx // 50, cy // 50 ORDER BY dark DESC, cx, cy) AS k, count(*) OVER (PARTITION BY cx // 50, cy // 50) AS n FROM c)
SELECT gx, gy, dark, cx, cy, n FROM r WHERE k = 1""",
    "rle_bands": f"WITH {_BANDS} SELECT * FROM bands",
    "merge_bands": f"""WITH {_BANDS}, m AS (SELECT *, coalesce(start - lag(stop) OVER (PARTITION BY q ORDER BY start) > 3, false)::INT AS new FROM bands),
n AS (SELECT *, sum(new) OVER (PARTITION BY q ORDER BY start) AS g FROM m) SELECT q, min(start) AS start, max(stop) AS stop, count(*) AS parts FROM n GROUP BY q, g""",
    "trim_tallest_bands": f"""WITH {_BANDS}, k AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY stop - start DESC, start) AS k FROM bands)
SELECT q, start, stop, (row_number() OVER (PARTITION BY q ORDER BY start) - 1)::INT AS place FROM k WHERE k <= 5""",
    "gap_cluster_1d": f"""WITH {_POS}, m AS (SELECT *, coalesce(cx - lag(cx) OVER (PARTITION BY sheet ORDER BY cx) >= 12, false)::INT AS new FROM pos), n AS (SELECT *, sum(new) OVER (PARTITION BY sheet ORDER BY cx)::BIGINT AS cluster FROM m)
SELECT sheet, cluster, count(*) AS n, sum(cx)::DOUBLE / count(*) AS centre, min(cx) AS lo, max(cx) AS hi FROM n GROUP BY sheet, cluster""",
    "pitch_median": f"WITH {_POS}, m AS (SELECT sheet, lead(cx) OVER (PARTITION BY sheet ORDER BY cx) - cx AS step FROM pos) SELECT sheet, median(step)::DOUBLE AS pitch, count(*) AS steps FROM m WHERE step > 5 GROUP BY sheet",
    "nearest_lattice": f"""WITH {_C}, l AS (SELECT DISTINCT sheet, q, cx, cy FROM c),
n AS (SELECT *, round_even(239::DOUBLE + floor((cy - 239::DOUBLE) / (760::DOUBLE / 30) + 0.5::DOUBLE) * (760::DOUBLE / 30), 0)::INT AS v FROM l)
SELECT sheet, q, cx, cy, CASE WHEN abs(v - cy) <= 12 THEN v ELSE cy END AS y FROM n""",
    "nearest_centroid": f"""WITH {_C}, k AS (SELECT *, CASE WHEN cx <= 188 THEN 0 WHEN cx <= 376 THEN 1 WHEN cx <= 564 THEN 2 ELSE 3 END AS "column" FROM c) SELECT q, "column", count(*) AS n, min(cx) AS lo, max(cx) AS hi FROM k GROUP BY ALL""",
    "anchor_fallback": f"""WITH {_C}, f AS (SELECT *, CASE WHEN cx < 150 AND cy < 200 THEN 'TL' WHEN cx > 600 AND cy < 200 THEN 'TR' WHEN cx < 150 AND cy > 860 THEN 'BL' WHEN cx > 600 AND cy > 860 THEN 'BR' END AS corner FROM c WHERE dark >= 20),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sheet, corner ORDER BY dark DESC, cx, cy) AS k FROM f WHERE corner IS NOT NULL) WHERE k = 1),
e AS (SELECT DISTINCT o_orderkey AS sheet, corner, px, py FROM orders, (VALUES ('TL', 36, 36), ('TR', 714, 36), ('BL', 36, 1024), ('BR', 714, 1024)) v(corner, px, py))
SELECT e.sheet, e.corner, coalesce(cx, px) AS x, coalesce(cy, py) AS y, cx IS NOT NULL AS found FROM e LEFT JOIN b ON b.sheet = e.sheet AND b.corner = e.corner""",
    "yolo_overlay": f"""WITH {_C}, a AS (SELECT DISTINCT sheet, cx, cy FROM c WHERE q % 2 = 1), b AS (SELECT sheet, cx AS ox, cy AS oy, max(fill)::DOUBLE / 100 AS conf FROM c WHERE q % 2 = 0 AND fill >= CASE WHEN q % 4 = 0 THEN 30 ELSE 25 END GROUP BY ALL)
SELECT a.sheet, cx, cy, max(conf) AS conf, count(*) AS boxes FROM a JOIN b ON a.sheet = b.sheet AND (cx - ox) * (cx - ox) + (cy - oy) * (cy - oy) <= 19600 GROUP BY ALL""",
    "union_detections": f"""WITH {_C}, u AS (SELECT sheet, 'circle' AS kind, r, NULL::INT AS conf FROM c WHERE q % 2 = 1 UNION ALL SELECT sheet, CASE WHEN q % 4 = 0 THEN 'layout' ELSE 'bubble' END, NULL, fill FROM c WHERE q % 2 = 0 AND fill >= CASE WHEN q % 4 = 0 THEN 30 ELSE 25 END)
SELECT sheet, kind, count(*) AS n, count(r) AS with_radius, max(conf)::DOUBLE / 100 AS conf FROM u GROUP BY ALL""",
    "anchor_candidates_top12": f"""WITH {shapes.SOLIDITY_SQL}, k AS (SELECT page, cx, cy, area, (row_number() OVER (PARTITION BY page ORDER BY area DESC, cx, cy) - 1)::INT AS place FROM solid WHERE solidity >= {shapes.LEAST_SOLIDITY}::DOUBLE)
SELECT * FROM k WHERE place < 12""",
    "corner_order": "WITH " + _C + ", " + ", ".join(f"{n} AS (SELECT sheet, cx AS {n}_x, cy AS {n}_y FROM (SELECT *, row_number() OVER (PARTITION BY sheet ORDER BY {k}, cx, cy) AS k FROM c) WHERE k = 1)" for n, k in (("tl", "cx + cy"), ("tr", "cy - cx"), ("br", "-(cx + cy)"), ("bl", "cx - cy"))) + " SELECT * FROM tl JOIN tr USING (sheet) JOIN br USING (sheet) JOIN bl USING (sheet)",
}
