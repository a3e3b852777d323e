"""Queries over dark discs as pixels: blobs with their hulls, and the darkness under circles, with their SQL.

A page is 32 orders; each circle is a dark disc whose radius grows with its darkness.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import blobs, pages, runs
from ..operators import geometry as geo
from ..sources.marks import CIRCLES_SQL, MASK, circles

ORDERS_A_PAGE = 32
#: Squared bounds of an anchor's size, least ratio of its sides and least solidity (fixed values of the sheet format).
LEAST_AREA, MOST_AREA, LEAST_ASPECT, LEAST_SOLIDITY = 81, 12656, 0.65, 0.70


def dark_radius():
    return F.floor(F.col("r") * F.col("dark") / MASK).cast("int")


def discs(spark, d):
    """Dark discs, a page's together; one without a place or a radius has no pixels."""
    page = F.floor(F.col("sheet") / ORDERS_A_PAGE)
    rows = circles(spark, d).select(page.alias("page"), "cx", "cy", dark_radius().alias("rd")).where("cx IS NOT NULL AND cy IS NOT NULL AND rd >= 0")
    known = F.coalesce(F.col("page"), F.lit(0))
    return pages.by_page(rows, "page").withColumn("id", ((known * 1024 + F.col("cx")) * 2048 + F.col("cy")) * 64 + F.col("rd"))


def blob_rows(spark, d):
    return pages.page_blobs(discs(spark, d), "page", "rd")


def page_blobs(spark, d):
    return blob_rows(spark, d).select("page", "blob", "area", "cx", "cy", "width", "height")


def largest_blob(spark, d):
    """The largest blob of each page that is neither a speck nor a bar."""
    some = page_blobs(spark, d).where((F.col("area") >= 150) & (blobs.aspect() >= 0.2))
    return geo.top_within(some, ["page"], [F.desc("area"), F.asc("blob")], 1).drop("rank")


def blob_solidity(spark, d):
    """Blobs of an anchor's size and squareness, with the share of their hull that they fill."""
    some = blob_rows(spark, d).where((F.col("area") > LEAST_AREA) & (F.col("area") < MOST_AREA) & (blobs.aspect() >= LEAST_ASPECT))
    return some.select("page", "blob", "area", "cx", "cy", blobs.aspect().alias("aspect"), (F.col("area") / F.col("hull")).alias("solidity"))


def anchor_marks(spark, d):
    return blob_solidity(spark, d).where(F.col("solidity") >= LEAST_SOLIDITY)


def disc_darkness(spark, d):
    """The darkness under each circle of a sheet: dark pixels, the best of eleven places sideways, and pixels in all."""
    rows = circles(spark, d).where("r IS NOT NULL").withColumn("rd", dark_radius())
    placed = F.col("sheet").isNotNull() & F.col("cx").isNotNull() & F.col("cy").isNotNull()
    key = ["sheet", "cx", "cy", "r"]
    found = pages.disc_darkness(pages.by_page(rows.where(placed).select(*key, "rd"), "sheet"), "sheet", "r", "rd")
    # a circle without a sheet or a place is over nothing dark
    return found.union(rows.where(~placed).select(*key).distinct().select(*key, F.lit(0).cast("long").alias("dark"), runs.disc_pixels(F.col("r")).alias("mask")))


QUERIES = {f.__name__: f for f in (page_blobs, largest_blob, blob_solidity, disc_darkness)}

_C = f"c AS ({CIRCLES_SQL})"
_REACH = "floor(sqrt(({r} * {r} - dy * dy)::DOUBLE))::INT"
_BLOBS = f"""RECURSIVE {_C}, m AS (SELECT DISTINCT sheet // {ORDERS_A_PAGE} AS page, cx, cy, (r * dark // {MASK})::INT AS rd FROM c), n AS (SELECT *, ((page * 1024 + cx) * 2048 + cy) * 64 + rd AS id FROM m),
t AS (SELECT a.id AS a, b.id AS b FROM n a JOIN n b ON a.page = b.page AND a.id <> b.id AND (a.cx - b.cx) * (a.cx - b.cx) + (a.cy - b.cy) * (a.cy - b.cy) <= (a.rd + b.rd + 1) * (a.rd + b.rd + 1)),
reach AS (SELECT a, b FROM t UNION SELECT reach.a, t.b FROM reach JOIN t ON reach.b = t.a),
l AS (SELECT n.*, least(id, coalesce(low, id)) AS blob FROM n LEFT JOIN (SELECT a, min(b) AS low FROM reach GROUP BY a) ON a = id),
sp AS (SELECT page, blob, cx, cy + dy AS y, {_REACH.format(r="rd")} AS w FROM (SELECT *, unnest(range(-rd, rd + 1)) AS dy FROM l)),
px AS (SELECT DISTINCT page, blob, y, unnest(range(cx - w, cx + w + 1)) AS x FROM sp),
ln AS (SELECT page, blob, y, count(*) AS n, min(x) AS lo, max(x) + 1 AS hi, sum(x) AS sx FROM px GROUP BY ALL),
bl AS (SELECT page, blob, sum(n)::BIGINT AS area, (sum(sx) // sum(n))::BIGINT AS cx, (sum(y * n) // sum(n))::BIGINT AS cy, max(hi) - min(lo) AS width, max(y) - min(y) + 1 AS height FROM ln GROUP BY ALL)"""
_OK = f"area > {LEAST_AREA} AND area < {MOST_AREA} AND least(width, height)::DOUBLE / greatest(width, height) >= {LEAST_ASPECT}::DOUBLE"
_WRAP = lambda name, x, order: f"""{name} AS (SELECT blob, y, {x} AS x, 0::BIGINT AS twice FROM ends WHERE y = first
  UNION ALL SELECT h.blob, e.y, e.{x}, h.twice + (e.{x} + h.x) * (e.y - h.y) FROM {name} h JOIN ends e ON e.blob = h.blob AND e.y > h.y QUALIFY row_number() OVER (PARTITION BY h.blob ORDER BY (e.{x} - h.x)::DOUBLE / (e.y - h.y){order}, e.y DESC) = 1)"""  # noqa: E731
#: The hull by wrapping: from the first line on, the next vertex is the one of the flattest slope outwards.
SOLIDITY_SQL = f"""{_BLOBS}, ok AS (SELECT * FROM bl WHERE {_OK}),
ed AS (SELECT blob, y, min(lo) AS lo, max(hi) AS hi FROM (SELECT blob, unnest([y, y + 1]) AS y, lo, hi FROM ln WHERE blob IN (SELECT blob FROM ok)) GROUP BY ALL),
ends AS (SELECT *, min(y) OVER (PARTITION BY blob) AS first, max(y) OVER (PARTITION BY blob) AS last FROM ed),
{_WRAP("hl", "lo", "")}, {_WRAP("hr", "hi", " DESC")},
hull AS (SELECT blob, (max(r.twice) - max(l.twice)) / 2::DOUBLE AS hull FROM (SELECT hl.blob, hl.twice FROM hl JOIN ends e ON e.blob = hl.blob AND e.y = hl.y AND e.last = e.y) l JOIN (SELECT hr.blob, hr.twice FROM hr JOIN ends e ON e.blob = hr.blob AND e.y = hr.y AND e.last = e.y) r USING (blob) GROUP BY blob),
solid AS (SELECT page, ok.blob, area, cx, cy, least(width, height)::DOUBLE / greatest(width, height) AS aspect, area / hull AS solidity FROM ok JOIN hull ON hull.blob = ok.blob)"""
ORACLES = {
    "page_blobs": f"WITH {_BLOBS} SELECT page, blob, area, cx, cy, width, height FROM bl",
    "largest_blob": f"""WITH {_BLOBS}, k AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY area DESC, blob) AS k FROM bl WHERE area >= 150 AND least(width, height)::DOUBLE / greatest(width, height) >= 0.2::DOUBLE)
SELECT page, blob, area, cx, cy, width, height FROM k WHERE k = 1""",
    "blob_solidity": f"WITH {SOLIDITY_SQL} SELECT * FROM solid",
    "disc_darkness": f"""WITH {_C}, dk AS (SELECT sheet, cx, cy, (r * dark // {MASK})::INT AS rd FROM c),
px AS (SELECT DISTINCT sheet, y, unnest(range(cx - w, cx + w + 1)) AS x FROM (SELECT sheet, cx, cy + dy AS y, {_REACH.format(r="rd")} AS w FROM (SELECT *, unnest(range(-rd, rd + 1)) AS dy FROM dk))),
isl AS (SELECT sheet, y, min(x) AS x0, max(x) AS x1 FROM (SELECT *, x - row_number() OVER (PARTITION BY sheet, y ORDER BY x) AS g FROM px) GROUP BY sheet, y, g),
pr AS (SELECT DISTINCT sheet, cx, cy, r FROM c), pl AS (SELECT *, cy + dy AS y, {_REACH.format(r="r")} AS w FROM (SELECT *, unnest(range(-r, r + 1)) AS dy FROM pr)),
mk AS (SELECT sheet, cx, cy, r, sum(2 * w + 1)::INT AS mask FROM pl GROUP BY ALL),
sh AS (SELECT pl.sheet, pl.cx, pl.cy, pl.r, s, sum(greatest(0, least(x1, pl.cx + s + w) - greatest(x0, pl.cx + s - w) + 1))::BIGINT AS n FROM pl JOIN isl ON isl.sheet = pl.sheet AND isl.y = pl.y, (SELECT unnest(range(-5, 6)) AS s) GROUP BY ALL)
SELECT mk.sheet, mk.cx, mk.cy, mk.r, coalesce(max(n), 0) AS dark, mask FROM mk LEFT JOIN sh ON sh.sheet = mk.sheet AND sh.cx = mk.cx AND sh.cy = mk.cy AND sh.r = mk.r GROUP BY ALL""",
}
