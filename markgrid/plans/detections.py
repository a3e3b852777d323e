"""Queries of the order-dependent operators; their SQL walks each sheet by recursion."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import greedy
from ..sources.marks import CIRCLES_SQL, circles


def pages(spark, d):
    """Circles on pages of a bounded number of detections: one page a sheet."""
    return circles(spark, d)


def bars_match_greedy(spark, d):
    bars = pages(spark, d).select("sheet", (F.col("q") % 2).alias("below"), F.col("cx").alias("at"))
    return greedy.bars_match(bars, "sheet", 62.0)


def monotone_row_match(spark, d):
    return greedy.match_rows(pages(spark, d), "sheet", 239.0, 63.0, 12, 20.0)


def nms_circles(spark, d):
    return greedy.nms(pages(spark, d), "sheet", 140.0)


def gap_fill_anti(spark, d):
    return greedy.gap_fill(pages(spark, d).withColumn("box", (F.col("dark") <= 25).cast("int")), "sheet", 140.0)


def trim_rows_greedy(spark, d):
    return greedy.trim_rows(pages(spark, d), ["sheet", "q"], [80.0, 230.0, 380.0, 530.0, 680.0])


def proximity_filter(spark, d):
    return greedy.proximity_filter(pages(spark, d), "sheet", "cy", 100.0)


def kmeans_1d(spark, d):
    return greedy.cluster_1d(pages(spark, d), "sheet", "cx", 4)


QUERIES = {f.__name__: f for f in (bars_match_greedy, monotone_row_match, nms_circles, gap_fill_anti, trim_rows_greedy, proximity_filter, kmeans_1d)}

_C = f"c AS ({CIRCLES_SQL})"
ORACLES = {
    "bars_match_greedy": f"""WITH {_C}, t AS (SELECT DISTINCT sheet, cx::DOUBLE AS top FROM c WHERE q % 2 = 0), b AS (SELECT DISTINCT sheet, cx::DOUBLE AS bottom FROM c WHERE q % 2 = 1),
n AS (SELECT t.sheet, top, bottom, abs(bottom - top) AS far, row_number() OVER (PARTITION BY t.sheet, top ORDER BY abs(bottom - top), bottom) AS k FROM t JOIN b ON t.sheet = b.sheet),
w AS (SELECT sheet, bottom, min(top) AS top FROM n WHERE k = 1 AND far < 62 GROUP BY ALL)
SELECT t.sheet, t.top, w.bottom FROM t LEFT JOIN w ON t.sheet = w.sheet AND t.top = w.top""",
    "monotone_row_match": f"""WITH RECURSIVE {_C}, p AS (SELECT DISTINCT sheet, cy::DOUBLE AS cy FROM c),
r(sheet, i, last, hit) AS (SELECT DISTINCT sheet, -1, -1e300::DOUBLE, NULL::DOUBLE FROM p UNION ALL
  SELECT sheet, i + 1, coalesce(found, last), found FROM (SELECT r.sheet, r.i, r.last, (SELECT min(cy) FROM p WHERE p.sheet = r.sheet AND p.cy > r.last AND abs(p.cy - (239 + 63 * (r.i + 1))) <= 20) AS found FROM r WHERE r.i < 11)),
m AS (SELECT sheet, coalesce(median(hit - (239 + 63 * i)), 0) AS shift FROM r WHERE i >= 0 GROUP BY sheet)
SELECT r.sheet, i::BIGINT AS row_idx, coalesce(hit, 239 + 63 * i + shift)::DOUBLE AS y FROM r JOIN m ON r.sheet = m.sheet WHERE i >= 0""",
    "nms_circles": f"""WITH RECURSIVE {_C}, p AS (SELECT *, row_number() OVER (PARTITION BY sheet ORDER BY r DESC, cx, cy) AS k FROM (SELECT DISTINCT sheet, cx, cy, r FROM c)),
w(sheet, k, kept) AS (SELECT sheet, k, [k] FROM p WHERE k = 1 UNION ALL
  SELECT w.sheet, p.k, CASE WHEN EXISTS (SELECT 1 FROM p o WHERE o.sheet = w.sheet AND list_contains(w.kept, o.k) AND (o.cx - p.cx) * (o.cx - p.cx) + (o.cy - p.cy) * (o.cy - p.cy) < 19600) THEN w.kept ELSE list_append(w.kept, p.k) END
  FROM w JOIN p ON p.sheet = w.sheet AND p.k = w.k + 1),
z AS (SELECT sheet, max_by(kept, k) AS kept FROM w GROUP BY sheet)
SELECT p.sheet, cx::DOUBLE AS cx, cy::DOUBLE AS cy, r::DOUBLE AS r FROM p JOIN z ON z.sheet = p.sheet WHERE list_contains(kept, k)""",
    "gap_fill_anti": f"""WITH RECURSIVE {_C}, d AS (SELECT DISTINCT sheet, cx, cy, (dark <= 25) AS box FROM c), b AS (SELECT * FROM d WHERE box),
p AS (SELECT *, row_number() OVER (PARTITION BY sheet ORDER BY cy, cx) AS k FROM d WHERE NOT box),
o AS (SELECT p.* FROM p WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.sheet = p.sheet AND abs(b.cx - p.cx) <= 140 AND abs(b.cy - p.cy) <= 140)),
w(sheet, k, kept) AS (SELECT sheet, 0::BIGINT, []::BIGINT[] FROM (SELECT DISTINCT sheet FROM p) UNION ALL
  SELECT w.sheet, p.k, CASE WHEN NOT EXISTS (SELECT 1 FROM o WHERE o.sheet = w.sheet AND o.k = p.k) OR EXISTS (SELECT 1 FROM p h WHERE h.sheet = w.sheet AND list_contains(w.kept, h.k) AND abs(h.cx - p.cx) <= 140 AND abs(h.cy - p.cy) <= 140) THEN w.kept ELSE list_append(w.kept, p.k) END
  FROM w JOIN p ON p.sheet = w.sheet AND p.k = w.k + 1),
z AS (SELECT sheet, max_by(kept, k) AS kept FROM w GROUP BY sheet)
SELECT p.sheet, cx::DOUBLE AS cx, cy::DOUBLE AS cy FROM p JOIN z ON z.sheet = p.sheet WHERE list_contains(kept, k)""",
    "trim_rows_greedy": f"""WITH RECURSIVE {_C}, p AS (SELECT *, row_number() OVER (PARTITION BY sheet, q ORDER BY cx, cy) AS k FROM (SELECT DISTINCT sheet, q, cx, cy FROM c)),
w(sheet, q, i, taken) AS (SELECT DISTINCT sheet, q, 0, []::BIGINT[] FROM p UNION ALL
  SELECT sheet, q, i + 1, CASE WHEN near IS NULL THEN taken ELSE list_append(taken, near) END FROM (
    SELECT w.*, (SELECT arg_min(p.k, abs(p.cx - (80 + 150 * w.i)) * 10000 + p.k) FROM p WHERE p.sheet = w.sheet AND p.q = w.q AND NOT list_contains(w.taken, p.k)) AS near FROM w WHERE i < 5)),
z AS (SELECT sheet, q, unnest(taken) AS k, unnest(range(len(taken))) AS choice_rank FROM w WHERE i = 5)
SELECT p.sheet, p.q, cx::DOUBLE AS cx, cy::DOUBLE AS cy, choice_rank FROM z JOIN p ON p.sheet = z.sheet AND p.q = z.q AND p.k = z.k""",
    "proximity_filter": f"""WITH RECURSIVE {_C}, r(sheet, cy) AS (SELECT sheet, min(cy) FROM c GROUP BY sheet UNION ALL
  SELECT sheet, after FROM (SELECT r.sheet, (SELECT min(c.cy) FROM c WHERE c.sheet = r.sheet AND c.cy >= r.cy + 100) AS after FROM r) WHERE after IS NOT NULL)
SELECT sheet, cy::DOUBLE AS cy FROM r""",
    "kmeans_1d": f"""WITH {_C}, p AS (SELECT sheet, cx::DOUBLE AS v, row_number() OVER (PARTITION BY sheet ORDER BY cx) AS k, count(*) OVER (PARTITION BY sheet) AS n FROM (SELECT DISTINCT sheet, cx FROM c)),
g AS (SELECT a.sheet, a.k - 1 AS i, b.k AS j, a.n, min(m.v) AS lo, max(m.v) AS hi, floor((sum(m.v * m.v) - sum(m.v) * sum(m.v) / count(*)) * 1000000 + 0.5)::BIGINT AS cost
  FROM p a JOIN p b ON a.sheet = b.sheet AND a.k <= b.k JOIN p m ON m.sheet = a.sheet AND m.k BETWEEN a.k AND b.k GROUP BY ALL),
x AS (SELECT a.sheet, a.j AS c1, b.j AS c2, c.j AS c3, row_number() OVER (PARTITION BY a.sheet ORDER BY a.cost + b.cost + c.cost + d.cost, c.j, b.j, a.j) AS best
  FROM g a JOIN g b ON a.sheet = b.sheet AND b.i = a.j JOIN g c ON c.sheet = a.sheet AND c.i = b.j JOIN g d ON d.sheet = a.sheet AND d.i = c.j WHERE a.i = 0 AND d.j = a.n),
l AS (SELECT p.sheet, v, CASE WHEN n <= 4 THEN k - 1 ELSE (k > c1)::INT + (k > c2)::INT + (k > c3)::INT END::BIGINT AS cluster FROM p LEFT JOIN x ON x.sheet = p.sheet AND best = 1)
SELECT sheet, cluster, count(*) AS n, min(v) AS lo, max(v) AS hi FROM l GROUP BY ALL""",
}
