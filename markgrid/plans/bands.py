"""Queries over dark profiles of pages (two orders each): question rows and the shift of a page, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bands
from ..sources.marks import CIRCLES_SQL, circles

ROWS, TOP, BOTTOM, MERGE_GAP, APART, REACH, MOST_SHIFT = 6, 239, 999, 12, 30, 20, 12


def profile(spark, d):
    """page, y, v: on each line the circles' darkness within three lines of their centres."""
    rows = circles(spark, d).select(F.floor(F.col("sheet") / 2).alias("page"), F.explode(F.sequence(F.col("cy") - 3, F.col("cy") + 3)).alias("y"), "dark")
    return rows.groupBy("page", "y").agg(F.sum("dark").alias("v"))


def profile_rows(spark, d):
    return bands.rows_of_profile(profile(spark, d), "page", ROWS, TOP, BOTTOM, MERGE_GAP, APART, REACH, least=8)


def profile_shift(spark, d):
    printed = spark.range(ROWS).select(F.bround(TOP + (F.col("id") + 0.5) * ((BOTTOM - TOP) / ROWS), 0).cast("int").alias("y"))
    return bands.profile_shift(profile(spark, d), printed, "page", MOST_SHIFT)


QUERIES = {f.__name__: f for f in (profile_rows, profile_shift)}

_P = f"c AS ({CIRCLES_SQL}), p AS (SELECT page, y, sum(dark)::BIGINT AS v FROM (SELECT sheet // 2 AS page, unnest(range(cy - 3, cy + 4)) AS y, dark FROM c) GROUP BY ALL)"
_PRINTED = f"round_even({TOP} + (i + 0.5::DOUBLE) * ({BOTTOM - TOP}::DOUBLE / {ROWS}), 0)::INT"
_CEN = "((b.start + b.stop) // 2)"
ORACLES = {
    "profile_rows": f"""WITH RECURSIVE {_P},
m AS (SELECT *, sum(v) OVER (PARTITION BY page ORDER BY y RANGE BETWEEN {REACH} PRECEDING AND {REACH} FOLLOWING)::DOUBLE / {2 * REACH + 1} AS mean FROM p),
k AS (SELECT page, y, y - row_number() OVER (PARTITION BY page ORDER BY y) AS g FROM m WHERE v >= 8 AND v >= 0.5::DOUBLE * mean),
r AS (SELECT page, min(y) AS start, max(y) AS stop FROM k GROUP BY page, g),
s AS (SELECT *, coalesce(start - lag(stop) OVER (PARTITION BY page ORDER BY start) > {MERGE_GAP}, false)::INT AS new FROM r),
t AS (SELECT *, sum(new) OVER (PARTITION BY page ORDER BY start) AS g FROM s),
b AS (SELECT page, min(start) AS start, max(stop) AS stop, row_number() OVER (PARTITION BY page ORDER BY min(start)) AS i FROM t GROUP BY page, g),
f AS (SELECT page, i, [{{'a': start, 'z': stop}}] AS kept FROM b WHERE i = 1
  UNION ALL SELECT f.page, b.i, CASE WHEN {_CEN} - ((f.kept[-1].a + f.kept[-1].z) // 2) >= {APART} THEN list_append(f.kept, {{'a': b.start, 'z': b.stop}})
    WHEN b.stop - b.start > f.kept[-1].z - f.kept[-1].a THEN list_append(f.kept[:-2], {{'a': b.start, 'z': b.stop}}) ELSE f.kept END FROM f JOIN b ON b.page = f.page AND b.i = f.i + 1),
l AS (SELECT page, arg_max(kept, i) AS kept FROM f GROUP BY page),
e AS (SELECT q.page, coalesce(l.kept, []) AS kept, CASE len(coalesce(l.kept, [])) WHEN {ROWS} THEN 'exact' ELSE CASE WHEN len(coalesce(l.kept, [])) > {ROWS} THEN 'trim' WHEN len(coalesce(l.kept, [])) >= 3 THEN 'extrapolated' ELSE 'fallback' END END AS how FROM (SELECT DISTINCT page FROM p) q LEFT JOIN l ON l.page = q.page),
u AS (SELECT page, how, unnest(kept) AS x FROM e WHERE how <> 'fallback'),
h AS (SELECT page, how, (x.a + x.z) // 2 AS y, row_number() OVER (PARTITION BY page ORDER BY x.z - x.a DESC, x.a) AS k FROM u),
o AS (SELECT page, how, y, (row_number() OVER (PARTITION BY page ORDER BY y) - 1)::INT AS row_idx FROM h WHERE k <= {ROWS}),
d AS (SELECT page, y - lag(y) OVER (PARTITION BY page ORDER BY y) AS step FROM o WHERE how = 'extrapolated'),
g1 AS (SELECT page, trunc(trunc(median(step)) * 1.5::DOUBLE) AS most FROM d WHERE step IS NOT NULL GROUP BY page),
g2 AS (SELECT page, trunc(median(step))::INT AS pitch FROM d JOIN g1 USING (page) WHERE step <= most GROUP BY page),
x AS (SELECT page, max(y) AS y, count(*) AS n FROM o WHERE how = 'extrapolated' GROUP BY page)
SELECT page, how, row_idx, y FROM o
UNION ALL SELECT page, 'extrapolated', (n + k - 1)::INT, (y + k * pitch)::INT FROM (SELECT *, unnest(range(1, {ROWS} - n + 1)) AS k FROM x JOIN g2 USING (page))
UNION ALL SELECT page, how, i::INT, {_PRINTED} FROM (SELECT page, how, unnest(range({ROWS})) AS i FROM e WHERE how = 'fallback')""",
    "profile_shift": f"""WITH {_P}, x AS (SELECT {_PRINTED} AS y FROM (SELECT unnest(range({ROWS})) AS i)), s AS (SELECT q.page AS page, k AS shift, coalesce(sum(v), 0)::BIGINT AS score FROM (SELECT DISTINCT page FROM p) q, (SELECT unnest(range(-{MOST_SHIFT}, {MOST_SHIFT + 1})) AS k), x LEFT JOIN p ON p.page = q.page AND p.y = x.y + k GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY score DESC, shift) AS best FROM s) SELECT page, shift::INT AS shift, score FROM r WHERE best = 1""",
}
