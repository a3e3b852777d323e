"""Order-dependent operators and kernels against brute force and golden values."""

import itertools

import numpy as np

from markgrid.operators import geometry, greedy
from markgrid.sources import templates as t

# questions, columns, rows, headers, visual rows, column width, radius, x of ranks 0..4, first row's y, first question of column 0
GOLDEN = [
    (10, 2, 5, 1, 6, 311, 12, [310, 257, 203, 149, 95], 429, 6),
    (15, 2, 8, 2, 10, 311, 12, [310, 257, 203, 149, 95], 353, 9),
    (20, 2, 10, 2, 12, 311, 12, [299, 251, 203, 155, 107], 334, 11),
    (30, 4, 8, 2, 10, 155, 9, [168, 146, 124, 102, 80], 353, 25),
    (50, 4, 13, 3, 16, 155, 9, [168, 146, 124, 102, 80], 310, 40),
    (100, 4, 25, 5, 30, 155, 9, [168, 146, 124, 102, 80], 277, 76),
]


def test_template_geometry(spark):
    rows = t.templates(spark)
    assert rows.count() == 40 and rows.select("template_id").distinct().count() == 40
    cells = t.grid(rows.where("n_choices = 5")).toPandas()
    for q, cols, per, hdr, vis, width, r, xs, y, first in GOLDEN:
        own = cells[cells.n_questions == q]
        assert len(own) == 5 * q and sorted(own.q.unique()) == list(range(1, q + 1))
        top = own[(own.col_idx == 0) & (own.row_idx == 0)].sort_values("choice_rank")
        assert list(top.cx) == xs and set(top.cy) == {y} and set(top.q) == {first} and set(top.r) == {r}
        assert set(zip(own.n_cols, own.rows_per_col, own.n_hdr_rows, own.visual_rows, own.col_w)) == {(cols, per, hdr, vis, width)}


def test_kmeans_is_exact():
    r = np.random.default_rng(0)
    for _ in range(30):
        v = np.sort(r.integers(0, 60, 8).astype(float))
        label = greedy.kmeans_1d(np.stack([v, v + 7]), 3)
        assert (label[0] == label[1]).all()
        label = label[0]
        cost = lambda cuts: sum(((p - p.mean()) ** 2).sum() for p in np.split(v, cuts) if len(p))
        best = min(cost(list(c)) for c in itertools.combinations(range(1, 8), 2))
        assert abs(sum(((v[label == c] - v[label == c].mean()) ** 2).sum() for c in set(label)) - best) < 1e-9


def test_suppression_keeps_a_maximal_set(spark):
    r = np.random.default_rng(4)
    rows = {(s, int(x), int(y), int(z)) for s in range(40) for x, y, z in zip(r.integers(0, 60, 12), r.integers(0, 60, 12), r.integers(1, 5, 12))}
    kept = {tuple(map(int, x)) for x in greedy.nms(spark.createDataFrame(sorted(rows), "sheet long, cx long, cy long, r long"), "sheet", 14.0).select("sheet", "cx", "cy", "r").collect()}
    near = lambda p, q: p[0] == q[0] and (p[1] - q[1]) ** 2 + (p[2] - q[2]) ** 2 < 14 * 14
    assert kept <= rows and not any(near(p, q) for p, q in itertools.combinations(kept, 2))
    assert all(any(near(p, k) and k[3] >= p[3] for k in kept) for p in rows - kept)


def test_matchers(spark):
    bars = spark.createDataFrame([(1, 0, 10), (1, 0, 12), (1, 0, 90), (1, 1, 11), (1, 1, 60), (2, 0, 5), (3, 1, 5)], "sheet int, below int, at int")
    assert sorted(map(tuple, greedy.bars_match(bars, "sheet", 20.0).collect())) == [(1, 10.0, 11.0), (1, 12.0, None), (1, 90.0, None), (2, 5.0, None)]
    rows = spark.createDataFrame([(1, 12), (1, 33), (2, 500)], "sheet int, cy int")
    assert sorted(map(tuple, greedy.match_rows(rows, "sheet", 10.0, 10.0, 3, 4.0).collect())) == [(1, 0, 12.0), (1, 1, 22.5), (1, 2, 33.0), (2, 0, 10.0), (2, 1, 20.0), (2, 2, 30.0)]
    at = spark.createDataFrame([(1, v) for v in (0, 5, 11, 14, 22)], "sheet int, cy int")
    assert sorted(r.cy for r in greedy.proximity_filter(at, "sheet", "cy", 10.0).collect()) == [0.0, 11.0, 22.0]
    circles = spark.createDataFrame([(1, 5, 0), (1, 8, 0), (1, 30, 0)], "sheet int, cx int, cy int")
    assert sorted((r.choice_rank, r.cx) for r in greedy.trim_rows(circles, ["sheet"], [6.0, 7.0]).collect()) == [(0, 5.0), (1, 8.0)]
    found = spark.createDataFrame([(1, 0, 0, 1), (1, 10, 10, 0), (1, 30, 0, 0), (1, 40, 5, 0)], "sheet int, cx int, cy int, box int")
    assert [tuple(r) for r in greedy.gap_fill(found, "sheet", 14.0).collect()] == [(1, 30.0, 0.0)]


def test_within_reach_finds_all_pairs(spark):
    r = np.random.default_rng(0)
    a, b = r.integers(0, 100, (40, 2)).tolist(), r.integers(0, 100, (40, 2)).tolist()
    one = spark.createDataFrame([(1, *p) for p in a], "page long, cx long, cy long")
    two = spark.createDataFrame([(1, *p) for p in b], "page long, ox long, oy long")
    want = sum((p[0] - q[0]) ** 2 + (p[1] - q[1]) ** 2 <= 400 for p in a for q in b)
    assert geometry.within_reach(one, two, ["page"], 20).count() == want


def test_split_of_columns_with_the_names_it_uses(spark):
    from pyspark.sql import functions as F

    from markgrid.operators import codes

    rows = spark.range(23).select((F.col("id") % 2).alias("g"), F.col("id").alias("k"), *[F.lit(7).alias(c) for c in ("__lo", "__hi", "__range", "__n", "__before", "split")])
    out = codes.every_nth_split(rows, ["g"], ["k"], 5)
    assert out.columns == ["g", "k", "__lo", "__hi", "__range", "__n", "__before", "split"]
    got = {(r.g, r.k): r.split for r in out.collect()}
    assert got == {(k % 2, k): "val" if k // 2 % 5 == 0 else "train" for k in range(23)}
