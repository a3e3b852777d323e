import itertools
import random

import pytest
from pyspark.sql import functions as F

from markgrid.operators import blobs, projective, runs


def disc(cx, cy, r):
    return {(cx + dx, cy + dy) for dx in range(-r, r + 1) for dy in range(-r, r + 1) if dx * dx + dy * dy <= r * r}


def hull_area(points):
    """By gift wrapping over all points."""
    points = sorted(set(points))
    if len(points) < 3:
        return 0.0
    ring, at = [], points[0]
    while at not in ring:
        ring.append(at)
        best = next(p for p in points if p != at)
        for p in points:
            side = (best[0] - at[0]) * (p[1] - at[1]) - (best[1] - at[1]) * (p[0] - at[0])
            if p != at and (side < 0 or (side == 0 and abs(p[0] - at[0]) + abs(p[1] - at[1]) > abs(best[0] - at[0]) + abs(best[1] - at[1]))):
                best = p
        at = best
    return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1]))) / 2


def test_hull_by_monotone_chain(spark):
    r = random.Random(1)
    cases = [[(r.randrange(12), r.randrange(12)) for _ in range(n)] for n in range(1, 40)]
    cases += [[(0, 0)] * 5, [(i, 2 * i) for i in range(6)], [(0, 0), (0, 5), (5, 5), (5, 0), (2, 2), (0, 0)], [(3, i) for i in range(4)], [(0, 0), (9, 0), (0, 9), (3, 3), (4, 4), (4, 5)], []]
    df = spark.createDataFrame([(i, [(y, x) for x, y in c]) for i, c in enumerate(cases)], "i int, p array<struct<y:int,x:int>>")
    got = {x.i: x.a for x in df.select("i", blobs.hull_area(F.col("p")).alias("a")).collect()}
    assert got == {i: hull_area(c) for i, c in enumerate(cases)}


def groups(discs):
    """Blobs of (cx, cy, r) by trying all pairs."""
    left, out = set(range(len(discs))), []
    while left:
        todo = [left.pop()]
        own = set(todo)
        while todo:
            x, y, a = discs[todo.pop()]
            near = {i for i in left if (discs[i][0] - x) ** 2 + (discs[i][1] - y) ** 2 <= (discs[i][2] + a + 1) ** 2}
            left -= near
            own |= near
            todo += near
        out.append(own)
    return out


def chain_and_ring():
    long = [(20 + 9 * i, 500, 4) for i in range(70)]
    ring = [(300 + dx, 200 + dy, 5) for dx, dy in ((0, 0), (10, 0), (20, 0), (30, 0), (30, 10), (30, 20), (30, 30), (20, 30), (10, 30), (0, 30), (0, 20), (0, 10))]
    alone = [(700, 900, 6), (15, 15, 0)]
    r = random.Random(2)
    random.Random(3).shuffle(long)
    return long + ring + alone + [(r.randrange(100, 250), r.randrange(700, 850), r.randrange(8)) for _ in range(60)]


def test_blobs_of_chains_and_rings(spark):
    discs = sorted(set(chain_and_ring()))
    rows = [(1, i, *c) for i, c in enumerate(discs)] + [(2, 1000 + i, *c) for i, c in enumerate(discs[:5])]
    df = spark.createDataFrame(rows, "page int, id long, cx int, cy int, rd int")
    labelled = blobs.labelled(df, ["page"], "rd", 14)
    got = {}
    for x in labelled.collect():
        got.setdefault((x.page, x.blob), set()).add(x.id)
    want = {(1, min(g)): g for g in groups(discs)} | {(2, 1000 + min(g)): {1000 + i for i in g} for g in groups(discs[:5])}
    assert got == want
    rows = {(x.page, x.blob): x for x in blobs.measured(labelled, ["page"], "rd").withColumns({"aspect": blobs.aspect(), "solidity": blobs.solidity()}).collect()}
    for g in groups(discs):
        pixels = set().union(*(disc(*discs[i]) for i in g))
        xs, ys = [p[0] for p in pixels], [p[1] for p in pixels]
        x = rows[1, min(g)]
        assert (x.area, x.width, x.height, x.cx, x.cy) == (len(pixels), max(xs) - min(xs) + 1, max(ys) - min(ys) + 1, sum(xs) // len(xs), sum(ys) // len(ys))
        corners = [(px + a, py + b) for px, py in pixels for a, b in itertools.product((0, 1), repeat=2)]
        assert x.solidity == pytest.approx(len(pixels) / hull_area(corners)) and x.solidity <= 1
    empty = blobs.labelled(df.limit(0), ["page"], "rd", 14)
    assert empty.count() == 0 and blobs.measured(empty, ["page"], "rd").count() == 0


def test_darkness_under_discs(spark):
    r = random.Random(5)
    dark = [(s, r.randrange(60), r.randrange(60), r.randrange(7)) for s in (1, 2) for _ in range(12)] + [(1, 30, 30, 5)] * 2
    probes = [(s, r.randrange(60), r.randrange(60), r.randrange(1, 9)) for s in (1, 2, 3) for _ in range(20)] + [(1, 2, 2, 6)]
    lines = runs.dark_runs(spark.createDataFrame(dark, "sheet int, cx int, cy int, rd int"), ["sheet"], "rd")
    got = {(x.sheet, x.cx, x.cy, x.r): (x.dark, x.mask) for x in runs.disc_darkness(spark.createDataFrame(probes, "sheet int, cx int, cy int, r int"), lines, ["sheet"], "r").collect()}
    want = {}
    for s, cx, cy, radius in probes:
        image = set().union(*(disc(x, y, rd) for t, x, y, rd in dark if t == s), set())
        want[s, cx, cy, radius] = (max(len(disc(cx + k, cy, radius) & image) for k in range(-5, 6)), len(disc(cx, cy, radius)))
    assert got == want and any(v[0] == 0 for v in got.values()) and any(v[0] == v[1] for v in got.values())


def test_projective_map_takes_corners_to_corners(spark):
    quads = [((60, 50), (700, 30), (690, 1000), (40, 1030)), ((36, 36), (714, 36), (714, 1024), (36, 1024)), ((0, 0), (10, 0), (20, 0), (0, 10)), ((0, 0), (0, 0), (9, 9), (0, 9))]
    names = ("tl", "tr", "br", "bl")
    df = spark.createDataFrame([(i, *[v for p in q for v in p]) for i, q in enumerate(quads)] + [(4, None, 1, 5, 1, 5, 5, 1, 5)], "i int, " + ", ".join(f"{n}_{a} int" for n in names for a in "xy"))
    corner = {n: (F.col(f"{n}_x"), F.col(f"{n}_y")) for n in names}
    m = df.withColumn("m", projective.square_map(*corner.values()))
    rect = tuple(F.lit(float(v)) for v in (36, 36, 714, 1024))
    out = m.select("i", *[v.alias(f"{n}_{a}") for n, c in corner.items() for a, v in zip("xy", projective.mapped(F.col("m"), *c, rect))]).collect()
    want = (36, 36, 714, 36, 714, 1024, 36, 1024)
    for x in out[:2]:
        assert tuple(x)[1:] == pytest.approx(want, abs=1e-9)
    assert all(v is None for x in out[2:] for v in tuple(x)[1:])


def test_projective_map_equals_the_kernels(spark):
    import numpy as np

    from markgrid.operators import kernels

    quad = ((60, 50), (700, 30), (690, 1000), (40, 1030))
    h = kernels.homography(np.array(quad, float), np.array([[0.0, 0], [749, 0], [749, 1059], [0, 1059]]))
    points = [(100, 100), (375, 530), (640, 20), (-50, 2000)]
    df = spark.createDataFrame(points, "x int, y int").withColumn("m", projective.square_map(*[(F.lit(x), F.lit(y)) for x, y in quad]))
    rect = tuple(F.lit(float(v)) for v in (0, 0, 749, 1059))
    for row in df.select("x", "y", *[v.alias(n) for n, v in zip("uv", projective.mapped(F.col("m"), F.col("x"), F.col("y"), rect))]).collect():
        p = h @ np.array([row.x, row.y, 1.0])
        assert (row.u, row.v) == pytest.approx((p[0] / p[2], p[1] / p[2]), abs=1e-6)
