"""What queries move between tasks stays a small multiple of their input."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from markgrid import catalog
from markgrid.functions import extensions
from markgrid.functions.columns import choice_label
from markgrid.operators import blobs, layout, pages, runs
from markgrid.operators import geometry as geo
from markgrid.plans import grid
from markgrid.sources import templates as t
from markgrid.sources.marks import circles

from .conftest import rows_of
from .test_shapes import chain_and_ring


def shuffled(spark, df):
    """Rows written to shuffles by running df(), also by the jobs of tables that it writes on its way."""
    sc = spark.sparkContext._jsc.sc()
    stages = lambda: (sc.listenerBus().waitUntilEmpty(30_000), sc.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None))[1]
    each = lambda found: [found.apply(i) for i in range(found.size())]
    seen = max((x.stageId() for x in each(stages())), default=-1)
    df().write.format("noop").mode("overwrite").save()
    return sum(x.shuffleWriteRecords() for x in each(stages()) if x.stageId() > seen)


def moved(spark, sf_dir, name):
    """shuffled() of a query as a multiple of the circles."""
    return shuffled(spark, lambda: catalog.queries()[name](spark, sf_dir)) / circles(spark, sf_dir).count()


def test_grid_lines_are_the_lines_of_the_bubbles(spark):
    """Every template once, many circles around its bubbles, moved columns: by line as by bubble."""
    r = random.Random(7)
    cells = t.grid(t.numbered(spark))
    bubbles = cells.withColumn("sheet", F.col("position").cast("long"))
    rows = bubbles.collect()
    cols = sorted({(x.sheet, x.position, x.col_idx, x.col_w) for x in rows})
    columns = [(s, p, c, 64 + c * w + (k := r.randrange(-9, 10)), 64 + (c + 1) * w + k + r.randrange(2), r.random() < 0.5) for s, p, c, w in cols]
    found = [(x.sheet, x.cx + r.randrange(-14, 15), x.cy + r.randrange(-14, 15)) for x in rows if r.random() < 0.4 and x.sheet != 3]
    columns = spark.createDataFrame(columns, "sheet long, position int, col_idx int, x0 int, x1 int, from_bar boolean")
    found = spark.createDataFrame(found + found[:50], "sheet long, cx int, cy int")
    lined = geo.regularize(grid.drawn_in(grid.shifted(bubbles, columns.drop("position")), found), ["sheet", "col_idx", "choice_rank"], "cx").withColumn("option", choice_label(F.col("choice_rank"), F.col("lang")))
    lined = lined.groupBy("sheet", "col_idx", "choice_rank", "option", F.col("cx_median").alias("cx"))
    want = lined.agg(F.count("*").alias("bubbles"), F.count_if("snapped").alias("snapped"), F.min("cy").alias("top"), F.max("cy").alias("bottom"), F.sum("cy").alias("sum_cy"))
    got = grid.grid_lines(columns, grid.template_lines(spark), found)
    assert rows_of(got) == rows_of(want) and got.where("snapped > 3").count() > 20


def test_assembled_grid_moves_no_bubbles(spark, sf_dir):
    assert moved(spark, sf_dir, "assembled_grid") < 12


def test_page_kernel_is_the_table_one(spark, monkeypatch):
    """Blobs of pages with chains, rings, doubles and discs of no page: as by joins of cells, with blocks of any size."""
    rows = [(p, i + 1000 * p, *c) for p, some in ((1, chain_and_ring()), (2, chain_and_ring()[::3]), (-4, [(5, 5, 3), (5, 5, 6), (17, 5, 4)])) for i, c in enumerate(sorted(set(some)))]
    df = spark.createDataFrame(rows, "page int, id long, cx int, cy int, rd int")
    old = blobs.measured(blobs.labelled(df, ["page"], "rd", 14), ["page"], "rd").withColumn("solidity", blobs.solidity()).drop("lines")
    share = (F.col("area") / F.col("hull")).alias("solidity")
    names = ["page", "blob", "area", "cx", "cy", "width", "height", "solidity"]
    want = rows_of(old, names)
    assert rows_of(pages.page_blobs(pages.by_page(df, "page"), "page", "rd").select("*", share), names) == want
    whole = [np.array(v) for v in zip(*sorted((p, x, y, r, i) for p, i, x, y, r in rows))]
    for block in (1, 7, 300):
        got = blocked(monkeypatch, block, whole)
        assert sorted(map(tuple, got)) == sorted((int(x.page), x.blob, x.area, x.cx, x.cy, x.width, x.height, x.solidity) for x in old.collect())
    lost = spark.createDataFrame([(None, 5, 1, 1, 0), (None, 6, 900, 900, 0), (0, 7, 1, 1, 0)], "page int, id long, cx int, cy int, rd int")
    assert {tuple(x)[:3] for x in pages.page_blobs(pages.by_page(lost, "page"), "page", "rd").collect()} == {(None, None, 2), (0, 7, 1)}


def blocked(monkeypatch, block, whole):
    for name in ("blocks", "bands"):
        monkeypatch.setattr(pages, name, lambda *a, f=vars(pages)[name], **b: f(*a, most=block))
    page, x, y, r, ids = whole
    got = pages.blobs_of(page, np.zeros(len(page), bool), ids, x, y, r)
    monkeypatch.undo()
    return zip(*[got[k].tolist() for k in ("by", "blob", "area", "cx", "cy", "width", "height")], (got["area"] / got["hull"]).tolist())


def test_groups_stay_whole():
    sizes = [3, 1, 50, 2, 2, 9, 1]
    flat = [i if i else None for i, n in enumerate(sizes) for _ in range(n)]
    batches = [pa.RecordBatch.from_pydict({"g": pa.array(flat[i : i + 4], pa.int64())}) for i in range(0, len(flat), 4)]
    got = [t["g"].to_pylist() for t in pages.whole_groups(iter(batches), "g", 5)]
    assert sum(got, []) == flat and all(a[-1] != b[0] for a, b in zip(got, got[1:])) and len(got) > 2


@pytest.mark.parametrize("name, most", [("blob_solidity", 1.5), ("anchor_candidates_top12", 1.5), ("anchor_quad", 1.5), ("disc_darkness", 1.5), ("page_alignment", 3), ("aligned_circles", 4), ("page_blobs", 1.5), ("largest_blob", 1.5)])
def test_pages_move_discs_once(spark, sf_dir, name, most):
    assert moved(spark, sf_dir, name) < most


def test_quads_in_blocks():
    """The best quad is the same however few quads are tried at once; all equal: the first by place."""
    r = np.random.default_rng(4)
    x, y = r.integers(0, 750, (30, 9)), r.integers(0, 1060, (30, 9))
    want = layout.quads_of(x, y, 39750.0, 0.7)
    assert (want[1] > 0).sum() > 5
    for most in (1, 5, 200):
        best, area = layout.quads_of(x, y, 39750.0, 0.7, most)
        assert (area == want[1]).all() and (best == want[0]).all()
    square = np.array([[0, 400, 400, 0, 0, 400]]), np.array([[0, 0, 400, 400, 0, 0]])
    assert layout.quads_of(*square, 1.0, 0.7)[0].tolist() == [[0, 1, 2, 3]]


def test_darkness_kernel_is_the_table_one(spark, monkeypatch):
    """Darkness under discs by whole pages, in blocks of any size, with doubles, light discs and crowded pages: as by joins of lines."""
    r = random.Random(11)
    rows = [(p, r.randrange(70), r.randrange(70), r.randrange(1, 9), r.choice([None, 0, 1, 3, 6, 9])) for p in (-3, 1, 2) for _ in range(40)]
    rows += rows[:5] + [(9, 4, 4, 3, None)]
    df = spark.createDataFrame(rows, "page int, cx int, cy int, r int, rd int")
    old = runs.disc_darkness(df.drop("rd"), runs.dark_runs(df.where("rd IS NOT NULL"), ["page"], "rd"), ["page"], "r")
    want = rows_of(old)
    assert rows_of(pages.disc_darkness(pages.by_page(df, "page"), "page", "r", "rd")) == want
    whole = [np.array(v) for v in zip(*sorted((p, x, y, a, -1 if b is None else b) for p, x, y, a, b in rows))]
    plain = [v.tolist() for v in pages.darkness_of(*whole, 5)]
    for block in (1, 9, 500):
        for name in ("blocks", "bands"):
            monkeypatch.setattr(pages, name, lambda *a, f=vars(pages)[name], **b: f(*a, most=block))
        assert [v.tolist() for v in pages.darkness_of(*whole, 5)] == plain
        monkeypatch.undo()


def test_lattices_of_wide_pitch(spark, sf_dir):
    """Few centres and many tries, in blocks too: the first least try of all; and what is moved is the centres once."""
    r = np.random.default_rng(6)
    for _ in range(300):
        pitch, ys = float(r.integers(20, 1400)) / 4, np.sort(r.integers(0, 1060, r.integers(1, 7)))
        tries = [ys[0] - pitch / 2 + k for k in range(math.ceil(pitch + 1))]
        errors = [sum(min(abs(y - (at + i * pitch)) for i in range(12)) for y in ys.tolist()) for at in tries]
        two = np.concatenate([ys, ys])
        assert layout.first_rows(np.repeat([0, 1], len(ys)), two, np.array([pitch, pitch]), 12).tolist() == [tries[errors.index(min(errors))]] * 2
    assert moved(spark, sf_dir, "lattice_fit") < 1.5


def test_spreads_of_many_lists():
    r = np.random.default_rng(8)
    lists = [r.integers(0, 20, n).astype(float) for n in (0, 1, 4, 0, 7, 2, 1, 0)]
    got = extensions.spreads(np.concatenate(lists), np.array([len(v) for v in lists]))
    assert [None if math.isnan(x) else x for x in got] == [float(np.median(np.abs(v - np.median(v)))) if len(v) else None for v in lists]
    assert np.isnan(extensions.spreads(np.zeros(0), np.array([0, 0]))).all()
