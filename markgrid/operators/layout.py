"""Operators that place things on a sheet: spans and bars, columns, row lattices, anchor quads and boxes.

A sheet has a bounded number of detections, so each is gathered into sorted arrays once, and the
rules are array expressions inside the JVM; quads and lattices are tried in NumPy, over
many pages at once.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import half_even
from . import pages


def inside(width: int, height: int) -> Column:
    """Whether a circle (cx, cy, r) lies within an image."""
    return (F.col("cx") - F.col("r") >= 0) & (F.col("cy") - F.col("r") >= 0) & (F.col("cx") + F.col("r") < width) & (F.col("cy") + F.col("r") < height)


def covered(spans: DataFrame, by: list[str], gap: int = 0) -> DataFrame:
    """by..., start, stop, width: runs of positions that spans (start, stop) cover; spans that overlap,
    touch, or lie at most gap positions apart are one run."""
    order = Window.partitionBy(*by).orderBy("start", "stop")
    before = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    group = F.sum(F.coalesce((F.col("start") > before + 1 + gap).cast("int"), F.lit(0))).over(order)
    runs = spans.select(*by, "start", "stop").withColumn("g", group).groupBy(*by, "g").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("g")
    return runs.withColumn("width", F.col("stop") - F.col("start") + 1)


def wide(runs: DataFrame, least: Column | int) -> DataFrame:
    """Runs at least so wide: bars (a share of the column), bands of question rows (ten pixels)."""
    return runs.where(F.col("width") >= least)


def bar_floor(column_width: Column) -> Column:
    return F.greatest(F.lit(30), F.floor(F.lit(0.2) * column_width))


def uniform_rows(y0: Column, y1: Column, rows: Column, truncated: bool = False) -> Column:
    """Centres of so many equal rows between y0 and y1: rounded half to even, or truncated."""
    cut = (lambda y: F.floor(y).cast("int")) if truncated else half_even
    centre = lambda i: cut(y0 + (i + F.lit(0.5)) * ((y1 - y0) / rows.cast("double")))
    return F.when(rows > 0, F.transform(F.sequence(F.lit(0), rows - 1), centre)).otherwise(F.array().cast("array<int>"))


def columns_from_bars(sheets: DataFrame, bars: DataFrame, by: str) -> DataFrame:
    """by, col_idx, x0, x1, from_bar: the i-th bar from the left is column i, if the sheet has as many
    bars (by, start, stop) as columns; else its printed columns (sheets: printed, an array of x0, x1)."""
    found = bars.groupBy(by).agg(F.sort_array(F.collect_list(F.struct(F.col("start").alias("x0"), F.col("stop").alias("x1")))).alias("bars"))
    both = sheets.join(found, by, "left")
    same = F.coalesce(F.size("bars") == F.size("printed"), F.lit(False))
    return both.select(by, same.alias("from_bar"), F.posexplode(F.when(same, F.col("bars")).otherwise(F.col("printed"))).alias("col_idx", "c")).select(by, "col_idx", "c.x0", "c.x1", "from_bar")


def median_of(values: Column) -> Column:
    """Median of an array without nulls; null if it is empty."""
    ordered = F.array_sort(values)
    middle = lambda i: F.get(ordered, F.floor(i / 2).cast("int"))
    return (middle(F.size(values) - 1) + middle(F.size(values))) / F.lit(2.0)


def medians(g: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The groups that have values, in order, and the median of each."""
    order = np.lexsort((values, g))
    g, values = g[order], values[order]
    first = np.flatnonzero(pages.changes(g)) if len(g) else np.zeros(0, np.int64)
    n = np.diff(np.append(first, len(g)))
    return g[first], (values[first + (n - 1) // 2] + values[first + n // 2]) / 2.0


def first_rows(g: np.ndarray, y: np.ndarray, pitch: np.ndarray, rows: int) -> np.ndarray:
    """row0 of each group 0, 1, .. of centres (g, y, by g) with a pitch: the first try of the least sum of distances.

    Between the places where a row meets a centre the sum is concave, so the first least try is the first or last of all, or next to
    such a place: where those are fewer than the tries, only they are summed."""
    start = np.flatnonzero(pages.changes(g))
    size = np.diff(np.append(start, len(g)))
    low, tries = np.minimum.reduceat(y, start) - pitch / 2, np.ceil(pitch + 1).astype(np.int64)
    off = y - low[g]
    meets = [off - np.clip(np.floor((off + 1) / pitch[g]) - back, 0, rows - 1) * pitch[g] for back in range(3)]
    near = np.clip(np.stack([cut(v) for v in meets for cut in (np.floor, np.ceil)], axis=1).astype(np.int64), 0, tries[g][:, None] - 1).ravel()
    few = 6 * size + 2 < tries
    counts = np.where(few, 6 * size + 2, tries)
    row0 = np.empty(len(pitch))
    for part in pages.blocks(counts * size):
        group, k = pages.spread_out(counts[part])
        heads = np.flatnonzero(k == 0)
        group += part.start
        left = 6 * size[group] - k
        picked = np.where(left > 0, near[np.minimum(6 * start[group] + k, len(near) - 1)], np.where(left == 0, 0, tries[group] - 1))
        k = np.where(few[group], picked, k)
        at = low[group] + k
        one, place = pages.spread_out(size[group])
        away, step = y[start[group[one]] + place] - at[one], pitch[group[one]]
        far = np.abs(away - np.clip(np.floor(away / step + 0.5), 0, rows - 1) * step)
        total = np.add.reduceat(far, np.cumsum(size[group]) - size[group])
        least = np.minimum.reduceat(total, heads)
        row0[part] = low[part] + np.minimum.reduceat(np.where(total == least[group - part.start], k, tries[group]), heads)
    return row0


def fit_lattice(centres: DataFrame, by: str, rows: int, y0: int, y1: int, noise: int = 5, reach: int = 12, once: bool = False) -> DataFrame:
    """by, pitch, row0, quality, lattice from row centres (by, col, y; whole numbers, neither col nor y null) of all columns of a
    sheet; with once, equal ones count once.

    The pitch is the median over columns of the median step of over `noise` between neighbouring
    centres; row0 is, in steps of one pixel over half a pitch to each side of the topmost centre, the
    first with the least sum of distances to the nearest of `rows` rows; quality is the share of
    centres within reach of a row. Without a pitch of `noise`: uniform rows, quality 0. Many sheets are
    fitted at once in NumPy; pitches are quarters of a pixel, so sums of distances are exact in any order."""
    uniform = np.rint(y0 + (np.arange(rows) + 0.5) * (float(y1 - y0) / rows)).astype(np.int32)

    def run(batches):
        for table in pages.whole_groups(batches, by):
            key, unknown = pages.keys(table, by)
            g = np.cumsum(pages.changes(key, unknown)) - 1
            heads = np.flatnonzero(pages.changes(g))
            col, y = pages.numbers(table, "col"), pages.numbers(table, "y")
            order = np.lexsort((y, col, g))
            g, col, y = g[order], col[order], y[order]
            if once:
                new = pages.changes(g, col, y)
                g, col, y = g[new], col[new], y[new]
            step = np.diff(y)
            some = np.flatnonzero((g[1:] == g[:-1]) & (col[1:] == col[:-1]) & (step > noise))
            column = np.cumsum(pages.changes(g, col)) - 1
            of, own = medians(column[some], step[some])
            first = np.flatnonzero(pages.changes(column))
            with_pitch, found = medians(g[first[of]], own)
            n = len(heads)
            pitch, row0 = np.full(n, np.nan), np.full(n, np.nan)
            pitch[with_pitch] = found
            fit = np.flatnonzero(pitch >= noise)
            mine = np.isin(g, fit)
            if len(fit):
                row0[fit] = first_rows(np.searchsorted(fit, g[mine]), y[mine], pitch[fit], rows)
            lattice = np.tile(uniform, (n, 1))
            lattice[fit] = np.rint(row0[fit][:, None] + np.arange(rows) * pitch[fit][:, None]).astype(np.int32)
            near = (np.abs(y[:, None] - lattice[g]) <= reach).any(axis=1)
            quality = np.where(np.isnan(row0), 0.0, np.bincount(g, near, n) / np.bincount(g, minlength=n))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, n * rows + 1, rows), pa.int32()), pa.array(lattice.ravel()))
            arrays = [pa.array(key[heads], mask=unknown[heads]).cast(table.schema.field(by).type), pa.array(pitch, mask=np.isnan(pitch)), pa.array(row0, mask=np.isnan(row0)), pa.array(quality), lists]
            yield from pa.Table.from_arrays(arrays, [by, "pitch", "row0", "quality", "lattice"]).to_batches(10_000)

    kind = centres.schema[by].dataType.simpleString()
    return pages.by_page(centres.select(by, "col", "y"), by).mapInArrow(run, f"{by} {kind}, pitch double, row0 double, quality double, lattice array<int>")


def quads_of(x: np.ndarray, y: np.ndarray, least_area: float, squareness: float, most: int = 200_000) -> tuple[np.ndarray, np.ndarray]:
    """Of pages (rows of x and y) of n candidates each: the places of the corners tl, tr, br, bl of the best quad, and its area; -1 without one."""
    pages, n = x.shape
    row = np.arange(pages)[:, None]
    ranks = []
    for key in (x + y, y - x, -(x + y), x - y):
        rank = np.empty((pages, n), np.int64)
        rank[row, np.lexsort((y, x, key))] = np.arange(n)
        ranks.append(rank)
    best, area = np.zeros((pages, 4), np.int64), np.full(pages, -1.0)
    every = itertools.combinations(range(n), 4)
    while four := list(itertools.islice(every, most)):
        quad = np.array(four)
        step = max(1, most // len(quad))
        for at in range(0, pages, step):
            part = row[at : at + step]
            ends = [quad[np.arange(len(quad)), rank[at : at + step][:, quad].argmin(axis=2)] for rank in ranks]
            (ax, ay), (bx, by), (cx, cy), (dx, dy) = ((x[part, e].astype(np.float64), y[part, e].astype(np.float64)) for e in ends)
            size = np.abs((ax * by - bx * ay) + (bx * cy - cx * by) + (cx * dy - dx * cy) + (dx * ay - ax * dy)) / 2
            side = lambda px, py, qx, qy: np.sqrt((px - qx) * (px - qx) + (py - qy) * (py - qy))
            alike = lambda a, b: np.minimum(a, b) / (np.maximum(a, b) + 1e-6) > squareness
            good = alike(side(ax, ay, bx, by), side(dx, dy, cx, cy)) & alike(side(ax, ay, dx, dy), side(bx, by, cx, cy)) & (size > least_area)
            size = np.where(good, size, -1.0)
            first, own = size.argmax(axis=1), np.arange(len(part))
            better = np.flatnonzero(size[own, first] > area[at : at + step])
            area[at + better] = size[better, first[better]]
            best[at + better] = np.stack([e[better, first[better]] for e in ends], axis=1)
    return best, area


def best_quad(candidates: DataFrame, by: str, least_area: float, squareness: float = 0.7) -> DataFrame:
    """by, tl_x .. bl_y, area: of all quads of four candidates (by, place 0.., cx, cy) the one of largest
    area whose opposite sides are alike by more than squareness; of equals the first by place. A
    group has a few candidates (twelve make 495 quads); groups of one size are tried together."""
    held = candidates.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("place", "cx", "cy"))).alias("c")).where(F.size("c") >= 4)
    held = held.select(by, F.col("c.cx").alias("xs"), F.col("c.cy").alias("ys"))
    kind = lambda name: candidates.schema[name].dataType.simpleString()
    names = [f"{c}_{a}" for c in ("tl", "tr", "br", "bl") for a in "xy"]
    schema = f"{by} {kind(by)}, " + ", ".join(f"{v} {kind('c' + v[-1])}" for v in names) + ", area double"

    def run(batches):
        for batch in batches:
            sizes = batch["xs"].value_lengths().to_numpy()
            starts = np.cumsum(sizes) - sizes
            flat = [batch[v].flatten() for v in ("xs", "ys")]
            x, y = (v.to_numpy().astype(np.int64) for v in flat)
            for n in np.unique(sizes):
                own = np.flatnonzero(sizes == n)
                at = starts[own][:, None] + np.arange(n)
                best, area = quads_of(x[at], y[at], least_area, squareness)
                some = np.flatnonzero(area >= 0)
                place = at[some][np.arange(len(some))[:, None], best[some]]
                corners = [flat[i].take(pa.array(place[:, c])) for c in range(4) for i in range(2)]
                yield pa.RecordBatch.from_arrays([batch[by].take(pa.array(own[some])), *corners, pa.array(area[some])], [by, *names, "area"])

    return held.mapInArrow(run, schema)


def cut(x: Column) -> Column:
    """x without its fraction."""
    return x.cast("int")


def grid_box(corner: dict[str, tuple[Column, Column]], whole: Column, width: int, height: int) -> dict[str, Column]:
    """x0, x1, y0, y1 of the answer grid from the corner anchors TL, TR, BL, BR, where all were found
    (whole), else as fractions of the image."""
    top, bottom = F.least(corner["TL"][1], corner["TR"][1]), F.greatest(corner["BL"][1], corner["BR"][1])
    left, right = F.least(corner["TL"][0], corner["BL"][0]), F.greatest(corner["TR"][0], corner["BR"][0])
    h, w = bottom - top, right - left
    # Fixed values of the sheet format: insets from the anchors, and fractions of the image without them.
    near = {"x0": left + w * F.lit(0.06), "x1": right - w * F.lit(0.06), "y0": top + h * F.lit(0.205), "y1": top + h * F.lit(0.975)}
    else_ = {"x0": 0.10 * width, "x1": 0.90 * width, "y0": 0.247 * height, "y1": 0.94 * height}
    return {k: F.when(whole, cut(v)).otherwise(F.lit(int(else_[k]))) for k, v in near.items()}


def between_anchors(xs: Column, x0: Column, x1: Column) -> Column:
    """x0, x1 of the column groups whose boundaries are the midpoints between neighbouring anchors; none
    with fewer than two anchors."""
    ordered = F.array_sort(xs)
    mids = F.zip_with(F.slice(ordered, 1, F.size(ordered) - 1), F.slice(ordered, 2, F.size(ordered) - 1), lambda a, b: F.floor((a + b) / 2).cast("int"))
    edges = F.concat(F.array(x0), mids, F.array(x1))
    groups = F.zip_with(F.slice(edges, 1, F.size(edges) - 1), F.slice(edges, 2, F.size(edges) - 1), lambda a, b: F.struct(a.alias("x0"), b.alias("x1")))
    return F.when(F.size(xs) >= 2, groups)


def warp_size(corner: dict[str, tuple[Column, Column]]) -> tuple[Column, Column]:
    """Width and height of a page seen at its corners tl, tr, br, bl: the longer of opposite sides."""
    side = lambda a, b: F.sqrt(F.pow((corner[a][0] - corner[b][0]).cast("double"), F.lit(2.0)) + F.pow((corner[a][1] - corner[b][1]).cast("double"), F.lit(2.0)))
    return cut(F.greatest(side("br", "bl"), side("tr", "tl"))), cut(F.greatest(side("tr", "br"), side("tl", "bl")))
