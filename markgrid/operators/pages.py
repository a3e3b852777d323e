"""Discs of whole pages in NumPy: blobs with their measures and hulls, and the darkness under discs.

Rows come sorted by page, a page in one task, so that one shuffle of the discs is all that is moved; their lines and pixels
are never rows of a table. Many pages are worked on at once, and lines and pairs in blocks of bounded size. A page's discs
are held whole: of those at one centre only the largest has pixels of its own, so there are no more than a page has centres.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

DISCS, BLOCK = 200_000, 1_000_000
MEASURES = "blob long, area long, cx long, cy long, width int, height int, hull double"


def whole_groups(batches: Iterator[pa.RecordBatch], by: str, size: int = DISCS) -> Iterator[pa.Table]:
    """Some `size` rows at a time, groups in one piece, of batches sorted by `by`."""
    held, n, enough = [], 0, size
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= enough:
            rows = pa.Table.from_batches(held)
            starts = np.flatnonzero(changes(*keys(rows, by)))
            at = int(starts[-1])
            if at:
                yield rows.slice(0, at)
            held, n = rows.slice(at).to_batches(), rows.num_rows - at
            enough = max(size, 2 * n)
    if n:
        yield pa.Table.from_batches(held)


def keys(rows: pa.Table, by: str) -> tuple[np.ndarray, np.ndarray]:
    """The values of a whole-numbered column, 0 for null, and which are null."""
    column = rows[by].cast(pa.int64())
    return column.fill_null(0).to_numpy(), column.is_null().to_numpy(zero_copy_only=False)


def changes(*columns: np.ndarray) -> np.ndarray:
    """Whether each row differs from the one before."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return new


def spread_out(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of so many items a row: the item, and the row's place among its own."""
    item = np.repeat(np.arange(len(counts)), counts)
    return item, np.arange(len(item)) - np.repeat(np.cumsum(counts) - counts, counts)


def blocks(counts: np.ndarray, most: int = BLOCK) -> Iterator[slice]:
    """Slices of items whose counts come to some `most` each."""
    total = np.cumsum(counts)
    at = 0
    while at < len(counts):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most, "right")))
        yield slice(at, to)
        at = to


def joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """label (of each item the least item of its set), after the sets of a and b have become one, pair by pair: the
    greater label takes the smaller one, then every label its label's own, until no pair is apart."""
    while True:
        la, lb = label[a], label[b]
        apart = la != lb
        if not apart.any():
            return label
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while not np.array_equal(label, further := label[label]):
            label = further


def touching_sets(g: np.ndarray, x: np.ndarray, y: np.ndarray, r: np.ndarray) -> np.ndarray:
    """For each disc of group g a label that it shares with the discs of its group that it is linked to by overlap or touch.
    Discs in the order of cells meet those behind them in the same and the next cell, and the three cells of the next line."""
    side = 2 * int(r.max()) + 2
    gx, gy = (x - x.min()) // side + 1, (y - y.min()) // side + 1
    across = int(gx.max()) + 2
    cell = (g * (int(gy.max()) + 2) + gy) * across + gx
    order = np.argsort(cell, kind="stable")
    cell, x, y, r = cell[order], x[order], y[order], r[order]
    label, own = np.arange(len(cell)), np.arange(len(cell))
    ranges = ((own + 1, np.searchsorted(cell, cell + 1, "right")), (np.searchsorted(cell, cell + across - 1, "left"), np.searchsorted(cell, cell + across + 1, "right")))
    for low, high in ranges:
        counts = high - low
        for part in blocks(counts):
            item, place = spread_out(counts[part])
            a, b = item + part.start, low[part][item] + place
            near = (x[a] - x[b]) ** 2 + (y[a] - y[b]) ** 2 <= (r[a] + r[b] + 1) ** 2
            label = joined(label, a[near], b[near])
    out = np.empty_like(label)
    out[order] = label
    return out


def bands(y: np.ndarray, r: np.ndarray, most: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Lines from, to (both in) that divide the page so that some `most` lines of discs are in each."""
    low, high = int((y - r).min()), int((y + r).max())
    step = max(1, (high - low + 1) // -(-int((2 * r + 1).sum()) // most))
    return ((at, min(high, at + step - 1)) for at in range(low, high + 1, step))


def lines(y: np.ndarray, r: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A row for each line of discs from low to high: the disc, the line, and how far the disc reaches to each side."""
    first, last = np.maximum(y - r, low), np.minimum(y + r, high)
    disc, place = spread_out(np.maximum(last - first + 1, 0))
    at = first[disc] + place
    dy = at - y[disc]
    return disc, at, np.floor(np.sqrt((r[disc] * r[disc] - dy * dy).astype(np.float64))).astype(np.int64)


def covered_lines(c: np.ndarray, x: np.ndarray, y: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, ...]:
    """c, y, n (pixels that the discs of a blob c cover on the line), twice the sum of their x, least and greatest x; by c, y."""
    found = []
    left, top = int((x - r).min()), int((y - r).min())
    wide, high = int((x + r).max()) - left + 2, int((y + r).max()) - top + 1
    for low, to in bands(y, r):
        disc, at, reach = lines(y, r, low, to)
        if not len(disc):
            continue
        base = (c[disc] * high + at - top) * wide - left
        start, stop, base = base + x[disc] - reach, base + x[disc] + reach, base + left
        order = np.argsort(start, kind="stable")
        start, stop, base = start[order], stop[order], base[order]
        before = np.concatenate([[-1], np.maximum.accumulate(stop)[:-1]])
        fresh = np.maximum(start, before + 1)
        n = np.maximum(stop - fresh + 1, 0)
        first = np.flatnonzero(changes(base))
        row = base[first] // wide
        real = lambda v: v - base[first] + left
        twice = np.add.reduceat(n * (fresh + stop - 2 * (base - left)), first)
        found.append((row // high, row % high + top, np.add.reduceat(n, first), twice, real(start[first]), real(np.maximum.reduceat(stop, first))))
    out = [np.concatenate(v) for v in zip(*found)]
    if len(found) > 1:
        order = np.lexsort((out[1], out[0]))
        out = [v[order] for v in out]
    return tuple(out)


def twice_under(c: np.ndarray, y: np.ndarray, x: np.ndarray, side: int) -> np.ndarray:
    """Twice the area between x = 0 and the hull of points (one a line of a blob, by c, y) on one side (-1: small x, 1:
    large x), for each c. A point that lies within its neighbours' line is no vertex, so all such go at once, until none is left."""
    while True:
        whole = np.zeros(len(c), bool)
        whole[1:-1] = (c[:-2] == c[1:-1]) & (c[2:] == c[1:-1])
        i = np.flatnonzero(whole)
        a, b = i - 1, i + 1
        inner = side * ((x[i] - x[a]) * (y[b] - y[a]) - (x[b] - x[a]) * (y[i] - y[a])) <= 0
        if not inner.any():
            break
        keep = np.ones(len(c), bool)
        keep[i[inner]] = False
        c, y, x = c[keep], y[keep], x[keep]
    new = changes(c)
    under = np.zeros(len(c), np.int64)
    under[1:] = np.where(new[1:], 0, (x[1:] + x[:-1]) * (y[1:] - y[:-1]))
    return np.add.reduceat(under, np.flatnonzero(new))


def hull_areas(c: np.ndarray, y: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Area of the convex hull of each blob's pixels, taken as squares, from its lines by c, y."""
    c, y, left, right = np.repeat(c, 2), np.repeat(y, 2), np.repeat(left, 2), np.repeat(right + 1, 2)
    y[1::2] += 1
    order = np.lexsort((y, c))
    c, y = c[order], y[order]
    first = np.flatnonzero(changes(c, y))
    c, y, left, right = c[first], y[first], np.minimum.reduceat(left[order], first), np.maximum.reduceat(right[order], first)
    return (twice_under(c, y, right, 1) - twice_under(c, y, left, -1)) / 2.0


def measures(c: np.ndarray, x: np.ndarray, y: np.ndarray, r: np.ndarray) -> dict[str, np.ndarray]:
    """MEASURES but blob, of blobs 0, 1, .. (c: the blob of each disc)."""
    c, y, n, twice, left, right = covered_lines(c, x, y, r)
    first = np.flatnonzero(changes(c))
    total, low, high = (lambda v: np.add.reduceat(v, first)), (lambda v: np.minimum.reduceat(v, first)), (lambda v: np.maximum.reduceat(v, first))
    area = total(n)
    return {
        "area": area, "cx": total(twice) // (2 * area), "cy": total(y * n) // area,
        "width": high(right) - low(left) + 1, "height": high(y) - low(y) + 1, "hull": hull_areas(c, y, left, right),
    }


def blobs_of(page: np.ndarray, unknown: np.ndarray, ids: np.ndarray, x: np.ndarray, y: np.ndarray, r: np.ndarray) -> dict[str, np.ndarray]:
    """by, unknown and MEASURES of the blobs of whole pages. Discs of no page (unknown) are one blob without an id, as in SQL.
    A blob of one disc is as any of its radius, so those are measured once and moved."""
    label = touching_sets(np.cumsum(changes(page, unknown)) - 1, x, y, r)
    if unknown.any():
        label[unknown] = label[unknown].min()
    least = np.full(len(label), np.iinfo(np.int64).max)
    np.minimum.at(least, label, ids)
    size = np.bincount(label, minlength=len(label))[label]
    alone, some = np.flatnonzero(size == 1), np.flatnonzero(size > 1)
    radii, kind = np.unique(r[alone], return_inverse=True)
    heads, c = np.unique(label[some], return_inverse=True)
    n = len(radii)
    got = measures(np.concatenate([np.arange(n), c + n]), np.concatenate([0 * radii, x[some]]), np.concatenate([0 * radii, y[some]]), np.concatenate([radii, r[some]]))
    row = np.concatenate([kind, np.arange(n, n + len(heads))])
    moved = {"cx": x[alone], "cy": y[alone]}
    out = {k: v[row] + (np.concatenate([moved[k], np.zeros(len(heads), np.int64)]) if k in moved else 0) for k, v in got.items()}
    own = np.concatenate([alone, some[np.unique(c, return_index=True)[1]]])
    return {"by": page[own], "unknown": unknown[own], "blob": least[label[own]]} | out


def largest_at(columns: list[np.ndarray], r: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of discs that share columns: those, the largest radius and the least id."""
    order = np.lexsort(columns[::-1])
    first = np.flatnonzero(changes(*[v[order] for v in columns]))
    return (*[v[order][first] for v in columns], np.maximum.reduceat(r[order], first), np.minimum.reduceat(ids[order], first))


def numbers(rows: pa.Table, name: str) -> np.ndarray:
    return rows[name].cast(pa.int64()).to_numpy()


def by_page(rows: DataFrame, by: str) -> DataFrame:
    return rows.repartition(by).sortWithinPartitions(by)


def page_blobs(discs: DataFrame, by: str, r: str) -> DataFrame:
    """by and MEASURES of the blobs of discs (by, id, cx, cy and a radius; none null but by), which by_page has dealt: blobs are discs linked by touch,
    blob is their least id; centres are rounded down."""
    schema = f"{by} {discs.schema[by].dataType.simpleString()}, {MEASURES}"
    names = [x.split()[0] for x in MEASURES.split(", ")]

    def run(batches):
        for rows in whole_groups(batches, by):
            page, unknown = keys(rows, by)
            page, unknown, x, y, radius, ids = largest_at([page, unknown, numbers(rows, "cx"), numbers(rows, "cy")], numbers(rows, r), numbers(rows, "id"))
            got = blobs_of(page, unknown, ids, x, y, radius)
            arrays = [pa.array(got["by"], mask=got["unknown"]).cast(rows.schema.field(by).type), pa.array(got["blob"], mask=got["unknown"])]
            arrays += [pa.array(got[k], pa.int32() if k in ("width", "height") else None) for k in names[1:]]
            yield from pa.Table.from_arrays(arrays, [by, *names]).to_batches(50_000)

    return discs.select(by, "id", "cx", "cy", r).mapInArrow(run, schema)


def runs_of(base: np.ndarray, x: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last pixel of the runs that spans cover together, all on one axis: base is where a span's line begins on it."""
    order = np.argsort(start := base + x - reach, kind="stable")
    start, stop = start[order], np.maximum.accumulate((base + x + reach)[order])
    first = np.flatnonzero(np.concatenate([[True], start[1:] > stop[:-1] + 1])) if len(start) else np.zeros(0, np.int64)
    return start[first], stop[np.append(first[1:], len(start)) - 1] if len(start) else stop


def darkness_of(page: np.ndarray, x: np.ndarray, y: np.ndarray, r: np.ndarray, dark_r: np.ndarray, shifts: int) -> tuple[np.ndarray, ...]:
    """The distinct discs (page, x, y, r) of whole pages, each with the most pixels that it shares, over sideways shifts of
    -shifts..shifts, with the dark discs (radius dark_r, none if negative) of its page."""
    order = np.lexsort((r, y, x, page))
    own = order[changes(page[order], x[order], y[order], r[order])]
    lit = np.flatnonzero(dark_r >= 0)
    dp, dx, dy, dr = largest_at([page[lit], x[lit], y[lit]], dark_r[lit], dark_r[lit])[:4] if len(lit) else [np.zeros(0, np.int64)] * 4
    page, x, y, r = page[own], x[own], y[own], r[own]
    shared = np.zeros((len(own), 2 * shifts + 1), np.int64)
    g = np.cumsum(changes(page)) - 1
    dg = g[np.searchsorted(page, dp)]
    edge = lambda f, sign: int(f(np.concatenate([x + sign * (r + shifts), dx + sign * dr])))
    left, top, high = edge(np.min, -1), int((y - r).min()), int((y + r).max() - (y - r).min()) + 1
    wide = edge(np.max, 1) - left + 2
    begin = lambda g, at: (g * high + at - top) * wide - left
    for low, to in bands(y, r):
        disc, at, reach = lines(dy, dr, low, to)
        start, stop = runs_of(begin(dg[disc], at), dx[disc], reach)
        for part in blocks(2 * r + 1):
            disc, at, reach = lines(y[part], r[part], low, to)
            first = begin(g[part][disc], at) + x[part][disc] - reach
            nearest = np.searchsorted(stop, first - shifts, "left")
            counts = np.maximum(np.searchsorted(start, first + 2 * reach + shifts, "right") - nearest, 0)
            met = np.flatnonzero(counts)
            disc, reach, first, nearest, counts = disc[met] + part.start, reach[met], first[met], nearest[met], counts[met]
            for some in blocks(counts):
                item, place = spread_out(counts[some])
                run, at, probe = nearest[some][item] + place, first[some][item], disc[some][item]
                a, b, last = ((v).astype(np.int32) for v in (start[run] - at, stop[run] - at, 2 * reach[some][item]))
                ends = np.flatnonzero(changes(probe))
                for k in range(-shifts, shifts + 1):
                    n = np.maximum(np.minimum(b, last + k) - np.maximum(a, k) + 1, 0)
                    shared[probe[ends], k + shifts] += np.add.reduceat(n, ends)
    return page, x, y, r, shared.max(axis=1)


def disc_darkness(discs: DataFrame, by: str, r: str, dark_r: str, shifts: int = 5) -> DataFrame:
    """by, cx, cy, r, dark, mask as runs.disc_darkness has it, of discs (by, cx, cy, r, none null; dark_r, null for a light one) which
    by_page has dealt; the dark discs of a page are on it."""
    kind = lambda name: f"{name} {discs.schema[name].dataType.simpleString()}"
    schema = ", ".join([*map(kind, (by, "cx", "cy", r)), "dark long", "mask int"])

    def run(batches):
        for rows in whole_groups(batches, by):
            faint = rows[dark_r].cast(pa.int64()).fill_null(-1).to_numpy()
            *key, dark = darkness_of(*[numbers(rows, n) for n in (by, "cx", "cy", r)], faint, shifts)
            radii, place = np.unique(key[-1], return_inverse=True)
            mask = np.array([(2 * lines(np.zeros(1, np.int64), v[None], -v, v)[2] + 1).sum() for v in radii])
            arrays = [pa.array(v).cast(rows.schema.field(n).type) for n, v in zip((by, "cx", "cy", r), key)]
            yield from pa.Table.from_arrays([*arrays, pa.array(dark), pa.array(mask[place], pa.int32())], [by, "cx", "cy", r, "dark", "mask"]).to_batches(50_000)

    return discs.select(by, "cx", "cy", r, dark_r).mapInArrow(run, schema)
