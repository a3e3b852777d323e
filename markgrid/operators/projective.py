"""Projective maps as columns: a quad seen in a photo is mapped to a rectangle of the page, in closed form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Corner = tuple[Column, Column]
NAMES = "abcdefghi"


def square_map(tl: Corner, tr: Corner, br: Corner, bl: Corner) -> Column:
    """A struct a..i: (x, y) of the quad goes to u = (ax + by + c) / (gx + hy + i), v = (dx + ey + f) / (gx + hy + i)
    of the unit square. Null if three corners are in line, or a corner is missing.

    The map from the square to the quad has a closed form; this is its adjugate, so nothing is solved for."""
    (x0, y0), (x1, y1), (x2, y2), (x3, y3) = ((x.cast("double"), y.cast("double")) for x, y in (tl, tr, br, bl))
    ax, ay, bx, by = x1 - x2, y1 - y2, x3 - x2, y3 - y2
    sx, sy = x0 - x1 + x2 - x3, y0 - y1 + y2 - y3
    den = ax * by - bx * ay
    g, h = sx * by - bx * sy, ax * sy - sx * ay
    # all nine times den
    a, b, c = (x1 - x0) * den + g * x1, (x3 - x0) * den + h * x3, x0 * den
    d, e, f = (y1 - y0) * den + g * y1, (y3 - y0) * den + h * y3, y0 * den
    inverse = {"a": e * den - f * h, "b": c * h - b * den, "c": b * f - c * e, "d": f * g - d * den, "e": a * den - c * g, "f": c * d - a * f, "g": d * h - e * g, "h": b * g - a * h, "i": a * e - b * d}
    corner = lambda p, q, r: (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])
    p = ((x0, y0), (x1, y1), (x2, y2), (x3, y3))
    usable = F.lit(True)
    for k in range(4):
        usable = usable & (corner(p[k], p[(k + 1) % 4], p[(k + 2) % 4]) != 0)
    return F.when(usable, F.struct(*[v.alias(k) for k, v in inverse.items()]))


def mapped(m: Column, x: Column, y: Column, rect: tuple[Column, Column, Column, Column]) -> tuple[Column, Column]:
    """Where square_map m and the rectangle (left, top, right, bottom) take a point; null on the line that goes to infinity."""
    left, top, right, bottom = rect
    x, y = x.cast("double"), y.cast("double")
    w = m["g"] * x + m["h"] * y + m["i"]
    u, v = (m["a"] * x + m["b"] * y + m["c"]) / F.nullif(w, F.lit(0.0)), (m["d"] * x + m["e"] * y + m["f"]) / F.nullif(w, F.lit(0.0))
    return left + (right - left) * u, top + (bottom - top) * v
