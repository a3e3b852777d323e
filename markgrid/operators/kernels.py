"""Pixel kernels over aligned gray sheets (NumPy, one sheet at a time inside a task) and the stage
that turns sheets into bubble rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDTH, HEIGHT, DARK = 750, 1060, 185


def white_level(gray: np.ndarray, block: int = 25) -> np.ndarray:
    """Paper brightness around each pixel: a high percentile of blocks, spread back over them."""
    h, w = gray.shape
    full = np.pad(gray, ((0, -h % block), (0, -w % block)), mode="edge")
    tiles = full.reshape(full.shape[0] // block, block, full.shape[1] // block, block)
    level = np.percentile(tiles, 75, axis=(1, 3))
    return np.repeat(np.repeat(level, block, 0), block, 1)[:h, :w]


def even_light(gray: np.ndarray) -> np.ndarray:
    """Shading taken out: pixels relative to the paper around them, 0..255."""
    return np.clip(gray.astype(np.float32) / np.maximum(white_level(gray), 1.0) * 255.0, 0, 255).astype(np.uint8)


def disc(r: int) -> tuple[np.ndarray, np.ndarray]:
    y, x = np.mgrid[-r : r + 1, -r : r + 1]
    inside = x * x + y * y <= r * r
    return y[inside], x[inside]


def dark_pixels(even: np.ndarray, cx: np.ndarray, cy: np.ndarray, r: int, shifts: int = 5) -> tuple[np.ndarray, int]:
    """Most dark pixels under each disc over shifts of -shifts..shifts pixels sideways, and the disc's pixels."""
    dy, dx = disc(r)
    best = np.zeros(len(cx), np.int64)
    for s in range(-shifts, shifts + 1):
        ys = np.clip(cy[:, None] + dy, 0, even.shape[0] - 1)
        xs = np.clip(cx[:, None] + dx + s, 0, even.shape[1] - 1)
        best = np.maximum(best, (even[ys, xs] < DARK).sum(1))
    return best, len(dy)


def homography(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The 3 x 3 map that takes four points of source to those of target."""
    rows = []
    for (x, y), (u, v) in zip(source, target):
        rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y, u], [0, 0, 0, x, y, 1, -v * x, -v * y, v]]
    m = np.array(rows, float)
    return np.append(np.linalg.solve(m[:, :8], m[:, 8]), 1.0).reshape(3, 3)


def warp(gray: np.ndarray, matrix: np.ndarray, width: int = WIDTH, height: int = HEIGHT) -> np.ndarray:
    """gray seen through a map from its pixels to a width x height page (bilinear, white outside)."""
    back = np.linalg.inv(matrix)
    y, x = np.mgrid[0:height, 0:width]
    p = back @ np.stack([x.ravel(), y.ravel(), np.ones(x.size)])
    u, v = p[0] / p[2], p[1] / p[2]
    i, j = np.floor(v).astype(int), np.floor(u).astype(int)
    ok = (i >= 0) & (j >= 0) & (i < gray.shape[0] - 1) & (j < gray.shape[1] - 1)
    i, j = np.where(ok, i, 0), np.where(ok, j, 0)
    a, b = v - i, u - j
    g = gray.astype(float)
    value = g[i, j] * (1 - a) * (1 - b) + g[i, j + 1] * (1 - a) * b + g[i + 1, j] * a * (1 - b) + g[i + 1, j + 1] * a * b
    return np.where(ok, np.rint(value), 255).astype(np.uint8).reshape(height, width)


def sharpness(gray: np.ndarray) -> float:
    """Variance of the Laplacian over 500, at most 1."""
    g = gray.astype(float)
    lap = g[1:-1, :-2] + g[1:-1, 2:] + g[:-2, 1:-1] + g[2:, 1:-1] - 4 * g[1:-1, 1:-1]
    return float(min(1.0, lap.var() / 500.0))


def measured(sheets: DataFrame, cells: DataFrame) -> DataFrame:
    """sheet, q, rank, dark, mask for each bubble of aligned sheets (sheet, template_id, gray 750 x 1060).

    cells (template_id, q, choice_rank, cx, cy, r) is the grid of all templates, of fixed size, and
    goes to the tasks as a list on each template's row."""
    lists = cells.groupBy("template_id").agg(*[F.collect_list(c).alias(c) for c in ("q", "choice_rank", "cx", "cy")], F.first("r").alias("r"))

    def run(batches):
        for pdf in batches:
            for s in pdf.itertuples():
                even = even_light(np.frombuffer(s.gray, np.uint8).reshape(HEIGHT, WIDTH))
                dark, mask = dark_pixels(even, np.asarray(s.cx), np.asarray(s.cy), int(s.r) - 1)
                yield pd.DataFrame({"sheet": s.sheet, "q": s.q, "rank": s.choice_rank, "dark": dark, "mask": mask})

    return sheets.join(F.broadcast(lists), "template_id").mapInPandas(run, "sheet long, q int, rank int, dark int, mask int")


def render(cx: np.ndarray, cy: np.ndarray, r: int, share: np.ndarray, seed: int = 0, shade: float = 0.0, noise: float = 0.0) -> np.ndarray:
    """An aligned sheet with a ring at each place, filled to share of its disc from the centre outwards."""
    page = np.full((HEIGHT, WIDTH), 245.0)
    dy, dx = disc(r)
    far = np.sqrt(dy * dy + dx * dx)
    for x, y, s in zip(cx, cy, share):
        page[y + dy[far > r - 1], x + dx[far > r - 1]] = 90
        inner = far <= (r - 1) * np.sqrt(s)
        if s > 0:
            page[y + dy[inner], x + dx[inner]] = 40
    page *= 1 - shade * np.linspace(0, 1, WIDTH)[None, :]
    page += np.random.default_rng(seed).normal(0, noise, page.shape) if noise else 0
    return np.clip(page, 0, 255).astype(np.uint8)
