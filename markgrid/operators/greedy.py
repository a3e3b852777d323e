"""Order-dependent operators: greedy rules whose outcome for one item depends on earlier ones.

Spark gathers each sheet's or row's detections, a bounded set, into one sorted array; the rule is a
fold over that array inside the JVM. Only exact one-dimensional k-means is a dynamic program in
NumPy, over many sheets at once.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def gathered(points: DataFrame, by: list[str], order: list[Column], name: str = "items", where: Column | None = None) -> DataFrame:
    """by, and the distinct structs of order, sorted; with where, of those points only (the array may be empty)."""
    item = F.struct(*order)
    return points.groupBy(*by).agg(F.sort_array(F.collect_set(item if where is None else F.when(where, item))).alias(name))


def real(name: str) -> Column:
    return F.col(name).cast("double").alias(name)


def folded(items: Column, empty: Column, step) -> Column:
    return F.aggregate(items, empty, step)


def kept_in_turn(items: Column, held: Column, clash) -> Column:
    """held, and each of items in turn that clashes with none held so far."""
    add = lambda acc, x: F.when(F.exists(acc, lambda k: clash(k, x)), acc).otherwise(F.concat(acc, F.array(x)))
    return folded(items, held, add)


def bars_match(bars: DataFrame, by: str, reach: float) -> DataFrame:
    """by, top, bottom (null if none) from bars (by, below 0 or 1, at): each top bar has a nearest bottom
    bar (the first of equals); if it is within reach, the first such top bar gets it."""
    at = F.col("at").cast("double")
    tops = F.sort_array(F.collect_set(F.when(F.col("below") == 0, at))).alias("tops")
    bottoms = F.collect_set(F.when(F.col("below") == 1, at)).alias("bottoms")
    near = lambda t: F.array_min(F.transform("bottoms", lambda b: F.struct(F.abs(b - t).alias("far"), b.alias("at"))))

    def step(acc, t):
        found = near(t)
        free = (found["far"] < reach) & ~F.exists(acc, lambda m: m["bottom"].eqNullSafe(found["at"]))
        return F.concat(acc, F.array(F.struct(t.alias("top"), F.when(free, found["at"]).alias("bottom"))))

    pairs = folded(F.col("tops"), F.array().cast("array<struct<top:double,bottom:double>>"), step)
    return bars.groupBy(by).agg(tops, bottoms).select(by, F.inline(pairs))


def match_rows(points: DataFrame, by: str, origin: float, step: float, rows: int, reach: float) -> DataFrame:
    """row_idx, y: each expected row takes the first found row within reach after the last match; rows
    without one are shifted by the median shift of the others."""
    held = points.groupBy(by).agg(F.sort_array(F.collect_set(F.col("cy").cast("double"))).alias("found"))
    expected = F.transform(F.sequence(F.lit(0), F.lit(rows - 1)), lambda i: F.lit(origin) + i * F.lit(step))

    def take(acc, y):
        hit = F.get(F.filter("found", lambda v: (v > acc["last"]) & (F.abs(v - y) <= reach)), F.lit(0))
        return F.struct(F.coalesce(hit, acc["last"]).alias("last"), F.concat(acc["rows"], F.array(F.struct(y.alias("y"), hit.alias("hit")))).alias("rows"))

    start = F.struct(F.lit(-1e300).alias("last"), F.array().cast("array<struct<y:double,hit:double>>").alias("rows"))
    matched = held.select(by, folded(expected, start, take)["rows"].alias("rows"))
    shifts = F.array_sort(F.transform(F.filter("rows", lambda r: r["hit"].isNotNull()), lambda r: r["hit"] - r["y"]))
    middle = lambda a: (F.get(a, F.floor((F.size(a) - 1) / 2).cast("int")) + F.get(a, F.floor(F.size(a) / 2).cast("int"))) / 2
    shifted = matched.withColumn("shifts", shifts).withColumn("shift", F.coalesce(middle(F.col("shifts")), F.lit(0.0)))
    return shifted.select(by, F.posexplode("rows").alias("row_idx", "r"), "shift").select(by, F.col("row_idx").cast("long").alias("row_idx"), F.coalesce(F.col("r.hit"), F.col("r.y") + F.col("shift")).alias("y"))


def nms(circles: DataFrame, by: str, apart: float) -> DataFrame:
    """Non-maximum suppression: larger circles first, those nearer than `apart` to a kept one go."""
    held = gathered(circles, [by], [(-F.col("r").cast("double")).alias("size"), real("cx"), real("cy")])
    close = lambda k, c: (k["cx"] - c["cx"]) * (k["cx"] - c["cx"]) + (k["cy"] - c["cy"]) * (k["cy"] - c["cy"]) < apart * apart
    none = F.array().cast("array<struct<size:double,cx:double,cy:double>>")
    return held.select(by, F.inline(kept_in_turn(F.col("items"), none, close))).select(by, "cx", "cy", (-F.col("size")).alias("r"))


def gap_fill(detections: DataFrame, by: str, reach: float) -> DataFrame:
    """The circles (box 0) that boxes (box 1), and circles added before, leave room for within reach in
    x and y, in order of y, then x."""
    item = F.struct(real("cy"), real("cx"))
    boxes, circles = (F.sort_array(F.collect_set(F.when(F.col("box") == b, item))).alias(n) for b, n in ((1, "boxes"), (0, "circles")))
    close = lambda k, c: (F.abs(k["cx"] - c["cx"]) <= reach) & (F.abs(k["cy"] - c["cy"]) <= reach)
    all_held = kept_in_turn(F.col("circles"), F.col("boxes"), close)
    added = F.slice(all_held, F.size("boxes") + 1, F.size("circles"))
    return detections.groupBy(by).agg(boxes, circles).where(F.size("circles") > 0).select(by, F.inline(added)).select(by, "cx", "cy")


def trim_rows(circles: DataFrame, by: list[str], centres: list[float]) -> DataFrame:
    """cx, cy, choice_rank: each centre in turn takes the nearest circle left, of equals the leftmost."""
    held = gathered(circles, by, [real("cx"), real("cy")])

    def take(acc, c):
        near = F.array_min(F.transform(acc["left"], lambda p: F.struct(F.abs(p["cx"] - c["at"]).alias("far"), p.alias("p"))))["p"]
        taken = F.concat(acc["taken"], F.array(F.struct(near["cx"].alias("cx"), near["cy"].alias("cy"), c["rank"].alias("choice_rank"))))
        return F.when(F.size(acc["left"]) == 0, acc).otherwise(F.struct(F.filter(acc["left"], lambda p: p != near).alias("left"), taken.alias("taken")))

    ranked = F.array(*[F.struct(F.lit(float(c)).alias("at"), F.lit(i).cast("long").alias("rank")) for i, c in enumerate(centres)])
    start = F.struct(F.col("items").alias("left"), F.array().cast("array<struct<cx:double,cy:double,choice_rank:bigint>>").alias("taken"))
    return held.select(*by, F.inline(folded(ranked, start, take)["taken"]))


def proximity_filter(points: DataFrame, by: str, at: str, apart: float) -> DataFrame:
    """Positions that lie at least `apart` after the last one kept."""
    held = points.groupBy(by).agg(F.sort_array(F.collect_set(F.col(at).cast("double"))).alias("items"))
    keep = lambda acc, v: F.when((F.size(acc) == 0) | (v - F.get(acc, F.size(acc) - 1) >= apart), F.concat(acc, F.array(v))).otherwise(acc)
    return held.select(by, F.explode(folded(F.col("items"), F.array().cast("array<double>"), keep)).alias(at))


def kmeans_1d(values: np.ndarray, k: int) -> np.ndarray:
    """Cluster numbers (in order of centre) with the least sum of squares, exact, for each row of sorted
    values (groups x n). Sums are taken in millionths; of equal splits the earliest last cut wins."""
    groups, n = values.shape
    k = min(k, n)
    zero = np.zeros((groups, 1))
    s1, s2 = (np.concatenate([zero, np.cumsum(v, axis=1)], axis=1) for v in (values, values * values))
    cost = np.full((k + 1, groups, n + 1), np.iinfo(np.int64).max // 4)
    cut = np.zeros((k + 1, groups, n + 1), np.int64)
    cost[0, :, 0] = 0
    for c in range(1, k + 1):
        for j in range(c, n + 1):
            i = np.arange(c - 1, j)
            spread = s2[:, j : j + 1] - s2[:, i] - (s1[:, j : j + 1] - s1[:, i]) ** 2 / (j - i)
            whole = cost[c - 1][:, i] + np.floor(spread * 1e6 + 0.5).astype(np.int64)
            best = whole.argmin(axis=1)
            cut[c, :, j], cost[c, :, j] = i[best], whole[np.arange(groups), best]
    label, j, row = np.zeros((groups, n), np.int64), np.full(groups, n), np.arange(groups)
    for c in range(k, 0, -1):
        first = cut[c, row, j]
        place = np.arange(n)
        label[(place >= first[:, None]) & (place < j[:, None])] = c - 1
        j = first
    return label


def cluster_1d(points: DataFrame, by: str, at: str, k: int) -> DataFrame:
    """by, cluster, n, lo, hi from the distinct positions of each group; groups of one size are solved together."""
    held = points.groupBy(by).agg(F.sort_array(F.collect_set(F.col(at).cast("double"))).alias("items"))
    kind = held.schema[by].dataType.simpleString()

    def run(batches):
        for pdf in batches:
            sizes = pdf["items"].map(len).to_numpy()
            for n in np.unique(sizes):
                some = pdf[sizes == n]
                values = np.stack(some["items"].to_numpy()) if n else np.zeros((len(some), 0))
                label = kmeans_1d(values, k)
                key = np.repeat(some[by].to_numpy(), n)
                first = np.concatenate([np.ones((len(some), 1), bool), label[:, 1:] != label[:, :-1]], axis=1).ravel() if n else np.zeros(0, bool)
                at_ = np.flatnonzero(first)
                ends = np.append(at_[1:], len(first))
                flat = values.ravel()
                yield pd.DataFrame({by: key[at_], "cluster": label.ravel()[at_], "n": ends - at_, "lo": flat[at_], "hi": flat[ends - 1]})

    return held.mapInPandas(run, f"{by} {kind}, cluster long, n long, lo double, hi double")
