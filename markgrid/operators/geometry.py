"""Operators on detected positions: clusters, bands, lattices and nearest points, as windows and
equi-joins; a point's neighbours are found by cells, never by pairing all points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import half_even


def regularize(points: DataFrame, by: list[str], value: str) -> DataFrame:
    """The exact median of value per group, rounded half to even, on each point."""
    medians = points.groupBy(*by).agg(half_even(F.median(value)).alias(f"{value}_median"))
    return points.join(medians, by)


def rank_within(points: DataFrame, by: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    return points.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1)


def top_within(points: DataFrame, by: list[str], order: list[Column], n: int, name: str = "rank") -> DataFrame:
    """The first n of each group, numbered from 0. The filter is on the row number itself, so that Spark
    keeps n rows a group while it sorts, before and after the shuffle."""
    kept = points.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(name) <= n)
    return kept.withColumn(name, F.col(name) - 1)


def arg_max_cell(points: DataFrame, by: list[str], value: str, tie: list[str]) -> DataFrame:
    """One point a cell: the largest value, the smallest tie columns among equals."""
    best = F.max(F.struct(value, *[(-F.col(t)).alias(f"minus_{t}") for t in tie]))
    return points.groupBy(*by).agg(best.alias("b"), F.count("*").alias("n")).select(*by, F.col(f"b.{value}").alias(value), *[(-F.col(f"b.minus_{t}")).alias(t) for t in tie], "n")


def bands(marks: DataFrame, by: list[str], at: str) -> DataFrame:
    """Runs of consecutive positions: by, start, stop, size. marks has each position once."""
    island = F.col(at) - F.row_number().over(Window.partitionBy(*by).orderBy(at))
    return marks.withColumn("island", island).groupBy(*by, "island").agg(F.min(at).alias("start"), F.max(at).alias("stop"), F.count("*").alias("size")).drop("island")


def merge_bands(runs: DataFrame, by: list[str], gap: int) -> DataFrame:
    """Bands at most gap apart become one; bands must not overlap."""
    order = Window.partitionBy(*by).orderBy("start")
    new = (F.col("start") - F.lag("stop").over(order) > gap).cast("int")
    group = F.sum(F.coalesce(new, F.lit(0))).over(order)
    return runs.withColumn("g", group).groupBy(*by, "g").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.count("*").alias("parts")).drop("g")


def tallest(runs: DataFrame, by: list[str], n: int) -> DataFrame:
    """The n tallest bands of each group (the earlier of equals), numbered by position."""
    height = (F.col("stop") - F.col("start")).desc()
    kept = top_within(runs, by, [height, F.col("start")], n, "k").drop("k")
    return rank_within(kept, by, [F.col("start")], "place")


def gap_clusters(values: DataFrame, by: list[str], at: str, gap: int) -> DataFrame:
    """One-dimensional clusters: a new one starts where the next value is gap or more away."""
    order = Window.partitionBy(*by).orderBy(at)
    new = (F.col(at) - F.lag(at).over(order) >= gap).cast("int")
    label = F.sum(F.coalesce(new, F.lit(0))).over(order)
    return values.withColumn("cluster", label).groupBy(*by, "cluster").agg(F.count("*").alias("n"), (F.sum(at) / F.count("*")).alias("centre"), F.min(at).alias("lo"), F.max(at).alias("hi"))


def pitch(values: DataFrame, by: list[str], at: str, least: int = 5) -> DataFrame:
    """Median of the differences over `least` between neighbouring positions."""
    step = F.lead(at).over(Window.partitionBy(*by).orderBy(at)) - F.col(at)
    return values.withColumn("step", step).where(F.col("step") > least).groupBy(*by).agg(F.median("step").alias("pitch"), F.count("*").alias("steps"))


def snap(at: Column, origin: Column, step: Column, reach: int) -> Column:
    """The nearest point of a regular lattice if it is within reach, else the position itself."""
    near = half_even(origin + F.floor((at - origin) / step + 0.5) * step)
    return F.when(F.abs(near - at) <= reach, near).otherwise(at)


def nearest(at: Column, centres: list[float]) -> Column:
    """Index of the nearest of a few fixed centres; the first wins ties."""
    distance = [F.abs(at - F.lit(c)) for c in centres]
    least = F.least(*distance)
    return F.coalesce(*[F.when(d == least, F.lit(i)) for i, d in enumerate(distance)])


def within_reach(points: DataFrame, others: DataFrame, by: list[str], reach: int) -> DataFrame:
    """Pairs of points and others (ox, oy) of a group at a distance of at most reach. Both sides are
    dealt into cells of that size; a point meets the nine cells around it."""
    cell = lambda c: F.floor(F.col(c) / reach)
    offsets = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    around = points.withColumn("o", F.explode(offsets)).withColumns({"gx": cell("cx") + F.col("o.i"), "gy": cell("cy") + F.col("o.j")}).drop("o")
    dealt = others.withColumns({"gx": cell("ox"), "gy": cell("oy")})
    dx, dy = F.col("cx") - F.col("ox"), F.col("cy") - F.col("oy")
    return around.join(dealt, [*by, "gx", "gy"]).where(dx * dx + dy * dy <= reach * reach).drop("gx", "gy")


def corners(points: DataFrame, by: list[str]) -> DataFrame:
    """Top-left, top-right, bottom-right and bottom-left point of each group, by sum and difference
    of the coordinates; of equals the one with the smaller x, then y."""
    x, y = F.col("cx"), F.col("cy")
    pick = lambda key: F.min(F.struct(key.alias("k"), x.alias("x"), y.alias("y")))
    found = points.groupBy(*by).agg(pick(x + y).alias("tl"), pick(y - x).alias("tr"), pick(-(x + y)).alias("br"), pick(x - y).alias("bl"))
    return found.select(*by, *[F.col(f"{c}.{a}").alias(f"{c}_{a}") for c in ("tl", "tr", "br", "bl") for a in ("x", "y")])
