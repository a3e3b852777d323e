"""Blobs: discs that touch each other are one, whatever their number; their areas, boxes, centres and hulls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import written
from .geometry import within_reach
from .runs import dark_runs


def touching(discs: DataFrame, by: list[str], r: str, largest: int) -> DataFrame:
    """a, b: ids of discs (id, cx, cy, radius of at most `largest`) that overlap or touch; neighbours are met by cells."""
    others = discs.select(*by, F.col("cx").alias("ox"), F.col("cy").alias("oy"), F.col("id").alias("b"), F.col(r).alias("r2"))
    near = within_reach(discs.select(*by, "cx", "cy", F.col("id").alias("a"), F.col(r).alias("r1")), others, by, 2 * largest + 1)
    dx, dy, reach = F.col("cx") - F.col("ox"), F.col("cy") - F.col("oy"), F.col("r1") + F.col("r2") + 1
    return near.where((F.col("a") != F.col("b")) & (dx * dx + dy * dy <= reach * reach)).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """id, label: the least id that edges (a, b; both directions) lead to. Each round takes the least label around,
    then the label's own label, so a chain halves; rounds are written tables, and their number is that of the
    halvings of the longest chain."""
    edges = written(edges, "edges")
    labels = written(edges.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        around = edges.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        least = written(labels.join(around, "id").select("id", F.col("label").alias("before"), F.least("label", "near").alias("label")), "labels")
        jump = least.select(F.col("id").alias("label"), F.col("label").alias("far"))
        found = written(least.join(jump, "label").select("id", "before", F.least("label", "far").alias("label")), "labels")
        labels = found.select("id", "label")
        if found.where("label <> before").isEmpty():
            return labels


def labelled(discs: DataFrame, by: list[str], r: str, largest: int) -> DataFrame:
    """discs with blob: the least id of the discs that are joined with it."""
    found = components(touching(discs, by, r, largest))
    return discs.join(found, "id", "left").withColumn("blob", F.coalesce("label", "id")).drop("label")


def chain(points: Column, side: int) -> Column:
    """The hull's vertices on one side (-1: small x, 1: large x) of distinct points (y, x) in order. A fold: what a new point
    leaves no longer convex goes; as the chain is convex, those are its last ones."""

    def turn(a, b, p):
        return ((b["y"] - a["y"]) * (p["x"] - a["x"]) - (b["x"] - a["x"]) * (p["y"] - a["y"])) * -side

    def add(held, p):
        kept = F.filter(held, lambda v, i: (i == 0) | (turn(F.get(held, i - 1), v, p) > 0))
        return F.concat(kept, F.array(p))

    return F.aggregate(points, F.array().cast("array<struct<y:bigint,x:bigint>>"), add)


def twice_under(vertices: Column) -> Column:
    """Twice the area between a chain and the line x = 0."""
    add = lambda acc, p: F.struct(p["y"].alias("y"), p["x"].alias("x"), (acc["s"] + F.coalesce((p["x"] + acc["x"]) * (p["y"] - acc["y"]), F.lit(0))).alias("s"))
    none = F.lit(None).cast("bigint")
    return F.aggregate(vertices, F.struct(none.alias("y"), none.alias("x"), F.lit(0).cast("bigint").alias("s")), add)["s"]


def hull_area(points: Column) -> Column:
    """Area of the convex hull of an array of points (y, x), by the monotone chain; 0 for fewer than three, or in line."""
    whole = F.sort_array(F.array_distinct(F.transform(points, lambda p: F.struct(p["y"].cast("bigint").alias("y"), p["x"].cast("bigint").alias("x")))))
    return (twice_under(chain(whole, 1)) - twice_under(chain(whole, -1))) / F.lit(2.0)


def measured(discs: DataFrame, by: list[str], r: str) -> DataFrame:
    """by..., blob, discs, area (pixels), cx, cy (centre, rounded down), width, height, lines (y, left, right) of labelled discs."""
    key = [*by, "blob"]
    line = dark_runs(discs, key, r).groupBy(*key, "y").agg(F.sum("width").alias("n"), F.sum((F.col("start") + F.col("stop")) * F.col("width")).alias("twice_x"), F.min("start").alias("left"), F.max("stop").alias("right"))
    whole = line.groupBy(*key).agg(
        F.sum("n").alias("area"), F.sum("twice_x").alias("twice_x"), F.sum(F.col("y") * F.col("n")).alias("sum_y"), (F.max("right") - F.min("left") + 1).alias("width"), (F.max("y") - F.min("y") + 1).alias("height"),
        F.collect_list(F.struct("y", "left", "right")).alias("lines"),
    )
    return whole.select(*key, "area", F.floor(F.col("twice_x") / (2 * F.col("area"))).alias("cx"), F.floor(F.col("sum_y") / F.col("area")).alias("cy"), "width", "height", "lines")


def aspect() -> Column:
    return F.least("width", "height") / F.greatest("width", "height")


def solidity() -> Column:
    """Area as a share of the convex hull's, taking pixels as squares."""
    corner = lambda y, x: F.struct(y.alias("y"), x.alias("x"))
    square = lambda p: F.array(corner(p["y"], p["left"]), corner(p["y"], p["right"] + 1), corner(p["y"] + 1, p["left"]), corner(p["y"] + 1, p["right"] + 1))
    return F.col("area") / hull_area(F.flatten(F.transform("lines", square)))
