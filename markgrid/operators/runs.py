"""Pixels as rows: dark runs of a line (y, start, stop), discs as one span a line, and counts by their ends.

An image is never laid out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .layout import covered


def half_width(r: Column, dy: Column) -> Column:
    """How far a disc of radius r reaches to each side on the line dy below its centre."""
    return F.floor(F.sqrt((r * r - dy * dy).cast("double"))).cast("int")


def disc_lines(discs: DataFrame, r: str) -> DataFrame:
    """discs (cx, cy and a radius) with a row for each line: y, reach (to each side)."""
    lines = discs.withColumn("dy", F.explode(F.sequence(-F.col(r), F.col(r))))
    return lines.withColumns({"y": F.col("cy") + F.col("dy"), "reach": half_width(F.col(r), F.col("dy"))}).drop("dy")


def disc_pixels(r: Column) -> Column:
    """The pixels of a disc."""
    return F.aggregate(F.transform(F.sequence(-r, r), lambda dy: 2 * half_width(r, dy) + 1), F.lit(0), lambda a, b: a + b)


def dark_runs(discs: DataFrame, by: list[str], r: str) -> DataFrame:
    """by..., y, start, stop, width: the runs that dark discs cover together."""
    spans = disc_lines(discs, r).select(*by, "y", (F.col("cx") - F.col("reach")).alias("start"), (F.col("cx") + F.col("reach")).alias("stop"))
    return covered(spans, [*by, "y"])


def disc_darkness(discs: DataFrame, runs: DataFrame, by: list[str], r: str, shifts: int = 5) -> DataFrame:
    """by..., cx, cy, r, dark, mask: for each disc the pixels, and the most dark ones among them over sideways shifts of
    -shifts..shifts. runs: dark_runs. Pixels that no run has are light, also beyond the page.

    A disc's line meets the runs of the same line that it can reach, and what they share is a difference of two
    ends for each shift, so all of it is plain arithmetic in compiled code."""
    key = [*by, "cx", "cy", r]
    each = disc_lines(discs.select(*key).distinct(), r).alias("a")
    far, at = F.col("reach") + shifts, F.col("cx")
    near = (F.col("start") <= at + far) & (F.col("stop") >= at - far)
    met = each.join(runs.select(*by, "y", "start", "stop"), [*by, "y"]).where(near)
    step = range(-shifts, shifts + 1)
    shared = lambda s: F.greatest(F.lit(0), F.least(F.col("stop"), at + s + F.col("reach")) - F.greatest(F.col("start"), at + s - F.col("reach")) + 1)
    counts = met.groupBy(*key).agg(*[F.sum(shared(s)).alias(f"s{s + shifts}") for s in step])
    found = counts.select(*key, F.greatest(*[F.col(f"s{s + shifts}") for s in step]).alias("dark"))
    every = discs.select(*key).distinct().join(found, key, "left")
    return every.select(*key, F.coalesce("dark", F.lit(0)).alias("dark"), disc_pixels(F.col(r)).alias("mask"))
