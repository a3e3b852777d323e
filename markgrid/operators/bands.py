"""Question rows from a dark profile: a moving threshold, bands, and exactly as many rows as a sheet has; and the
shift of a profile against the printed rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .geometry import bands, merge_bands
from .layout import median_of, uniform_rows

EMPTY = "array<struct<start:int,stop:int>>"


def dark_lines(profile: DataFrame, by: list[str], reach: int, share: float, least: int) -> DataFrame:
    """by..., y: lines whose value v is at least `least`, and at least `share` of the mean over the lines at most
    `reach` away (lines that the profile lacks are 0)."""
    around = Window.partitionBy(*by).orderBy("y").rangeBetween(-reach, reach)
    mean = F.sum("v").over(around) / F.lit(2 * reach + 1)
    return profile.withColumn("mean", mean).where((F.col("v") >= least) & (F.col("v") >= F.lit(share) * F.col("mean"))).select(*by, "y")


def spaced(found: Column, apart: int) -> Column:
    """Bands in order whose centres lie at least `apart` after the last one kept; of two that don't, the taller stays
    (the earlier of equals)."""
    centre = lambda b: F.floor((b["start"] + b["stop"]) / 2)
    height = lambda b: b["stop"] - b["start"]

    def add(kept, b):
        last = F.get(kept, F.size(kept) - 1)
        swap = F.concat(F.slice(kept, 1, F.size(kept) - 1), F.array(b))
        return F.when(F.size(kept) == 0, F.array(b)).when(centre(b) - centre(last) >= apart, F.concat(kept, F.array(b))).when(height(b) > height(last), swap).otherwise(kept)

    return F.aggregate(found, F.array().cast(EMPTY), add)


def tallest(found: Column, n: int) -> Column:
    """The n tallest bands (the earlier of equals), in order."""
    by_height = F.array_sort(F.transform(found, lambda b: F.struct((b["start"] - b["stop"]).alias("minus"), b["start"].alias("start"), b["stop"].alias("stop"))))
    return F.array_sort(F.transform(F.slice(by_height, 1, n), lambda b: F.struct(b["start"].alias("start"), b["stop"].alias("stop"))))


def extrapolated(centres: Column, n: int) -> Column:
    """Centres (three or more) and, below the last, as many more as make n, a pitch apart: the median of the steps that are
    not over one and a half times the median step."""
    steps = F.zip_with(F.slice(centres, 2, F.size(centres) - 1), F.slice(centres, 1, F.size(centres) - 1), lambda a, b: a - b)
    whole = lambda a: median_of(a).cast("int")
    pitch = whole(F.filter(steps, lambda s: s <= (whole(steps) * 1.5).cast("int")))
    more = F.transform(F.sequence(F.lit(1), n - F.size(centres)), lambda k: F.element_at(centres, -1) + k * pitch)
    return F.concat(centres, more)


def rows_of_profile(profile: DataFrame, by: str, rows: int, y0: int, y1: int, merge_gap: int, apart: int, reach: int = 20, share: float = 0.5, least: int = 1) -> DataFrame:
    """by, how, row_idx, y: exactly `rows` rows for each group of profile (by, y, v; each line once).

    Dark lines make bands, bands at most merge_gap apart one, and bands closer than `apart` the taller of them. As
    many as rows: exact; more: the tallest (trim); three or more: extrapolated; else uniform rows of y0..y1 (fallback)."""
    dark = dark_lines(profile, [by], reach, share, least)
    merged = merge_bands(bands(dark, [by], "y"), [by], merge_gap)
    held = merged.groupBy(by).agg(F.sort_array(F.collect_list(F.struct(F.col("start").cast("int").alias("start"), F.col("stop").cast("int").alias("stop")))).alias("found"))
    every = profile.select(by).distinct().join(held, by, "left").select(by, spaced(F.coalesce("found", F.array().cast(EMPTY)), apart).alias("found"))
    n = F.size("found")
    how = F.when(n == rows, "exact").when(n > rows, "trim").when(n >= 3, "extrapolated").otherwise("fallback")
    centres = F.transform(tallest(F.col("found"), rows), lambda b: F.floor((b["start"] + b["stop"]) / 2).cast("int"))
    # in steps, so that each list is computed once
    named = every.select(by, how.alias("how"), centres.alias("centres"))
    ys = F.when(F.col("how") == "extrapolated", extrapolated(F.col("centres"), rows)).when(F.col("how") == "fallback", uniform_rows(F.lit(float(y0)), F.lit(float(y1)), F.lit(rows))).otherwise(F.col("centres"))
    return named.select(by, "how", F.posexplode(ys).alias("row_idx", "y"))


def profile_shift(profile: DataFrame, expected: DataFrame, by: str, most: int) -> DataFrame:
    """by, shift, score: for each group of profile (by, y, v) the shift of -most..most under which its values on the
    expected rows (y) sum to most, the smallest of equals; 0 for a profile without values. Each expected row
    meets the lines around it by their number; nothing is paired with all lines."""
    offsets = F.explode(F.sequence(F.lit(-most), F.lit(most)))
    places = F.broadcast(expected.select(F.col("y").alias("row"), offsets.alias("shift")).select("shift", (F.col("row") + F.col("shift")).alias("y")))  # rows of one sheet
    sums = profile.join(places, "y").groupBy(by, "shift").agg(F.sum("v").alias("score"))
    best = sums.where("score > 0").groupBy(by).agg(F.max(F.struct("score", (-F.col("shift")).alias("minus"))).alias("b"))
    total = profile.groupBy(by).agg(F.sum("v").alias("total")).join(best, by, "left")
    none = F.when(F.col("total") == 0, 0).otherwise(-most)
    return total.select(by, F.coalesce(-F.col("b.minus"), none).alias("shift"), F.coalesce("b.score", F.lit(0)).alias("score"))
