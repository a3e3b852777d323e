"""Operators on decoded codes, labels and class scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import code_role
from .geometry import nearest

CODE_PATTERNS = {"code": r"(?i)[A-Z]?\d{4,6}(?:[-]\d+)?", "digits": r"\d{4,6}", "student": r"(?i)[A-Z]?\d{5,6}"}


def roles(codes: DataFrame, by: list[str]) -> DataFrame:
    """The first student and the first exam code of each group in reading order (column at); UNKNOWN without one."""
    first = lambda role: F.coalesce(F.min(F.when(code_role(F.col("code")) == role, F.struct("at", "code")))["code"], F.lit("UNKNOWN"))
    return codes.groupBy(*by).agg(first("student").alias("student_code"), first("exam").alias("exam_code"), F.count("*").alias("codes"))


def extract_codes(text: Column) -> dict[str, Column]:
    return {name: F.regexp_extract(text, pattern, 0) for name, pattern in CODE_PATTERNS.items()}


def decode_digits(cells: DataFrame, by: list[str], places: int, least: float = 0.20) -> DataFrame:
    """A code per group from bubbles (place, digit, fill): the darkest digit of each place if over
    least (the smaller digit of equals), '?' else; places are read from the last to the first."""
    best = cells.groupBy(*by, "place").agg(F.max(F.struct("fill", (-F.col("digit")).alias("minus"))).alias("b"))
    mark = F.when(F.col("b.fill") > least, (-F.col("b.minus")).cast("string")).otherwise("?")
    at = [F.coalesce(F.max(F.when(F.col("place") == p, mark)), F.lit("?")) for p in range(places)]
    return best.groupBy(*by).agg(F.concat(*reversed(at)).alias("code"))


def softmax(scores: list[Column]) -> tuple[list[Column], Column]:
    """Stable softmax and the index of the first largest score."""
    top = F.greatest(*scores)
    powers = [F.exp(s - top) for s in scores]
    whole = reduce(lambda a, b: a + b, powers)
    return [p / whole for p in powers], F.coalesce(*[F.when(s == top, F.lit(i)) for i, s in enumerate(scores)])


def class_weights(labels: DataFrame, label: str, classes: int) -> DataFrame:
    """Inverse-frequency weights of each class that occurs."""
    counts = labels.groupBy(label).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select(label, "n", (F.col("total") / (F.lit(classes) * F.col("n"))).alias("weight"))  # one row


def confusion(rows: DataFrame, truth: str, seen: str, classes: list[int]) -> DataFrame:
    """A row for each true class: counts by predicted class, support and recall."""
    cells = [F.count_if(F.col(seen) == c).alias(f"seen_{c}") for c in classes]
    return rows.groupBy(truth).agg(*cells, F.count("*").alias("support"), (F.count_if(F.col(truth) == F.col(seen)) / F.count("*")).alias("recall"))


def evaluation(rows: DataFrame, truth: str, seen: str, loss: str) -> DataFrame:
    """One row: n, accuracy, and the mean loss with inverse-frequency class weights, which is the mean over
    classes of each class's mean. loss: in whole millionths, so that the sums are exact."""
    by = rows.groupBy(truth).agg(F.count("*").alias("n"), F.count_if(F.col(truth) == F.col(seen)).alias("right"), F.sum(loss).alias("loss"))
    mean = F.floor(F.col("loss") * 1000 / F.col("n")).cast("long")
    return by.agg(F.sum("n").alias("n"), (F.sum("right") / F.sum("n")).alias("accuracy"), (F.sum(mean) / F.count("*") / F.lit(1e9)).alias("weighted_loss"))


def code_cells(circles: DataFrame, height: int, centres: list[float]) -> DataFrame:
    """circles (cx, cy, fill) with the digit of the nearest of ten even rows of a grid of that height, and
    the place of the nearest column centre; circles outside the grid go."""
    rows = [(i + 0.5) * height / 10 for i in range(10)]
    inside = circles.where((F.col("cy") >= 0) & (F.col("cy") < height))
    return inside.withColumns({"digit": nearest(F.col("cy"), rows), "place": nearest(F.col("cx"), centres)})


def every_nth_split(rows: DataFrame, by: list[str], order: list[str], n: int = 5, ranges: int = 1024) -> DataFrame:
    """Every nth row of each group goes to val. Few groups may hold all rows, so rows are numbered within
    ranges of the first of order (numeric), on top of the sizes of the ranges before: a window never
    sees more than one range of a group, or the sizes of a group's ranges. A column split is replaced."""
    names = rows.columns
    rows = rows.select(F.struct(*names).alias("__row"), *dict.fromkeys([*by, *order]))
    ends = rows.agg(F.min(order[0]).alias("__lo"), F.max(order[0]).alias("__hi"))  # one row
    ranged = rows.crossJoin(F.broadcast(ends)).withColumn("__range", F.floor((F.col(order[0]) - F.col("__lo")) * ranges / (F.col("__hi") - F.col("__lo") + 1)))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = ranged.groupBy(*by, "__range").agg(F.count("*").alias("__n")).withColumn("__before", before)
    seq = F.row_number().over(Window.partitionBy(*by, "__range").orderBy(*order)) - 1 + F.col("__before")
    return ranged.join(sizes, [*by, "__range"]).withColumn("split", F.when(seq % n == 0, "val").otherwise("train")).select(*[F.col("__row").getField(c).alias(c) for c in names if c != "split"], "split")


def box_line(cls: Column, x0: Column, y0: Column, x1: Column, y1: Column, width: int, height: int) -> Column:
    """A detection label line: class, centre and size as shares of the page, clamped to it, in millionths."""
    clamp = lambda v, top: F.greatest(F.lit(0), F.least(v, F.lit(top)))
    x0, x1, y0, y1 = clamp(x0, width), clamp(x1, width), clamp(y0, height), clamp(y1, height)
    million = lambda v, size: F.floor(v * 1_000_000 / (2 * size)).cast("long").cast("string")
    return F.concat_ws(" ", cls.cast("string"), million(x0 + x1, width), million(y0 + y1, height), million(2 * (x1 - x0), width), million(2 * (y1 - y0), height))
