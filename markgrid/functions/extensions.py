"""Functions that users add to SQL: a table function of the bubbles of a template, and an aggregate in pandas.

register(spark) makes them callable by name, the table function with LATERAL:

    SELECT t.template_id, b.* FROM used t, LATERAL template_bubbles(t.template_id) b
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..sources import templates as t

BUBBLES = "q int, choice_rank int, col_idx int, row_idx int, cx int, cy int, r int"


def bubbles_of(template_id: str | None, rtl: bool = True) -> list[tuple]:
    """Rows of BUBBLES of a registered template (question and choice counts of the registry); none for other text."""
    found = re.fullmatch(r"Q(\d+)_(\d+)ch", template_id or "")
    if not found or int(found[1]) not in t.QUESTION_COUNTS or int(found[2]) not in t.CHOICE_COUNTS:
        return []
    n, choices = int(found[1]), int(found[2])
    cols = 2 if n <= 20 else 4
    rows = -(-n // cols)
    width, height = (t.GRID_X1 - t.GRID_X0) // cols, (t.GRID_Y1 - t.GRID_Y0) / (rows + -(-rows // t.HEADER_EVERY))
    css = 26 if n <= 20 else 20 if n <= 50 else 18
    r = max(6, round(css * (25.4 / 96.0) * t.PX_PER_MM / 2))
    inset, base = (t.WIDE_LEFT_INSET, t.WIDE_RIGHT_BASE) if n == 20 else (t.LEFT_INSET, t.RIGHT_BASE)
    out = []
    for col in range(cols):
        x0 = t.GRID_X0 + col * width
        left, right = x0 + width * inset, x0 + width - (base + width * t.RIGHT_INSET)
        for row in range(rows):
            q = ((cols - 1 - col) if rtl else col) * rows + row + 1
            cy = round(t.GRID_Y0 + (row + row // t.HEADER_EVERY + 1.5) * height)
            for rank in range(choices if q <= n else 0):
                place = choices - 1 - rank if rtl else rank
                out.append((q, rank, col, row, round(left + place * ((right - left) / (choices - 1))), cy, r))
    return out


class TemplateBubbles:
    """template_id -> BUBBLES. A row-wise function, as Spark allows none in Arrow batches behind LATERAL."""

    def eval(self, template_id: str) -> Iterator[tuple]:
        yield from bubbles_of(template_id)


def spread(values: pd.Series) -> float:
    """Median absolute deviation; null without values. For groups of bounded size, such as a sheet's bubbles: a group is
    given to Python whole."""
    held = values.dropna()
    return float((held - held.median()).abs().median()) if len(held) else math.nan


def spread_udf():
    """spread as a grouped aggregate."""

    @F.pandas_udf("double")
    def spread_of(values: pd.Series) -> float:
        return spread(values)

    return spread_of


def spreads(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """spread of each of many groups at once: values without nulls, a group's together, and how many each has; NaN for none."""

    def middle(v):
        v = v[np.lexsort((v, group))]
        return (v[np.minimum(first + (sizes - 1) // 2, len(v) - 1)] + v[np.minimum(first + sizes // 2, len(v) - 1)]) / 2.0

    group, first = np.repeat(np.arange(len(sizes)), sizes), np.cumsum(sizes) - sizes
    if not len(values):
        return np.full(len(sizes), math.nan)
    return np.where(sizes > 0, middle(np.abs(values - middle(values)[group])), math.nan)


def spread_of_list_udf():
    """spread of a list, for groups so many that one call of Python each would take too long: a batch of lists is one call."""

    @F.pandas_udf("double")
    def spread_of_list(lists: pd.Series) -> pd.Series:
        sizes = lists.map(len).to_numpy(dtype=np.int64)
        values = np.concatenate(lists.to_list()).astype(np.float64) if len(lists) else np.zeros(0)
        return pd.Series(spreads(values, sizes))

    return spread_of_list


def register(spark: SparkSession) -> None:
    spark.udtf.register("template_bubbles", F.udtf(TemplateBubbles, returnType=BUBBLES))
    spark.udf.register("spread", spread_udf())
    spark.udf.register("spread_of_list", spread_of_list_udf())
