"""A few drawn pages for tests of the pixel kernels: marks of some sheets in the bubbles of a template."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from markgrid.operators import kernels
from markgrid.plans import grading as g
from markgrid.sources import templates as t
from markgrid.sources.marks import MASK

TEMPLATE = "Q10_5ch"


def drawn(spark, marks):
    """sheet, template_id, gray: each sheet of marks as a drawn page."""
    darkest = marks.where("q <= 10").groupBy("sheet", "q", "rank").agg(F.max("dark").alias("dark"))
    cells = F.broadcast(t.grid(t.templates(spark).where(F.col("template_id") == TEMPLATE)).select("q", F.col("choice_rank").alias("rank"), "cx", "cy", "r"))
    places = darkest.join(cells, ["q", "rank"]).groupBy("sheet").agg(*[F.collect_list(c).alias(c) for c in ("cx", "cy", "dark")], F.first("r").alias("r"))

    def run(batches):
        for pdf in batches:
            for s in pdf.itertuples():
                page = kernels.render(np.asarray(s.cx), np.asarray(s.cy), int(s.r), np.asarray(s.dark) / MASK, seed=int(s.sheet), shade=0.2, noise=2.0)
                yield pd.DataFrame({"sheet": [s.sheet], "template_id": [TEMPLATE], "gray": [page.tobytes()]})

    return places.mapInPandas(run, "sheet long, template_id string, gray binary")


def read_again(spark, marks):
    """sheet, q, choice and note as read from the drawn pages."""
    bubbles = kernels.measured(drawn(spark, marks), t.grid(t.templates(spark)))
    share = bubbles.select("sheet", "q", "rank", F.round(F.col("dark") * MASK / F.col("mask")).cast("int").alias("dark"))
    return g.graded(share, g.V3O, 10).select("sheet", "q", "choice", "note")
