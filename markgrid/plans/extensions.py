"""Queries by functions that users add, and the classifier fitted by Newton steps, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import extensions
from ..operators import codes, learn
from ..sources.marks import CIRCLES_SQL, circles
from ..sources.tables import written
from . import answers as a
from . import geometry

FEATURES, CLASSES, HELD_OUT = ("fill", "fill_squared", "share"), ("empty", "filled", "ambiguous"), 5


def lateral_bubbles(spark, d):
    """The bubbles of the templates in use, by the table function."""
    extensions.register(spark)
    used = geometry.sheets(spark, d).groupBy("template_id").agg(F.count("*").alias("sheets"))
    return spark.sql("SELECT u.template_id, b.*, u.sheets FROM {used} u, LATERAL template_bubbles(u.template_id) b", used=used)


def fill_spread(spark, d):
    """The median absolute deviation of the fills of each sheet."""
    extensions.register(spark)
    return spark.sql("SELECT sheet, nanvl(spread_of_list(fills), NULL) AS spread FROM (SELECT sheet, collect_list(fill) AS fills FROM {c} GROUP BY sheet)", c=circles(spark, d).select("sheet", "fill"))


def labelled(spark, d):
    """Bubbles with their features and status: fill, its square, and its share of the question's darkest."""
    marks = a.bubble_statuses(spark, d).select("sheet", "q", "fill", F.col("fill").alias("own"), "status")
    top = marks.groupBy("sheet", "q").agg(F.max("own").alias("top"))
    joined = marks.join(top, ["sheet", "q"])
    return joined.select("sheet", "status", "fill", (F.col("fill") * F.col("fill")).alias("fill_squared"), F.coalesce(F.col("fill") / F.nullif("top", F.lit(0.0)), F.lit(0.0)).alias("share"))


def status_classifier(spark, d):
    """A softmax of three features learnt from four sheets in five, judged on the fifth."""
    rows = written(labelled(spark, d), "labelled-bubbles")
    model = learn.fit_softmax(rows.where(F.col("sheet") % HELD_OUT != 0), FEATURES, "status", CLASSES, penalty=1e-6)
    held = rows.where(F.col("sheet") % HELD_OUT == 0)
    own = F.coalesce(*[F.when(F.col("status") == c, p) for c, p in zip(CLASSES, model.probabilities())])
    seen = held.select("status", model.predicted().alias("seen"), F.floor(-F.log(F.greatest(own, F.lit(1e-12))) * 1e6 + 0.5).cast("long").alias("loss"))
    return codes.evaluation(seen, "status", "seen", "loss")


QUERIES = {f.__name__: f for f in (lateral_bubbles, fill_spread, status_classifier)}
ORACLES = {
    "lateral_bubbles": geometry.ORACLES["bubble_positions"],
    "fill_spread": f"SELECT sheet, mad(fill)::DOUBLE AS spread FROM ({CIRCLES_SQL}) GROUP BY sheet",
}
