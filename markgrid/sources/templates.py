"""Sheet templates: a dimension generated from question counts, choice counts and languages, and
bubble geometry read from measurement files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import half_even, template_id

# Fixed values of the sheet format.
QUESTION_COUNTS = (10, 15, 18, 20, 30, 40, 50, 60, 80, 100)
CHOICE_COUNTS = (2, 3, 4, 5)
GRID_X0, GRID_X1, GRID_Y0, GRID_Y1 = 64, 686, 239, 999
PX_PER_MM = 750 / 210
HEADER_EVERY = 5
LEFT_INSET, RIGHT_INSET, RIGHT_BASE = 0.100, 0.089, 37.0
WIDE_LEFT_INSET, WIDE_RIGHT_BASE = 0.138, 48.0


def templates(spark: SparkSession, langs: tuple[str, ...] = ("ar",)) -> DataFrame:
    """One row a template and language, with derived geometry in pixels of the aligned sheet."""
    each = lambda xs: F.explode(F.array(*map(F.lit, xs)))
    q = F.col("n_questions")
    base = spark.range(0, 1, 1, 1).select(each(QUESTION_COUNTS).alias("n_questions")).select("n_questions", each(CHOICE_COUNTS).alias("n_choices")).withColumn("lang", each(langs))
    return base.select(
        template_id(q, F.col("n_choices")).alias("template_id"), "lang", "n_questions", "n_choices",
        F.when(q <= 20, 2).otherwise(4).alias("n_cols"), (F.col("lang") == "ar").alias("rtl"),
        F.when(q <= 20, 26).when(q <= 50, 20).otherwise(18).alias("bubble_css_px"),
        F.when(q == 20, WIDE_LEFT_INSET).otherwise(LEFT_INSET).alias("left_inset"), F.when(q == 20, WIDE_RIGHT_BASE).otherwise(RIGHT_BASE).alias("right_base"),
    ).withColumn("rows_per_col", F.ceil(q / F.col("n_cols")).cast("int")).withColumn(
        "n_hdr_rows", F.ceil(F.col("rows_per_col") / HEADER_EVERY).cast("int")
    ).withColumn("visual_rows", F.col("rows_per_col") + F.col("n_hdr_rows")).withColumns({
        "col_w": F.floor(F.lit(GRID_X1 - GRID_X0) / F.col("n_cols")).cast("int"),
        "row_h": F.lit(float(GRID_Y1 - GRID_Y0)) / F.col("visual_rows"),
        "bub_r": F.greatest(F.lit(6), half_even(F.col("bubble_css_px") * F.lit(25.4 / 96.0) * F.lit(PX_PER_MM) / 2)),
    })


def numbered(spark: SparkSession) -> DataFrame:
    """templates with a position 0..39 in order of question and choice counts."""
    q = sum((F.when(F.col("n_questions") == n, F.lit(i)).otherwise(F.lit(0)) for i, n in enumerate(QUESTION_COUNTS)), F.lit(0))
    return templates(spark).withColumn("position", (q * len(CHOICE_COUNTS) + F.col("n_choices") - 2).cast("int"))


def row_y(row):
    """Centre of a question row (0 is first) in its column, below a header every HEADER_EVERY rows."""
    return half_even(F.lit(GRID_Y0) + (row + F.floor(row / HEADER_EVERY) + 1.5) * F.col("row_h"))


def header_y(group):
    return half_even(F.lit(GRID_Y0) + (group * (HEADER_EVERY + 1) + 0.5) * F.col("row_h"))


def bubble_x(col, rank):
    """Centre of a choice in a column; the first choice is the rightmost where text runs right to left."""
    x0 = F.lit(GRID_X0) + col * F.col("col_w")
    left = x0 + F.col("col_w") * F.col("left_inset")
    right = x0 + F.col("col_w") - (F.col("right_base") + F.col("col_w") * F.lit(RIGHT_INSET))
    place = F.when(F.col("rtl"), F.col("n_choices") - 1 - rank).otherwise(rank)
    return half_even(left + place * ((right - left) / (F.col("n_choices") - 1)))


def question_at(col, row):
    return F.when(F.col("rtl"), (F.col("n_cols") - 1 - col) * F.col("rows_per_col")).otherwise(col * F.col("rows_per_col")) + row + 1


def grid(template_rows: DataFrame) -> DataFrame:
    """A row for each bubble: col_idx, row_idx, choice_rank, q, cx, cy, r; rows beyond the last question are left out."""
    cells = template_rows.withColumn("col_idx", F.explode(F.sequence(F.lit(0), F.col("n_cols") - 1))).withColumn("row_idx", F.explode(F.sequence(F.lit(0), F.col("rows_per_col") - 1)))
    cells = cells.withColumn("q", question_at(F.col("col_idx"), F.col("row_idx")).cast("int")).where("q <= n_questions")
    cells = cells.withColumn("choice_rank", F.explode(F.sequence(F.lit(0), F.col("n_choices") - 1)))
    return cells.withColumns({"cx": bubble_x(F.col("col_idx"), F.col("choice_rank")), "cy": row_y(F.col("row_idx")), "r": F.col("bub_r")})


def bubble_geometry(spark: SparkSession, folder: str) -> DataFrame:
    """template, lang, q, choice, col, row, cx_frac, cy_frac, r_frac from measurement files <template>_<lang>.json."""
    schema = "template string, n_questions int, n_choices int, n_cols int, rtl boolean, bubbles array<struct<q:int,choice:int,col:int,row:int,cx_frac:double,cy_frac:double,r_frac:double>>"
    rows = spark.read.schema(schema).option("multiLine", True).json(folder)
    return rows.select(F.col("template"), F.when(F.col("rtl"), "ar").otherwise("en").alias("lang"), "n_questions", "n_choices", "n_cols", F.inline("bubbles"))
