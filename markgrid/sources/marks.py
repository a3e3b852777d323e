"""Mark tables: one row per bubble, read from the star-schema tables.

dense: sheet = order, question = line number, rank = supplier mod 5, dark pixels = quantity of 50.
sparse: sheets of 100 questions of which about a third have marks, eight orders a sheet.
circles: detected circles with positions, radii and fills, one per order line.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MASK = 50


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dense_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sheet, q, rank, dark: repeated bubbles are not yet combined."""
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("sheet"), F.col("l_linenumber").alias("q"), (F.col("l_suppkey") % 5).cast("int").alias("rank"), F.col("l_quantity").cast("int").alias("dark")
    )


def sparse_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").select(
        F.floor(F.col("l_orderkey") / 8).alias("sheet"), (F.col("l_partkey") % 100 + 1).cast("int").alias("q"), (F.col("l_suppkey") % 5).cast("int").alias("rank"), F.col("l_quantity").cast("int").alias("dark")
    )


def circles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sheet, q, cx, cy, r, fill (hundredths), part, line: circle positions."""
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("sheet"), F.col("l_linenumber").alias("q"), (F.col("l_partkey") % 750).cast("int").alias("cx"), (F.col("l_suppkey") * 7 % 1060).cast("int").alias("cy"),
        (F.col("l_linenumber") + 7).cast("int").alias("r"), F.round(F.col("l_discount") * 1000).cast("int").alias("fill"), F.col("l_quantity").cast("int").alias("dark"),
    )


DENSE_SQL = "SELECT l_orderkey AS sheet, l_linenumber AS q, (l_suppkey % 5)::INT AS rank, l_quantity::INT AS dark FROM lineitem"
SPARSE_SQL = "SELECT l_orderkey // 8 AS sheet, (l_partkey % 100 + 1)::INT AS q, (l_suppkey % 5)::INT AS rank, l_quantity::INT AS dark FROM lineitem"
CIRCLES_SQL = (
    "SELECT l_orderkey AS sheet, l_linenumber AS q, (l_partkey % 750)::INT AS cx, (l_suppkey * 7 % 1060)::INT AS cy, (l_linenumber + 7)::INT AS r, "
    "round(l_discount * 1000)::INT AS fill, l_quantity::INT AS dark FROM lineitem"
)
