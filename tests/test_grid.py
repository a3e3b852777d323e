from pyspark.sql import functions as F

from markgrid.plans import grading as g
from markgrid.plans import grid


def test_columns_move_with_their_bars_and_bubbles_to_circles(spark):
    bubbles = spark.createDataFrame(
        [(1, q, 0, col, row, 100 + 155 * col, 300 + 20 * row, 155) for q, (col, row) in enumerate([(0, 0), (0, 1), (1, 0), (1, 1)], 1)],
        "sheet int, q int, choice_rank int, col_idx int, row_idx int, cx int, cy int, col_w int",
    )
    columns = spark.createDataFrame([(1, 0, 70, 226, True), (1, 1, 0, 0, False)], "sheet int, col_idx int, x0 int, x1 int, from_bar boolean")
    moved = grid.shifted(bubbles, columns)
    assert {r.q: r.cx for r in moved.collect()} == {1: 106, 2: 106, 3: 255, 4: 255}  # (70 + 226) / 2 - 141.5 = 6.5, to the even 6
    circles = spark.createDataFrame([(1, 110, 303), (1, 102, 303), (1, 106, 331), (1, 255, 333), (2, 255, 300), (1, 106, 332)], "sheet int, cx int, cy int")
    got = {r.q: (r.cx, r.cy, r.snapped) for r in grid.drawn_in(moved, circles, 12).collect()}
    # of two at one distance the leftmost; one at 11 is within reach, 13 is not; other sheets don't count
    assert got == {1: (102, 303, True), 2: (106, 331, True), 3: (255, 300, False), 4: (255, 320, False)}
    assert grid.drawn_in(moved, circles.limit(0), 12).where("snapped").count() == 0
    assert grid.drawn_in(moved.limit(0), circles, 12).count() == 0


def test_every_bubble_has_its_place(spark, sf_dir):
    rows = grid.assembled(spark, sf_dir)
    per = rows.groupBy("sheet", "col_idx", "choice_rank").agg(F.countDistinct("cx").alias("xs"))
    assert per.where("xs <> 1").count() == 0
    assert rows.groupBy("sheet", "q", "choice_rank").count().where("count <> 1").count() == 0


def test_precision_decides_on_a_bound(spark):
    """Of fills 0.8 and 0.52 the second is 0.65 of the first: not less in double precision, less in single."""
    marks = spark.createDataFrame([(1, 1, 0, 40), (1, 1, 1, 26)], "sheet long, q int, rank int, dark int")
    note = lambda policy: g.graded(marks, policy, 1).first().note
    assert (note(g.V3O), note(g.V3)) == ("ok", "double_mark")
