"""Grading policies against the truth tables of their definitions."""

import pytest

from markgrid.plans import grading as g

# fills of options A..E; choice, note or tier, and marked letters of a double mark, by policy
TABLE = [
    ((0.90, 0.10, 0.10, 0.10, 0.10), "A ok", "A", "A absolute", "A absolute"),
    ((0.10, 0.90, 0.50, 0.10, 0.10), "B ok", "B", "B absolute", "B double_mark BC"),
    ((0.10, 0.90, 0.60, 0.10, 0.10), "B double_mark BC", "B double_mark BC", "B absolute", "B double_mark BC"),
    ((0.80, 0.10, 0.80, 0.10, 0.10), "A double_mark AC", "A double_mark AC", "A double_mark AC", "A double_mark AC"),
    ((0.50, 0.90, 0.90, 0.10, 0.10), "B double_mark BC", "B double_mark BC", "B double_mark BC", "B double_mark ABC"),
    ((0.70, 0.90, 0.10, 0.10, 0.10), "B double_mark AB", "A double_mark AB", "B double_mark AB", "B double_mark AB"),
    ((0.35, 0.05, 0.05, 0.05, 0.05), "A ambiguous", "A", "A relative", "A relative"),
    ((0.30, 0.25, 0.05, 0.05, 0.05), "- blank", "- unanswered", "A relative", "A relative"),
    ((0.25, 0.05, 0.05, 0.05, 0.05), "A ambiguous", "- unanswered", "A relative", "- unanswered"),
    ((0.40, 0.30, 0.05, 0.05, 0.05), "A ok", "A", "A yolo_resolved", "A double_mark AB"),
    ((0.38, 0.37, 0.36, 0.36, 0.36), "A double_mark ABCDE", "A double_mark ABCDE", "- unanswered", "- unanswered"),
    ((0.00, 0.00, 0.00, 0.00, 0.00), "- blank", "- unanswered", "- unanswered", "- unanswered"),
    ((0.55, 0.50, 0.52, 0.10, 0.10), "A double_mark ABC", "A double_mark ABC", "A double_mark ABC", "A double_mark ABC"),
    ((0.30, 0.14, 0.14, 0.14, 0.10), "A ambiguous", "- unanswered", "- unanswered", "A relative"),
]


@pytest.mark.parametrize("at,policy", [(1, g.V3O), (2, g.V2), (3, g.S8), (4, g.V1)])
def test_truth_table(spark, at, policy):
    rows = spark.createDataFrame([(1, i, *t[0]) for i, t in enumerate(TABLE)], "sheet long, q int, " + ", ".join(f"f{r} double" for r in g.RANKS))
    for r in policy.grade(rows).collect():
        text = r.note or (r.tier if "tier" in r else "")
        got = " ".join(x for x in (r.choice or "-", text, r.all_filled if r.note == "double_mark" else "") if x)
        assert got == TABLE[r.q][at], (r.q, got)


def test_spine_fills_missing_questions_and_drops_others(spark):
    marks = spark.createDataFrame([(1, 2, 0, 50), (1, 9, 1, 50), (2, 1, 3, 20)], "sheet long, q int, rank int, dark int")
    got = {(r.sheet, r.q): (r.choice, r.note) for r in g.graded(marks, g.V3O, 3).collect()}
    assert got == {(1, 1): (None, "blank"), (1, 2): ("A", "ok"), (1, 3): (None, "blank"), (2, 1): ("D", "ok"), (2, 2): (None, "blank"), (2, 3): (None, "blank")}


def test_blank_runs_emit_every_question_from_the_tenth(spark):
    from markgrid.operators.rollup import blank_runs

    answers = spark.createDataFrame([(1, q, "A" if q <= 8 else None) for q in range(1, 21)], "sheet long, q int, choice string")
    assert sorted((r.q, r.run) for r in blank_runs(answers).collect()) == [(18, 10), (19, 11), (20, 12)]


def test_a_detector_confirms_and_resolves(spark):
    marks = [(1, q, r, d) for q, ds in enumerate([(10, 10, 12, 0, 0), (14, 13, 2, 2, 2), (14, 13, 2, 2, 2), (40, 38, 0, 0, 0), (40, 38, 0, 0, 0)], 1) for r, d in enumerate(ds)]
    seen = [(1, 1, 2, 0.31, True), (1, 2, 0, 0.42, True), (1, 3, 0, 0.29, True), (1, 4, 0, 0.9, False), (1, 5, 0, 0.2, False), (1, 9, 0, 0.9, True)]
    rows = g.detected_rows(spark.createDataFrame(marks, "sheet long, q int, rank int, dark int"), spark.createDataFrame(seen, "sheet long, q int, rank int, conf double, filled boolean"))
    got = {r.q: (r.choice, r.note, r.tier, r.all_filled) for r in g.with_spine(g.S8.grade(rows, detected=True), 9, g.S8.blank).collect()}
    assert got[1] == ("C", "yolo_conf=0.31", "yolo", "C")
    assert got[2] == got[3] == ("A", "yolo_resolved", "relative", "A")
    assert got[4] == ("B", "yolo_resolved", "absolute", "B")  # trusted verdict: A isn't filled
    assert got[5] == ("A", "double_mark", "absolute", "AB")  # verdict too weak: fills decide
    assert got[9] == (None, "no_circles", "none", "")  # a detection without a bubble


def test_a_classifier_asks_for_review(spark):
    cases = [((0.9, 0.1), (0.0, 0.5), "A", "ambiguous_review"), ((0.69, 0.1), (0.5, 0.0), None, "ambiguous_review"), ((0.7, 0.1), (0.3, 0.4), "A", ""), ((0.8, 0.8), (0.1, 0.1), "A", "double_mark"), ((0.5, 0.1), (0.4, 0.1), None, "unanswered")]
    rows = spark.createDataFrame([(1, q, *[x for r in g.RANKS for x in ((p[r], u[r]) if r < 2 else (None, None))]) for q, (p, u, _, _) in enumerate(cases)], "sheet long, q int, " + ", ".join(f"p{r} double, u{r} double" for r in g.RANKS))
    got = {r.q: (r.choice, r.note) for r in g.V2_MODEL.grade(rows).collect()}
    assert got == {q: c[2:] for q, c in enumerate(cases)}
