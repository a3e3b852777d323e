"""Queries over a second detector's and a classifier's verdicts, evaluations and summaries, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import ARABIC, LETTERS, choice_label
from ..operators import codes as ops
from ..operators import rollup
from ..sources.marks import CIRCLES_SQL, DENSE_SQL, circles, dense_marks, read
from . import answers as a
from . import grading as g

#: Left edges and widths of the four answer columns of a page of 750 pixels.
COLUMNS = ((0, 188), (188, 188), (376, 188), (564, 186))
TYPES = {"AB": "two", "ABC": "three", "ABCD": "four"}


def joint_sheets(spark, d):
    """Order lines as bubbles (sheet, q, rank) of sheets that four orders share."""
    place = {"sheet": F.floor(F.col("l_orderkey") / 4).cast("long"), "q": F.col("l_linenumber"), "rank": (F.col("l_suppkey") % 5).cast("int")}
    return read(spark, d, "lineitem").withColumns(place)


def answers_s8_detector(spark, d):
    """s8 on faint marks, with a detector's verdict on two bubbles in three."""
    lines = joint_sheets(spark, d)
    marks = lines.withColumn("dark", F.floor(F.col("l_quantity") / 2).cast("int"))
    detections = lines.where("l_returnflag <> 'N'").select("sheet", "q", "rank", (F.col("l_partkey") % 101 / 100).alias("conf"), (F.col("l_returnflag") == "R").alias("filled"))
    return g.with_spine(g.S8.grade(g.detected_rows(marks, detections), detected=True), a.SPINE, g.S8.blank)


def answers_v2_model(spark, d):
    """v2 with a classifier's probabilities of filled and ambiguous, per bubble the surest reading."""
    p = F.col("l_partkey") % 101
    read_ = F.struct((p / 100).alias("p"), (F.least(100 - p, F.col("l_suppkey") * 7 % 101) / 100).alias("u"))
    rows = joint_sheets(spark, d).withColumn("m", read_).groupBy("sheet", "q").agg(*[F.max(F.when(F.col("rank") == r, F.col("m"))).alias(f"m{r}") for r in g.RANKS])
    rows = rows.select("sheet", "q", *[F.col(f"m{r}.{c}").alias(f"{c}{r}") for r in g.RANKS for c in ("p", "u")])
    return g.with_spine(g.V2_MODEL.grade(rows), a.SPINE, g.V2_MODEL.blank)


def class_evaluation(spark, d):
    """Accuracy and weighted loss of a three-class scorer: sums of every third number of each vector."""
    score = lambda c: F.aggregate(F.filter("embedding", lambda x, i: i % 3 == c), F.lit(0).cast("long"), lambda s, x: s + F.floor(x.cast("double") * 1e6 + 0.5)) / F.lit(1e6)
    rows = read(spark, d, "embeddings").select((F.col("label") % 3).cast("int").alias("truth"), *[score(c).alias(f"s{c}") for c in range(3)])
    probs, best = ops.softmax([F.col(f"s{c}") for c in range(3)])
    loss = F.floor(-F.ln(F.get(F.array(*probs), F.col("truth"))) * 1e6 + 0.5).cast("long")
    return ops.evaluation(rows.select("truth", best.alias("seen"), loss.alias("loss")), "truth", "seen", "loss")


def code_grid_decode(spark, d):
    """A four-digit code per sheet from circles: nearest of ten rows, nearest column, darkest digit."""
    found = circles(spark, d).select("sheet", "cx", "cy", (F.col("dark") / 50).alias("fill"))
    return ops.decode_digits(ops.code_cells(found, 1060, [x + w / 2 for x, w in COLUMNS]), ["sheet"], len(COLUMNS))


def answer_map_read(spark, d):
    """Answers read back from their JSON object."""
    return rollup.answers_of_map(rollup.answer_map(a.answers_v3o(spark, d)))


def question_types(spark, d):
    """Questions of each type, where the lines of an order override the default."""
    kind = F.element_at(F.array(*map(F.lit, TYPES)), (F.min("l_suppkey") % 3 + 1).cast("int"))
    overrides = read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("sheet"), F.col("l_linenumber").alias("q")).agg(kind.alias("type"))
    return rollup.type_summary(overrides, a.SPINE, "ABCD", TYPES)


def column_profile_max(spark, d):
    """Per block of a hundred sheets and row position, the darkest column's share of its width, times the mean width."""
    dark = circles(spark, d).where("dark > 30").withColumn("block", F.floor(F.col("sheet") / 100).cast("long"))
    share = [F.count_if(F.col("cx").between(x, x + w - 1)) / F.lit(float(w)) for x, w in COLUMNS]
    mean = sum(w for _, w in COLUMNS) / len(COLUMNS)
    return dark.groupBy("block", "cy").agg((F.greatest(*share) * F.lit(mean)).alias("combined"), F.count("*").alias("total"))


def choice_labels(spark, d):
    """Every marked bubble with its label in the language of its sheet."""
    lang = F.when(F.col("o_custkey") % 2 == 0, "ar").otherwise("en").alias("lang")
    sheets = read(spark, d, "orders").select(F.col("o_orderkey").alias("sheet"), lang)
    marks = dense_marks(spark, d).select("sheet", "q", (F.col("rank") + (F.col("q") == 7).cast("int")).alias("rank"), "dark")
    return marks.join(sheets, "sheet").select("sheet", "q", "rank", "dark", "lang", choice_label(F.col("rank"), F.col("lang")).alias("label"))


def mark_previews(spark, d):
    """The first five marked bubbles of each sheet, in order of question and rank."""
    label = F.concat(F.lit("Q"), F.col("q").cast("string"), choice_label(F.col("rank")))
    return rollup.previews(dense_marks(spark, d).select("sheet", "q", "rank", label.alias("label")).distinct(), 5)


QUERIES = {f.__name__: f for f in (answers_s8_detector, answers_v2_model, class_evaluation, code_grid_decode, answer_map_read, question_types, column_profile_max, choice_labels, mark_previews)}

_FAINT = """SELECT l_orderkey // 4 AS sheet, l_linenumber AS q, (l_suppkey % 5)::INT AS rank, floor(l_quantity / 2)::INT AS dark,
CASE WHEN l_returnflag <> 'N' THEN l_partkey % 101 / 100::DOUBLE END AS conf, CASE WHEN l_returnflag <> 'N' THEN l_returnflag = 'R' END AS filled FROM lineitem"""
_CENTRES = [x + w / 2 for x, w in COLUMNS]
_near = lambda c, at: f"list_position({{l}}, list_min({{l}}))".format(l=f"[{', '.join(f'abs({c} - {x}::DOUBLE)' for x in at)}]") + " - 1"
_labels = lambda letters: "[" + ", ".join(f"'{x}'" for x in letters) + "]"
ORACLES = {
    "answers_s8_detector": a._tiered(g.S8, _FAINT, True),
    "answers_v2_model": f"""WITH m AS (SELECT l_orderkey // 4 AS sheet, l_linenumber AS q, (l_suppkey % 5)::INT AS rank, l_partkey % 101 AS p, least(100 - l_partkey % 101, l_suppkey * 7 % 101) AS u FROM lineitem),
b AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY sheet, q, rank ORDER BY p DESC, u DESC) = 1), spine AS (SELECT sheet, q FROM (SELECT DISTINCT sheet FROM b WHERE q BETWEEN 1 AND {a.SPINE}), (SELECT unnest(range(1, {a.SPINE} + 1))::INT AS q)),
r AS (SELECT sheet, q, count(*) FILTER (p >= 70) AS n, count(*) FILTER (p < 70 AND u >= 50) AS m, first({a._LETTER} ORDER BY p DESC, rank) AS best, string_agg({a._LETTER}, '' ORDER BY rank) FILTER (p >= 70) AS l FROM b GROUP BY 1, 2)
SELECT sheet, q, CASE WHEN n > 0 THEN best END AS choice, CASE WHEN n IS NULL THEN 'no_circles' WHEN n > 1 THEN 'double_mark' WHEN m > 0 THEN 'ambiguous_review' WHEN n = 0 THEN 'unanswered' ELSE '' END AS note, coalesce(l, '') AS all_filled
FROM spine LEFT JOIN r USING (sheet, q)""",
    "class_evaluation": """WITH u AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings),
s AS (SELECT vec_id, any_value(label % 3) AS truth, coalesce(sum(floor(x * 1e6 + 0.5)) FILTER (i % 3 = 0), 0) / 1e6 AS a, coalesce(sum(floor(x * 1e6 + 0.5)) FILTER (i % 3 = 1), 0) / 1e6 AS b, coalesce(sum(floor(x * 1e6 + 0.5)) FILTER (i % 3 = 2), 0) / 1e6 AS c FROM u GROUP BY 1),
t AS (SELECT *, greatest(a, b, c) AS m FROM s), e AS (SELECT *, exp(a - m) AS ea, exp(b - m) AS eb, exp(c - m) AS ec FROM t),
p AS (SELECT truth, CASE WHEN a = m THEN 0 WHEN b = m THEN 1 ELSE 2 END AS seen, floor(-ln(CASE truth WHEN 0 THEN ea WHEN 1 THEN eb ELSE ec END / (ea + eb + ec)) * 1e6 + 0.5)::BIGINT AS loss FROM e),
k AS (SELECT truth, count(*) AS n, count(*) FILTER (truth = seen) AS r, sum(loss)::BIGINT AS loss FROM p GROUP BY 1)
SELECT sum(n)::BIGINT AS n, sum(r)::DOUBLE / sum(n)::DOUBLE AS accuracy, sum(floor(loss * 1000 / n)::BIGINT)::DOUBLE / count(*) / 1e9::DOUBLE AS weighted_loss FROM k""",
    "code_grid_decode": f"""WITH c AS (SELECT sheet, dark / 50 AS fill, {_near("cy", [(i + 0.5) * 106 for i in range(10)])} AS digit, {_near("cx", _CENTRES)} AS place FROM ({CIRCLES_SQL})),
k AS (SELECT sheet, place, CASE WHEN max(fill) > 0.2::DOUBLE THEN first(digit ORDER BY fill DESC, digit)::VARCHAR ELSE '?' END AS m FROM c GROUP BY 1, 2),
w AS (SELECT sheet, p, coalesce(max(CASE WHEN place = p THEN m END), '?') AS m FROM k, range(4) r(p) GROUP BY 1, 2) SELECT sheet, string_agg(m, '' ORDER BY p DESC) AS code FROM w GROUP BY 1""",
    "answer_map_read": f"WITH {a._v3o(a.SPINE)} SELECT sheet, q, choice FROM answers",
    "question_types": f"""WITH o AS (SELECT l_orderkey AS sheet, l_linenumber AS q, min(l_suppkey) % 3 AS k FROM lineitem GROUP BY 1, 2),
g AS (SELECT sheet, unnest(range(1, {a.SPINE} + 1)) AS q FROM (SELECT DISTINCT sheet FROM o)), t AS (SELECT g.sheet, coalesce(k, 2) AS k, count(*) AS n FROM g LEFT JOIN o USING (sheet, q) GROUP BY 1, 2)
SELECT sheet, string_agg(n || 'x' || ['two', 'three', 'four'][k + 1], ' | ' ORDER BY k) AS summary FROM t GROUP BY 1""",
    "column_profile_max": f"""WITH n AS (SELECT sheet // 100 AS block, cy, least(cx // 188, 3) AS k, count(*) AS n FROM ({CIRCLES_SQL}) WHERE dark > 30 GROUP BY 1, 2, 3)
SELECT block, cy, max(n::DOUBLE / CASE WHEN k = 3 THEN 186 ELSE 188 END::DOUBLE) * 187.5::DOUBLE AS combined, sum(n)::BIGINT AS total FROM n GROUP BY 1, 2""",
    "choice_labels": f"""WITH m AS (SELECT sheet, q, rank + CASE WHEN q = 7 THEN 1 ELSE 0 END AS rank, dark, CASE WHEN o_custkey % 2 = 0 THEN 'ar' ELSE 'en' END AS lang FROM ({DENSE_SQL}) JOIN orders ON o_orderkey = sheet)
SELECT *, coalesce(CASE lang WHEN 'ar' THEN {_labels(ARABIC)} ELSE {_labels(LETTERS)} END[rank + 1], '?') AS label FROM m""",
    "mark_previews": f"""WITH m AS (SELECT DISTINCT sheet, q, rank FROM ({DENSE_SQL})), r AS (SELECT *, row_number() OVER (PARTITION BY sheet ORDER BY q, rank) AS i FROM m)
SELECT sheet, count(*)::INT AS n, string_agg('Q' || q || {a._LETTER}, ',' ORDER BY i) FILTER (i <= 5) || CASE WHEN count(*) > 5 THEN ',...' ELSE '' END AS preview FROM r GROUP BY 1""",
}
