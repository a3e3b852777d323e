"""Queries over graded answers, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import LETTERS, nano
from ..operators import rollup
from ..sources.marks import DENSE_SQL, MASK, SPARSE_SQL, dense_marks, sparse_marks
from . import grading as g

SPINE, LONG_SPINE = 10, 100


def graded(policy):
    return lambda spark, d: g.graded(dense_marks(spark, d), policy, SPINE)


answers_v3o = graded(g.V3O)


def long_sheets(spark, d):
    return g.graded(sparse_marks(spark, d), g.V3O, LONG_SPINE)


def bubble_statuses(spark, d):
    rows = g.V3O.statuses(g.question_rows(dense_marks(spark, d)))
    items = [F.struct(F.lit(r).alias("rank"), F.col(f"f{r}").alias("fill"), F.when(F.col(f"s{r}"), "filled").when(F.col(f"b{r}"), "ambiguous").otherwise("empty").alias("status"), F.col(f"c{r}").alias("confidence")) for r in g.RANKS]
    return rows.select("sheet", "q", F.inline(F.array(*items))).where("fill IS NOT NULL")


def classify_fill_ratio(spark, d):
    return bubble_statuses(spark, d).select("sheet", "q", "rank", "fill", "status", nano(F.col("confidence")).alias("confidence_nano"))


def rel_ratio_filter(spark, d):
    """Filled bubbles that the comparison with the question's darkest makes empty."""
    top = F.greatest(*g.fills())
    items = [F.struct(F.lit(r).alias("rank"), f.alias("fill"), (f.cast("float").cast("double") < F.lit(0.65) * top.cast("float").cast("double")).alias("weak")) for r, f in enumerate(g.fills())]
    rows = g.question_rows(dense_marks(spark, d)).select("sheet", "q", top.alias("row_max"), F.inline(F.array(*items)))
    return rows.where("fill IS NOT NULL AND cast(cast(fill AS float) AS double) > 0.35D AND weak").select("sheet", "q", "rank", "fill", "row_max")


def classification_confidence(spark, d):
    return bubble_statuses(spark, d).groupBy("sheet").agg((F.sum(nano(F.col("confidence"))) / F.count("*") / F.lit(1e9)).alias("classification_confidence"), F.count("*").alias("n_bubbles"))


def status_counts(spark, d):
    is_ = lambda s: F.count_if(F.col("status") == s)
    return bubble_statuses(spark, d).groupBy("sheet").agg(is_("filled").alias("filled"), is_("ambiguous").alias("ambiguous"), is_("empty").alias("empty"))


def confidence_avg_answered(spark, d):
    value = F.when(F.col("choice").isNotNull(), nano(F.col("fill")))
    return answers_v3o(spark, d).groupBy("sheet").agg(F.coalesce(F.sum(value) / F.count(value) / F.lit(1e9), F.lit(0.0)).alias("confidence_avg"))


def top2_fills(spark, d):
    """The two darkest bubbles of each question; the first rank wins ties."""
    pairs = F.array_compact(F.array(*[F.when(f.isNotNull(), F.struct((-f).alias("minus"), F.lit(r).alias("rank"))) for r, f in enumerate(g.fills())]))
    best = F.slice(F.array_sort(pairs), 1, 2)
    rows = g.question_rows(dense_marks(spark, d)).select("sheet", "q", best.alias("b"))
    letter = lambda i: F.get(F.array(*map(F.lit, LETTERS)), F.get("b", i)["rank"])
    return rows.select("sheet", "q", letter(0).alias("first"), (-F.get("b", 0)["minus"]).alias("first_fill"), letter(1).alias("second"), (-F.get("b", 1)["minus"]).alias("second_fill"))


def dump_double_marked(spark, d):
    return answers_v3o(spark, d).where("note = 'double_mark'").select("sheet", "q", "choice", "all_filled", "fill")


def row_stats_adjusted(spark, d):
    """Per question: darkest, second darkest and palest fill, and the darkest less the palest."""
    fs = g.fills()
    rows = g.question_rows(dense_marks(spark, d))
    return rows.select("sheet", "q", F.greatest(*fs).alias("row_max"), F.least(*fs).alias("row_min"), g.second(fs).alias("row_second"), (F.greatest(*fs) - F.least(*fs)).alias("adjusted_max"), g.count([f.isNotNull() for f in fs]).alias("n_choices"))


def candidate_union(spark, d):
    """Absolute hits and the relative ones near the best of them, as letters."""
    fs = g.fills()
    sure = [f >= 0.35 for f in fs]
    primary = F.greatest(*[F.when(s, f) for s, f in zip(sure, fs)])
    extra = [(f >= 0.28) & ~s & (f >= primary * 0.7) for s, f in zip(sure, fs)]
    rows = g.question_rows(dense_marks(spark, d))
    return rows.select("sheet", "q", g.letters(sure).alias("absolute"), g.letters(extra).alias("extra"), F.concat(g.letters(sure), g.letters(extra)).alias("candidates"))


def blank_runs(spark, d):
    return rollup.blank_runs(long_sheets(spark, d))


def sheet_rollup(spark, d):
    return rollup.sheet_rollup(g.graded(dense_marks(spark, d), g.V3O, 7))


QUERIES = {
    "answers_v3o": answers_v3o,
    "answers_v3": graded(g.V3),
    "answers_v2": graded(g.V2),
    "answers_s8": graded(g.S8),
    "answers_v1": graded(g.V1),
    "answers_v0": graded(g.V0),
    "classify_fill_ratio": classify_fill_ratio,
    "rel_ratio_filter": rel_ratio_filter,
    "classification_confidence": classification_confidence,
    "status_counts": status_counts,
    "confidence_avg_answered": confidence_avg_answered,
    "top2_fills": top2_fills,
    "dump_double_marked": dump_double_marked,
    "row_stats_adjusted": row_stats_adjusted,
    "candidate_union": candidate_union,
    "sheet_rollup": sheet_rollup,
    "blank_runs": blank_runs,
    "answer_map": lambda s, d: rollup.answer_map(answers_v3o(s, d)),
    "answer_pivot10": lambda s, d: rollup.answer_pivot(answers_v3o(s, d)),
    "flag_strings": lambda s, d: rollup.flag_strings(answers_v3o(s, d)),
    "issue_list": lambda s, d: rollup.issues(QUERIES["answers_v0"](s, d)),
}

# SQL works on one row a bubble, with windows and grouped lists: another shape than the Spark plans.
_LETTER = "substr('ABCDE', rank + 1, 1)"


def _bubbles(source: str = DENSE_SQL) -> str:
    return f"b AS (SELECT sheet, q, rank, max(dark)::DOUBLE / {MASK}::DOUBLE AS f FROM ({source}) GROUP BY sheet, q, rank)"


def _spine(n: int) -> str:
    return f"spine AS (SELECT sheet, q FROM (SELECT DISTINCT sheet FROM b WHERE q BETWEEN 1 AND {n}), (SELECT unnest(range(1, {n} + 1))::INT AS q))"


_NANO = "floor(({x}) * 1e9 + 0.5)::BIGINT"
_STATUS = """x AS (SELECT *, f::FLOAT::DOUBLE AS g, max(f::FLOAT::DOUBLE) OVER (PARTITION BY sheet, q) AS top FROM b),
st AS (SELECT sheet, q, rank, f,
  CASE WHEN g > 0.35::DOUBLE AND g < 0.65::DOUBLE * top THEN 'empty' WHEN g > 0.35::DOUBLE THEN 'filled' WHEN g >= 0.18::DOUBLE AND g <= 0.55::DOUBLE THEN 'ambiguous' ELSE 'empty' END AS status,
  CASE WHEN g > 0.35::DOUBLE AND g < 0.65::DOUBLE * top THEN greatest(0::DOUBLE, least(1::DOUBLE, 1 - g))
    WHEN g > 0.35::DOUBLE THEN greatest(0.5::DOUBLE, least(1::DOUBLE, (g - 0.35::DOUBLE) / (1::DOUBLE - 0.35::DOUBLE + 1e-6::DOUBLE) + 0.5::DOUBLE))
    WHEN g >= 0.18::DOUBLE THEN greatest(0::DOUBLE, least(1::DOUBLE, 1 - abs(g - (0.18::DOUBLE + 0.55::DOUBLE) / 2) / ((0.55::DOUBLE - 0.18::DOUBLE) / 2 + 1e-6::DOUBLE)))
    ELSE greatest(0::DOUBLE, least(1::DOUBLE, 1 - g / (0.18::DOUBLE + 1e-6::DOUBLE))) END AS conf FROM x)"""


def _v3o(n: int, source: str = DENSE_SQL) -> str:
    return f"""{_bubbles(source)}, {_spine(n)}, {_STATUS},
qs AS (SELECT sheet, q, count(*) FILTER (status = 'filled') AS nf, count(*) FILTER (status = 'ambiguous') AS na,
  string_agg({_LETTER}, '' ORDER BY rank) FILTER (status = 'filled') AS lf, string_agg({_LETTER}, '' ORDER BY rank) FILTER (status = 'ambiguous') AS la,
  first({_LETTER} ORDER BY f DESC, rank) FILTER (status = 'filled') AS best,
  sum({_NANO.format(x="f")})::DOUBLE / count(*) / 1e9::DOUBLE AS fill, sum({_NANO.format(x="conf")})::DOUBLE / count(*) / 1e9::DOUBLE AS confidence FROM st GROUP BY sheet, q),
answers AS (SELECT spine.sheet, spine.q, CASE WHEN nf > 0 THEN best WHEN na = 1 THEN la END AS choice,
  CASE WHEN nf > 1 THEN 'double_mark' WHEN nf = 1 THEN 'ok' WHEN na = 1 THEN 'ambiguous' ELSE 'blank' END AS note,
  CASE WHEN nf > 0 THEN lf WHEN na = 1 THEN la ELSE '' END AS all_filled, coalesce(fill, 0::DOUBLE) AS fill, coalesce(confidence, 0::DOUBLE) AS confidence
  FROM spine LEFT JOIN qs USING (sheet, q))"""


def _tiered(p: g.Tiered, source: str = DENSE_SQL, detected: bool = False) -> str:
    """detected: source has conf and filled (a detector's verdict) as well."""
    adj = "f - min(f) OVER w" if p.background else "f"
    sure2 = f"a >= prim * {p.double}::DOUBLE" if p.background else "true"
    flat = " OR d2 < 1e-6::DOUBLE" if p.background else ""
    ok = f"pick AND f > {p.status}::DOUBLE" if p.status is not None else "false"
    bubbles, hits, only, conf = _bubbles(f"SELECT * FROM ({source}) WHERE rank < {p.choices}"), "", "false", "''"
    if detected:
        dark = f"CASE WHEN y >= {p.trusted}::DOUBLE THEN z ELSE f > {p.status}::DOUBLE END"
        best = "ORDER BY conf DESC, filled DESC"
        bubbles = f"b AS (SELECT sheet, q, rank, max(dark)::DOUBLE / {MASK}::DOUBLE AS f, first(conf {best}) AS y, first(filled {best}) AS z FROM ({source}) WHERE rank < {p.choices} GROUP BY sheet, q, rank)"
        ok, hit = f"pick AND ({dark})", f"({dark}) AND y >= {p.last}::DOUBLE AND a = top AND a >= {p.signal}::DOUBLE"
        hits = f", count(*) FILTER ({hit}) AS nh, string_agg({_LETTER}, '' ORDER BY rank) FILTER ({hit}) AS lh, max(y) FILTER ({hit}) AS yh"
        only, conf = "n = 0 AND nh = 1", "printf('yolo_conf=%.2f', yh)"
    first = f"CASE WHEN {only} THEN lh WHEN" if detected else "CASE WHEN"
    return f"""WITH {bubbles}, bb AS (SELECT DISTINCT sheet FROM ({source}) WHERE q BETWEEN 1 AND {SPINE}),
spine AS (SELECT sheet, q FROM bb, (SELECT unnest(range(1, {SPINE} + 1))::INT AS q)),
a1 AS (SELECT *, {adj} AS a FROM b WINDOW w AS (PARTITION BY sheet, q)),
a2 AS (SELECT sheet, q, list(a ORDER BY rank) AS l, list_sum(list(a ORDER BY rank)) / count(*) AS mean, max(a) AS top, list_sort(list(a), 'DESC')[2] AS d2 FROM a1 GROUP BY sheet, q),
a3 AS (SELECT a1.*, mean, top, d2, a >= {p.filled}::DOUBLE AS s0, a >= mean + {p.margin}::DOUBLE AND a >= {p.signal}::DOUBLE AS rel FROM a1 JOIN a2 USING (sheet, q)),
a4 AS (SELECT *, max(CASE WHEN s0 THEN a END) OVER w AS prim, count(*) FILTER (rel) OVER w AS nrel, max(CASE WHEN rel THEN a END) OVER w AS rtop FROM a3 WINDOW w AS (PARTITION BY sheet, q)),
a5 AS (SELECT *, s0 AND {sure2} AS sure FROM a4),
a6 AS (SELECT *, coalesce(rel AND NOT sure AND a >= prim * {p.double}::DOUBLE, false) AS extra, count(*) FILTER (sure) OVER w AS nsure,
  row_number() OVER (PARTITION BY sheet, q ORDER BY rel DESC, a DESC, rank) AS rr, row_number() OVER (PARTITION BY sheet, q ORDER BY a DESC, rank) AS ar FROM a5 WINDOW w AS (PARTITION BY sheet, q)),
a7 AS (SELECT *, max(CASE WHEN rel AND rr = 2 THEN a END) OVER w AS rsec FROM a6 WINDOW w AS (PARTITION BY sheet, q)),
a8 AS (SELECT *, CASE WHEN nsure > 0 THEN sure OR extra WHEN nrel > 1 THEN CASE WHEN rsec >= rtop * {p.close}::DOUBLE THEN rel ELSE rel AND rr = 1 END WHEN nrel = 1 THEN rel
  ELSE top >= {p.signal}::DOUBLE AND (d2 IS NULL{flat} OR top >= d2 * {p.dominant}::DOUBLE) AND ar = 1 END AS pick FROM a7),
qs AS (SELECT sheet, q, count(*) FILTER (pick) AS n, count(*) FILTER ({ok}) AS nok, any_value(nsure) AS nsure, any_value(nrel) AS nrel,
  string_agg({_LETTER}, '' ORDER BY rank) FILTER (pick) AS lp, string_agg({_LETTER}, '' ORDER BY rank) FILTER ({ok}) AS lok, first({_LETTER} ORDER BY a DESC, rank) FILTER (pick) AS best{hits} FROM a8 GROUP BY sheet, q)
SELECT spine.sheet, spine.q, {first} n > 1 AND nok = 1 THEN lok WHEN n > 0 THEN best END AS choice,
  CASE WHEN n IS NULL THEN 'no_circles' WHEN {only} THEN {conf} WHEN n = 0 THEN 'unanswered' WHEN n = 1 THEN '' WHEN nok = 1 THEN 'yolo_resolved' ELSE 'double_mark' END AS note,
  CASE WHEN {only} THEN 'yolo' WHEN n IS NULL OR n = 0 THEN 'none' WHEN nsure > 0 THEN 'absolute' WHEN nrel > 0 OR {str(not p.background).lower()} THEN 'relative' ELSE 'dominant' END AS tier,
  {first} n > 1 AND nok = 1 THEN lok WHEN n > 0 THEN lp ELSE '' END AS all_filled FROM spine LEFT JOIN qs USING (sheet, q)"""


_V0 = f"""{_bubbles()}, {_spine(SPINE)},
qs AS (SELECT sheet, q, count(*) FILTER (f > 0.42::DOUBLE) AS n, max(f) AS top, first({_LETTER} ORDER BY f DESC, rank) AS best FROM b GROUP BY sheet, q),
answers AS (SELECT spine.sheet, spine.q, CASE WHEN n > 0 OR top > 0.42::DOUBLE * 0.72::DOUBLE THEN best END AS choice, coalesce(n > 1, false) AS double_mark,
  coalesce(n = 0 AND top > 0.42::DOUBLE * 0.72::DOUBLE, false) AS low_confidence FROM spine LEFT JOIN qs USING (sheet, q))"""
_LIST = "coalesce(string_agg('Q' || q, ',' ORDER BY q) FILTER ({x}), '')"

ORACLES = {
    "answers_v3o": f"WITH {_v3o(SPINE)} SELECT * FROM answers",
    "answers_v3": f"WITH {_v3o(SPINE)} SELECT * FROM answers".replace("::FLOAT::DOUBLE", ""),
    "answers_v2": f"""WITH {_bubbles()}, {_spine(SPINE)}, x AS (SELECT *, max(f) OVER (PARTITION BY sheet, q) AS top FROM b),
h AS (SELECT *, f >= 0.35::DOUBLE AND (top < 0.175::DOUBLE OR f >= 0.65::DOUBLE * top) AS hit FROM x),
qs AS (SELECT sheet, q, count(*) FILTER (hit) AS n, string_agg({_LETTER}, '' ORDER BY rank) FILTER (hit) AS l FROM h GROUP BY sheet, q)
SELECT spine.sheet, spine.q, substr(l, 1, 1) AS choice, CASE WHEN n IS NULL THEN 'no_circles' WHEN n = 0 THEN 'unanswered' WHEN n > 1 THEN 'double_mark' ELSE '' END AS note, coalesce(l, '') AS all_filled
FROM spine LEFT JOIN qs USING (sheet, q)""",
    "answers_s8": _tiered(g.S8),
    "answers_v1": _tiered(g.V1),
    "answers_v0": f"WITH {_V0} SELECT * FROM answers",
    "classify_fill_ratio": f"WITH {_bubbles()}, {_STATUS} SELECT sheet, q, rank, f AS fill, status, {_NANO.format(x='conf')} AS confidence_nano FROM st",
    "rel_ratio_filter": f"""WITH {_bubbles()}, x AS (SELECT *, max(f) OVER (PARTITION BY sheet, q) AS row_max FROM b)
SELECT sheet, q, rank, f AS fill, row_max FROM x WHERE f::FLOAT::DOUBLE > 0.35::DOUBLE AND f::FLOAT::DOUBLE < 0.65::DOUBLE * row_max::FLOAT::DOUBLE""",
    "classification_confidence": f"WITH {_bubbles()}, {_STATUS} SELECT sheet, sum({_NANO.format(x='conf')})::DOUBLE / count(*) / 1e9::DOUBLE AS classification_confidence, count(*) AS n_bubbles FROM st GROUP BY sheet",
    "status_counts": f"WITH {_bubbles()}, {_STATUS} SELECT sheet, count(*) FILTER (status = 'filled') AS filled, count(*) FILTER (status = 'ambiguous') AS ambiguous, count(*) FILTER (status = 'empty') AS empty FROM st GROUP BY sheet",
    "confidence_avg_answered": f"WITH {_v3o(SPINE)} SELECT sheet, coalesce(sum({_NANO.format(x='fill')}) FILTER (choice IS NOT NULL)::DOUBLE / count(*) FILTER (choice IS NOT NULL) / 1e9::DOUBLE, 0::DOUBLE) AS confidence_avg FROM answers GROUP BY sheet",
    "top2_fills": f"""WITH {_bubbles()}, r AS (SELECT *, row_number() OVER (PARTITION BY sheet, q ORDER BY f DESC, rank) AS n FROM b)
SELECT sheet, q, max(CASE WHEN n = 1 THEN {_LETTER} END) AS first, max(CASE WHEN n = 1 THEN f END) AS first_fill, max(CASE WHEN n = 2 THEN {_LETTER} END) AS second, max(CASE WHEN n = 2 THEN f END) AS second_fill
FROM r GROUP BY sheet, q""",
    "dump_double_marked": f"WITH {_v3o(SPINE)} SELECT sheet, q, choice, all_filled, fill FROM answers WHERE note = 'double_mark'",
    "row_stats_adjusted": f"WITH {_bubbles()} SELECT sheet, q, max(f) AS row_max, min(f) AS row_min, list_sort(list(f), 'DESC')[2] AS row_second, max(f) - min(f) AS adjusted_max, count(*)::INT AS n_choices FROM b GROUP BY sheet, q",
    "candidate_union": f"""WITH {_bubbles()}, x AS (SELECT *, max(CASE WHEN f >= 0.35::DOUBLE THEN f END) OVER (PARTITION BY sheet, q) AS prim FROM b),
y AS (SELECT *, f >= 0.35::DOUBLE AS s, coalesce(f >= 0.28::DOUBLE AND f < 0.35::DOUBLE AND f >= prim * 0.7::DOUBLE, false) AS e FROM x),
z AS (SELECT sheet, q, coalesce(string_agg({_LETTER}, '' ORDER BY rank) FILTER (s), '') AS absolute, coalesce(string_agg({_LETTER}, '' ORDER BY rank) FILTER (e), '') AS extra FROM y GROUP BY sheet, q)
SELECT *, absolute || extra AS candidates FROM z""",
    "sheet_rollup": f"""WITH {_v3o(7)} SELECT sheet, count(*) AS questions, count(choice) AS answered, {_LIST.format(x="choice IS NULL")} AS unanswered, {_LIST.format(x="note = 'double_mark'")} AS double_marked,
{_LIST.format(x="note = 'ambiguous'")} AS ambiguous, count(*) FILTER (choice IS NULL OR note = 'double_mark') = 0 AS valid FROM answers GROUP BY sheet""",
    "blank_runs": f"""WITH {_v3o(LONG_SPINE, SPARSE_SQL)}, l AS (SELECT sheet, q, choice, max(CASE WHEN choice IS NOT NULL THEN q END) OVER (PARTITION BY sheet ORDER BY q) AS last_answered FROM answers)
SELECT sheet, q, (q - coalesce(last_answered, 0))::INT AS run, 'blank_run_ends_at_Q' || q AS flag FROM l WHERE choice IS NULL AND q - coalesce(last_answered, 0) >= 10""",
    "answer_map": f"""WITH {_v3o(SPINE)} SELECT sheet, '{{' || string_agg('"' || q || '":' || coalesce('"' || choice || '"', 'null'), ',' ORDER BY q) || '}}' AS answers FROM answers GROUP BY sheet""",
    "answer_pivot10": f"WITH {_v3o(SPINE)} SELECT sheet, ((q - 1) // 10)::INT AS decade, " + ", ".join(f"coalesce(max(CASE WHEN (q - 1) % 10 = {i} THEN choice END), '-') AS c{i}" for i in range(10)) + " FROM answers GROUP BY sheet, decade",
    "flag_strings": f"""WITH {_v3o(SPINE)} SELECT sheet, q, CASE WHEN choice IS NULL THEN 'EMPTY_Q' ELSE 'MULTIPLE_Q' END || q AS flag FROM answers WHERE choice IS NULL OR note = 'double_mark'""",
    "issue_list": f"""WITH {_V0}, r AS (SELECT sheet, {_LIST.format(x="choice IS NULL")} AS u, {_LIST.format(x="low_confidence")} AS l FROM answers GROUP BY sheet)
SELECT sheet, u = '' AND l = '' AS valid, concat_ws('; ', CASE WHEN u <> '' THEN 'unanswered questions: ' || u END, CASE WHEN l <> '' THEN 'low-confidence answers: ' || l END) AS issues FROM r""",
}
