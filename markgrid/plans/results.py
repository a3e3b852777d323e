"""Queries that join answers with dimensions, other detections and lookups, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.columns import LETTERS, choice_label
from ..operators import rollup
from ..sources.marks import CIRCLES_SQL, circles, dense_marks, read
from . import answers as a


def sheet_results(spark, d):
    """The result row of each sheet, with its student and exam."""
    sheets = read(spark, d, "orders").select(F.col("o_orderkey").alias("sheet"), "o_custkey", F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyy-MM-dd").alias("scanned"))
    students = read(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("student"), "c_nationkey")
    nations = read(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("nation"))
    rolled = rollup.sheet_rollup(a.answers_v3o(spark, d)).select("sheet", "answered", "double_marked", "valid")
    joined = rolled.join(sheets, "sheet").join(students, "o_custkey").join(F.broadcast(nations), "c_nationkey")  # 25 nations
    return joined.select("sheet", "student", "nation", "scanned", "answered", "double_marked", "valid")


def predictions_with_details(spark, d):
    """Bubbles joined with their predictions by (sheet, question, option), and by option letter with the answer."""
    marks = dense_marks(spark, d).groupBy("sheet", "q", "rank").agg(F.max("dark").alias("dark"), F.count("*").alias("marks"))
    status = a.bubble_statuses(spark, d).select("sheet", "q", F.col("rank").cast("int").alias("rank"), "status")
    joined = marks.join(status, ["sheet", "q", "rank"])
    return joined.select("sheet", "q", choice_label(F.col("rank")).alias("option"), "dark", "marks", "status")


def enriched_circles(spark, d):
    """Circles with the fill that a second table has for their place, 0 without."""
    c = circles(spark, d)
    known = c.where("dark > 25").groupBy("cx", "cy").agg(F.max("fill").alias("known"))
    places = c.groupBy("cx", "cy").agg(F.count("*").alias("n"))
    return places.join(known, ["cx", "cy"], "left").select("cx", "cy", "n", F.coalesce("known", F.lit(0)).alias("fill"))


def decoded_union(spark, d):
    """Codes of each sheet from two decoders, in order, each once."""
    lines = read(spark, d, "lineitem")
    order = F.struct("l_linenumber", "l_partkey", "l_suppkey")
    one = F.transform(F.sort_array(F.collect_list(F.when(F.col("l_linenumber") <= 3, F.struct(order.alias("o"), (F.col("l_suppkey") % 20).alias("c"))))), lambda x: x["c"])
    two = F.transform(F.sort_array(F.collect_list(F.when(F.col("l_linenumber") >= 3, F.struct(order.alias("o"), (F.col("l_suppkey") % 20).alias("c"))))), lambda x: x["c"])
    codes = F.array_distinct(F.concat(one, two))  # a sheet has a bounded number of lines
    return lines.groupBy(F.col("l_orderkey").alias("sheet")).agg(F.array_join(F.transform(codes, lambda x: x.cast("string")), ",").alias("codes"))


def column_union(spark, d):
    """Column edges from bars and from a static layout: the mean where both have a column, else the one there is."""
    c = circles(spark, d).withColumns({"page": F.col("sheet"), "col_idx": F.floor(F.col("cx") / 188).cast("int")})
    edge = lambda flag, name: c.where(flag).groupBy("page", "col_idx").agg(F.min("cx").alias(name))
    both = edge("dark >= 25", "bar").join(edge("dark < 25", "static"), ["page", "col_idx"], "full")
    middle = F.when(F.col("bar").isNotNull() & F.col("static").isNotNull(), (F.col("bar") + F.col("static")) / 2).otherwise(F.coalesce("bar", "static").cast("double"))
    return both.select("page", "col_idx", middle.alias("x0"), F.col("bar").isNotNull().alias("from_bar"))


def replaced_regions(spark, d):
    """Detections of a page with those of one kind replaced by another source's, counted by kind and source."""
    c = circles(spark, d).withColumns({"page": F.col("sheet"), "kind": F.when(F.col("dark") % 3 == 0, "answers").otherwise("codes")})
    model = c.where("dark > 20").select("page", "kind", F.lit("model").alias("source"))
    static = c.where("dark <= 20 AND kind = 'answers'").select("page", "kind", F.lit("static").alias("source"))
    return model.where("kind <> 'answers'").unionByName(static).groupBy("page", "kind", "source").agg(F.count("*").alias("n"))


def projection_profile(spark, d):
    """Dark marks by row position and column, and the largest column's count scaled by the columns."""
    by_col = circles(spark, d).where("dark > 30").groupBy("cy", F.floor(F.col("cx") / 188).cast("int").alias("col_idx")).agg(F.count("*").alias("n"))
    return by_col.groupBy("cy").agg(F.max("n").alias("largest"), F.sum("n").alias("total"), F.count("*").alias("columns"))


def run_ids(spark, d):
    """A run id for each event: its time and eight hexadecimal digits."""
    tail = F.substring(F.md5(F.col("event_id").cast("string").cast("binary")), 1, 8)
    return read(spark, d, "events").select("event_id", F.concat_ws("_", F.date_format(F.col("ts").cast("timestamp"), "yyyyMMdd_HHmmss"), tail).alias("run_id"))


def seeded_sample(spark, d):
    """A reproducible tenth of the documents: the smallest hashes of seed and id in each language."""
    docs = read(spark, d, "documents").select("doc_id", "lang", F.md5(F.concat(F.lit("7:"), F.col("doc_id").cast("string")).cast("binary")).alias("place"))
    return docs.where(F.substring("place", 1, 2) < "1a").select("doc_id", "lang", "place")


def answer_distribution(spark, d):
    """Answers by question and choice, with each choice's place among them."""
    n = a.answers_v3o(spark, d).where("choice IS NOT NULL").groupBy("q", "choice").agg(F.count("*").alias("n"))
    order = Window.partitionBy("q").orderBy(F.desc("n"), "choice")
    return n.withColumn("place", F.row_number().over(order))


QUERIES = {f.__name__: f for f in (sheet_results, predictions_with_details, enriched_circles, decoded_union, column_union, replaced_regions, projection_profile, run_ids, seeded_sample, answer_distribution)}

_C = f"c AS ({CIRCLES_SQL})"
ORACLES = {
    "sheet_results": f"""WITH {a._v3o(a.SPINE)}, r AS (SELECT sheet, count(choice) AS answered, {a._LIST.format(x="note = 'double_mark'")} AS double_marked, count(*) FILTER (choice IS NULL OR note = 'double_mark') = 0 AS valid FROM answers GROUP BY sheet)
SELECT sheet, c_name AS student, n_name AS nation, strftime(o_orderdate, '%Y-%m-%d') AS scanned, answered, double_marked, valid FROM r JOIN orders ON o_orderkey = sheet JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey""",
    "predictions_with_details": f"""WITH {a._bubbles()}, {a._STATUS}, m AS (SELECT sheet, q, rank, max(dark) AS dark, count(*) AS marks FROM ({a.DENSE_SQL}) GROUP BY 1, 2, 3)
SELECT sheet, q, substr('{"".join(LETTERS)}', rank + 1, 1) AS option, dark, marks, status FROM m JOIN st USING (sheet, q, rank)""",
    "enriched_circles": f"WITH {_C} SELECT cx, cy, count(*) AS n, coalesce(max(fill) FILTER (dark > 25), 0) AS fill FROM c GROUP BY cx, cy",
    "decoded_union": """WITH l AS (SELECT l_orderkey AS sheet, l_suppkey % 20 AS c, l_linenumber, l_partkey, l_suppkey FROM lineitem), u AS (SELECT *, 0 AS d FROM l WHERE l_linenumber <= 3 UNION ALL SELECT *, 1 FROM l WHERE l_linenumber >= 3),
o AS (SELECT sheet, c, row_number() OVER (PARTITION BY sheet ORDER BY d, l_linenumber, l_partkey, l_suppkey) AS i FROM u), f AS (SELECT sheet, c, min(i) AS i FROM o GROUP BY sheet, c) SELECT sheet, string_agg(c, ',' ORDER BY i) AS codes FROM f GROUP BY sheet""",
    "column_union": f"""WITH {_C}, g AS (SELECT sheet AS page, cx // 188 AS col_idx, min(cx) FILTER (dark >= 25) AS bar, min(cx) FILTER (dark < 25) AS static FROM c GROUP BY 1, 2)
SELECT page, col_idx, CASE WHEN bar IS NOT NULL AND static IS NOT NULL THEN (bar + static) / 2::DOUBLE ELSE coalesce(bar, static)::DOUBLE END AS x0, bar IS NOT NULL AS from_bar FROM g WHERE bar IS NOT NULL OR static IS NOT NULL""",
    "replaced_regions": f"""WITH {_C}, k AS (SELECT sheet AS page, CASE WHEN dark % 3 = 0 THEN 'answers' ELSE 'codes' END AS kind, CASE WHEN dark > 20 THEN 'model' ELSE 'static' END AS source FROM c)
SELECT page, kind, source, count(*) AS n FROM k WHERE (kind = 'answers') = (source = 'static') GROUP BY ALL""",
    "projection_profile": f"WITH {_C}, g AS (SELECT cy, cx // 188 AS k, count(*) AS n FROM c WHERE dark > 30 GROUP BY 1, 2) SELECT cy, max(n) AS largest, sum(n)::BIGINT AS total, count(*) AS columns FROM g GROUP BY cy",
    "run_ids": "SELECT event_id, strftime(ts, '%Y%m%d_%H%M%S') || '_' || substr(md5(event_id::VARCHAR), 1, 8) AS run_id FROM events",
    "seeded_sample": "SELECT doc_id, lang, md5('7:' || doc_id) AS place FROM documents WHERE substr(md5('7:' || doc_id), 1, 2) < '1a'",
    "answer_distribution": f"WITH {a._v3o(a.SPINE)}, n AS (SELECT q, choice, count(*) AS n FROM answers WHERE choice IS NOT NULL GROUP BY 1, 2) SELECT *, row_number() OVER (PARTITION BY q ORDER BY n DESC, choice)::INT AS place FROM n",
}
