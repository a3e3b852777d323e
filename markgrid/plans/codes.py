"""Queries over codes, labels, requests and events, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import template_numbers
from ..operators import codes as ops
from ..operators import requests
from ..sources import templates as t
from ..sources.marks import CIRCLES_SQL, DENSE_SQL, circles, dense_marks, read


def qr_classify(spark, d):
    """Codes read on each sheet's lines: a student code on some, exam codes on the others."""
    code = F.when(F.col("l_suppkey") % 3 == 0, F.concat(F.lit("stu-"), F.col("l_partkey").cast("string"))).otherwise(F.concat(F.lit("EXAM-"), F.col("l_suppkey").cast("string")))
    at = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    return ops.roles(read(spark, d, "lineitem").select(F.col("l_orderkey").alias("sheet"), code.alias("code"), at.alias("at")), ["sheet"])


def noisy(spark, d):
    text = F.concat(F.lit("id: "), F.substring(F.lit("abcXYZ"), (F.col("l_linenumber") % 6 + 1).cast("int"), F.lit(1)), F.col("l_partkey") * 37 + 1000, F.lit("-"), F.col("l_suppkey"), F.lit(" end"))
    return read(spark, d, "lineitem").select(F.col("l_orderkey").alias("sheet"), F.col("l_linenumber").alias("q"), text.alias("text"))


def ocr_code_extract(spark, d):
    found = noisy(spark, d).withColumns(ops.extract_codes(F.col("text")))
    return found.select("sheet", "q", "code", "digits", F.col("code").rlike(r"^(?i:[A-Z]?\d{5,6})$").alias("is_student"))


def digit_grid_decode(spark, d):
    cells = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("sheet"), (F.col("l_linenumber") - 1).alias("place"), (F.col("l_suppkey") % 10).cast("int").alias("digit"), (F.col("l_quantity") / 50).alias("fill"))
    return ops.decode_digits(cells, ["sheet"], 7)


def template_id_parse(spark, d):
    """Template ids made from orders and read back; some are not template ids."""
    name = F.when(F.col("o_orderkey") % 7 == 0, F.concat(F.lit("sheet"), F.col("o_orderkey"))).otherwise(F.format_string("Q%d_%dch", F.col("o_orderkey") % 100 + 1, F.col("o_custkey") % 4 + 2))
    rows = read(spark, d, "orders").select("o_orderkey", name.alias("template"))
    q, c = template_numbers(F.col("template"))
    return rows.select("o_orderkey", "template", q.alias("n_questions"), c.alias("n_choices"))


def yolo_label_lines(spark, d):
    line = ops.box_line(F.when(F.col("dark") > 17, 0).otherwise(1), F.col("cx") - F.col("r"), F.col("cy") - F.col("r"), F.col("cx") + F.col("r"), F.col("cy") + F.col("r"), 750, 1060)
    return circles(spark, d).select("sheet", "q", line.alias("line")).groupBy("sheet", "q", "line").agg(F.count("*").alias("n"))


def softmax_argmax(spark, d):
    """Class probabilities of the first three numbers of each vector, in millionths."""
    probs, best = ops.softmax([F.get("embedding", i).cast("double") * 10 for i in range(3)])
    return read(spark, d, "embeddings").select("vec_id", best.cast("int").alias("label"), *[F.floor(p * 1e6 + 0.5).cast("long").alias(f"p{i}") for i, p in enumerate(probs)])


def class_weights(spark, d):
    return ops.class_weights(read(spark, d, "embeddings").select("label"), "label", 3)


def confusion_matrix(spark, d):
    return ops.confusion(read(spark, d, "labels"), "quality", "toxic", [0, 1])


def train_val_split(spark, d):
    rows = read(spark, d, "customer").select("c_custkey", "c_mktsegment")
    return ops.every_nth_split(rows, ["c_mktsegment"], ["c_custkey"])


def mark_truth_labels(spark, d):
    """Each bubble, labelled by whether its choice is in the key: the two darkest-line suppliers of an order's question."""
    key = dense_marks(spark, d).where("dark >= 40").groupBy("sheet", "q").agg(F.collect_set("rank").alias("answers"))
    marks = dense_marks(spark, d).groupBy("sheet", "q", "rank").agg(F.max("dark").alias("dark"))
    joined = marks.join(key, ["sheet", "q"], "left")
    truth = F.coalesce(F.array_contains("answers", F.col("rank")), F.lit(False))
    return joined.select("sheet", "q", "rank", "dark", truth.alias("is_answer"))


def whitelist_semi(spark, d):
    """Sheets whose template is registered, and the number of those that aren't."""
    orders = read(spark, d, "orders").select("o_orderkey", F.format_string("Q%d_%dch", F.col("o_orderkey") % 10 * 10, F.col("o_custkey") % 5 + 1).alias("template_id"))
    known = F.broadcast(t.templates(spark).select("template_id"))
    status = orders.join(known, "template_id", "left_semi").withColumn("known", F.lit(True)).unionByName(orders.join(known, "template_id", "left_anti").withColumn("known", F.lit(False)))
    return status.groupBy("template_id", "known").agg(F.count("*").alias("n"))


def upload_validation(spark, d):
    """Uploads of the event stream: first bytes, size limit, and the status a service gives."""
    e = read(spark, d, "events").select("event_id", "user_id", F.floor(F.col("value") * 100000).cast("long").alias("size"), F.when(F.col("event_id") % 3 == 0, F.lit("ffd8ffe0")).when(F.col("event_id") % 3 == 1, F.lit("89504e470d0a1a0a")).otherwise(F.lit("47494638")).alias("head"))
    kind = requests.kind_of(F.unhex("head"))
    status = F.when(F.col("size") == 0, 400).when(F.col("size") > 25 * 1024 * 1024, 413).when(kind.isNull(), 415).otherwise(200)
    return e.select("event_id", "user_id", "size", kind.alias("kind"), status.alias("status"))


def rate_limit_flags(spark, d):
    """Users over the limit in a window of a day (a minute's traffic of these tables is one request)."""
    e = read(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.groupBy("user_id", F.window("ts", "1 day").alias("w")).agg(F.count("*").alias("requests")).where("requests > 3").select("user_id", F.date_format("w.start", "yyyy-MM-dd").alias("day"), "requests")


def request_ids(spark, d):
    """The client's request id where it is sane, else one made from the event."""
    e = read(spark, d, "events").select("event_id", F.get_json_object("props", "$.id").alias("given"), "event_type", "user_id")
    own = F.md5(F.concat_ws(":", "event_id", "user_id", "event_type").cast("binary"))
    ok = F.col("given").isNotNull() & F.col("given").rlike("^[A-Za-z0-9_-]{1,64}$")
    return e.select("event_id", F.when(ok, F.col("given")).otherwise(own).alias("request_id"))


def ttl_sweep(spark, d):
    """Run folders by age at the newest run: what a sweep keeps and removes, by month."""
    runs = read(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").cast("timestamp").alias("at"))
    newest = runs.agg(F.max("at").alias("now"))
    age = F.datediff("now", "at")
    return runs.crossJoin(F.broadcast(newest)).groupBy(F.date_format("at", "yyyy-MM").alias("month")).agg(F.count_if(age >= 365).alias("removed"), F.count_if(age < 365).alias("kept"))  # one row


QUERIES = {f.__name__: f for f in (
    qr_classify, ocr_code_extract, digit_grid_decode, template_id_parse, yolo_label_lines, softmax_argmax, class_weights, confusion_matrix, train_val_split, mark_truth_labels, whitelist_semi,
    upload_validation, rate_limit_flags, request_ids, ttl_sweep,
)}

_CODE = "CASE WHEN l_suppkey % 3 = 0 THEN 'stu-' || l_partkey ELSE 'EXAM-' || l_suppkey END"
_AT = "ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity"
_M = lambda x, size: f"floor(({x}) * 1000000::DOUBLE / {2 * size})::BIGINT"
ORACLES = {
    "qr_classify": f"""SELECT l_orderkey AS sheet, coalesce(first({_CODE} {_AT}) FILTER (l_suppkey % 3 = 0), 'UNKNOWN') AS student_code,
coalesce(first({_CODE} {_AT}) FILTER (l_suppkey % 3 <> 0), 'UNKNOWN') AS exam_code, count(*) AS codes FROM lineitem GROUP BY 1""",
    "ocr_code_extract": """WITH x AS (SELECT l_orderkey AS sheet, l_linenumber AS q, 'id: ' || substr('abcXYZ', (l_linenumber % 6 + 1)::INT, 1) || (l_partkey * 37 + 1000) || '-' || l_suppkey || ' end' AS text FROM lineitem)
SELECT sheet, q, regexp_extract(text, '(?i)[A-Z]?\\d{4,6}(?:[-]\\d+)?') AS code, regexp_extract(text, '\\d{4,6}') AS digits,
regexp_matches(regexp_extract(text, '(?i)[A-Z]?\\d{4,6}(?:[-]\\d+)?'), '^(?i:[A-Z]?\\d{5,6})$') AS is_student FROM x""",
    "digit_grid_decode": """WITH b AS (SELECT l_orderkey AS sheet, l_linenumber - 1 AS place, l_suppkey % 10 AS digit, l_quantity / 50 AS fill FROM lineitem),
k AS (SELECT sheet, place, CASE WHEN max(fill) > 0.2::DOUBLE THEN first(digit ORDER BY fill DESC, digit)::VARCHAR ELSE '?' END AS m FROM b GROUP BY 1, 2),
g AS (SELECT sheet, p, coalesce(max(CASE WHEN place = p THEN m END), '?') AS m FROM k, range(7) r(p) GROUP BY 1, 2) SELECT sheet, string_agg(m, '' ORDER BY p DESC) AS code FROM g GROUP BY 1""",
    "template_id_parse": """WITH x AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'sheet' || o_orderkey ELSE 'Q' || (o_orderkey % 100 + 1) || '_' || (o_custkey % 4 + 2) || 'ch' END AS template FROM orders)
SELECT *, nullif(regexp_extract(template, '^Q(\\d+)_(\\d+)ch$', 1), '')::INT AS n_questions, nullif(regexp_extract(template, '^Q(\\d+)_(\\d+)ch$', 2), '')::INT AS n_choices FROM x""",
    "yolo_label_lines": f"""WITH c AS ({CIRCLES_SQL}), k AS (SELECT *, greatest(0, least(cx - r, 750)) AS x0, greatest(0, least(cx + r, 750)) AS x1, greatest(0, least(cy - r, 1060)) AS y0, greatest(0, least(cy + r, 1060)) AS y1 FROM c)
SELECT sheet, q, concat_ws(' ', CASE WHEN dark > 17 THEN 0 ELSE 1 END, {_M("x0 + x1", 750)}, {_M("y0 + y1", 1060)}, {_M("2 * (x1 - x0)", 750)}, {_M("2 * (y1 - y0)", 1060)}) AS line, count(*) AS n FROM k GROUP BY ALL""",
    "softmax_argmax": """WITH x AS (SELECT vec_id, embedding[1]::DOUBLE * 10 AS a, embedding[2]::DOUBLE * 10 AS b, embedding[3]::DOUBLE * 10 AS c FROM embeddings), y AS (SELECT *, greatest(a, b, c) AS m FROM x),
z AS (SELECT *, exp(a - m) AS ea, exp(b - m) AS eb, exp(c - m) AS ec FROM y) SELECT vec_id, CASE WHEN a = m THEN 0 WHEN b = m THEN 1 ELSE 2 END AS label,
floor(ea / (ea + eb + ec) * 1e6 + 0.5)::BIGINT AS p0, floor(eb / (ea + eb + ec) * 1e6 + 0.5)::BIGINT AS p1, floor(ec / (ea + eb + ec) * 1e6 + 0.5)::BIGINT AS p2 FROM z""",
    "class_weights": "SELECT label, n, (sum(n) OVER ())::DOUBLE / (3 * n) AS weight FROM (SELECT label, count(*) AS n FROM embeddings GROUP BY 1)",
    "confusion_matrix": "SELECT quality, count(*) FILTER (toxic = 0) AS seen_0, count(*) FILTER (toxic = 1) AS seen_1, count(*) AS support, count(*) FILTER (quality = toxic)::DOUBLE / count(*) AS recall FROM labels GROUP BY 1",
    "train_val_split": "SELECT c_custkey, c_mktsegment, CASE WHEN (row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) - 1) % 5 = 0 THEN 'val' ELSE 'train' END AS split FROM customer",
    "mark_truth_labels": f"SELECT sheet, q, rank, max(dark) AS dark, max(dark) >= 40 AS is_answer FROM ({DENSE_SQL}) GROUP BY 1, 2, 3",
    "whitelist_semi": """SELECT template_id, q IN (10, 20, 30, 40, 50, 60, 80) AND c BETWEEN 2 AND 5 AS known, count(*) AS n
FROM (SELECT o_orderkey % 10 * 10 AS q, o_custkey % 5 + 1 AS c, 'Q' || (o_orderkey % 10 * 10) || '_' || (o_custkey % 5 + 1) || 'ch' AS template_id FROM orders) GROUP BY 1, 2""",
    "upload_validation": """WITH e AS (SELECT event_id, user_id, floor(value * 100000)::BIGINT AS size, CASE event_id % 3 WHEN 0 THEN 'jpeg' WHEN 1 THEN 'png' END AS kind FROM events)
SELECT *, CASE WHEN size = 0 THEN 400 WHEN size > 26214400 THEN 413 WHEN kind IS NULL THEN 415 ELSE 200 END AS status FROM e""",
    "rate_limit_flags": "SELECT user_id, strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, count(*) AS requests FROM events GROUP BY 1, 2 HAVING count(*) > 3",
    "request_ids": """WITH e AS (SELECT *, json_extract_string(props, '$.id') AS given FROM events)
SELECT event_id, CASE WHEN given IS NOT NULL AND regexp_full_match(given, '[A-Za-z0-9_-]{1,64}') THEN given ELSE md5(event_id || ':' || user_id || ':' || event_type) END AS request_id FROM e""",
    "ttl_sweep": """SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) FILTER (date_diff('day', o_orderdate, now_) >= 365) AS removed, count(*) FILTER (date_diff('day', o_orderdate, now_) < 365) AS kept
FROM orders, (SELECT max(o_orderdate) AS now_ FROM orders) GROUP BY 1""",
}
