"""Streaming queries over the event table, run to its end; a batch query in SQL must agree."""

from __future__ import annotations

import tempfile

from pyspark.sql import functions as F

from ..sources import sinks
from ..sources.marks import read
from ..streaming import limits, scans


def shared(spark) -> str:
    """The shared folder of this session; a local one only in a local session without any, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return base or "file://" + tempfile.mkdtemp(prefix="spark-streams-")


def events_at(d):
    return f"{d}/[e]vents.parquet"


def source(spark, d):
    return scans.scan_events(spark, events_at(d))


def streamed(transform):
    return lambda spark, d: scans.run_available(spark, transform(source(spark, d)), shared(spark))


def whole(transform):
    return lambda spark, d: scans.run_to_end(spark, events_at(d), transform, shared(spark))


WINDOW_S, LIMIT = 86_400, 3


def stream_sliding_limit(spark, d):
    """Each request that the watermark has passed, with the requests of its user's last day and whether it is within three."""
    own = spark.newSession()  # the state store is a setting of the session
    own.conf.set("spark.sql.streaming.stateStore.providerClass", limits.STATE_STORE)
    place = scans.new_place(shared(spark))
    scans.run_at(limits.judged_stream(source(own, d), WINDOW_S, LIMIT, scans.DELAY), place)
    return scans.result_at(spark, place)


def sliding_limit(spark, d):
    events = read(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return limits.judged(events, WINDOW_S, LIMIT)


def stream_first_within(spark, d):
    """Deliveries without repeats, by user and type."""
    found = scans.run_available(spark, scans.first_within(source(spark, d)), shared(spark))
    return found.groupBy("user_id", "event_type").agg(F.count("*").alias("deliveries"))


def stream_late_rows(spark, d):
    """Rows on time and late, by day: a late one comes after the watermark of the micro-batches before."""
    place = scans.new_place(shared(spark))
    scans.run_at(source(spark, d), place, lambda batch, number: scans.split_late(batch, number, place, scans.DELAY_S))
    both = spark.read.parquet(f"{place}/on_time").withColumn("late", F.lit(False)).unionByName(spark.read.parquet(f"{place}/late").withColumn("late", F.lit(True)))
    return both.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "late").agg(F.count("*").alias("n"))


def retention_sweep(spark, d):
    """Scans in folders by day, swept of days that are ten days old or more at the newest scan: what is left."""
    path = f"{scans.new_place(shared(spark))}/runs"
    events = read(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    sinks.write_by_day(events, path, "ts")
    sinks.sweep_days(spark, path, events.agg(F.max("ts")).first()[0], 10)
    return spark.read.parquet(path).groupBy(F.date_format("day", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))


QUERIES = {
    "stream_hourly_scans": whole(scans.hourly),
    "stream_sliding": whole(scans.sliding),
    "stream_session": whole(scans.sessions),
    "stream_dedupe": streamed(scans.first_of_each),
    "stream_rate_limit": streamed(scans.over_limit),
    "stream_sliding_limit": stream_sliding_limit,
    "sliding_limit": sliding_limit,
    "stream_first_within": stream_first_within,
    "stream_late_rows": stream_late_rows,
    "retention_sweep": retention_sweep,
}
#: What the watermark has passed at the end of a stream.
_W = "w AS (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 10 MINUTES AS passed FROM events)"
_JUDGED = f"""SELECT user_id, event_id, epoch_us(ts) AS at, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN {WINDOW_S * 1_000_000 - 1} PRECEDING AND CURRENT ROW) AS requests FROM events"""
ORACLES = {
    "stream_hourly_scans": "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS scans, sum(floor(value * 1e6 + 0.5)::BIGINT)::BIGINT AS value_micro FROM events GROUP BY ALL",
    "stream_sliding": """WITH s AS (SELECT time_bucket(INTERVAL 3 HOURS, ts, TIMESTAMP '1970-01-01') AS b FROM events), w AS (SELECT b AS start FROM s UNION ALL SELECT b - INTERVAL 3 HOURS FROM s)
SELECT start AS start, count(*) AS scans FROM w GROUP BY ALL""",
    "stream_session": """WITH l AS (SELECT user_id, ts, coalesce(ts > lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 2 HOURS, true)::INT AS new FROM events),
g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS n FROM l) SELECT user_id, min(ts) AS start, (max(ts) + INTERVAL 2 HOURS) AS stop, count(*) AS scans FROM g GROUP BY user_id, n""",
    "stream_dedupe": "SELECT DISTINCT user_id, event_type, date_trunc('second', ts) AS at FROM events",
    "stream_rate_limit": f"WITH {_W} SELECT user_id, date_trunc('day', ts) AS start, count(*) AS requests FROM events, w WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= passed GROUP BY 1, 2 HAVING count(*) > 3",
    "stream_sliding_limit": f"WITH {_W}, j AS ({_JUDGED}) SELECT j.*, requests <= {LIMIT} AS allowed FROM j, w WHERE j.\"at\" <= epoch_us(passed)",
    "sliding_limit": f"WITH j AS ({_JUDGED}) SELECT *, requests <= {LIMIT} AS allowed FROM j",
    "stream_first_within": "SELECT user_id, event_type, count(DISTINCT date_trunc('second', ts)) AS deliveries FROM events GROUP BY ALL",
    "stream_late_rows": "SELECT strftime(ts, '%Y-%m-%d') AS day, false AS late, count(*) AS n FROM events GROUP BY 1",
    "retention_sweep": "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, count(DISTINCT user_id) AS users FROM events WHERE date_trunc('day', ts) + INTERVAL 1 DAY > (SELECT max(ts) FROM events) - INTERVAL 10 DAYS GROUP BY 1",
}
