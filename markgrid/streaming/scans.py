"""Scan events as streams: windows, sessions, deduplication and request limits.

Each transformation takes and returns a DataFrame and works on a stream or a table alike; the
watermark only has meaning on a stream. run_available runs one over the files that a source folder
has, to the end, and gives what it wrote.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DELAY_S = 600
DELAY = f"{DELAY_S} seconds"
#: How far beyond the watermark a stream is closed: more than the delay and the longest window or gap together.
REACH = "2 days"
#: A watermark begins at 1970 and takes what is before that for late, so windows count time from 2000 years earlier
#: (whole cycles of the calendar, whole days), in microseconds.
ERA = 5 * 146_097 * 86_400 * 1_000_000
SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def scan_events(spark: SparkSession, path: str, files_per_trigger: int | None = 8) -> DataFrame:
    """The event stream of a folder or (as a glob pattern) file of Parquet, with event time in ts; without a number
    of files all that are there make one micro-batch."""
    reader = spark.readStream.schema(SCHEMA)
    rows = (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).parquet(path)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def plain(name: str) -> Column:
    """An instant as the session's wall-clock time, as the tables have it."""
    return F.col(name).cast("timestamp_ntz")


def timed(events: DataFrame) -> DataFrame:
    return events.withColumn("ts", F.timestamp_micros(F.unix_micros("ts") + ERA)).withWatermark("ts", DELAY)


def untimed(instant: Column) -> Column:
    """An instant of timed rows as the tables have it."""
    return F.timestamp_micros(F.unix_micros(instant) - ERA).cast("timestamp_ntz")


def hourly(events: DataFrame) -> DataFrame:
    w = F.window("ts", "1 hour")
    return timed(events).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("scans"), F.sum(F.floor(F.col("value") * 1e6 + 0.5).cast("long")).alias("value_micro")).select(
        untimed(F.col("w.start")).alias("start"), "event_type", "scans", "value_micro"
    )


def sliding(events: DataFrame) -> DataFrame:
    w = F.window("ts", "6 hours", "3 hours")
    return timed(events).groupBy(w.alias("w")).agg(F.count("*").alias("scans")).select(untimed(F.col("w.start")).alias("start"), "scans")


def sessions(events: DataFrame, gap: str = "2 hours") -> DataFrame:
    w = F.session_window("ts", gap)
    return timed(events).groupBy(w.alias("w"), "user_id").agg(F.count("*").alias("scans")).select("user_id", untimed(F.col("w.start")).alias("start"), untimed(F.col("w.end")).alias("stop"), "scans")


def first_of_each(events: DataFrame) -> DataFrame:
    """One event of each user, type and second: repeated deliveries go."""
    return events.withColumn("second", F.date_trunc("second", "ts")).withWatermark("second", DELAY).dropDuplicates(["user_id", "event_type", "second"]).select("user_id", "event_type", plain("second").alias("at"))


def over_limit(events: DataFrame, window: str = "1 day", limit: int = 3) -> DataFrame:
    w = F.window("ts", window)
    return events.withWatermark("ts", DELAY).groupBy(w.alias("w"), "user_id").agg(F.count("*").alias("requests")).where(F.col("requests") > limit).select("user_id", plain("w.start").alias("start"), "requests")


def first_within(events: DataFrame, delay: str = DELAY) -> DataFrame:
    """The first delivery of each user's type and second, as the stream has it; a delivery that comes more than
    the delay after it, in event time, counts as new, so state is kept no longer than that."""
    second = events.withColumn("second", F.date_trunc("second", "ts")).withWatermark("ts", delay)
    return second.dropDuplicatesWithinWatermark(["user_id", "event_type", "second"])


def new_place(base: str) -> str:
    return f"{base.rstrip('/')}/stream-{uuid.uuid4().hex}"


def run_at(stream: DataFrame, place: str, write=None) -> list[dict]:
    """Runs a stream in append mode over all that its source has, from where an earlier run at the same place ended,
    and gives the progress of its micro-batches. write(batch, number): by default a folder a batch below place/result."""
    write = write or (lambda batch, number: batch_folder(batch, f"{place}/result", number))
    query = stream.writeStream.outputMode("append").option("checkpointLocation", f"{place}/checkpoint").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    return [json.loads(p.json) for p in query.recentProgress]


def result_at(spark: SparkSession, place: str) -> DataFrame:
    return spark.read.parquet(f"{place}/result").drop("batch")


def run_available(spark: SparkSession, stream: DataFrame, base: str) -> DataFrame:
    """Runs a stream over all that its source has and returns the result: what the watermark has made final.
    Checkpoint and result lie below base, a folder that all executors share."""
    place = new_place(base)
    run_at(stream, place)
    return result_at(spark, place)


def run_to_end(spark: SparkSession, path: str, transform, base: str) -> DataFrame:
    """Runs a transformation over all events that a path has and returns the whole result, with the windows that are
    still open at its end. The events are one micro-batch, so none is late behind another, whatever order the files
    have. Then a row of a second source closes the stream: it carries the watermark past all windows but its own,
    which stays open, so it is in no result."""
    place = new_place(base)
    events = scan_events(spark, path, None).unionByName(scan_events(spark, f"{place}/[c]losing", None))
    stream = transform(events)
    passed = run_at(stream, place)[-1]["eventTime"]["watermark"]
    at = untimed(F.lit(passed).cast("timestamp") + F.expr(f"INTERVAL {REACH}"))
    spark.range(1).select(at.alias("ts")).write.parquet(f"{place}/closing")
    run_at(stream, place)
    return result_at(spark, place)


def batch_folder(rows: DataFrame, path: str, number: int) -> None:
    """Writes a micro-batch to a folder of its own, so that a batch that is run again replaces its rows."""
    rows.write.mode("overwrite").parquet(f"{path}/batch={number}")


def split_rejects(batch: DataFrame, number: int, reason: Column, good: str, rejected: str) -> None:
    """For foreachBatch: rows without a reason go to one table, the others with it to the dead-letter table."""
    marked = batch.withColumn("error", reason).persist()
    batch_folder(marked.where("error IS NULL").drop("error"), good, number)
    batch_folder(marked.where("error IS NOT NULL"), rejected, number)
    marked.unpersist()


def split_late(batch: DataFrame, number: int, place: str, delay_s: int) -> None:
    """For foreachBatch: rows that come after the watermark of the batches before (their latest ts less the
    delay) go to place/late, the others to place/on_time. The latest ts of each batch is kept beside them, so a
    batch that is run again is split the same way."""
    spark = batch.sparkSession
    batch = batch.persist()
    seen = batch.select(F.max("ts").alias("latest"))
    if number:
        before = spark.read.schema("latest timestamp, batch long").parquet(f"{place}/latest").where(F.col("batch") < number)
        passed = before.agg(F.max("latest")).first()[0]
    else:
        passed = None
    late = F.coalesce(F.col("ts") <= F.lit(passed) - F.make_dt_interval(secs=F.lit(delay_s)), F.lit(False)) if passed is not None else F.lit(False)
    batch_folder(batch.where(late), f"{place}/late", number)
    batch_folder(batch.where(~late), f"{place}/on_time", number)
    batch_folder(seen, f"{place}/latest", number)
    batch.unpersist()
