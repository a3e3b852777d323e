import datetime
import itertools
import shutil

import duckdb
import pytest
from pyspark.sql import functions as F

from markgrid.plans import streams
from markgrid.sources import sinks
from markgrid.streaming import limits, scans

from .conftest import rows_of

START = datetime.datetime(2024, 1, 1)


def events(spark, rows):
    """rows: (event_id, second, user_id)."""
    made = [(i, START + datetime.timedelta(seconds=s), u, "view", 1.0, "{}") for i, s, u in rows]
    return spark.createDataFrame(made, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def land(spark, folder, rows, n):
    events(spark, rows).coalesce(1).write.mode("overwrite").parquet(f"{folder}/in/part={n}")


def judged_by_hand(rows, window, limit):
    out = {}
    for i, s, u in rows:
        n = sum(1 for _, t, v in rows if v == u and s - window < t <= s)
        out[i] = (n, n <= limit)
    return out


@pytest.fixture
def own(spark):
    session = spark.newSession()
    session.conf.set("spark.sql.streaming.stateStore.providerClass", limits.STATE_STORE)
    return session


def limited(own, folder):
    stream = scans.scan_events(own, f"{folder}/in", files_per_trigger=1)
    return scans.run_at(limits.judged_stream(stream, 60, 3, "30 seconds"), f"file://{folder}/run")


def test_sliding_limit_goes_on_after_a_restart(spark, own, tmp_path):
    seconds = [0, 10, 20, 30, 59, 60, 61, 90, 90, 90, 150, 151, 300, 301, 302, 303, 304, 363, 364]
    rows = [(i, s, 1) for i, s in enumerate(seconds)] + [(100 + i, s, 2) for i, s in enumerate(seconds[::3])] + [(200, 100_000, 9)]
    folder = str(tmp_path)
    for n, (low, high) in enumerate([(0, 25), (25, 91)]):
        land(spark, folder, [r for r in rows if low <= r[1] < high], n)
    limited(own, folder)
    early = {r.event_id for r in scans.result_at(spark, f"file://{folder}/run").collect()}
    assert early and len(early) < sum(s < 91 for _, s, _ in rows)
    for n, (low, high) in enumerate([(91, 310), (310, 10**6)], 2):
        land(spark, folder, [r for r in rows if low <= r[1] < high], n)
    progress = limited(own, folder)
    got = {r.event_id: (r.requests, r.allowed) for r in scans.result_at(spark, f"file://{folder}/run").collect()}
    want = judged_by_hand(rows, 60, 3)
    assert got == {i: v for i, v in want.items() if i != 200} and {v[1] for v in got.values()} == {True, False}
    table = {r.event_id: (r.requests, r.allowed) for r in limits.judged(events(spark, rows).withColumn("ts", F.col("ts").cast("timestamp")), 60, 3).collect()}
    assert table == want
    # quiet users leave nothing behind: what is left is the last one's request
    assert progress[-1]["stateOperators"][0]["numRowsTotal"] <= 3
    assert limits.judged(spark.createDataFrame([], "user_id long, event_id long, ts timestamp"), 60, 3).count() == 0


def test_deduplication_keeps_bounded_state(spark, tmp_path):
    folder, n = str(tmp_path), 12
    for k in range(n):  # an hour a file, each request twice
        land(spark, folder, [(k * 100 + i, k * 3600 + i // 2 * 30, 1) for i in range(100)], k)
    stream = scans.scan_events(spark, f"{folder}/in", files_per_trigger=1)
    progress = scans.run_at(scans.first_within(stream), f"file://{folder}/run")
    assert scans.result_at(spark, f"file://{folder}/run").count() == n * 50
    rows = [p["stateOperators"][0]["numRowsTotal"] for p in progress if p["stateOperators"]]
    assert len(rows) >= n and max(rows) <= 100 < n * 50


def test_late_rows_go_to_dead_letters(spark, tmp_path):
    folder = str(tmp_path)
    land(spark, folder, [(1, 0, 1), (2, 5000, 1)], 0)
    place = f"file://{folder}/run"

    def run():
        stream = scans.scan_events(spark, f"{folder}/in", files_per_trigger=1)
        scans.run_at(stream, place, lambda batch, number: scans.split_late(batch, number, place, 600))

    run()
    land(spark, folder, [(3, 4400, 1), (4, 4401, 1), (5, 9000, 1)], 1)
    run()
    ids = lambda kind: sorted(r.event_id for r in spark.read.parquet(f"{place}/{kind}").collect())
    assert (ids("on_time"), ids("late")) == ([1, 2, 4, 5], [3])
    # a micro-batch that is run again gives the same
    again = spark.read.schema(scans.SCHEMA).parquet(f"{folder}/in/part=1").withColumn("ts", F.col("ts").cast("timestamp"))
    scans.split_late(again, 1, place, 600)
    assert (ids("on_time"), ids("late")) == ([1, 2, 4, 5], [3])


def test_sweep_drops_whole_days_once(spark, tmp_path):
    days = [START + datetime.timedelta(days=d, hours=7) for d in range(5)]
    rows = spark.createDataFrame(list(itertools.product([1, 2], days)), "id int, at timestamp")
    path = str(tmp_path / "runs")
    sinks.write_by_day(rows, path, "at")
    (tmp_path / "runs" / "other").mkdir()
    now = datetime.datetime(2024, 1, 5)
    assert [d.day for d in sinks.sweep_days(spark, path, now, 2)] == [1, 2]
    assert sinks.sweep_days(spark, path, now, 2) == []
    assert sorted({r.at.day for r in spark.read.parquet(f"{path}/day=*").collect()}) == [3, 4, 5] and (tmp_path / "runs" / "other").exists()
    assert sinks.sweep_days(spark, str(tmp_path / "nothing"), now, 2) == []


@pytest.mark.parametrize("name, times", [("stream_hourly_scans", 1), ("stream_sliding", 2), ("stream_session", 1)])
def test_whole_result_of_a_stream(spark, tmp_path, name, times):
    """Each event is counted: in windows open at the end, in files that come out of order, before 1970."""
    folder, n = tmp_path / "events.parquet", 10
    folder.mkdir()
    for k in range(n):  # newest first
        day = START - datetime.timedelta(days=(0, 1, 2, 3, 4, 5, 6, 7, 8, 20_000)[k])
        made = [(k * 100 + i, day + datetime.timedelta(minutes=59 * i), None if i % 7 == 0 else i % 3, "view", i / 8, "{}") for i in range(30)]
        made.append((k * 100 + 30, day, 5, "click", 1.0, "{}"))
        made += [(k * 100 + 31 + j, day + datetime.timedelta(microseconds=t), 5, "click", 1.0, "{}") for j, t in enumerate((7_200_000_000, 14_400_000_000, 21_600_000_001))]
        spark.createDataFrame(made, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(f"{tmp_path}/made/{k}")
        (made_file,) = (tmp_path / "made" / str(k)).glob("*.parquet")
        shutil.copy(made_file, folder / f"part-{k}.parquet")
    with duckdb.connect() as c:
        c.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/*.parquet'")
        want = rows_of(c.execute(streams.ORACLES[name]).df())
    got = streams.QUERIES[name](spark, str(tmp_path))
    assert got.agg(F.sum("scans")).first()[0] == times * n * 34
    assert rows_of(got) == want
