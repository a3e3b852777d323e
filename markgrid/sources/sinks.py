"""Result sinks and read-back: JSON results by exam, dead letters, label lines, and retention.

A sink takes the id of the job that writes; the same job run again replaces its rows.
"""

from __future__ import annotations

import datetime
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def replacing(rows: DataFrame, job: str, by: list[str]):
    """A writer that replaces the folders job/by... which rows have, and no others."""
    own = rows.withColumn("job", F.lit(job))
    return own.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("job", *by)


def write_results(results: DataFrame, path: str, job: str, by: str = "exam_code") -> None:
    """One JSON line a sheet, in a folder for each job and value of by."""
    replacing(results, job, [by]).json(path)


def write_label_lines(lines: DataFrame, path: str, job: str) -> None:
    replacing(lines.select("line"), job, []).text(path)


def write_crops(crops: DataFrame, path: str, job: str) -> None:
    """Bubble crops as Parquet, in a folder for each job and split."""
    replacing(crops, job, ["split"]).parquet(path)


def read_crops(spark: SparkSession, path: str, split: str) -> DataFrame:
    """One split; only its folder is read."""
    return spark.read.parquet(path).where(F.col("split") == split).drop("split", "job")


def read_back(results: DataFrame, errors: DataFrame, wanted: DataFrame) -> DataFrame:
    """run_id, status for wanted (run_id): 200 with a result, 422 with an error, else 404."""
    ok, bad = (df.select("run_id").distinct().withColumn(name, F.lit(True)) for df, name in ((results, "ok"), (errors, "bad")))
    found = wanted.join(ok, "run_id", "left").join(bad, "run_id", "left")
    return found.select("run_id", F.when(F.col("ok"), 200).when(F.col("bad"), 422).otherwise(404).alias("status"))


def expired(files: DataFrame, now, ttl_hours: int) -> DataFrame:
    """path of the files (path, modificationTime) whose age at now is the time to live or more."""
    return files.where(F.col("modificationTime") <= F.lit(now) - F.make_dt_interval(hours=F.lit(ttl_hours))).select("path")


def scan_folder(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").load(folder).select("path", "modificationTime", "length")


def write_by_day(rows: DataFrame, path: str, at: str) -> None:
    """rows as Parquet in a folder for each day of `at`; days that rows has are replaced."""
    by_day = rows.withColumn("day", F.to_date(at)).repartition("day")
    by_day.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def sweep_days(spark: SparkSession, path: str, now: datetime.datetime, ttl_days: int) -> list[datetime.date]:
    """Deletes the folders of days that ended ttl_days or more before now, whole and without reading them, and
    names them; a second sweep finds none. Other folders stay."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    gone = []
    for found in system.listStatus(folder) if system.exists(folder) else []:
        name = found.getPath().getName()
        if found.isDirectory() and re.fullmatch(r"day=\d{4}-\d\d-\d\d", name):
            day = datetime.date.fromisoformat(name[4:])
            ended = datetime.datetime.combine(day + datetime.timedelta(days=1), datetime.time())
            if ended <= now - datetime.timedelta(days=ttl_days):
                system.delete(found.getPath(), True)
                gone.append(day)
    return sorted(gone)
