"""Scanned sheets as a stream: image files of a landing folder become graded answers, one result row a
sheet, and dead letters, micro-batch by micro-batch.

A file is named <template id>__<anything>.<png or jpg>; its path is the sheet. (Empty files give no row in
Spark's file source.) Each batch goes to
folders of its own number, so a batch that is run again after a failure replaces what it wrote.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import rounded, stem, suffix
from ..operators import kernels, requests, rollup
from ..operators.timing import StageTimes
from ..plans import grading as g
from ..sources import images
from ..sources import templates as t
from ..sources.marks import MASK
from .scans import batch_folder

SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def landed(spark: SparkSession, folder: str, files_per_trigger: int = 64) -> DataFrame:
    """The image files of a landing folder as a stream."""
    rows = spark.readStream.format("binaryFile").schema(SCHEMA).option("pathGlobFilter", "*.{png,jpg,jpeg}").option("maxFilesPerTrigger", files_per_trigger).load(folder)
    return rows.withColumns({"template_id": F.split_part(stem(F.col("path")), F.lit("__"), F.lit(1)), "suffix": suffix(F.col("path"))})


def refused(files: DataFrame, known: DataFrame) -> DataFrame:
    """path, template_id and, for files that can't be read as sheets, status and error."""
    status = requests.checked(files.select("path", "template_id", "content"), known)
    code, message = requests.explained(F.col("status"))
    return status.select("path", "template_id", "status", F.when(F.col("status") != 200, F.concat_ws(": ", code, message)).alias("error"))


def read_batch(files: DataFrame, number: int, out: str, times: StageTimes | None = None) -> None:
    """Answers, results and dead letters of files (path, content, template_id, ...), below out."""
    spark = files.sparkSession
    times = times or StageTimes()
    known = t.templates(spark)
    files = files.persist()
    rules = refused(files, known).persist()
    fine = files.join(F.broadcast(rules.where("error IS NULL").select("path")), "path", "left_semi")  # the names of one batch
    with times.stage("decode", images.decoded(fine).join(rules.select("path", "template_id"), "path")) as pages:
        pages = pages.persist()
        fits = (F.col("error").isNull()) & (F.col("h") == kernels.HEIGHT) & (F.col("w") == kernels.WIDTH)
        bad = pages.where(~F.coalesce(fits, F.lit(False))).select("path", "template_id", F.lit(422).alias("status"), F.coalesce("error", F.lit("not an aligned page")).alias("error"))
        batch_folder(rules.where("error IS NOT NULL").unionByName(bad), f"{out}/errors", number)
    numbered = pages.where(fits).withColumn("sheet", F.xxhash64("path"))
    with times.stage("measure", kernels.measured(numbered.select("sheet", "template_id", "gray"), t.grid(known))) as bubbles:
        marks = bubbles.select("sheet", "q", "rank", F.round(F.col("dark") * MASK / F.col("mask")).cast("int").alias("dark")).persist()
        marks.count()
    sizes = numbered.select("sheet", "path", "template_id").join(F.broadcast(known.select("template_id", "n_questions")), "template_id")
    most = max(t.QUESTION_COUNTS)
    with times.stage("grade", g.graded(marks, g.V3O, most).join(sizes, "sheet").where("q <= n_questions")) as answers:
        answers = answers.persist()
        shown = answers.select("path", "template_id", "q", "choice", "note", rounded(F.col("fill"), 4).alias("fill"))
        batch_folder(shown, f"{out}/answers", number)
        batch_folder(rollup.sheet_rollup(answers).join(sizes.select("sheet", "path", "template_id"), "sheet").drop("sheet"), f"{out}/results", number)
    for df in (answers, marks, pages, rules, files):
        df.unpersist()


def run(spark: SparkSession, folder: str, out: str, files_per_trigger: int = 64) -> None:
    """Reads all files that the landing folder has; a later run goes on where this one ended."""
    stream = landed(spark, folder, files_per_trigger).writeStream.option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True)
    stream.foreachBatch(lambda files, number: read_batch(files, number, out)).start().awaitTermination()
