"""Operator 1: exact dedup against a persistent digest index.

The index is a table bucketed and sorted by the SHA-256 of the normalised text (A-Z lower-cased,
null as empty). A batch is reduced to one winner per digest, deduplicated by one sort-merge join with
the index - which gives what an anti-join would leave, and the sizes of all groups in the same pass -
and appended; how often the others turned up again is appended as counts (rows without keep_id), so
group sizes cover the index and the batch. Everything is DataFrame code.

Batches: rows carry the number of their batch, and a batch counts from when its end is noted in the
index's log, so what a failed append left is never read. A batch that is run again under its name, after a
failure or a finished run, is judged by the batches before it and gets its first verdicts; it is appended once.
Log entries are names of empty files, so none is ever half written. One job writes at a time.
compact() merges all batches but the last into one file a bucket with a row a digest; older ones can't be
run again from then on. Spark sorts the buckets once more for the join, as it takes no order from files.

Hot digests: rows are first counted per (digest, doc_id), which spreads a group of copies, then
per digest with map-side partial sums. In the last join, digests that the batch has at least
max(64, rows/10,000) times - so 10,000 digests at most, whatever the input - are broadcast; all
others go through a sort-merge join in which no key has more rows than that. The index itself is
only joined with one row per digest.

Defined cases: a null text equals an empty one; a null doc_id loses to any other; rows that repeat
doc_id and text give one row each, of which one is kept; an empty table gives no rows; further
columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import free_name, new_path, remove, remove_path, table, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HOT_SHARE, HOT_LEAST = 10_000, 64
FORMAT = 3


def digest(text):
    return F.sha2(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER).cast("binary"), 256)


class DigestIndex:
    """The index below a location in a shared store; the same location opens the same index again.

    buckets only counts for a new index (default: spark.sql.shuffle.partitions); another number than
    that of an existing index, or another format, is an error. close() takes the table out of the
    session's catalog and leaves the files."""

    def __init__(self, spark: SparkSession, location: str | None = None, buckets: int | None = None):
        self.spark = spark
        self.location = (location or new_path(spark, "digest-index")).rstrip("/")
        known = [re.fullmatch(r"index-(\d+)-(\d+)", n) for n in self._names()]
        if known := [m for m in known if m]:
            form, own = map(int, known[0].groups())
            if form != FORMAT or (buckets or own) != own:
                raise ValueError(f"{self.location} is an index of format {form} with {own} buckets")
            self.buckets = own
        else:
            self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
            self._note(f"index-{FORMAT}-{self.buckets}")
        self.name = None
        self._open()

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.location}/{name}")

    def _system(self):
        return self._path("log").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self) -> list[str]:
        folder = self._path("log")
        return [f.getPath().getName() for f in self._system().listStatus(folder)] if self._system().exists(folder) else []

    def _note(self, name: str) -> None:
        self._system().create(self._path(f"log/{name}"), True).close()

    def _log(self) -> tuple[int, set[int], dict[str, int], int]:
        """The batch that the compacted part ends with (0: none), batches begun, and finished ones by name's hash; the last finished."""
        names = self._names()
        base = max([0, *(int(n[5:]) for n in names if n.startswith("base-"))])
        begun = {int(n[6:]) for n in names if n.startswith("begun-")}
        done = {n.split("-")[2]: int(n.split("-")[1]) for n in names if n.startswith("done-")}
        return base, begun, done, max([base, *done.values()])

    def _open(self) -> None:
        self.close()
        base = self._log()[0]
        self.data = f"{self.location}/data-{base}"
        self.name = f"digest_index_{uuid.uuid4().hex}"
        self.spark.sql(
            f"CREATE TABLE {self.name} (digest STRING, keep_id BIGINT, n BIGINT, first BOOLEAN, batch BIGINT) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.data}'"
        )

    def begin(self, batch: str | None) -> tuple[int, bool]:
        """The number of a batch, and whether it is in the index already."""
        base, begun, done, _ = self._log()
        key = hashlib.sha256((batch or uuid.uuid4().hex).encode()).hexdigest()
        if key in done:
            if done[key] <= base:
                raise ValueError(f"batch {batch} is part of the compacted index and can't be run again")
            return done[key], True
        number = max([base, *begun, *done.values()]) + 1
        self._note(f"begun-{number}")
        self.running = (number, key)
        return number, False

    def read(self, before: int | None = None) -> DataFrame:
        """One row per digest and batch that had it, of the finished batches (before one); first marks the one with the id that stays."""
        base, begun, done, _ = self._log()
        failed = sorted(begun - set(done.values()) - {n for n in begun if n <= base})
        rows = self.spark.table(self.name)
        rows = rows.where(~F.col("batch").isin(failed)) if failed else rows
        return rows if before is None else rows.where(F.col("batch") < before)

    def groups(self, before: int | None = None) -> DataFrame:
        """digest, keep_id, group_size: one row per digest; the aggregation follows the buckets."""
        return self.read(before).groupBy("digest").agg(F.max(F.when(F.col("first"), F.col("keep_id"))).alias("keep_id"), F.sum("n").alias("group_size"))

    def append(self, rows: DataFrame, number: int) -> None:
        """Appends the rows (digest, keep_id, n, first) of a batch, and notes that it is finished."""
        self._write(rows.withColumn("batch", F.lit(number).cast("long")), self.name, self.data)
        self.spark.catalog.refreshTable(self.name)
        self._note(f"done-{number}-{self.running[1]}")

    def _write(self, rows: DataFrame, name: str, data: str) -> None:
        (
            rows.repartition(self.buckets, "digest")
            .write.bucketBy(self.buckets, "digest").sortBy("digest")
            .option("path", data).format("parquet").mode("append").saveAsTable(name)
        )

    def compact(self) -> None:
        """One file a bucket and one row a digest for all batches but the last, which stays as it is."""
        base, _, done, last = self._log()
        merged = max([base, *(n for n in done.values() if n < last)])
        old_data, old_name = self.data, self.name
        if merged == base:
            return
        own = self.groups(last).select("digest", "keep_id", F.col("group_size").alias("n"), F.lit(True).alias("first"), F.lit(merged).cast("long").alias("batch"))
        rows = written(own.unionByName(self.read().where(F.col("batch") == last)), "compacted")
        self.data, self.name = f"{self.location}/data-{merged}", f"digest_index_{uuid.uuid4().hex}"
        remove_path(self.spark, self.data)  # of a compaction that failed
        self._write(rows, self.name, self.data)
        self._note(f"base-{merged}")
        self.spark.sql(f"DROP TABLE IF EXISTS {old_name}")
        remove_path(self.spark, old_data)
        remove(self.spark, rows)

    def close(self) -> None:
        if self.name:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def exact_dedup(docs: DataFrame, index: DigestIndex | None = None, batch: str | None = None) -> DataFrame:
    """A row for each row of docs (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the largest doc_id stays; a text that an earlier batch brought into
    the index stays there, and all its rows here go. group_size counts the rows of all batches up to
    this one. batch names the batch: run again under its name, it gets its first verdicts. Without an index,
    one for this call alone is made and removed."""
    keys = verdicts(docs, index, batch)
    return keys.select(
        "doc_id", "keep_id", "group_size", F.posexplode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("i", "nth"), "digest", "stays"
    ).select(
        "doc_id", "keep_id", "group_size", (F.col("stays") & (F.col("i") == 0)).alias("kept"), F.col("digest").alias("text_sha256")
    )


def verdicts(docs: DataFrame, index: DigestIndex | None = None, batch: str | None = None) -> DataFrame:
    """digest, doc_id, n (rows that have both), keep_id, group_size, stays: whether one of the n rows is kept."""
    spark = docs.sparkSession
    own = index or DigestIndex(spark)
    number, known = own.begin(batch)
    rows = written(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest(F.col("text")).alias("digest"))
        .groupBy("digest", "doc_id").agg(F.count("*").alias("n")),
        "digests",
    )
    winners = rows.groupBy("digest").agg(F.max("doc_id").alias("own_id"), F.sum("n").alias("batch_size"))
    # what the index had before this batch: those digests stay there
    before = own.groups(number).select("digest", F.lit(True).alias("old"), F.col("keep_id").alias("old_id"), F.col("group_size").alias("old_size"))
    held = written(
        winners.join(before.hint("merge"), "digest", "left").select(
            "digest", "batch_size", F.col("old").isNotNull().alias("old"), F.when(F.col("old"), F.col("old_id")).otherwise(F.col("own_id")).alias("keep_id"),
            (F.col("batch_size") + F.coalesce("old_size", F.lit(0))).alias("group_size"),
        ),
        "merged",
    )
    if not known:
        own.append(held.select("digest", F.when(~F.col("old"), F.col("keep_id")).alias("keep_id"), F.col("batch_size").alias("n"), (~F.col("old")).alias("first")), number)
    total = held.agg(F.sum("batch_size")).first()[0] or 0
    hot = F.col("batch_size") >= max(HOT_LEAST, -(-total // HOT_SHARE))
    few, rest = F.broadcast(held.where(hot)), held.where(~hot).hint("merge")
    joined = rows.join(few, "digest").unionByName(rows.join(F.broadcast(held.where(hot).select("digest")), "digest", "left_anti").join(rest, "digest"))
    stays = ~F.col("old") & F.col("doc_id").eqNullSafe(F.col("keep_id"))
    out = written(joined.select("digest", "doc_id", "n", "keep_id", "group_size", stays.alias("stays")), "verdicts")
    remove(spark, rows, held)
    if index is None:
        own.close()
        remove_path(spark, own.location)
    return out


def keep_first_copies(docs: DataFrame) -> DataFrame:
    """docs without rows whose normalised text another row with a larger doc_id has; of rows that
    repeat text and doc_id one stays. Texts are moved by one shuffle, on a hash of text and id, which
    spreads groups of copies; the semi-join and the removal of repeated rows share it."""
    key = free_name(docs, "__key")
    of = lambda h, i: F.sha2(F.concat_ws(":", h, F.coalesce(i.cast("long").cast("string"), F.lit(""))).cast("binary"), 256)
    kept = verdicts(docs.select("doc_id", "text")).where("stays").select(of(F.col("digest"), F.col("doc_id")).alias(key))
    own = docs.withColumn(key, of(digest(F.col("text")), F.col("doc_id")))
    return own.join(kept.hint("merge"), key, "left_semi").dropDuplicates([key]).select(*docs.columns)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


SQL = f"""
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), '{UPPER}', '{LOWER}')) AS h FROM documents),
g AS (SELECT h, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY h)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, h AS text_sha256 FROM d JOIN g USING (h)
"""
