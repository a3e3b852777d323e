"""Operator 13: line dedup. Lines that several documents share stay in one of them only.

Normalised lines are exploded and hashed, distinct documents are counted per hash, lines of too many
documents are dropped, and the rest is put together again by position. All of it is DataFrame code.

A line's key is the line without white space (20, 09-0D) at its ends, A-Z lower-cased. Keys of at
least LEAST_CHARS code points in at least LEAST_DOCS documents lose all their lines, except those of
the largest doc_id that has the key. Hashes are two 64-bit ones with different seeds, 128 bits together.

Texts are moved once, in the last join, and the lines themselves never: what is shuffled is hashes,
ids and positions. A hash is first counted per (hash, doc_id), which spreads a line that very many
documents share, then per hash with partial sums. Lines meet the counts in one join; hashes of at least
max(64, 1/10,000 of all counted pairs) documents - so 10,000 at most, whatever the input - are looked
up in a broadcast table instead, and their lines go through that join under the key of their own row, so
no key of the join has more rows than that. Positions are gathered per row, which its text bounds.

Defined cases: a null text is an empty one, one empty line; rows that repeat a doc_id are one document
for the counts, and each is cut for itself; a null doc_id is a document of its own, before all others;
a text whose lines all go becomes empty; an empty table gives no rows; further columns are passed on by
drop_shared_lines, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .exact_dedup import HOT_LEAST, HOT_SHARE, LOWER, UPPER
from .shared import free_name, remove, table, written

LEAST_CHARS, LEAST_DOCS = 20, 3
SPACE = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(SPACE)), UPPER, LOWER)


def whole(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def row_key(doc_id: Column, text: Column) -> tuple[Column, Column]:
    """Two hashes of id and text: rows that repeat both have the same lines and share their key."""
    return F.xxhash64(doc_id, text), F.xxhash64(F.lit(1), text, doc_id)


def long_lines(docs: DataFrame, least: int) -> DataFrame:
    """doc_id, r1, r2 (the row), pos, h1, h2 (the line) for each line with a key of at least `least` code points."""
    id_, text = F.col("doc_id").cast("long"), whole(F.col("text"))
    r1, r2 = row_key(id_, text)
    lines = docs.select(id_.alias("doc_id"), r1.alias("r1"), r2.alias("r2"), F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    keys = lines.where(F.octet_length("line") >= least).select("doc_id", "r1", "r2", "pos", line_key(F.col("line")).alias("key")).where(F.char_length("key") >= least)
    return keys.select("doc_id", "r1", "r2", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))


def shared_lines(lines: DataFrame, least_docs: int) -> DataFrame:
    """h1, h2, docs, keep_id: lines of at least least_docs documents, and the document that keeps them."""
    pairs = lines.groupBy("h1", "h2", "doc_id").agg(F.lit(1).alias("one"))
    return pairs.groupBy("h1", "h2").agg(F.count("*").alias("docs"), F.max("doc_id").alias("keep_id")).where(F.col("docs") >= least_docs)


def dropped_positions(docs: DataFrame, least: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """r1, r2, drop, n_dropped: of each row that loses lines, which (true or false by position)."""
    lines = long_lines(docs, least)
    shared = written(shared_lines(lines, least_docs), "shared-lines")
    total = shared.agg(F.sum("docs")).first()[0] or 0
    hot = F.col("docs") >= max(HOT_LEAST, -(-total // HOT_SHARE))
    few = F.broadcast(shared.where(hot).select("h1", "h2", F.col("keep_id").alias("hot_id")))
    rest = shared.where(~hot).select(F.col("h1").alias("k1"), F.col("h2").alias("k2"), F.lit(False).alias("is_hot"), "keep_id")
    seen = lines.join(few, ["h1", "h2"], "left").withColumn("is_hot", F.col("hot_id").isNotNull())
    keyed = seen.select("doc_id", "r1", "r2", "pos", "is_hot", "hot_id", *[F.when(F.col("is_hot"), F.col(f"r{i}")).otherwise(F.col(f"h{i}")).alias(f"k{i}") for i in (1, 2)])
    met = keyed.join(rest, ["k1", "k2", "is_hot"], "left").withColumn("stays_in", F.coalesce("hot_id", "keep_id"))
    gone = met.where(F.col("stays_in").isNotNull() & ~F.col("doc_id").eqNullSafe(F.col("stays_in")))
    at = gone.groupBy("r1", "r2").agg(F.sort_array(F.collect_set("pos")).alias("at"))
    before = F.concat(F.array(F.lit(-1)), F.slice("at", 1, F.size("at") - 1))
    run = lambda p, q: F.concat(F.array_repeat(F.lit(False), p - q - 1), F.array(F.lit(True)))
    flags = at.select("r1", "r2", F.flatten(F.zip_with("at", before, run)).alias("drop"), F.size("at").cast("long").alias("n_dropped"))
    out = written(flags, "dropped-lines")
    remove(docs.sparkSession, shared)
    return out


def drop_shared_lines(docs: DataFrame, least: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """docs (doc_id, text, ...) with the text that is left, and n_lines (before) and n_dropped."""
    n_lines, n_dropped = free_name(docs, "n_lines"), free_name(docs, "n_dropped")
    k1, k2 = free_name(docs, "__r1"), free_name(docs, "__r2")
    r1, r2 = row_key(F.col("doc_id").cast("long"), whole(F.col("text")))
    d, n = free_name(docs, "__drop"), free_name(docs, "__n")
    flags = dropped_positions(docs.select("doc_id", "text"), least, least_docs).select(F.col("r1").alias(k1), F.col("r2").alias(k2), F.col("drop").alias(d), F.col("n_dropped").alias(n))
    own = docs.withColumns({k1: r1, k2: r2}).join(flags.hint("shuffle_hash"), [k1, k2], "left")
    lines = F.split(whole(F.col("text")), "\n")
    left = F.array_join(F.filter(lines, lambda x, i: ~F.coalesce(F.get(F.col(d), i), F.lit(False))), "\n")
    columns = [F.when(F.col(n).isNull(), whole(F.col("text"))).otherwise(left).alias(c) if c.lower() == "text" else F.col(c) for c in docs.columns]
    return own.select(*columns, F.size(lines).cast("long").alias(n_lines), F.coalesce(F.col(n), F.lit(0)).cast("long").alias(n_dropped))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = drop_shared_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


_KEY = f"translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}')"
SQL = f"""
WITH s AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
e AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM s),
k AS (SELECT doc_id, pos, line, {_KEY} AS key FROM e),
g AS (SELECT key, max(doc_id) AS keep_id FROM k WHERE length(key) >= {LEAST_CHARS} GROUP BY key HAVING count(DISTINCT doc_id) >= {LEAST_DOCS}),
f AS (SELECT k.doc_id, pos, line, g.key IS NOT NULL AND g.keep_id <> k.doc_id AS gone FROM k LEFT JOIN g ON g.key = k.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256 FROM f GROUP BY doc_id
"""
