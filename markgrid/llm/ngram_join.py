"""Operator 4: n-gram Jaccard join with adaptive multi-match prefixes.

Two documents link when 100 * |A n B| >= percent * |A u B| over their sets of word shingles.

1. Documents with equal sets form one class; its smallest doc_id stands for it from here on.
2. Shingles get one global order: by hash, but shingles that turn up in HOT_LEAST prefixes or more
   come last, by that number. It is found by ROUNDS rounds: count all prefixes under the present
   order, demote, repeat. (Any order is correct; this one makes prefixes rare. At most ROUNDS * HOT_LIMIT
   shingles, a million, are demoted, so what is broadcast is bounded.)
3. Linked documents share at least l of the first |A| - ceil(t |A|) + l shingles of that order
   (the l-prefix). Each document picks l in 1..L_MAX by the estimated cost of its candidates: the
   postings read, plus the verifications that so many postings can bring about when a candidate
   needs l of them. Two documents must share min(l, l') shingles before verification.
4. Postings are joined in two steps. First every document meets one document of each of its prefix
   shingles only (the first of HEADS orders, by shingle), which is linear in the postings, and
   components are formed. Then pairs from different components meet, and must share the number of
   shingles of 3: copies of one another are together by then, so a large group of near copies is not
   expanded into its pairs, and no link between components is lost.
   Step one can't count: a document's other shared shingles may have other heads, so the number of
   shingles with one head is only a lower bound, and a demand on it would leave members of a large
   group to step two. It needs no count either: it may find any links it likes, as each is verified,
   and what it misses step two finds; 5. keeps its pairs few (check_s: 485,624 postings, 4,586 pairs
   to verify, 3,022 of them links).
5. A pair only leaves a join if its sketches allow a link: a sketch has the parity of the number of
   elements in each of SKETCH cells, and every element in one set only changes one parity, so sets
   that differ in more parities than linked sets may differ in elements cannot link. This is exact.
6. Candidates are verified by full sets, made anew of just the documents that have candidates. The
   set of a is sent to each b, that of b is sent once to every PART pairs of b, and a row of a names no
   more than about LISTED of its pairs, so a document of very many candidates is no hot key on either side.

Defined cases: null and empty texts have an empty set and link with nothing; texts of fewer words
than a shingle are one shingle; rows of a repeated doc_id are one document: if its texts differ, it
has the links of equal texts of each, and other links by the text of the smallest fingerprint; rows
without doc_id get the component of the class they are in, if that has an id; empty tables give no
rows; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .shared import free_name, remove, table, written
from .text import chunk_words, chunks, mix, shingles, signed

HOT_LEAST, HOT_LIMIT, ROUNDS, L_MAX, HEADS, SKETCH, BROADCAST_IDS, PART, LISTED, HOT_CLASSES = 4, 500_000, 2, 8, 4, 512, 1_000_000, 32, 1_000, 10_000
_other, _third = np.uint64(0xD6E8FEB86659FD93), np.uint64(0x8CB92BA72F3D8DD7)


def shingle_set(words: np.ndarray, k: int) -> np.ndarray:
    return np.unique(shingles(words, k))


def prefix_size(n: int, percent: int) -> int:
    return n + (-percent * n) // 100 + 1


def ordered(own: np.ndarray, hot: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """A sorted set in the global order."""
    if len(hot):
        at = np.minimum(np.searchsorted(hot, own), len(hot) - 1)
        key = np.where(hot[at] == own, weight[at], 0)
        if key.any():
            return own[np.lexsort((own, key))]
    return own


def sketch(own: np.ndarray) -> np.ndarray:
    """Parities of the elements in each cell, as SKETCH / 64 numbers."""
    cells = np.bincount((mix(own ^ _third) % np.uint64(SKETCH)).astype(np.int64), minlength=SKETCH) & 1
    return np.packbits(cells.astype(np.uint8)).view(np.uint64)


def may_link(percent: int):
    """Whether sketches (sketch, sketch2) and sizes (n, m) of two sets allow a link: linked sets differ in
    (100 - percent) / (100 + percent) of the sum of their sizes at most."""
    apart = sum((F.bit_count(F.get("sketch", i).bitwiseXOR(F.get("sketch2", i))) for i in range(SKETCH // 64)), F.lit(0))
    return (100 + percent) * apart <= (100 - percent) * (F.col("n") + F.col("m"))


def lists(column: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(x) for x in column])]).astype(np.int32)
    flat = signed(np.concatenate(column)) if column else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


def texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))


def prefixes(docs: DataFrame, k: int, percent: int, hot: tuple[np.ndarray, np.ndarray] | None, extra: int) -> DataFrame:
    """doc_id, n, a fingerprint of the set (f, g), its sketch, and the first shingles in the global order."""
    shared = docs.sparkSession.sparkContext.broadcast(hot) if hot else None

    def run(batches):
        demoted, weight = shared.value if shared else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        for b, some in chunks(batches, "text"):
            sets = [shingle_set(w, k) for w in chunk_words(some)]
            cut = [ordered(s, demoted, weight)[: prefix_size(len(s), percent) + extra] if len(s) else s for s in sets]
            f, g = (signed(np.array([mix(s ^ x).sum(dtype=np.uint64) for s in sets], np.uint64)) for x in (np.uint64(0), _other))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(f), pa.array(g), lists([sketch(s) for s in sets]), lists(cut)], ["doc_id", "n", "f", "g", "sketch", "prefix"])

    return texts(docs).mapInArrow(run, "doc_id long, n long, f long, g long, sketch array<long>, prefix array<long>")


def full_sets(docs: DataFrame, few: DataFrame, k: int, small: bool, texts_of: DataFrame | None) -> DataFrame:
    """The columns of few (id, carried) and the set of each document of an id. texts_of: id and
    fingerprint of the text that counts, for ids of several."""
    docs = texts(docs)
    found = docs.join(F.broadcast(few) if small else few, docs["doc_id"] == few["id"]).select("id", "carried", "text")

    def run(batches):
        for b, some in chunks(batches, "text"):
            sets = [shingle_set(w, k) for w in chunk_words(some)]
            f = signed(np.array([mix(s).sum(dtype=np.uint64) for s in sets], np.uint64))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("carried"), pa.array(f), lists(sets)], ["id", "carried", "f", "items"])

    kind = few.schema["carried"].dataType.simpleString()
    out = found.mapInArrow(run, f"id long, carried {kind}, f long, items array<long>")
    if texts_of is not None:
        out = out.join(texts_of, "id", "left").where("own_f IS NULL OR own_f = f")
    return out


def hot_shingles(heads: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of at least HOT_LEAST prefixes (more, if they were over HOT_LIMIT), with the number."""
    counts = written(heads.select(F.explode("prefix").alias("token")).groupBy("token").count().where(F.col("count") >= HOT_LEAST), "hot")
    powers = [F.count(F.when(F.col("count") >= HOT_LEAST << i, 1)) for i in range(40)]
    sizes = counts.agg(*[p.alias(f"p{i}") for i, p in enumerate(powers)]).first()
    i = next(i for i in range(40) if sizes[i] <= HOT_LIMIT)
    got = counts.where(F.col("count") >= HOT_LEAST << i).toArrow()  # HOT_LIMIT rows at most
    remove(heads.sparkSession, counts)
    token, n = got.column("token").to_numpy().view(np.uint64), got.column("count").to_numpy()
    order = np.argsort(token)
    return token[order], n[order]


def merged(one: tuple[np.ndarray, np.ndarray] | None, two: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    if one is None:
        return two
    token = np.concatenate([one[0], two[0]])
    token, first = np.unique(token, return_index=True)  # an earlier round's weight stays
    return token, np.concatenate([one[1], two[1]])[first]


def similar_sizes(percent: int):
    return (100 * F.col("n") >= percent * F.col("m")) & (100 * F.col("m") >= percent * F.col("n"))


def verified(docs: DataFrame, pairs: DataFrame, k: int, percent: int, texts_of: DataFrame | None) -> DataFrame:
    """The pairs (a, b) that link. pairs: written; texts are shuffled only for very many pairs."""
    small = pairs.count() <= BROADCAST_IDS
    heads = pairs.groupBy("b").agg(F.ceil(F.count("*") / PART).alias("parts"))
    part = F.pmod(F.xxhash64("a"), F.col("parts"))
    tails = pairs.groupBy("a").agg(F.ceil(F.count("*") / LISTED).alias("lists")).where("lists > 1")
    own_list = F.pmod(F.xxhash64("b"), F.coalesce("lists", F.lit(1)))
    to = pairs.join(heads, "b").join(tails, "a", "left").groupBy(F.col("a").alias("id"), own_list.alias("list")).agg(F.collect_list(F.struct("b", part.alias("part"))).alias("carried")).drop("list")
    left = full_sets(docs, to, k, small, texts_of).select(F.col("id").alias("a"), F.col("items").alias("x"), F.inline("carried"))
    right = full_sets(docs, heads.select(F.col("b").alias("id"), F.col("parts").alias("carried")), k, small, texts_of).select(
        F.col("id").alias("b"), F.col("items").alias("y"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("carried") - 1)).alias("part")
    )
    both = F.size(F.array_intersect("x", "y"))
    return left.join(right.hint("merge"), ["b", "part"]).where(100 * both >= percent * (F.size("x") + F.size("y") - both)).select("a", "b")


def enough(met: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of documents that share the shingles the shorter of their prefixes calls for, or
    as many as two linked sets of their sizes (n, m) may have in common at least, if that is fewer."""
    overlap = -F.floor(-percent * F.greatest("n", "m") / 100)
    pairs = met.groupBy(F.col("doc_id").alias("a"), "b").agg(F.count("*").alias("shared"), F.first(F.least("l", "l2", overlap)).alias("need"))
    return pairs.where("shared >= need").select("a", "b")


def near_classes(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs (doc_id, text)."""
    spark, hot = docs.sparkSession, None
    for _ in range(ROUNDS):
        hot = merged(hot, hot_shingles(prefixes(docs, k, percent, hot, 0)))
    rows = written(prefixes(docs, k, percent, hot, L_MAX - 1), "prefixes")
    classes = written(rows.where("n > 0").groupBy("f", "g", "n").agg(F.min("doc_id").alias("rep"), F.count("*").alias("size")), "classes")
    texts_of = written(rows.groupBy(F.col("doc_id").alias("id")).agg(F.min("f").alias("own_f"), F.max("f").alias("last")).where("own_f <> last").drop("last"), "repeated-ids")
    if texts_of.isEmpty():
        texts_of, single = None, rows
    else:
        single = rows.join(texts_of, rows["doc_id"] == texts_of["id"], "left").where("own_f IS NULL OR own_f = f").drop("id", "own_f")
    reps = single.join(classes.select("rep").distinct(), F.col("doc_id") == F.col("rep"), "left_semi").where("n > 0")

    # postings of shingles that two documents share, up to the L_MAX-prefix
    every = reps.select("doc_id", "n", F.posexplode("prefix").alias("rank", "token"))
    counts = written(every.groupBy("token").agg(F.count("*").alias("df")).where("df > 1"), "counts")
    postings = written(every.join(counts, "token").withColumn("l_rank", F.greatest(F.lit(1), F.col("rank") - (F.col("n") + F.floor(-percent * F.col("n") / 100)) + 1)), "postings")
    remove(spark, counts)
    # rank 0 .. p1-1 are of the 1-prefix, rank p1-1+i of the (1+i)-prefix
    verify = F.lit(1) + F.first("n") / 8
    read = [F.sum(F.when(F.col("l_rank") <= i, F.col("df") - 1).otherwise(0)) for i in range(1, L_MAX + 1)]
    cost = [r * (1 + verify / i) for i, r in enumerate(read, 1)]
    best, least = F.lit(1), cost[0]
    for i, c in enumerate(cost[1:], 2):
        best, least = F.when(c <= least, F.lit(i)).otherwise(best), F.least(least, c)
    dealt = postings.repartition("doc_id")  # the sums and the join share this shuffle
    own = written(dealt.join(dealt.groupBy("doc_id").agg(best.alias("l")).hint("merge"), "doc_id").where("l_rank <= l").select("token", "doc_id", "n", "l"), "own-postings")
    remove(spark, postings)

    # step one: each document and the first document of each of its shingles
    sketches = written(single.join(own.select(F.col("doc_id").alias("__id")).distinct(), F.col("doc_id") == F.col("__id"), "left_semi").dropDuplicates(["doc_id"]).select(F.col("doc_id").alias("b"), F.col("sketch").alias("sketch2")), "sketches")
    place = F.xxhash64("doc_id", F.pmod(F.col("token"), F.lit(HEADS)))
    first = written(own.groupBy("token").agg(F.min(F.struct(place.alias("place"), "doc_id", "n")).alias("head"), F.count("*").alias("df")).where("df > 1"), "heads")
    met = own.join(first.select("token", F.col("head.doc_id").alias("b"), F.col("head.n").alias("m")), "token").where("doc_id <> b").where(similar_sizes(percent))
    met = met.select("doc_id", "n", "b", "m").distinct().join(sketches, "b").join(sketches.select(F.col("b").alias("doc_id"), F.col("sketch2").alias("sketch")), "doc_id")
    star = written(met.where(may_link(percent)).select(F.col("doc_id").alias("a"), "b"), "star")
    links = written(verified(docs, star, k, percent, texts_of), "links")
    remove(spark, first)
    inside = written(components(links), "inside")

    # step two: pairs from different components that share enough
    placed = own.join(inside, own["doc_id"] == inside["id"], "left").select("token", "doc_id", "n", "l", F.coalesce("component", "doc_id").alias("c"))
    placed = written(placed, "placed")
    mixed = placed.groupBy("token").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("token")
    mixed = written(mixed, "mixed")
    left = placed.join(mixed, "token", "left_semi").join(sketches.select(F.col("b").alias("doc_id"), F.col("sketch2").alias("sketch")), "doc_id")
    left = written(left, "open-postings")
    right = left.select(F.col("token").alias("token2"), F.col("doc_id").alias("b"), F.col("n").alias("m"), F.col("l").alias("l2"), F.col("c").alias("c2"), F.col("sketch").alias("sketch2"))
    cross = left.join(right, (F.col("token") == F.col("token2")) & (F.col("doc_id") > F.col("b")) & (F.col("c") != F.col("c2")) & similar_sizes(percent) & may_link(percent))
    cross = written(enough(cross, percent).join(star, ["a", "b"], "left_anti"), "cross")
    more = written(verified(docs, cross, k, percent, texts_of), "more-links")
    found = components(links.unionByName(more))
    named = written(classes.join(found, classes["rep"] == found["id"], "left").select("f", "g", "n", "size", F.coalesce("component", "rep").alias("component_id")), "named")
    remove(spark, own, sketches, star, links, inside, placed, mixed, left, cross, more, classes, found)
    # classes of over a ten-thousandth of all rows are broadcast, so no key of the other join has more
    keys = ["f", "g", "n"]
    hot = F.col("size") > max(1, (named.agg(F.sum("size")).first()[0] or 0) // HOT_CLASSES)
    few, some = F.broadcast(named.where(hot).drop("size")), rows.where("n > 0").select("doc_id", *keys)
    joined = some.join(few, keys).unionByName(some.join(F.broadcast(named.where(hot).select(*keys)), keys, "left_anti").join(named.where(~hot).drop("size").hint("merge"), keys))
    empty = rows.where("n = 0").select("doc_id", *keys, F.col("doc_id").alias("component_id"))
    return joined.unionByName(empty).select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one_of_each(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """docs with one document, the smallest doc_id, of each group of near copies."""
    groups = near_classes(docs, k, percent)
    key = free_name(docs, "__id")
    kept = groups.where(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias(key)).distinct()
    return docs.join(kept, docs["doc_id"] == kept[key], "left_semi").unionByName(docs.where("doc_id IS NULL"))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(table(spark, sf_dir, "documents"), 3, 90)


#: The same over every pair that shares a shingle; small tables only.
SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(words) < 3 THEN array_to_string(words, ' ') ELSE words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] END AS shingle
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 1, 2))) AS i FROM w WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 90 * (x.n + y.n - i)),
r(id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.id AND r.c < e.b)
SELECT doc_id, coalesce(n, 0) AS n_shingles, c AS component_id
FROM (SELECT id AS doc_id, min(c) AS c FROM r GROUP BY id) LEFT JOIN n USING (doc_id)
"""
