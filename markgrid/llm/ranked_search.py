"""Operator 12: ranked lexical search with per-term geometric blocking.

The items are searched in blocks of bounded size; for each block of items:

1. forward: one pass over the documents gives, for every row with a term, its number of terms and the
   terms of the items that it has, with counts. Document frequencies and lengths are summed from it.
2. thresholds: in every part of the forward table the documents of each item's rarest terms are scored;
   the k-th best of all parts is a lower bound of the k-th best of all documents. The largest impact of
   each term is taken along.
3. blocks: a document that can reach an item's threshold has one of its essential terms, that is all but
   the weakest terms whose largest impacts together stay below the threshold. The posting list of each
   essential term is clustered, part by part, by the similarity of its documents: every document goes to
   the nearest of the list's representatives. A block of such a cluster is stored with the coordinatewise
   maximum of its documents' impacts.
4. search: an item visits the blocks of its essential terms. The sum of the maxima over its terms is an
   exact upper bound for each document of the block; only a block whose bound is below the threshold is
   skipped.
5. the documents of the other blocks are joined with the forward table and scored; the k best stay.

So no document is lost: every one that reaches the threshold lies in a block that was not skipped, and a
threshold of 0 skips nothing. All of it is whole numbers in 64 bits but the weight's logarithm.

Nothing is shuffled but pairs of item and row that pass a bound, and once the forward table. Parts have at
most PART_POSTINGS postings (or one document) and lists are clustered in pieces of PIECE_DOCS
documents, so memory is bounded; a term that all documents have makes many blocks, in all tasks. The
driver holds one block of items: QUERY_BYTES of text and QUERY_ITEMS rows on average, by a hash.

Defined cases: null texts have no terms; an item without terms, or whose terms no document has, gives no
rows; repeated items, also null ids, are ranked each; repeated documents each take a rank; equal scores
are in order of doc_id, a null one first; empty tables give no rows; further columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import remove, table, written
from .text import give_back

K, BLOCK_DOCS, SEED_DOCS = 20, 8, 64
PART_POSTINGS, PIECE_DOCS, PIECE_CELLS, PAIR_ENTRIES = 1 << 20, 2048, 1 << 22, 1 << 21
QUERY_BYTES, QUERY_ITEMS = 16 << 20, 20_000
#: Bytes of terms, A-Z as a-z; all others as a space.
TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
FORWARD = "row long, doc_id long, n long, terms array<int>, tfs array<int>"
TEXT_SLICE = 16 << 20


def terms_of(raw: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, in runs of about TEXT_SLICE bytes that end between terms."""
    at = 0
    while len(raw) - at > TEXT_SLICE:
        end = at + TEXT_SLICE
        while end < len(raw) and TERM_BYTES[raw[end]] != 32:
            end += 1
        yield raw[at:end].translate(TERM_BYTES).split(b" ")
        at = end
    yield raw[at:].translate(TERM_BYTES).split(b" ")


def counted(text: str | None) -> Counter:
    c: Counter = Counter()
    for words in terms_of((text or "").encode()):
        c.update(words)
    del c[b""]
    return c


class Items:
    """A block of items: their terms as numbers 0..size-1, and how often each has which."""

    def __init__(self, rows: list[tuple]) -> None:
        self.ids = [item_id for item_id, _ in rows]
        counts = [counted(text) for _, text in rows]
        self.number = {t: i for i, t in enumerate(sorted(set().union(*counts)))}
        self.size = len(self.number)
        pairs = [sorted((self.number[t], n) for t, n in c.items()) for c in counts]
        self.terms = [np.array([t for t, _ in p], np.int64) for p in pairs]
        self.times = [np.array([n for _, n in p], np.int64) for p in pairs]
        self.keys = np.concatenate([i * self.size + t for i, t in enumerate(self.terms)]) if rows else np.zeros(0, np.int64)
        self.key_times = np.concatenate(self.times) if rows else np.zeros(0, np.int64)


class Corpus:
    """What scoring needs of all documents: N, L and the weight of each term."""

    def __init__(self, documents: int, length: int, df: np.ndarray) -> None:
        self.documents, self.length = documents, max(length, 1)
        self.weight = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(d) + 1))) for d in df], np.int64)

    def impacts(self, n: np.ndarray, terms: np.ndarray, tfs: np.ndarray) -> np.ndarray:
        """What one occurrence of a term in an item adds to the score; n: the documents' lengths, a value a posting."""
        m = 75 + 25 * n * self.documents // self.length
        tf = tfs.astype(np.int64)
        return self.weight[terms] * (1_000_000_000 * tf // (1000 * tf + 12 * m))


class Part:
    """Rows of the forward table as flat arrays: postings start[i]..start[i+1] are those of row i."""

    def __init__(self, batch: pa.RecordBatch, corpus: Corpus) -> None:
        lists = batch.column("terms")
        self.rows, n = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("row", "n"))
        self.terms = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        size = lists.value_lengths().to_numpy(zero_copy_only=False)
        self.start = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
        self.of = np.repeat(np.arange(len(size)), size)
        self.impact = corpus.impacts(n[self.of], self.terms, batch.column("tfs").flatten().to_numpy(zero_copy_only=False))

    def postings(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The postings of some rows, and for each the place of its row among them."""
        size = self.start[rows + 1] - self.start[rows]
        place = np.repeat(np.arange(len(rows)), size)
        first = np.cumsum(size) - size
        return np.arange(len(place)) - first[place] + self.start[rows][place], place

    def by_term(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Terms of the part, and where the list of each begins and ends among the postings sorted by term."""
        order = np.argsort(self.terms, kind="stable")
        terms, first = np.unique(self.terms[order], return_index=True)
        return order, terms, np.append(first, len(order))


def parts(batches: Iterator[pa.RecordBatch], corpus: Corpus) -> Iterator[Part]:
    """Parts of at most PART_POSTINGS postings, or of one row."""
    for b in batches:
        ends = np.cumsum(b.column("terms").value_lengths().to_numpy(zero_copy_only=False))
        at = 0
        while at < b.num_rows:
            done = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + PART_POSTINGS, "right")))
            yield Part(b.slice(at, to - at), corpus)
            at = to


def summed(values: np.ndarray, place: np.ndarray, n: int) -> np.ndarray:
    """Whole-number sums of values by place, which is in order."""
    total = np.concatenate([[0], np.cumsum(values)])
    at = np.searchsorted(place, np.arange(n + 1))
    return total[at[1:]] - total[at[:-1]]


def forward(docs: DataFrame, items: Items) -> DataFrame:
    number = items.number

    def run(batches):
        row = TaskContext.get().partitionId() << 40
        for b in batches:
            for at in range(0, b.num_rows, 500):
                some = b.slice(at, 500)
                out = []
                for doc_id, text in zip(some.column("doc_id").to_pylist(), some.column("text").to_pylist()):
                    c = counted(text)
                    if c:
                        found = sorted((number[t], c[t]) for t in c.keys() & number.keys())
                        out.append((row, doc_id, c.total(), [t for t, _ in found], [n for _, n in found]))
                        row += 1
                if out:
                    types = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()))
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), types)], ["row", "doc_id", "n", "terms", "tfs"])
        give_back()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, FORWARD)


def corpus_of(fwd: DataFrame, items: Items) -> Corpus:
    n, length = fwd.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(items.size, np.int64)
    for term, count in fwd.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*")).collect():  # at most a row for each term of the items
        df[term] = count
    return Corpus(n, length, df)


def long_batch(columns: list[np.ndarray], names: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names.split())


def thresholds(fwd: DataFrame, items: Items, corpus: Corpus, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For each item a score that k documents reach (0 if none is known), and the largest impact of each term."""
    rarest = [t[np.argsort(-corpus.weight[t], kind="stable")] for t in items.terms]

    def run(batches):
        times = np.zeros(items.size, np.int64)
        for p in parts(batches, corpus):
            order, terms, first = p.by_term()
            yield long_batch([-1 - terms, np.maximum.reduceat(p.impact[order], first[:-1]) if len(terms) else terms], "item score")
            place = np.full(items.size, -1)
            place[terms] = np.arange(len(terms))
            got = [np.zeros((2, 0), np.int64)]
            for i, own in enumerate(rarest):
                rows = np.zeros(0, np.int64)
                for j in place[own]:
                    if j >= 0 and len(rows) < SEED_DOCS:
                        rows = np.union1d(rows, p.of[order[first[j] : first[j + 1]][:SEED_DOCS]])
                at, which = p.postings(rows)
                times[items.terms[i]] = items.times[i]
                best = np.sort(summed(p.impact[at] * times[p.terms[at]], which, len(rows)))[::-1][:k]
                times[items.terms[i]] = 0
                got.append(np.stack([np.full(len(best), i), best]))
            yield long_batch(list(np.concatenate(got, axis=1)), "item score")

    seen = written(fwd.select("row", "n", "terms", "tfs").mapInArrow(run, "item long, score long"), "seeds")
    largest, floor = np.zeros(items.size, np.int64), np.zeros(len(items.ids), np.int64)
    for item, score in seen.where("item < 0").groupBy("item").agg(F.max("score")).collect():
        largest[-1 - item] = score
    best = seen.where("item >= 0").withColumn("place", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score")))).where(F.col("place") <= k)
    for item, count, score in best.groupBy("item").agg(F.count("*"), F.min("score")).collect():
        floor[item] = score if count == k else 0
    remove(fwd.sparkSession, seen)
    return floor, largest


def essential(items: Items, floor: np.ndarray, largest: np.ndarray) -> dict[int, list[int]]:
    """The items by essential term: a document without an essential term of an item stays below its threshold."""
    by: dict[int, list[int]] = {}
    for i, (terms, times) in enumerate(zip(items.terms, items.times)):
        most = times * largest[terms]
        weakest = np.argsort(most, kind="stable")
        for t in terms[weakest[np.cumsum(most[weakest]) >= floor[i]]].tolist():
            if largest[t]:
                by.setdefault(t, []).append(i)
    return by


BLOCK = "term int, rows array<long>, terms array<int>, maxima array<long>"


def clustered(impacts: np.ndarray) -> np.ndarray:
    """Cluster numbers of documents (rows of impacts): each goes to the nearest, by Euclidean distance, of as many
    evenly chosen representatives as there are blocks to be."""
    n = len(impacts)
    at = impacts.astype(np.float32) / np.float32(max(int(impacts.max(initial=0)), 1))
    heads = at[np.arange(-(-n // BLOCK_DOCS)) * n // -(-n // BLOCK_DOCS)]
    return ((heads * heads).sum(1) - 2 * (at @ heads.T)).argmin(1)


def blocks(fwd: DataFrame, items: Items, corpus: Corpus, lists: dict[int, list[int]]) -> DataFrame:
    """The blocks of the essential terms' posting lists: rows, and the maxima over them, of the terms of those items."""
    wanted = np.zeros(items.size, bool)
    wanted[list(lists)] = True

    def run(batches):
        for p in parts(batches, corpus):
            order, terms, first = p.by_term()
            place, out, held = np.full(items.size, -1), [], 0
            for j in np.flatnonzero(wanted[terms]):
                own = np.unique(np.concatenate([items.terms[i] for i in lists[int(terms[j])]]))
                place[own] = np.arange(len(own))
                docs = p.of[order[first[j] : first[j + 1]]]
                step = max(1, min(PIECE_DOCS, PIECE_CELLS // len(own)))
                for at in range(0, len(docs), step):
                    rows = docs[at : at + step]
                    posts, which = p.postings(rows)
                    column = place[p.terms[posts]]
                    near = column >= 0
                    impacts = np.zeros((len(rows), len(own)), np.int64)
                    impacts[which[near], column[near]] = p.impact[posts[near]]
                    label = clustered(impacts)
                    by = np.argsort(label, kind="stable")
                    cut = np.flatnonzero(np.diff(label[by], prepend=-1))
                    most = np.maximum.reduceat(impacts[by], cut, axis=0)
                    for members, top in zip(np.split(p.rows[rows[by]], cut[1:]), most):
                        some = np.flatnonzero(top)
                        out.append((int(terms[j]), members, own[some].astype(np.int32), top[some]))
                        held += len(members) + len(some)
                place[own] = -1
                if held > PART_POSTINGS:
                    yield block_batch(out)
                    out, held = [], 0
            if out:
                yield block_batch(out)
        give_back()

    return fwd.select("row", "n", "terms", "tfs").mapInArrow(run, BLOCK)


def block_batch(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()))
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), types)], ["term", "rows", "terms", "maxima"])


def survivors(index: DataFrame, items: Items, floor: np.ndarray, lists: dict[int, list[int]]) -> DataFrame:
    """row, item: the documents of the blocks whose bound for an item reaches its threshold (some more than once)."""

    def run(batches):
        times = np.zeros(items.size, np.int64)
        for b in batches:
            term = b.column("term").to_numpy(zero_copy_only=False)
            order = np.argsort(term, kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(term[order])) + 1):
                some = b.take(pa.array(own))
                rows, maxima, terms = (some.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("rows", "maxima", "terms"))
                n_rows, n_terms = (some.column(c).value_lengths().to_numpy(zero_copy_only=False) for c in ("rows", "terms"))
                of_row, of_term = np.repeat(np.arange(len(own)), n_rows), np.repeat(np.arange(len(own)), n_terms)
                for i in lists.get(int(term[own[0]]), ()):
                    times[items.terms[i]] = items.times[i]
                    bound = summed(maxima * times[terms], of_term, len(own))
                    times[items.terms[i]] = 0
                    found = rows[(bound >= floor[i])[of_row]]
                    if len(found):
                        yield long_batch([found, np.full(len(found), i)], "row item")

    return index.mapInArrow(run, "row long, item long")


SCORED = "item long, item_id long, doc_id long, score long"


def scored(candidates: DataFrame, items: Items, corpus: Corpus) -> DataFrame:
    """The exact score of each document of candidates (items, doc_id, n, terms, tfs) for its items."""
    ids = pa.array(items.ids, pa.int64())

    def run(batches):
        for b in batches:
            for p, doc_ids, wanted in candidate_parts(b, corpus):
                lengths = wanted.value_lengths().to_numpy(zero_copy_only=False)
                row, item = np.repeat(np.arange(len(lengths)), lengths), wanted.flatten().to_numpy(zero_copy_only=False)
                ends = np.cumsum(p.start[row + 1] - p.start[row])
                at = 0
                while at < len(row):
                    to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIR_ENTRIES, "right")))
                    posts, which = p.postings(row[at:to])
                    key = item[at:to][which] * items.size + p.terms[posts]
                    place = np.minimum(np.searchsorted(items.keys, key), len(items.keys) - 1)
                    times = np.where(items.keys[place] == key, items.key_times[place], 0)
                    score = summed(p.impact[posts] * times, which, to - at)
                    good = np.flatnonzero(score > 0)
                    columns = [pa.array(item[at:to][good]), ids.take(pa.array(item[at:to][good])), doc_ids.take(pa.array(row[at:to][good])), pa.array(score[good])]
                    yield pa.RecordBatch.from_arrays(columns, ["item", "item_id", "doc_id", "score"])
                    at = to
        give_back()

    return candidates.mapInArrow(run, SCORED)


def candidate_parts(batch: pa.RecordBatch, corpus: Corpus) -> Iterator[tuple]:
    for at in range(0, batch.num_rows, 1000):
        some = batch.slice(at, 1000)
        yield Part(some, corpus), some.column("doc_id"), some.column("items")


def search_block(docs: DataFrame, items: Items, k: int) -> DataFrame:
    spark = docs.sparkSession
    fwd = written(forward(docs, items), "forward")
    corpus = corpus_of(fwd, items)
    floor, largest = thresholds(fwd, items, corpus, k)
    lists = essential(items, floor, largest)
    index = written(blocks(fwd, items, corpus, lists), "blocks")
    found = survivors(index, items, floor, lists).groupBy("row").agg(F.collect_set("item").alias("items"))  # at most all items of the block
    ranked = scored(found.join(fwd, "row"), items, corpus)
    ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_first("doc_id")))).where(F.col("rank") <= k)
    out = written(ranked.select("item_id", "rank", "doc_id", "score"), "ranked")
    remove(spark, fwd, index)
    return out


def search(docs: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents (doc_id, text) of each item (item_id, text)."""
    spark = docs.sparkSession
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    count, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    n = max(1, -(-count // QUERY_ITEMS), -(-size // QUERY_BYTES))
    number: Callable = lambda i: F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i
    found = [search_block(docs, Items([tuple(r) for r in rows.where(number(i)).collect()]), k) for i in range(n)]
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERMS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
SQL = f"""
WITH d AS (SELECT doc_id, {_TERMS} AS terms FROM documents), s AS (SELECT doc_id, terms, len(terms) AS n FROM d WHERE len(terms) > 0),
a AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS length FROM s),
q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY ALL),
p AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, n, unnest(terms) AS term FROM s) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM p, a GROUP BY term, n_docs),
i AS (SELECT doc_id, p.term, w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // length))) AS impact FROM p JOIN w ON w.term = p.term, a),
r AS (SELECT item_id, doc_id, sum(times * impact)::BIGINT AS score FROM q JOIN i ON i.term = q.term GROUP BY item_id, doc_id),
k AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM r WHERE score > 0)
SELECT * FROM k WHERE rank <= {K}
"""
