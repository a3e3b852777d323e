"""Operator 10: language-model scores by Brown class-based bigrams.

Tokens are the words and one end per document; a word is known by its 64-bit hash, of which the last eight bits are its cell. Counts, contexts
and classes of words are tables that grow with the corpus.

1. Counts: each word's training count and total, by Spark.
2. Seed classes: exchange clustering over units - the end token, the SEEDS most frequent words,
   and CELLS cells of words by a hash of their last three bytes - moves one unit at a time to the
   class that gains most bigram likelihood between classes, until few move. Its input, unit
   bigrams, is counted over all training tokens and has a fixed size.
3. Every other word with a training count of FLOOR or more gets a class from all its own contexts:
   the classes of the tokens before and after each of its occurrences are gathered per word by one
   shuffle, and the word moves to the class that gives most likelihood (the exchange step to first
   order; all words move at once, in parallel). Class bigrams are counted anew after each such pass, and
   the next one sees the new classes, until a pass adds less than LEAST_GAIN of likelihood a token, PASSES
   at most; a pass that lowers the likelihood is taken back. The classes that contexts are made of are
   those of the seeds and of the CONTEXT_WORDS most frequent other words, which are broadcast; words
   beyond stand there with the class of their cell. Words of fewer training occurrences, and words
   never seen, take the class of their cell, whose contexts are those of all words of that ending
   outside the seeds.
4. Every text becomes a sequence of classes, a byte a token. Words outside the FREQUENT most frequent
   (those are broadcast, with their counts and classes) are looked up by a join with the table of
   words. Class bigrams are counted over the training sequences.

Model: P(text) = product of P(class | class before) * P(word | class), the end token included.
Transitions are interpolated with class frequencies (Witten-Bell); a word with count c in class k
has (c + 0.5) / (N_k + 0.5 * (V_k + 1)), one share being left for words not seen there; the end token is
alone in class 0.

Hot keys: a word outside the seeds is less than 1 / SEEDS of all tokens, and its contexts are packed
into a row per task and flush before they are shuffled; words outside the broadcast are rarer still.

Defined cases: null and empty texts are the end token alone; repeated rows are counted and scored
each; a null doc_id counts as empty text for the split; without training documents every base
probability is 1 and classes are uniform; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import crc_mod, remove, table, written
from .text import LOWER, chunks, hash_spans, signed, slices, spans

SEEDS, CELLS, CLASSES, FLOOR, FREQUENT, SWEEPS = 1023, 256, 48, 3, 1_000_000, 6
PASSES, LEAST_GAIN, CONTEXT_WORDS = 4, 0.03, 1_000_000
#: Words and tokens that a task holds before it passes them on.
FLUSH, HELD = 1_000_000, 2_000_000
END, SEEN_LATER = 0, 255


def endings(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The cell of each word, by its last three bytes."""
    x = np.zeros(len(starts), np.uint64)
    for i in range(1, 4):
        x = x * np.uint64(256) + np.where(ends - i >= starts, LOWER[buf[np.maximum(ends - i, 0)]], 0).astype(np.uint64)
    return ((x * np.uint64(2654435761) >> np.uint64(16)) % np.uint64(CELLS)).astype(np.uint8)


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and cells of the words of all texts one after another, and the number of words of each text.
    The last bits of a hash are the cell."""
    hashes, cells, n = [], [], np.zeros(len(texts), np.int64)

    def take(raw: bytes, ends_of_texts: np.ndarray, first: int) -> None:
        buf = np.frombuffer(raw, np.uint8)
        starts, ends = spans(buf)
        cell = endings(buf, starts, ends)
        hashes.append(hash_spans(buf, starts, ends) & ~np.uint64(CELLS - 1) | cell)
        cells.append(cell)
        n[first : first + len(ends_of_texts)] += np.diff(np.searchsorted(starts, ends_of_texts), prepend=0)

    whole = len(texts) > 1
    if whole:
        take(b"\n".join(texts), np.cumsum([len(t) + 1 for t in texts]), 0)
    for t in () if whole else texts:
        for piece in slices(t):
            take(piece, np.array([len(piece)]), 0)
    none = np.zeros(0, np.uint64)
    return np.concatenate(hashes or [none]), np.concatenate(cells or [none.astype(np.uint8)]), n


class Lookup:
    """Places of hashes in a sorted array, -1 where there is none."""

    def __init__(self, known: np.ndarray):
        bits = max(1, int(2 * len(known)).bit_length())
        self.known, self.shift = np.append(known, np.uint64(0)), np.uint64(64 - bits)
        self.bound = np.searchsorted(known >> self.shift, np.arange((1 << bits) + 1, dtype=np.uint64)).astype(np.int32)

    def __call__(self, h: np.ndarray) -> np.ndarray:
        bucket = (h >> self.shift).astype(np.int64)
        at, stop = self.bound[bucket], self.bound[bucket + 1]
        out = np.where((at < stop) & (self.known[at] == h), at, -1)
        left = np.flatnonzero((out < 0) & (at + 1 < stop))
        while len(left):
            at[left] += 1
            here = at[left]
            hit = self.known[here] == h[left]
            out[left[hit]] = here[hit]
            left = left[~hit & (here + 1 < stop[left])]
        return out


def summed(h: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
    """Distinct hashes and the sums of values for each."""
    order = np.argsort(h, kind="stable")
    h = h[order]
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
    return [h[first], *(np.add.reduceat(v[order], first) if len(h) else v for v in values)]


def word_counts(docs: DataFrame) -> DataFrame:
    """h, c (count in training documents), total over docs (text binary, training boolean)."""

    def run(batches):
        held: list[list[np.ndarray]] = []

        def joined():
            return summed(*(np.concatenate(x) for x in zip(*held)))

        def out(h, c, total):
            return pa.RecordBatch.from_arrays([pa.array(signed(h)), pa.array(c), pa.array(total)], ["h", "c", "total"])

        for b, texts in ((p, t) for b in batches for p, t in chunks([b], "text")):
            h, _, n = tokens(texts)
            training = np.repeat(np.array(b.column("training").to_pylist(), bool), n)
            held.append(summed(h, training.astype(np.int64), np.ones(len(h), np.int64)))
            if sum(len(x[0]) for x in held) > FLUSH:
                held = [joined()]
                if len(held[0][0]) > FLUSH // 2:
                    yield out(*held[0])
                    held = []
        if held:
            yield out(*joined())

    some = docs.select("text", "training").mapInArrow(run, "h long, c long, total long")
    return some.groupBy("h").agg(F.sum("c").alias("c"), F.sum("total").alias("total"))


def least_of(words: DataFrame, column: str, most: int) -> int:
    """A power of two such that at most that many words have so much or more."""
    sizes = words.agg(*[F.count(F.when(F.col(column) >= 1 << i, 1)).alias(f"p{i}") for i in range(60)]).first()
    return 1 << next(i for i in range(60) if sizes[i] <= most)


def seeds_of(words: DataFrame) -> np.ndarray:
    """The hashes of the SEEDS words of most training occurrences, sorted."""
    top = words.where("c > 0").orderBy(F.desc("c"), "h").limit(SEEDS).select("h").toArrow()
    return np.sort(top.column("h").to_numpy().view(np.uint64))


def units_of(at: np.ndarray, cell: np.ndarray, seeds: int) -> np.ndarray:
    """Units of words by their places among so many seeds (-1: none): the end token, seeds, cells."""
    return np.where(at >= 0, at + 1, 1 + seeds + cell.astype(np.int64))


def framed(x: np.ndarray, n: np.ndarray, fill: int) -> np.ndarray:
    """x with fill before each text and after the last."""
    return np.insert(x, np.concatenate([[0], np.cumsum(n)]), fill)


def unit_bigrams(docs: DataFrame, seeds: np.ndarray) -> np.ndarray:
    """Counts of unit pairs over docs (text binary); the end token also stands before a text."""
    shared = docs.sparkSession.sparkContext.broadcast(seeds)
    units = 1 + len(seeds) + CELLS

    def run(batches):
        find, n = Lookup(shared.value), np.zeros(units * units, np.int32)
        for _, texts in chunks(batches, "text"):
            h, cell, sizes = tokens(texts)
            unit = framed(units_of(find(h), cell, len(shared.value)), sizes, END)
            pairs, times = np.unique(unit[:-1] * units + unit[1:], return_counts=True)
            n[pairs] += times.astype(np.int32)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(n[some].astype(np.int64))], ["pair", "n"])

    got = docs.select("text").mapInArrow(run, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    m = np.zeros(units * units)
    m[got.column("pair").to_numpy()] = got.column("n").to_numpy()
    return m.reshape(units, units)


def _f(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1.0))


def exchange(m: np.ndarray, classes: int = CLASSES, sweeps: int = SWEEPS) -> np.ndarray:
    """The class of each unit; unit END stays alone in class 0."""
    units = len(m)
    freq = m.sum(0)
    of = np.zeros(units, np.int64)
    order = np.argsort(-freq[1:], kind="stable") + 1
    of[order] = 1 + np.arange(units - 1) % (classes - 1)
    sums = np.zeros((classes, units))
    np.add.at(sums, of, m)
    g = np.zeros((classes, classes))
    np.add.at(g.T, of, sums.T)
    for _ in range(sweeps):
        moved = 0
        for w in order:
            own, self_ = of[w], m[w, w]
            r = np.bincount(of, m[w], classes)
            l = np.bincount(of, m[:, w], classes)
            r[own] -= self_
            l[own] -= self_
            total_r, total_l = r.sum() + self_, l.sum() + self_
            if not total_r and not total_l:
                continue
            g[own] -= r
            g[:, own] -= l
            g[own, own] -= self_
            row, col, d = g.sum(1), g.sum(0), np.diag(g)
            gain = (_f(g + r) - _f(g)).sum(1) + (_f(g + l[:, None]) - _f(g)).sum(0)
            gain += _f(d + r + l + self_) - _f(d + r) - _f(d + l) + _f(d)
            gain -= _f(row + total_r) - _f(row) + _f(col + total_l) - _f(col)
            gain[0] = -np.inf
            new = int(gain.argmax())
            if gain[new] <= gain[own] + 1e-9:
                new = own
            g[new] += r
            g[:, new] += l
            g[new, new] += self_
            of[w] = new
            moved += new != own
        if moved <= units // 200:
            break
    return of


def class_pairs(m: np.ndarray, of: np.ndarray, classes: int = CLASSES) -> np.ndarray:
    """Counts of class pairs from counts of unit pairs."""
    sums = np.zeros((classes, len(m)))
    np.add.at(sums, of, m)
    g = np.zeros((classes, classes))
    np.add.at(g.T, of, sums.T)
    return g


def transitions(g: np.ndarray) -> np.ndarray:
    """log10 P(class | class before)."""
    alone = (g.sum(0) + 0.5) / (g.sum() + 0.5 * len(g))
    kinds = np.maximum((g > 0).sum(1, keepdims=True), 1)
    return np.log10((g + kinds * alone) / (g.sum(1, keepdims=True) + kinds))


def best_classes(contexts: np.ndarray, g: np.ndarray) -> np.ndarray:
    """For each word the class of most likelihood. contexts: words x 2 classes: how often each class stands
    before and after the word; g: class pairs. Class 0 is the end token's own."""
    classes = len(g)
    p = np.log((g + 0.5) / (g.sum(1, keepdims=True) + 0.5 * classes))  # class | class before
    share = np.log((g.sum(0) + 0.5) / (g.sum() + 0.5 * classes))
    gain = contexts[:, :classes] @ (p - share) + contexts[:, classes:] @ p.T
    gain[:, 0] = -np.inf
    return gain.argmax(1)


def likelihood(g: np.ndarray) -> float:
    """The log-likelihood of a class bigram model from its class pairs, but for what no choice of classes changes."""
    return float(_f(g).sum() - _f(g.sum(0)).sum() - _f(g.sum(1)).sum())


class Assignment:
    """A class for every word: its own if it is among the words here, else that of its cell. Seeds come first in words."""

    def __init__(self, seeds: np.ndarray, words: np.ndarray, k: np.ndarray, cells: np.ndarray):
        order = np.argsort(words)
        self.words, self.seed = words[order], np.append(order < len(seeds), False)
        self.k = np.concatenate([k[order], cells]).astype(np.uint8)

    def finder(self):
        """A function from hashes and cells to classes, and whether each is a seed."""
        find = Lookup(self.words)

        def classes(h, cell):
            at = find(h)
            return self.k[np.where(at >= 0, at, len(self.words) + cell.astype(np.int64))], self.seed[at]

        return classes


def pair_counts(found: DataFrame, run, classes: int) -> np.ndarray:
    """The sum of the class pairs that run finds in each task's part of found."""

    def rows(batches):
        g = run(batches)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(classes * classes, dtype=np.int32)), pa.array(g)], ["pair", "n"])

    g = np.zeros(classes * classes)
    for pair, n in found.mapInArrow(rows, "pair int, n long").groupBy("pair").agg(F.sum("n")).collect():  # classes^2 rows
        g[pair] = n
    return g.reshape(classes, classes)


def class_bigrams(docs: DataFrame, now: Assignment, classes: int = CLASSES) -> np.ndarray:
    """Counts of class pairs over docs (text binary); the end token also stands before a text."""
    shared = docs.sparkSession.sparkContext.broadcast(now)

    def run(batches):
        of, g = shared.value.finder(), np.zeros(classes * classes, np.int64)
        for _, texts in chunks(batches, "text"):
            h, cell, sizes = tokens(texts)
            k = framed(of(h, cell)[0], sizes, END).astype(np.int64)
            g += np.bincount(k[:-1] * classes + k[1:], minlength=classes * classes)
        return g

    return pair_counts(docs.select("text"), run, classes)


def word_classes(docs: DataFrame, now: Assignment, g: np.ndarray) -> DataFrame:
    """h, k: the best class of each word but the seeds that docs (text binary) have FLOOR times or more, by
    the classes that its neighbours have now and their pairs g."""
    shared = docs.sparkSession.sparkContext.broadcast((now, g))
    classes = len(g)

    def gather(batches):
        of, held = shared.value[0].finder(), []

        def out():
            h, near = (np.concatenate(x) for x in zip(*held))
            order = np.argsort(h, kind="stable")
            h = h[order]
            first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            ends = pa.py_buffer(np.append(2 * first, 2 * len(h)).astype(np.int32))
            packed = pa.Array.from_buffers(pa.binary(), len(first), [None, ends, pa.py_buffer(np.ascontiguousarray(near[order]))])
            return pa.RecordBatch.from_arrays([pa.array(signed(h[first])), packed], ["h", "near"])

        for _, texts in chunks(batches, "text"):
            h, cell, sizes = tokens(texts)
            own, seed = of(h, cell)
            k = framed(own, sizes, END)
            place = np.arange(len(h)) + np.repeat(np.arange(len(sizes)), sizes) + 1
            rare = np.flatnonzero(~seed)
            held.append((h[rare], np.stack([k[place[rare] - 1], k[place[rare] + 1] + classes], 1).astype(np.uint8)))
            if sum(len(x[0]) for x in held) > HELD:
                yield out()
                held = []
        if sum(len(x[0]) for x in held):
            yield out()

    def choose(batches):
        pairs = shared.value[1]
        last, over = np.zeros(0, np.uint64), np.zeros((0, 2 * classes))

        def out(h, contexts):
            enough = contexts.sum(1) >= 2 * FLOOR
            return pa.RecordBatch.from_arrays([pa.array(signed(h[enough])), pa.array(best_classes(contexts[enough], pairs).astype(np.int16))], ["h", "k"])

        for b in batches:
            if b.num_rows:
                h = b.column("h").to_numpy().view(np.uint64)
                ends = np.frombuffer(b.column("near").buffers()[1], np.int32)[b.column("near").offset :][: len(h) + 1]
                near = np.frombuffer(b.column("near").buffers()[2], np.uint8)[ends[0] : ends[-1]] if ends[-1] > ends[0] else np.zeros(0, np.uint8)
                fresh = np.concatenate([[True], h[1:] != h[:-1]])
                word = np.repeat(np.cumsum(fresh) - 1, np.diff(ends))
                own = h[fresh]
                contexts = np.bincount(word * 2 * classes + near, minlength=len(own) * 2 * classes).reshape(len(own), -1).astype(float)
                if len(last) and own[0] == last[0]:
                    contexts[0] += over[0]
                elif len(last):
                    yield out(last, over)
                last, over = own[-1:], contexts[-1:]
                yield out(own[:-1], contexts[:-1])
        if len(last):
            yield out(last, over)

    near = docs.select("text").mapInArrow(gather, "h long, near binary")
    return near.repartition("h").sortWithinPartitions("h").mapInArrow(choose, "h long, k smallint")


def settled(docs: DataFrame, counts: DataFrame, seeds: np.ndarray, of: np.ndarray, g: np.ndarray) -> DataFrame | None:
    """h, k of the words but the seeds after passes over docs (text binary) that each raise the likelihood; None
    if no pass does. counts: h, c; of, g: classes of units and their pairs."""
    spark, rest, value = docs.sparkSession, None, likelihood(g)
    some = counts.where(F.col("c") >= least_of(counts, "c", CONTEXT_WORDS)).select("h")
    now = Assignment(seeds, seeds, of[1 : 1 + len(seeds)], of[1 + len(seeds) :])
    for _ in range(PASSES):
        moved = written(word_classes(docs, now, g), "word-classes")
        got = moved.join(some, "h").select("h", "k").toArrow()  # CONTEXT_WORDS rows at most
        own = [got.column("h").to_numpy().view(np.uint64), got.column("k").to_numpy()]
        after = Assignment(seeds, np.concatenate([seeds, own[0]]), np.concatenate([of[1 : 1 + len(seeds)], own[1]]), of[1 + len(seeds) :])
        pairs = class_bigrams(docs, after, len(g))
        gain = likelihood(pairs) - value
        if gain <= 0:
            remove(spark, moved)
            break
        if rest is not None:
            remove(spark, rest)
        rest, now, g, value = moved, after, pairs, value + gain
        if gain <= LEAST_GAIN * g.sum():
            break
    return rest


class Model:
    """What tasks need: all of bounded size."""

    def __init__(self, least, frequent, counts, of, n_class, v_class, ends):
        self.least, self.frequent, self.counts, self.of = least, frequent, counts, of
        self.n, self.v, self.ends = int(n_class.sum()) + ends, int(v_class.sum()) + (ends > 0), ends
        self.base_total = self.n + 0.5 * (self.v + 1)
        self.class_total = n_class + 0.5 * (v_class + 1)
        self.end_base = float(np.log10((ends + 0.5) / self.base_total))


def learn(docs: DataFrame) -> tuple[Model, DataFrame]:
    """The model but for its transitions, and the table of words (h, c, total, k: class), from docs (text binary, training boolean)."""
    counts = written(word_counts(docs), "word-counts")
    training = docs.where("training")
    ends = training.count()
    seeds = seeds_of(counts)
    m = unit_bigrams(training, seeds)
    of = exchange(m)
    spark, cell_class = docs.sparkSession, of[1 + len(seeds) :]
    named = spark.createDataFrame([(int(h), int(of[i + 1])) for i, h in enumerate(signed(seeds))], "h long, k smallint")
    rest = settled(training, counts, seeds, of, class_pairs(m, of))
    by_cell = F.element_at(F.lit([int(k) for k in cell_class]), (F.col("h").bitwiseAND(CELLS - 1) + 1).cast("int")).cast("smallint")
    own = named if rest is None else rest.unionByName(named)
    words = written(counts.join(own, "h", "left").select("h", "c", "total", F.coalesce("k", by_cell).alias("k")), "words")
    remove(spark, counts, *([] if rest is None else [rest]))
    n_class, v_class = np.zeros(CLASSES), np.zeros(CLASSES)
    for k, n, v in words.where("c > 0").groupBy("k").agg(F.sum("c"), F.count("*")).collect():  # CLASSES rows
        n_class[k], v_class[k] = n, v
    least = least_of(words, "total", FREQUENT)
    got = words.where(F.col("total") >= least).select("h", "c", "k").toArrow()  # FREQUENT rows at most
    h = got.column("h").to_numpy().view(np.uint64)
    order = np.argsort(h)
    c, k = (got.column(x).to_numpy()[order] for x in ("c", "k"))
    return Model(least, h[order], c, k.astype(np.uint8), n_class, v_class, ends), words


def sequences(docs: DataFrame, model: Model, words: DataFrame) -> DataFrame:
    """doc_id, training, n_tokens, n_known, base, emit and classes (a byte a token, the end last) for each
    row of docs (doc_id, text binary, training)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = ["row", "doc_id", "training", "n_tokens", "n_known", "base", "emit", "classes", "rare"]

    def run(batches):
        own = shared.value
        find = Lookup(own.frequent)
        known = np.append(own.counts > 0, False).astype(np.int64)
        base = np.append(np.log10((own.counts + 0.5) / own.base_total), 0.0)
        emit = np.append(np.log10((own.counts + 0.5) / own.class_total[own.of]), 0.0)
        of = np.append(own.of, np.uint8(SEEN_LATER))
        row = TaskContext.get().partitionId() << 40
        for b, texts in ((p, t) for b in batches for p, t in chunks([b], "text")):
            h, _, n = tokens(texts)
            at = find(h)  # -1: the last of each array
            ends = np.cumsum(n)
            total = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[ends], prepend=0)
            rare = np.flatnonzero(at < 0)
            k = np.insert(of[at], ends, END)
            cut = ends + np.arange(1, len(n) + 1)
            classes = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(np.append(0, cut).astype(np.int32)), pa.py_buffer(k)])
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(rare, np.append(0, ends)).astype(np.int32)), pa.array(signed(h[rare])))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(row, row + len(n))), b.column("doc_id"), b.column("training"), pa.array(n + 1), pa.array(total(known[at]) + int(own.ends > 0)),
                 pa.array(sums(base[at], n) + own.end_base), pa.array(sums(emit[at], n)), classes, lists], names,
            )
            row += len(n)

    schema = "row long, doc_id long, training boolean, n_tokens long, n_known long, base double, emit double, classes binary, rare array<long>"
    parts = written(docs.select("doc_id", "text", "training").mapInArrow(run, schema), "sequences")
    rare = parts.select("row", F.posexplode("rare").alias("i", "h"))
    class_total = F.element_at(F.lit([float(x) for x in model.class_total]), F.col("k") + 1)
    added = (
        rare.join(words.where(F.col("total") < model.least).select("h", "c", "k"), "h")
        .groupBy("row").agg(
            F.sum((F.col("c") > 0).cast("long")).alias("known2"),
            F.sum(F.log10((F.col("c") + 0.5) / F.lit(float(model.base_total)))).alias("base2"),
            F.sum(F.log10((F.col("c") + 0.5) / class_total)).alias("emit2"),
            F.transform(F.array_sort(F.collect_list(F.col("i").cast("long") * 256 + F.col("k"))), lambda x: (x % 256).cast("smallint")).alias("later"),
        )
    )
    zero = lambda c: F.coalesce(c, F.lit(0))
    return parts.drop("rare").join(added, "row", "left").select(
        "doc_id", "training", "n_tokens", (F.col("n_known") + zero("known2")).alias("n_known"),
        (F.col("base") + zero("base2")).alias("base"), (F.col("emit") + zero("emit2")).alias("emit"), "classes", "later",
    )


def sums(x: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of n numbers."""
    out, some = np.zeros(len(n)), n > 0
    if len(x):
        out[some] = np.add.reduceat(x, (np.cumsum(n) - n)[some])
    return out


def filled(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The classes of a batch's texts one after another, and their numbers."""
    classes = b.column("classes").to_pylist()
    k = np.frombuffer(b"".join(classes), np.uint8).copy()
    later = b.column("later").flatten()
    k[k == SEEN_LATER] = later.to_numpy().astype(np.uint8)
    return k, np.array([len(x) for x in classes])


def sequence_pairs(found: DataFrame, classes: int = CLASSES) -> np.ndarray:
    """Counts of class pairs over sequences; the end token also stands before a text."""

    def run(batches):
        g = np.zeros(classes * classes, np.int64)
        for b in batches:
            if b.num_rows:
                k = np.append(np.uint8(END), filled(b)[0]).astype(np.int64)  # a text's end stands before the next one
                g += np.bincount(k[:-1] * classes + k[1:], minlength=classes * classes)
        return g

    return pair_counts(found.select("classes", "later"), run, classes)


def score(docs: DataFrame, model: Model, words: DataFrame) -> DataFrame:
    """doc_id, training, n_tokens, n_known, train_tokens, base_score, score, perplexity for each row
    of docs (doc_id, text binary, training)."""
    found = written(sequences(docs, model, words), "class-sequences")
    shared = docs.sparkSession.sparkContext.broadcast(transitions(sequence_pairs(found.where("training"))))

    def run(batches):
        step = shared.value
        for b in batches:
            if b.num_rows:
                k, n = filled(b)
                moves = sums(step[np.append(np.uint8(END), k[:-1]), k], n)
                total = pa.array(moves + b.column("emit").to_numpy())
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "training", "n_tokens", "n_known", "base")), total], ["doc_id", "training", "n_tokens", "n_known", "base", "score"])

    scored = found.mapInArrow(run, "doc_id long, training boolean, n_tokens long, n_known long, base double, score double")
    return scored.select(
        "doc_id", "training", "n_tokens", "n_known", F.lit(model.n).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), "score"
    ).withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), (crc_mod(F.col("doc_id"), 5) != 1).alias("training"))
    return score(docs, *learn(docs)).select("doc_id", (~F.col("training")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")
