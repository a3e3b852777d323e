"""Operator 9: document quality from a linear-chain conditional random field over lines.

Every line with a word gets FEATURES statistics, cut into bins; the field's states are bad and
good, its evidence is the bins of the line and of its two neighbours, its transitions link lines.
Training: a document is one chain, however long, and its lines carry its label; gradient ascent on the penalised log-likelihood over
at most about SAMPLE labelled documents (the smallest hashes of their ids, a documented bound: the
model has a few hundred numbers). Scoring: forward-backward gives each line's probability of being
good, and their mean weighted by line length, on a logistic scale fitted to the training
documents, is the document's score.

Features, forward and backward steps are NumPy over all lines of a chunk of documents; a step is
taken for all documents at once. Bytes are read in slices; lines, and word and line repeats, are
those of the whole text, however long: what is held of a text is eight bytes a word and its lines.

The driver gets at most LINES lines of the sample: its documents in the order of the hashes of
their ids, each taken if its lines still fit.

Defined cases: null and empty texts and texts without a word score 0; without labels of both kinds
every other text scores 0.5; repeated rows are scored each; labels that are null, or of a
document without text, teach nothing; a null doc_id counts as empty text for the split; further
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import crc_mod, remove, table, written
from .text import SLICE, chunks, hash_spans, mix, slices, spans

SAMPLE, LINES, CUT, STEPS, RATE, DECAY, THRESHOLD = 8_000, 400_000, 64, 150, 0.1, 1e-3, 0.3
#: Upper edges of the bins of each statistic; all but the first and the third from last are shares.
EDGES = {
    "words": [1, 2, 4, 8, 16, 32, 64, 128],
    "marks": [0, 0.005, 0.02, 0.05, 0.1, 0.2, 0.4],
    "upper": [0, 0.01, 0.03, 0.06, 0.12, 0.25, 0.5, 0.8],
    "digits": [0, 0.01, 0.05, 0.1, 0.2, 0.4],
    "stops": [0, 0.01, 0.02, 0.04, 0.08, 0.15],
    "same_as_last": [0, 0.01, 0.05, 0.1, 0.3, 0.6],
    "distinct": [0.1, 0.25, 0.5, 0.7, 0.8, 0.9, 0.97],
    "word_length": [2, 3, 4, 5, 6, 8, 12],
    "repeated_triples": [0, 0.02, 0.05, 0.1, 0.25, 0.5, 0.8],
    "again": [0],
}
WIDTH = 10
SIZE = len(EDGES) * WIDTH
_kinds = np.zeros((5, 256), np.uint8)
_kinds[0, list(b"#*$%&|<>!")] = 1
_kinds[1, 65:91] = 1
_kinds[2, 48:58] = 1
_kinds[3, list(b".,;:?")] = 1
_kinds[4, 65:91] = _kinds[4, 97:123] = _kinds[4, 0xC0:] = 1


def again(keys: np.ndarray, groups: np.ndarray) -> np.ndarray:
    """Whether each key stood earlier in its group, or stands later: (earlier, any other place)."""
    own = mix(keys ^ mix(groups.astype(np.uint64)))
    order = np.argsort(own, kind="stable")
    own = own[order]
    equal = own[1:] == own[:-1]
    earlier = np.zeros(len(own), bool)
    earlier[order[1:][equal]] = True
    twice = earlier.copy()
    twice[order[:-1][equal]] = True
    return earlier, twice


def pieces(texts: list[bytes]):
    """Byte arrays of the texts one after another, each ended by a newline, cut at white space."""
    held, size = [], 0
    for t in texts:
        if size and size + len(t) > SLICE:
            yield np.frombuffer(b"\n".join(held) + b"\n", np.uint8)
            held, size = [], 0
        if len(t) > SLICE:
            for piece in slices(t):
                yield np.frombuffer(piece, np.uint8)
            t = b""  # its newline
        held.append(t)
        size += len(t) + 1
    if held:
        yield np.frombuffer(b"\n".join(held) + b"\n", np.uint8)


def chunk_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bins (lines x features), byte lengths, and documents of all lines with a word."""
    hashes, lines, parts, at = [], [], [], 0
    for buf in pieces(texts):
        starts, ends = spans(buf)
        breaks = np.flatnonzero(buf == 10)
        if len(starts):
            line = np.searchsorted(breaks, starts) + at
            first = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]]))
            sums = [np.add.reduceat(ends - starts, first), *(np.add.reduceat(kind[buf], starts[first], dtype=np.int64) for kind in _kinds)]  # white space is of no kind
            hashes.append(hash_spans(buf, starts, ends))
            lines.append(line)
            parts.append(np.stack([line[first], *sums]))
        at += len(breaks)
    if not hashes:
        return np.zeros((0, len(EDGES)), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    hashes, line, parts = np.concatenate(hashes), np.concatenate(lines), np.concatenate(parts, axis=1)
    fresh = np.concatenate([[True], line[1:] != line[:-1]])
    first = np.flatnonzero(fresh)  # first word of each line
    n = np.diff(np.concatenate([first, [len(line)]]))
    joined = np.flatnonzero(np.concatenate([[True], parts[0, 1:] != parts[0, :-1]]))  # a line may lie in several pieces
    sums, marks, upper, digits, stops, letters = np.add.reduceat(parts[1:], joined, axis=1)
    doc = np.searchsorted(np.cumsum([t.count(b"\n") + 1 for t in texts]), line[first], "right")
    line = np.cumsum(fresh) - 1
    same = np.concatenate([[False], hashes[1:] == hashes[:-1]]) & ~fresh
    repeated, _ = again(hashes, line)
    triples = np.zeros(len(hashes), bool)
    if len(hashes) > 2:
        key = mix(mix(hashes[:-2]) + hashes[1:-1] * np.uint64(3) + mix(hashes[2:] ^ np.uint64(77)))
        inside = np.flatnonzero(doc[line[:-2]] == doc[line[2:]])  # not the last words of one text and the first of the next
        triples[inside] = again(key[inside], doc[line[inside]])[1]
    of_line = lambda x: np.add.reduceat(x.astype(np.int64), first)
    whole = np.add.reduceat(mix(hashes + (np.arange(len(hashes)) - first[line]).astype(np.uint64)), first)
    seen, _ = again(whole, doc)
    stats = [n, marks / sums, upper / np.maximum(letters, 1), digits / sums, stops / sums, of_line(same) / n, 1 - of_line(repeated) / n, sums / n, of_line(triples) / n, seen]
    bins = np.stack([np.searchsorted(e, s, "left") for e, s in zip(EDGES.values(), stats)], axis=1)
    return bins + np.arange(len(EDGES)) * WIDTH, sums, doc


def evidence(bins: np.ndarray, doc: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Log-odds of good for each line. w: 3 x (SIZE + 1): own, line before, line after; the last
    number of a row is for a missing neighbour (own: the constant)."""
    value = w[:, :-1][:, bins].sum(2)
    joined = doc[1:] == doc[:-1]
    before = np.full(len(bins), w[1, -1])
    before[1:][joined] = value[1, :-1][joined]
    after = np.full(len(bins), w[2, -1])
    after[:-1][joined] = value[2, 1:][joined]
    return value[0] + w[0, -1] + before + after


def _through(x: np.ndarray, to0: tuple[float, float], to1: tuple[float, float]) -> np.ndarray:
    """log(e^to1[0] + e^(to1[1] + x)) - log(e^to0[0] + e^(to0[1] + x))"""
    return np.logaddexp(to1[0], to1[1] + x) - np.logaddexp(to0[0], to0[1] + x)


def forward(e: np.ndarray, n: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Log-odds of good for each line from its own evidence and the lines before it, for chains that lie one after
    another in e, n lines each. t: 2 x 2 transitions (before, after).

    A step is taken for all chains at once. Chains of over CUT lines are taken in runs of CUT: what a run
    makes of either state before it is found for all runs at once, then the runs of a chain are linked in turn, which
    gives the same numbers in CUT + n / CUT steps."""
    into_bad, into_good = (t[0, 0], t[1, 0]), (t[0, 1], t[1, 1])
    runs = -(-n // CUT)
    chain = np.repeat(np.arange(len(n)), runs)
    place = np.arange(len(chain)) - np.repeat(np.cumsum(runs) - runs, runs)
    first = (np.cumsum(n) - n)[chain] + place * CUT
    size = np.minimum(CUT, n[chain] - place * CUT)
    a = e.copy()

    def along(which: np.ndarray, step) -> None:
        order = which[np.argsort(-size[which], kind="stable")]
        longest = int(size[order[0]]) if len(order) else 0
        live = np.searchsorted(-size[order], -np.arange(longest), "left")  # runs of more than i lines
        for i in range(1, longest):
            step(order[: live[i]], first[order[: live[i]]] + i)

    def value(_, here):
        a[here] = e[here] + _through(a[here - 1], into_bad, into_good)

    along(np.flatnonzero(place == 0), value)
    later = np.flatnonzero(place > 0)
    if not len(later):
        return a
    # weight of bad and log-odds behind each run, after a bad and after a good line
    bad, odd = np.zeros((2, len(chain))), np.zeros((2, len(chain)))
    for k in (0, 1):
        bad[k, later], odd[k, later] = t[k, 0], e[first[later]] + t[k, 1] - t[k, 0]

    def both(run, here):
        for k in (0, 1):
            bad[k, run] += np.logaddexp(into_bad[0], into_bad[1] + odd[k, run])
            odd[k, run] = e[here] + _through(odd[k, run], into_bad, into_good)

    along(later, both)
    out, before = np.zeros(len(chain)), np.zeros(len(chain))
    out[place == 0] = a[(first + size - 1)[place == 0]]
    turn = later[np.argsort(place[later], kind="stable")]
    for own in np.split(turn, np.flatnonzero(np.diff(place[turn])) + 1):
        x = before[own] = out[own - 1]
        out[own] = np.logaddexp(bad[0, own] + odd[0, own], x + bad[1, own] + odd[1, own]) - np.logaddexp(bad[0, own], x + bad[1, own])
    a[first[later]] = e[first[later]] + _through(before[later], into_bad, into_good)
    along(later, value)
    return a


def messages(e: np.ndarray, n: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward log-odds of chains. Forward includes a line's own evidence, backward doesn't."""
    c = forward(e[::-1], n[::-1], t.T)[::-1]
    b = np.zeros(len(e))
    if len(e):
        b[:-1] = _through(c[1:], (t[0, 0], t[0, 1]), (t[1, 0], t[1, 1]))
        b[np.cumsum(n) - 1] = 0
    return forward(e, n, t), b


def odds(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def gradient(bins: np.ndarray, chain: np.ndarray, n: np.ndarray, y: np.ndarray, w: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the log-likelihood of labels y (1: good) with respect to weights and transitions."""
    joined = chain[1:] == chain[:-1]
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[:-1][joined].astype(int), y[1:][joined].astype(int)), 1)
    e = evidence(bins, chain, w)
    a, b = messages(e, n, t)
    d = y - odds(a + b)
    gw = np.zeros_like(w)
    gw[0, :-1] = np.bincount(bins.ravel(), np.repeat(d, bins.shape[1]), SIZE)
    gw[0, -1] = d.sum()
    for row, (own, other) in ((1, (slice(1, None), slice(None, -1))), (2, (slice(None, -1), slice(1, None)))):
        gw[row, :-1] = np.bincount(bins[other][joined].ravel(), np.repeat(d[own][joined], bins.shape[1]), SIZE)
        gw[row, -1] = d.sum() - d[own][joined].sum()
    x, z = a[:-1][joined], (e + b)[1:][joined]
    pair = np.stack([t[0, 0] + 0 * x, t[0, 1] + z, t[1, 0] + x, t[1, 1] + x + z])
    pair = np.exp(pair - pair.max(0))
    return gw, seen - (pair / pair.sum(0)).sum(1).reshape(2, 2)


def train(bins: np.ndarray, chain: np.ndarray, good: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights and transitions from lines in chains (consecutive numbers), each labelled good or not."""
    w, t = np.zeros((3, SIZE + 1)), np.zeros((2, 2))
    n = np.bincount(chain)
    y = good.astype(float)
    lines = len(y)
    m1 = [np.zeros_like(w), np.zeros_like(t)]
    m2 = [np.zeros_like(w), np.zeros_like(t)]
    for step in range(1, STEPS + 1):
        gw, gt = gradient(bins, chain, n, y, w, t)
        for v, g, p, q in ((w, gw, m1[0], m2[0]), (t, gt, m1[1], m2[1])):
            g = g / lines - DECAY * v
            p += 0.1 * (g - p)
            q += 0.01 * (g * g - q)
            v += RATE * (p / (1 - 0.9**step)) / (np.sqrt(q / (1 - 0.99**step)) + 1e-8)
    return w, t


def weighted(bins: np.ndarray, size: np.ndarray, doc: np.ndarray, w: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Documents with a line, and the log-odds of the mean of their lines' probabilities weighted by size."""
    which, n = np.unique(doc, return_counts=True)
    p = odds(sum(messages(evidence(bins, doc, w), n, t)))
    first = np.concatenate([[0], np.cumsum(n)[:-1]])
    q = np.clip(np.add.reduceat(p * size, first) / np.add.reduceat(size, first), 1e-4, 1 - 1e-4)
    return which, np.log(q / (1 - q))


def scale(x: np.ndarray, good: np.ndarray) -> np.ndarray:
    """Intercept and slope of a logistic regression of good on x, by Newton's method with a small penalty."""
    b, m = np.array([0.0, 1.0]), np.stack([np.ones(len(x)), x], 1)
    for _ in range(50):
        p = odds(m @ b)
        b = b + np.linalg.solve((m * (p * (1 - p))[:, None]).T @ m + np.eye(2), m.T @ (good - p) - (b - [0, 1]))
    return np.array([b[0], max(b[1], 0.01)])


def training_rows(docs: DataFrame, labels: DataFrame, sample: int, most: int) -> list[dict]:
    """quality, bins and sizes of the lines of about sample labelled documents, of most lines together."""
    marked = labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("__id"), F.col("quality").cast("int").alias("quality"))
    share = min(1.0, sample / max(1, marked.count()))
    place = F.pmod(F.xxhash64("__id", F.lit("crf")), F.lit(1 << 30))
    # the smallest hashes: about sample rows, and never more than twice as many
    few = marked.where(place < int(share * (1 << 30))).withColumn("place", place).orderBy("place", "__id", "quality").limit(2 * sample)
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).join(F.broadcast(few), F.col("doc_id") == F.col("__id"))

    def run(batches):
        for b, texts in chunks(batches, "text"):
            bins, size, doc = chunk_features(texts)
            cut = [(i, j) for i, j in zip(*(np.searchsorted(doc, np.arange(len(texts)), side) for side in ("left", "right")))]
            cols = [[j - i for i, j in cut], [bins[i:j].astype(np.uint8).tobytes() for i, j in cut], [size[i:j].tobytes() for i, j in cut]]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("place", "doc_id", "quality")), pa.array(cols[0], pa.int64()), *(pa.array(c, pa.binary()) for c in cols[1:])], ["place", "doc_id", "quality", "n", "bins", "sizes"])

    kept = chosen.select("place", "doc_id", "quality", "text").mapInArrow(run, "place long, doc_id long, quality int, n long, bins binary, sizes binary")
    kept = written(kept.where("n > 0").withColumn("mark", F.xxhash64("bins", "sizes")), "labelled-lines")
    keys = ["place", "doc_id", "quality", "mark"]
    left, fits = most, []
    for r in kept.select(*keys, "n").orderBy(*keys).limit(2 * sample).collect():  # a few numbers each
        if r["n"] <= left:
            left -= r["n"]
            fits.append(tuple(r[k] for k in keys))
    if not fits:
        return []
    ids = docs.sparkSession.createDataFrame(sorted(set(fits)), "place long, doc_id long, quality int, mark long")
    got = kept.join(F.broadcast(ids), keys).orderBy(*keys).limit(len(fits)).select("quality", "bins", "sizes").toArrow().to_pylist()
    remove(docs.sparkSession, kept)
    return got


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, most: int = LINES) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Weights, transitions and scale from docs (doc_id, text) and labels (doc_id, quality); None without both kinds."""
    rows = training_rows(docs, labels, sample, most)
    if len({r["quality"] for r in rows}) < 2:
        return None
    lines = [np.frombuffer(r["bins"], np.uint8).astype(np.int64).reshape(-1, len(EDGES)) for r in rows]
    n = np.array([len(x) for x in lines])
    bins, doc = np.concatenate(lines), np.repeat(np.arange(len(n)), n)
    good = np.array([r["quality"] == 1 for r in rows])
    w, t = train(bins, doc, good[doc])
    x = weighted(bins, np.concatenate([np.frombuffer(r["sizes"], np.int64) for r in rows]), doc, w, t)[1]
    return w, t, scale(x, good.astype(float))


def quality(texts: list[bytes], model: tuple[np.ndarray, np.ndarray, np.ndarray] | None) -> np.ndarray:
    """The score of each text."""
    score = np.zeros(len(texts))
    bins, size, doc = chunk_features(texts)
    if not len(bins):
        return score
    if model is None:
        score[np.unique(doc)] = 0.5
        return score
    w, t, (at, slope) = model
    which, x = weighted(bins, size, doc, w, t)
    score[which] = odds(at + slope * x)
    return score


def scores(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, np.ndarray] | None) -> DataFrame:
    """doc_id, score for each row of docs (doc_id, text)."""

    def run(batches):
        for b, texts in chunks(batches, "text"):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(quality(texts, model))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, score double")


def keep_good(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, np.ndarray] | None, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose text scores threshold or more, with all their columns."""

    def run(batches):
        for b in batches:
            for part, texts in chunks([b], "text"):
                texts = [t.encode() if isinstance(t, str) else t for t in texts]
                yield part.filter(pa.array(quality(texts, model) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def training_part(docs: DataFrame) -> DataFrame:
    return docs.where(crc_mod(F.col("doc_id"), 5) != 0)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = learn(training_part(docs), training_part(labels))
    return scores(docs, model).select(
        "doc_id", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted")
    )
