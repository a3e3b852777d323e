"""Operator 7: language identification by multilingual mixture inference.

Learning: byte trigram counts (hashed into a fixed number of cells, words bounded by one space,
A-Z lower-cased) per labelled language, summed over all training documents by Spark; the model
has languages x CELLS numbers, whatever the input. Inference: a document is a mixture of
languages; each word's likelihood under each language is the product over its trigrams, and
expectation-maximisation estimates the proportions. The set of languages is the one of the j most
frequent, j = 1, 2, ..., with the best log-likelihood less PENALTY * log(words) per language.

Defined cases: null texts and texts without a letter are `und` with score 0, as is everything if
there is nothing to learn from; rows with null language or text teach nothing; repeated rows count
each; ties between languages go to the first by name; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import crc_mod, table
from .text import LOWER, SPACE, chunks, slices

CELLS = 1 << 16
ROUNDS, PENALTY, SMOOTH = 12, 3.0, 0.05
_letter = np.zeros(256, bool)
_letter[65:91] = _letter[97:123] = _letter[128:] = True
_flat = LOWER.copy()
_flat[SPACE] = 32


def trigrams(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Cell of the trigram that ends at each byte after the first of a word, its trailing space
    included; and where in that array each word starts."""
    buf = np.concatenate([[32, 32], _flat[np.frombuffer(raw, np.uint8)], [32]]).astype(np.uint32)
    code = (buf[:-2] << 16) | (buf[1:-1] << 8) | buf[2:]
    cells = ((code * np.uint32(2654435761)) >> np.uint32(16)).astype(np.int32)
    inside = buf[1:-1] != 32  # the middle byte is of a word
    first = inside & (buf[:-2] == 32)
    kept = np.flatnonzero(inside)
    return cells[kept], np.flatnonzero(first[kept])


def count_cells(docs: DataFrame) -> DataFrame:
    """lang, cell, n over docs (text binary, lang)."""

    def run(batches):
        held: dict[str, np.ndarray] = {}
        for b, texts in chunks(batches, "text"):
            for lang, t in zip(b.column("lang").to_pylist(), texts):
                own = held.setdefault(lang, np.zeros(CELLS, np.int64))
                for piece in slices(t):
                    own += np.bincount(trigrams(piece)[0], minlength=CELLS)
        for lang, own in held.items():
            some = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some)), pa.array(some.astype(np.int32)), pa.array(own[some])], ["lang", "cell", "n"])

    return docs.mapInArrow(run, "lang string, cell int, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n"))


def learn(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages by name, and log-likelihoods (CELLS x languages) from docs (text, lang)."""
    rows = docs.where("lang IS NOT NULL AND text IS NOT NULL").select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("binary").alias("text"))
    got = count_cells(rows).toArrow()
    langs = sorted(set(got.column("lang").to_pylist()))
    n = np.zeros((CELLS, len(langs)))
    if langs:
        at = {x: i for i, x in enumerate(langs)}
        n[got.column("cell").to_numpy(), [at[x] for x in got.column("lang").to_pylist()]] = got.column("n").to_numpy()
    p = (n + SMOOTH) / (n + SMOOTH).sum(0, keepdims=True) if langs else n
    return langs, np.log(p, where=p > 0, out=np.zeros_like(p)).astype(np.float32)


def fit(like: np.ndarray, doc: np.ndarray, first: np.ndarray, n: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proportions and log-likelihoods of documents. like: words x languages, scaled to a largest
    value of 1; doc: each word's document; first, n: each document's first word and words."""
    p = allowed / allowed.sum(1, keepdims=True)
    for _ in range(ROUNDS):
        r = like * p[doc]
        r /= np.maximum(r.sum(1, keepdims=True), 1e-30)
        p = np.add.reduceat(r, first, axis=0) / n[:, None]
    return p, np.add.reduceat(np.log(np.maximum((like * p[doc]).sum(1), 1e-30)), first)


def infer(words: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proportions (documents x languages) and the chosen languages. words: log-likelihoods by
    language of all documents' words in order; n: words of each document, none 0."""
    k = words.shape[1]
    first = np.concatenate([[0], np.cumsum(n)[:-1]])
    doc = np.repeat(np.arange(len(n)), n)
    top = words.max(1)
    like = np.exp(words - top[:, None])
    p, full = fit(like, doc, first, n, np.ones((len(n), k)))
    order = np.argsort(-p, axis=1, kind="stable")
    cost = PENALTY * np.log(n + 1.0)
    one = np.add.reduceat(words, first, axis=0) - np.add.reduceat(top, first)[:, None]
    best_language = one.argmax(1)
    best = one.max(1) - cost
    props = np.zeros_like(p)
    props[np.arange(len(n)), best_language] = 1.0
    chosen = props > 0
    for j in range(2, k + 1):
        open_ = np.flatnonzero(full - j * cost > best)  # no set of j can do better than all languages
        if not len(open_):
            break
        allowed = np.zeros((len(open_), k))
        np.put_along_axis(allowed, order[open_, :j], 1.0, axis=1)
        mask = np.isin(doc, open_)
        m = n[open_]
        q, value = fit(like[mask], np.repeat(np.arange(len(m)), m), np.concatenate([[0], np.cumsum(m)[:-1]]), m, allowed)
        better = value - j * cost[open_] > best[open_]
        best[open_[better]] = (value - j * cost[open_])[better]
        props[open_[better]] = q[better]
        chosen[open_[better]] = allowed[better] > 0
    return props, chosen


def word_likelihoods(raw: bytes, table_: np.ndarray) -> np.ndarray:
    parts = []
    for piece in slices(raw):
        cells, first = trigrams(piece)
        if len(first):
            parts.append(np.add.reduceat(table_[cells], first, axis=0))
    return np.concatenate(parts) if parts else np.zeros((0, table_.shape[1]), np.float32)


def has_letter(raw: bytes) -> bool:
    seen = _letter[np.frombuffer(raw, np.uint8)] if raw else np.zeros(0, bool)
    if not seen.any():
        return False
    return any(c.isalpha() for c in raw.decode("utf-8", "replace"))


def predict(docs: DataFrame, langs: list[str], model: np.ndarray) -> DataFrame:
    """doc_id, lang_pred, score (its proportion) and languages (all chosen, with proportions)."""
    schema = "doc_id long, lang_pred string, score double, languages map<string,double>"
    shared = docs.sparkSession.sparkContext.broadcast(model)  # CELLS x languages

    def run(batches):
        table_ = shared.value
        for b, texts in chunks(batches, "text", 1 << 20):
            words, known = [], []
            for i, t in enumerate(texts):
                if langs and has_letter(t):
                    w = word_likelihoods(t, table_)
                    if len(w):
                        words.append(w)
                        known.append(i)
            pred, score, sets = ["und"] * len(texts), [0.0] * len(texts), [[] for _ in texts]
            if known:
                props, chosen = infer(np.concatenate(words).astype(np.float64), np.array([len(w) for w in words]))
                for i, p, c in zip(known, props, chosen):
                    pred[i], score[i] = langs[int(p.argmax())], float(min(1.0, p.max()))
                    sets[i] = [(langs[x], float(p[x])) for x in np.flatnonzero(c)]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(pred), pa.array(score), pa.array(sets, pa.map_(pa.string(), pa.float64()))], ["doc_id", "lang_pred", "score", "languages"]
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, schema)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    part = crc_mod(F.col("doc_id"), 4)
    model = learn(docs.where(part != 2))
    return predict(docs, *model).select("doc_id", (part == 2).alias("held_out"), "lang_pred", "score", "languages")
