"""Operator 8: quality rules with risk-controlled thresholds.

Per text, line and word statistics; four of them, as shares of limits that are usual for web text
(LIMITS, fixed beforehand, not learnt), are on one scale, and the largest is the text's score.

The rule of a stratum (language) is "reject if the score is over a cutoff", learnt from labelled
rows used only for that (holdouts: no rule is fitted to them beforehand). Cutoffs are tested from the loosest to the strictest: the null hypothesis "more than ALPHA
of the good documents are rejected" is tested with the exact binomial upper bound (Clopper-Pearson).
Tests stop at the first that fails (fixed-sequence testing, no correction within a stratum); over
strata the level is divided by their number (Bonferroni); with one score, ALPHA is not divided. With
probability 1 - DELTA, all strata at once, at most ALPHA of the good documents are rejected by the
rule. Of the certified cutoffs the loosest is taken that still rejects ENOUGH of the bad documents
that the strictest would. With four strata 144 good labels that pass the base rule are enough. Strata
with fewer, for which no cutoff could be certified, and languages without labels are one stratum
together, whose rule is certified for their documents as a whole; if that is too small as well, it
has no cutoff, and its documents are kept.

What the labels give is counted by Spark on a fixed grid of cutoffs: strata x grid rows.

Defined cases: null and empty texts have zeros everywhere and fail the base rule; a null language
is a stratum of its own; labels that are null or of repeated documents count as given, each row;
empty tables give no rows or no cutoffs; further columns are ignored.
"""

from __future__ import annotations

from math import ceil, exp, lgamma, log, log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import table, written
from .text import SPACE, chunk_words, chunks, shingles

ALPHA, DELTA, GRID, ENOUGH = 0.03, 0.05, 100, 0.95
#: The stratum of all languages without enough labels.
OTHERS = "\x00others"
#: Share of the text that each rule looks at, in 0..1; higher is worse.
RULES = ("marks", "shouting", "duplicate_lines", "repeated_words")
#: A share of so much counts as 1 in the score, of which STEPS grid cells make 1.
LIMITS, STEPS = {"marks": 0.1, "shouting": 0.3, "duplicate_lines": 0.3, "repeated_words": 0.3}, 25
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_marks")
_symbol = np.zeros(256, bool)
_symbol[list(b"#*$%&|<>")] = True
_mark = _symbol.copy()
_mark[ord("!")] = True
_upper = np.zeros(256, bool)
_upper[65:91] = True
_letter = _upper.copy()
_letter[97:123] = True


def statistics(raw: bytes, words: np.ndarray) -> tuple[int, ...]:
    """COUNTS of one text."""
    n = len(words)
    if not n:
        return (0,) * len(COUNTS)
    seen = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    chars = int(seen.sum() - seen[0x80:0xC0].sum() - seen[SPACE].sum())
    lines = [x for x in raw.split(b"\n") if x.strip(b" \t\r\x0b\x0c")]
    repeats = 0
    if n > 3:
        _, which, times = np.unique(shingles(words, 3), return_inverse=True, return_counts=True)
        again = times[which] > 1
        covered = np.zeros(n, bool)
        for i in range(3):
            covered[i : n - 2 + i] |= again
        repeats = int(covered.sum())
    upper, letters = int(seen[_upper].sum()), int(seen[_letter].sum())
    return (n, chars, int(seen[_symbol].sum()), len(lines) - len(set(lines)), repeats, len(lines), upper, letters, int(seen[_mark].sum()))


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, lang and COUNTS for each row of docs (doc_id, text, lang)."""
    fields = ["doc_id", "lang", *COUNTS]

    def run(batches):
        for b, texts in chunks(batches, "text"):
            rows = np.array([statistics(t, w) for t, w in zip(texts, chunk_words(texts, fold=False))], np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("lang"), *map(pa.array, rows.T)], fields)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("binary").alias("text")).mapInArrow(
        run, "doc_id long, lang string, " + ", ".join(f"{c} long" for c in COUNTS)
    )


def shares() -> dict:
    """Each rule's statistic as an expression over COUNTS, null where it has no denominator."""
    part = lambda a, b: F.least(F.lit(1.0), F.col(a) / F.when(F.col(b) > 0, F.col(b)))
    return {
        "marks": part("n_marks", "word_chars"), "shouting": part("n_upper", "n_letters"), "duplicate_lines": part("n_dup_lines", "n_lines"),
        "repeated_words": part("n_repeat_words", "n_words"),
    }


def base_failed():
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def binomial_cdf(k: int, n: int, p: float) -> float:
    if p <= 0 or k >= n:
        return 1.0
    if p >= 1:
        return 0.0
    logs = [lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * log(p) + (n - i) * log1p(-p) for i in range(k + 1)]
    top = max(logs)
    return min(1.0, exp(top) * sum(exp(x - top) for x in logs))


def certified(rejected: int, n: int, alpha: float, delta: float) -> bool:
    """The exact upper bound (level delta) of a rejection rate seen as rejected of n is at most alpha."""
    return n > 0 and rejected < alpha * n and binomial_cdf(rejected, n, alpha) <= delta


def labels_needed(tests: int, alpha: float = ALPHA, delta: float = DELTA) -> int:
    """Good documents without which nothing can be certified in one of so many strata."""
    return ceil(log(delta / max(1, tests)) / log1p(-alpha))


def cutoffs(counts: dict[str, np.ndarray], alpha: float = ALPHA, delta: float = DELTA) -> dict[str, int]:
    """counts: by stratum, bad (row 0) and good (row 1) documents by grid cell of their score. The
    chosen cutoff cell c of each: reject a document whose cell is over c."""
    found = {}
    for key, (bad, good) in counts.items():
        n, rejected, passed = int(good.sum()), 0, []
        for c in range(GRID - 1, -1, -1):
            rejected += int(good[c + 1])
            if not certified(rejected, n, alpha, delta / len(counts)):
                break
            passed.append((c, int(bad[c + 1 :].sum())))
        if passed and passed[-1][1]:
            found[key] = next(c for c, hit in passed if hit >= ENOUGH * passed[-1][1])
    return found


def stratum():
    return F.coalesce("lang", F.lit(""))


def cells() -> dict:
    """Each rule's grid cell 0..GRID as an expression; the score's is the largest."""
    return {r: F.least(F.lit(GRID), F.coalesce(F.ceil(x / LIMITS[r] * STEPS), F.lit(0))).cast("int") for r, x in shares().items()}


def learn(stats: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> dict[str, int]:
    """Each stratum's cutoff of the score, from the rows of stats (of measured()) that labels (doc_id,
    quality) covers; OTHERS stands for all strata without enough labels."""
    marked = labels.where("quality IN (0, 1)").select(F.col("doc_id").cast("long").alias("doc_id"), "quality")
    grid = (
        stats.where(~base_failed()).join(marked, "doc_id")
        .groupBy(stratum().alias("stratum"), "quality", F.greatest(*cells().values()).alias("cell")).count()
    )
    counts: dict[str, np.ndarray] = {}
    for s, quality, c, n in grid.collect():  # languages x 2 x (GRID + 1) rows at most
        counts.setdefault(s, np.zeros((2, GRID + 1), np.int64))[quality, c] += n
    need = labels_needed(len(counts), alpha, delta)
    few = [s for s, n in counts.items() if n[1].sum() < need]
    if few:
        counts[OTHERS] = sum(counts.pop(s) for s in few)
    return cutoffs(counts, alpha, delta)


def judged(stats: DataFrame, found: dict[str, int]) -> DataFrame:
    """stats with base_failed, kept and reasons."""
    others = F.lit(found.get(OTHERS, GRID))
    own = [F.lit(x) for s, c in found.items() if s != OTHERS for x in (s, c)]
    limit = F.coalesce(F.element_at(F.create_map(*own), stratum()), others) if own else others
    reject = [F.when(c > limit, F.lit(rule)) for rule, c in cells().items()]
    return stats.withColumn("base_failed", base_failed()).withColumn("reasons", F.array_compact(F.array(*reject))).withColumn("kept", ~F.col("base_failed") & (F.size("reasons") == 0))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = measured(table(spark, sf_dir, "documents"))
    stats = written(stats, "quality-statistics")
    found = learn(stats, table(spark, sf_dir, "labels"))
    return judged(stats, found).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
