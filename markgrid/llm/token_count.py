"""Operator 5: token counts of a unigram tokenizer without its tokens.

Count-only Viterbi: an Aho-Corasick automaton enumerates the vocabulary's matches in a word, and
dynamic programming over character positions carries the best score and that path's number of
pieces. Rules of the tokenizer (unigram model with byte fallback, white-space split, one leading
word mark): of paths with equal score into one position, the one whose last piece starts first
wins; a character without a piece of its own costs the smallest score less 10 and counts as its
UTF-8 bytes (as one unknown piece if the vocabulary lacks byte pieces; a run of those counts once).

Pieces and scores are those of the public SentencePiece file, read as a unigram vocabulary; no
tokenizer is trained. Words are counted once per worker and kept in a table of bounded size.

Defined cases: null and empty texts have 0 tokens; repeated rows are counted each; words of any
length take memory in proportion to that word; further columns are ignored.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import table

MARK = "▁"
KEPT_WORDS = 400_000
UNKNOWN_PENALTY = 10.0
_other_space = re.compile("[\x1c-\x1f]")
_word = re.compile(r"(?:[^\s]|[\x1c-\x1f])+")


def vocabulary(model_file: str) -> list[tuple[str, float]]:
    """Pieces with scores of a SentencePiece file; control and unknown pieces match no text."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
    return [(sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.get_piece_size())]


class PieceCounter:
    def __init__(self, pieces: list[tuple[str, float]]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min((s for _, s in pieces), default=0.0) - UNKNOWN_PENALTY
        names = {p for p, _ in pieces}
        self.bytes = all(f"<0x{i:02X}>" in names for i in range(256))
        self.kept: dict[str, int] = {}

    def viterbi(self, word: str) -> int:
        """Pieces on the best path of a word that has its mark."""
        n = len(word)
        score, pieces, unk = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        done, single = 0, False

        def close(end: int, has_piece: bool, has_single: bool) -> None:
            # the character's own start comes after all earlier starts, so it loses ties
            if not has_single and (not has_piece or score[end - 1] + self.unknown > score[end]):
                score[end] = score[end - 1] + self.unknown
                size = len(word[end - 1].encode("utf-8", "surrogatepass")) if self.bytes else int(not unk[end - 1])
                pieces[end], unk[end] = pieces[end - 1] + size, True

        matched = False
        for last, (size, own) in self.automaton.iter(word):
            end = last + 1
            while done < end - 1:
                close(done + 1, matched, single)
                done, matched, single = done + 1, False, False
            s = score[end - size] + own
            if not matched or s > score[end]:  # matches at one end come longest first
                score[end], pieces[end], matched = s, pieces[end - size] + 1, True
            single |= size == 1
        while done < n:
            close(done + 1, matched, single)
            done, matched, single = done + 1, False, False
        return pieces[n]

    def word(self, word: str) -> int:
        """A white-space free word gets a mark in front unless it has one; marks inside it start new words."""
        marked = word if word.startswith(MARK) else MARK + word
        return sum(self.viterbi(MARK + w) for w in marked.split(MARK)[1:])

    def text(self, text: str | None) -> int:
        words = _word.findall(text or "") if _other_space.search(text or "") else (text or "").split()
        kept, total = self.kept, 0
        for w in words:
            n = kept.get(w)
            if n is None:
                n = self.word(w)
                if len(w) <= 64:
                    if len(kept) >= KEPT_WORDS:
                        kept.clear()
                    kept[w] = n
            total += n
        return total


@lru_cache(maxsize=2)
def counter(model_file: str) -> PieceCounter:
    return PieceCounter(vocabulary(model_file))


def token_counts(docs: DataFrame, model_file: str) -> DataFrame:
    """doc_id, n_chars (code points), n_tokens for each row of docs (doc_id, text)."""

    def count(batches):
        own = counter(model_file)
        for b in batches:
            texts = b.column("text").to_pylist()
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([len(t or "") for t in texts], pa.int64()), pa.array(map(own.text, texts), pa.int64())],
                ["doc_id", "n_chars", "n_tokens"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(count, "doc_id long, n_chars long, n_tokens long")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
