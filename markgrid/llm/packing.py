"""Operator 6: sum-of-squares online packing into windows of 4096 tokens.

Each task packs the documents of its own partition, in order, and nothing is shuffled. A document
is cut into full windows; the rest goes where the sum of squares of the level counts (how many
open windows are filled to each level) becomes least: into an open window of level h, which lowers
count[h] and raises count[h + size], or into a new one. The level array has one entry a token of
the window, so a step is one NumPy expression over it. Ties go to the fullest window.

Open windows are held with their ids until full. When a new one makes them MAX_OPEN, the fullest is
filled up from the emptiest, which bounds memory and leaves all other windows as they are. At the end
of the partition they are cut and joined into full windows; what is then left is cut into windows
whose lengths are powers of two, which need no padding.

Ids come from the public tokenizer. It drops white space and never joins across it, so the ids of
a text are those of its words; words are encoded once per worker into a table of bounded size.

Defined cases: null and empty texts are the end id alone; repeated rows are packed each; documents
longer than a window span several; an empty table gives no rows; further columns are ignored.
sequence_id is partition * 2^40 + number, the same when a task is run again.
"""

from __future__ import annotations

import json
import re
import unicodedata
import zlib
from collections import deque
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import table
from .text import give_back

WINDOW, END_ID, MAX_OPEN, KEPT_WORDS = 4096, 2, 512, 200_000
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


#: Marks after a word: the tokenizer's pattern always splits them from letters.
MARKS = ".,;:!?%$&#*|)]"
#: Characters whose lower case may depend on the library or on their place.
_far = re.compile("[^\\x00-\\u012f\\u0132-\\u024f]")


def split(text: str) -> list[str]:
    """Words between white space; the tokenizer takes the four separators 1C to 1F for ordinary marks."""
    if "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text:
        return text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
    return text.split()


class WordEncoder:
    """Ids of words. A word of letters with marks behind it is the ids of the letters and of the marks;
    many words of letters are encoded as one text, as each ends with a piece that ends a word."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())  # the same pieces for text that is normal already and split at spaces
        spec["normalizer"] = None
        spec["pre_tokenizer"]["pretokenizers"][0] = {"type": "WhitespaceSplit"}
        self.plain_tokenizer = Tokenizer.from_str(json.dumps(spec))
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(1 + max(vocabulary.values()), bool)
        self.ends[[i for piece, i in vocabulary.items() if piece.endswith("</w>")]] = True
        # words and their parts of letters or marks; beyond KEPT_WORDS a table grows old, and what is still used moves on
        self.kept: dict[str, bytes] = {"": b""}
        self.plain: dict[str, bytes] = {"": b""}
        self.old_kept: dict[str, bytes] = {}
        self.old_plain: dict[str, bytes] = {}

    def each(self, words: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def letters(self, words: list[str]) -> list[bytes]:
        ids = np.array(self.plain_tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        cut = 4 * (np.flatnonzero(self.ends[ids]) + 1)
        if len(cut) != len(words):
            return self.each(words)
        raw, start = ids.tobytes(), 0
        out = []
        for end in cut.tolist():
            out.append(raw[start:end])
            start = end
        return out

    def learn(self, new: list[str]) -> None:
        parts, odd, stems, tails = [], [], set(), set()
        for w in new:
            low = w.lower()
            stem = low.rstrip(MARKS)
            if (stem and not stem.isalpha()) or not (w.isascii() or (not _far.search(w) and unicodedata.is_normalized("NFC", stem))):
                odd.append(w)
            else:
                tail = low[len(stem) :]
                parts.append((w, stem, tail))
                stems.add(stem)
                tails.add(tail)
        plain, old = self.plain, self.old_plain
        for x in stems | tails:
            if x not in plain and x in old:
                plain[x] = old[x]
        for some, encode in ((stems, self.letters), (tails, self.each)):
            some = [x for x in some if x not in plain]
            for at in range(0, len(some), 5_000):
                plain.update(zip(some[at : at + 5_000], encode(some[at : at + 5_000])))
        self.kept.update({w: plain[stem] + plain[tail] for w, stem, tail in parts})
        for at in range(0, len(odd), 5_000):
            self.kept.update(zip(odd[at : at + 5_000], self.each(odd[at : at + 5_000])))

    def ids(self, texts: list[str | None]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit numbers."""
        words = [split(t) if t else [] for t in texts]
        if len(self.kept) > KEPT_WORDS:
            self.old_kept, self.kept = self.kept, {"": b""}
        if len(self.plain) > KEPT_WORDS:
            self.old_plain, self.plain = self.plain, {"": b""}
        get = self.kept.get
        found = [list(map(get, ws)) for ws in words]
        gaps = [[i for i, x in enumerate(ids) if x is None] if None in ids else () for ids in found]
        new, old = [], self.old_kept
        for w in {ws[i] for ws, at in zip(words, gaps) for i in at}:
            if (known := old.get(w)) is None:
                new.append(w)
            else:
                self.kept[w] = known
        self.learn(new)
        for ws, ids, at in zip(words, found, gaps):
            for i in at:
                ids[i] = get(ws[i])
        return list(map(b"".join, found))


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


class SumOfSquares:
    """Packs items online; out gets (doc, start, ids, doc_tokens, sequence, offset) of closed windows."""

    def __init__(self, first_sequence: int, window: int = WINDOW, max_open: int = MAX_OPEN):
        self.window, self.max_open, self.sequence = window, max_open, first_sequence
        self.count = np.zeros(window + 1, np.int64)
        self.open: list[deque] = [deque() for _ in range(window)]
        self.n_open, self.out = 0, []

    def add(self, doc, ids: bytes) -> None:
        total = len(ids) // 4
        full = total - total % self.window
        for at in range(0, full, self.window):
            self.close([(doc, at, ids[4 * at : 4 * (at + self.window)], total)])
        if full < total:
            self.place((doc, full, ids[4 * full :], total))

    def level(self, size: int) -> int:
        """The level whose windows should take an item of this size; 0: a new window."""
        n = self.count[: self.window - size + 1]
        after = self.count[size : self.window + 1]
        # (n-1)^2 - n^2 + (m+1)^2 - m^2 for levels n, m; a full window leaves the sum, a new one has no level to leave
        change = 2 * (after - n) + 2
        change[-1] -= 2 * after[-1] + 1
        change[0] += 2 * n[0] - 1
        usable = n > 0
        usable[0] = True
        change[~usable] = np.iinfo(np.int64).max
        return len(change) - 1 - int(change[::-1].argmin())

    def place(self, piece) -> None:
        size = len(piece[2]) // 4
        h = self.level(size)
        if h:
            pieces = self.open[h].popleft()
            self.count[h] -= 1
            self.n_open -= 1
        else:
            pieces = []
        pieces.append(piece)
        self.put(pieces, h + size)
        if self.n_open >= self.max_open:
            self.top_up()

    def put(self, pieces, level: int) -> None:
        """Closes a full window, keeps another one open."""
        if level == self.window:
            self.close(pieces)
        elif level:
            self.open[level].append(pieces)
            self.count[level] += 1
            self.n_open += 1

    def top_up(self) -> None:
        """Fills the fullest open window from the front of the emptiest, cutting a document if need be."""
        levels = np.flatnonzero(self.count)
        high, low = int(levels[-1]), int(levels[0])
        full, rest = self.open[high].pop(), self.open[low].popleft()
        self.count[high] -= 1
        self.count[low] -= 1
        self.n_open -= 2
        while rest and high < self.window:
            doc, start, ids, total = rest.pop(0)
            take = min(len(ids) // 4, self.window - high)
            full.append((doc, start, ids[: 4 * take], total))
            high, low = high + take, low - take
            if 4 * take < len(ids):
                rest.insert(0, (doc, start + take, ids[4 * take :], total))
        self.put(full, high)
        self.put(rest, low)

    def close(self, pieces) -> None:
        at = 0
        for doc, start, ids, total in pieces:
            self.out.append((doc, start, ids, total, self.sequence, at))
            at += len(ids) // 4
        self.sequence += 1

    def rejoin(self) -> None:
        """Cuts and joins the open windows' pieces into full ones; one open window stays at most."""
        held, size = [], 0
        for h in range(self.window - 1, 0, -1):
            while self.open[h]:
                for doc, start, ids, total in self.open[h].popleft():
                    while ids:
                        take = min(len(ids) // 4, self.window - size)
                        held.append((doc, start, ids[: 4 * take], total))
                        size, start, ids = size + take, start + take, ids[4 * take :]
                        if size == self.window:
                            self.close(held)
                            held, size = [], 0
        self.count[:] = 0
        self.n_open = 0
        if held:
            self.open[size].append(held)
            self.count[size], self.n_open = 1, 1

    def finish(self) -> None:
        self.rejoin()
        rest = [p for h in range(1, self.window) for ps in self.open[h] for p in ps]
        left = sum(len(p[2]) // 4 for p in rest)
        while left:
            room, held = 1 << (left.bit_length() - 1), []
            left -= room
            while room:
                doc, start, ids, total = rest.pop(0)
                take = min(room, len(ids) // 4)
                held.append((doc, start, ids[: 4 * take], total))
                if 4 * take < len(ids):
                    rest.insert(0, (doc, start + take, ids[4 * take :], total))
                room -= take
            self.close(held)


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW) -> DataFrame:
    """A row for each piece of the rows of docs (doc_id, text)."""

    def run(batches):
        own = encoder(tokenizer)
        packer = SumOfSquares(TaskContext.get().partitionId() << 40, window)
        end = np.array([END_ID], "<u4").tobytes()

        def batch():
            out, packer.out = packer.out, []
            doc, start, ids, total, seq, at = zip(*out)
            columns = [doc, start, [len(x) // 4 for x in ids], [zlib.crc32(x) for x in ids], total, seq, at]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], [f.split()[0] for f in SCHEMA.split(", ")])

        for b in batches:
            for at in range(0, b.num_rows, 64):
                some = b.slice(at, 64)
                for doc, ids in zip(some.column("doc_id").to_pylist(), own.ids(some.column("text").to_pylist())):
                    packer.add(doc, ids + end)
                if len(packer.out) > 5000:
                    yield batch()
        packer.finish()
        if packer.out:
            yield batch()
        give_back()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), default_tokenizer())
