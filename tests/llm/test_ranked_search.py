import math
import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from markgrid.llm import ranked_search as rs

from ..conftest import rows_of
from . import data

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t) for t in TERM.findall(text or "")]


def brute(docs, items, k=20):
    held = [(i, terms(t)) for i, t in docs]
    held = [(i, Counter(t), len(t)) for i, t in held if t]
    n_docs, length = len(held), sum(n for *_, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item_id, text in items:
        q, best = Counter(terms(text)), []
        for i, c, n in held:
            m = 100 - 25 + (25 * n * n_docs) // length
            score = sum(times * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 12 * m)) for t, times in q.items() if t in c)
            if score > 0:
                best.append((-score, -1 if i is None else i))
        out += [(item_id, rank, None if i < 0 else i, -s) for rank, (s, i) in enumerate(sorted(best)[:k], 1)]
    return sorted(out, key=str)


def prose(r, n, words):
    return " ".join(words[min(int(r.expovariate(0.02)), len(words) - 1)] for _ in range(n))


def some(seed, n_docs, n_items):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    docs = [(i, prose(r, r.choice([3, 20, 60, 400]), words)) for i in range(n_docs)]
    items = [(i, prose(r, r.randint(1, 25), words)) for i in range(n_items)]
    for i in range(0, n_items, 3):  # planted passages
        docs += [(n_docs + 10 * i + j, docs[j][1] + " " + items[i][1]) for j in range(3)]
    return docs, items


def got(spark, docs, items, k=20):
    d, q = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    return sorted((tuple(r) for r in rs.search(d, q, k).collect()), key=str)


def test_equals_brute_force(spark):
    docs, items = some(1, 600, 25)
    assert got(spark, docs, items) == brute(docs, items)
    assert got(spark, docs, items, 3) == brute(docs, items, 3)


def test_odd_cases(spark):
    docs = [(1, None), (2, ""), (3, "... - "), (4, "Été x1 x1_x2"), (5, "ÉTÉ été\x7fX1"), (6, "x1 " * 40_000), (7, "y" * 400_000 + " x1"), (8, "same text"), (8, "same text"), (9, "same text"), (None, "same text"), (10, "x1\x1cx2 日本"), (11, "\x80x1")]
    items = [(1, "été"), (2, None), (3, ""), (None, "x1 x2 X1"), (None, "same"), (4, "same TEXT text"), (4, "same TEXT text"), (5, "nowhere"), (6, "y" * 400_000), (7, "日本 x2"), (8, "!!")]
    want = brute(docs, items)
    assert got(spark, docs, items) == want and {r[0] for r in want} == {1, None, 4, 6, 7}
    assert got(spark, [], items) == [] and got(spark, docs, []) == [] and got(spark, [(1, None)], items) == []


def test_items_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(rs, "QUERY_ITEMS", 4)
    docs, items = some(4, 200, 15)
    assert got(spark, docs, items, 5) == brute(docs, items, 5)


def test_many_equal_documents_rank_by_id(spark):
    docs = [(i, "the very same passage of words") for i in range(3000)] + [(5000 + i, f"other words {i}") for i in range(500)]
    items = [(0, "same passage"), (1, "words"), (2, "other passage")]
    assert got(spark, docs, items) == brute(docs, items)


def test_blocks_are_skipped_only_below_exact_bounds(spark):
    docs, items = some(7, 800, 20)
    own = rs.Items(items)
    fwd = rs.forward(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), own).persist()
    corpus = rs.corpus_of(fwd, own)
    floor, largest = rs.thresholds(fwd, own, corpus, 5)
    lists = rs.essential(own, floor, largest)
    index = rs.blocks(fwd, own, corpus, lists).collect()
    impact = {}
    for r in fwd.collect():
        n = np.full(len(r.terms), r.n)
        impact[r.row] = dict(zip(r.terms, corpus.impacts(n, np.array(r.terms, int), np.array(r.tfs, int)).tolist()))
    listed = {}
    for b in index:
        assert all(m == max(impact[r].get(t, 0) for r in b.rows) for t, m in zip(b.terms, b.maxima))
        listed.setdefault(b.term, []).extend(b.rows)
    # every essential list is whole, each document in one block
    assert all(sorted(rows) == sorted(r for r, c in impact.items() if t in c) for t, rows in listed.items()) and set(listed) == set(lists)
    assert len(index) > 2 * len(listed)
    pairs = sum(len(b.rows) * len(lists[b.term]) for b in index)
    left = rs.survivors(spark.createDataFrame(index, rs.BLOCK), own, floor, lists).collect()
    assert 0 < len(left) < pairs
    # what is left out can't be among the best
    kept = {(r.row, r.item) for r in left}
    for i, (terms_, times) in enumerate(zip(own.terms, own.times)):
        for r, c in impact.items():
            if sum(c.get(int(t), 0) * int(n) for t, n in zip(terms_, times)) >= max(floor[i], 1):
                assert (r, i) in kept
    fwd.unpersist()


def test_query_equals_its_sql(spark, duck, sf_dir):
    assert rows_of(rs.op12(spark, sf_dir)) == rows_of(duck.execute(rs.SQL).df())


def test_clashing_names(spark):
    docs, items = some(2, 60, 5)
    extra = {c: F.lit(1) for c in ("row", "n", "terms", "tfs", "item_id", "score", "rank")}
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumns(extra)
    q = spark.createDataFrame(items, "item_id long, text string").withColumns({c: F.lit(2) for c in ("doc_id", "score", "rank", "item")})
    assert sorted((tuple(r) for r in rs.search(d, q).collect()), key=str) == brute(docs, items)
    assert len(rs.search(data.documents(spark), q).columns) == 4
