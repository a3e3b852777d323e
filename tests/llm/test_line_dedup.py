import hashlib
from collections import defaultdict

from pyspark.sql import functions as F

from markgrid.llm import line_dedup

from . import data

LONG = "this line is shared by many documents"


def key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))


def brute(rows, least=20, least_docs=3):
    holders = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= least:
                holders[key(line)].add(i)
    low = lambda i: -1 if i is None else i
    keep = {k: max(ids, key=low) for k, ids in holders.items() if len(ids) >= least_docs}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        left = [x for x in lines if keep.get(key(x), i) == i]
        out.append((i, "\n".join(left), len(lines), len(lines) - len(left)))
    return sorted(out, key=str)


def got(spark, rows, **options):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return sorted([tuple(r) for r in line_dedup.drop_shared_lines(docs, **options).collect()], key=str)


CASES = [
    (1, f"{LONG}\nown line of the first document\n"), (2, f"  {LONG.upper()}\t\nshort\n{LONG}"), (3, LONG), (4, None), (5, ""), (6, "\n\n"), (7, f"\x0b{LONG}\x0c\r\nend"),
    (8, "twice is not enough to go\nx"), (9, "twice is not enough to go"), (10, "é" * 19), (11, "é" * 19), (12, "é" * 19), (13, "É" * 20 + "\nA"), (14, "É" * 20), (15, "É" * 20), (16, "é" * 20),
    (17, f"{LONG} \x1c"), (18, "Z" * 400_000), (19, "z" * 400_000 + "\n" * 3), (20, " " + "Z" * 400_000),
]


def test_equals_brute_force(spark):
    assert got(spark, CASES) == brute(CASES)
    assert {i: n for i, _, _, n in got(spark, CASES)} == {i: n for i, _, _, n in brute(CASES)}
    assert got(spark, CASES, least=4, least_docs=2) == brute(CASES, 4, 2)


def test_repeated_rows_and_null_ids(spark):
    rows = [*CASES, (3, LONG), (3, LONG), (3, f"a\n{LONG}"), (None, LONG), (None, "rare but long enough line"), (1, "rare but long enough line"), (2, "rare but long enough line")]
    assert got(spark, rows) == brute(rows)
    # two documents, one of them in many rows, are not three
    few = [(1, LONG)] * 5 + [(2, LONG)]
    assert got(spark, few) == brute(few) and all(n == 0 for *_, n in got(spark, few))


def test_a_line_of_very_many_documents(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "HOT_LEAST", 4)
    monkeypatch.setattr(line_dedup, "HOT_SHARE", 2)
    rows = [(i, f"{LONG}\nline number {i} of its own kind\n{LONG}\nshared by a few documents only {i // 4}") for i in range(200)]
    want = brute(rows)
    assert got(spark, rows) == want and sum(n for *_, n in want) == 2 * 199 + 150


def test_empty_table_and_clashing_names(spark):
    assert got(spark, []) == []
    docs = data.documents(spark).withColumns({c: F.lit(1) for c in ("n_lines", "n_dropped", "__r1", "__drop", "h1", "pos", "line", "keep_id", "is_hot")})
    out = line_dedup.drop_shared_lines(docs)
    assert out.columns == [*docs.columns, "n_lines_", "n_dropped_"]
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == [(i, t) for i, t, *_ in brute([(r[0], r[1]) for r in data.rows()])]


def test_query(spark, tmp_path):
    folder = data.folder(spark, str(tmp_path))
    want = {i: (n, d, hashlib.sha256(t.encode()).hexdigest()) for i, t, n, d in brute([(r[0], r[1]) for r in data.rows(False)])}
    assert {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in line_dedup.op13(spark, folder).collect()} == want
