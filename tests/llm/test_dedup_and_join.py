import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from markgrid.llm import exact_dedup, mixing, ngram_join, text
from markgrid.llm.components import components
from markgrid.llm.queries import oracle_sql, queries

from ..conftest import rows_of
from .data import SCHEMA, documents, folder, texts

UP = {c: c + 32 for c in range(65, 91)}


@pytest.mark.parametrize("name", ["op1_exact_dedup", "op3_mixing", "op4_ngram_jaccard_join"])
def test_query_equals_its_sql(spark, duck, sf_dir, name):
    got = rows_of(queries()[name](spark, sf_dir))
    assert got == rows_of(duck.execute(oracle_sql()[name]).df())


def test_exact_dedup_odd_cases(spark):
    docs = documents(spark)
    out = exact_dedup.exact_dedup(docs).toPandas()
    assert len(out) == docs.count()
    groups = defaultdict(list)
    for r in docs.collect():
        groups[hashlib.sha256((r.text or "").translate(UP).encode()).hexdigest()].append(r.doc_id)
    for h, ids in groups.items():
        own = out[out.text_sha256 == h]
        assert len(own) == len(ids) and (own.group_size == len(ids)).all()
        assert own.kept.sum() == 1
        if any(i is not None for i in ids):
            best = max(i for i in ids if i is not None)
            assert (own.keep_id == best).all() and own[own.kept].doc_id.iloc[0] == best
    kept = exact_dedup.keep_first_copies(docs)
    assert kept.columns == docs.columns and kept.count() == len(groups)


def test_hot_group_and_persistent_index(spark):
    """A third of all rows in one group; a second batch meets the index of the first."""
    rows = spark.range(600).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'Same' WHEN id % 3 = 1 THEN concat('t', id) ELSE concat('u', id div 6) END AS text")
    index = exact_dedup.DigestIndex(spark)
    out = exact_dedup.exact_dedup(rows, index).toPandas()
    assert len(out) == 600 and out.kept.sum() == rows.select("text").distinct().count()
    index.close()
    batch = [(1000, "SAME"), (1001, "new"), (1002, "Same"), (1003, "same")]
    again = exact_dedup.exact_dedup(spark.createDataFrame(batch, "doc_id long, text string"), exact_dedup.DigestIndex(spark, index.location))
    got = {r.doc_id: (r.kept, r.keep_id, r.group_size) for r in again.collect()}
    assert got == {1000: (False, 597, 203), 1001: (True, 1001, 1), 1002: (False, 597, 203), 1003: (False, 597, 203)}


def test_index_reopened_by_another_session(spark):
    """Four buckets, reopened where sixteen are the rule; a digest that is cold in the index is hot in the batch."""
    rows = spark.range(400).selectExpr("id AS doc_id", "concat('t', id) AS text")
    index = exact_dedup.DigestIndex(spark, buckets=4)
    assert exact_dedup.exact_dedup(rows, index).where("kept").count() == 400
    index.close()
    own = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        reopened = exact_dedup.DigestIndex(spark, index.location)
        assert reopened.buckets == 4
        hot = spark.range(1000).selectExpr("id + 1000 AS doc_id", "CASE WHEN id < 600 THEN 'T7' ELSE concat('t', id - 600) END AS text")
        out = exact_dedup.exact_dedup(hot, reopened).toPandas()
        assert len(out) == 1000 and not out.kept.any()
        assert (out.group_size[out.doc_id < 1600] == 602).all() and (out.keep_id[out.doc_id < 1600] == 7).all()
        assert exact_dedup.exact_dedup(rows, reopened).where("kept").count() == 0
        with pytest.raises(ValueError):
            exact_dedup.DigestIndex(spark, index.location, buckets=8)
        reopened.close()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", own)
    assert not [t.name for t in spark.catalog.listTables() if t.name == reopened.name]


def test_batches_run_again_get_their_first_verdicts(spark, monkeypatch):
    rows = spark.range(150).selectExpr("id AS doc_id", "concat('t', id % 120) AS text")
    more = spark.range(60).selectExpr("id + 500 AS doc_id", "concat('T', id + 100) AS text")
    answer = lambda df, name: rows_of(exact_dedup.exact_dedup(df, index, name))
    index = exact_dedup.DigestIndex(spark, buckets=4)
    # the append fails half way: rows are there, the end of the batch is not noted
    whole = exact_dedup.DigestIndex._note
    monkeypatch.setattr(exact_dedup.DigestIndex, "_note", lambda self, name: (_ for _ in ()).throw(OSError("lost")) if name.startswith("done-") else whole(self, name))
    with pytest.raises(OSError):
        answer(rows, "monday")
    monkeypatch.setattr(exact_dedup.DigestIndex, "_note", whole)
    first = answer(rows, "monday")
    assert sum(v == "True" for r in first[1] for v in r) == 120 and index.read().count() == 120
    second = answer(more, "tuesday")
    assert answer(rows, "monday") == first and answer(more, "tuesday") == second
    assert index.groups().agg({"group_size": "sum"}).first()[0] == 210
    third = answer(rows, "wednesday")
    assert not any(v == "True" for r in third[1] for v in r)
    before = rows_of(index.groups())
    index.compact()
    assert rows_of(index.groups()) == before and index.read().where("batch < 4").count() == index.read().where("batch < 4").select("digest").distinct().count()
    reopened = exact_dedup.DigestIndex(spark, index.location)
    assert reopened.data == index.data and rows_of(reopened.groups()) == before
    assert answer(rows, "wednesday") == third
    with pytest.raises(ValueError):
        answer(rows, "monday")
    files = {f.rsplit("/", 1)[1] for f in index.read().where("batch < 4").inputFiles()}
    assert len(files) <= index.buckets
    index.close()
    reopened.close()


def test_the_index_is_read_once_and_not_shuffled(spark, monkeypatch):
    rows = spark.range(100).selectExpr("id AS doc_id", "concat('t', id) AS text")
    index = exact_dedup.DigestIndex(spark, buckets=4)
    exact_dedup.exact_dedup(rows, index)
    plans = []
    keep = exact_dedup.written
    monkeypatch.setattr(exact_dedup, "written", lambda df, name: (plans.append((name, df._jdf.queryExecution().executedPlan().toString())), keep(df, name))[1])
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        exact_dedup.exact_dedup(rows, index)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    using = [(name, plan) for name, plan in plans if index.name in plan]
    assert [name for name, _ in using] == ["merged"] and using[0][1].count("SelectedBucketsCount") == 1
    assert using[0][1].count("Exchange") == 1  # of the batch; the index keeps its buckets
    index.close()


def test_first_copies_move_texts_once(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("__key", docs_key())
    out = exact_dedup.keep_first_copies(docs)
    assert out.columns == docs.columns
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = exact_dedup.keep_first_copies(docs)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert plan.count("Exchange") == 2  # texts and verdicts


def docs_key():
    from pyspark.sql import functions as F

    return F.lit("own column")


def test_empty_table(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert exact_dedup.exact_dedup(none).count() == 0
    assert exact_dedup.keep_first_copies(none).count() == 0
    assert ngram_join.near_classes(none, 3, 90).count() == 0
    assert ngram_join.keep_one_of_each(none).count() == 0
    assert mixing.mix(none).count() == 0
    assert mixing.select_docs(none, 0.9).count() == 0


def brute_components(docs, k, percent):
    sets = {}
    for i, t in docs.items():
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    parent = {i: i for i in docs}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(docs)
    for n, x in enumerate(ids):
        for y in ids[:n]:
            both = len(sets[x] & sets[y])
            if both and 100 * both >= percent * (len(sets[x]) + len(sets[y]) - both):
                a, b = find(x), find(y)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("k,percent", [(3, 90), (5, 80)])
def test_near_classes_equal_brute_force(spark, k, percent):
    docs = documents(spark)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_classes(docs, k, percent).collect() if r.doc_id is not None}
    assert got == brute_components(texts(), k, percent)
    kept = ngram_join.keep_one_of_each(docs, k, percent)
    assert kept.columns == docs.columns
    want = {i for i, (_, c) in brute_components(texts(), k, percent).items() if i == c}
    assert {r.doc_id for r in kept.collect()} - {None} == want


def test_large_group_of_near_copies(spark):
    """Two hundred edited copies of one text, some of which link only through others, and a shared passage."""
    r = np.random.default_rng(3)
    base = [f"w{i}" for i in range(100)]
    docs = {}
    for i in range(200):
        w = list(base)
        for j in r.choice(100, r.integers(0, 6), replace=False):
            w[j] = f"e{i}x{j}"
        docs[i] = " ".join(w)
    for i in range(200, 260):
        docs[i] = " ".join([f"own{i}y{j}" for j in range(60)] + base[:50])
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in ngram_join.near_classes(df, 3, 90).collect()}
    assert got == brute_components(docs, 3, 90)


def test_hot_heads_and_classes_and_repeated_ids(spark, monkeypatch):
    """Small bounds, so that heads are split, classes are broadcast, and sets are joined by a shuffle."""
    docs = documents(spark)
    want = sorted(tuple(x) for x in ngram_join.near_classes(docs, 3, 90).fillna(-1).collect())
    for name, value in (("PART", 2), ("LISTED", 1), ("HOT_CLASSES", 3), ("BROADCAST_IDS", 0)):
        monkeypatch.setattr(ngram_join, name, value)
    assert sorted(tuple(x) for x in ngram_join.near_classes(docs, 3, 90).fillna(-1).collect()) == want
    a, b = "one two three four five six seven eight nine ten", "another text that has nothing to do with it at all"
    rows = [(1, a), (2, a + " x"), (2, b), (3, b), (4, b.upper()), (2, b)]
    got = sorted(tuple(x) for x in ngram_join.near_classes(spark.createDataFrame(rows, "doc_id long, text string"), 3, 80).collect())
    assert len(got) == 6 and {x[0]: x[2] for x in got if x[0] != 2} in ({1: 1, 3: 1, 4: 1}, {1: 1, 3: 2, 4: 2})
    assert got == sorted(tuple(x) for x in ngram_join.near_classes(spark.createDataFrame(rows[::-1], "doc_id long, text string").repartition(3), 3, 80).collect())


def test_prefix_and_sketch_bounds():
    r = np.random.default_rng(1)
    for _ in range(300):
        n = int(r.integers(1, 200))
        x = r.integers(0, 2**63, n, dtype=np.uint64)
        y = np.unique(np.concatenate([x[: int(r.integers(0, n + 1))], r.integers(0, 2**63, int(r.integers(0, 30)), dtype=np.uint64)]))
        x = np.unique(x)
        both = len(np.intersect1d(x, y))
        differ = len(x) + len(y) - 2 * both
        apart = sum(int(v).bit_count() for v in ngram_join.sketch(x) ^ ngram_join.sketch(y))
        assert apart <= differ
        for percent in (80, 90):
            if len(y) and 100 * both >= percent * (len(x) + len(y) - both):
                for extra in range(3):
                    px, py = (s[: ngram_join.prefix_size(len(s), percent) + extra] for s in (x, y))
                    assert len(np.intersect1d(px, py)) >= min(extra + 1, both)


def test_short_linked_sets_share_enough(spark):
    both = [(1, 5, 8, 2, 4, 8)] * 4  # sets of 5 and 4 with 4 in common: 80 %
    fewer = [(3, 8, 8, 4, 8, 8)] * 6  # 8 and 8 need 7 at least
    met = spark.createDataFrame(both + fewer, "doc_id long, n long, l int, b long, m long, l2 int")
    assert [tuple(r) for r in ngram_join.enough(met, 80).collect()] == [(1, 2)]


def test_components_of_chain_star_and_clique(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, i) for i in range(101, 140)] + [(i, j) for i in range(200, 208) for j in range(200, i)] + [(300, 300)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {i: 0 for i in range(51)} | {i: 100 for i in range(100, 140)} | {i: 200 for i in range(200, 208)}
    assert got == want


def test_word_hashes_follow_the_definition():
    for t in list(texts().values())[:12] + [texts()[16], "A" * 400 + " b", "tab\x0bvt\x0cff\rcr"]:
        raw = (t or "").encode()
        words = re.findall(rb"[^\x20\x09-\x0D]+", raw)
        got = text.word_hashes(raw)
        assert len(got) == len(words)
        names = defaultdict(set)
        for w, h in zip(words, got):
            names[w.lower()].add(int(h))
        assert all(len(v) == 1 for v in names.values()) and len({next(iter(v)) for v in names.values()}) == len(names)
    long = (b"the quick brown fox " * 120_000) + b"end"
    assert len(text.word_hashes(long)) == 480_001 and len(set(text.word_hashes(long).tolist())) == 5


def water_fill(budget, kids):
    """Shares of children (name, weight, capacity), by rounds."""
    share, left, open_ = {}, budget, dict((n, (w, c)) for n, w, c in kids)
    while open_:
        total = sum(w for w, _ in open_.values())
        full = [n for n, (w, c) in open_.items() if c * total <= left * w]
        if not full:
            return share | {n: left * w // total for n, (w, _) in open_.items()}
        n = min(full, key=lambda n: open_[n][1] / open_[n][0])
        share[n] = open_.pop(n)[1]
        left -= share[n]
    return share


def test_mixing_budgets_and_prefixes(spark):
    docs = documents(spark, repeat=False)
    out = mixing.mix(docs, share=0.7, max_epochs=3).toPandas()
    assert len(out) == docs.count()
    sizes = out.groupby(["domain", "lang", "source"]).tokens.sum().to_dict()
    cap = lambda key: sum(3 * n for k, n in sizes.items() if k[: len(key)] == key)
    budgets = {(): int(sum(sizes.values()) * 0.7)}
    for level, named in enumerate(mixing.DEFAULT_WEIGHTS):
        nxt = {}
        for key, b in budgets.items():
            kids = sorted({k[level] for k in sizes if k[:level] == key})
            nxt |= {(*key, n): s for n, s in water_fill(b, [(n, named.get(n, 1), cap((*key, n))) for n in kids]).items()}
        budgets = nxt
    took = (out.tokens * out.copies).groupby([out.domain, out.lang, out.source]).sum().to_dict()
    for key, b in budgets.items():
        n = sizes[key]
        assert took[key] <= b
        own = out[(out.domain == key[0]) & (out.lang == key[1]) & (out.source == key[2])]
        missing = own[own.copies == (b // n if n else 0)].tokens
        if n and len(missing):  # the prefix ends at the first document that does not fit
            epoch = b // n
            place = lambda i: (int(hashlib.md5(f"{mixing.SEED}:{epoch}:{i}".encode()).hexdigest()[:8], 16), i)
            through = 0
            for i in sorted(own.doc_id, key=place):
                through += int(own[own.doc_id == i].tokens.iloc[0])
                assert int(own[own.doc_id == i].copies.iloc[0]) == epoch + (through <= b % n)
    kept = mixing.select_docs(documents(spark), 0.9)
    assert kept.columns == documents(spark).columns and 0 < kept.count() < documents(spark).count() + 1


def test_mixing_beyond_the_broadcast_bound_is_the_same(spark, monkeypatch):
    docs = documents(spark)
    want = rows_of(mixing.mix(docs))
    monkeypatch.setattr(mixing, "BROADCAST_LEAVES", 0)
    assert rows_of(mixing.mix(docs)) == want


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    path = folder(spark, str(tmp_path), documents(spark))
    docs = spark.read.parquet(f"{path}/documents.parquet")
    seen = Counter()
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, path)
        out.write.parquet(f"{path}/{name}")
        docs = spark.read.parquet(f"{path}/{name}")
        seen[name] = docs.count()
        if name != "packing":
            assert out.columns == documents(spark).columns
    assert list(seen) == ["quality classifier", "exact dedup", "near duplicates", "mixing", "packing"]
    assert corpus_pipeline.run(spark, path).count() == seen["packing"]


def plain_shares(nodes, total):
    """Budgets of siblings, {name: (capacity, weight)}: full ones first, the rest by weight."""
    left, weights, out = total, sum(w for _, w in nodes.values()), {}
    for name in sorted(nodes, key=lambda x: (nodes[x][0] / nodes[x][1], x)):
        cap, w = nodes[name]
        if cap * weights > w * left:
            break
        out[name] = cap
        left, weights = left - cap, weights - w
    return out | {name: left * w // weights for name, (_, w) in nodes.items() if name not in out}


def plain_mix(rows, share):
    """Ids that one epoch at most of each leaf yields, from rows (doc_id, lang, source, text)."""
    leaf, size = {}, {}
    for i, lang, source, text in rows:
        number = re.search(r"[0-9]{1,9}$", source or "")
        leaf[i] = (f"domain{int(number.group()) % mixing.DOMAINS if number else 0}", lang or "", source or "")
        size[i] = len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    budget = {(): math.floor(sum(size.values()) * share)}
    for level, named in enumerate(mixing.DEFAULT_WEIGHTS, 1):
        caps = Counter()
        for i, path in leaf.items():
            caps[path[:level]] += size[i]
        for parent in {path[:-1] for path in caps}:
            budget |= plain_shares({path: (c, named.get(path[-1], 1)) for path, c in caps.items() if path[:-1] == parent}, budget[parent])
    taken = set()
    for path in set(leaf.values()):
        own = [i for i in leaf if leaf[i] == path]
        tokens = sum(size[i] for i in own)
        epochs, rest = divmod(budget[path], tokens) if tokens else (0, 0)
        through = 0
        for i in sorted(own, key=lambda x: (hashlib.md5(f"{mixing.SEED}:{epochs}:{x}".encode()).hexdigest()[:8], x)):
            through += size[i]
            if epochs or through <= rest:
                taken.add(i)
    return taken


def test_pipeline_equals_brute_force(spark, tmp_path):
    """Each stage's documents, against the plain form of its rule over what the stage before kept."""
    import corpus_pipeline
    from markgrid.llm import packing, quality_crf

    path = folder(spark, str(tmp_path), documents(spark, repeat=False))
    docs = spark.read.parquet(f"{path}/documents.parquet")
    model = quality_crf.learn(quality_crf.training_part(docs), quality_crf.training_part(spark.read.parquet(f"{path}/labels.parquet")))
    left = {r.doc_id for r in quality_crf.scores(docs, model).collect() if r.score >= 0.3}
    own, want = texts(), {}
    want["quality classifier"] = set(left)
    best = {}
    for i in left:
        key = (own[i] or "").translate(UP)
        best[key] = max(i, best.get(key, i))
    left = set(best.values())
    want["exact dedup"] = set(left)
    left = {i for i, (_, c) in brute_components({i: own[i] for i in left}, 5, 80).items() if i == c}
    want["near duplicates"] = set(left)
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, path).write.parquet(f"{path}/{name}")
        docs = spark.read.parquet(f"{path}/{name}")
        ids = [r.doc_id for r in docs.select("doc_id").collect()]
        if name in want:
            assert sorted(ids) == sorted(want[name]), name
        if name == "mixing":
            place = {r.doc_id: (r.lang, r.source) for r in documents(spark, repeat=False).collect()}
            left = plain_mix([(i, *place[i], own[i]) for i in left], corpus_pipeline.MIX_SHARE)
            assert sorted(ids) == sorted(left)
        if name == "packing":
            encoder = packing.encoder(packing.default_tokenizer())
            end = packing.END_ID.to_bytes(4, "little")
            ids_of = {i: x + end for i, x in zip(sorted(left), encoder.ids([own[i] for i in sorted(left)]))}
            out = docs.toPandas().sort_values(["doc_id", "start"])
            assert set(out.doc_id) == left
            for i, g in out.groupby("doc_id"):
                assert (g.start == g.length.cumsum() - g.length).all() and (g.doc_tokens == g.length.sum()).all() and 4 * g.length.sum() == len(ids_of[i])
                assert all(r.ids_crc32 == zlib.crc32(ids_of[i][4 * r.start : 4 * (r.start + r.length)]) for r in g.itertuples())
            for _, g in out.sort_values("offset").groupby("sequence_id"):
                assert (g.offset == g.length.cumsum() - g.length).all()
                assert g.length.sum() == packing.WINDOW or (g.length.sum() < packing.WINDOW and int(g.length.sum()).bit_count() == 1)
