import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from markgrid.llm import html_extract, language_id, lm_scoring, packing, quality_crf, quality_rules, token_count
from markgrid.llm.queries import queries

from .data import SCHEMA, documents, folder, texts

P = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    return folder(spark, str(tmp_path_factory.mktemp("odd")), documents(spark))


@pytest.fixture(scope="module")
def none(spark, tmp_path_factory):
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    return folder(spark, str(tmp_path_factory.mktemp("none")), spark.createDataFrame([], SCHEMA), empty)


@pytest.mark.parametrize("name", ["op1_exact_dedup", "op3_mixing", "op4_ngram_jaccard_join", "op5_token_counts", "op6_packing", "op7_language_id", "op8_quality_rules", "op9_quality_classifier", "op10_lm_scoring"])
def test_odd_and_empty_tables(spark, odd, none, name):
    n = queries()[name](spark, odd).count()
    assert n == documents(spark).count() or (name == "op6_packing" and n >= documents(spark).count())
    assert queries()[name](spark, none).count() == 0


def test_token_counts_are_the_tokenizers(spark, odd):
    from tokenizers import Tokenizer, models, pre_tokenizers

    pieces = token_count.vocabulary(P.path("piece_bpe_32k.model"))
    own = Tokenizer(models.Unigram(pieces, unk_id=0, byte_fallback=True))
    own.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.Metaspace(replacement=token_count.MARK, prepend_scheme="always", split=True)])
    want = {i: len(own.encode(t or "", add_special_tokens=False).ids) for i, t in texts().items()}
    got = {r.doc_id: r.n_tokens for r in queries()["op5_token_counts"](spark, odd).collect()}
    assert {i: got[i] for i in want} == want


def test_ties_and_unknowns_of_small_vocabularies():
    import random

    from tokenizers import Tokenizer, models, pre_tokenizers

    r = random.Random(4)
    for _ in range(60):
        pieces = [("<unk>", 0.0), *{"".join(r.choice("abcé▁") for _ in range(r.randint(1, 4))): float(-r.randint(1, 3)) for _ in range(10)}.items()]
        own = Tokenizer(models.Unigram(pieces, unk_id=0, byte_fallback=False))
        own.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)])
        c = token_count.PieceCounter(pieces)
        for _ in range(20):
            t = "".join(r.choice("abcé z▁") for _ in range(12))
            assert c.text(t) == len(own.encode(t, add_special_tokens=False).ids)


def test_packing_round_trip(spark, odd):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(packing.default_tokenizer())
    out = packing.pack(documents(spark, repeat=False), packing.default_tokenizer()).toPandas()
    for i, t in texts().items():
        ids = np.array(own.encode(t or "", add_special_tokens=False).ids + [packing.END_ID], "<u4")
        at = 0
        for r in out[out.doc_id == i].sort_values("start").itertuples():
            assert r.start == at and r.doc_tokens == len(ids) and zlib.crc32(ids[at : at + r.length].tobytes()) == r.ids_crc32
            at += r.length
        assert at == len(ids)
    for _, g in out.sort_values("offset").groupby("sequence_id"):
        assert (g.offset == g.length.cumsum() - g.length).all() and g.length.sum() <= packing.WINDOW
        assert g.length.sum() == packing.WINDOW or int(g.length.sum()).bit_count() == 1


def test_store_of_open_windows_is_topped_up_when_full():
    r = np.random.default_rng(6)
    for most in (2, 3, 8):
        p = packing.SumOfSquares(0, 16, most)
        docs = [r.integers(0, 1000, int(r.integers(1, 40))).astype("<u4") for _ in range(400)]
        for doc, ids in enumerate(docs):
            before = p.count.copy()
            p.add(doc, ids.tobytes())
            assert p.n_open == p.count.sum() == sum(map(len, p.open)) < most
            assert np.abs(p.count - before).sum() <= 6  # the window placed into and the two that were joined
            assert all(sum(len(x[2]) for x in ps) == 4 * h for h, some in enumerate(p.open) for ps in some)
        assert all(sum(len(x[2]) for x in p.out if x[4] == s) == 64 for s in range(p.sequence))
        p.finish()
        for doc, ids in enumerate(docs):
            own = sorted((x[1], x[2]) for x in p.out if x[0] == doc)
            assert b"".join(x for _, x in own) == ids.tobytes() and [a for a, _ in own] == [sum(len(x) // 4 for _, x in own[:i]) for i in range(len(own))]


def test_sum_of_squares_choice():
    r = np.random.default_rng(2)
    for _ in range(200):
        p = packing.SumOfSquares(0, 16)
        p.count[1:16] = r.integers(0, 3, 15)
        size = int(r.integers(1, 16))

        def cost(h):
            n = p.count.copy()
            if h:
                n[h] -= 1
            if h + size < 16:
                n[h + size] += 1
            return int((n[1:16] ** 2).sum())

        usable = [h for h in range(16 - size + 1) if h == 0 or p.count[h]]
        assert cost(p.level(size)) == min(map(cost, usable))


def test_language_mixtures(spark, sf_dir):
    out = queries()["op7_language_id"](spark, sf_dir).toPandas()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").toPandas().merge(out, on="doc_id")
    assert (docs.lang == docs.lang_pred)[docs.held_out].mean() > 0.95
    assert docs.score.between(0, 1).all()
    model = language_id.learn(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    one, two = (docs[docs.lang == x].text.iloc[0][:1500] for x in ("en", "de"))
    got = language_id.predict(spark.createDataFrame([(1, one + "\n" + two), (2, None), (3, "123 !!")], "doc_id long, text string"), *model).toPandas().set_index("doc_id")
    assert set(got.languages[1]) >= {"en", "de"} and abs(sum(got.languages[1].values()) - 1) < 1e-6
    assert list(got.lang_pred[[2, 3]]) == ["und", "und"] and list(got.score[[2, 3]]) == [0, 0]


def brute_statistics(t):
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    triples = Counter(zip(words, words[1:], words[2:]))
    covered = {i + k for i in range(len(words) - 2) if triples[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def test_quality_rule_statistics(spark, odd):
    out = quality_rules.op8(spark, odd).toPandas()
    for i, t in texts().items():
        want = brute_statistics(t or "")
        r = out[out.doc_id == i].iloc[0]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and (not r.base_failed or not r.kept)


def test_exact_binomial_bound_and_error_control():
    from math import comb

    for n, p in ((20, 0.1), (50, 0.03), (7, 0.6)):
        for k in range(n + 1):
            assert abs(quality_rules.binomial_cdf(k, n, p) - sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))) < 1e-9
    r, alpha, broken = np.random.default_rng(0), 0.1, 0
    for _ in range(200):  # the true rate of a chosen cutoff is over alpha in at most delta of the runs
        good = r.beta(1, 8, 400)
        cells = np.bincount(np.ceil(good * quality_rules.GRID).astype(int), minlength=quality_rules.GRID + 1)
        bad = np.full(quality_rules.GRID + 1, 5)
        found = quality_rules.cutoffs({"en": np.stack([bad, cells])}, alpha, 0.1)
        for c in found.values():
            broken += (1 - c / quality_rules.GRID) ** 8 > alpha
    assert broken <= 20


def test_quality_rule_of_a_small_stratum(spark):
    rows = [(i, "de", 60, 300, 0, 0, 0, 5, 6, 300, 0) for i in range(150)] + [(i, "de", 60, 300, 90, 0, 0, 5, 6, 300, 90) for i in range(150, 160)]
    stats = spark.createDataFrame(rows, "doc_id long, lang string, " + ", ".join(f"{c} long" for c in quality_rules.COUNTS))
    labels = spark.createDataFrame([(r[0], int(r[0] < 150)) for r in rows], "doc_id long, quality int")
    out = quality_rules.judged(stats, quality_rules.learn(stats, labels)).toPandas()
    assert (out.kept == (out.doc_id < 150)).all() and list(out.reasons[150]) == ["marks"]
    few = labels.where("doc_id >= 60")  # 90 good ones: no cutoff can be certified
    assert quality_rules.learn(stats, few) == {}


def test_small_strata_are_one(spark):
    """Two languages of 90 good documents each are enough together; French has its own, milder rule."""
    row = lambda i, lang, marks: (i, lang, 60, 300, marks, 0, 0, 5, 6, 300, marks)
    rows = [row(i, "de" if i % 2 else "es", 0) for i in range(180)] + [row(i, "de", 15) for i in range(180, 200)]
    rows += [row(i, "fr", 15) for i in range(200, 400)] + [row(i, "fr", 90) for i in range(400, 420)] + [row(420, "xx", 15), row(421, None, 0)]
    stats = spark.createDataFrame(rows, "doc_id long, lang string, " + ", ".join(f"{c} long" for c in quality_rules.COUNTS))
    labels = spark.createDataFrame([(i, int(i < 180 or 200 <= i < 400)) for i in range(420)], "doc_id long, quality int")
    found = quality_rules.learn(stats, labels)
    assert set(found) == {"fr", quality_rules.OTHERS} and found["fr"] > found[quality_rules.OTHERS]
    out = quality_rules.judged(stats, found).toPandas()
    assert set(out.doc_id[~out.kept]) == {*range(180, 200), *range(400, 420), 420}
    for tests in (1, 2, 4):
        n = quality_rules.labels_needed(tests)
        assert quality_rules.certified(0, n, quality_rules.ALPHA, quality_rules.DELTA / tests) and not quality_rules.certified(0, n - 1, quality_rules.ALPHA, quality_rules.DELTA / tests)


def binomial_upper(k, n, level):
    """The Clopper-Pearson upper bound, by bisection of the distribution summed term by term."""
    low, high = 0.0, 1.0
    for _ in range(60):
        p = (low + high) / 2
        low, high = (p, high) if sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)) > level else (low, p)
    return high


def test_cutoffs_equal_a_plain_search(spark):
    """Verdicts of the query against the rule written out, on labels that certify something."""
    d = "/root/testdata/sf0.01"
    out = quality_rules.op8(spark, d).toPandas()
    docs = spark.read.parquet(f"{d}/documents.parquet").toPandas().set_index("doc_id")
    labels = spark.read.parquet(f"{d}/labels.parquet").toPandas()
    score, base = {}, {}
    for i, t, lang in zip(docs.index, docs.text, docs.lang):
        t = t or ""
        words, chars, _, dup, repeats = brute_statistics(t)
        base[i] = words < 50 or 100 * repeats > 50 * words
        lines = len([x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)])
        letters, upper, marks = len(re.findall("[A-Za-z]", t)), len(re.findall("[A-Z]", t)), len(re.findall(r"[#*$%&|<>!]", t))
        shares = {"marks": (marks, chars), "shouting": (upper, letters), "duplicate_lines": (dup, lines), "repeated_words": (repeats, words)}
        score[i] = max(min(100, math.ceil(min(1, a / b) / quality_rules.LIMITS[r] * 25)) if b else 0 for r, (a, b) in shares.items())
    good, bad = Counter(), Counter()
    for i, q in zip(labels.doc_id, labels.quality):
        if i in base and not base[i] and q in (0, 1):
            (good if q else bad)[docs.lang[i] or "", score[i]] += 1
    names = {s for s, _ in [*good, *bad]}
    total = lambda c, some, over=-1: sum(n for (s, x), n in c.items() if s in some and x > over)
    own = [{s} for s in names if total(good, {s}) >= quality_rules.labels_needed(len(names))]
    rest = names - set().union(*own) if own else names
    groups = own + ([rest] if rest else [])
    limit = {}
    for some in groups:
        n, certified = total(good, some), []
        for c in range(99, -1, -1):
            if not n or binomial_upper(total(good, some, c), n, quality_rules.DELTA / len(groups)) > quality_rules.ALPHA:
                break
            certified.append(c)
        if certified and total(bad, some, certified[-1]):
            c = next(c for c in certified if total(bad, some, c) >= 0.95 * total(bad, some, certified[-1]))
            limit |= {s: c for s in some} | ({None: c} if some is rest else {})
    want = {i: not base[i] and score[i] <= limit.get(lang or "", limit.get(None, 100) if (lang or "") not in names else 100) for i, lang in docs.lang.items()}
    assert dict(zip(out.doc_id, out.kept)) == want
    assert limit and (~out.kept & ~out.base_failed).sum() > 0  # a learnt cutoff acts


def test_forward_backward_is_exact():
    r = np.random.default_rng(0)
    n = np.array([3, 1, 5, 2])
    e, t = r.normal(size=n.sum()), r.normal(size=(2, 2))
    a, b = quality_crf.messages(e, n, t)
    at = 0
    for m in n:
        weight = {}
        for path in np.ndindex(*[2] * m):
            weight[path] = math.exp(sum(e[at + i] for i in range(m) if path[i]) + sum(t[path[i], path[i + 1]] for i in range(m - 1)))
        total = sum(weight.values())
        for i in range(m):
            assert abs(sum(w for p, w in weight.items() if p[i]) / total - quality_crf.odds(a + b)[at + i]) < 1e-9
        at += m


def test_quality_of_a_long_text_is_the_same_in_any_slices(monkeypatch):
    r = np.random.default_rng(3)
    words = [b"word%d" % i for i in range(3000)]
    lines = [b" ".join(words[i] for i in r.integers(0, 3000, 12)) for _ in range(55_000)]
    long = b"\n".join(lines + lines[:20_000] + [b"ONE " * 300_000])  # over 4 MiB, with a line of 1.2 MB
    texts_ = [b"short text\nshort text", long, b"", b"last\n\nline"]
    assert len(long) > 5 << 20
    want = quality_crf.chunk_features(texts_)
    assert (want[0][want[2] == 1][:, -1] % quality_crf.WIDTH).sum() >= 20_000  # repeats are seen across slices
    assert len(want[1]) == 2 + 75_001 + 2 and int(want[1].sum()) == sum(len(w) for t in texts_ for w in t.split())
    monkeypatch.setattr(quality_crf, "SLICE", 1 << 30)
    for got, own in zip(quality_crf.chunk_features(texts_), want):
        assert (got == own).all()


def test_lines_at_the_driver_are_bounded(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{x}.parquet") for x in ("documents", "labels"))
    rows = quality_crf.training_rows(docs, labels, 100, 300)
    sizes = [len(r["sizes"]) // 8 for r in rows]
    assert 0 < sum(sizes) <= 300
    every = quality_crf.training_rows(docs, labels, 100, 10**9)
    assert len(every) > len(rows) and all(r in every for r in rows)


def plain_lines(text):
    """Statistics and sizes of each line with a word, by loops over words."""
    lines = [re.findall(rb"[^ \t-\r]+", x) for x in (text or "").encode().split(b"\n")]
    lines = [ws for ws in lines if ws]
    words = [w.lower() for ws in lines for w in ws]
    triples = list(zip(words, words[1:], words[2:]))
    times, out, at = Counter(triples), [], 0
    for i, ws in enumerate(lines):
        raw, low = b"".join(ws), [w.lower() for w in ws]
        n, size = len(ws), len(raw)
        count = lambda chars: sum(map(raw.count, [bytes([x]) for x in chars]))
        letters = count(range(65, 91)) + count(range(97, 123)) + count(range(0xC0, 256))
        earlier = any([w.lower() for w in x] == low for x in lines[:i])
        stats = [n, count(b"#*$%&|<>!") / size, count(range(65, 91)) / max(letters, 1), count(range(48, 58)) / size, count(b".,;:?") / size]
        stats += [sum(a == b for a, b in zip(low, low[1:])) / n, 1 - (n - len(set(low))) / n, size / n]
        stats += [sum(times[t] > 1 for t in triples[at : at + n]) / n, earlier]
        out.append(([sum(e < s for e in edges) for edges, s in zip(quality_crf.EDGES.values(), stats)], size))
        at += n
    return out


def plain_score(text, model):
    """The score by sums over the two states of each line."""
    w, t, (at, slope) = model
    lines = plain_lines(text)
    if not lines:
        return 0.0
    value = [[sum(w[k][f * quality_crf.WIDTH + b] for f, b in enumerate(bins)) for bins, _ in lines] for k in range(3)]
    e = [v + w[0][-1] + (value[1][i - 1] if i else w[1][-1]) + (value[2][i + 1] if i + 1 < len(lines) else w[2][-1]) for i, v in enumerate(value[0])]

    def messages(order, link):
        prior, out = [1.0, 1.0], {}
        for i in order:
            out[i] = list(prior)
            own = [prior[0], prior[1] * math.exp(e[i])]
            prior = [sum(own[s] * math.exp(link(s, to)) for s in (0, 1)) for to in (0, 1)]
            prior = [x / sum(prior) for x in prior]
        return out

    before = messages(range(len(e)), lambda s, to: t[s][to])
    after = messages(reversed(range(len(e))), lambda s, to: t[to][s])
    good = [before[i][1] * after[i][1] * math.exp(e[i]) for i in range(len(e))]
    p = [g / (g + before[i][0] * after[i][0]) for i, g in enumerate(good)]
    q = min(max(sum(x * size for x, (_, size) in zip(p, lines)) / sum(size for _, size in lines), 1e-4), 1 - 1e-4)
    return 1 / (1 + math.exp(-(at + slope * math.log(q / (1 - q)))))


def test_quality_scores_equal_a_plain_restatement(spark, odd, sf_dir):
    for d in (odd, sf_dir):
        docs, labels = (spark.read.parquet(f"{d}/{x}.parquet") for x in ("documents", "labels"))
        model = quality_crf.learn(quality_crf.training_part(docs), quality_crf.training_part(labels))
        plain = sorted((-1 if r.doc_id is None else r.doc_id, plain_score(r.text, model)) for r in docs.collect())
        out = sorted((-1 if r.doc_id is None else r.doc_id, r.score, r.held_out, r.predicted) for r in quality_crf.op9(spark, d).collect())
        assert [i for i, _ in plain] == [r[0] for r in out]
        for (i, want), (_, got, held_out, predicted) in zip(plain, out):
            assert abs(got - want) < 1e-6 and predicted == (got >= 0.3)
            assert held_out == (zlib.crc32(("" if i < 0 else str(i)).encode()) % 5 == 0)


def test_quality_of_a_text_does_not_depend_on_the_next():
    first, second = b"north wind north", b"wind north\nlate"
    alone = quality_crf.chunk_features([first])[0]
    assert (quality_crf.chunk_features([first, second])[0][:1] == alone).all()
    first, second = b"wind north south east wind", b"north south"
    assert (quality_crf.chunk_features([first, second])[0][:1] == quality_crf.chunk_features([first])[0]).all()


def test_training_climbs_the_penalised_likelihood():
    """After training, the brute-force penalised likelihood of small chains is as good as at any small step away."""
    r = np.random.default_rng(8)
    n = np.array([3, 2, 4, 1, 3, 2] * 6)
    chain = np.repeat(np.arange(len(n)), n)
    good = np.repeat(r.integers(0, 2, len(n)), n).astype(bool)
    bins = np.stack([np.minimum(r.integers(0, 3, len(chain)) + good, 2) + f * quality_crf.WIDTH for f in range(len(quality_crf.EDGES))], axis=1)

    def likelihood(w, t):
        e, total = quality_crf.evidence(bins, chain, w), 0.0
        for c in range(len(n)):
            own, y = e[chain == c], good[chain == c].astype(int)
            score = lambda path: sum(own[i] for i in range(len(own)) if path[i]) + sum(t[a, b] for a, b in zip(path, path[1:]))
            total += score(y) - math.log(sum(math.exp(score(p)) for p in np.ndindex(*[2] * len(own))))
        return total / len(chain) - quality_crf.DECAY / 2 * ((w**2).sum() + (t**2).sum())

    w, t = quality_crf.train(bins, chain, good)
    best = likelihood(w, t)
    assert best > likelihood(0 * w, 0 * t) + 0.1
    for _ in range(20):
        assert likelihood(w + r.normal(0, 0.3, w.shape), t + r.normal(0, 0.3, t.shape)) < best


def test_long_chains_are_one_chain():
    """Messages and gradient of chains of over CUT lines against plain loops over each whole chain."""
    r = np.random.default_rng(3)
    n = np.array([200, 1, 64, 65, 129, 7, 500])
    assert quality_crf.CUT == 64
    chain = np.repeat(np.arange(len(n)), n)
    bins = np.stack([r.integers(0, quality_crf.WIDTH, len(chain)) + f * quality_crf.WIDTH for f in range(len(quality_crf.EDGES))], axis=1)
    y = r.integers(0, 2, len(chain)).astype(float)
    w, t = r.normal(0, 0.4, (3, quality_crf.SIZE + 1)), r.normal(0, 1, (2, 2))

    def plain(e, t, total=False):
        """log-odds forward and backward, and the log-normaliser, of one chain."""
        f = [np.array([0.0, e[0]])]
        for x in e[1:]:
            f.append(np.array([np.logaddexp(f[-1][0] + t[0, k], f[-1][1] + t[1, k]) + k * x for k in (0, 1)]))
        b = [np.zeros(2)]
        for x in e[:0:-1]:
            b.append(np.array([np.logaddexp(t[k, 0] + b[-1][0], t[k, 1] + x + b[-1][1]) for k in (0, 1)]))
        return np.logaddexp(*f[-1]) if total else (np.array([v[1] - v[0] for v in f]), np.array([v[1] - v[0] for v in b[::-1]]))

    e = quality_crf.evidence(bins, chain, w)
    a, b = quality_crf.messages(e, n, t)
    for c in range(len(n)):
        want = plain(e[chain == c], t)
        assert np.allclose(a[chain == c], want[0]) and np.allclose(b[chain == c], want[1])

    def likelihood(w, t):
        e, total = quality_crf.evidence(bins, chain, w), 0.0
        for c in range(len(n)):
            own, z = e[chain == c], y[chain == c].astype(int)
            total += (own * z).sum() + t[z[:-1], z[1:]].sum() - plain(own, t, True)
        return total

    gw, gt = quality_crf.gradient(bins, chain, n, y, w, t)
    for v, g, at in [(w, gw, tuple(r.integers(0, s) for s in w.shape)) for _ in range(12)] + [(w, gw, (k, quality_crf.SIZE)) for k in range(3)] + [(t, gt, (i, j)) for i in (0, 1) for j in (0, 1)]:
        held = v[at]
        v[at] = held + 1e-5
        up = likelihood(w, t)
        v[at] = held - 1e-5
        down = likelihood(w, t)
        v[at] = held
        assert abs((up - down) / 2e-5 - g[at]) < 1e-4 * max(1, abs(g[at]))


def test_quality_classifier_on_held_out(spark):
    d = "/root/testdata/sf0.01"
    out = quality_crf.op9(spark, d).toPandas().merge(spark.read.parquet(f"{d}/labels.parquet").toPandas(), on="doc_id")
    held = out[out.held_out]
    assert (held.predicted == held.quality).mean() > 0.9
    assert held[held.quality == 1].predicted.mean() > 0.97 and out.score.between(0, 1).all()


def test_base_scores_and_model(spark, odd):
    docs = documents(spark).select("doc_id", "text").collect()
    split = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
    tokens = [(r.doc_id, (r.text or "").encode().lower().split() + ["end"]) for r in docs]
    c = Counter(w for i, ws in tokens if not split(i) for w in ws)
    n, v = sum(c.values()), len(c)
    want = sorted((len(ws), round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), 5), sum(w in c for w in ws), n) for _, ws in tokens)
    out = lm_scoring.op10(spark, odd).toPandas()
    got = sorted((r.n_tokens, round(r.base_score, 5), r.n_known, r.train_tokens) for r in out.itertuples())
    assert got == want
    assert np.isfinite(out.score).all() and (out.score < 0).all()


def test_rare_words_beyond_the_broadcast_are_the_same(spark, odd, monkeypatch):
    want = lm_scoring.op10(spark, odd).toPandas().sort_values(["doc_id", "n_tokens"]).reset_index(drop=True)
    monkeypatch.setattr(lm_scoring, "FREQUENT", 30)
    got = lm_scoring.op10(spark, odd).toPandas().sort_values(["doc_id", "n_tokens"]).reset_index(drop=True)
    assert np.allclose(want.base_score, got.base_score) and np.allclose(want.score, got.score) and (want.n_known == got.n_known).all()


def test_scores_equal_a_plain_class_bigram(spark, odd, monkeypatch):
    """Classes of all words over the floor from their own contexts, and scores, by loops over words."""
    monkeypatch.setattr(lm_scoring, "SEEDS", 12)
    monkeypatch.setattr(lm_scoring, "FREQUENT", 100)
    monkeypatch.setattr(lm_scoring, "LEAST_GAIN", 0)
    split = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
    docs = [(i, [*(t or "").encode().lower().split()]) for i, t in ((r.doc_id, r.text) for r in documents(spark).select("doc_id", "text").collect())]
    code = {w: int(lm_scoring.signed(lm_scoring.tokens([w])[0])[0]) for w in {w for _, ws in docs for w in ws}}
    assert len(set(code.values())) == len(code)
    c = Counter(w for i, ws in docs if not split(i) for w in ws)
    ends = sum(not split(i) for i, _ in docs)
    seeds = sorted(sorted(c, key=lambda w: (-c[w], code[w]))[:12], key=lambda w: code[w] % 2**64)
    unit = lambda w: seeds.index(w) + 1 if w in seeds else 13 + code[w] % lm_scoring.CELLS
    m = np.zeros((13 + lm_scoring.CELLS, 13 + lm_scoring.CELLS))
    for i, ws in docs:
        if not split(i):
            u = [0, *map(unit, ws), 0]
            for a, b in zip(u, u[1:]):
                m[a, b] += 1
    of = lm_scoring.exchange(m)
    k = lm_scoring.CLASSES
    g = lm_scoring.class_pairs(m, of)
    far = [w for w in c if c[w] >= lm_scoring.FLOOR and w not in seeds]
    assert len(far) > 50
    classes, values = {w: int(of[unit(w)]) for w in code}, [lm_scoring.likelihood(g)]
    for _ in range(lm_scoring.PASSES):
        contexts, pairs = {w: np.zeros(2 * k) for w in c}, np.zeros((k, k))
        for i, ws in docs:
            if not split(i):
                own = [0, *(classes[w] for w in ws), 0]
                for at, w in enumerate(ws):
                    contexts[w][own[at]] += 1
                    contexts[w][k + own[at + 2]] += 1
        moved = classes | dict(zip(far, map(int, lm_scoring.best_classes(np.array([contexts[w] for w in far]), g))))
        for i, ws in docs:
            if not split(i):
                own = [0, *(moved[w] for w in ws), 0]
                for a, b in zip(own, own[1:]):
                    pairs[a, b] += 1
        if lm_scoring.likelihood(pairs) <= values[-1]:
            break
        classes, g = moved, pairs
        values.append(lm_scoring.likelihood(g))
    assert len(values) > 2 and values == sorted(values)  # later passes add to the first
    n, v, pairs = Counter(), Counter(), np.zeros((k, k))
    for w in c:
        n[classes[w]] += c[w]
        v[classes[w]] += 1
    for i, ws in docs:
        if not split(i):
            own = [0, *(classes[w] for w in ws), 0]
            for a, b in zip(own, own[1:]):
                pairs[a, b] += 1
    step, want = lm_scoring.transitions(pairs), []
    for i, ws in docs:
        own = [0, *(classes[w] for w in ws), 0]
        want.append((len(ws) + 1, round(sum(step[a, b] for a, b in zip(own, own[1:])) + sum(math.log10((c[w] + 0.5) / (n[classes[w]] + 0.5 * (v[classes[w]] + 1))) for w in ws), 4)))
    got = [(r.n_tokens, round(r.score, 4)) for r in lm_scoring.op10(spark, odd).collect()]
    assert sum(c.values()) + ends == lm_scoring.op10(spark, odd).first().train_tokens
    assert np.allclose(sorted(got), sorted(want), atol=2e-4)


def test_best_class_is_of_most_likelihood():
    r = np.random.default_rng(5)
    g, contexts = r.integers(0, 40, (5, 5)), r.integers(0, 6, (20, 10))
    p = (g + 0.5) / (g.sum(1, keepdims=True) + 2.5)
    share = (g.sum(0) + 0.5) / (g.sum() + 2.5)
    for row, k in zip(contexts, lm_scoring.best_classes(contexts.astype(float), g)):
        value = [sum(n * math.log(p[a, j] / share[j]) for a, n in enumerate(row[:5])) + sum(n * math.log(p[j, b]) for b, n in enumerate(row[5:])) for j in range(1, 5)]
        assert k == 1 + int(np.argmax(value))


def test_lookup_finds_what_is_there():
    r = np.random.default_rng(1)
    for size in (0, 1, 2, 1000):
        known = np.unique(np.concatenate([r.integers(0, 2**64, size, dtype=np.uint64), r.integers(0, 50, min(size, 20), dtype=np.uint64)]))
        asked = np.concatenate([known, known + np.uint64(1), r.integers(0, 2**64, 500, dtype=np.uint64), np.array([0, 2**64 - 1], np.uint64)])
        at = lm_scoring.Lookup(known)(asked)
        where = {int(x): i for i, x in enumerate(known)}
        assert at.tolist() == [where.get(int(x), -1) for x in asked]


def test_model_terms_of_a_text_over_four_megabytes():
    r = np.random.default_rng(2)
    words = [b"w%d" % i for i in range(500)] + [b"Caf\xc3\xa9", b"A" * 300]
    long = b" ".join(words[i] for i in r.integers(0, 502, 900_000)) + b"\n tail"
    assert len(long) > 4 << 20
    h, cell, n = lm_scoring.tokens([long])
    two, _, sizes = lm_scoring.tokens([long, b"", b"one two"])
    assert n[0] == len(h) == len(long.split()) and (two[: n[0]] == h).all() and sizes.tolist() == [n[0], 0, 2]
    names = dict(zip(h.tolist(), long.lower().split()))
    assert len(names) == len(set(long.lower().split()))


def test_class_model_adds_up():
    r = np.random.default_rng(0)
    m = r.integers(0, 30, (40, 40)).astype(float)
    of = lm_scoring.exchange(m, classes=6)
    assert of[0] == 0 and (of[1:] > 0).all()
    assert np.allclose((10 ** lm_scoring.transitions(lm_scoring.class_pairs(m, of, 6))).sum(1), 1)

    def value(of):
        g = np.zeros((6, 6))
        np.add.at(g, (of[:, None], of[None, :]), m)
        f = lm_scoring._f
        return f(g).sum() - f(g.sum(0)).sum() - f(g.sum(1)).sum()

    start = of.copy()
    start[1:] = 1 + np.arange(39) % 5
    assert value(of) > value(start)


PAGE = """<!DOCTYPE html><html><head><title>T {i}</title><style>p{{}}</style><script>var x="<p>no</p>";</script></head><body><header>Site</header><nav><ul>{menu}</ul></nav>
<!-- note --><div class="cookie-notice">We use cookies</div><div id="sidebar-{i}"><p>Side</p></div>{open}<h1>Head&nbsp;line {i}</h1><p>First <b>bo</b>ld &amp; plain {i}.<br>Next</p>{more}{close}
<div class="comments"><p>Reader {i}</p></div><form><input>Send</form><footer>&copy; site</footer></body></html>"""


@pytest.mark.parametrize("open_,close", [("<article>", "</article>"), ("<main>", "</main>"), ('<div class="content">', "</div>"), ("<div>", "</div>")])
def test_wrappers(spark, open_, close):
    pages = []
    for i in range(12):
        more = "".join(f"<p>Paragraph {k} of page {i} goes on and on for a while.</p>" for k in range(i % 4))
        menu = "".join(f"<li><a href=/{k}>Item {k}</a></li>" for k in range(3 + i % 3))
        pages.append((i, f"https://Host.example/{i}", PAGE.format(i=i, menu=menu, open=open_, close=close, more=more)))
    want = {i: " ".join([f"Head line {i}", f"First bold & plain {i}.", "Next", *[f"Paragraph {k} of page {i} goes on and on for a while." for k in range(i % 4)]]) for i in range(12)}
    pages += [(100, None, None), (101, "", ""), (102, "https://host.example/x", "<article><p>cut <b>off"), (103, "https://other.example", "plain words")]
    out = html_extract.main_text(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)).toPandas().set_index("page_id")
    assert {i: out.text[i] for i in want} == want
    assert list(out.text[[100, 101, 103]]) == ["", "", "plain words"]
    assert (out.n_chars == out.text.str.len()).all()


def test_wrapper_beyond_the_broadcast_bound_is_the_same(spark, sf_dir, monkeypatch):
    want = {r.page_id: r.text for r in html_extract.op2(spark, sf_dir).collect()}
    monkeypatch.setattr(html_extract, "BROADCAST_MB", 0)
    assert {r.page_id: r.text for r in html_extract.op2(spark, sf_dir).collect()} == want
    for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect():
        import html

        article = re.search(r"<article>(.*?)(</article>|$)", r.html, re.S)[1]
        assert want[r.page_id] == " ".join(html.unescape(re.sub("<[^>]*>", " ", article)).split())


def extracted(spark, pages):
    rows = [(i, "https://host.example/", p) for i, p in enumerate(pages)]
    return [r.text for r in html_extract.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).orderBy("page_id").collect()]


def test_the_wrapper_decides_within_articles(spark):
    page = "<article><div class=box>{box}</div><p>Text {i}</p></article>"
    pages = [page.format(box="Support us", i=i) for i in range(8)] + [page.format(box="Own box", i=8), "<article><p>Bare</p></article>"]
    fixed = [page.format(box="Support us", i=i) for i in range(8)] + ["<article><p>Bare</p></article>"]
    assert extracted(spark, pages)[8:] == ["Own box Text 8", "Bare"]  # a box that differs is not fixed
    assert extracted(spark, fixed) == [*[f"Text {i}" for i in range(8)], "Bare"]
    assert extracted(spark, [page.format(box="Support us", i=0)] * 8) == ["Support us Text 0"] * 8  # copies


def test_article_of_each_page(spark):
    deep = "<div>" * 105 + "x" + "</div>" * 105
    pages = [
        "<main><article><p>In article</p></article></main>",
        "<main><p>Only main</p></main>",
        "<aside><article>teaser</article></aside><div class=content><p>By mass, long enough</p></div>",
        "<html class='nav-open'><body class='has-sidebar'><div class='with-sidebar'><article><p>Layout</p></article></div></body></html>",
        "<div class='sidebar layout'><article><p>Around</p></article></div>",
        f"<article>{deep}<p>after</p></article>",
    ]
    for one in (extracted(spark, pages), [extracted(spark, [p])[0] for p in pages]):
        assert one == ["In article", "Only main", "By mass, long enough", "Layout", "Around", "x after"]


def test_class_names_and_captions_do_not_matter(spark):
    for name in ("related", "post search-result", "legal-news", "story banner", "content comment-policy"):
        pages = [f"<nav><a href=/>Home</a></nav><article class='{name}'><header><h1>Head {i}</h1></header><figure><figcaption>Caption {i}</figcaption></figure><p>Text of page {i}</p></article>" for i in range(6)]
        assert extracted(spark, pages) == [f"Head {i} Caption {i} Text of page {i}" for i in range(6)]


PARTS_BESIDE = [
    "<ul><li><a href=/a>Leak one</a></li><li><a href=/b>Leak two</a></li></ul>",
    "<div class='ad'>Leak: buy number {i} now.</div>",
    "<div class='comments'><div class='comment'><b>Ann</b><p>Leak, nice {i}</p></div><div class='comment'><b>Bob</b><p>Leak, no {i}</p></div></div>",
    "<section id=comments><p>Leak {i}</p><p>Leak again {i}</p></section>",
    "<div role=complementary><p>Leak {i}</p></div>",
    "<div class='newsletter-box-2'>Leak: write to us {i}</div>",
    "<nav><p>Leak {i}</p></nav><form><p>Leak {i}</p></form>",
]


@pytest.mark.parametrize("part", PARTS_BESIDE)
def test_what_stands_within_an_article_without_being_it(spark, part):
    """On every page of the table, whatever the number of its host's pages; no article text is lost."""
    import html

    rows, want = [], {}
    for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect():
        article = re.search(r"<article>(.*?)(</article>|$)", r.html, re.S)[1]
        want[r.page_id] = " ".join(html.unescape(re.sub("<[^>]*>", " ", article)).split())
        at = r.html.index("</article>") if r.page_id % 2 else r.html.index("</h1>") + 5
        rows.append((r.page_id, r.url, r.html[:at] + part.format(i=r.page_id) + r.html[at:]))
    out = html_extract.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in out} == want


def test_named_and_linked_parts_that_are_the_article(spark):
    pages = [
        "<article class='comment'><p>All of it is marked</p></article>",
        "<article><p>Short.</p><section class='news-story'><p>Most of the article stands here</p></section></article>",
        "<article><p>See <a href=/x>the report</a> for more.</p><p><a href=/y>One linked line</a></p></article>",
        "<article><ul><li><a href=/a>A list of links</a></li><li><a href=/b>is all there is</a></li></ul></article>",
        "<article><p>An essay on ads that is long enough to be one.</p><div class='comment-policy'>Kept</div></article>",
    ]
    want = ["All of it is marked", "Short. Most of the article stands here", "See the report for more. One linked line", "A list of links is all there is", "An essay on ads that is long enough to be one. Kept"]
    assert [extracted(spark, [p])[0] for p in pages] == want


def test_divisions_of_unlike_contents_are_kept_apart(spark):
    page = "<div><ul><li><a href=/>Home</a></li></ul></div><div><h1>Head {i}</h1><p>Text of page {i} that goes on and on, as an article does, for a line or two at least</p><p>More of it {i}</p></div><div>Imprint {i}</div>"
    assert extracted(spark, [page.format(i=i) for i in range(6)]) == [f"Head {i} Text of page {i} that goes on and on, as an article does, for a line or two at least More of it {i}" for i in range(6)]


def unnamed(r, i):
    """A page of divisions whose names tell nothing, and its article text: what varies and is long."""
    blocks = [f"Sentence {k} of page {i} " + "goes on " * r.randint(5, 15) for k in range(r.randint(1, 6))]
    terms = [(f"term {i} {k}", f"meaning {i} {k} that is told at length") for k in range(r.choice([0, 0, 3, 5]))]
    menu = "".join(f"<div class=x1><a href=/{k}>Menu {k}</a></div>" for k in range(r.randint(3, 6)))
    body = f"<h1>Title {i}</h1>" + "".join(f"<p>{b}</p>" for b in blocks) + ("<dl>" + "".join(f"<dt>{a}<dd>{b}" for a, b in terms) + "</dl>" if terms else "")
    html = f"<html><body><div class=x0>{menu}</div><div class=x0><div class=z9>Subscribe to us today</div><div class=q7>{body}</div></div><div class=x0><div>About</div><div>Imprint {i}</div></div></body></html>"
    return html, " ".join([f"Title {i}", *(b.strip() for b in blocks), *(x for t in terms for x in t)])


def test_host_without_helpful_names(spark):
    import random

    r = random.Random(8)
    pages, want = zip(*(unnamed(r, i) for i in range(40)))
    assert extracted(spark, pages) == list(want)


def test_any_order_and_partitioning_gives_the_same(spark, sf_dir):
    import random

    r = random.Random(9)
    rows = [(f"p{k}", "https://one.example/", unnamed(r, k)[0]) for k in range(150)] + [(f"q{x.page_id}", "http://two.example", x.html) for x in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    seen = []
    for parts, order in ((1, rows), (7, rows[::-1]), (4, r.sample(rows, len(rows)))):
        df = spark.createDataFrame(order, "page_id string, url string, html string").repartition(parts)
        seen.append((sorted(tuple(x) for x in html_extract.main_text(df).collect()), sorted((x.host, bytes(x.wrapper)) for x in html_extract.wrappers(df.withColumn("host", html_extract.host())).collect())))
    assert seen[0] == seen[1] == seen[2] and len(seen[0][0]) == len(rows)
    assert spark.createDataFrame(rows, "page_id string, url string, html string").count() > html_extract.FAN_IN  # more than one round


def test_repeats_of_several_elements_and_long_pages():
    page = lambda n, i: "<article><dl>" + "".join(f"<dt>word {k} {i}</dt><dd>sense {k} {i}</dd>" for k in range(n)) + "</dl></article>"
    import random
    import time

    r = random.Random(1)
    kinds = ["h2", "p", "table", "ul", "pre", "blockquote"]
    mixed = lambda n, i: "<article>" + "".join(f"<{k}>{j} {i}</{k}>" for j, k in enumerate(r.choice(kinds) for _ in range(n))) + "</article>"
    began = time.monotonic()
    for make, n in ((page, 20_000), (mixed, 20_000), (mixed, 350)):
        pages = [html_extract.parse(make(n, i)) for i in range(3)]
        wrapper = html_extract.skeleton(pages[0])
        for p in pages[1:]:
            wrapper = html_extract.merge(wrapper, html_extract.skeleton(p))
        count = lambda g: 1 + sum(map(count, g[1])) if g[0] != "#" else 1
        assert count(wrapper) < 2000
        rule = html_extract.Rule(wrapper)
        for p in pages:
            flat = lambda g: [g[1]] if g[0] == "#" else [x for c in g[1] for x in flat(c)]
            assert html_extract.extract(p, rule) == " ".join(flat(p))
    assert time.monotonic() - began < 60
    one = html_extract.skeleton(html_extract.parse(page(5, 1)))
    (dl,) = one[1][0][1]
    assert [c[0] for c in dl[1]] == ["*"] and [c[0] for c in dl[1][0][1]] == ["dt", "dd"]


def test_alignment_is_of_largest_likeness():
    import random

    r = random.Random(2)
    node = lambda: [r.choice("abc"), [[r.choice("xy"), [], 1, False]], 1, False]
    for _ in range(200):
        x, y = ([node() for _ in range(r.randint(0, 6))] for _ in range(2))

        def best(i, j):
            if i == len(x) or j == len(y):
                return 0.0
            own = html_extract.likeness(x[i], y[j])
            return max(best(i + 1, j), best(i, j + 1), best(i + 1, j + 1) + own if own else 0.0)

        found = html_extract.pairs_of(x, y)
        if not (len(x) == len(y) and len(found) == len(x)):
            assert abs(sum(html_extract.likeness(x[i], y[j]) for i, j in found) - best(0, 0)) < 1e-9
        assert all(a < c and b < d for (a, b), (c, d) in zip(found, found[1:]))


def test_pages_of_odd_tables(spark):
    schema = "page_id long, url string, html string, host string, wrapper string, place long, by long, n long, text string"
    none = html_extract.main_text(spark.createDataFrame([], schema))
    assert none.count() == 0
    rows = [(1, None, None), (None, "http://h.example/", "<p>a</p>"), (2, "http://h.example/", "<p>a</p>"), (2, "http://h.example/", "<p>a</p>"), (3, "no url", "x" * 5_000_000), (4, "http://h.example/", "<article>" + "<p>word</p>" * 300_000)]
    df = spark.createDataFrame([(*x, "h", "w", 1, 2, 3, "t") for x in rows], schema)
    got = sorted(((r.page_id or 0), r.text) for r in html_extract.main_text(df).collect())
    assert [(i, len(t)) for i, t in got] == [(0, 1), (1, 0), (2, 1), (2, 1), (3, 5_000_000), (4, 1_499_999)]


def test_word_tables_that_grow_old_give_the_same_ids(monkeypatch):
    r = np.random.default_rng(4)
    words = ["w%d" % i for i in range(200)] + ["Été,", "naïve!", "x" * 50, "A.B", "日本"]
    texts = [" ".join(words[i] for i in r.zipf(1.3, 60) % len(words)) for _ in range(60)] + [None, ""]
    want = packing.WordEncoder(packing.default_tokenizer()).ids(texts)
    monkeypatch.setattr(packing, "KEPT_WORDS", 20)
    own = packing.WordEncoder(packing.default_tokenizer())
    assert [x for i in range(0, len(texts), 4) for x in own.ids(texts[i : i + 4])] == want and len(own.old_kept) > 20
