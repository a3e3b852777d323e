"""Language identification against a plain restatement of it: words, trigrams, EM, penalised sets."""

import math
import random
import re

import numpy as np
import pytest

from markgrid.llm import language_id as li

LANGS = {"aa": "the cat sat on a mat and ran home again", "bb": "der hund lief schnell über die straße nach haus", "cc": "él niño corrió muy rápido hacia su casa ayer"}


def words_of(text):
    low = bytes(c + 32 if 65 <= c <= 90 else c for c in text.encode())
    return re.findall(rb"[^\x20\x09-\x0D]+", low)


def cells_of(word):
    p = b" " + word + b" "
    return [((p[i] << 16 | p[i + 1] << 8 | p[i + 2]) * 2654435761 % 2**32) >> 16 for i in range(len(word))]


def plain_model(rows):
    langs = sorted({lang for _, lang in rows if lang is not None})
    n = np.zeros((li.CELLS, len(langs)))
    for text, lang in rows:
        if text is not None and lang is not None:
            for w in words_of(text):
                for c in cells_of(w):
                    n[c, langs.index(lang)] += 1
    return langs, np.array([[math.log(x) for x in row] for row in (n + li.SMOOTH) / (n + li.SMOOTH).sum(0)]).astype(np.float32)


def em(like, allowed):
    k = len(allowed)
    p = [a / sum(allowed) for a in allowed]
    for _ in range(li.ROUNDS):
        total = [0.0] * k
        for w in like:
            parts = [w[i] * p[i] for i in range(k)]
            whole = max(sum(parts), 1e-30)
            total = [t + x / whole for t, x in zip(total, parts)]
        p = [t / len(like) for t in total]
    return p, sum(math.log(max(sum(x * y for x, y in zip(w, p)), 1e-30)) for w in like)


def plain_prediction(text, langs, model):
    """lang_pred and proportions of the chosen set, every number of languages tried."""
    if text is None or not any(c.isalpha() for c in text):
        return "und", {}
    like, k = [], len(langs)
    logs = [[sum(float(model[c, i]) for c in cells_of(w)) for i in range(k)] for w in words_of(text)]
    like = [[math.exp(x - max(w)) for x in w] for w in logs]
    full, _ = em(like, [1.0] * k)
    order = sorted(range(k), key=lambda i: (-full[i], i))
    cost = li.PENALTY * math.log(len(like) + 1)
    ones = [sum(w[i] - max(w) for w in logs) for i in range(k)]
    top = max(range(k), key=lambda i: (ones[i], -i))
    best, props = ones[top] - cost, [float(i == top) for i in range(k)]
    for j in range(2, k + 1):
        q, value = em(like, [float(i in order[:j]) for i in range(k)])
        if value - j * cost > best:
            best, props = value - j * cost, q
    return langs[max(range(k), key=lambda i: (props[i], -i))], {x: p for x, p in zip(langs, props) if p > 0}


def sample(r, lang, n):
    return " ".join(r.choice(LANGS[lang].split()) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    r = random.Random(3)
    out = [(sample(r, lang, 60), lang) for lang in LANGS for _ in range(4)]
    return out + [(None, "aa"), ("lost words", None), ("", "bb"), out[0]]


def test_model_is_of_counted_trigrams(spark, rows):
    langs, model = li.learn(spark.createDataFrame(rows, "text string, lang string").repartition(3))
    want_langs, want = plain_model(rows)
    assert langs == want_langs
    assert np.abs(model - want).max() < 1e-5


def test_predictions_equal_a_plain_search(spark, rows):
    r = random.Random(4)
    docs = [sample(r, lang, n) for lang in LANGS for n in (1, 2, 5, 40)]
    docs += [sample(r, a, n) + "\n" + sample(r, b, m) for a, b, n, m in [("aa", "bb", 40, 40), ("cc", "aa", 200, 30), ("bb", "cc", 3, 90), ("aa", "cc", 15, 1)]]
    docs += [sample(r, "aa", 60) + " " + sample(r, "bb", 60) + " " + sample(r, "cc", 60), "zzz qqq", "A", "12 !!", "", None, " \t\n", "Über\x00niño \x1c x", "1a2"]
    docs += [" ".join(r.choice(sum((s.split() for s in LANGS.values()), [])) for _ in range(n)) for n in (3, 7, 20, 80)]
    langs, model = plain_model(rows)
    got = {x.doc_id: x for x in li.predict(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(3), langs, model).collect()}
    sets = set()
    for i, text in enumerate(docs):
        lang, props = plain_prediction(text, langs, model)
        assert got[i].lang_pred == lang, text
        assert set(got[i].languages) == set(props), text
        assert all(abs(got[i].languages[x] - p) < 1e-6 for x, p in props.items())
        assert abs(got[i].score - max(props.values(), default=0.0)) < 1e-6
        sets.add(len(props))
    assert sets == {0, 1, 2, 3}


def test_ties_go_to_the_first_by_name(spark):
    same = [("one two three", "yy"), ("one two three", "xx")]
    langs, model = li.learn(spark.createDataFrame(same, "text string, lang string"))
    got = li.predict(spark.createDataFrame([(1, "two one"), (2, "nothing known")], "doc_id long, text string"), langs, model).collect()
    assert {x.lang_pred for x in got} == {"xx"} and {x.score for x in got} == {1.0}


def test_text_over_four_megabytes_is_as_in_one_piece(spark, rows, monkeypatch):
    r = random.Random(5)
    long = (sample(r, "aa", 5000) + "\n" + sample(r, "bb", 20_000) + "\t") * 40
    assert len(long.encode()) > 4 << 20
    langs, model = plain_model(rows)
    cut = li.word_likelihoods(long.encode(), model)
    monkeypatch.setattr(li, "slices", lambda raw: [raw])
    whole = li.word_likelihoods(long.encode(), model)
    assert cut.shape == whole.shape == (len(long.split()), len(langs)) and (cut == whole).all()
    got = li.predict(spark.createDataFrame([(1, long)], "doc_id long, text string"), langs, model).first()
    props, _ = li.infer(whole.astype(np.float64), np.array([len(whole)]))
    assert got.lang_pred == "bb" and abs(got.languages["aa"] - 0.2) < 0.02 and abs(got.score - props[0].max()) < 1e-9
