"""A small documents table with every odd case, and near copies."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n long, rep long, component_id long, token long, kept boolean, digest string, domain string, tokens long, score double, l long, a long, b long"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(r, n):
    return " ".join(r.choice(WORDS) + r.choice(["", "s", "ed", "ing", "ly"]) for _ in range(n))


def texts():
    r = random.Random(5)
    base = prose(r, 120)
    words = base.split()
    out = {1: base, 2: base.upper(), 3: " ".join(words[:60] + ["changed"] + words[61:]), 4: " ".join(words[:-1] + ["other"]), 5: prose(r, 90), 6: None, 7: "", 8: " \n\t ", 9: "one", 10: "One", 11: "two words"}
    out[12] = "the very same line\n" * 40
    out[13] = prose(r, 300) + "\n" + "### $$$ *** " * 50
    out[14] = "x" * 300_000
    out[15] = prose(r, 60_000)
    out[16] = "é ü ß \x1c 日本語 \x00 🙂 " * 3
    out[17] = words[0] + " " + words[1] + " " + words[2]
    near = prose(r, 150).split()
    for i in range(18, 40):
        w = list(near)
        for _ in range(r.randint(0, 4)):
            w[r.randrange(len(w))] = "edit%d" % r.randrange(10**6)
        out[i] = " ".join(w)
    for i in range(40, 60):
        out[i] = prose(r, r.randint(1, 80))
    return out


def rows(repeat=True):
    out = []
    for i, t in texts().items():
        out.append((i, t, [None, "en", "fr"][i % 3], [None, "src0", "src0", "src7"][i % 4], len(t or "")))
    if repeat:
        out += [out[0], out[0], (None, out[4][1], "en", "src1", 1), (None, None, None, None, None)]
    return [(*x, 7, 7, 7, 7, True, "d", "domain9", 7, 0.5, 7, 7, 7) for x in out]


def documents(spark, repeat=True):
    return spark.createDataFrame(rows(repeat), SCHEMA).repartition(3)


def folder(spark, path, docs=None, labels=None):
    """documents.parquet and labels.parquet below path."""
    (docs if docs is not None else documents(spark, False)).write.mode("overwrite").parquet(f"{path}/documents.parquet")
    labels = labels if labels is not None else spark.createDataFrame([(i, i % 2, 0) for i in range(1, 60)] + [(None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int")
    labels.write.mode("overwrite").parquet(f"{path}/labels.parquet")
    return path
