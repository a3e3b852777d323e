"""Layout operators, output formats, upload rules and the stream of scanned sheets."""

import itertools
import math
import struct
import zlib

import numpy as np
from pyspark.sql import functions as F

from markgrid.functions import columns as fc
from markgrid.operators import codes, kernels, layout, requests
from markgrid.operators.timing import StageTimes
from markgrid.sources import images
from markgrid.sources import templates as t
from markgrid.streaming import sheets


def test_rounding_is_pythons(spark):
    r = np.random.default_rng(0)
    values = [*r.random(3000).tolist(), *(r.random(500) / 1000).tolist(), 2.675, 0.125, 0.375, 1.0, 0.0, 0.00005, 0.00015, 0.5, 1.5, 2.5, 37.5, 38.5, *[k / 32 for k in range(64)], *[k / 20000 for k in range(1, 400)]]
    rows = spark.createDataFrame([(v,) for v in values], "x double").select("x", *[fc.rounded(F.col("x"), d).alias(f"d{d}") for d in (0, 2, 3, 4)], fc.percent(F.col("x")).alias("p")).collect()
    for x in rows:
        assert [x.d0, x.d2, x.d3, x.d4] == [round(x.x), round(x.x, 2), round(x.x, 3), round(x.x, 4)], x
        assert x.p == "%.0f%%" % (x.x * 100)


def test_file_names(spark):
    import pathlib

    names = ["a/b/Scan.PNG", "x.tar.gz", "none", ".hidden", "dir.d/file", "", "up/é.JpEg", "a."]
    got = spark.createDataFrame([(n,) for n in names], "n string").select("n", fc.suffix(F.col("n")).alias("s"), fc.stem(F.col("n")).alias("t")).collect()
    assert [(r.s, r.t) for r in got[:7]] == [(pathlib.PurePosixPath(n).suffix.lower() or ".jpg", pathlib.PurePosixPath(n).stem) for n in names[:7]]


def brute_lattice(columns, rows, y0, y1):
    steps = [np.diff(sorted(c)) for c in columns]
    steps = [float(np.median(s[s > 5])) for s in steps if len(s) and (s > 5).any()]
    uniform = [round(y0 + (i + 0.5) * (y1 - y0) / rows) for i in range(rows)]
    if not steps or np.median(steps) < 5:
        return None, 0.0, uniform
    pitch, flat = float(np.median(steps)), sorted(y for c in columns for y in c)
    tries = [flat[0] - pitch / 2 + k for k in range(math.ceil(pitch + 1))]
    errors = [sum(min(abs(y - (t0 + i * pitch)) for i in range(rows)) for y in flat) for t0 in tries]
    row0 = tries[errors.index(min(errors))]
    lattice = [round(row0 + i * pitch) for i in range(rows)]
    return row0, sum(min(abs(y - v) for v in lattice) <= 12 for y in flat) / len(flat), lattice


def test_lattice_fit(spark):
    r = np.random.default_rng(1)
    want, data = {}, []
    for s in range(60):
        pitch = int(r.integers(6, 60)) if s % 4 else int(r.integers(1, 6))
        columns = [sorted({int(100 + i * pitch + r.integers(-2, 3)) for i in range(int(r.integers(1, 9)))}) for _ in range(3)]
        data += [(s, c, y) for c, ys in enumerate(columns) for y in ys]
        want[s] = brute_lattice(columns, 12, 239, 999)
    got = layout.fit_lattice(spark.createDataFrame(data, "sheet long, col int, y int"), "sheet", 12, 239, 999).collect()
    assert len(got) == 60
    for x in got:
        row0, quality, lattice = want[x.sheet]
        assert x.row0 == row0 and abs(x.quality - quality) < 1e-12 and list(x.lattice) == lattice
    assert any(x.row0 is None for x in got) and any(x.quality == 1 for x in got)


def test_best_quad(spark):
    r = np.random.default_rng(2)
    data = [(0, i, x, y) for i, (x, y) in enumerate([(40, 40), (300, 500), (710, 36), (712, 1020), (400, 300), (38, 1024)])]  # a page's corners and two marks
    data += [(p, i, int(x), int(y)) for p in range(1, 40) for i, (x, y) in enumerate(zip(r.integers(0, 750, 9), r.integers(0, 1060, 9)))]
    data += [(50, i, 10 * i, 5) for i in range(3)]
    got = {x.page: tuple(x)[1:] for x in layout.best_quad(spark.createDataFrame(data, "page long, place int, cx int, cy int"), "page", 39750.0).collect()}
    assert got[0][:8] == (40, 40, 710, 36, 712, 1020, 38, 1024) and 50 not in got
    for page in range(40):
        best, area = None, 39750.0
        for quad in itertools.combinations([d[2:] for d in data if d[0] == page], 4):
            tl, tr, br, bl = (min(quad, key=lambda p: (k(*p), *p)) for k in (lambda x, y: x + y, lambda x, y: y - x, lambda x, y: -x - y, lambda x, y: x - y))
            ring = [tl, tr, br, bl]
            size = abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1]))) / 2
            like = lambda a, b: min(a, b) / (max(a, b) + 1e-6) > 0.7
            if size > area and like(math.dist(tl, tr), math.dist(bl, br)) and like(math.dist(tl, bl), math.dist(tr, br)):
                best, area = (*tl, *tr, *br, *bl, size), size
        assert got.get(page) == best


def test_spans_bars_and_columns(spark):
    spans = spark.createDataFrame([(1, 0, 20), (1, 15, 40), (1, 41, 45), (1, 60, 61), (2, 5, 9)], "sheet long, start int, stop int")
    runs = layout.covered(spans, ["sheet"])
    assert sorted(map(tuple, runs.collect())) == [(1, 0, 45, 46), (1, 60, 61, 2), (2, 5, 9, 5)]
    assert sorted(map(tuple, layout.covered(spans, ["sheet"], 14).collect())) == [(1, 0, 61, 62), (2, 5, 9, 5)]
    assert [tuple(x) for x in layout.wide(runs, 10).collect()] == [(1, 0, 45, 46)]
    printed = spark.createDataFrame([(1, [(64, 375), (375, 686)]), (2, [(64, 375), (375, 686)]), (3, [(64, 375), (375, 686)])], "sheet long, printed array<struct<x0:int,x1:int>>")
    got = sorted(map(tuple, layout.columns_from_bars(printed, runs.select("sheet", "start", "stop"), "sheet").collect()))
    assert got == [(1, 0, 0, 45, True), (1, 1, 60, 61, True), *[(s, i, *x, False) for s in (2, 3) for i, x in enumerate([(64, 375), (375, 686)])]]
    ys = spark.range(1).select(layout.uniform_rows(F.lit(239.0), F.lit(999.0), F.lit(30)).alias("a"), layout.uniform_rows(F.lit(239.0), F.lit(999.0), F.lit(30), True).alias("b"), layout.uniform_rows(F.lit(0.0), F.lit(9.0), F.lit(0)).alias("c")).first()
    exact = [239 + (i + 0.5) * (760 / 30) for i in range(30)]
    assert list(ys.a) == [round(y) for y in exact] and list(ys.b) == [int(y) for y in exact] and list(ys.c) == []


def test_split_does_not_need_one_window_a_group(spark):
    rows = spark.createDataFrame([(i * i % 9973, "one" if i % 3 else "two") for i in range(2000)], "k long, g string").distinct()
    got = codes.every_nth_split(rows, ["g"], ["k"], 5, ranges=16).collect()
    for g in ("one", "two"):
        own = sorted((x for x in got if x.g == g), key=lambda x: x.k)
        assert [x.split for x in own] == ["val" if i % 5 == 0 else "train" for i in range(len(own))] and len(own) > 100


def test_upload_rules(spark):
    png, jpeg = images.encode_png(np.zeros((3, 3))), b"\xff\xd8\xff\xe0rest"
    rows = [(1, png, "Q10_5ch"), (2, jpeg, "Q10_5ch"), (3, b"", "Q10_5ch"), (4, None, "Q10_5ch"), (5, b"GIF89a", "Q10_5ch"), (6, png, "Q11_5ch"), (7, png, None), (8, jpeg + b"x" * 500, "Q10_5ch")]
    got = requests.checked(spark.createDataFrame(rows, "id int, content binary, template_id string"), t.templates(spark), most=400)
    code, message = requests.explained(F.col("status"))
    out = {r.id: r for r in got.withColumns({"code": code, "message": message}).collect()}
    assert {i: r.status for i, r in out.items()} == {1: 200, 2: 200, 3: 400, 4: 400, 5: 415, 6: 422, 7: 422, 8: 413}
    assert out[1].kind == "png" and out[2].kind == "jpeg" and out[1].code is None and out[8].code == "UPLOAD_TOO_LARGE"
    assert spark.range(1).select(requests.explained(F.lit(500))[0].alias("c")).first().c == "INTERNAL_ERROR"


def test_png_filters():
    gray = np.random.default_rng(3).integers(0, 256, (6, 11, 3)).astype(np.uint8)
    lines, up = [], np.zeros(33, int)
    for y in range(6):
        row = gray[y].ravel().astype(int)
        left = np.concatenate([[0, 0, 0], row[:-3]])
        corner = np.concatenate([[0, 0, 0], up[:-3]])
        p = left + up - corner
        paeth = [min((a, b, c), key=lambda v: abs(q - v)) for a, b, c, q in zip(left, up, corner, p)]
        guess = {0: 0 * row, 1: left, 2: up, 3: (left + up) // 2, 4: np.array(paeth)}[y % 5]
        lines.append(bytes([y % 5]) + ((row - guess) % 256).astype(np.uint8).tobytes())
        up = row
    part = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    raw = b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", 11, 6, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(b"".join(lines))) + part(b"IEND", b"")
    assert (images.decode_png(raw) == np.rint(gray @ np.array([0.299, 0.587, 0.114])).astype(np.uint8)).all()


def test_stream_of_sheets(spark, tmp_path):
    """Drawn pages through the landing folder: answers, results, dead letters; batches run twice change nothing."""
    cells = t.grid(t.templates(spark).where("template_id = 'Q10_4ch'")).toPandas()
    r, want = np.random.default_rng(5), {}
    folder, out = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    for i in range(3):
        picks = {q: int(r.integers(-1, 4)) for q in range(1, 11)}
        share = [0.8 if picks[q] == c else 0.0 for q, c in zip(cells.q, cells.choice_rank)]
        page = kernels.render(cells.cx.to_numpy(), cells.cy.to_numpy(), int(cells.r.iloc[0]), np.array(share), seed=i, shade=0.2, noise=2.0)
        (folder / f"Q10_4ch__{i}.png").write_bytes(images.encode_png(page))
        want |= {(f"Q10_4ch__{i}.png", q): ("ABCD"[c] if c >= 0 else None) for q, c in picks.items()}
    (folder / "Q10_4ch__broken.png").write_bytes(b"\x89PNG\r\n\x1a\nbroken")
    (folder / "Q10_4ch__small.png").write_bytes(images.encode_png(np.zeros((9, 9))))
    (folder / "Q10_4ch__text.jpg").write_bytes(b"no image")
    (folder / "Q11_4ch__odd.png").write_bytes(images.encode_png(np.zeros((9, 9))))
    sheets.run(spark, str(folder), out)
    (folder / "Q10_4ch__late.jpeg").write_bytes(b"GIF89a")
    sheets.run(spark, str(folder), out)  # goes on with what is new
    name = lambda p: p.rsplit("/", 1)[1]
    read = lambda x: spark.read.parquet(f"{out}/{x}")
    assert {(name(x.path), x.q): x.choice for x in read("answers").collect()} == want
    assert {name(x.path): x.answered for x in read("results").collect()} == {f: sum(v is not None for (g, _), v in want.items() if g == f) for f, _ in want}
    errors = {name(x.path): x.status for x in read("errors").collect()}
    assert errors == {"Q10_4ch__broken.png": 422, "Q10_4ch__small.png": 422, "Q10_4ch__text.jpg": 415, "Q11_4ch__odd.png": 422, "Q10_4ch__late.jpeg": 415}
    files = images.scans(spark, str(folder)).where("path NOT LIKE '%late%'").withColumn("template_id", F.regexp_extract("path", r"([^/]*)__[^/]*$", 1))
    times = StageTimes()
    sheets.read_batch(files, 0, out, times)  # the same batch again
    assert read("answers").count() == len(want) and read("errors").count() == 5 and read("results").count() == 3
    assert [(x["stage"], x["rows"]) for x in times.records] == [("decode", 5), ("measure", 120), ("grade", 30)] and 0 < sum(x["seconds"] for x in times.records) <= times.elapsed()
