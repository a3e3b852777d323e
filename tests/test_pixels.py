import numpy as np

from markgrid.operators import kernels
from markgrid.plans import grading as g
from markgrid.sources import images
from markgrid.sources.marks import dense_marks

from . import sheets


def test_round_trip_of_a_few_sheets(spark, sf_dir):
    marks = dense_marks(spark, sf_dir).where("sheet % 100 = 0")
    got = {(r.sheet, r.q): r for r in sheets.read_again(spark, marks).collect()}
    want = g.graded(marks, g.V3O, 10).collect()
    assert {(r.sheet, r.q) for r in want} == set(got)
    clear = [r for r in want if r.note == "ok" and r.fill > 0.4]
    assert clear and all(got[r.sheet, r.q].choice == r.choice for r in clear)
    blank = [r for r in want if r.fill == 0]
    assert blank and all(got[r.sheet, r.q].choice is None for r in blank)


def test_png_scan_with_dead_letters(spark, tmp_path):
    gray = np.random.default_rng(0).integers(0, 256, (20, 30)).astype(np.uint8)
    (tmp_path / "a.png").write_bytes(images.encode_png(gray))
    (tmp_path / "b.png").write_bytes(b"broken")
    (tmp_path / "c.txt").write_bytes(b"other")
    rows = {r.path.rsplit("/", 1)[1]: r for r in images.decoded(images.scans(spark, str(tmp_path))).collect()}
    assert set(rows) == {"a.png", "b.png"}
    assert rows["a.png"].error is None and (rows["a.png"].h, rows["a.png"].w) == (20, 30) and bytes(rows["a.png"].gray) == gray.tobytes()
    assert rows["b.png"].error and rows["b.png"].gray is None


def test_warp_undoes_a_perspective():
    page = kernels.render(np.array([200, 500]), np.array([300, 700]), 12, np.array([0.9, 0.0]))
    corners = np.array([[36.0, 36], [714, 36], [714, 1024], [36, 1024]])
    seen = np.array([[60.0, 50], [700, 30], [690, 1000], [40, 1030]])
    photo = kernels.warp(page, kernels.homography(corners, seen))
    back = kernels.warp(photo, kernels.homography(seen, corners))
    dark, mask = kernels.dark_pixels(kernels.even_light(back), np.array([200, 500]), np.array([300, 700]), 11)
    assert dark[0] / mask > 0.7 > 0.35 > dark[1] / mask
    assert 0 < kernels.sharpness(page) <= 1 and kernels.sharpness(np.full((9, 9), 7, np.uint8)) == 0


def darkness_model():
    """Scores by the mean darkness of the middle of a crop."""

    def predict(images):
        dark = 1 - images[:, 12:20, 12:20].mean(axis=(1, 2))
        return np.stack([1 - 4 * dark, 4 * dark - 1, 0 * dark], axis=1).astype(np.float32)

    return predict


def test_model_path(spark, sf_dir):
    from markgrid.operators import classify
    from markgrid.sources import templates as t

    pages = sheets.drawn(spark, dense_marks(spark, sf_dir).where("sheet < 3")).persist()
    cells = t.grid(t.templates(spark))
    scored = classify.with_scores(classify.crops(pages, cells), darkness_model)
    fills = kernels.measured(pages, cells).selectExpr("sheet", "q", "rank", "dark / mask AS fill")
    out = classify.decided(scored.join(fills, ["sheet", "q", "rank"])).select("fill", "status", "confidence").toPandas()
    assert len(out) == 50 * pages.count()
    assert set(out[out.fill > 0.5].status) == {"filled"} and set(out[out.fill < 0.02].status) == {"empty"}
    assert out.confidence.between(0.33, 1).all()
    pages.unpersist()


def test_decision_on_unsure_crops(spark):
    from markgrid.operators import classify

    rows = spark.createDataFrame([([0.0, 0.0, 3.0], 0.5), ([0.0, 0.0, 3.0], 0.1), ([0.0, 0.0, 3.0], 0.25), ([0.0, 2.0, 0.0], 0.0)], "scores array<float>, fill double")
    assert [r.status for r in classify.decided(rows).collect()] == ["filled", "empty", "ambiguous", "filled"]
