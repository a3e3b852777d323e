import datetime
import json

from markgrid.sources import sinks, templates
from markgrid.streaming import scans


def test_results_and_read_back(spark, tmp_path):
    results = spark.createDataFrame([("r1", "E1", "أ"), ("r2", "E2", "B")], "run_id string, exam_code string, choice string")
    sinks.write_results(results, str(tmp_path / "results"), "job1")
    sinks.write_results(results.where("run_id = 'r1'"), str(tmp_path / "results"), "job1")  # run again: replaced
    back = spark.read.json(str(tmp_path / "results"))
    assert {(r.run_id, r.exam_code, r.choice) for r in back.collect()} == {("r1", "E1", "أ"), ("r2", "E2", "B")}
    errors = spark.createDataFrame([("r3", "x")], "run_id string, error string")
    wanted = spark.createDataFrame([("r1",), ("r3",), ("r4",)], "run_id string")
    assert {r.run_id: r.status for r in sinks.read_back(back, errors, wanted).collect()} == {"r1": 200, "r3": 422, "r4": 404}


def test_retention_and_dead_letters(spark, tmp_path):
    now = datetime.datetime(2024, 1, 2)
    files = spark.createDataFrame([("a", now - datetime.timedelta(hours=24)), ("b", now - datetime.timedelta(hours=23))], "path string, modificationTime timestamp")
    assert [r.path for r in sinks.expired(files, now, 24).collect()] == ["a"]
    from pyspark.sql import functions as F

    batch = spark.createDataFrame([(1, 5), (2, None)], "id int, size int")
    scans.split_rejects(batch, 0, F.when(F.col("size").isNull(), "no size"), str(tmp_path / "good"), str(tmp_path / "bad"))
    assert spark.read.parquet(str(tmp_path / "good")).count() == 1
    assert spark.read.parquet(str(tmp_path / "bad")).first().error == "no size"


def test_geometry_files(spark, tmp_path):
    bubbles = [{"q": 1, "choice": c, "col": 0, "row": 0, "cx_frac": 0.1 * c, "cy_frac": 0.5, "r_frac": 0.01} for c in range(5)]
    (tmp_path / "Q10_5ch_ar.json").write_text(json.dumps({"template": "Q10_5ch", "n_questions": 10, "n_choices": 5, "n_cols": 2, "rtl": True, "bubbles": bubbles}, indent=2))
    rows = templates.bubble_geometry(spark, str(tmp_path)).collect()
    assert len(rows) == 5 and {r.lang for r in rows} == {"ar"} and {r.choice for r in rows} == set(range(5))


def test_crops_by_split(spark, tmp_path):
    crops = spark.createDataFrame([("train", [0.5], 1), ("val", [0.25], 0)], "split string, image array<float>, label int")
    sinks.write_crops(crops, str(tmp_path / "crops"), "job1")
    sinks.write_crops(crops, str(tmp_path / "crops"), "job1")
    assert [tuple(r) for r in sinks.read_crops(spark, str(tmp_path / "crops"), "val").collect()] == [([0.25], 0)]
