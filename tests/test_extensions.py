import numpy as np
from pyspark.sql import functions as F

from markgrid.functions import extensions
from markgrid.operators import learn
from markgrid.plans import extensions as plans


def plain_fit(x, y, k, penalty=1e-3):
    """Newton's method in NumPy; y: class numbers, the last class is the reference."""
    x = np.column_stack([np.ones(len(x)), x])
    n, p = x.shape
    w = np.zeros((k - 1, p))
    for _ in range(200):
        s = np.column_stack([x @ w.T, np.zeros(n)])
        q = np.exp(s - s.max(1, keepdims=True))
        q /= q.sum(1, keepdims=True)
        d = (y[:, None] == np.arange(k)) - q
        g = (d[:, :-1].T @ x / n - penalty * w).ravel()
        h = np.zeros((k - 1, p, k - 1, p))
        for a in range(k - 1):
            for b in range(k - 1):
                h[a, :, b, :] = (x * (q[:, a] * ((a == b) - q[:, b]))[:, None]).T @ x / n
        w = w + np.linalg.solve(h.reshape(g.size, g.size) + penalty * np.eye(g.size), g).reshape(w.shape)
        if np.abs(g).max() < 1e-12:
            break
    return w


def test_newton_equals_numpy(spark):
    r = np.random.default_rng(1)
    x = r.normal(0, 1, (800, 2))
    y = (x @ np.array([[1.5, -1], [0.3, 2]]) + r.gumbel(0, 1, (800, 2))).argmax(1) + (r.random(800) < 0.2)
    names = ("a", "b", "c")
    rows = [(float(i), float(j), names[c]) for (i, j), c in zip(x, y)]
    df = spark.createDataFrame([*rows, (None, 1.0, "a"), (1.0, 1.0, None), (1.0, 1.0, "other")], "u double, v double, label string").repartition(5)
    model = learn.fit_softmax(df, ("u", "v"), "label", names)
    want = plain_fit(x, y, 3)
    assert np.abs(model.weights - want).max() < 1e-6
    got = df.where("u IS NOT NULL AND label IN ('a', 'b', 'c')").select("u", "v", model.predicted().alias("p"), F.array(*model.probabilities()).alias("q")).toPandas()
    score = np.column_stack([np.column_stack([np.ones(len(got)), got[["u", "v"]]]) @ want.T, np.zeros(len(got))])
    assert (got.p == np.array(names)[score.argmax(1)]).all() and np.allclose(np.stack(got.q).sum(1), 1)


def test_fit_without_rows_or_with_one_class(spark):
    df = spark.createDataFrame([(1.0, "a"), (2.0, "a")], "u double, label string")
    assert not learn.fit_softmax(df.limit(0), ("u",), "label", ("a", "b")).weights.any()
    one = learn.fit_softmax(df, ("u",), "label", ("a", "b"))
    assert np.isfinite(one.weights).all() and {r.p for r in df.select(one.predicted().alias("p")).collect()} == {"a"}


def test_classifier_on_held_out_sheets(spark, sf_dir):
    got = plans.status_classifier(spark, sf_dir).first()
    counts = [r["count"] for r in plans.labelled(spark, sf_dir).where("sheet % 5 = 0").groupBy("status").count().collect()]
    assert got.n == sum(counts) > 500 and got.accuracy > max(0.9, max(counts) / got.n) and 0 < got.weighted_loss < 1


def test_table_function_of_odd_names(spark):
    extensions.register(spark)
    rows = spark.createDataFrame([("Q10_5ch",), ("Q11_5ch",), (None,), ("x",), ("Q10_9ch",)], "id string")
    got = spark.sql("SELECT id, count(*) AS n FROM {rows} r, LATERAL template_bubbles(r.id) b GROUP BY id", rows=rows).collect()
    assert [tuple(r) for r in got] == [("Q10_5ch", 50)]


def test_spread(spark):
    extensions.register(spark)
    df = spark.createDataFrame([(1, 1.0), (1, 5.0), (1, 2.0), (1, None), (2, None), (3, 4.0)], "k int, v double")
    got = {r.k: r.s for r in spark.sql("SELECT k, spread(v) AS s FROM {df} GROUP BY k", df=df).collect()}
    assert got[1] == 1.0 and got[3] == 0.0 and (got[2] is None or got[2] != got[2])
