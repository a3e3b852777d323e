"""A multinomial logistic regression by Newton steps: each step is one aggregation to sums of a fixed size.

Rows never leave the executors; the driver solves a system of (classes - 1) x (features + 1) unknowns.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import total


@dataclass(frozen=True)
class Softmax:
    """Coefficients (classes - 1 rows; the last class is the reference, of score 0) of a constant and the features."""

    features: tuple[str, ...]
    classes: tuple
    weights: np.ndarray

    def scores(self) -> list[Column]:
        x = inputs(self.features)
        return [*(total([F.lit(float(w)) * v for w, v in zip(row, x)]) for row in self.weights), F.lit(0.0)]

    def probabilities(self) -> list[Column]:
        score = self.scores()
        most = F.greatest(*score)
        e = [F.exp(s - most) for s in score]
        return [v / total(e) for v in e]

    def predicted(self) -> Column:
        """The class of the largest probability, the first of equals."""
        score = self.scores()
        most = F.greatest(*score)
        return F.coalesce(*[F.when(s == most, F.lit(c)) for s, c in zip(score, self.classes)])


def inputs(features: tuple[str, ...]) -> list[Column]:
    return [F.lit(1.0), *(F.col(f).cast("double") for f in features)]


def fit_softmax(rows: DataFrame, features: tuple[str, ...], label: str, classes: tuple, penalty: float = 1e-3, steps: int = 50, enough: float = 1e-10) -> Softmax:
    """The coefficients of most penalised likelihood: the mean log-likelihood less penalty / 2 times the sum of their
    squares. Rows whose label is none of classes, or with a null feature, teach nothing; without rows all are 0.

    Every step is one pass over all rows. A step is halved until the gain is not negative."""
    whole = rows.where(F.col(label).isin(*classes)).select(label, *features).dropna()
    x, k, p = inputs(features), len(classes) - 1, len(features) + 1
    w = np.zeros((k, p))

    def sums(w: np.ndarray) -> tuple[float, float, np.ndarray, np.ndarray]:
        model = Softmax(features, classes, w)
        prob = model.probabilities()
        is_ = [(F.col(label) == c).cast("double") for c in classes]
        names = {"n": F.lit(1.0), "like": total([F.when(F.col(label) == c, F.log(q)).otherwise(0.0) for c, q in zip(classes, prob)])}
        held = whole.select(*[q.alias(f"p{i}") for i, q in enumerate(prob)], *[(y - q).alias(f"d{i}") for i, (y, q) in enumerate(zip(is_, prob))], *[v.alias(f"x{j}") for j, v in enumerate(x)], *[v.alias(n) for n, v in names.items()])
        terms = {f"g{i}_{j}": F.col(f"d{i}") * F.col(f"x{j}") for i in range(k) for j in range(p)}
        for a in range(k):
            for b in range(a, k):
                share = F.col(f"p{a}") * ((1.0 if a == b else 0.0) - F.col(f"p{b}"))
                terms |= {f"h{a}_{b}_{i}_{j}": share * F.col(f"x{i}") * F.col(f"x{j}") for i in range(p) for j in range(i, p)}
        got = held.agg(F.sum("n").alias("n"), F.sum("like").alias("like"), *[F.sum(v).alias(n) for n, v in terms.items()]).first().asDict()
        n = got["n"] or 0.0
        if not n:
            return 0.0, 0.0, np.zeros(k * p), np.eye(k * p)
        grad = np.array([got[f"g{i}_{j}"] for i in range(k) for j in range(p)]) / n - penalty * w.ravel()
        hess = np.zeros((k, p, k, p))
        for a in range(k):
            for b in range(a, k):
                block = np.array([[got[f"h{a}_{b}_{min(i, j)}_{max(i, j)}"] for j in range(p)] for i in range(p)]) / n
                hess[a, :, b, :] = hess[b, :, a, :] = block
        return n, got["like"] / n - penalty / 2 * float((w * w).sum()), grad, hess.reshape(k * p, k * p) + penalty * np.eye(k * p)

    n, value, grad, hess = sums(w)
    for _ in range(steps):
        if not n or np.abs(grad).max() < enough:
            break
        step = np.linalg.solve(hess, grad).reshape(k, p)
        for _ in range(30):
            _, new, g, h = sums(w + step)
            if new >= value - 1e-15:
                break
            step = step / 2
        w, value, grad, hess = w + step, new, g, h
    return Softmax(features, classes, w)
