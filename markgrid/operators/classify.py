"""Bubble classification by a batch model: 32 x 32 crops, class probabilities, and the decision that
combines them with the fill ratio. The model is a callable that each Python worker builds once, so a
neural network of any library fits; none is supplied here."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import clip
from .codes import softmax
from .kernels import HEIGHT, WIDTH, even_light

SIDE = 32
LABELS = ("empty", "filled", "ambiguous")


def crop(even: np.ndarray, cx: int, cy: int, r: int) -> np.ndarray:
    """The square around a bubble, brought to SIDE x SIDE by the nearest pixel; white beyond the page."""
    at = np.rint(np.linspace(-1.3 * r, 1.3 * r, SIDE)).astype(int)
    y, x = cy + at[:, None], cx + at[None, :]
    ok = (y >= 0) & (y < even.shape[0]) & (x >= 0) & (x < even.shape[1])
    return np.where(ok, even[np.clip(y, 0, even.shape[0] - 1), np.clip(x, 0, even.shape[1] - 1)], 255).astype(np.uint8)


def crops(sheets: DataFrame, cells: DataFrame) -> DataFrame:
    """sheet, q, rank, image (SIDE * SIDE numbers in 0..1) for each bubble of aligned sheets."""
    lists = cells.groupBy("template_id").agg(*[F.collect_list(c).alias(c) for c in ("q", "choice_rank", "cx", "cy")], F.first("r").alias("r"))

    def run(batches):
        for pdf in batches:
            for s in pdf.itertuples():
                even = even_light(np.frombuffer(s.gray, np.uint8).reshape(HEIGHT, WIDTH))
                images = [(crop(even, x, y, int(s.r)).ravel() / 255.0).astype(np.float32) for x, y in zip(s.cx, s.cy)]
                yield pd.DataFrame({"sheet": s.sheet, "q": s.q, "rank": s.choice_rank, "image": images})

    return sheets.join(F.broadcast(lists), "template_id").mapInPandas(run, "sheet long, q int, rank int, image array<float>")


def with_scores(images: DataFrame, make: Callable[[], Callable[[np.ndarray], np.ndarray]], batch_size: int = 256) -> DataFrame:
    """images with scores (one number a label): make() gives a function of N x SIDE x SIDE arrays."""
    from pyspark.ml.functions import predict_batch_udf
    from pyspark.sql import types as T

    udf = predict_batch_udf(make, return_type=T.ArrayType(T.FloatType()), batch_size=batch_size, input_tensor_shapes=[[SIDE, SIDE]])
    return images.withColumn("scores", udf("image"))


def decided(scored: DataFrame, filled: float = 0.35, low: float = 0.18) -> DataFrame:
    """scored (scores, fill) with status and confidence: the likeliest label; an ambiguous one becomes
    filled over the fill threshold and empty (with a confidence of a half at least) under the low one."""
    probs, best = softmax([F.get("scores", i).cast("double") for i in range(len(LABELS))])
    label = F.get(F.array(*map(F.lit, LABELS)), best)
    confidence: Column = F.greatest(*probs)
    unsure, fill = label == "ambiguous", F.col("fill")
    status = F.when(unsure & (fill > filled), "filled").when(unsure & (fill < low), "empty").otherwise(label)
    return scored.withColumns({"status": status, "confidence": F.when(unsure & (fill < low), clip(confidence, 0.5, 1.0)).otherwise(confidence)})
