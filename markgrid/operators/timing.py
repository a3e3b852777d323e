"""Stage timings: how long each stage took and how many rows it gave, by Spark's own observation."""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


class StageTimes:
    """One record per stage: stage, rows (of the first action that runs it within the stage), seconds."""

    def __init__(self):
        self.records: list[dict] = []
        self.began = time.perf_counter()

    @contextmanager
    def stage(self, name: str, rows: DataFrame) -> Iterator[DataFrame]:
        """rows, observed; what runs inside the block is the stage."""
        seen, start = Observation(name), time.perf_counter()
        yield rows.observe(seen, F.count(F.lit(1)).alias("rows"))
        self.records.append({"stage": name, "rows": seen.get["rows"], "seconds": time.perf_counter() - start})

    def elapsed(self) -> float:
        return time.perf_counter() - self.began
