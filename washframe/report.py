"""Step log: what each operator did, as small driver-side records or a DataFrame."""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass
class Step:
    step: str
    detail: str = ""
    columns: list[str] = field(default_factory=list)
    count: int = 0
    seconds: float = 0.0


class StepLog:
    """Ordered list of steps; ``to_frame`` gives one row per step."""

    def __init__(self) -> None:
        self.steps: list[Step] = []
        self._t0 = time.perf_counter()

    def add(self, step: str, detail: str = "", columns=None, count: int = 0) -> Step:
        now = time.perf_counter()
        entry = Step(step, detail, list(columns or []), int(count), now - self._t0)
        self._t0 = now
        self.steps.append(entry)
        return entry

    def names(self) -> list[str]:
        return [s.step for s in self.steps]

    def append_to(self, spark: SparkSession, path: str, run_id: str | None = None) -> str:
        """Append the steps to a parquet operation-log table (one row per step)."""
        frame = self.to_frame(spark).withColumn("run_id", F.lit(run_id or ""))
        frame.write.mode("append").parquet(path)
        return path

    def to_frame(self, spark: SparkSession) -> DataFrame:
        schema = T.StructType([
            T.StructField("step_no", T.IntegerType()),
            T.StructField("step", T.StringType()),
            T.StructField("detail", T.StringType()),
            T.StructField("columns", T.StringType()),
            T.StructField("count", T.LongType()),
            T.StructField("seconds", T.DoubleType()),
        ])
        rows = [(i + 1, s.step, s.detail, ",".join(s.columns), s.count, round(s.seconds, 3))
                for i, s in enumerate(self.steps)]
        return spark.createDataFrame(rows, schema)
