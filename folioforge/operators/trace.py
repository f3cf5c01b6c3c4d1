"""What each stage of a running search let through, measured while it runs.

``watch`` puts an observation into the plan, which Spark sums up as rows pass; nothing is written
or counted a second time. After the action, ``report`` has one row per stage. The action should write or
collect: one that sorts all rows runs its input once more to sample it, which would count them again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

REPORT = "place int, stage string, n_rows long, n_scored long, lowest double, highest double"


class Trace:
    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.stages: list[tuple[str, Observation]] = []

    def watch(self, stage: str, rows: DataFrame, score: str | None = "score") -> DataFrame:
        """The rows, counted as they pass, with the least and the greatest of a score."""
        if any(s == stage for s, _ in self.stages):
            raise ValueError(f"two stages named {stage}")
        seen = Observation(f"{stage}-{uuid.uuid4().hex}")
        self.stages.append((stage, seen))
        value = F.lit(None).cast("double") if score is None else F.col(score).cast("double")
        return rows.observe(seen, F.count(F.lit(1)).alias("n_rows"), F.count(value).alias("n_scored"), F.min(value).alias("lowest"), F.max(value).alias("highest"))

    def report(self) -> DataFrame:
        """One row per stage, in the order they were watched; the action they belong to must have ended."""
        found = [(place, stage, *[seen.get.get(c) for c in ("n_rows", "n_scored", "lowest", "highest")]) for place, (stage, seen) in enumerate(self.stages)]
        return self.spark.createDataFrame(found, REPORT)
