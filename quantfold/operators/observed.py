"""Row counts of pipeline stages, taken while the pipeline runs.

``DataFrame.observe`` counts rows as they pass, so no stage is computed again for its count.  Marks belong where the
rows of a job's last stage pass (before a write or checkpoint, with no shuffle between): Spark counts each
partition of such a stage once, also when a lost task is run again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


class StageCounts:
    """Counts by stage, in the order of the marks."""

    def __init__(self):
        self._marks: list[tuple[str, Observation]] = []

    def mark(self, df: DataFrame, stage: str) -> DataFrame:
        """``df``, whose rows are counted when it is first written, checkpointed or collected."""
        seen = Observation(f"rows: {stage}")
        self._marks.append((stage, seen))
        return df.observe(seen, F.count(F.lit(1)).alias("n"))

    def counts(self) -> dict[str, int]:
        """Waits for stages that haven't run; call it after the action on the last mark."""
        return {stage: int(seen.get.get("n", 0)) for stage, seen in self._marks}

    def table(self, spark: SparkSession) -> DataFrame:
        """``stage, n``: a row a mark."""
        return spark.createDataFrame(list(self.counts().items()), "stage string, n long")
