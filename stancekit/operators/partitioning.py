"""Parallelism guard for CPU-heavy text stages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


# Tasks per core for CPU-bound text stages: texts range from one word to
# tens of thousands, so one task per core leaves cores idle behind the
# largest task (measured on sf0.1 documents, 8 cores: 8 tasks 2.3 s,
# 24 tasks 1.6 s, 64 tasks 1.5 s).
TASKS_PER_CORE = 4


def spread_for_cpu(df: DataFrame, key: str | None = None, min_partitions: int | None = None) -> DataFrame:
    """Give a CPU-bound stage enough tasks to keep every core busy.

    Regex cleaning and sentence splitting cost CPU per byte, so a scan that
    yields fewer partitions than ``TASKS_PER_CORE`` x cores (e.g. one large
    row group) leaves cores idle. Only then is the input hash-partitioned
    (by ``key`` when given, which keeps retries deterministic). On a large
    input the scan already has far more splits than that and the frame is
    returned as is, so the corpus is never shuffled just for parallelism.
    """
    try:
        target = min_partitions or TASKS_PER_CORE * df.sparkSession.sparkContext.defaultParallelism
        current = df.rdd.getNumPartitions()
    except Exception:  # e.g. a Spark Connect session: leave planning to AQE
        return df
    if current >= target:
        return df
    if key is not None:
        return df.repartition(target, F.xxhash64(F.col(key)))
    return df.repartition(target)
