"""L2: reproducible labelling sample."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stancekit.config import DEFAULT_SAMPLE_SIZE, SAMPLE_SEED


def sample_order(id_col: str = "id", seed: int = SAMPLE_SEED):
    """Seeded pseudo-random order that depends only on the row id, so the
    sample is the same for any partitioning and any engine with md5."""
    return F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f"|{seed}")))


def labeling_sample(
    sentences: DataFrame, n: int = DEFAULT_SAMPLE_SIZE, seed: int = SAMPLE_SEED, id_col: str = "id"
) -> DataFrame:
    """Exactly ``min(n, rows)`` rows without replacement plus an empty
    ``label`` column. Planned as TakeOrderedAndProject: every task keeps its
    local best ``n``, only those reach the final merge."""
    picked = sentences.orderBy(sample_order(id_col, seed), F.col(id_col)).limit(n)
    return picked.withColumn("label", F.lit(None).cast("string"))
