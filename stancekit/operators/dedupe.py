"""Keep-first de-duplication, heterogeneous union, top-N per key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _order_struct(order: list[Column | str]) -> Column:
    cols = [F.col(c) if isinstance(c, str) else c for c in order]
    return F.struct(*[c.alias(f"_o{i}") for i, c in enumerate(cols)])


def dedupe_first(df: DataFrame, keys: list[str], order: list[Column | str], latest: bool = False) -> DataFrame:
    """One row per key, the first by ``order`` (ascending value columns;
    ``latest=True`` keeps the last instead). Add a unique tie-breaker for a
    deterministic winner.

    Implemented as ``min_by`` in a grouped aggregation rather than a window:
    the aggregation combines rows map-side, so a key holding a large share of
    the data (many copies of one item) is reduced before the shuffle instead
    of landing in one task.
    """
    payload = [c for c in df.columns if c not in keys]
    row = F.struct(*[F.col(c) for c in payload]) if payload else F.lit(None)
    pick = F.max_by if latest else F.min_by
    # A leading 64-bit hash of the keys lets the sort-based aggregation
    # compare longs instead of (possibly long) key strings; grouping by
    # (hash, keys) is exactly grouping by keys.
    grouped = df.groupBy(F.xxhash64(*keys).alias("_kh"), *keys)
    out = grouped.agg(pick(row, _order_struct(order)).alias("_first"))
    return out.select(*keys, *[F.col(f"_first.{c}").alias(c) for c in payload]).select(*df.columns)


def union_all(frames: list[DataFrame]) -> DataFrame:
    """Concatenate frames with different columns; missing ones are NULL.
    Column order: first appearance across the inputs."""
    frames = [f for f in frames if f is not None]
    if not frames:
        raise ValueError("union_all needs at least one frame")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def topn_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int, rank_col: str | None = None) -> DataFrame:
    """L1: at most ``n`` rows per key by ``order``.

    ``row_number() <= n`` is planned as a WindowGroupLimit: each map task
    keeps only its local top ``n`` per key before the shuffle, so a hot key
    ships at most ``n`` rows per task.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    ranked = df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n)
    if rank_col:
        return ranked.withColumnRenamed("_rn", rank_col)
    return ranked.drop("_rn")
