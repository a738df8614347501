"""Exact dedup by content sort.

Rows are range-partitioned by sampled splitters and sorted externally by their
normalised bytes, so equal texts lie side by side; a scan compares neighbours
in full and keeps the smallest identifier of each run.

A splitter is not a whole text (the sample would grow with the texts) but its
first characters, a hash of all of it, the identifier and the number of the
input partition. So a text that holds a third of all rows is cut into as many
partitions as its rows deserve. Runs at the edge of a partition may go on in
the next one; only those, a few rows a partition, are compared across
partitions afterwards.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stancekit.llm.common import by_bytes, materialize

PREFIX = 16  # characters of a text in a splitter
OUTPUT = ("keep_id", "group_size", "kept", "text_sha256")


def normalised(text: Column) -> Column:
    """White space (blank, tab to carriage return) as single blanks; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+", " ")


def content_sorted(docs: DataFrame, id_col: str, text_col: str, carry: tuple[str, ...]) -> DataFrame:
    """``id, carried, key, norm`` in partitions that are ranges of the content
    order; among equals by id, rows without id last."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.struct(F.lit(0).alias("_"), *carry).alias("carried"),
                       normalised(F.col(text_col)).alias("norm"), F.spark_partition_id().alias("part"))
    rows = rows.withColumns({"key": F.xxhash64("norm"), "prefix": F.substring("norm", 1, PREFIX)})
    by_id = F.col("id").asc_nulls_last()
    return (rows.repartitionByRange("prefix", "key", by_id, "part").sortWithinPartitions("prefix", "key", "norm", by_id, "part")
            .select("id", "carried", "key", "norm"))


def _compare_neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of equal texts in one sorted partition. Rows are held back while
    their key may go on. ``edge`` marks rows with the key of the partition's
    first or last row; the first row of such a run brings its text."""
    run = TaskContext.get().partitionId() << 40
    held: list[pa.RecordBatch] = []
    first = last = None
    for batch in by_bytes(batches, "norm"):
        key = batch.column("key").to_numpy()
        if first is None:
            first = key[0]
        cuts = np.flatnonzero(key[1:] != key[:-1]) + 1
        if not held or key[0] != last or len(cuts):
            end = int(cuts[-1]) if len(cuts) else 0
            done = [*held, batch.slice(0, end)]
            rows = sum(b.num_rows for b in done)
            if rows:
                yield from _runs(done, run, (first,))
            run += rows
            held = [batch.slice(end)]
        else:
            held.append(batch)
        last = key[-1]
    if held:
        yield from _runs(held, run, (first, last))


def _runs(rows: list[pa.RecordBatch], run: int, edges: tuple[int, ...]) -> Iterator[pa.RecordBatch]:
    rows = pa.Table.from_batches(rows).combine_chunks()
    ids, key, norm = (rows.column(c).combine_chunks() for c in ("id", "key", "norm"))
    key = key.to_numpy()
    cut = np.ones(len(key), bool)
    cut[1:] = key[1:] != key[:-1]
    for i in np.flatnonzero(~cut):  # the hash is equal: are the texts?
        cut[i] = not norm[i].as_buffer().equals(norm[i - 1].as_buffer())
    first = np.flatnonzero(cut)
    of = np.cumsum(cut) - 1
    size = np.diff(np.append(first, len(key)))
    edge = np.isin(key, edges)
    sha = pa.array([hashlib.sha256(norm[i].as_buffer()).hexdigest() for i in first.tolist()], pa.string())
    text = norm.take(pa.array(np.arange(len(key)), mask=~(cut & edge)))
    out = pa.table({"id": ids, "carried": rows.column("carried"), "run": run + of, "place": np.arange(len(key)) - first[of],
                    "size": size[of], "low": ids.take(pa.array(first[of])), "sha": sha.take(pa.array(of)), "edge": edge, "edge_text": text})
    yield from out.to_batches(max_chunksize=10_000)


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``docs``: its id (as ``id_col``, long), ``keep_id`` (smallest
    id among equal texts), ``group_size``, ``kept`` (true for one row of a
    group) and ``text_sha256`` (of the normalised text), then the columns named
    in ``carry``.

    Texts are equal if they are after each run of white space has become one
    blank. Null counts as empty, and empty texts equal each other. Rows without
    id count, and stay only where no row of the group has one (``keep_id`` is
    then null). Of repeated rows one is kept. Columns not named in ``carry``
    are not read; a carried column must not have the name of an output column.
    An empty table gives no rows. Rows with the same hash are held in memory
    together, at most those of one range partition.
    """
    taken = {*OUTPUT, id_col} & {*carry}
    if taken:
        raise ValueError(f"carried columns named like the output: {sorted(taken)}")
    rows = content_sorted(docs, id_col, text_col, carry)
    schema = T.StructType([
        T.StructField("id", T.LongType()), rows.schema["carried"],
        *(T.StructField(c, T.LongType()) for c in ("run", "place", "size", "low")),
        T.StructField("sha", T.StringType()), T.StructField("edge", T.BooleanType()), T.StructField("edge_text", T.StringType())])
    members = materialize(rows.mapInArrow(_compare_neighbours, schema), "content-runs")
    tips = members.where(F.col("edge") & (F.col("place") == 0)).select("run", "edge_text", "size", "low")
    whole = tips.groupBy("edge_text").agg(F.min(F.struct(F.col("low").isNull(), "low", "run")).alias("best"), F.sum("size").alias("total"))
    joined = materialize(tips.join(whole, "edge_text").select("run", F.col("best.low").alias("keep_id"), F.col("best.run").alias("keep_run"), "total"),
                         "edge-runs")
    extra = [F.col(f"carried.{c}").alias(c) for c in carry]
    inside = members.where(~F.col("edge")).select(
        F.col("id").alias(id_col), F.col("low").alias("keep_id"), F.col("size").alias("group_size"), (F.col("place") == 0).alias("kept"),
        F.col("sha").alias("text_sha256"), *extra)
    at_edge = members.where("edge").join(joined, "run").select(
        F.col("id").alias(id_col), "keep_id", F.col("total").alias("group_size"),
        ((F.col("place") == 0) & (F.col("run") == F.col("keep_run"))).alias("kept"), F.col("sha").alias("text_sha256"), *extra)
    return inside.union(at_edge)
