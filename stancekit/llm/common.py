"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import contextlib
import ctypes
import inspect
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stancekit.session import checkpoint_dir

# Texts are handed to numpy in slices of about this many bytes, so that the
# temporaries of one slice stay small whatever the batch holds.
SLICE_BYTES = 1 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared folder of ``spark.checkpoint.dir``."""
    return f"{checkpoint_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, **options) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back;
    ``options`` are the writer's.

    Cuts the lineage: a lost executor costs a re-read of a file, not a
    recomputation of everything before it.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def row_key(id_col: str, text_col: str) -> Column:
    """``id, a, b``: a row by its id and 128 bits of its text, so that rows
    without id, or of the same id, are told apart."""
    return F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("a"), F.xxhash64(F.lit("second"), text_col).alias("b"))


def is_row(row_id: Column, text: Column, id_col: str, a: str, b: str) -> Column:
    """The row of this ``row_key``."""
    return row_id.eqNullSafe(F.col(id_col)) & (F.xxhash64(text) == F.col(a)) & (F.xxhash64(F.lit("second"), text) == F.col(b))


def text_buffers(arr: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all strings and the ``n + 1`` offsets into them.
    Null counts as empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    arr = pc.fill_null(pc.cast(arr, pa.large_string()), "")
    if len(arr) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = arr.buffers()
    offsets = np.frombuffer(off, np.int64)[arr.offset:arr.offset + len(arr) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def by_bytes(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches into runs of whole rows of about ``limit`` text bytes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        part = (np.cumsum(size, dtype=np.int64) - 1) // limit
        cuts = np.flatnonzero(np.diff(part)) + 1
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            yield batch.slice(int(a), int(b - a))


def released(work: Callable) -> Callable:
    """A function of a Python worker that gives memory back when it is done.

    Workers outlive their tasks; what the allocators keep of a task's arrays
    would otherwise count against the executor while other stages run.
    """

    def finish(out):
        if isinstance(out, Iterator):
            return _then_release(out)
        release_memory()
        return out

    # Spark looks at the number of arguments.
    if len(inspect.signature(work).parameters) == 2:
        return lambda left, right: finish(work(left, right))
    return lambda rows: finish(work(rows))


def _then_release(out: Iterator) -> Iterator:
    yield from out
    release_memory()


def release_memory() -> None:
    from stancekit.llm import shingles

    shingles.forget_powers()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # a C library without it
        ctypes.CDLL(None).malloc_trim(0)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (murmur3's fmix64), elementwise."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def word_key(words: pa.Array) -> np.ndarray:
    """A 64-bit hash for each string of an Arrow array (no nulls)."""
    import xxhash

    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in pc.cast(words, pa.large_binary()).to_pylist()),
                       np.uint64, len(words))


def components(edges: DataFrame, name: str = "components", max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(a, b)``: ``(id, component_id)`` for
    every id that occurs, with the smallest id of its component.

    Contraction in rounds: each vertex takes the neighbour (or itself) of
    smallest pseudo-random rank, the chains so built are followed two steps,
    and the edges are rewritten to what the vertices point to. Ranks differ
    from round to round, so the number of edges falls geometrically whatever
    the shape of the graph. Every round is a pair of joins and one map-side
    combined aggregation over written tables; nothing reaches the driver but
    the number of edges left.

    Null ids and self loops give no row; repeated edges count once.
    """
    spark = edges.sparkSession
    e = materialize(edges.where("a <> b").select(F.col("a").cast("long"), F.col("b").cast("long")).distinct(), name)
    maps: list[DataFrame] = []
    for r in range(max_rounds):
        if e.isEmpty():
            break
        rank = lambda c, r=r: F.struct(F.xxhash64(F.lit(r), c).alias("h"), F.col(c).alias("v"))
        both = e.union(e.select("b", "a"))
        best = (both.groupBy("a").agg(F.min(rank("b")).alias("m"))
                .select(F.col("a").alias("v"), F.least(F.col("m"), rank("a")).getField("v").alias("p")))
        best = materialize(best, name)
        for _ in range(2):  # follow the chains
            up = best.select(F.col("v").alias("q"), F.col("p").alias("pp"))
            best = best.join(up, F.col("p") == F.col("q"), "left").select("v", F.coalesce("pp", "p").alias("p"))
        best = materialize(best, name)
        maps.append(best)
        e = (e.join(best.select(F.col("v").alias("a"), F.col("p").alias("pa")), "a")
             .join(best.select(F.col("v").alias("b"), F.col("p").alias("pb")), "b")
             .where("pa <> pb").select(F.col("pa").alias("a"), F.col("pb").alias("b")).distinct())
        e = materialize(e, name)
    else:
        raise RuntimeError(f"components did not converge in {max_rounds} rounds")
    if not maps:
        return spark.createDataFrame([], "id long, component_id long")
    label = maps[0]
    for m in maps[1:]:
        label = (label.join(m.select(F.col("v").alias("q"), F.col("p").alias("pp")), F.col("p") == F.col("q"), "left")
                 .select("v", F.coalesce("pp", "p").alias("p")))
    label = materialize(label.select(F.col("v").alias("id"), F.col("p").alias("root")), name)
    low = label.groupBy("root").agg(F.min("id").alias("component_id"))
    return label.join(low, "root").select("id", "component_id")
