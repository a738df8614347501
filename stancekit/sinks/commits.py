"""K1-K6 with restart: which runs of which tables are whole.

A step writes its tables into folders of its run (``<table>/run_ts=<run>``),
replacing what an earlier attempt left there, and then commits: one small
record that names them. Readers take committed runs only, so a step killed
between write and commit has written nothing as far as they can see, and a
second attempt writes nothing twice.
"""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stancekit.sources.files import path_exists

COMMITS = "commits"
PACKED = "zstd"
RECORD = "run_ts string, step string, dataset string"


def run_folder(base: str, dataset: str, run_ts: str) -> str:
    return os.path.join(base, dataset, f"run_ts={run_ts}")


def write_run(df: DataFrame, base: str, dataset: str, run_ts: str, partition_by: Sequence[str] = (), fmt: str = "parquet",
              **options: object) -> str:
    """One run of a table, in place of any earlier attempt at it. Parquet runs are
    packed with ``PACKED`` unless options say otherwise: ids are hexadecimal
    digests and sentences repeat, of which Spark's default packs little."""
    path = run_folder(base, dataset, run_ts)
    if fmt == "parquet":
        options = {"compression": PACKED, **options}
    writer = df.drop("run_ts").write.mode("overwrite").options(**options)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.format(fmt).save(path)
    return path


def commit(spark: SparkSession, base: str, run_ts: str, step: str, datasets: Sequence[str]) -> None:
    """Record that a step of a run is done. The record is a folder of its own
    that Spark's committer puts in place in one go."""
    rows = [(run_ts, step, d) for d in datasets] or [(run_ts, step, None)]
    spark.createDataFrame(rows, RECORD).coalesce(1).write.mode("overwrite").json(os.path.join(base, COMMITS, f"{run_ts}-{step}"))


def commits(spark: SparkSession, base: str) -> DataFrame:
    """``run_ts, step, dataset`` of everything committed; unfinished records
    (without Spark's success mark) do not count."""
    folder = os.path.join(base, COMMITS)
    if not path_exists(spark, folder):
        return spark.createDataFrame([], RECORD)
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    listed = where.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(where)
    whole = [p for p in (s.getPath().toString() for s in listed) if path_exists(spark, f"{p}/_SUCCESS")]
    return spark.read.schema(RECORD).json(whole) if whole else spark.createDataFrame([], RECORD)


def is_committed(spark: SparkSession, base: str, run_ts: str, step: str) -> bool:
    return not commits(spark, base).where((F.col("run_ts") == run_ts) & (F.col("step") == step)).isEmpty()


def committed_runs(spark: SparkSession, base: str, dataset: str) -> list[str]:
    """Runs of a table, ascending: one short string a run."""
    rows = commits(spark, base).where(F.col("dataset") == dataset).select("run_ts").distinct().collect()
    return sorted(r.run_ts for r in rows)


def read_runs(spark: SparkSession, base: str, dataset: str, runs: Sequence[str] | None = None) -> DataFrame | None:
    """The committed runs of a table (all, or those named), with ``run_ts``;
    None where there is none. Runs of different columns are merged."""
    have = committed_runs(spark, base, dataset)
    paths = [run_folder(base, dataset, r) for r in have if runs is None or r in runs]
    if not paths:
        return None
    df = spark.read.option("basePath", os.path.join(base, dataset)).option("mergeSchema", True).parquet(*paths)
    # Partition discovery guesses types; run names and platforms are text.
    return df.withColumns({c: F.col(c).cast("string") for c in ("run_ts", "platform") if c in df.columns})
