"""ST1-ST3: the preparation and classification chain on Structured Streaming.

The collectors were re-run periodically and each run added files; the
streaming form consumes those files as they land. All per-row work
(cleaning, splitting, rules, combination) is the same Column expressions as
in batch, so micro-batch and batch outputs are identical row for row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stancekit.config import ClassifierConfig
from stancekit.operators.classify import classify
from stancekit.operators.scoring import Scorer
from stancekit.operators.sentences import explode_sentences, platform_of


def read_raw_stream(spark: SparkSession, path: str, schema: T.StructType, max_files_per_trigger: int | None = None) -> DataFrame:
    """New Parquet files under ``path`` as a stream (schema must be given)."""
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.parquet(path)


def read_table_stream(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table as a stream, whether it is a folder of part files or a
    single file; a path without a readable table raises."""
    schema = spark.read.parquet(path).schema
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where).isDirectory():
        return read_raw_stream(spark, path, schema)
    folder, _, name = path.rpartition("/")
    return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)


def stream_classify(raw: DataFrame, cfg: ClassifierConfig | None = None, scorer: Scorer | None = None) -> DataFrame:
    """ST1: raw items -> cleaned sentences -> classification (stateless).

    Expensive scorers are applied row by row here (the batch path scores
    distinct sentences once, which needs a shuffle per micro-batch)."""
    sentences = explode_sentences(raw, text_col="text", already_clean=False)
    return classify(sentences, cfg, scorer, distinct_scoring=False)


def stream_dedupe(raw: DataFrame, event_time: str, delay: str = "1 day") -> DataFrame:
    """ST2: first arrival per ``(platform, id)`` within the watermark delay.

    Differs from batch ``dedupe_first``: the surviving copy is the first to
    arrive, not the one with the highest collection priority."""
    with_platform = raw.withColumn("platform", platform_of(F.col("source")))
    return with_platform.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["platform", "id"])


def stream_dedupe_best(raw: DataFrame, event_time: str, order: list, gap: str = "1 day", delay: str = "1 day") -> DataFrame:
    """ST2 with the priority of D1: of the copies of one ``(platform, id)`` the
    first by ``order`` (columns, ascending), not the first to arrive.

    Copies at most ``gap`` apart belong together; they are emitted as one row, with
    the time range ``seen``, once the watermark has passed the last of them by
    ``gap``. The state holds one row a group that is still open, combined before
    the shuffle, so an id with a third of all rows costs one row a task.
    """
    keyed = raw.withColumn("platform", platform_of(F.col("source"))).withWatermark(event_time, delay)
    best = F.min_by(F.struct(*[c for c in raw.columns if c != "id"]), F.struct(*order)).alias("best")
    groups = keyed.groupBy("platform", "id", F.session_window(event_time, gap).alias("seen")).agg(best, F.count(F.lit(1)).alias("n_copies"))
    return groups.select("id", "best.*", "platform", "n_copies", F.col("seen.start").alias("seen_from"), F.col("seen.end").alias("seen_until"))


def stream_stats(results: DataFrame, event_time: str, window: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """ST3: stance counts per tumbling window; rows later than the watermark
    are dropped. Emits each window once it is final (append mode)."""
    return (
        results.withWatermark(event_time, delay)
        .groupBy(F.window(event_time, window).alias("window"), "final")
        .agg(F.count(F.lit(1)).alias("n"), F.avg("confidence").alias("avg_confidence"))
    )


def start(df: DataFrame, path: str, checkpoint: str, mode: str = "append", available_now: bool = False,
          partition_by: tuple[str, ...] = ()):
    """Start a Parquet sink with a checkpoint in the shared checkpoint folder.
    ``available_now`` processes what has landed and stops (scheduled runs)."""
    w = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()
