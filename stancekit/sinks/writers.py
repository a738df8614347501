"""K1-K6: the tables that jobs write.

Large tables are Parquet, one folder a run (``sinks.commits``), partitioned by
platform inside it. Only the labelling sample, which people edit, and the
small metric tables are single CSV files; their size is bounded by parameters
(sample size, number of labels).
"""

from __future__ import annotations

import os
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stancekit.operators.sentences import platform_of
from stancekit.sinks.commits import write_run

CSV = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def run_timestamp(now: datetime | None = None) -> str:
    """``YYYYmmdd_HHMMSS`` (UTC) identifying one job run."""
    return (now or datetime.now(timezone.utc)).strftime("%Y%m%d_%H%M%S")


def _by_platform(df: DataFrame) -> DataFrame:
    return df if "platform" in df.columns else df.withColumn("platform", platform_of(F.col("source")))


def write_raw(df: DataFrame, base: str, run_ts: str, dataset: str, fmt: str = "parquet") -> str:
    """K1: collector output (Parquet, or CSV with a header per file for tools
    that expect the original files; nested columns are JSON text in CSV)."""
    out = _by_platform(df)
    if fmt == "csv":
        nested = [f.name for f in out.schema.fields if f.dataType.typeName() in ("array", "map", "struct")]
        return write_run(out.withColumns({c: F.to_json(c) for c in nested}), base, dataset, run_ts, ["platform"], "csv", **CSV)
    return write_run(out, base, dataset, run_ts, ["platform"])


def write_prepared(originals: DataFrame, sentences: DataFrame, base: str, run_ts: str) -> tuple[str, str]:
    """K2: ``original_data`` (what earlier run each item came from is ``collected_ts``)
    and ``sentences_data``."""
    if "run_ts" in originals.columns:
        originals = originals.withColumnRenamed("run_ts", "collected_ts")
    return (write_run(_by_platform(originals), base, "original_data", run_ts, ["platform"]),
            write_run(_by_platform(sentences), base, "sentences_data", run_ts, ["platform"]))


def write_results(results: DataFrame, base: str, run_ts: str) -> str:
    """K4: ``classification_results``."""
    out = _by_platform(results) if "source" in results.columns or "platform" in results.columns else results
    return write_run(out, base, "classification_results", run_ts, ["platform"] if "platform" in out.columns else [])


def write_errors(misclassified: DataFrame, base: str, run_ts: str) -> str:
    """K5: ``error_analysis`` (misclassified rows)."""
    return write_run(misclassified, base, "error_analysis", run_ts)


def _single_csv(df: DataFrame, base: str, name: str) -> str:
    path = os.path.join(base, name)
    df.coalesce(1).write.mode("overwrite").options(**CSV).csv(path)
    return path


def write_labeling_sample(sample: DataFrame, base: str, run_ts: str) -> str:
    """K3: one CSV file for manual labelling (at most ``sample_size`` rows)."""
    return _single_csv(sample, base, f"labeling_sample_{run_ts}")


def write_metrics(summary: DataFrame, report: DataFrame, base: str, run_ts: str, prefix: str = "evaluation") -> tuple[str, str]:
    """K6: one-row metric summary (with its timestamp) and the report."""
    return (_single_csv(summary.withColumn("timestamp", F.lit(run_ts)), base, f"{prefix}_metrics_{run_ts}"),
            _single_csv(report, base, f"{prefix}_report_{run_ts}"))


def write_plot_data(confusion: DataFrame, f1: DataFrame, base: str, run_ts: str, prefix: str = "evaluation") -> tuple[str, str]:
    """The tables behind the confusion heat map and the F1 bar chart."""
    return (_single_csv(confusion, base, f"{prefix}_confusion_{run_ts}"), _single_csv(f1, base, f"{prefix}_f1_{run_ts}"))
