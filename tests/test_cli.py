"""The job CLI over a folder of legacy collector CSV files."""

import glob
import os

import pandas as pd

from stancekit.plans import jobs
from stancekit.sinks import commits

from test_files_jobs import legacy_dir


def test_cli_prepare_model_evaluate(spark):
    raw = legacy_dir()
    base = os.path.dirname(raw)
    processed = os.path.join(raw + "-processed")
    jobs.main(["--steps", "prepare, model", "--raw-data-dir", raw, "--processed-data-dir", processed,
               "--prepare-labeling", "--labeling-sample-size", "2", "--model-name", ""])
    results = commits.read_runs(spark, processed, "classification_results")
    assert results.count() >= 3
    sample_files = glob.glob(os.path.join(processed, "labeling_sample_*", "*.csv"))
    assert len(sample_files) == 1 and len(pd.read_csv(sample_files[0])) == 2
    # label every result as neutral and evaluate the latest run
    labeled = os.path.join(base, "cli_labels.csv")
    results.select("id").toPandas().assign(label="neutral").to_csv(labeled, index=False)
    jobs.main(["--steps", "evaluate", "--raw-data-dir", raw, "--processed-data-dir", processed,
               "--labeled-file", labeled])
    metrics = glob.glob(os.path.join(processed, "evaluation_metrics_*", "*.csv"))
    report = glob.glob(os.path.join(processed, "evaluation_report_*", "*.csv"))
    assert metrics and report
    m = pd.read_csv(metrics[0])
    assert list(m.columns) == ["accuracy", "f1_pro", "f1_contra", "f1_neutral", "timestamp"]
    assert m.accuracy.iloc[0] > 0.5


def test_steps_parsing_strips_blanks():
    args = jobs.parse_args(["--steps", "prepare, model", "--search-term", "a, b"])
    job, landed = jobs.job_config(args)
    assert job.steps == ("prepare", "model") and job.search_terms == ("a", "b")


def test_failed_steps_end_a_full_run_and_the_exit_code(spark, tmp_path):
    from stancekit.config import JobConfig

    # collect with an unreadable landed table: under "all" the run stops there
    job = JobConfig(raw_data_dir=str(tmp_path / "raw"), processed_data_dir=str(tmp_path / "p"), steps=("all",))
    assert jobs.run(spark, job, jobs.Landed(posts=str(tmp_path / "missing"))).report == {"collect": jobs.FAILED}
    # nothing landed, nothing to prepare
    assert jobs.run(spark, job).report == {"collect": jobs.NOTHING, "prepare": jobs.NOTHING}
    # a label column that does not exist
    results = spark.createDataFrame([("1", "pro")], "id string, final string")
    results.write.parquet(str(tmp_path / "results"))
    labels = tmp_path / "labels.csv"
    labels.write_text("id,other\n1,pro\n")
    argv = ["--steps", "evaluate", "--processed-data-dir", str(tmp_path / "p"), "--results-file", str(tmp_path / "results")]
    assert jobs.main([*argv, "--labeled-file", str(labels)]) == 1
    assert jobs.main(argv) == 0  # no labels at all: nothing to evaluate
