"""The batch jobs as a table of steps, with restart, and their CLI.

A step reads committed tables, writes its own for this run and commits them
(``sinks.commits``). Nothing is passed from step to step but tables on
storage, so a lost executor re-runs tasks of one step only, and a job that
died is taken up with ``--run-id``: committed steps are not done again, and what
an unfinished one left behind is replaced.

    python -m stancekit.plans.jobs --steps prepare,model,evaluate \\
        --raw-data-dir data/raw --processed-data-dir data/processed --labeled-file data/labels.csv
"""

from __future__ import annotations

import argparse
import logging
import os
import sys
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stancekit import config as cfgmod
from stancekit.operators import evaluate as E
from stancekit.operators.classify import classification_stats, classify
from stancekit.operators.dedupe import dedupe_first, union_all
from stancekit.operators.sampling import labeling_sample
from stancekit.operators.scoring import default_scorer
from stancekit.operators.sentences import add_cleaned_text, explode_sentences, platform_of
from stancekit.sinks import commits
from stancekit.sinks import writers as W
from stancekit.sources import files, news, social

log = logging.getLogger("stancekit.jobs")

RAW_DATASETS = ("articles", "posts", "comments", "tweets")
DONE, RESUMED, NOTHING, FAILED = "done", "resumed", "nothing to do", "failed"


@dataclass
class Landed:
    """Paths of landed tables for the collect step (Parquet)."""

    pages: str | None = None
    posts: str | None = None
    comments: str | None = None
    tweets: str | None = None
    sites: tuple[tuple[str, str], ...] = field(default_factory=tuple)
    result_pages: str | None = None


@dataclass
class Run:
    """One run: its parameters, how its steps ended and the tables they gave."""

    spark: SparkSession
    job: cfgmod.JobConfig
    landed: Landed
    run_ts: str
    report: dict[str, str] = field(default_factory=dict)
    tables: dict[str, DataFrame] = field(default_factory=dict)

    @property
    def raw(self) -> str:
        return self.job.raw_data_dir

    @property
    def processed(self) -> str:
        return self.job.processed_data_dir

    def written(self, path: str) -> DataFrame:
        """What this run has just written, before it is committed."""
        df = self.spark.read.parquet(path)
        return df.withColumn("platform", F.col("platform").cast("string")) if "platform" in df.columns else df


# Collect (P3) ------------------------------------------------------------------

def _articles(run: Run) -> DataFrame | None:
    if not (run.landed.pages and run.landed.sites):
        return None
    results = run.spark.read.parquet(run.landed.result_pages) if run.landed.result_pages else None
    return news.news_site_scan(run.spark.read.parquet(run.landed.pages), run.landed.sites, run.job.max_pages, results)


def _posts(run: Run) -> DataFrame | None:
    if not run.landed.posts:
        return None
    return social.post_search(run.spark.read.parquet(run.landed.posts), run.job.subreddits, run.job.search_terms, run.job.max_posts)


def _comments(run: Run) -> DataFrame | None:
    if not run.landed.comments or "posts" not in run.tables:
        return None
    return social.comments_for_posts(run.spark.read.parquet(run.landed.comments), run.tables["posts"])


def _tweets(run: Run) -> DataFrame | None:
    if not run.landed.tweets:
        return None
    return social.tweets_union_dedupe(run.spark.read.parquet(run.landed.tweets), run.job.hashtags, run.job.usernames,
                                      run.job.lang, run.job.max_tweets)


# In this order: comments belong to the posts that were found.
COLLECTORS: dict[str, Callable[[Run], DataFrame | None]] = {"articles": _articles, "posts": _posts, "comments": _comments, "tweets": _tweets}


def collect(run: Run) -> list[str]:
    """Raw tables from whatever has landed; without landed tables, none."""
    found = []
    for name, collector in COLLECTORS.items():
        items = collector(run)
        if items is not None:
            run.tables[name] = run.written(W.write_raw(items, run.raw, run.run_ts, name))
            found.append(name)
    return found


# Prepare (P1, P2, P4) ----------------------------------------------------------

def read_raw(spark: SparkSession, raw_dir: str) -> DataFrame | None:
    """Every committed raw table plus legacy CSV files of the folder, as one
    relation with ``platform`` and ``run_ts``."""
    frames = [df for df in (commits.read_runs(spark, raw_dir, name) for name in RAW_DATASETS) if df is not None]
    headers = files.csv_headers(spark, raw_dir)
    if headers:
        for row in files.skipped_files(spark, raw_dir, headers=headers).collect():  # one a file
            log.warning("%s left out, it has no column %s", row["_file"], ", ".join(row["missing"]))
        legacy = files.read_legacy_csv_dir(spark, raw_dir, headers=headers)
        ts = F.regexp_extract(F.col("_file"), r"([0-9]{8}_[0-9]{6})\.csv$", 1)
        frames.append(legacy.withColumn("run_ts", ts).withColumn("platform", platform_of(F.col("source"))).drop("_file"))
    return union_all(frames) if frames else None


def _collection_order():
    """Latest run first; within a run search results before timelines, then
    by source, url and text, so that the winner never depends on row order."""
    return [F.coalesce(F.col("run_ts"), F.lit("")), F.when(F.col("source").contains("/@"), 0).otherwise(1),
            *[F.coalesce(F.col(c), F.lit("")) for c in ("source", "url", "text")]]


def prepare(raw: DataFrame, dedupe: bool = True) -> tuple[DataFrame, DataFrame]:
    """``(originals, sentences)``. Q1: the same item collected by several
    runs (or written both per source and combined) is kept once per
    ``(platform, id)``, the most recent run winning."""
    if dedupe:
        raw = dedupe_first(raw, ["platform", "id"], _collection_order(), latest=True)
    originals = add_cleaned_text(raw)
    return originals, explode_sentences(originals)


def prepare_step(run: Run) -> list[str]:
    raw = read_raw(run.spark, run.raw)
    if raw is None:
        return []
    aside = files.quarantined_records(run.spark, run.raw)
    commits.write_run(aside, run.processed, "quarantined_records", run.run_ts)
    o_path, s_path = W.write_prepared(*prepare(raw, run.job.dedupe), run.processed, run.run_ts)
    run.tables["original_data"], sentences = run.written(o_path), run.written(s_path)
    if sentences.isEmpty():
        return []
    run.tables["sentences_data"] = sentences
    if run.job.prepare_labeling:
        sample = labeling_sample(sentences.drop("platform"), run.job.labeling_sample_size)
        path = W.write_labeling_sample(sample, run.processed, run.run_ts)
        run.tables["labeling_sample"] = run.spark.read.options(**W.CSV).option("multiLine", True).csv(path)
    return ["original_data", "sentences_data", "quarantined_records"]


# Model (P5) ----------------------------------------------------------------------

def _input(run: Run, dataset: str, path: str | None) -> DataFrame | None:
    """What a step reads: this run's table, else the named path, else the last committed run (Q18)."""
    if dataset in run.tables:
        return run.tables[dataset].drop("platform", "run_ts")
    if path:
        return files.read_table(run.spark, path)
    last = commits.committed_runs(run.spark, run.processed, dataset)[-1:]
    found = commits.read_runs(run.spark, run.processed, dataset, last)
    return None if found is None else found.drop("platform", "run_ts")


def model_step(run: Run) -> list[str]:
    sentences = _input(run, "sentences_data", run.job.sentences_path)
    if sentences is None:
        return []
    results = classify(sentences, run.job.classifier, default_scorer(run.job.model_name), run.job.sentence_column)
    run.tables["classification_results"] = run.written(W.write_results(results, run.processed, run.run_ts))
    log.info("labels: %s", classification_stats(run.tables["classification_results"]).first().asDict())
    return ["classification_results"]


# Evaluate (P6) -------------------------------------------------------------------

def evaluate_step(run: Run) -> list[str]:
    results = _input(run, "classification_results", run.job.results_path)
    if results is None or not run.job.labeled_path:
        return []
    label = run.job.label_column
    labeled = files.read_table(run.spark, run.job.labeled_path).select("id", label)
    joined = E.eval_join(results, labeled, label)
    if joined.isEmpty():
        log.warning("no label refers to any result")
        return []
    unlabeled = joined.where(F.col(label).isNull()).agg(F.sum(E.WEIGHT_COL)).first()[0] or 0
    if unlabeled:
        log.warning("%s rows have an empty label and do not count", unlabeled)
    metrics = E.evaluate(joined, label, "final")
    metrics["misclassified"], metrics["error_counts"] = E.error_analysis(joined, label, "final", run.job.sentence_column)
    W.write_errors(metrics["misclassified"], run.processed, run.run_ts)
    W.write_metrics(metrics["summary"], metrics["report"], run.processed, run.run_ts)
    W.write_plot_data(metrics["confusion"], metrics["f1"], run.processed, run.run_ts)
    run.tables.update(metrics)
    return ["error_analysis"]


# The runner (P7) ---------------------------------------------------------------

@dataclass(frozen=True)
class Step:
    """``work`` writes tables and names them. In a full run, a step that gives
    nothing ends the run if ``needed``; one that fails ends it in any case but the last."""

    name: str
    folder: str
    needed: bool
    work: Callable[[Run], list[str]]


STEPS = (Step("collect", "raw", False, collect), Step("prepare", "processed", True, prepare_step),
         Step("model", "processed", True, model_step), Step("evaluate", "processed", False, evaluate_step))


def attempt(step: Step, run: Run) -> str:
    """Do a step and commit it, unless an earlier attempt of this run has."""
    base = getattr(run, step.folder)
    if commits.is_committed(run.spark, base, run.run_ts, step.name):
        for name in [r.dataset for r in commits.commits(run.spark, base).where(
                (F.col("run_ts") == run.run_ts) & (F.col("step") == step.name) & F.col("dataset").isNotNull()).collect()]:
            run.tables[name] = commits.read_runs(run.spark, base, name, [run.run_ts])
        return RESUMED
    try:
        datasets = step.work(run)
    except Exception:
        log.exception("step %s of run %s", step.name, run.run_ts)
        return FAILED
    if not datasets:
        return NOTHING
    commits.commit(run.spark, base, run.run_ts, step.name, datasets)
    return DONE


def run(spark: SparkSession, job: cfgmod.JobConfig, landed: Landed | None = None, run_id: str | None = None) -> Run:
    """The steps that ``job.steps`` asks for, in their order."""
    out = Run(spark, job, landed or Landed(), run_id or W.run_timestamp())
    full = "all" in job.steps
    for step in STEPS:
        if not full and step.name not in job.steps:
            continue
        ended = out.report[step.name] = attempt(step, out)
        log.info("step %s: %s", step.name, ended)
        if full and (ended == FAILED or (ended == NOTHING and step.needed)):
            break
    return out


def parse_args(argv=None):
    p = argparse.ArgumentParser(description="Argument mining jobs on Spark")
    p.add_argument("--raw-data-dir", default="data/raw")
    p.add_argument("--processed-data-dir", default="data/processed")
    p.add_argument("--steps", default="all")
    p.add_argument("--landed-pages")
    p.add_argument("--landed-posts")
    p.add_argument("--landed-comments")
    p.add_argument("--landed-tweets")
    p.add_argument("--landed-result-pages", help="landed search-result pages; articles are then those they link to")
    p.add_argument("--run-id", help="take up this run: steps it has committed are not done again")
    p.add_argument("--news-sites", default="", help="name=host_suffix,...")
    p.add_argument("--search-term", default=cfgmod.DEFAULT_SEARCH_TERM)
    p.add_argument("--max-pages", type=int, default=cfgmod.DEFAULT_MAX_PAGES)
    p.add_argument("--max-posts", type=int, default=cfgmod.DEFAULT_MAX_POSTS)
    p.add_argument("--max-tweets", type=int, default=cfgmod.DEFAULT_MAX_TWEETS)
    p.add_argument("--reddit-subreddits", default=",".join(cfgmod.DEFAULT_SUBREDDITS))
    p.add_argument("--twitter-hashtags", default=",".join(cfgmod.CLI_HASHTAGS))
    p.add_argument("--twitter-usernames", default=",".join(cfgmod.DEFAULT_USERNAMES))
    p.add_argument("--prepare-labeling", action="store_true")
    p.add_argument("--labeling-sample-size", type=int, default=cfgmod.DEFAULT_SAMPLE_SIZE)
    p.add_argument("--model-name", default=cfgmod.DEFAULT_MODEL_NAME)
    p.add_argument("--sentences-file")
    p.add_argument("--sentence-column", default="sentence")
    p.add_argument("--results-file")
    p.add_argument("--labeled-file")
    p.add_argument("--label-column", default="label")
    p.add_argument("--no-dedupe", action="store_true")
    return p.parse_args(argv)


def job_config(args) -> tuple[cfgmod.JobConfig, Landed]:
    job = cfgmod.JobConfig(
        raw_data_dir=args.raw_data_dir, processed_data_dir=args.processed_data_dir,
        steps=cfgmod.split_list(args.steps.lower()) or ("all",),
        search_terms=cfgmod.split_list(args.search_term), max_pages=args.max_pages, max_posts=args.max_posts,
        max_tweets=args.max_tweets, subreddits=cfgmod.split_list(args.reddit_subreddits),
        hashtags=cfgmod.split_list(args.twitter_hashtags), usernames=cfgmod.split_list(args.twitter_usernames),
        prepare_labeling=args.prepare_labeling, labeling_sample_size=args.labeling_sample_size,
        model_name=args.model_name, sentences_path=args.sentences_file, sentence_column=args.sentence_column,
        results_path=args.results_file, labeled_path=args.labeled_file, label_column=args.label_column,
        dedupe=not args.no_dedupe,
    )
    sites = tuple(tuple(s.split("=", 1)) for s in cfgmod.split_list(args.news_sites) if "=" in s)
    landed = Landed(args.landed_pages, args.landed_posts, args.landed_comments, args.landed_tweets, sites, args.landed_result_pages)
    return job, landed


def main(argv=None) -> int:
    """Exit code 0 unless some step failed."""
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(levelname)s %(message)s")
    from stancekit.session import build_session

    args = parse_args(argv)
    job, landed = job_config(args)
    report = run(build_session("stancekit-jobs"), job, landed, args.run_id).report
    return int(FAILED in report.values())


if __name__ == "__main__":
    sys.exit(main())
