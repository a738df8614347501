"""Legacy files and end-to-end jobs."""

import os
import tempfile

import pandas as pd
from pyspark.sql import functions as F

from stancekit.config import ClassifierConfig, JobConfig
from stancekit.plans import catalog as C
from stancekit.plans import jobs
from stancekit.sinks import commits
from stancekit.sources import files

from conftest import SF001


def legacy_dir():
    d = tempfile.mkdtemp(prefix="stancekit-legacy-")
    pd.DataFrame([
        {"id": -123, "source": "spiegel", "url": "https://s.example.com/a", "title": "T, mit Komma",
         "text": 'Er sagte "Hallo",\nneue Zeile.', "date": "2024-01-01"},
    ]).to_csv(os.path.join(d, "spiegel_articles_20240101_100000.csv"), index=False)
    pd.DataFrame([
        {"id": "abc", "source": "reddit/r/de", "url": "u", "title": "t", "text": "Post", "author": "x",
         "score": 5, "created_utc": "2024-01-01T00:00:00", "num_comments": 2},
    ]).to_csv(os.path.join(d, "reddit_posts_de_20240101_100000.csv"), index=False)
    pd.DataFrame([
        {"id": "99", "source": "twitter", "url": "u", "text": "Tweet", "author": "y", "followers_count": 1,
         "created_at": "2024-01-01T00:00:00+00:00", "retweet_count": 0, "favorite_count": 0,
         "hashtags": ["NewWork", "x"]},
    ]).to_csv(os.path.join(d, "twitter_tweets_20240101_100000.csv"), index=False)
    pd.DataFrame([{"id": "1", "source": "s", "body": "no text column"}]).to_csv(os.path.join(d, "broken.csv"), index=False)
    with open(os.path.join(d, "empty_20240101_100000.csv"), "w") as fh:
        fh.write("\n")
    with open(os.path.join(d, "notes.txt"), "w") as fh:
        fh.write("ignored")
    return d


def test_legacy_csv_dir(spark):
    d = legacy_dir()
    df = files.read_legacy_csv_dir(spark, d)
    rows = {r.source: r for r in df.collect()}
    assert set(rows) == {"spiegel", "reddit/r/de", "twitter"}
    art = rows["spiegel"]
    assert art.title == "T, mit Komma" and art.text == 'Er sagte "Hallo",\nneue Zeile.'
    assert art.id == spark.range(1).select(F.sha2(F.lit("https://s.example.com/a"), 256)).first()[0]
    assert rows["reddit/r/de"].score == 5 and rows["reddit/r/de"].id == "abc"
    assert rows["twitter"].hashtags == ["NewWork", "x"]
    skipped = files.skipped_files(spark, d).collect()
    assert len(skipped) == 1 and skipped[0]._file.endswith("broken.csv") and skipped[0].missing == ["text"]


def write_landed(spark, base):
    paths = {}
    for name, df in {
        "pages": C.table(spark, SF001, "pages"),
        "posts": C.posts(spark, SF001),
        "comments": C.thread_comments(spark, SF001).withColumn("post_id", F.lit("0")),
        "tweets": C.tweets(spark, SF001),
    }.items():
        paths[name] = os.path.join(base, name)
        df.write.mode("overwrite").parquet(paths[name])
    labels = C.labeled(spark, SF001)
    return paths, labels


def test_end_to_end_jobs(spark):
    base = tempfile.mkdtemp(prefix="stancekit-jobs-")
    paths, _ = write_landed(spark, base)
    job = JobConfig(raw_data_dir=os.path.join(base, "raw"), processed_data_dir=os.path.join(base, "processed"),
                    steps=("collect", "prepare", "model"), search_terms=("für", "the"), subreddits=("src0", "src1"),
                    hashtags=("view",), usernames=("user1",), lang=None, prepare_labeling=True,
                    labeling_sample_size=20, classifier=ClassifierConfig.fixture(), model_name="")
    landed = jobs.Landed(paths["pages"], paths["posts"], paths["comments"], paths["tweets"],
                         (("site_com", "example.com"),))
    out = jobs.run(spark, job, landed)
    assert set(out.report.values()) == {jobs.DONE}
    assert {"articles", "posts", "comments", "tweets"} <= set(out.tables)
    originals, sentences, labeling = (out.tables[x] for x in ("original_data", "sentences_data", "labeling_sample"))
    assert labeling.count() == 20
    n_items = originals.count()
    results = out.tables["classification_results"]
    assert results.count() == sentences.count() > 0
    # sentence ids are unique and the index is dense from 0 per text
    assert sentences.select("id").distinct().count() == sentences.count()
    dense = sentences.groupBy("text_id").agg((F.max("sentence_index") + 1 - F.count("*")).alias("gap"))
    assert dense.where(F.col("gap") != 0).count() == 0

    # label a few sentences and evaluate
    labeled_csv = os.path.join(base, "labeled.csv")
    lab = results.select("id", F.when(F.length("sentence") % 2 == 0, "pro").otherwise("neutral").alias("label")).limit(40)
    lab.toPandas().to_csv(labeled_csv, index=False)
    job.steps = ("evaluate",)
    job.labeled_path = labeled_csv
    metrics = jobs.run(spark, job, landed).tables
    s = metrics["summary"].first()
    assert 0.0 <= s.accuracy <= 1.0
    assert sum(r["count"] for r in metrics["confusion"].collect()) == 40

    # a rerun of collect + prepare adds no duplicate items (Q1)
    job.steps = ("collect", "prepare")
    job.prepare_labeling = False
    assert jobs.run(spark, job, landed, "29990101_000000").tables["original_data"].count() == n_items


class Killed(BaseException):
    """Not an error that a step could handle: the process is gone."""


def test_killed_run_is_taken_up(spark, monkeypatch):
    """A step dies after it has written and before it commits: readers see
    nothing of it, and the same run taken up again gives every row once."""
    base = tempfile.mkdtemp(prefix="stancekit-restart-")
    paths, _ = write_landed(spark, base)
    job = JobConfig(raw_data_dir=os.path.join(base, "raw"), processed_data_dir=os.path.join(base, "processed"), steps=("collect", "prepare", "model"),
                    search_terms=("für", "the"), subreddits=("src0",), classifier=ClassifierConfig.fixture(), model_name="")
    landed = jobs.Landed(posts=paths["posts"])
    commit, died = commits.commit, []

    def dying(spark, folder, run_ts, step, datasets):
        if step == "model" and not died:
            died.append(step)
            raise Killed
        commit(spark, folder, run_ts, step, datasets)

    monkeypatch.setattr(commits, "commit", dying)
    try:
        jobs.run(spark, job, landed, "20240101_000000")
    except Killed:
        pass
    assert died and os.listdir(os.path.join(base, "processed", "classification_results"))
    assert commits.read_runs(spark, job.processed_data_dir, "classification_results") is None
    sentences = commits.read_runs(spark, job.processed_data_dir, "sentences_data").count()

    out = jobs.run(spark, job, landed, "20240101_000000")
    assert out.report == {"collect": jobs.RESUMED, "prepare": jobs.RESUMED, "model": jobs.DONE}
    results = commits.read_runs(spark, job.processed_data_dir, "classification_results")
    assert results.count() == results.select("id").distinct().count() == sentences > 0
    assert jobs.run(spark, job, landed, "20240101_000000").report["model"] == jobs.RESUMED
    assert commits.committed_runs(spark, job.processed_data_dir, "classification_results") == ["20240101_000000"]


def test_unfinished_commit_does_not_count(spark, tmp_path):
    df = spark.createDataFrame([("1", "twitter")], "id string, source string")
    commits.write_run(df, str(tmp_path), "t", "r1")
    commits.commit(spark, str(tmp_path), "r1", "s", ["t"])
    commits.write_run(df, str(tmp_path), "t", "r2")
    os.makedirs(tmp_path / "commits" / "r2-s")  # no success mark
    (tmp_path / "commits" / "r2-s" / "part-0.json").write_text('{"run_ts":"r2","step":"s","dataset":"t"}')
    assert commits.committed_runs(spark, str(tmp_path), "t") == ["r1"]
    assert commits.read_runs(spark, str(tmp_path), "t").count() == 1
    assert commits.read_runs(spark, str(tmp_path / "none"), "t") is None


def test_headers_of_many_files_in_one_job(spark, tmp_path):
    for i in range(60):
        extra = ',"a ""quoted"", name"' if i % 2 else ""
        (tmp_path / f"f{i:03d}.csv").write_text(("\ufeff" if i % 5 == 0 else "") + ("\n" if i % 7 == 0 else "") + f"id,source,text{extra}\n{i},s,\"x\ny\"{',z' if extra else ''}\n")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "no.csv").write_text("id,source,text\n9,s,t\n")
    spark.sparkContext.setJobGroup("headers", "")
    found = files.csv_headers(spark, str(tmp_path))
    jobs_run = len(spark.sparkContext.statusTracker().getJobIdsForGroup("headers"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert {h: len(p) for h, p in found.items()} == {("id", "source", "text"): 30, ("id", "source", "text", 'a "quoted", name'): 30}
    assert jobs_run < 8
    assert files.read_legacy_csv_dir(spark, str(tmp_path)).count() == 60


def test_mixed_raw_folder(spark, tmp_path):
    """Collected Parquet and legacy CSV side by side, a wide file, one without
    a text column, an empty file and both kinds of quotes in a list cell."""
    from stancekit.plans.jobs import read_raw
    from stancekit.sinks import writers as W
    from stancekit.sources import files

    tweets = spark.createDataFrame([("1", "twitter", "hello", ["x"])], "id string, source string, text string, hashtags array<string>")
    W.write_raw(tweets, str(tmp_path), "20240101_000000", "tweets")
    commits.commit(spark, str(tmp_path), "20240101_000000", "collect", ["tweets"])
    wide = ",".join(f"c{i}" for i in range(40))
    (tmp_path / "wide_20240102_000000.csv").write_text(f"{wide},id,source,text,hashtags\n{'v,' * 40}2,twitter,\"a\nb\",\"['a', \"\"it's\"\", 'c']\"\n")
    (tmp_path / "other_20240103_000000.csv").write_text("id,source\n3,twitter\n")
    (tmp_path / "empty.csv").write_text("")
    got = {r["id"]: r for r in read_raw(spark, str(tmp_path)).collect()}
    assert set(got) == {"1", "2"} and got["2"]["text"] == "a\nb" and got["2"]["hashtags"] == ["a", "it's", "c"]
    assert got["2"]["run_ts"] == "20240102_000000"
    skipped = files.skipped_files(spark, str(tmp_path)).collect()
    assert [(r["_file"].rpartition("/")[2], r["missing"]) for r in skipped] == [("other_20240103_000000.csv", ["text"])]


def test_dedupe_winner_does_not_depend_on_order(spark):
    from stancekit.plans.jobs import prepare

    rows = [("7", "twitter/@u", "from the timeline", "twitter", "r1"), ("7", "twitter", "from the search", "twitter", "r1")]
    for some in (rows, rows[::-1]):
        df = spark.createDataFrame(some, "id string, source string, text string, platform string, run_ts string").withColumn("url", F.lit(None).cast("string"))
        assert [r["source"] for r in prepare(df.coalesce(1))[0].collect()] == ["twitter"]


def test_records_that_fit_no_column_go_aside(spark, tmp_path):
    (tmp_path / "a_20240101_000000.csv").write_text('id,source,text\n1,s,one\n2,s,two,three\n3,s\n4,s,"a,b"\n5,s,x,y,z\n')
    (tmp_path / "b.csv").write_text("id,source\n6,s,too many\n")
    got = {r.id: r.text for r in files.read_legacy_csv_dir(spark, str(tmp_path)).collect()}
    assert got == {"1": "one", "3": None, "4": "a,b"}
    aside = sorted((r._file.rpartition("/")[2], r.fields) for r in files.quarantined_records(spark, str(tmp_path)).collect())
    assert aside == [("a_20240101_000000.csv", ["2", "s", "two", "three"]), ("a_20240101_000000.csv", ["5", "s", "x", "y"])]
    job = JobConfig(raw_data_dir=str(tmp_path), processed_data_dir=str(tmp_path / "p"), steps=("prepare",))
    assert jobs.run(spark, job, run_id="r").report == {"prepare": jobs.DONE}
    assert commits.read_runs(spark, str(tmp_path / "p"), "quarantined_records").count() == 2
    assert files.quarantined_records(spark, str(tmp_path / "none")).count() == 0


def test_runs_are_packed(spark, tmp_path):
    """Digests and repeated sentences: zstd, unless the caller says otherwise."""
    import pyarrow.parquet as pq

    def codecs(folder):
        parts = [os.path.join(folder, f) for f in os.listdir(folder) if f.endswith(".parquet")]
        return {pq.ParquetFile(p).metadata.row_group(0).column(0).compression for p in parts}

    df = spark.createDataFrame([("1", "twitter")], "id string, source string").coalesce(1)
    assert codecs(commits.write_run(df, str(tmp_path), "t", "r1")) == {"ZSTD"}
    assert codecs(commits.write_run(df, str(tmp_path), "t", "r2", compression="gzip")) == {"GZIP"}
