"""ST1-ST3: streaming gives the batch result."""

import os
import tempfile

from pyspark.sql import functions as F

from stancekit.config import ClassifierConfig
from stancekit.operators.classify import classify
from stancekit.operators.sentences import explode_sentences
from stancekit.plans import catalog as C
from stancekit.streaming import streams

from conftest import SF001


def test_stream_classify_equals_batch(spark):
    base = tempfile.mkdtemp(prefix="stancekit-stream-")
    raw_path = os.path.join(base, "raw")
    raw = C.texts(spark, SF001).select("id", "source", "text")
    raw.repartition(3).write.parquet(raw_path)
    cfg = ClassifierConfig.fixture()
    stream = streams.stream_classify(streams.read_raw_stream(spark, raw_path, raw.schema, 1), cfg)
    q = streams.start(stream, os.path.join(base, "out"), os.path.join(base, "ckpt"), available_now=True)
    q.awaitTermination(600)
    got = spark.read.parquet(os.path.join(base, "out"))
    want = classify(explode_sentences(raw, text_col="text", already_clean=False), cfg)
    cols = ["id", "final", "confidence", "sentence_index"]
    assert got.count() == want.count()
    assert got.select(cols).exceptAll(want.select(cols)).count() == 0


def test_stream_dedupe_and_window_stats(spark):
    base = tempfile.mkdtemp(prefix="stancekit-stream2-")
    src = os.path.join(base, "in")
    rows = [("1", "twitter", "2024-01-01 00:00:00", "pro", 0.9), ("1", "twitter", "2024-01-01 00:10:00", "pro", 0.9),
            ("2", "twitter/@x", "2024-01-01 00:20:00", "contra", 0.5), ("3", "reddit/r/de", "2024-01-01 02:00:00", "pro", 0.9)]
    df = spark.createDataFrame(rows, "id string, source string, ts string, final string, confidence double") \
        .withColumn("ts", F.to_timestamp("ts"))
    df.coalesce(1).write.parquet(src)
    stream = spark.readStream.schema(df.schema).parquet(src)
    dd = streams.stream_dedupe(stream, "ts", "1 hour")
    q = dd.writeStream.format("memory").queryName("dedupe_out").trigger(availableNow=True).start()
    q.awaitTermination(300)
    assert sorted(r.id for r in spark.table("dedupe_out").collect()) == ["1", "2", "3"]
    st = streams.stream_stats(stream, "ts", "1 hour", "0 seconds")
    q2 = st.writeStream.format("memory").queryName("stats_out").outputMode("append").trigger(availableNow=True).start()
    q2.awaitTermination(300)
    got = {(r.window.start.hour, r.final): r.n for r in spark.table("stats_out").collect()}
    assert got[(0, "pro")] == 2 and got[(0, "contra")] == 1


def test_stream_over_part_files(spark, tmp_path):
    from stancekit.streaming import streams

    path = f"{tmp_path}/documents.parquet"
    spark.range(40).repartition(4).write.parquet(path)
    for p in (path, "/root/testdata/sf0.001/region.parquet"):
        q = streams.read_table_stream(spark, p).writeStream.format("memory").queryName("parts").trigger(availableNow=True).start()
        q.awaitTermination()
        assert spark.table("parts").count() == spark.read.parquet(p).count()


def test_dedupe_by_priority_equals_batch_and_survives_a_restart(spark, tmp_path):
    """Copies of an item arrive in several files and runs; of those on time the
    best one comes out once, whatever came first, and late ones change nothing."""
    from pyspark.sql import Window

    schema = "id string, source string, ts timestamp, prio int, text string"
    t = lambda minute: f"2024-01-01 {minute // 60:02d}:{minute % 60:02d}:00"
    runs = [[("a", "twitter/@x", t(0), 1, "timeline"), ("b", "twitter", t(2), 0, "b")],
            [("a", "twitter", t(5), 0, "search"), ("c", "reddit/r/de", t(6), 0, "c"), ("a", "reddit/r/de", t(7), 3, "other platform")],
            [("b", "twitter/@y", t(8), 2, "worse"), ("d", "twitter", t(300), 0, "d")],
            [("a", "twitter", t(1), -1, "too late"), ("e", "twitter", t(600), 0, "moves the watermark")]]
    src, out, ckpt = (str(tmp_path / x) for x in ("in", "out", "ckpt"))
    frames = []
    for n, rows in enumerate(runs):
        df = spark.createDataFrame(rows, schema.replace("ts timestamp", "ts string")).withColumn("ts", F.to_timestamp("ts"))
        df.coalesce(1).write.mode("append").parquet(src)
        frames.append(df)
        stream = spark.readStream.schema(schema).parquet(src)
        best = streams.stream_dedupe_best(stream, "ts", ["prio", "ts"], "30 minutes", "1 hour")
        q = streams.start(best, out, ckpt, available_now=True)  # a new query on the old checkpoint
        q.awaitTermination(300)
    got = {(r.id, r.platform): (r.text, r.n_copies) for r in spark.read.parquet(out).collect()}
    on_time = frames[0].union(frames[1]).union(frames[2]).withColumn("platform", F.substring_index("source", "/", 1))
    first = Window.partitionBy("id", "platform").orderBy("prio", "ts")
    batch = on_time.withColumn("k", F.row_number().over(first)).where("k = 1 and id <> 'd'")
    assert {k: v[0] for k, v in got.items() if k[0] != "d"} == {(r.id, r.platform): r.text for r in batch.collect()}
    assert got["a", "twitter"] == ("search", 2) and got["b", "twitter"] == ("b", 2) and got["a", "reddit"] == ("other platform", 1)
