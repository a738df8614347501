"""Landed-table views over the driver's test tables.

The original tool read collector output (articles, posts, comments, tweets)
and manually labelled sentences. The shared test tables stand in for them:

* ``documents``      -> texts to prepare / posts of a forum (source = forum)
* ``labels``         -> manual labels (toxic -> contra, quality -> pro)
* ``pages``          -> landed news pages
* ``conversations``  -> threads: turn 0 is the post, later turns comments
* ``events``         -> tweets (event_type = hashtag, user_id = author)

Every view is a projection of its table, so the work grows with the data.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stancekit.operators.evaluate import prune_to_labels
from stancekit.operators.partitioning import spread_for_cpu

EPOCH_BASE = 1704067200  # 2024-01-01T00:00:00Z, base for synthetic epoch fields


# Tables whose rows carry long texts processed by CPU-heavy expressions,
# with the column that identifies a row.
TEXT_TABLES = {"documents": "doc_id", "pages": "page_id", "conversations": "conv_id"}


def table(spark: SparkSession, sf_dir: str, name: str, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """A table; ``keep`` prunes its rows next to the scan."""
    df = keep(spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet"))
    if name in TEXT_TABLES:
        df = spread_for_cpu(df, TEXT_TABLES[name])
    return df


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, source, text, lang`` from documents."""
    return _as_texts(table(spark, sf_dir, "documents"))


def _as_texts(d: DataFrame) -> DataFrame:
    return d.select(F.col("doc_id").cast("string").alias("id"), "source", "text", "lang")


def labeled_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts that have a label, others pruned before any text is cleaned."""
    return _as_texts(table(spark, sf_dir, "documents", lambda d: prune_to_labels(d, table(spark, sf_dir, "labels"), "doc_id")))


def labeled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, label``: toxic -> contra, else quality -> pro, else neutral."""
    lab = table(spark, sf_dir, "labels")
    label = (F.when(F.col("toxic") == 1, "contra").when(F.col("quality") == 1, "pro").otherwise("neutral"))
    return lab.select(F.col("doc_id").cast("string").alias("id"), label.alias("label"))


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forum posts: subreddit = source, title = first line, score = n_chars."""
    d = table(spark, sf_dir, "documents")
    did = F.col("doc_id").cast("string")
    return d.select(
        did.alias("id"),
        F.col("source").alias("subreddit"),
        F.split_part(F.col("text"), F.lit("\n"), F.lit(1)).alias("title"),
        "text",
        F.concat(F.lit("author"), (F.col("doc_id") % 97).cast("string")).alias("author"),
        F.col("n_chars").alias("score"),
        (F.lit(EPOCH_BASE) + F.col("doc_id") * 3600).alias("created_utc"),
        (F.col("n_chars") % 50).alias("num_comments"),
        F.concat(F.lit("/r/"), F.col("source"), F.lit("/comments/"), did, F.lit("/")).alias("permalink"),
    )


def thread_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First turn of every conversation as a post of forum ``threads``."""
    c = table(spark, sf_dir, "conversations").where(F.col("turn") == 0)
    cid = F.col("conv_id").cast("string")
    return c.select(
        cid.alias("id"), F.lit("threads").alias("subreddit"),
        F.split_part(F.col("text"), F.lit("\n"), F.lit(1)).alias("title"), "text",
        F.col("role").alias("author"), F.length("text").cast("long").alias("score"),
        (F.lit(EPOCH_BASE) + F.col("conv_id") * 3600).alias("created_utc"),
        F.lit(0).cast("long").alias("num_comments"),
        F.concat(F.lit("/r/threads/comments/"), cid, F.lit("/")).alias("permalink"),
    )


def thread_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Later turns as comments; the parent is the previous turn."""
    c = table(spark, sf_dir, "conversations").where(F.col("turn") > 0)
    cid = F.col("conv_id").cast("string")
    prev = F.concat(F.lit("t1_"), cid, F.lit("_"), (F.col("turn") - 1).cast("string"))
    return c.select(
        F.concat(cid, F.lit("_"), F.col("turn").cast("string")).alias("id"),
        cid.alias("post_id"), "text", F.col("role").alias("author"), F.col("turn").alias("score"),
        (F.lit(EPOCH_BASE) + F.col("conv_id") * 3600 + F.col("turn") * 60).alias("created_utc"),
        F.when(F.col("turn") == 1, F.concat(F.lit("t3_"), cid)).otherwise(prev).alias("parent_id"),
    )


def tweets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tweets: one hashtag (the event type) each, author ``user<id>``."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").cast("string").alias("id"),
        F.col("props").alias("text"),
        F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("author"),
        F.col("user_id").alias("followers_count"),
        F.col("ts").alias("created_at"),
        F.floor("value").cast("long").alias("retweet_count"),
        (F.col("event_id") % 10).alias("favorite_count"),
        F.array(F.col("event_type")).alias("hashtags"),
    )


def tweet_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw tweet objects with an ``entities`` struct; events with a value
    below 5 carry no entities (the projection must yield an empty list)."""
    e = table(spark, sf_dir, "events")
    ent = F.struct(F.array(F.struct(F.col("event_type").alias("text"))).alias("hashtags"))
    return e.select(
        F.col("event_id").cast("string").alias("id"),
        F.when(F.col("value") >= 5, ent).alias("entities"),
    )
