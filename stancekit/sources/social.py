"""Post, comment and tweet collection over landed tables.

The API clients searched remote services term by term with a per-term
limit. Over landed tables the same selection is one plan: the matching
terms of each row are exploded, the per-term limit is a top-N window
(WindowGroupLimit, pre-limited before the shuffle) and keep-first
de-duplication is a grouped ``min_by``. Remote search ranking cannot be
reproduced; the ordering inside each term is an explicit parameter.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stancekit.operators.dedupe import dedupe_first

POST_COLUMNS = ("id", "source", "url", "title", "text", "author", "score", "created_utc", "num_comments")
COMMENT_COLUMNS = ("id", "post_id", "source", "text", "author", "score", "created_utc", "parent_id")
TWEET_COLUMNS = ("id", "source", "url", "text", "author", "followers_count", "created_at",
                 "retweet_count", "favorite_count", "hashtags")


# Field builders (F2 / F3 / F4 / S12) ------------------------------------------

def epoch_to_iso(seconds: Column) -> Column:
    """epoch seconds -> ``yyyy-MM-ddTHH:mm:ss`` (session time zone)."""
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss")


def ts_to_iso(ts: Column) -> Column:
    """Aware timestamp -> ISO string with UTC offset."""
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))


def reddit_url(permalink: Column) -> Column:
    """``https://www.reddit.com{permalink}``."""
    return F.concat(F.lit("https://www.reddit.com"), permalink)


def tweet_url(tweet_id: Column, username: Column | None = None) -> Column:
    """status url; ``user`` stands in when no username is known."""
    who = username if username is not None else F.lit("user")
    return F.concat(F.lit("https://twitter.com/"), who, F.lit("/status/"), tweet_id)


def subreddit_source(sub: Column) -> Column:
    """``reddit/r/{subreddit}``."""
    return F.concat(F.lit("reddit/r/"), sub)


def user_source(username: Column) -> Column:
    """``twitter/@{username}``."""
    return F.concat(F.lit("twitter/@"), username)


def hashtag_texts(entities: Column) -> Column:
    """``[h.text for h in entities.hashtags]``, empty when missing."""
    return F.coalesce(F.transform(entities.getField("hashtags"), lambda h: h.getField("text")),
                      F.array().cast("array<string>"))


# Posts and comments ----------------------------------------------------------

def _term_hits(text: Column, terms: Sequence[str]) -> Column:
    """Index of every search term occurring in ``text`` (case-insensitive)."""
    lo = F.lower(text)
    return F.explode(F.array(*[F.when(lo.contains(t.lower()), F.lit(i)) for i, t in enumerate(terms)]))


def post_search(posts: DataFrame, subreddits: Sequence[str], terms: Sequence[str], limit: int = 100,
                order: Sequence[Column] | None = None) -> DataFrame:
    """Posts of the given subreddits matching any term, at most
    ``limit`` per (subreddit, term), de-duplicated by id keeping the copy of
    the earliest term and rank.

    ``posts`` needs ``id, subreddit, title, text, author, score,
    created_utc (epoch seconds), num_comments, permalink``.
    """
    from stancekit.operators.dedupe import topn_per_key

    order = list(order) if order is not None else [F.col("score").desc(), F.col("id")]
    hay = F.concat_ws(" ", F.col("title"), F.col("text"))
    hits = posts.where(F.col("subreddit").isin(*subreddits)).select("*", _term_hits(hay, terms).alias("term_idx"))
    hits = hits.where(F.col("term_idx").isNotNull())
    ranked = topn_per_key(hits, ["subreddit", "term_idx"], order, limit, rank_col="rank")
    shaped = ranked.select(
        F.col("id").cast("string").alias("id"),
        subreddit_source(F.col("subreddit")).alias("source"),
        reddit_url(F.col("permalink")).alias("url"),
        "title", "text", F.col("author").cast("string").alias("author"),
        F.col("score").cast("long").alias("score"),
        epoch_to_iso(F.col("created_utc")).alias("created_utc"),
        F.col("num_comments").cast("long").alias("num_comments"),
        "term_idx", "rank",
    )
    first = dedupe_first(shaped, ["source", "id"], ["term_idx", "rank"])
    return first.select(*POST_COLUMNS)


def comments_for_posts(comments: DataFrame, posts: DataFrame, limit_per_post: int | None = None) -> DataFrame:
    """Every comment of the given posts (left-semi join on post id).

    ``comments`` needs ``id, post_id, text, author, score, created_utc
    (epoch seconds), parent_id``. Q7: with ``limit_per_post`` only the
    earliest ``limit_per_post`` comments of each post are kept (top-N per
    key, pre-limited before the shuffle).
    """
    from stancekit.operators.dedupe import topn_per_key

    wanted = posts.select(F.col("id").cast("string").alias("post_id"))
    picked = comments.withColumn("post_id", F.col("post_id").cast("string")).join(wanted, "post_id", "left_semi")
    if limit_per_post is not None:
        picked = topn_per_key(picked, ["post_id"], [F.col("created_utc"), F.col("id")], limit_per_post)
    return picked.select(
        F.col("id").cast("string").alias("id"), "post_id", F.lit("reddit_comment").alias("source"), "text",
        F.col("author").cast("string").alias("author"), F.col("score").cast("long").alias("score"),
        epoch_to_iso(F.col("created_utc")).alias("created_utc"), F.col("parent_id").cast("string").alias("parent_id"),
    )


# Tweets ----------------------------------------------------------------------

def _tweet_shape(df: DataFrame, source: Column, url: Column) -> DataFrame:
    return df.select(
        F.col("id").cast("string").alias("id"), source.alias("source"), url.alias("url"), "text",
        F.col("author").cast("string").alias("author"), F.col("followers_count").cast("long").alias("followers_count"),
        ts_to_iso(F.col("created_at")).alias("created_at"), F.col("retweet_count").cast("long").alias("retweet_count"),
        F.col("favorite_count").cast("long").alias("favorite_count"), F.col("hashtags"),
        *[c for c in ("prio", "grp", "rank") if c in df.columns],
    )


def _tag_hits(hashtags: Column, tags: Sequence[str]) -> Column:
    """Index of every requested hashtag the tweet carries (case-insensitive)."""
    wrapped = F.concat(F.lit("\u0001"), F.lower(F.array_join(hashtags, "\u0001")), F.lit("\u0001"))
    return F.explode(F.array(*[F.when(wrapped.contains(f"\u0001{t.lower()}\u0001"), F.lit(i))
                               for i, t in enumerate(tags)]))


def _hashtag_ranked(tweets: DataFrame, hashtags: Sequence[str], lang: str | None, count: int) -> DataFrame:
    from stancekit.operators.dedupe import topn_per_key

    base = tweets
    if lang is not None and "lang" in tweets.columns:
        base = base.where(F.col("lang") == lang)
    if "is_retweet" in tweets.columns:
        base = base.where(~F.coalesce(F.col("is_retweet"), F.lit(False)))
    hits = base.select("*", _tag_hits(F.col("hashtags"), hashtags).alias("grp")).where(F.col("grp").isNotNull())
    ranked = topn_per_key(hits, ["grp"], [F.col("created_at").desc(), F.col("id")], count, rank_col="rank")
    return _tweet_shape(ranked, F.lit("twitter"), tweet_url(F.col("id").cast("string")))


def hashtag_search(tweets: DataFrame, hashtags: Sequence[str], lang: str | None = "de", count: int = 100) -> DataFrame:
    """Original tweets carrying any hashtag, ``count`` newest per
    hashtag, de-duplicated by id keeping the earliest hashtag's copy."""
    ranked = _hashtag_ranked(tweets, hashtags, lang, count)
    return dedupe_first(ranked, ["id"], ["grp", "rank"]).select(*TWEET_COLUMNS)


def _timeline_ranked(tweets: DataFrame, usernames: Sequence[str], count: int) -> DataFrame:
    from stancekit.operators.dedupe import topn_per_key

    idx = F.array_position(F.array(*[F.lit(u) for u in usernames]), F.col("author")).cast("int")
    base = tweets.where(F.col("author").isin(*usernames)).withColumn("grp", idx)
    ranked = topn_per_key(base, ["grp"], [F.col("created_at").desc(), F.col("id")], count, rank_col="rank")
    user = F.col("author").cast("string")
    return _tweet_shape(ranked, user_source(user), tweet_url(F.col("id").cast("string"), user))


def user_timeline(tweets: DataFrame, usernames: Sequence[str], count: int = 100) -> DataFrame:
    """The ``count`` newest tweets of each user (no de-duplication, no
    language or retweet filter)."""
    return _timeline_ranked(tweets, usernames, count).select(*TWEET_COLUMNS)


def tweets_union_dedupe(tweets: DataFrame, hashtags: Sequence[str], usernames: Sequence[str],
                        lang: str | None = "de", count: int = 100) -> DataFrame:
    """Hashtag tweets then timeline tweets, one row per id; the hashtag
    copy wins (it comes first in collection order).

    One scan: every tweet carries its memberships -- ``(0, hashtag index)``
    for each requested hashtag it has (subject to the language and retweet
    filters) and ``(1, user index)`` for its author's timeline -- exploded
    into one relation, limited to ``count`` per membership by one
    group-limited window and de-duplicated by id on ``(prio, grp, rank)``.
    """
    from stancekit.operators.dedupe import topn_per_key

    tag_ok = F.lit(True)
    if lang is not None and "lang" in tweets.columns:
        tag_ok = tag_ok & (F.col("lang") == lang)
    if "is_retweet" in tweets.columns:
        tag_ok = tag_ok & ~F.coalesce(F.col("is_retweet"), F.lit(False))
    wrapped = F.concat(F.lit("\u0001"), F.lower(F.array_join(F.col("hashtags"), "\u0001")), F.lit("\u0001"))
    member = []
    for i, t in enumerate(hashtags):
        hit = tag_ok & wrapped.contains(f"\u0001{t.lower()}\u0001")
        member.append(F.when(hit, F.struct(F.lit(0).alias("prio"), F.lit(i).alias("grp"))))
    for j, u in enumerate(usernames, start=1):
        member.append(F.when(F.col("author") == u, F.struct(F.lit(1).alias("prio"), F.lit(j).alias("grp"))))
    hits = tweets.select("*", F.explode(F.array(*member)).alias("_m")).where(F.col("_m").isNotNull())
    hits = hits.select("*", F.col("_m.prio").alias("prio"), F.col("_m.grp").alias("grp")).drop("_m")
    ranked = topn_per_key(hits, ["prio", "grp"], [F.col("created_at").desc(), F.col("id")], count, rank_col="rank")
    user = F.col("author").cast("string")
    tid = F.col("id").cast("string")
    source = F.when(F.col("prio") == 0, F.lit("twitter")).otherwise(user_source(user))
    url = F.when(F.col("prio") == 0, tweet_url(tid)).otherwise(tweet_url(tid, user))
    shaped = _tweet_shape(ranked, source, url)
    return dedupe_first(shaped, ["id"], ["prio", "grp", "rank"]).select(*TWEET_COLUMNS)
