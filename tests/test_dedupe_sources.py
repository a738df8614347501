"""D1, D2, L1, L2, S1-S12."""

import random

from pyspark.sql import functions as F

from stancekit.operators.dedupe import dedupe_first, topn_per_key, union_all
from stancekit.operators.sampling import labeling_sample
from stancekit.sources import news, social


def test_dedupe_first_keeps_lowest_order_and_survives_hot_key(spark):
    rnd = random.Random(3)
    rows = [("hot", rnd.randrange(1000), i) for i in range(300)] + [(f"k{i % 50}", rnd.randrange(1000), i) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, prio int, seq int").repartition(7)
    got = {r.k: (r.prio, r.seq) for r in dedupe_first(df, ["k"], ["prio", "seq"]).collect()}
    want = {}
    for k, p, s in rows:
        if k not in want or (p, s) < want[k]:
            want[k] = (p, s)
    assert got == want


def test_union_all_pads_missing_columns(spark):
    a = spark.createDataFrame([("1", "x")], "id string, text string")
    b = spark.createDataFrame([("2", 5)], "id string, score long")
    u = union_all([a, b])
    assert u.columns == ["id", "text", "score"]
    assert sorted(u.collect(), key=lambda r: r.id)[1].text is None


def test_topn_per_key_plans_group_limit(spark):
    df = spark.createDataFrame([(k, v) for k in "ab" for v in range(10)], "k string, v int")
    top = topn_per_key(df, ["k"], [F.col("v").desc()], 3, rank_col="rank")
    assert sorted((r.k, r.v) for r in top.collect()) == [("a", 7), ("a", 8), ("a", 9), ("b", 7), ("b", 8), ("b", 9)]
    assert "WindowGroupLimit" in top._jdf.queryExecution().executedPlan().toString()


def test_labeling_sample_exact_size_and_stable(spark):
    df = spark.createDataFrame([(f"id{i}", f"s{i}") for i in range(100)], "id string, sentence string")
    a = labeling_sample(df, 50)
    b = labeling_sample(df.repartition(13), 50)
    ids_a = sorted(r.id for r in a.collect())
    assert len(ids_a) == 50 and ids_a == sorted(r.id for r in b.collect())
    assert a.where(F.col("label").isNotNull()).count() == 0
    small = spark.createDataFrame([(f"id{i}", "s") for i in range(7)], "id string, sentence string")
    assert labeling_sample(small, 50).count() == 7


PAGE = ("<html><head><title>T</title><script>var x='<p>no</p>';</script></head><body>"
        "<nav><a href=\"/rel\">r</a><a href=\"https://abs.example.org/x\">a</a></nav>"
        "<article><h1> Titel &amp; mehr </h1><time datetime=\"2024-05-01T10:00:00\">1. Mai</time>"
        "<p>Erster <b>Absatz</b>.</p><div>skip</div><p>Zweiter<p>Dritter offen</article></body></html>")


def test_article_extraction(spark):
    df = spark.createDataFrame([("https://www.site.example.com/a?page=2", PAGE), ("https://x.example.net/b", "<p>nur</p>"),
                                ("https://x.example.net/c", None)], "url string, html string")
    rows = news.extract_articles(df, "site").orderBy("url").collect()
    assert len(rows) == 2
    a, b = rows
    assert (a.title, a.text, a.date) == ("Titel & mehr", "Erster Absatz. Zweiter Dritter offen", "2024-05-01T10:00:00")
    assert (b.title, b.text, b.date) == ("No title", "", None)
    assert len(a.id) == 64 and a.id != b.id


def test_link_extraction_and_site_scan(spark):
    df = spark.createDataFrame([("https://www.site.example.com/a?page=2", PAGE)], "url string, html string")
    links = [r.link for r in news.extract_links(df, scope="page").orderBy("link_index").collect()]
    assert links == ["https://www.site.example.com/rel", "https://abs.example.org/x"]
    assert news.extract_links(df, scope="article").count() == 0
    sites = (("one", "example.com"), ("two", "site.example.com"), ("three", "example.org"))
    scanned = news.news_site_scan(df, sites, max_pages=5)
    assert sorted(r.source for r in scanned.collect()) == ["one", "two"]
    assert news.news_site_scan(df, sites, max_pages=1).count() == 0


def test_post_search_limits_and_dedupes(spark):
    posts = spark.createDataFrame([
        ("p1", "de", "4-Tage-Woche jetzt", "", "u", 10, 0, 1, "/r/de/p1"),
        ("p2", "de", "Arbeitszeit", "4-Tage-Woche", "u", 30, 0, 1, "/r/de/p2"),
        ("p3", "de", "nichts", "", "u", 50, 0, 1, "/r/de/p3"),
        ("p4", "other", "4-Tage-Woche", "", "u", 99, 0, 1, "/r/other/p4"),
    ], "id string, subreddit string, title string, text string, author string, score long, "
       "created_utc long, num_comments long, permalink string")
    got = social.post_search(posts, ["de"], ["4-Tage-Woche", "Arbeitszeit"], limit=1).collect()
    assert [(r.id, r.source, r.url, r.created_utc) for r in got] == [
        ("p2", "reddit/r/de", "https://www.reddit.com/r/de/p2", "1970-01-01T00:00:00")]
    comments = spark.createDataFrame([("c1", "p2", "hi", "a", 1, 60, "t3_p2"), ("c2", "p1", "x", "b", 1, 0, "t3_p1")],
                                     "id string, post_id string, text string, author string, score long, "
                                     "created_utc long, parent_id string")
    picked = social.comments_for_posts(comments, spark.createDataFrame(got))
    assert [(r.id, r.source, r.created_utc) for r in picked.collect()] == [("c1", "reddit_comment", "1970-01-01T00:01:00")]


def test_tweets_union_keeps_hashtag_copy(spark):
    tw = spark.createDataFrame([
        ("1", "a", "alice", 5, "2024-01-02 00:00:00", 0, 0, ["NewWork"]),
        ("2", "b", "bob", 5, "2024-01-03 00:00:00", 0, 0, ["other"]),
    ], "id string, text string, author string, followers_count long, created_at string, retweet_count long, "
       "favorite_count long, hashtags array<string>").withColumn("created_at", F.to_timestamp("created_at"))
    both = {r.id: r for r in social.tweets_union_dedupe(tw, ["newwork"], ["alice", "bob"], lang=None).collect()}
    assert both["1"].source == "twitter" and both["1"].url == "https://twitter.com/user/status/1"
    assert both["2"].source == "twitter/@bob" and both["2"].url == "https://twitter.com/bob/status/2"
    assert both["1"].created_at == "2024-01-02T00:00:00+00:00"


def test_hashtag_projection(spark):
    df = spark.createDataFrame([({"hashtags": [{"text": "a"}, {"text": "b"}]},), (None,)],
                               "entities struct<hashtags: array<struct<text: string>>>")
    assert [r.h for r in df.select(social.hashtag_texts(F.col("entities")).alias("h")).collect()] == [["a", "b"], []]


def test_comment_limit_per_post(spark):
    comments = spark.createDataFrame(
        [(f"c{i}", "p1" if i < 5 else "p2", "t", "a", 1, 100 - i, "x") for i in range(8)],
        "id string, post_id string, text string, author string, score long, created_utc long, parent_id string")
    posts = spark.createDataFrame([("p1",), ("p2",)], "id string")
    got = social.comments_for_posts(comments, posts, limit_per_post=2).collect()
    assert sorted((r.post_id, r.id) for r in got) == [("p1", "c3"), ("p1", "c4"), ("p2", "c6"), ("p2", "c7")]


def test_raw_sink_csv(spark, tmp_path):
    from stancekit.sinks import writers as W

    df = spark.createDataFrame([("1", "twitter", 'a "q", b', ["x", "y"])], "id string, source string, text string, hashtags array<string>")
    path = W.write_raw(df, str(tmp_path), "20240101_000000", "tweets", fmt="csv")
    back = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path).first()
    assert back.text == 'a "q", b' and back.hashtags == '["x","y"]' and back.platform == "twitter"


def test_article_edge_cases(spark):
    html = ("<h1>Erst <em>fett</em> &amp; mehr</h1><article class='a'><p class=\"x\">Eins</p>"
            "<P>Zwei &#8220;zitiert&#8221;</P><p></p><p>Drei</p></article><article><p>zweiter Artikel</p></article>"
            "<time class='t'>ohne Attribut</time>")
    df = spark.createDataFrame([("https://a.example.com/x", html)], "url string, html string")
    r = news.extract_articles(df, "s").first()
    assert r.title == "Erst fett & mehr"
    # All paragraphs of all articles; an empty one keeps its slot, like ' '.join.
    assert r.text == "Eins Zwei “zitiert”  Drei zweiter Artikel"
    assert r.date is None  # a <time> without datetime gives no date


def test_confusion_wide(spark):
    from stancekit.operators import evaluate as E

    df = spark.createDataFrame([("pro", "pro", 2), ("contra", "pro", 1)], "true_label string, pred_label string, n long")
    rows = {r.true_label: (r.pro, r.contra, r.neutral) for r in E.confusion_wide(df).collect()}
    assert rows == {"pro": (2, 0, 0), "contra": (1, 0, 0), "neutral": (0, 0, 0)}


def test_link_forms_and_page_numbers(spark):
    html = """<article><a href="/d?a=1&amp;b=2">x</a><a class=c href='/k'>y</a></article><article><A HREF=/m>z</a></article>"""
    df = spark.createDataFrame([("https://a.example.com/x", html)], "url string, html string")
    root = "https://a.example.com"
    assert [r.link for r in news.extract_links(df).orderBy("link_index").collect()] == [f"{root}/d?a=1&b=2", f"{root}/k", f"{root}/m"]
    urls = ["u?page=0000000000099", "u?page=10000000000", "u?page=7&x=1", "u", "u?page=" + "9" * 40]
    got = spark.createDataFrame([(u,) for u in urls], "u string").select(news.url_page_no(F.col("u")).alias("n")).collect()
    assert [r.n for r in got] == [99, 10_000_000_000, 7, 1, (1 << 63) - 1]
