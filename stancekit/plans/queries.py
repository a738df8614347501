"""Registered queries over the driver tables, one per operator.

Each builder takes ``(spark, sf_dir)`` and returns a lazy DataFrame over
the whole tables. Doubles are rounded to 6 digits where sums or means over
doubles make the last bits depend on the summation order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stancekit.config import ClassifierConfig
from stancekit.functions import html_tree
from stancekit.functions import text as T
from stancekit.operators import evaluate as E
from stancekit.operators import trained_sentences as TS
from stancekit.operators import trained_scorer as TM
from stancekit.operators.classify import classification_stats, classify
from stancekit.operators.dedupe import dedupe_first, topn_per_key, union_all
from stancekit.operators.lexicon import match_lexicon
from stancekit.operators.rules import gap_rule_labels, rule_label
from stancekit.operators.sampling import labeling_sample
from stancekit.operators.scoring import ExpressionScorer, argmax_label, nli_scores, synthetic_logits
from stancekit.operators.sentences import explode_sentences
from stancekit.plans import catalog as C
from stancekit.session import scratch_path, stored
from stancekit.sources import files, news, social

FIXTURE = ClassifierConfig.fixture()
FIXTURE_LEMMA = ClassifierConfig(pro_triggers=FIXTURE.pro_triggers, contra_triggers=FIXTURE.contra_triggers,
                                 apply_lemma_rules=True)
SEARCH_TERMS = ("für", "the", "que", "nicht")
SITES = (("site_com", "example.com"), ("site_net", "example.net"), ("site_org", "example.org"))
HASHTAGS = ("view", "click")
USERS = ("user1", "user2", "user3", "user4", "user5")


def _r6(c):
    return F.round(c, 6)


# Text ------------------------------------------------------------------------

def q_clean_text(spark, d):
    docs = C.table(spark, d, "documents").select("doc_id", "text")
    return T.with_clean_text(docs, "text", "cleaned_text").select("doc_id", "cleaned_text")


def q_strip_html(spark, d):
    pages = C.table(spark, d, "pages")
    return pages.select("page_id", T.strip_html(F.col("html")).alias("text"))


def q_strip_urls(spark, d):
    pages = C.table(spark, d, "pages")
    joined = F.concat(F.col("url"), F.lit(" "), T.strip_html(F.col("html")))
    return pages.select("page_id", T.strip_urls(joined).alias("text"))


def q_strip_emoji(spark, d):
    docs = C.table(spark, d, "documents")
    return docs.select("doc_id", T.strip_emoji(F.col("text")).alias("text"))


def q_collapse_ws(spark, d):
    docs = C.table(spark, d, "documents")
    return docs.select("doc_id", T.collapse_ws(F.col("text")).alias("text"))


def q_strip_special(spark, d):
    docs = C.table(spark, d, "documents")
    return docs.select("doc_id", T.strip_special(F.col("text")).alias("text"))


def q_clean_pages(spark, d):
    pages = C.table(spark, d, "pages").select("page_id", "html")
    return T.with_clean_text(pages, "html", "cleaned_text").select("page_id", "cleaned_text")


def q_split_sentences(spark, d):
    docs = T.with_clean_text(C.table(spark, d, "documents").select("doc_id", "text"), "text", "c")
    return docs.select("doc_id", F.size(T.split_sentences(F.col("c"))).alias("n_sentences"))


def sentences(spark, d) -> DataFrame:
    return explode_sentences(C.texts(spark, d), text_col="text", already_clean=False)


def q_explode_sentences(spark, d):
    return sentences(spark, d)


def cleaned_documents(spark, d) -> DataFrame:
    """``id, source, clean``, stored: training and splitting read it several times."""
    return stored(T.with_clean_text(C.texts(spark, d).select("id", "source", "text"), "text", "clean").drop("text"), "cleaned")


def _trained(docs: DataFrame) -> TS.SentenceModel:
    return TS.train(docs, "clean", write=lambda df: stored(df, "sentence-model"))


def q_punkt_train(spark, d):
    """What the documents teach about periods, as one table."""
    m = _trained(cleaned_documents(spark, d))
    none = F.lit(None).cast("string").alias("next_word")
    score = F.round("score", 3).alias("score")
    return (m.abbreviations.select(F.lit("abbreviation").alias("kind"), "word", none, score)
            .union(m.collocations.select(F.lit("collocation"), "word", "next_word", score))
            .union(m.starters.select(F.lit("starter"), "word", none, score)))


def q_split_sentences_trained(spark, d):
    docs = cleaned_documents(spark, d)
    split = TS.split_sentences_trained(docs, _trained(docs))
    rows = split.select("id", F.posexplode_outer("sentences").alias("sentence_index", "sentence"))
    return rows.where(F.col("sentence").isNotNull())


# Classification ------------------------------------------------------------------

def q_rule_classify(spark, d):
    s = sentences(spark, d)
    return s.select("id", rule_label(F.col("sentence"), FIXTURE).alias("rule_based"))


def q_lemma_gap_rules(spark, d):
    s = sentences(spark, d)
    return s.select("id", rule_label(F.col("sentence"), FIXTURE_LEMMA).alias("rule_based"))


def q_lemma_gap_tokens(spark, d):
    """M2 on word positions, over sentences with a text of the original's own
    subject added to some of them, since its lemmas do not occur in the tables."""
    added = F.array(*[F.lit(x) for x in LEMMA_ENDINGS])
    s = sentences(spark, d)
    pick = (F.conv(F.substring("id", 1, 6), 16, 10).cast("long") % len(LEMMA_ENDINGS)).cast("int")
    text = F.concat_ws(" ", "sentence", F.get(added, pick))
    return gap_rule_labels(s.select("id", text.alias("sentence")), "sentence", FIXTURE).select("id", "rule_based")


LEMMA_ENDINGS = ("", "Die Produktivität ist im letzten Jahr gestiegen", "Es steigt die Produktivität", "Die Kosten für alle stiegen", "Das Problem",
                 "Alle waren zufrieden", "Zufrieden sind alle", "Der Wettbewerb ist ein Nachteil", "Gesundheit und Wohlbefinden", "")


def q_eval_join_rows(spark, d):
    """J1 fanned out: conversations' turns as results, their labels by turn role,
    so that ids repeat on both sides."""
    turns = C.table(spark, d, "conversations")
    cid = F.col("conv_id").cast("string").alias("id")
    results = turns.select(cid, "turn", F.when(F.length("text") % 2 == 0, "pro").otherwise("neutral").alias("final"))
    labeled = turns.select(cid, F.when(F.col("role") == "user", "pro").otherwise("contra").alias("label"))
    return E.eval_join_rows(results, labeled).select("id", "turn", "final", "label")


def opening_lexicon(sents: DataFrame) -> DataFrame:
    """A lexicon as large as the texts: the first 8 to 24 characters of every
    sentence of 24 or more, and the fixture's triggers."""
    number = lambda c, digits: F.conv(F.substring(F.md5(c), 1, digits), 16, 10).cast("long")
    text = F.lower("sentence")
    size = (number(text, 4) % 17 + 8).cast("int")
    openings = sents.where(F.char_length("sentence") >= 24).select(F.substring(text, F.lit(1), size).alias("trigger")).distinct()
    openings = openings.select(F.when(number(F.col("trigger"), 4) % 3 == 0, "pro").otherwise("contra").alias("label"),
                               number(F.col("trigger"), 7).alias("priority"), "trigger")
    fixed = [("pro", t) for t in FIXTURE.pro_triggers] + [("contra", t) for t in FIXTURE.contra_triggers]
    short = sents.sparkSession.createDataFrame([(label, 1 << 40, t) for label, t in fixed], openings.schema)
    return openings.union(short)


def q_large_lexicon_rules(spark, d):
    """J4 with a lexicon of tens of thousands of triggers, over whole documents."""
    docs = cleaned_documents(spark, d)
    sents = docs.select(F.explode(T.split_sentences(F.col("clean"))).alias("sentence"))
    return match_lexicon(docs, opening_lexicon(sents), stored, "id", "clean")


def sentence_results(spark, d) -> DataFrame:
    return classify(sentences(spark, d), FIXTURE)


def q_classification_stats(spark, d):
    st = classification_stats(sentence_results(spark, d), ("source",))
    return st.select(
        "source", "total", "pro", "contra", "neutral", "rule_based_used", "transformer_used",
        _r6(F.col("avg_confidence")).alias("avg_confidence"), _r6(F.col("pro_percent")).alias("pro_percent"),
        _r6(F.col("contra_percent")).alias("contra_percent"), _r6(F.col("neutral_percent")).alias("neutral_percent"),
    )


def q_german_sentence_stats(spark, d):
    """Minimum slice: German documents -> clean -> sentences -> rules ->
    statistics per source. The language filter reaches the Parquet scan."""
    de = C.texts(spark, d).where(F.col("lang") == "de")
    res = classify(explode_sentences(de, text_col="text", already_clean=False), FIXTURE)
    st = classification_stats(res, ("source",))
    return st.select(
        "source", "total", "pro", "contra", "neutral", "rule_based_used", "transformer_used",
        _r6(F.col("avg_confidence")).alias("avg_confidence"), _r6(F.col("pro_percent")).alias("pro_percent"),
        _r6(F.col("contra_percent")).alias("contra_percent"), _r6(F.col("neutral_percent")).alias("neutral_percent"),
    )


def q_classification_totals(spark, d):
    st = classification_stats(sentence_results(spark, d))
    return st.select(
        "total", "pro", "contra", "neutral", "rule_based_used", "transformer_used",
        _r6(F.col("avg_confidence")).alias("avg_confidence"), _r6(F.col("pro_percent")).alias("pro_percent"),
        _r6(F.col("contra_percent")).alias("contra_percent"), _r6(F.col("neutral_percent")).alias("neutral_percent"),
    )


def document_inputs(spark, d, texts=C.texts) -> DataFrame:
    """Whole documents as classification inputs (cleaned text)."""
    t = texts(spark, d).select("id", "source", "text")
    return T.with_clean_text(t, "text", "sentence").select("id", "source", "sentence")


def q_nli_argmax(spark, d):
    docs = document_inputs(spark, d)
    scored = ExpressionScorer(synthetic_logits).add_logits(docs, "sentence", FIXTURE)
    best = argmax_label(F.col("nli_logits"), FIXTURE)
    return scored.select("id", best.label.alias("transformer"), _r6(best.score).alias("transformer_score"))


def _word_model(spark, d, docs: DataFrame) -> TM.WordModel:
    labelled = docs.join(C.labeled(spark, d), "id").select("clean", "label")
    return TM.train_word_model(labelled, stored, "clean")


def q_label_word_weights(spark, d):
    """M3, trained: what the labelled documents say about each word."""
    w = _word_model(spark, d, cleaned_documents(spark, d)).weights
    return w.select("word", *[F.round(x, 6).alias(x) for x in ("pro", "contra", "neutral")])


def q_trained_nli_scores(spark, d):
    """M3 by the trained model: label and score of every document."""
    docs = cleaned_documents(spark, d)
    scored = TM.with_word_logits(docs, _word_model(spark, d, docs), "clean")
    best = argmax_label(F.col("nli_logits"), FIXTURE)
    return scored.select("id", best.label.alias("transformer"), F.round(best.score, 5).alias("transformer_score"))


def q_nli_scores(spark, d):
    docs = document_inputs(spark, d)
    scored = ExpressionScorer(synthetic_logits).add_logits(docs, "sentence", FIXTURE)
    long = nli_scores(scored, ["id"], FIXTURE)
    return long.select("id", "rank", "label", "logits", _r6(F.col("score")).alias("score"))


def document_results(spark, d, texts=C.texts) -> DataFrame:
    return classify(document_inputs(spark, d, texts), FIXTURE, ExpressionScorer(synthetic_logits))


def evaluated_results(spark, d) -> DataFrame:
    """Results of the labelled documents only: nothing else is cleaned or classified."""
    return document_results(spark, d, C.labeled_texts)


def q_combine_classify(spark, d):
    r = document_results(spark, d)
    return r.select("id", "source", "rule_based", "transformer", "final", _r6(F.col("confidence")).alias("confidence"))


# Evaluation ------------------------------------------------------------------

def _counts(spark, d):
    return E.pair_counts(evaluated_results(spark, d), C.labeled(spark, d))


def q_eval_join(spark, d):
    j = E.eval_join(evaluated_results(spark, d), C.labeled(spark, d))
    return j.select("id", "final", "label", E.WEIGHT_COL)


def q_accuracy_f1(spark, d):
    m = E.accuracy_f1(_counts(spark, d))
    return m.select(*[_r6(F.col(c)).alias(c) for c in m.columns])


def q_classification_report(spark, d):
    r = E.classification_report(_counts(spark, d))
    return r.select("class", *[_r6(F.col(c)).alias(c) for c in ("precision", "recall", "f1_score", "support")])


def q_confusion_matrix(spark, d):
    return E.confusion_matrix(_counts(spark, d))


def q_f1_chart(spark, d):
    f = E.f1_long(_counts(spark, d))
    return f.select("class", _r6(F.col("f1")).alias("f1"))


def q_misclassified(spark, d):
    j = E.eval_join(evaluated_results(spark, d), C.labeled(spark, d))
    return E.misclassified(j).select("id", "label", "final", "error_type", E.WEIGHT_COL)


def q_error_counts(spark, d):
    j = E.eval_join(evaluated_results(spark, d), C.labeled(spark, d))
    return E.error_counts(E.misclassified(j))


def q_error_rate(spark, d):
    j = E.eval_join(evaluated_results(spark, d), C.labeled(spark, d))
    r = E.error_rate(j)
    return r.select("misclassified", "total", _r6(F.col("error_rate")).alias("error_rate"))


# Sources -----------------------------------------------------------------------

def q_news_article_extract(spark, d):
    pages = C.table(spark, d, "pages")
    return news.extract_articles(pages, "landed")


def q_news_link_extract(spark, d):
    return news.extract_links(C.table(spark, d, "pages"), scope="page")


def q_article_tree_extract(spark, d):
    return html_tree.extract_articles_by_tree(C.table(spark, d, "pages"), "landed")


def q_tree_links(spark, d):
    """Links inside list items, by containment of elements."""
    return html_tree.extract_links_by_tree(C.table(spark, d, "pages"), "li")


def q_news_site_scan(spark, d):
    return news.news_site_scan(C.table(spark, d, "pages"), SITES[:1], max_pages=1)


def q_news_union(spark, d):
    return news.news_site_scan(C.table(spark, d, "pages"), SITES, max_pages=5)


def result_listings(pages: DataFrame) -> DataFrame:
    """Search-result pages that list the landed pages: twenty ids a listing, one
    for each site root, with links in the forms that pages use."""
    url, root = F.col("url"), news.url_root(F.col("url"))
    path = F.substring(url, F.length(root) + 1, 1 << 20)
    host = F.regexp_replace(root, "^[^:]*:", "")
    port = F.when(url.startswith("https:"), ":443").otherwise(":80")
    form = F.col("page_id") % 4
    href = (F.when(form == 0, F.concat(F.upper(root), path)).when(form == 1, path)
            .when(form == 2, F.concat(F.lit(".."), path)).otherwise(F.concat(host, port, path, F.lit("#top"))))
    number = F.floor(F.col("page_id") / 20) + 1
    anchor = F.concat(F.lit('<li><a href="'), href, F.lit('">x</a>'))
    listed = pages.select(root.alias("root"), number.alias("n"), anchor.alias("anchor")).groupBy("root", "n").agg(F.collect_list("anchor").alias("anchors"))
    return listed.select(F.concat("root", F.lit("/search/all?page="), F.col("n").cast("string")).alias("url"),
                         F.concat(F.lit("<article><ul>"), F.array_join("anchors", ""), F.lit("</article>")).alias("html"))


def q_news_search_scan(spark, d):
    """S3 with link following: articles that the first five result pages lead to."""
    pages = C.table(spark, d, "pages")
    return news.news_search_scan(pages, stored(result_listings(pages), "result-pages"), SITES, max_pages=5)


def q_post_search(spark, d):
    return social.post_search(C.posts(spark, d), ["src0"], SEARCH_TERMS, limit=10)


def q_post_search_multi(spark, d):
    subs = [f"src{i}" for i in range(20)]
    return social.post_search(C.posts(spark, d), subs, SEARCH_TERMS, limit=10)


def q_comments_for_posts(spark, d):
    picked = social.post_search(C.thread_posts(spark, d), ["threads"], SEARCH_TERMS, limit=25)
    return social.comments_for_posts(C.thread_comments(spark, d), picked)


def q_hashtag_search(spark, d):
    return social.hashtag_search(C.tweets(spark, d), HASHTAGS, lang=None, count=100)


def q_user_timeline(spark, d):
    return social.user_timeline(C.tweets(spark, d), USERS, count=20)


def q_tweets_union_dedupe(spark, d):
    return social.tweets_union_dedupe(C.tweets(spark, d), HASHTAGS, USERS, lang=None, count=100)


def q_hashtag_project(spark, d):
    raw = C.tweet_entities(spark, d)
    return raw.select("id", social.hashtag_texts(F.col("entities")).alias("hashtags"))


def q_topn_per_key(spark, d):
    ev = C.table(spark, d, "events")
    top = topn_per_key(ev, ["user_id"], [F.col("value").desc(), F.col("event_id")], 3, rank_col="rank")
    return top.select("user_id", "event_id", "value", F.col("rank").cast("int").alias("rank"))


def q_dedupe_first(spark, d):
    docs = C.table(spark, d, "documents")
    return dedupe_first(docs, ["text"], ["doc_id"])


def q_union_all(spark, d):
    docs = C.texts(spark, d).select("id", "source", "text")
    conv = C.table(spark, d, "conversations").select(
        F.concat(F.col("conv_id").cast("string"), F.lit("_"), F.col("turn").cast("string")).alias("id"),
        "text", "role")
    return union_all([docs, conv])


def q_csv_scan(spark, d):
    """S13 round trip: documents written as one-header-per-file CSV (quotes,
    commas and newlines inside texts) and imported by the legacy reader."""
    import uuid

    path = scratch_path(spark, "csv_scan", uuid.uuid4().hex)
    docs = C.texts(spark, d).select("id", "source", "text")
    (docs.write.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False)
     .option("ignoreTrailingWhiteSpace", False).csv(path))
    return files.read_legacy_csv_dir(spark, path).select("id", "source", "text")


def q_raw_mixed_scan(spark, d):
    """Documents landed as CSV files of several headers in one
    folder, one of them without a text column, with records that fit no
    column; what the import keeps, and which records went aside."""
    import uuid

    path = scratch_path(spark, "raw_mixed", uuid.uuid4().hex)
    docs = C.texts(spark, d).withColumn("n", F.col("id").cast("long")).select("id", "source", "text", "n")
    forms = {"posts": ["id", "source", "text", "n AS score"], "texts": ["text", "id", "source"], "headless": ["id", "source", "n AS score"]}
    for k, (form, columns) in enumerate(forms.items()):
        (docs.where(F.col("n") % 3 == k).selectExpr(*columns).write.option("header", True).option("escape", '"')
         .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(f"{path}/{form}"))
    broken = docs.where("n % 100 = 0").select("n", F.concat_ws(",", "id", "source", F.lit("text"), F.lit("1"), F.lit("too many")).alias("value"))
    header = spark.range(1).select(F.lit(-1).cast("long").alias("n"), F.lit("id,source,text,score").alias("value"))
    header.union(broken).repartition(1).sortWithinPartitions("n").select("value").write.text(f"{path}/broken")
    files.gather_files(spark, path, ".csv")
    headers = files.csv_headers(spark, path)
    kept = files.read_legacy_csv_dir(spark, path, headers=headers).select(F.lit("kept").alias("part"), "id", "source", "text", "score")
    aside = files.quarantined_records(spark, path, headers=headers).select(
        F.lit("aside"), F.get("fields", F.lit(0)), F.get("fields", F.lit(1)), F.get("fields", F.lit(4)), F.lit(None).cast("long"))
    return kept.union(aside)


def q_stream_classify(spark, d):
    """ST1: the documents table consumed as a stream (one micro-batch per
    file, trigger availableNow) through clean -> split -> classify into a
    Parquet sink with its checkpoint in the shared folder; returns the
    sink's contents, which equal the batch classification."""
    import uuid

    from stancekit.streaming import streams

    base = scratch_path(spark, "stream_classify", uuid.uuid4().hex)
    raw = streams.read_table_stream(spark, f"{d.rstrip('/')}/documents.parquet")
    items = raw.select(F.col("doc_id").cast("string").alias("id"), "source", "text")
    out = streams.stream_classify(items, FIXTURE).select(
        "id", "source", "text_id", "sentence_index", "rule_based", "final", "confidence")
    q = streams.start(out, f"{base}/out", f"{base}/checkpoint", available_now=True)
    q.awaitTermination()
    return spark.read.parquet(f"{base}/out")


def q_stream_window_stats(spark, d):
    """ST3: events consumed as a stream of tweets, classified per item and
    counted per 1-hour tumbling window and label with a 1-hour watermark
    (append mode): exactly the windows the watermark has closed are
    emitted. Window bounds are returned as text."""
    import uuid

    from stancekit.streaming import streams

    base = scratch_path(spark, "stream_window_stats", uuid.uuid4().hex)
    raw = streams.read_table_stream(spark, f"{d.rstrip('/')}/events.parquet")
    # Watermarks need TIMESTAMP; the table stores wall-clock UTC (NTZ).
    events = raw.select(F.col("event_id").cast("string").alias("id"), F.col("ts").cast("timestamp").alias("ts"), "props")
    items = T.with_clean_text(events,
                              "props", "sentence").drop("props")
    stats = streams.stream_stats(classify(items, FIXTURE, distinct_scoring=False), "ts", "1 hour", "1 hour")
    out = stats.select(F.col("window.start").cast("string").alias("window_start"),
                       F.col("window.end").cast("string").alias("window_end"), "final", "n",
                       F.round("avg_confidence", 6).alias("avg_confidence"))
    q = streams.start(out, f"{base}/out", f"{base}/checkpoint", available_now=True)
    q.awaitTermination()
    return spark.read.parquet(f"{base}/out")


def q_stream_dedupe_best(spark, d):
    """ST2: events as copies of one item a user, those less than 30 minutes
    apart together; the one of highest value (then smallest id) stays."""
    import uuid

    from stancekit.streaming import streams

    base = scratch_path(spark, "stream_dedupe_best", uuid.uuid4().hex)
    raw = streams.read_table_stream(spark, f"{d.rstrip('/')}/events.parquet")
    items = raw.select(F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("id"), F.lit("twitter").alias("source"),
                       F.col("ts").cast("timestamp").alias("ts"), "event_id", "value")
    best = streams.stream_dedupe_best(items, "ts", [-F.col("value"), "event_id"], "30 minutes", "1 hour")
    out = best.select("id", "event_id", "value", "platform", "n_copies", F.col("seen_from").cast("string").alias("seen_from"),
                      F.col("seen_until").cast("string").alias("seen_until"))
    q = streams.start(out, f"{base}/out", f"{base}/checkpoint", available_now=True)
    q.awaitTermination()
    return spark.read.parquet(f"{base}/out")


def q_sink_round_trip(spark, d):
    """K2 and K4: tables of a run written, its results twice as after a restart,
    and read back by its commit; a later run that never committed is not seen."""
    import uuid

    from stancekit.sinks import commits
    from stancekit.sinks import writers as W

    base = scratch_path(spark, "sink_round_trip", uuid.uuid4().hex)
    texts = C.texts(spark, d).select("id", F.concat(F.lit("forum/"), "source").alias("source"), "text")
    originals = T.with_clean_text(texts, "text", "cleaned_text")
    run, later = "20240101_000000", "20240102_000000"
    _, path = W.write_prepared(originals, explode_sentences(originals), base, run)
    results = classify(spark.read.parquet(path).drop("platform"), FIXTURE)
    for _ in range(2):
        W.write_results(results, base, run)
    commits.commit(spark, base, run, "model", ["classification_results"])
    W.write_results(results, base, later)
    back = commits.read_runs(spark, base, "classification_results")
    return back.select("id", "source", "platform", "text_id", "sentence_index", "sentence", "final", "confidence", "run_ts")


def q_evaluate_all(spark, d):
    """Every metric of an evaluation, in long form."""
    m = E.evaluate(E.eval_join(evaluated_results(spark, d), C.labeled(spark, d)), "label", "final")
    summary = m["summary"].select(F.expr("stack(4, 'accuracy', accuracy, 'f1_pro', f1_pro, 'f1_contra', f1_contra, 'f1_neutral', f1_neutral)")
                                  .alias("name", "value")).select(F.lit("summary").alias("part"), "name", "value")
    report = m["report"].select(F.lit("report").alias("part"), "class", F.expr(
        "stack(4, 'precision', precision, 'recall', recall, 'f1_score', f1_score, 'support', support)").alias("what", "value"))
    report = report.select("part", F.concat_ws("/", "class", "what").alias("name"), "value")
    grid = m["confusion"].select(F.lit("confusion").alias("part"), F.concat_ws("/", "true_label", "pred_label").alias("name"),
                                 F.col("count").cast("double").alias("value"))
    return summary.union(report).union(grid).withColumn("value", _r6(F.col("value")))


def q_error_analysis(spark, d):
    """Misclassified rows, each with how often its kind of error occurs."""
    joined = E.eval_join(evaluated_results(spark, d), C.labeled(spark, d))
    mis, counts = E.error_analysis(joined, "label", "final", "sentence")
    return mis.select("id", "label", "final", "error_type").join(counts.withColumnRenamed("count", "n_of_type"), "error_type").select(
        "id", "label", "final", "error_type", "n_of_type")


def q_labeling_sample(spark, d):
    return labeling_sample(sentences(spark, d), 50)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "clean_text": q_clean_text,
    "strip_html": q_strip_html,
    "strip_urls": q_strip_urls,
    "strip_emoji": q_strip_emoji,
    "collapse_ws": q_collapse_ws,
    "strip_special": q_strip_special,
    "clean_pages": q_clean_pages,
    "split_sentences": q_split_sentences,
    "explode_sentences": q_explode_sentences,
    "punkt_train": q_punkt_train,
    "split_sentences_trained": q_split_sentences_trained,
    "rule_classify": q_rule_classify,
    "lemma_gap_rules": q_lemma_gap_rules,
    "lemma_gap_tokens": q_lemma_gap_tokens,
    "large_lexicon_rules": q_large_lexicon_rules,
    "classification_stats": q_classification_stats,
    "classification_totals": q_classification_totals,
    "german_sentence_stats": q_german_sentence_stats,
    "nli_argmax": q_nli_argmax,
    "nli_scores": q_nli_scores,
    "label_word_weights": q_label_word_weights,
    "trained_nli_scores": q_trained_nli_scores,
    "combine_classify": q_combine_classify,
    "eval_join": q_eval_join,
    "eval_join_rows": q_eval_join_rows,
    "accuracy_f1": q_accuracy_f1,
    "classification_report": q_classification_report,
    "confusion_matrix": q_confusion_matrix,
    "f1_chart": q_f1_chart,
    "misclassified": q_misclassified,
    "error_counts": q_error_counts,
    "error_rate": q_error_rate,
    "news_article_extract": q_news_article_extract,
    "news_link_extract": q_news_link_extract,
    "article_tree_extract": q_article_tree_extract,
    "tree_links": q_tree_links,
    "news_site_scan": q_news_site_scan,
    "news_union": q_news_union,
    "news_search_scan": q_news_search_scan,
    "post_search": q_post_search,
    "post_search_multi": q_post_search_multi,
    "comments_for_posts": q_comments_for_posts,
    "hashtag_search": q_hashtag_search,
    "user_timeline": q_user_timeline,
    "tweets_union_dedupe": q_tweets_union_dedupe,
    "hashtag_project": q_hashtag_project,
    "topn_per_key": q_topn_per_key,
    "dedupe_first": q_dedupe_first,
    "union_all": q_union_all,
    "labeling_sample": q_labeling_sample,
    "csv_scan": q_csv_scan,
    "raw_mixed_scan": q_raw_mixed_scan,
    "stream_classify": q_stream_classify,
    "stream_window_stats": q_stream_window_stats,
    "stream_dedupe_best": q_stream_dedupe_best,
    "sink_round_trip": q_sink_round_trip,
    "evaluate_all": q_evaluate_all,
    "error_analysis": q_error_analysis,
}
