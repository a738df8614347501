"""Randomised and property checks (cleaning, splitting, ids, counts)."""

import random

from pyspark.sql import functions as F

from stancekit.config import ClassifierConfig
from stancekit.functions import text as T
from stancekit.operators.classify import classification_stats, classify
from stancekit.operators.sentences import explode_sentences
from stancekit.plans import catalog as C

import pymodel
from conftest import SF001

PIECES = [
    "Wort", "wort", "z.B.", "u.a.", "usw.", "Dr.", "Nr.", "A.", "b.", "3.", "12.", "123.", "x", "é", "ß", "Ärger",
    ".", "..", "...", "!", "?", "?!", ")", "(", ".)", "-", ",", ";", ":", "#", "%", "€", "½", "_",
    " ", " ", " ", "  ", "\n", "\t", " ", " ", "\u001c", "❤️", "😀", "1️⃣", "ℹ️", "👍🏽",
    "&amp;", "&lt;", "&auml;", "&#8220;", "&#x2019;", "&bogus;", "&", "<b>", "</b>", "<p>", "</p>",
    "<!-- c -->", "<br>", "https://x.de/a", "www.y.org", "http://z.com/p?q=1",
]


def random_texts(n, seed=11):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(PIECES) for _ in range(rnd.randrange(0, 40))) for _ in range(n)]


def test_random_texts_match_python_model(spark):
    texts = random_texts(600)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: (r.c, r.s) for r in T.with_clean_text(df, "t", "c")
           .select("i", "c", T.split_sentences(F.col("c")).alias("s")).collect()}
    for i, t in enumerate(texts):
        want_c = pymodel.clean_text(t)
        assert got[i][0] == want_c, (t, got[i][0], want_c)
        assert got[i][1] == pymodel.split_sentences(want_c), (want_c, got[i][1])


def test_sentence_ids_stable_and_index_dense(spark):
    docs = C.texts(spark, SF001)
    a = explode_sentences(docs, text_col="text", already_clean=False)
    b = explode_sentences(docs.repartition(7), text_col="text", already_clean=False)
    assert a.select("id", "sentence").exceptAll(b.select("id", "sentence")).count() == 0
    assert a.select("id").distinct().count() == a.count()
    gaps = a.groupBy("text_id").agg((F.max("sentence_index") + 1 - F.count("*")).alias("g")).where("g != 0")
    assert gaps.count() == 0


def test_label_counts_add_up(spark):
    res = classify(explode_sentences(C.texts(spark, SF001), text_col="text", already_clean=False),
                   ClassifierConfig.fixture())
    st = classification_stats(res).first()
    assert st.pro + st.contra + st.neutral == st.total == st.rule_based_used + st.transformer_used
