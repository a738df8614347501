"""Cleaning and sentence splitting."""

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from stancekit.functions import text as T

import pymodel
from conftest import SF01


def clean_one(spark, value):
    df = spark.createDataFrame([(value,)], "t string")
    return df.select(T.clean_text(F.col("t")).alias("c")).first().c


# Cleaning edge rows. Row 1: the emoji library of the original removes an
# emoji before white space is collapsed, so "1️⃣ ❤️ é" leaves one blank.
EDGE_ROWS = [
    ("<p>Hallo</p><p>Welt &amp; Co</p> 50% <b>www.x.de/a?b</b> 1️⃣ ❤️ é „Zitat“ "
     "– a b\x1cc 4-Tage-Woche #NewWork (gut!) ½ €",
     "HalloWelt  Co 50 é Zitat  a b c 4-Tage-Woche NewWork (gut!) ½"),
    ("a # b", "a  b"),
    ("  x  ", "x"),
    ("", ""),
    (None, ""),
    ("siehe https://x.de/a).Weiter so", "siehe so"),
    ("Text mit ℹ️ Info", "Text mit Info"),
    ("<script>var a='<p>x</p>';</script><style>p{}</style>sichtbar<!-- weg -->", "sichtbar"),
    ("é decomposed", "e decomposed"),
    ("Zahl mit Leerraum", "Zahl mit Leerraum"),
]


@pytest.mark.parametrize("raw,expected", EDGE_ROWS)
def test_clean_edge_rows(spark, raw, expected):
    assert clean_one(spark, raw) == expected
    assert pymodel.clean_text(raw) == expected


def test_clean_matches_python_model_on_documents_and_pages(spark):
    docs = pq.read_table(f"{SF01}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    pages = pq.read_table(f"{SF01}/pages.parquet", columns=["page_id", "html"]).to_pylist()
    rows = [(r["text"],) for r in docs] + [(r["html"],) for r in pages]
    df = spark.createDataFrame(rows, "t string")
    got = [r.c for r in df.select(T.clean_text(F.col("t")).alias("c")).collect()]
    want = [pymodel.clean_text(t) for (t,) in rows]
    diffs = [i for i, (a, b) in enumerate(zip(got, want)) if a != b]
    assert not diffs, (diffs[:3], got[diffs[0]][:200] if diffs else None)


def test_only_allowed_characters_remain(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    bad = docs.select(T.clean_text(F.col("text")).alias("c")).where(
        F.col("c").rlike(r"[^\p{L}\p{N}_ .,!?:;\-()]") | F.col("c").rlike(r"^ | $"))
    assert bad.count() == 0


SPLIT_ROWS = [
    ("Das ist z.B. gut (wirklich.) Am 3. Mai. Und nun? Ja! Ende",
     ["Das ist z.B. gut (wirklich.)", "Am 3. Mai.", "Und nun?", "Ja!", "Ende"]),
    ("A. B. Müller kam. Dann ging er.", ["A. B. Müller kam.", "Dann ging er."]),
    ("Wir sahen u.a. Dr. Meier usw. und bzw. ca. drei.", ["Wir sahen u.a. Dr. Meier usw. und bzw. ca. drei."]),
    ("Es kostet 100. Danach nicht.", ["Es kostet 100.", "Danach nicht."]),
    ("Wirklich?! Ja... Gut.", ["Wirklich?!", "Ja...", "Gut."]),
    ("", []),
    ("ohne Punkt", ["ohne Punkt"]),
]


@pytest.mark.parametrize("text,expected", SPLIT_ROWS)
def test_split_rows(spark, text, expected):
    df = spark.createDataFrame([(text,)], "t string")
    got = df.select(T.split_sentences(F.col("t")).alias("s")).first().s
    assert got == expected
    assert pymodel.split_sentences(text) == expected


def test_split_matches_python_model(spark):
    docs = pq.read_table(f"{SF01}/documents.parquet", columns=["text"]).to_pylist()
    cleaned = [pymodel.clean_text(r["text"]) for r in docs]
    df = spark.createDataFrame([(c,) for c in cleaned], "t string")
    got = [r.s for r in df.select(T.split_sentences(F.col("t")).alias("s")).collect()]
    want = [pymodel.split_sentences(c) for c in cleaned]
    diffs = [i for i, (a, b) in enumerate(zip(got, want)) if a != b]
    assert not diffs, diffs[:3]


def test_split_uncleaned_input_trims_and_drops_blanks(spark):
    df = spark.createDataFrame([("  Eins.   Zwei!  ",)], "t string")
    got = df.select(T.split_sentences(F.col("t"), cleaned=False).alias("s")).first().s
    assert got == ["Eins.", "Zwei!"]


def test_entities_and_absolute_urls(spark):
    df = spark.createDataFrame([("&amp;lt;b&amp;gt; &quot;x&quot; &copy;", "/a", "https://h.de")],
                               "t string, href string, root string")
    r = df.select(T.strip_html(F.col("t")).alias("s"), T.url_absolutize(F.col("href"), F.col("root")).alias("u")).first()
    assert r.s == '&lt;b&gt; "x" ©'
    assert r.u == "https://h.de/a"


def test_references_decode_like_html_unescape(spark):
    import html

    rows = ["&amp;lt; &lt;b&gt; &quot;x&quot; &copy; &auml;&ouml; &#8220;q&#x201D; &#150; &#0; &#xD800; "
            "&bogus; & alone &#38;amp; &NotEqualTilde; &AMP; &#128512;", "plain", ""]
    df = spark.createDataFrame([(r,) for r in rows], "t string")
    got = [r.d for r in df.select(T.decode_entities(F.col("t")).alias("d")).collect()]
    assert got == [html.unescape(r) for r in rows]


def test_numeric_quotes_do_not_leave_digits(spark):
    assert clean_one(spark, "Er sagte &#8222;Hallo&#8220; &#x2013; gut.") == "Er sagte Hallo  gut."


def test_padded_references_and_enclosed_digits(spark):
    df = spark.createDataFrame([("&#00000065;&#x0000041;", "❶➊🄀")], "a string, b string")
    r = df.select(T.decode_entities(F.col("a")).alias("a"), T.strip_emoji(F.col("b")).alias("b")).first()
    assert (r.a, r.b) == ("AA", "❶➊🄀")
