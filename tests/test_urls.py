"""Url resolution and normal form: the RFC's examples, the standard library, and link following."""

from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from stancekit.functions import urls as U
from stancekit.sources import news

BASE = "http://a/b/c/d;p?q"
# RFC 3986, 5.4.1 and 5.4.2 (strict)
RFC = {"g:h": "g:h", "g": "http://a/b/c/g", "./g": "http://a/b/c/g", "g/": "http://a/b/c/g/", "/g": "http://a/g", "//g": "http://g",
       "?y": "http://a/b/c/d;p?y", "g?y": "http://a/b/c/g?y", "#s": "http://a/b/c/d;p?q", "g#s": "http://a/b/c/g", "g?y#s": "http://a/b/c/g?y",
       ";x": "http://a/b/c/;x", "g;x": "http://a/b/c/g;x", "g;x?y#s": "http://a/b/c/g;x?y", "": "http://a/b/c/d;p?q", ".": "http://a/b/c/",
       "./": "http://a/b/c/", "..": "http://a/b/", "../": "http://a/b/", "../g": "http://a/b/g", "../..": "http://a/", "../../": "http://a/",
       "../../g": "http://a/g", "../../../g": "http://a/g", "../../../../g": "http://a/g", "/./g": "http://a/g", "/../g": "http://a/g",
       "g.": "http://a/b/c/g.", ".g": "http://a/b/c/.g", "g..": "http://a/b/c/g..", "..g": "http://a/b/c/..g", "./../g": "http://a/b/g",
       "./g/.": "http://a/b/c/g/", "g/./h": "http://a/b/c/g/h", "g/../h": "http://a/b/c/h", "g;x=1/./y": "http://a/b/c/g;x=1/y",
       "g;x=1/../y": "http://a/b/c/y", "g//h": "http://a/b/c/g//h", "g?y/./x": "http://a/b/c/g?y/./x", "g?y/../x": "http://a/b/c/g?y/../x", "http:g": "http:g"}


def test_rfc_examples(spark):
    df = spark.createDataFrame([(BASE, r) for r in RFC], "base string, ref string")
    assert {r.ref: r.u for r in df.select("ref", U.resolve(F.col("base"), F.col("ref")).alias("u")).collect()} == RFC


def test_equals_standard_library(spark):
    bases = ["http://x.de", "http://x.de/", "https://x.de/a/b/", "http://x.de/a?q=/z/y", "http://x.de:81/a/b/c"]
    refs = ["a", "/a/../b/./c", "../../x/", "?n=2", "//y.de/p", "https://z.de/q/../r?s", "a/b/../../c", "ä/ö?ü", "mailto:x@y"]
    df = spark.createDataFrame([(b, r) for b in bases for r in refs], "base string, ref string")
    got = {(r.base, r.ref): r.u for r in df.select("base", "ref", U.resolve(F.col("base"), F.col("ref")).alias("u")).collect()}
    for (b, r), u in got.items():
        assert u == urljoin(b, r).replace("https://z.de/q/../r?s", "https://z.de/r?s"), (b, r)


@pytest.mark.parametrize("url, want", [
    ("HTTP://Ex.DE:80", "http://ex.de/"), ("https://ex.de:443/a/./b/../c#f", "https://ex.de/a/c"), ("http://ex.de:443/", "http://ex.de:443/"),
    ("http://ex.de:/x", "http://ex.de/x"), ("http://ex.de/%7euser/%c3%A4?a=%2f%", "http://ex.de/~user/%C3%A4?a=%2F%"), (None, None),
    ("http://ex.de/A", "http://ex.de/A"), ("http://ex.de?x", "http://ex.de/?x")])
def test_normal_form(spark, url, want):
    df = spark.createDataFrame([(url,)], "u string")
    once = df.select(U.normal_form(F.col("u")).alias("u"))
    assert once.first().u == want and once.select(U.normal_form(F.col("u"))).first()[0] == want


def test_search_scan_follows_links(spark):
    results = [("http://s.ex.de/search?page=1", "<article><a href='/a'>1</a><a href='HTTP://S.EX.DE:80/b#x'>2</a></article><a href='/no'>3</a>"),
               ("http://s.ex.de/search/more?page=2", "<article><a href='../c'>4</a><a href=/a>5</a><a>6</a></article>"),
               ("http://s.ex.de/search?page=3", "<article><a href=/late>7</a></article>"), ("http://other.de/?page=1", "<article><a href='http://s.ex.de/d'>8")]
    results += [("http://s.ex.de/search?page=1", "<article><a href=/a>again</a></article>")] * 50
    pages = [(f"http://s.ex.de/{x}", f"<h1>{x}</h1><article><p>text {x}</article>") for x in ("a", "b", "c", "d", "no", "late")] + [("http://s.ex.de/b", None)]
    df = lambda rows: spark.createDataFrame(rows, "url string, html string")
    got = sorted((r.source, r.title, r.text) for r in news.news_search_scan(df(pages), df(results), [("s", "ex.de")], 2).collect())
    assert got == [("s", x, f"text {x}") for x in "abc"]
    assert news.news_site_scan(df(pages), [("s", "ex.de")], 2, df(results)).count() == 3
    assert news.news_search_scan(df(pages), df(results).where("false"), [("s", "ex.de")], 2).collect() == []
