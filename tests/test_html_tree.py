"""Element tree: golden pages, and all test pages against a parser-driven model."""

from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from conftest import SF001
from stancekit.functions import html_tree as H


class Tree(HTMLParser):
    """Stack of open elements; an end tag closes up to its own start tag."""

    def __init__(self, html):
        super().__init__(convert_charrefs=True)
        self.stack, self.found, self.hidden = [], [], 0
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        node = {"name": tag, "attrs": dict(attrs), "text": "", "up": [n["name"] for n in self.stack]}
        self.found.append(node)
        if tag not in H.VOID:
            self.stack.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in H.VOID:
            self.stack.pop()

    def handle_endtag(self, tag):
        names = [n["name"] for n in self.stack]
        if tag in names:
            del self.stack[len(names) - 1 - names[::-1].index(tag):]

    def handle_data(self, data):
        if not any(n["name"] in ("script", "style", "template") for n in self.stack):
            for n in self.stack:
                n["text"] += data

    def select(self, outer, inner):
        return [n for n in self.found if n["name"] == inner and outer in n["up"]]


def model_article(html):
    tree = Tree(html)
    h1 = [n for n in tree.found if n["name"] == "h1"]
    time = [n for n in tree.found if n["name"] == "time"]
    return (h1[0]["text"].strip() if h1 else "No title", " ".join(n["text"].strip() for n in tree.select("article", "p")),
            time[0]["attrs"].get("datetime") if time else None)


GOLDEN = [
    "<article><p>eins</p><article><p>zwei</p></article><p>drei</p></article><p>vier</p>",
    "<article><p>a<p>b<p>c</article><p>d",
    "<article><div><p>a</div>b</p><p>c</p></article>",
    "<h1> T &amp; U<b>x</b> </h1><article></p><p>x<br>y<img src='a>b'>z</p></article>",
    "<article><p>a<!-- <p>no</p> --><script>'<p>no</p>'</script> b</p></article><time datetime='2024-01-02'>x</time>",
    "<ARTICLE class=a><P title=\"</p>\">A &lt; B</P></ARTICLE><time>x</time><time datetime=y></time>",
    "<article><p/>leer<p>3 < 4 & 5</p>", "<p>x</p>", "", "no tags", "</article><article><p>x</p></article></article><p>y</p>",
    "<article><ul><li><a href=/a>1</a><li><a>2</a><li><a HREF=\"http://x/b?c&amp;d\">3</a></ul></article><a href='/no'>4</a>",
]


@pytest.fixture(scope="module")
def golden(spark):
    return spark.createDataFrame([(f"https://s.de/{i}", h) for i, h in enumerate(GOLDEN)], "url string, html string")


def test_golden_articles(golden):
    got = {r.url: (r.title, r.text, r.date) for r in H.extract_articles_by_tree(golden, "x").collect()}
    assert got == {f"https://s.de/{i}": model_article(h) for i, h in enumerate(GOLDEN)}
    assert got["https://s.de/0"][1] == "eins zwei drei" and got["https://s.de/1"][1] == "abc bc c"


def test_golden_links(golden):
    got = [(r.page_url, r.link_index, r.link) for r in H.extract_links_by_tree(golden).orderBy("page_url", "link_index").collect()]
    assert got == [("https://s.de/11", 0, "https://s.de/a"), ("https://s.de/11", 1, "http://x/b?c&d")]


def test_ranges_and_depth(spark):
    df = spark.createDataFrame([("<a><b><a></b></a><b>",)], "html string")
    got = H.with_elements(df, ("a", "b")).first()["__elements"]
    assert [(e.name, e.start, e.end, e.depth) for e in got] == [("a", 0, 4, 0), ("b", 1, 3, 1), ("a", 2, 3, 2), ("b", 5, 6, 0)]


def test_all_pages_equal_the_model(spark):
    pages = spark.read.parquet(f"{SF001}/pages.parquet")
    got = {r.url: (r.title, r.text) for r in H.extract_articles_by_tree(pages, "x").collect()}
    assert got == {r.url: model_article(r.html)[:2] for r in pages.where(F.col("html").isNotNull()).collect()}


def test_missing_pages_and_long_ones(spark):
    long = "<article>" + "<p>absatz" * 400 + "</article>" + "x" * 200_000
    df = spark.createDataFrame([("u", None, "t"), ("v", long, "t"), ("v", long, "t")], "url string, html string, fetched string")
    rows = H.extract_articles_by_tree(df, "x", fetched_at_col="fetched").collect()
    assert [r.url for r in rows] == ["v", "v"] and {r.date for r in rows} == {"t"}
    assert rows[0].text.split(" ")[-1] == "absatz" and len(rows[0].text.split(" ")) == 400
    assert H.extract_links_by_tree(df.where("false")).collect() == []
