"""S1 / S2 / T1 on an element tree: which elements lie inside which others.

A page is cut into tokens (tags, comments, text). One fold over its tags keeps
the stack of open elements and gives each element the range of tokens it
covers: an end tag closes the innermost open element of its name and all that
is open inside that; an end tag that fits nothing is ignored; what is still
open at the end covers the rest. An element lies inside another if its range
does, so ``article p`` is a test of ranges, and text is a slice of tokens.

Everything is a Column expression; pages are never moved between tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stancekit.functions.text import WS, decode_entities, url_absolutize

# Elements that HTML never closes.
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")

_QUOTED = """[^>"']*+(?:"[^"]*"[^>"']*+|'[^']*'[^>"']*+)*+"""
TOKEN = rf"(?is)<!--.*?-->|<(?:script|style|template)\b[^>]*>.*?</(?:script|style|template)\s*>|</?[a-z]{_QUOTED}>|<[!?][^>]*>|[^<]+|<"
RAW = r"(?i)^<(?:script|style|template)\b"

ELEMENT = "array<struct<name:string,start:int,end:int,depth:int>>"
STACK = "array<struct<name:string,start:int>>"


def page_tokens(html: Column) -> Column:
    """Tags, comments and stretches of text, in order; nothing is left out."""
    return F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(TOKEN), F.lit(0))


def _tag_name(token: Column) -> Column:
    """Lower-case name of a start or end tag, '' for any other token."""
    return F.when(token.rlike(RAW), "").otherwise(F.lower(F.regexp_extract(token, r"^</?([a-zA-Z][^\s/>]*)", 1)))


def tags(tokens: Column) -> Column:
    """``array<struct<at, name, kind>>`` of start (``open``), end (``close``) and
    childless (``void``) tags."""
    def tag(t: Column, i: Column) -> Column:
        name = _tag_name(t)
        kind = F.when(t.startswith("</"), "close").when(name.isin(*VOID) | t.endswith("/>"), "void").otherwise("open")
        return F.struct(i.cast("int").alias("at"), name.alias("name"), kind.alias("kind"))

    return F.filter(F.transform(tokens, tag), lambda x: x["name"] != "")


def elements(tag_list: Column, n_tokens: Column, names: Sequence[str]) -> Column:
    """Elements of the given names by start: name, first and last token (the last
    is its end tag, or what closed it) and depth."""
    def closed(stack: Column, end: Column, below: Column) -> Column:
        """Elements of a part of the stack, that all end here; ``below`` is how many lie under it."""
        ranges = F.transform(stack, lambda s, k: F.struct(
            s["name"].alias("name"), s["start"].alias("start"), end.alias("end"), (below + k).cast("int").alias("depth")))
        return F.filter(ranges, lambda r: r["name"].isin(*names))

    def step(state: Column, tag: Column) -> Column:
        stack, found = state["stack"], state["found"]
        own = F.struct(tag["name"].alias("name"), tag["at"].alias("start"))
        up = F.array_position(F.reverse(F.transform(stack, lambda s: s["name"])), tag["name"]).cast("int")
        left = F.size(stack) - up
        childless = F.filter(F.array(F.struct(tag["name"].alias("name"), tag["at"].alias("start"), tag["at"].alias("end"),
                                              F.size(stack).alias("depth"))), lambda r: r["name"].isin(*names))
        opens, closes = tag["kind"] == "open", (tag["kind"] == "close") & (up > 0)
        return F.struct(
            F.when(opens, F.concat(stack, F.array(own))).when(closes, F.slice(stack, F.lit(1), left)).otherwise(stack).alias("stack"),
            F.when(closes, F.concat(found, closed(F.slice(stack, left + 1, up), tag["at"], left)))
            .when(tag["kind"] == "void", F.concat(found, childless)).otherwise(found).alias("found"))

    start = F.struct(F.array().cast(STACK).alias("stack"), F.array().cast(ELEMENT).alias("found"))
    end = n_tokens.cast("int")
    all_found = F.aggregate(tag_list, start, step, lambda s: F.concat(s["found"], closed(s["stack"], end, F.lit(0))))
    return F.array_sort(all_found, lambda a, b: a["start"] - b["start"])


def inside(element_list: Column, outer: str, inner: str) -> Column:
    """Elements ``inner`` that lie inside some element ``outer``, in document order."""
    outers = F.filter(element_list, lambda e: e["name"] == outer)
    return F.filter(element_list, lambda e: (e["name"] == inner) & F.exists(
        outers, lambda o: (o["start"] < e["start"]) & (e["start"] < o["end"])))


def token_texts(tokens: Column) -> Column:
    """What each token adds to the text: nothing for markup."""
    markup = lambda t: t.startswith("<") & (t != "<")
    return F.transform(tokens, lambda t: F.when(markup(t), "").when(t.contains("&"), decode_entities(t)).otherwise(t))


def element_text(texts: Column, element: Column) -> Column:
    """All text inside an element, without separators."""
    size = F.greatest(element["end"] - element["start"] - 1, F.lit(0))
    return F.array_join(F.slice(texts, element["start"] + 2, size), "")


def _stripped(c: Column) -> Column:
    return F.regexp_replace(c, f"^{WS}+|{WS}+$", "")


def attribute(token: Column, name: str) -> Column:
    """Value of a tag's attribute, decoded; null if it has none."""
    pattern = rf"""(?is)\s{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    value = F.concat(*[F.regexp_extract(token, pattern, i) for i in (1, 2, 3)])
    return F.when(token.rlike(pattern), F.when(value.contains("&"), decode_entities(value)).otherwise(value))


def with_elements(pages: DataFrame, names: Sequence[str], html_col: str = "html") -> DataFrame:
    """``pages`` with ``__tokens`` and ``__elements``, one projection a step so that
    each is computed once."""
    out = pages.withColumn("__tokens", page_tokens(F.col(html_col)))
    out = out.withColumn("__tags", tags(F.col("__tokens")))
    return out.withColumn("__elements", elements(F.col("__tags"), F.size("__tokens"), names)).drop("__tags")


def extract_articles_by_tree(pages: DataFrame, source: Column | str, url_col: str = "url", html_col: str = "html",
                             fetched_at_col: str | None = None) -> DataFrame:
    """S1 on the tree: ``id, source, url, title, text, date``.

    ``text`` joins the stripped text of every ``p`` inside an ``article``: a paragraph that
    is not closed holds the ones after it, whose text then comes again with
    each of them. ``title`` is the first ``h1``; ``date`` the ``datetime`` of the first ``time``
    element (null if that has none), without such an element ``fetched_at_col``. Pages without html give no row; a page without
    paragraphs has an empty text.
    """
    src = F.lit(source) if isinstance(source, str) else source
    fetched = F.col(fetched_at_col).cast("string") if fetched_at_col else F.lit(None).cast("string")
    rows = with_elements(pages.where(F.col(html_col).isNotNull()), ("article", "p", "h1", "time"), html_col)
    rows = rows.withColumn("__texts", token_texts(F.col("__tokens")))
    rows = rows.withColumn("__paragraphs", inside(F.col("__elements"), "article", "p"))
    first = lambda name: F.get(F.filter("__elements", lambda e: e["name"] == name), F.lit(0))
    rows = rows.withColumns({"__h1": first("h1"), "__time": first("time")})
    texts = F.col("__texts")
    title = F.when(F.col("__h1").isNull(), "No title").otherwise(_stripped(element_text(texts, F.col("__h1"))))
    date = F.when(F.col("__time").isNull(), fetched).otherwise(attribute(F.get("__tokens", F.col("__time.start")), "datetime"))
    text = F.array_join(F.transform("__paragraphs", lambda p: _stripped(element_text(texts, p))), " ")
    return rows.select(F.sha2(F.col(url_col), 256).alias("id"), src.alias("source"), F.col(url_col).alias("url"),
                       title.alias("title"), text.alias("text"), date.alias("date"))


def extract_links_by_tree(pages: DataFrame, outer: str = "article", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """S2 on the tree: ``page_url, link_index, link`` for every ``a`` with ``href`` inside an
    element ``outer``, in document order; links that do not begin with ``http``
    follow the page's site root."""
    rows = with_elements(pages, (outer, "a"), html_col).withColumn("__anchors", inside(F.col("__elements"), outer, "a"))
    hrefs = F.filter(F.transform("__anchors", lambda a: attribute(F.get("__tokens", a["start"]), "href")), lambda h: h.isNotNull())
    root = F.regexp_extract(F.col(url_col), r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]+)", 1)
    out = rows.select(F.col(url_col).alias("page_url"), root.alias("root"), F.posexplode_outer(hrefs).alias("link_index", "href"))
    return out.where(F.col("href").isNotNull()).select("page_url", "link_index", url_absolutize(F.col("href"), F.col("root")).alias("link"))
