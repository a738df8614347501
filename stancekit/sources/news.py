"""News extraction from landed HTML pages.

The collector fetched pages one by one over HTTP; here the pages are
already landed as a table ``(url, html, ...)`` and extraction is a single
projection over it. Markup is handled with fixed regular expressions (no
DOM), see the README for the approximations.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stancekit.functions.html_tree import attribute, extract_articles_by_tree, inside, with_elements
from stancekit.functions.text import WS, decode_entities, strip_tags, url_absolutize
from stancekit.functions.urls import normal_form, resolve


def py_strip(c: Column) -> Column:
    """Trim all (Unicode) white space at both ends, like ``str.strip()``."""
    return F.regexp_replace(c, f"^{WS}+|{WS}+$", "")


def element_text(fragment: Column) -> Column:
    """Visible text of an HTML fragment, stripped."""
    return py_strip(decode_entities(strip_tags(fragment)))


def article_html(html: Column) -> Column:
    """Inner HTML of all ``<article>`` elements ('' when absent)."""
    return F.array_join(articles_html(html), "\n")


def articles_html(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r"(?is)<article\b[^>]*>(.*?)</article\s*>"), F.lit(1))


def article_title(html: Column) -> Column:
    """Text of the first ``<h1>``, or ``'No title'`` when there is none."""
    h1 = F.regexp_extract(html, r"(?is)<h1\b[^>]*>(.*?)</h1\s*>", 1)
    return F.when(html.rlike(r"(?i)<h1[\s>]"), element_text(h1)).otherwise(F.lit("No title"))


def article_text(html: Column) -> Column:
    """Paragraph texts of all articles of the page, each stripped, joined by one blank.

    Each ``<p>`` start tag opens a paragraph that ends at ``</p>`` or at the
    next ``<p>``; an unclosed paragraph therefore contributes its own text
    once.
    """
    pieces = F.flatten(F.transform(articles_html(html), lambda a: F.slice(
        F.split(F.regexp_replace(a, r"(?i)<p(?:\s[^>]*)?>", "\u0001"), "\u0001"), 2, 1 << 30)))
    texts = F.transform(pieces, lambda x: element_text(F.get(F.split(x, r"(?i)</p\s*>"), 0)))
    return F.array_join(texts, " ")


def article_date(html: Column, fallback: Column | None = None) -> Column:
    """``datetime`` attribute of the first ``<time>`` element; pages without
    one get ``fallback`` (the fetch time when the landed table has it)."""
    attrs = F.regexp_extract(html, r"(?is)<time(\s[^>]*)?>", 1)
    value = F.regexp_extract(attrs, r"""(?i)\bdatetime\s*=\s*["']([^"']*)["']""", 1)
    has_time = html.rlike(r"(?i)<time[\s>]")
    has_attr = attrs.rlike(r"(?i)\bdatetime\s*=")
    fb = fallback if fallback is not None else F.lit(None).cast("string")
    return F.when(has_time, F.when(has_attr, value)).otherwise(fb)


def article_id(url: Column) -> Column:
    """Stable article id from the url (the same in every run)."""
    return F.sha2(url, 256)


def url_root(url: Column) -> Column:
    return F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]+)", 1)


def url_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#:@]+)", 1))


def url_page_no(url: Column) -> Column:
    """Result-page number from a ``page=`` query parameter (default 1)."""
    digits = F.regexp_extract(url, r"[?&]page=([0-9]+)", 1)
    beyond = F.when(digits != "", F.lit((1 << 63) - 1)).otherwise(F.lit(1))
    return F.coalesce(digits.try_cast("long"), beyond)


def extract_articles(pages: DataFrame, source: Column | str, url_col: str = "url", html_col: str = "html",
                     fetched_at_col: str | None = None) -> DataFrame:
    """``id, source, url, title, text, date`` for every landed page;
    pages without html (failed fetches) are dropped."""
    html, url = F.col(html_col), F.col(url_col)
    src = F.lit(source) if isinstance(source, str) else source
    fb = F.col(fetched_at_col).cast("string") if fetched_at_col else None
    return pages.where(html.isNotNull()).select(
        article_id(url).alias("id"),
        src.alias("source"),
        url.alias("url"),
        article_title(html).alias("title"),
        article_text(html).alias("text"),
        article_date(html, fb).alias("date"),
    )


def extract_links(pages: DataFrame, scope: str = "article", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(page_url, link_index, link)`` for every ``<a href>`` inside the
    article (``scope='article'``) or anywhere in the page (``'page'``);
    relative links are prefixed with the page's site root."""
    html = F.col(html_col)
    region = article_html(html) if scope == "article" else html
    tag = r"""(?is)<a\s(?:[^>]*?\s)?href\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    tags = F.regexp_extract_all(region, F.lit(tag), F.lit(0))
    hrefs = F.transform(tags, lambda x: F.concat(*[F.regexp_extract(x, tag, i) for i in (1, 2, 3)]))
    hrefs = F.transform(hrefs, lambda x: F.when(x.contains("&"), decode_entities(x)).otherwise(x))
    return pages.select(
        F.col(url_col).alias("page_url"), url_root(F.col(url_col)).alias("_root"),
        F.posexplode(hrefs).alias("link_index", "href"),
    ).select("page_url", "link_index", url_absolutize(F.col("href"), F.col("_root")).alias("link"))


def _site_match(host: Column, suffix: str) -> Column:
    suffix = suffix.lower()
    return (host == suffix) | host.endswith("." + suffix)


def site_pages(pages: DataFrame, sites: Sequence[tuple[str, str]], max_pages: int, url_col: str = "url") -> DataFrame:
    """Pages of the configured sites on result pages ``<= max_pages``, tagged
    with ``site``. One scan for all sites; a page matching several site
    suffixes is returned once per site (each site is scanned on its own)."""
    host = url_host(F.col(url_col))
    tags = F.array(*[F.when(_site_match(host, suffix), F.lit(name)) for name, suffix in sites])
    tagged = pages.where(url_page_no(F.col(url_col)) <= max_pages).withColumn("site", F.explode(tags))
    return tagged.where(F.col("site").isNotNull())


def news_site_scan(pages: DataFrame, sites: Sequence[tuple[str, str]], max_pages: int = 5,
                   result_pages: DataFrame | None = None, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Articles of every configured site, concatenated.

    Without ``result_pages`` the landed pages are the fetched articles
    themselves. With ``result_pages`` (landed search-result pages), only
    pages linked from a site's result pages are extracted (``news_search_scan``).
    """
    if result_pages is not None:
        return news_search_scan(pages, result_pages, sites, max_pages, url_col, html_col)
    return extract_articles(site_pages(pages, sites, max_pages, url_col), F.col("site"), url_col, html_col)


def search_links(result_pages: DataFrame, sites: Sequence[tuple[str, str]], max_pages: int, url_col: str = "url",
                 html_col: str = "html") -> DataFrame:
    """``site, link``: what the result pages of each site link to from inside an
    ``article``, resolved against the page and in normal form, each once."""
    found = with_elements(site_pages(result_pages, sites, max_pages, url_col), ("article", "a"), html_col)
    anchors = F.transform(inside(F.col("__elements"), "article", "a"), lambda a: attribute(F.get("__tokens", a["start"]), "href"))
    rows = found.select("site", F.col(url_col).alias("base"), F.explode_outer(F.array_distinct(anchors)).alias("href"))
    rows = rows.where(F.col("href").isNotNull()).select("site", resolve(F.col("base"), F.col("href")).alias("link"))
    # Keys that cannot be null: else the join's null test would parse every url once more.
    return rows.select("site", F.coalesce(normal_form(F.col("link")), F.lit("no link")).alias("link")).distinct()


def news_search_scan(pages: DataFrame, result_pages: DataFrame, sites: Sequence[tuple[str, str]], max_pages: int = 5,
                     url_col: str = "url", html_col: str = "html") -> DataFrame:
    """S3 by links: the articles that result pages of a site lead to.

    Links are made distinct before the join (on the map side first), so a url
    that very many result pages link to is one row in it; pages are matched by
    the normal form of their urls. A page that several sites lead to comes once
    a site; of landed pages with one normal form each comes; pages without html
    give nothing.
    """
    links = search_links(result_pages, sites, max_pages, url_col, html_col)
    keyed = pages.where(F.col(html_col).isNotNull()).withColumn("__link", F.coalesce(normal_form(F.col(url_col)), F.lit("no url")))
    chosen = keyed.join(links, F.col("__link") == F.col("link")).drop("__link", "link")
    return extract_articles_by_tree(chosen, F.col("site"), url_col, html_col)
