"""Captured search pages and sitemaps as tables of candidate links."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.functions import text, urls
from marketloom.functions.base import any_contained, let
from marketloom.operators.html import parse

ENGINES = ("google", "bing", "ddg", "coccoc")
#: Minutes for which an engine that refuses is left alone, and sub-sitemaps read for a site.
BLOCK_MINUTES, SUB_SITEMAPS = 10, 5
#: Pages asked of each engine for a keyword, links of a page under which it is the last, detail links that are enough, and words of a refusal.
PAGES, FEW_LINKS, ENOUGH_DETAIL = {"google": 2, "bing": 2, "ddg": 1, "coccoc": 1}, 5, 5
REFUSALS = {"google": ("google.com/recaptcha", "detected unusual traffic"), "bing": ("detected unusual traffic",)}


class _Hrefs(HTMLParser):
    """The targets of all links in document order, without a tree of elements."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found: list[str] = []

    def handle_starttag(self, tag, attrs):
        if tag == "a":
            target = dict(attrs)
            if "href" in target:
                self.found.append(target["href"] or "")


def _links(engine: str, html: str) -> list[str]:
    """Links of a search page in the order in which they count."""
    if engine not in ("bing", "ddg"):
        reader = _Hrefs()
        reader.feed(html)
        reader.close()
        return reader.found
    nodes = list(parse(html).walk())
    hrefs = lambda test: [n.attrs["href"] for n in nodes if n.tag == "a" and "href" in n.attrs and test(n)]
    if engine == "bing":
        cited = [n.text().strip().split(" ")[0] for n in nodes if n.tag == "cite"]
        cited = [c if c.startswith("http") else f"https://{c}" for c in cited if c]
        inside = lambda n: any(a.tag == "h2" for a in n.ancestors()) and any(a.fits(".b_algo") for a in n.ancestors())
        return cited + hrefs(inside)
    shown = [n.text().strip() for n in nodes if n.fits(".result__url")]
    return [s if s.startswith("http") else f"https://{s}" for s in shown if s] + hrefs(lambda n: n.fits(".result__a"))


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [_links(e, h or "") for e, h in zip(batch.column("engine").to_pylist(), batch.column("html").to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column("engine"), batch.column("keyword"), pa.array(found, pa.list_(pa.string()))], ["engine", "keyword", "links"])


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kept = ["brand", "model", "keyword", "engine", "page", "refused"]
    for batch in batches:
        found = [_links(e, h or "") for e, h in zip(batch.column("engine").to_pylist(), batch.column("html").to_pylist())]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(found, pa.list_(pa.string()))], [*kept, "links"])


def results(pages: DataFrame) -> DataFrame:
    """(engine, keyword, position, url) of captured search pages (engine, keyword, html); each link of a page once."""
    links = pages.select("engine", "keyword", "html").mapInArrow(_parsed, "engine string, keyword string, links array<string>")
    each = links.select("engine", "keyword", F.posexplode("links").alias("position", "href"))
    found = each.withColumn("url", _target(F.col("engine"), F.col("href"))).where("url is not null")
    return found.groupBy("engine", "keyword", "url").agg(F.min("position").alias("position")).select("engine", "keyword", "position", "url")


def _target(engine: Column, href: Column) -> Column:
    """Where a link of a search page leads; NULL for one that leads nowhere outside."""
    asked = F.try_url_decode(F.regexp_extract(href, "[?&]uddg=([^&]+)", 1))
    return F.when((engine == "ddg") & href.contains("uddg="), asked).otherwise(urls.normalize_href(href))


def _judged_pages(pages: DataFrame) -> DataFrame:
    """As ``read_pages``, each link with the judgement whether it is a detail link: links are structs (position, url, detail)."""
    keys = ["brand", "model", "keyword", "engine"]
    refused = F.lit(False)
    for engine, words in REFUSALS.items():
        refused = refused | ((F.col("engine") == engine) & any_contained(F.coalesce("html", F.lit("")), words))
    limit = F.element_at(F.create_map(*[F.lit(x) for kv in PAGES.items() for x in kv]), F.col("engine"))
    # pages that nobody asks for are left out before they are parsed; one that refuses is not searched for links
    asked = pages.where(F.col("page") <= limit).select(*keys, "page", refused.alias("refused"), "html").withColumn("html", F.when(~F.col("refused"), F.col("html")))
    parsed = asked.mapInArrow(_numbered, "brand string, model string, keyword string, engine string, page int, refused boolean, links array<string>")
    taken = F.filter(F.transform("links", lambda h: _target(F.col("engine"), h)), lambda u: u.startswith("http"))
    each = parsed.select(*keys, "page", "refused", F.posexplode_outer(taken).alias("position", "url"))
    judged = each.withColumn("detail", F.col("url").isNotNull() & urls.is_detail_url(F.col("url"), F.col("model"), F.col("brand")))
    shown = F.array_sort(F.collect_list(F.when(F.col("url").isNotNull(), F.struct("position", "url", "detail"))))  # the links of one page
    counted = judged.groupBy(*keys, "page", "refused").agg(shown.alias("links"), F.count_if("detail").alias("n_detail"))
    before = Window.partitionBy(*keys).orderBy("page").rowsBetween(Window.unboundedPreceding, -1)  # two pages at most
    enough = F.coalesce(F.sum("n_detail").over(before), F.lit(0)) >= ENOUGH_DETAIL
    ended = F.coalesce(F.max(F.col("refused") | (F.size("links") < FEW_LINKS)).over(before), F.lit(False))
    return counted.withColumn("read", ~enough & ~ended)


def read_pages(pages: DataFrame) -> DataFrame:
    """What is taken of each captured search page (brand, model, keyword, engine, page from 1, html): read, refused, links, n_detail.

    Pages are asked for in order, as many as ``PAGES`` allows. One is not read any more once those before it hold
    enough detail links (repeated ones count), or if one before it refused or had few links. A page that refuses gives
    no links. Links are in the order in which they count, repeated ones included.
    """
    none = F.array().cast("array<string>")
    links, n_detail = F.when(F.col("read"), F.col("links.url")).otherwise(none), F.when(F.col("read"), F.col("n_detail")).otherwise(0)
    return _judged_pages(pages).select("brand", "model", "keyword", "engine", "page", "read", "refused", links.alias("links"), n_detail.alias("n_detail"))


def progressive_links(requests: DataFrame, pages: DataFrame) -> DataFrame:
    """(brand, model, url, keyword_no, engine): each product's links in the keyword that first showed them, up to where the search stops.

    ``requests``: brand, model, keyword, keyword_no (from 0, in step order). A keyword is searched while the keywords
    before it have shown fewer than five distinct detail links; a link counts where it appears first.
    """
    product = ["brand", "model"]
    found = _judged_pages(pages).where("read").join(requests, [*product, "keyword"])
    each = found.select(*product, "keyword_no", "engine", F.explode("links").alias("l")).select(*product, "keyword_no", "engine", "l.url", "l.detail")
    first = each.groupBy(*product, "url").agg(F.min(F.struct("keyword_no", "engine")).alias("at"), F.first("detail").alias("detail")).select(*product, "url", "at.*", "detail")  # judged by product and URL alone
    detail = first.where("detail").groupBy(*product, "keyword_no").agg(F.count("*").alias("n_new"))
    # a product has a few dozen keywords, so these groups are small
    before = Window.partitionBy(*product).orderBy("keyword_no").rowsBetween(Window.unboundedPreceding, -1)
    counted = requests.join(detail, [*product, "keyword_no"], "left").withColumn("before", F.coalesce(F.sum("n_new").over(before), F.lit(0)))
    return first.join(counted.where(F.col("before") < ENOUGH_DETAIL).select(*product, "keyword_no"), [*product, "keyword_no"]).select(*product, "url", "keyword_no", "engine")


def blocked(log: DataFrame, now_ms: Column) -> DataFrame:
    """Engines that refused (status 403, 429 or a captcha) within the last ten minutes. ``log``: engine, status, captcha, at_ms."""
    refused = F.col("status").isin(403, 429) | F.col("captcha")
    last = log.where(refused).groupBy("engine").agg(F.max("at_ms").alias("at_ms"))
    return last.where(F.col("at_ms") + BLOCK_MINUTES * 60_000 > now_ms).select("engine")


def sitemap_links(sitemaps: DataFrame, products: DataFrame) -> DataFrame:
    """(url, model, brand): links of sitemaps (site, document) that look like pages of the site's wanted products (site, model, brand).

    Of an index, the first five parts whose names speak of products are read, if they were captured (as site = their URL).
    """
    loc = lambda c: F.regexp_extract_all(c, F.lit(r"<(?:loc|link)>\s*([^<\s]+)\s*</(?:loc|link)>"), F.lit(1))
    long_enough = sitemaps.where(F.length("document") >= 100)
    parts = long_enough.where(F.col("document").contains("<sitemap>")).select("site", F.posexplode(loc(F.col("document"))).alias("pos", "part")).where(F.col("part").rlike("product|san-pham|post"))
    first = parts.withColumn("n", F.row_number().over(Window.partitionBy("site").orderBy("pos"))).where(F.col("n") <= SUB_SITEMAPS)
    nested = first.join(long_enough.select(F.col("site").alias("part"), "document"), "part").select("site", "document")
    pages = long_enough.where(~F.col("document").contains("<sitemap>")).select("site", "document").unionByName(nested)
    links = pages.select("site", F.explode(loc(F.col("document"))).alias("url")).where(F.col("url").startswith("http")).distinct()

    def named(u: Column, m: Column) -> Column:
        digits = F.regexp_replace(m, "[^0-9]", "")
        return ((m != "") & u.contains(m)) | ((F.length(digits) >= 4) & u.contains(digits))

    met = links.join(products, "site")
    about = let(text.normalize_model(F.col("url")), lambda u: let(text.normalize_model(F.col("model")), lambda m: named(u, m)))
    return met.where(about & urls.is_detail_url(F.col("url"), F.col("model"), F.col("brand"))).select("url", "model", "brand")
