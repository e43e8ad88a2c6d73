"""Links of captured pages: anchors as the parser sees them, and those that lead to categories of a page's own site."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.functions import urls
from marketloom.functions.base import any_contained
from marketloom.operators.html import parse

#: Fixed value: category links kept of a page.
MOST_LINKS = 150


def _anchors(keys: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    kind = pa.list_(pa.struct([("href", pa.string()), ("text", pa.string())]))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[{"href": n.attrs["href"].strip(), "text": n.text()} for n in parse(h or "").walk() if n.tag == "a" and "href" in n.attrs] for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), pa.array(found, kind)], [*keys, "anchors"])

    return read


def _page_keys(keys: Sequence[str]) -> list[str]:
    return list(dict.fromkeys([*keys, "url"]))


def anchors(pages: DataFrame, keys: Sequence[str] = ("url",)) -> DataFrame:
    """(keys, url, position, href, text) of each link of each page (keys, url, html), in document order; ``keys`` tell pages of one URL apart."""
    by = _page_keys(keys)
    kinds = ", ".join(f"{k} {pages.schema[k].dataType.simpleString()}" for k in by)
    found = pages.select(*by, "html").mapInArrow(_anchors(by), f"{kinds}, anchors array<struct<href:string,text:string>>")
    return found.select(*by, F.posexplode("anchors").alias("position", "a")).select(*by, "position", "a.href", "a.text")


def _heads(path: Column) -> Column:
    """The beginnings of a path before each of its hyphens, and those of what stands after an empty segment."""
    cut = lambda p: F.transform(F.sequence(F.lit(1), F.greatest(F.size(F.split(p, "-")) - 1, F.lit(1))), lambda n: F.array_join(F.slice(F.split(p, "-"), F.lit(1), n), "-"))
    parts = F.split(path, "//")
    tails = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.concat(F.when(k > 1, "/").otherwise(""), F.array_join(F.slice(parts, k, F.size(parts)), "//")))
    return F.array_distinct(F.flatten(F.transform(F.filter(tails, lambda t: t.contains("-")), cut)))


def category_links(pages: DataFrame, keys: Sequence[str] = ("url",)) -> DataFrame:
    """(keys, url, link, position, has_parent): each page's distinct links to its own site that name a category in text or path.

    Not the homepage and none of the excluded paths; without query. A link has a parent if another one's path, without
    ``.html``, is its own up to a hyphen: the beginnings of its path are looked up among the page's paths.
    """
    by = _page_keys(keys)
    found = anchors(pages, keys).where(~F.col("href").startswith("#") & ~F.lower("href").startswith("javascript:"))
    full = found.withColumn("target", urls.absolute(F.col("url"), F.col("href")))
    name = lambda c: F.lower(F.regexp_extract(c, "^https?://([^/?#:]*)", 1))
    path = F.lower(F.regexp_extract("target", "^https?://[^/?#]*([^?#]*)", 1))
    own = (name("target") != "") & (name("target") == name("url"))
    kept = full.where(own & urls.matches_category(F.col("text"), path) & ~path.isin(*urls.HOME_PATHS) & ~any_contained(path, urls.CATEGORY_EXCLUSIONS))
    links = kept.select(*by, F.regexp_extract("target", "^[^?#]*", 0).alias("link"), "position").groupBy(*by, "link").agg(F.min("position").alias("position"))
    plain = links.withColumn("path", F.lower(F.replace(F.regexp_extract("link", "^https?://[^/?#]*(.*)$", 1), F.lit(".html"), F.lit(""))))
    heads = plain.select(*by, "link", F.explode(_heads(F.col("path"))).alias("path"))
    parents = heads.join(plain.select(*by, "path").distinct(), [*by, "path"], "left_semi").select(*by, "link").distinct()
    return links.join(parents.withColumn("has_parent", F.lit(True)), [*by, "link"], "left").select(*by, "link", "position", F.coalesce("has_parent", F.lit(False)).alias("has_parent"))


def category_pages(pages: DataFrame, keys: Sequence[str] = ("url",)) -> DataFrame:
    """(keys, url, link): the category links of each page that have no parent, the first ``MOST_LINKS`` in document order."""
    by = _page_keys(keys)
    by_place = Window.partitionBy(*by).orderBy("position", "link")
    return category_links(pages, keys).where(~F.col("has_parent")).withColumn("n", F.row_number().over(by_place)).where(F.col("n") <= MOST_LINKS).select(*by, "link")
