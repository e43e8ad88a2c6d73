"""Queries over captured pages: titles, links, page verification and the price cascade."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketloom.functions import urls
from marketloom.operators import html
from marketloom.session import spread, table


def page_titles(spark, sf):
    pages = table(spark, sf, "pages")
    return pages.select("page_id", F.regexp_extract("html", "(?is)<title[^>]*>(.*?)</title>", 1).alias("title"), F.size(F.regexp_extract_all("html", F.lit("(?is)<h1[^>]*>(.*?)</h1>"), F.lit(1))).cast("bigint").alias("n_h1"))


def page_links(spark, sf):
    hrefs = table(spark, sf, "pages").select("url", F.explode(F.regexp_extract_all("html", F.lit(r'href="([^"]+)"'), F.lit(1))).alias("href"))
    return hrefs.groupBy("href").agg(F.count("*").alias("n"))


def shop_pages(spark, sf):
    """Parts as shop pages: the same price shown by six kinds of markup, beside an old price that must not be taken."""
    k, price = F.col("p_partkey"), F.floor(F.col("p_retailprice") * 10_000).cast("bigint")
    dong = lambda c: F.concat(F.translate(F.format_number(c, 0), ",", "."), F.lit("đ"))
    named = F.when(k % 7 == 0, F.lit("DI-9999999")).otherwise(F.concat(F.lit("DI-"), (k + 1000).cast("string")))
    shown = F.when(k % 5 == 0, F.concat(F.lit('<span class="current-price">'), dong(F.col("price")), F.lit("</span>")))
    shown = shown.when(k % 5 == 1, F.concat(F.lit('<script type="application/ld+json">{"@type":"Product","name":"Kocher '), F.col("named"), F.lit('","offers":{"@type":"Offer","priceCurrency":"VND","price":'), F.col("price").cast("string"), F.lit("}}</script>")))
    shown = shown.when(k % 5 == 2, F.concat(F.lit('<b itemprop="price" content="'), F.col("price").cast("string"), F.lit('">x</b>')))
    shown = shown.when(k % 5 == 3, F.concat(F.lit("<p>"), dong(F.col("price")), F.lit("</p>"))).otherwise(F.concat(F.lit('<ins><span class="amount">'), dong(F.col("price")), F.lit("</span></ins>")))
    body = F.concat(F.lit("<html><head><title>Bep Kocher "), F.col("named"), F.lit('</title></head><body><div class="product-detail"><h1>Kocher '), F.col("named"), F.lit("</h1><del>"), dong(F.col("price") + 1_000_000), F.lit("</del>"), shown, F.lit("</div></body></html>"))
    rows = spread(table(spark, sf, "part")).withColumn("price", price).withColumn("named", named)
    return rows.select("p_partkey", F.concat(F.lit("https://shop.vn/p/"), k.cast("string")).alias("url"), body.alias("html"), F.concat(F.lit("DI-"), (k + 1000).cast("string")).alias("model"), F.lit("Kocher").alias("brand"), (F.col("price") * 1.2).alias("reference"))


def page_verify(spark, sf):
    rows = shop_pages(spark, sf)
    checked = rows.drop("html").join(html.extract(rows), "url")
    return checked.select("p_partkey", html.verify(F.col("titles"), F.lit("https://shop.vn/"), F.col("model"), F.col("brand")).alias("reject_reason"))


def price_cascade(spark, sf):
    rows = shop_pages(spark, sf)
    return html.page_prices(rows.drop("html"), html.extract(rows)).select("p_partkey", "price")


def cached_page_price(spark, sf):
    """Prices of verified pages, a third of them known from the price cache; a page that is about another model takes none."""
    rows = shop_pages(spark, sf)
    known = rows.where("p_partkey % 3 = 0").select("url", (F.col("reference") / 2).cast("bigint").alias("price"))
    return html.page_prices(rows.drop("html"), html.extract(rows, settled=known), known).select("p_partkey", "price", "reject_reason")


def captured_titles(spark, sf):
    """Captured pages that the parser read and the price candidates it found on them, counted by site."""
    found = html.extract(table(spark, sf, "pages"))
    return found.groupBy(urls.host(F.col("url")).alias("host")).agg(F.count("*").alias("pages"), F.sum(F.size("candidates")).alias("price_candidates"))


QUERIES = {f.__name__: f for f in (page_titles, page_links, page_verify, price_cascade, cached_page_price, captured_titles)}
ORACLES = {
    "page_titles": "SELECT page_id, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS title, len(regexp_extract_all(html, '(?is)<h1[^>]*>(.*?)</h1>')) AS n_h1 FROM pages",
    "page_links": """SELECT href, count(*) AS n FROM (SELECT unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS href FROM pages) GROUP BY 1""",
    "page_verify": "SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN 'Only brand matched, model missing' END AS reject_reason FROM part",
    "price_cascade": "SELECT p_partkey, CASE WHEN p_partkey % 7 <> 0 THEN floor(p_retailprice * 10000)::BIGINT END AS price FROM part",
    "cached_page_price": """WITH p AS (SELECT p_partkey, floor(p_retailprice * 10000)::BIGINT AS price FROM part)
SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN NULL WHEN p_partkey % 3 = 0 THEN floor(price * 1.2::DOUBLE / 2)::BIGINT ELSE price END AS price,
       CASE WHEN p_partkey % 7 = 0 THEN 'Only brand matched, model missing' END AS reject_reason FROM p""",
}
