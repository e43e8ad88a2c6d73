"""Queries over captured search pages: which pages are read, and where a search stops."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketloom.session import spread, table
from marketloom.sources import search


def _pages(spark, sf):
    """Line items as links of search pages: a part is searched by three keywords (return flags) at four engines, up to three pages each.

    A part's pages of one engine and keyword hold its line items by quantity; those with a discount lead to a
    collection and are no detail links. Where the order's number ends in 7 on a first page of the second engine, it refuses.
    """
    n, k = F.col("l_linenumber"), F.col("l_partkey").cast("string")
    engine = F.when(n <= 4, "google").when(n == 5, "bing").when(n == 6, "ddg").otherwise("coccoc")
    page = F.when(F.col("l_quantity") <= 20, 1).when(F.col("l_quantity") <= 45, 2).otherwise(3)
    tail = F.concat(F.lit("-di-"), (F.col("l_partkey") + 1000).cast("string"), F.lit("-"), F.col("l_suppkey").cast("string"))
    url = F.when(F.col("l_discount") >= 0.07, F.concat(F.lit("https://shop.vn/collections/x"), tail)).otherwise(F.concat(F.lit("https://shop.vn/san-pham/bep"), tail))
    link = F.when(engine == "ddg", F.concat(F.lit('<a class="result__a" href="'), url, F.lit('">x</a>')))
    link = link.when(engine == "bing", F.concat(F.lit('<div id="b_results"><li class="b_algo"><h2><a href="'), url, F.lit('">x</a></h2></li></div>'))).otherwise(F.concat(F.lit('<a href="'), url, F.lit('">x</a>')))
    refusal = F.when((engine == "bing") & (F.col("l_orderkey") % 10 == 7), "detected unusual traffic").otherwise("")
    rows = table(spark, sf, "lineitem").select(k.alias("part"), engine.alias("engine"), page.alias("page"), F.col("l_returnflag").alias("keyword"), F.struct("l_orderkey", "l_linenumber", F.concat(link, refusal).alias("a")).alias("a"))
    html = F.array_join(F.transform(F.array_sort(F.collect_list("a")), lambda a: a["a"]), "")  # one part's links of one page
    grouped = rows.groupBy("part", "keyword", "engine", "page").agg(html.alias("html"))
    model = F.concat(F.lit("DI-"), (F.col("part").cast("bigint") + 1000).cast("string"))
    return spread(grouped.select(F.col("part").alias("brand"), model.alias("model"), "keyword", "engine", "page", F.concat(F.lit("<html><body>"), "html", F.lit("</body></html>")).alias("html")))


def search_page_stops(spark, sf):
    """Every captured page within its engine's number of pages: whether it is read, and what it gives."""
    found = search.read_pages(_pages(spark, sf))
    return found.select("model", "keyword", "engine", "page", "read", "refused", F.size("links").cast("bigint").alias("n_links"), F.col("n_detail").cast("bigint").alias("n_detail"))


def progressive_links(spark, sf):
    """Links of each part, in the keyword that first shows them, until five distinct detail links are there."""
    parts = table(spark, sf, "lineitem").select("l_partkey").distinct()
    brand, model = F.col("l_partkey").cast("string"), F.concat(F.lit("DI-"), (F.col("l_partkey") + 1000).cast("string"))
    requests = parts.select(brand.alias("brand"), model.alias("model"), F.posexplode(F.array(F.lit("N"), F.lit("A"), F.lit("R"))).alias("keyword_no", "keyword"))
    return search.progressive_links(requests, _pages(spark, sf)).select("model", "url", "keyword_no", "engine")


QUERIES = {f.__name__: f for f in (search_page_stops, progressive_links)}
_LIMITS = ", ".join(f"('{e}', {n})" for e, n in search.PAGES.items())
_READ = f"""l AS (SELECT l_partkey, 'DI-' || (l_partkey + 1000) AS model, l_returnflag AS keyword, CASE WHEN l_linenumber <= 4 THEN 'google' WHEN l_linenumber = 5 THEN 'bing' WHEN l_linenumber = 6 THEN 'ddg' ELSE 'coccoc' END AS engine,
  CASE WHEN l_quantity <= 20 THEN 1 WHEN l_quantity <= 45 THEN 2 ELSE 3 END AS page, l_discount < 0.07 AS detail, l_linenumber = 5 AND l_orderkey % 10 = 7 AS refuses,
  'https://shop.vn/' || CASE WHEN l_discount >= 0.07 THEN 'collections/x' ELSE 'san-pham/bep' END || '-di-' || (l_partkey + 1000) || '-' || l_suppkey AS url FROM lineitem),
g AS (SELECT model, keyword, engine, page, bool_or(refuses) AS refused, count(*) FILTER (TRUE) AS links, count(*) FILTER (detail) AS details FROM l GROUP BY ALL),
c AS (SELECT g.* REPLACE (CASE WHEN refused THEN 0 ELSE links END AS links, CASE WHEN refused THEN 0 ELSE details END AS details) FROM g JOIN (VALUES {_LIMITS}) m(engine, most) ON g.engine = m.engine AND page <= most),
r AS (SELECT *, NOT EXISTS (SELECT 1 FROM c b WHERE b.model = c.model AND b.keyword = c.keyword AND b.engine = c.engine AND b.page < c.page AND (b.refused OR b.links < {search.FEW_LINKS}))
  AND coalesce((SELECT sum(details) FROM c b WHERE b.model = c.model AND b.keyword = c.keyword AND b.engine = c.engine AND b.page < c.page), 0) < {search.ENOUGH_DETAIL} AS read FROM c)"""
ORACLES = {
    "search_page_stops": f"WITH {_READ} SELECT model, keyword, engine, page, read, refused, CASE WHEN read THEN links ELSE 0 END AS n_links, CASE WHEN read THEN details ELSE 0 END AS n_detail FROM r",
    "progressive_links": f"""WITH {_READ}, f AS (SELECT model, url, any_value(detail) AS detail, min((CASE keyword WHEN 'N' THEN 0 WHEN 'A' THEN 1 ELSE 2 END, engine)) AS spot FROM l JOIN r USING (model, keyword, engine, page) WHERE read AND NOT refused GROUP BY 1, 2),
k AS (SELECT model, spot[1] AS keyword_no, spot[2] AS engine, url, detail FROM f)
SELECT model, url, keyword_no, engine FROM k WHERE (SELECT count(*) FROM k b WHERE b.model = k.model AND b.detail AND b.keyword_no < k.keyword_no) < {search.ENOUGH_DETAIL}""",
}
