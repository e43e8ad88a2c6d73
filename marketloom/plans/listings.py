"""Queries over listing pages: the offers of a page, and what its prices belong to."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketloom.functions import urls
from marketloom.operators import listing
from marketloom.session import table

PER_PAGE = 40


def listing_pages(spark, sf):
    """Parts as listing pages (url, html) of forty, in eight kinds of markup.

    A heading beside the price, a link a level up, a link around both, a trash heading first, a price in an excluded
    box, two prices with headings of two classes and links of two kinds, a price too deep inside, a price in a script.
    """
    k, name = F.col("p_partkey").cast("string"), F.col("p_name")
    dong = lambda factor: F.concat(F.translate(F.format_number(F.floor(F.col("p_retailprice") * factor).cast("bigint"), 0), ",", "."), F.lit("đ"))
    now, before = dong(10_000), dong(12_000)
    kinds = [
        ('<div class="item"><h3 class="product-title">', name, '</h3><a href="/p/', k, '.html">xem</a><span class="price">', now, "</span></div>"),
        ('<div class="item"><a href="/p/', k, '.html" class="name">', name, '</a><div class="box"><p>', now, "</p></div></div>"),
        ('<a href="/p/', k, '.html"><h3>', name, "</h3><b>", now, "<del>", before, "</del></b></a>"),
        ('<div class="item"><h3>Giỏ hàng ', name, "</h3><h4>", name, "</h4><span>", now, "</span></div>"),
        ('<div class="item"><div class="cart"><span>', now, "</span></div><h3>", name, "</h3></div>"),
        ('<div class="item"><h3>', name, '</h3><h3 class="title">', name, ' deluxe</h3><span class="old-price">', before, "</span><span>", now, '</span><a href="#">x</a><a href="../p/', k, '.html">y</a></div>'),
        ('<div class="item"><div><div><div><div><div><span>', now, "</span></div></div></div></div></div><h3>", name, "</h3></div>"),
        ('<div class="item"><h3>', name, "</h3><script>productSaleSetup('a','b','c','d','", F.floor(F.col("p_retailprice") * 10_000).cast("string"), "')</script></div>"),
    ]
    item = F.coalesce(*[F.when(F.col("p_size") % 8 == v, F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])) for v, parts in enumerate(kinds)])
    page = F.floor(F.col("p_partkey") / PER_PAGE).cast("bigint")
    items = table(spark, sf, "part").where("p_size IS NOT NULL").select(page.alias("page"), F.struct("p_partkey", item.alias("item")).alias("i"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list("i")), lambda i: i["item"]), "")
    html = F.concat(F.lit('<html><body><div class="product-grid">'), F.col("body"), F.lit("</div></body></html>"))
    return items.groupBy("page").agg(body.alias("body")).select(F.concat(F.lit("https://shop.vn/c/"), F.col("page").cast("string")).alias("url"), html.alias("html"))


def listing_offers(spark, sf):
    return listing.offers(listing_pages(spark, sf)).select("url", "title", "link", "price_text", "price", "is_original")


def nearest_titles(spark, sf):
    """Each shown price of a listing page with its nearest title, the link as written, before one offer of a link is chosen."""
    found = listing.nearest(listing.elements(listing_pages(spark, sf)))
    return found.select("url", F.col("position.entry").cast("bigint").alias("entry"), "title", "price_text", "href", "is_original")


QUERIES = {f.__name__: f for f in (listing_offers, nearest_titles)}

_VOID = "area|base|br|col|embed|hr|img|input|link|meta|source|track|wbr"


def _labels(doc: str) -> str:
    """Interval labels by SQL: tags in a row, a running sum for the depth, the next end tag of a depth for the end."""
    return f"""tok AS (SELECT url, unnest(regexp_extract_all(html, '<[^>]+>|[^<]+')) AS t, generate_subscripts(regexp_extract_all(html, '<[^>]+>|[^<]+'), 1) AS pos FROM {doc}),
ev AS (SELECT *, regexp_matches(t, '^<[a-zA-Z]') AS is_open, regexp_matches(t, '^<({_VOID})\\b|^<[a-zA-Z][^>]*/>$') AS is_void, t LIKE '</%' AS is_close FROM tok),
lv AS (SELECT *, sum(is_open::INT) OVER w AS e, sum((is_open AND NOT is_void)::INT - is_close::INT) OVER w AS level FROM ev WINDOW w AS (PARTITION BY url ORDER BY pos)),
opens AS (SELECT url, pos, e AS entry, level + is_void::INT AS depth, is_void, lower(regexp_extract(t, '^<([a-zA-Z0-9]+)', 1)) AS tag, regexp_extract(t, 'class="([^"]*)"', 1) AS cls, regexp_extract(t, 'href="([^"]*)"', 1) AS href FROM lv WHERE is_open),
closes AS (SELECT url, pos, e, level + 1 AS depth FROM lv WHERE is_close),
el AS (SELECT o.*, CASE WHEN is_void THEN o.pos ELSE c.pos END AS end_pos, CASE WHEN is_void THEN o.entry ELSE c.e END AS exit
  FROM opens o ASOF LEFT JOIN closes c ON o.url = c.url AND o.depth = c.depth AND o.pos < c.pos)"""


def _listed(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


_DOC = f"""item AS (SELECT p_partkey AS k, p_partkey // {PER_PAGE} AS page, p_size % 8 AS v, p_name AS n, floor(p_retailprice * 10000)::BIGINT AS raw,
  replace(format('{{:,}}', floor(p_retailprice * 10000)::BIGINT), ',', '.') || 'đ' AS now, replace(format('{{:,}}', floor(p_retailprice * 12000)::BIGINT), ',', '.') || 'đ' AS old FROM part WHERE p_size IS NOT NULL),
doc AS (SELECT 'https://shop.vn/c/' || page AS url, '<html><body><div class="product-grid">' || string_agg(CASE v
  WHEN 0 THEN '<div class="item"><h3 class="product-title">' || n || '</h3><a href="/p/' || k || '.html">xem</a><span class="price">' || now || '</span></div>'
  WHEN 1 THEN '<div class="item"><a href="/p/' || k || '.html" class="name">' || n || '</a><div class="box"><p>' || now || '</p></div></div>'
  WHEN 2 THEN '<a href="/p/' || k || '.html"><h3>' || n || '</h3><b>' || now || '<del>' || old || '</del></b></a>'
  WHEN 3 THEN '<div class="item"><h3>Giỏ hàng ' || n || '</h3><h4>' || n || '</h4><span>' || now || '</span></div>'
  WHEN 4 THEN '<div class="item"><div class="cart"><span>' || now || '</span></div><h3>' || n || '</h3></div>'
  WHEN 5 THEN '<div class="item"><h3>' || n || '</h3><h3 class="title">' || n || ' deluxe</h3><span class="old-price">' || old || '</span><span>' || now || '</span><a href="#">x</a><a href="../p/' || k || '.html">y</a></div>'
  WHEN 6 THEN '<div class="item"><div><div><div><div><div><span>' || now || '</span></div></div></div></div></div><h3>' || n || '</h3></div>'
  ELSE '<div class="item"><h3>' || n || '</h3><script>productSaleSetup(''a'',''b'',''c'',''d'',''' || raw || ''')</script></div>' END, '' ORDER BY k) || '</div></body></html>' AS html FROM item GROUP BY page)"""
_SHAPED = r"regexp_full_match({0}, '[0-9]{{1,3}}([.][0-9]{{3}})+ ?[đ₫]')"
_NEAREST = f"""{_DOC}, {_labels("doc")},
txt AS (SELECT el.url, el.entry, string_agg(lv.t, '' ORDER BY lv.pos) AS text,
    string_agg(lv.t, '' ORDER BY lv.pos) FILTER (NOT EXISTS (SELECT 1 FROM el s WHERE s.url = el.url AND s.entry > el.entry AND s.pos < lv.pos AND lv.pos < s.end_pos AND (s.tag IN ('del', 's') OR list_has_any(string_split(s.cls, ' '), ['line', 'old', 'del'])))) AS clear
  FROM el JOIN lv ON lv.url = el.url AND lv.pos > el.pos AND lv.pos < el.end_pos AND lv.t NOT LIKE '<%' WHERE el.tag NOT IN ('html', 'body') AND el.cls <> 'product-grid' GROUP BY 1, 2),
n AS (SELECT el.*, tag = 'script' AS scripted, CASE WHEN tag <> 'script' THEN text END AS text, CASE WHEN tag = 'script' THEN replace(format('{{:,}}', regexp_extract(text, '([0-9]+)', 1)::BIGINT), ',', '.') || ' ₫' ELSE clear END AS price_text,
    tag IN ('del', 's') OR regexp_matches(cls, 'line|old|del') AS is_original FROM el LEFT JOIN txt USING (url, entry)),
p AS (SELECT * FROM n WHERE {_SHAPED.format("price_text")} AND NOT EXISTS (SELECT 1 FROM n c WHERE c.url = n.url AND c.entry > n.entry AND c.entry <= n.exit AND c.depth = n.depth + 1 AND {_SHAPED.format("c.text")} AND NOT c.is_original)),
h AS (SELECT url, entry, depth, CASE WHEN regexp_matches(lower(cls), 'title|name') THEN 0 ELSE 1 END AS named, text FROM n WHERE tag IN ('h1', 'h2', 'h3', 'h4', 'h5', 'h6', 'a') AND length(text) BETWEEN 8 AND 149 AND NOT {_SHAPED.format("text")}
  AND len(list_filter({_listed(listing.TRASH)}, lambda w: contains(lower(text), w))) = 0),
up AS (SELECT p.url, p.entry AS price, p.depth AS pd, a.entry, a.exit, p.depth - a.depth AS step,
    a.tag IN {urls.LAYOUT_TAGS} OR len(list_filter({_listed(urls.EXCLUDED_PARTS)}, lambda w: contains(lower(a.cls), w))) > 0
    OR (NOT regexp_matches(lower(a.cls), 'item|col-') AND len(list_filter({_listed(urls.LAYOUT_PARTS)}, lambda w: contains(lower(a.cls), w))) > 0) AS stop
  FROM p JOIN el a ON a.url = p.url AND a.entry < p.entry AND a.exit >= p.entry),
sc AS (SELECT * FROM up WHERE step <= 5 AND NOT EXISTS (SELECT 1 FROM up b WHERE b.url = up.url AND b.price = up.price AND b.stop AND b.step <= up.step)),
far AS (SELECT sc.url, sc.price, sc.step, x.entry AS e, x.kind, x.named, x.val, sc.pd + x.depth - 2 * (SELECT max(depth) FROM el c WHERE c.url = sc.url AND c.entry <= least(sc.price, x.entry) AND c.exit >= greatest(sc.price, x.entry)) AS away
  FROM sc JOIN (SELECT url, entry, depth, 'title' AS kind, named, text AS val FROM h UNION ALL SELECT url, entry, depth, 'link', 0, href FROM el WHERE tag = 'a' AND length(href) > 2 AND NOT regexp_matches(href, '^(#|javascript:)')) x
    ON x.url = sc.url AND x.entry > sc.entry AND x.entry <= sc.exit),
best AS (SELECT * FROM far WHERE kind = 'title' QUALIFY row_number() OVER (PARTITION BY url, price ORDER BY step, away, named, e) = 1),
lk AS (SELECT f.url, f.price, f.val AS href FROM far f JOIN best b ON b.url = f.url AND b.price = f.price AND b.step = f.step WHERE f.kind = 'link' QUALIFY row_number() OVER (PARTITION BY f.url, f.price ORDER BY f.away, f.e) = 1),
own AS (SELECT b.url, b.price, a.href FROM best b JOIN el t ON t.url = b.url AND t.entry = b.e JOIN el a ON a.url = b.url AND a.tag = 'a' AND a.entry <= t.entry AND a.exit >= t.entry AND t.depth - a.depth < 3 QUALIFY row_number() OVER (PARTITION BY b.url, b.price ORDER BY a.depth DESC) = 1),
o AS (SELECT b.url, b.price AS entry, b.val AS title, p.price_text, coalesce(nullif(own.href, ''), lk.href) AS href, p.scripted, NOT p.scripted AND p.is_original AS is_original
  FROM best b JOIN p ON p.url = b.url AND p.entry = b.price LEFT JOIN own ON own.url = b.url AND own.price = b.price LEFT JOIN lk ON lk.url = b.url AND lk.price = b.price)"""
ORACLES = {
    "nearest_titles": f"WITH {_NEAREST} SELECT url, entry::BIGINT AS entry, title, price_text, href, is_original FROM o",
    "listing_offers": f"""WITH {_NEAREST},
r AS (SELECT *, regexp_replace(price_text, '[^0-9]', '', 'g')::BIGINT AS price, 'https://shop.vn' || regexp_replace(href, '^[.][.]', '') AS link FROM o)
SELECT url, title, link, price_text, price, is_original FROM r
QUALIFY row_number() OVER (PARTITION BY url, coalesce(link, title) ORDER BY is_original, CASE WHEN is_original THEN 0 ELSE price END, NOT scripted, entry) = 1""",
}
