"""Queries of the scalar function libraries: money, text, models and URLs, over columns of the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.functions import matching, money, text, urls
from marketloom.operators import model_join, relational
from marketloom.session import spread, table

_ACCENTS = "translate(strip_accents(lower({0})), 'đ', 'd')"


def _dong(column: str) -> Column:
    """A whole number of dong in Vietnamese notation: points between thousands and the sign."""
    return F.concat(F.translate(F.format_number(F.col(column), 0), ",", "."), F.lit("₫"))


def price_parse_plain(spark, sf):
    v = F.floor(F.col("p_retailprice") * 10_000).cast("bigint")
    df = table(spark, sf, "part").select("p_partkey", v.alias("v"))
    return df.select("p_partkey", money.parse_price_text(_dong("v")).alias("price"))


def price_parse_million(spark, sf):
    v = F.floor(F.col("o_totalprice") / 100).cast("bigint")
    df = table(spark, sf, "orders").select("o_orderkey", F.concat(F.floor(v / 100).cast("string"), F.lit("."), F.lpad((v % 100).cast("string"), 2, "0"), F.lit(" tr")).alias("t"))
    return df.select("o_orderkey", money.parse_price_text(F.col("t")).alias("price"))


def price_parse_thousand(spark, sf):
    df = table(spark, sf, "part").select("p_partkey", F.concat(F.floor("p_retailprice").cast("string"), F.lit("k")).alias("t"))
    return df.select("p_partkey", money.parse_price_text(F.col("t")).alias("price"))


def price_parse_reject(spark, sf):
    k = F.col("o_orderkey")
    written = F.when(k % 4 == 0, F.lit("Liên hệ")).when(k % 4 == 1, F.concat(F.lit("0"), (900_000_000 + k).cast("string"))).when(k % 4 == 2, F.concat(F.lit("hz "), k.cast("string"), F.lit("₫"))).otherwise(F.concat((k + 100_000).cast("string"), F.lit(" đ")))
    return table(spark, sf, "orders").select("o_orderkey", money.parse_price_text(written).alias("price"))


def price_shape_check(spark, sf):
    k = F.col("p_partkey")
    written = F.when(k % 3 == 0, _dong("v")).when(k % 3 == 1, F.concat(F.col("v").cast("string"), F.lit(".5"))).otherwise(F.col("p_name"))
    df = table(spark, sf, "part").withColumn("v", F.floor(F.col("p_retailprice") * 10_000).cast("bigint"))
    return df.select("p_partkey", money.is_price_shaped(written).alias("is_price"))


def price_range_filter(spark, sf):
    price, reference = F.bround(F.col("l_extendedprice") * 1000).cast("bigint"), F.bround(F.col("o_totalprice") * 300).cast("bigint")
    joined = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = joined.select("l_orderkey", "l_linenumber", "l_partkey", price.alias("price"), reference.alias("reference"))
    return rows.where(money.is_plausible(F.col("price"), F.col("reference"), F.lit(""))).select("l_orderkey", "l_linenumber", "l_partkey", "price")


def fake_price_filter(spark, sf):
    price = (F.col("p_partkey") * 7 + 1_234_567).cast("bigint")
    model = F.concat(F.lit("M-"), F.col("p_size").cast("string"), F.lit("4"), (F.col("p_partkey") % 10).cast("string"))
    return table(spark, sf, "part").select("p_partkey", money.is_fake_price(price, model).alias("is_fake"))


def normalize_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.normalize_text(F.col("text")).alias("normalized"))


_MODEL = "concat(upper(substr(p_type, 1, 2)), '-', CAST(p_partkey + 100 AS {s}), CASE WHEN p_size % 3 = 0 THEN ' Pro' WHEN p_size % 3 = 1 THEN '+ ' ELSE concat(' ', CAST(p_size * 10 AS {s}), 'mm') END)"
_SQL_MODEL = _MODEL.format(s="VARCHAR")


def _models(spark, sf) -> DataFrame:
    return table(spark, sf, "part").withColumn("model", F.expr(_MODEL.format(s="STRING")))


_SQL_NORM_MODEL = """concat(upper(substr(p_type, 1, 2)), CAST(p_partkey + 100 AS VARCHAR),
  CASE WHEN p_size % 3 = 0 THEN 'PRO' WHEN p_size % 3 = 1 THEN 'PLUS' ELSE CAST(p_size AS VARCHAR) END)"""


def normalize_model(spark, sf):
    return _models(spark, sf).select("p_partkey", text.normalize_model(F.col("model")).alias("normalized"))


def clean_model_specs(spark, sf):
    k = F.col("p_partkey")
    tail = F.when(k % 4 == 0, F.lit(" Đen-70cm")).when(k % 4 == 1, F.lit(" (Trắng)")).when(k % 4 == 2, F.lit(" New Black")).otherwise(F.lit(" Pro"))
    return table(spark, sf, "part").select("p_partkey", text.clean_model_specs(F.concat(F.lit("K-"), k.cast("string"), F.lit("I"), tail)).alias("cleaned"))


def clean_title(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.clean_title(F.col("text")).alias("cleaned"))


def model_variants(spark, sf):
    return _models(spark, sf).select("p_partkey", F.explode(text.model_variants(F.col("model"))).alias("variant"))


def mask_value(spark, sf):
    return table(spark, sf, "supplier").select("s_suppkey", text.mask_secret(F.when(F.col("s_suppkey") % 5 == 0, F.substring("s_name", 1, 8)).otherwise(F.col("s_name"))).alias("masked"))


def row_selection(spark, sf):
    k = F.col("p_partkey")
    spec = F.when(k % 10 == 9, F.lit("x-1")).otherwise(F.concat((k % 50).cast("string"), F.lit(", "), F.col("p_size").cast("string"), F.lit("-"), (k % 7 + 3).cast("string")))
    return table(spark, sf, "part").select("p_partkey", F.explode(text.parse_row_selection(spec)).alias("row_number"))


def token_explode(spark, sf):
    tokens = table(spark, sf, "pages").select("page_id", F.explode(matching.text_tokens(F.col("url"))).alias("token"))
    return tokens.groupBy("token").agg(F.count("*").alias("n"))


def model_split(spark, sf):
    parts = matching.split_model(F.col("model"))
    return _models(spark, sf).select("p_partkey", parts.alias("m")).select("p_partkey", F.col("m.prefix").alias("prefix"), F.col("m.digits").alias("digits"), F.col("m.suffix").alias("suffix"))


def _titles(spark, sf) -> DataFrame:
    """Suppliers as products (model SU-<key>), and titles that name the model, another prefix or an extended model."""
    k = (F.col("s_suppkey") + 100).cast("string")
    title = F.when(F.col("s_suppkey") % 4 == 0, F.concat(F.lit("Bep Kocher SU-"), k)).when(F.col("s_suppkey") % 4 == 1, F.concat(F.lit("Bep Kocher EI-"), k))
    title = title.when(F.col("s_suppkey") % 4 == 2, F.concat(F.lit("Bep Kocher SU-"), k, F.lit(" Pro Plus"))).otherwise(F.concat(F.lit("Bep Kocher SU-9"), k))
    return table(spark, sf, "supplier").select("s_suppkey", F.concat(F.lit("SU-"), k).alias("model"), title.alias("title"))


def prefix_conflict(spark, sf):
    return _titles(spark, sf).select("s_suppkey", matching.prefix_conflict(F.col("title"), F.col("model"), F.lit("Kocher")).alias("conflict"))


def suffix_conflict(spark, sf):
    return _titles(spark, sf).select("s_suppkey", matching.suffix_conflict(F.col("title"), F.col("model"), F.lit("Kocher")).alias("conflict"))


def model_match(spark, sf):
    return _titles(spark, sf).select("s_suppkey", matching.model_match(F.col("title"), F.col("model"), F.lit("Kocher")).alias("matched"))


def model_theta_join(spark, sf):
    """Titles met with models through the rarest key of each form of a model, so that the match rules run on few pairs."""
    rows = _titles(spark, sf)
    titles, models = rows.select(F.col("s_suppkey").alias("text_id"), F.col("title").alias("text")), rows.select(F.col("s_suppkey").alias("model_id"), "model")
    return model_join.model_join(titles, models).select(F.col("text_id").alias("s_suppkey"), F.col("model_id").alias("model_key"))


def model_from_title(spark, sf):
    title = F.concat(F.col("p_name"), F.lit(" "), F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("sms"), F.col("p_partkey").cast("string"), F.lit("x e-1"))).otherwise(F.concat(F.lit("q-"), F.col("p_partkey").cast("string"))))
    return table(spark, sf, "part").select("p_partkey", text.model_from_title(title).alias("model"))


def brand_detect(spark, sf):
    vendor = F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).otherwise(F.lit(" "))
    title = F.concat(F.col("p_name"), F.when(F.col("p_size") % 3 == 0, F.lit(" KOCHER Bosch")).otherwise(F.lit("")))
    return table(spark, sf, "part").select("p_partkey", text.detect_brand(vendor, title).alias("brand"))


def url_host_counts(spark, sf):
    return table(spark, sf, "pages").groupBy(urls.host(F.col("url")).alias("host")).agg(F.count("*").alias("n"))


def homepage_flag(spark, sf):
    url = F.when(F.col("page_id") % 3 == 0, F.regexp_replace("url", r"^(https?://[^/?#]+).*$", "$1/index.html")).otherwise(F.col("url"))
    return table(spark, sf, "pages").select("page_id", urls.is_homepage(url).alias("is_home"))


def _product_urls(spark, sf) -> DataFrame:
    k = F.col("p_partkey")
    slug = F.concat(F.replace(F.col("p_name"), F.lit(" "), F.lit("-")), F.lit("-di-"), (k + 1000).cast("string"), F.when(F.col("p_size") % 5 == 0, F.lit("-plus")).otherwise(F.lit("")))
    url = F.when(k % 4 == 0, F.concat(F.lit("https://shop.vn/san-pham/"), slug)).when(k % 4 == 1, F.concat(F.lit("https://www.nguyenkim.com/"), slug, F.lit(".html")))
    url = url.when(k % 4 == 2, F.concat(F.lit("https://shop.vn/collections/"), slug)).otherwise(F.concat(F.lit("https://google.com/search?q="), slug))
    return spread(table(spark, sf, "part")).select("p_partkey", "p_brand", "p_size", url.alias("url"), F.concat(F.lit("DI-"), (k + 1000).cast("string")).alias("model"))


def detail_url_filter(spark, sf):
    return _product_urls(spark, sf).where(urls.is_detail_url(F.col("url"), F.col("model"), F.lit("Kocher"))).select("p_partkey", "url")


def relevance_score(spark, sf):
    return _product_urls(spark, sf).select("p_partkey", urls.relevance_score(F.col("url"), F.col("model"), F.lit("Kocher")).alias("score"))


def bing_decode(spark, sf):
    coded = F.regexp_replace(F.translate(F.base64(F.col("url").cast("binary")), "+/", "-_"), "[=\r\n]", "")
    return table(spark, sf, "pages").select("page_id", urls.decode_bing(F.concat(F.lit("https://www.bing.com/ck/a?u=a1"), coded, F.lit("&p=1"))).alias("target"))


def topk_candidates(spark, sf):
    scored = _product_urls(spark, sf).select("p_brand", "url", urls.relevance_score(F.col("url"), F.col("model"), F.lit("Kocher")).alias("score"))
    return relational.top_k(scored, ["p_brand"], [F.desc("score"), F.col("url")], 50).select("p_brand", "rank", "url", "score")


def keyword_expand(spark, sf):
    sheet = F.when(F.col("p_size") % 2 == 0, F.lit("08.Giặt sấy")).otherwise(F.lit("Tivi"))
    model = F.concat(F.lit("QA"), F.col("p_partkey").cast("string"), F.when(F.col("p_size") % 3 == 0, F.lit("Ab")).otherwise(F.lit("-7")))
    brand = F.when(F.col("p_size") % 5 == 0, F.lit("Bosch")).otherwise(F.col("p_brand"))
    return table(spark, sf, "part").select("p_partkey", F.explode(text.keywords(brand, model, sheet)).alias("keyword"))


def search_href(spark, sf):
    """Targets of links as a search page writes them: redirects, plain links, and links of its own."""
    k = F.col("page_id") % 3
    href = F.when(k == 0, F.concat(F.lit("/url?sa=t&q="), F.url_encode("url"), F.lit("&ved=1"))).when(k == 1, F.col("url")).otherwise(F.lit("/search?q=x"))
    return table(spark, sf, "pages").select("page_id", urls.normalize_href(href).alias("target"))


def category_flag(spark, sf):
    """Links that name a product category in their text or path."""
    k = F.col("p_partkey") % 3
    label = F.when(k == 0, F.concat(F.lit("Xem Quạt "), F.col("p_name"))).otherwise(F.col("p_name"))
    path = F.when(k == 1, F.lit("/may-giat/9")).otherwise(F.lit("/p/9"))
    return table(spark, sf, "part").select("p_partkey", urls.matches_category(label, path).alias("is_category"))


def absolute_href(spark, sf):
    """Links as written on a page, seen from the page's own URL: of another site, from the root, beside it, with dots, a query or a place alone."""
    k = F.col("page_id") % 8
    hrefs = ["//cdn.vn/x.html", "/gia/tot", "trang.html", "https://khac.vn/y", "../../a/./b/../c.html?x=../y", "..", "?trang=2", "#dau"]
    href = F.element_at(F.array(*map(F.lit, hrefs)), (k + 1).cast("int"))
    return table(spark, sf, "pages").select("page_id", urls.absolute(F.col("url"), href).alias("target"))


def entity_decode(spark, sf):
    """Part names inside escaped text, one entity escaped twice and one that is not among the five."""
    escaped = F.concat(F.lit("&amp;lt;b&gt; "), F.col("p_name"), F.lit(" &quot;"), F.col("p_brand"), F.lit("&quot; &#39;"), F.col("p_type"), F.lit("&#39; &amp;amp; &nbsp;"))
    return table(spark, sf, "part").select("p_partkey", text.decode_entities(escaped).alias("decoded"))


def sheet_name_list(spark, sf):
    """Names of tabs as typed: blanks around them, empty ones, and repeats."""
    typed = F.concat(F.lit(" "), F.col("p_brand"), F.lit(" ,, "), F.col("p_type"), F.lit(","), F.col("p_brand"), F.lit(", "), F.when(F.col("p_size") % 3 == 0, F.col("p_type")).otherwise(F.col("p_name")), F.lit(" , "))
    return table(spark, sf, "part").select("p_partkey", F.array_join(text.selected_sheet_names(typed), "|").alias("names"))


def _stock(spark, sf) -> DataFrame:
    """Parts as variants of a shop's catalogue: SKUs and barcodes of many kinds, titles with and without a model code."""
    k, size = F.col("p_partkey"), F.col("p_size")
    sku = F.when(size % 4 == 0, F.concat(F.lit(" SK"), k.cast("string"), F.lit(" "))).when(size % 4 == 1, k.cast("string")).when(size % 4 == 2, F.col("p_brand"))
    barcode = F.when(size % 3 == 0, F.concat(F.lit("B"), k.cast("string"))).when(size % 3 == 1, F.lit("a1")).otherwise(F.lit(""))
    code = F.when(k % 4 == 0, F.concat(F.lit("EH-DIH"), k.cast("string"), F.lit(" "))).when(k % 4 == 1, F.concat(F.lit("x-"), k.cast("string"), F.lit(" kv-77 "))).otherwise(F.lit(""))
    title = F.concat(F.lit("Bếp từ "), F.lower("p_brand"), F.lit(" [mới] "), code, F.col("p_name"), F.lit(" (hộp)|máy ĐÔI"))
    return table(spark, sf, "part").select("p_partkey", "p_brand", sku.alias("sku"), barcode.alias("barcode"), title.alias("title"))


def real_model(spark, sf):
    return _stock(spark, sf).select("p_partkey", text.is_real_model(F.col("sku")).alias("sku_is_model"), text.is_real_model(F.col("barcode")).alias("barcode_is_model"))


def commercial_name(spark, sf):
    return _stock(spark, sf).select("p_partkey", text.commercial_name(F.col("title"), F.col("p_brand")).alias("name"))


def variant_model(spark, sf):
    """The model of a variant: SKU, barcode, code in the title, or commercial name."""
    return _stock(spark, sf).select("p_partkey", text.extract_model(F.col("sku"), F.col("barcode"), F.col("title"), F.col("p_brand")).alias("model"))


def sheet_price(spark, sf):
    """Order totals as typed into a sheet in four notations, read as the sheet's script does."""
    k, v = F.col("o_orderkey") % 4, F.floor("o_totalprice").cast("bigint")
    typed = F.when(k == 0, F.concat(F.translate(F.format_number(v, 0), ",", "."), F.lit(" đ"))).when(k == 1, F.concat(v.cast("string"), F.lit(".00"))).when(k == 2, F.lit("0")).otherwise(F.lit("liên hệ"))
    return table(spark, sf, "orders").select("o_orderkey", money.sheet_number(typed).alias("price"))


QUERIES = {
    f.__name__: f
    for f in (
        price_parse_plain, price_parse_million, price_parse_thousand, price_parse_reject, price_shape_check, price_range_filter, fake_price_filter, normalize_text, normalize_model,
        clean_model_specs, clean_title, model_variants, mask_value, row_selection, token_explode, model_split, prefix_conflict, suffix_conflict, model_match, model_theta_join,
        model_from_title, brand_detect, url_host_counts, homepage_flag, detail_url_filter, relevance_score, bing_decode, topk_candidates, keyword_expand, search_href, category_flag, absolute_href,
        entity_decode, sheet_name_list, real_model, commercial_name, variant_model, sheet_price,
    )
}

_SQL_URLS = """u AS (SELECT p_partkey, p_brand, p_size, p_partkey % 4 AS r, concat(replace(p_name, ' ', '-'), '-di-', (p_partkey + 1000)::VARCHAR, CASE WHEN p_size % 5 = 0 THEN '-plus' ELSE '' END) AS slug FROM part),
v AS (SELECT *, CASE r WHEN 0 THEN concat('https://shop.vn/san-pham/', slug) WHEN 1 THEN concat('https://www.nguyenkim.com/', slug, '.html') WHEN 2 THEN concat('https://shop.vn/collections/', slug) ELSE concat('https://google.com/search?q=', slug) END AS url FROM u),
s AS (SELECT *, CASE WHEN p_size % 5 = 0 THEN 0 ELSE 150 + 100 * (r = 1)::INT END + 40 + 10 + 10 * (r = 0)::INT + 10 * (r = 1)::INT + 10 * (r <> 3)::INT - 50 * (r IN (2, 3))::INT - 100 * (p_size % 5 = 0)::INT AS raw FROM v),
t AS (SELECT *, greatest(0, least(300, raw))::INT AS score FROM s)"""

_STOP = ", ".join(f"'{w}'" for w in text.NAME_STOP_WORDS)
_SQL_STOCK = """v AS (SELECT p_partkey, p_brand, CASE p_size % 4 WHEN 0 THEN concat('SK', p_partkey) WHEN 1 THEN p_partkey::VARCHAR WHEN 2 THEN p_brand ELSE '' END AS sku,
  CASE p_size % 3 WHEN 0 THEN concat('B', p_partkey) WHEN 1 THEN 'a1' ELSE '' END AS barcode,
  CASE p_partkey % 4 WHEN 0 THEN concat('EH-DIH', p_partkey, ' ') WHEN 1 THEN concat('x-', p_partkey, ' kv-77 ') ELSE '' END AS code, p_name FROM part),
t AS (SELECT *, length(sku) >= 3 AND regexp_matches(sku, '[A-Za-z]') AND regexp_matches(sku, '[0-9]') AS sku_ok,
  length(barcode) >= 3 AND regexp_matches(barcode, '[A-Za-z]') AND regexp_matches(barcode, '[0-9]') AS barcode_ok,
  list_filter(string_split_regex(concat('Bếp từ ', replace(concat(lower(p_brand), '  ', code, p_name, ' '), lower(p_brand), ' '), ' máy ĐÔI'), '\\s+'), lambda w: w <> '' AND lower(w) NOT IN (""" + _STOP + """)) AS words FROM v)"""

ORACLES = {
    "entity_decode": """WITH e AS (SELECT p_partkey, concat('&amp;lt;b&gt; ', p_name, ' &quot;', p_brand, '&quot; &#39;', p_type, '&#39; &amp;amp; &nbsp;') AS e FROM part)
SELECT p_partkey, replace(replace(replace(replace(replace(e, '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&#39;', chr(39)) AS decoded FROM e""",
    "sheet_name_list": """WITH l AS (SELECT p_partkey, list_filter(list_transform(string_split(concat(' ', p_brand, ' ,, ', p_type, ',', p_brand, ', ', CASE WHEN p_size % 3 = 0 THEN p_type ELSE p_name END, ' , '), ','), lambda x: trim(x)), lambda x: x <> '') AS l FROM part)
SELECT p_partkey, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), '|') AS names FROM l""",
    "real_model": f"WITH {_SQL_STOCK} SELECT p_partkey, sku_ok AS sku_is_model, barcode_ok AS barcode_is_model FROM t",
    "commercial_name": f"WITH {_SQL_STOCK} SELECT p_partkey, array_to_string(words, ' ') AS name FROM t",
    "variant_model": f"""WITH {_SQL_STOCK} SELECT p_partkey, CASE WHEN sku_ok THEN sku WHEN barcode_ok THEN barcode WHEN p_partkey % 4 = 0 THEN concat('DIH', p_partkey)
  WHEN p_partkey % 4 = 1 THEN CASE WHEN length(p_partkey::VARCHAR) >= 3 THEN concat('X-', p_partkey) ELSE 'KV-77' END ELSE array_to_string(words, ' ') END AS model FROM t""",
    "sheet_price": r"""WITH o AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN floor(o_totalprice)::BIGINT WHEN 1 THEN floor(o_totalprice)::BIGINT * 100 END AS v FROM orders)
SELECT o_orderkey, CASE WHEN v > 0 THEN CASE WHEN v < 100000 THEN v * 1000 ELSE v END END AS price FROM o""",
    "price_parse_plain": "SELECT p_partkey, floor(p_retailprice * 10000)::BIGINT AS price FROM part",
    "price_parse_million": "SELECT o_orderkey, CASE WHEN v < 100000 THEN v * 1000 ELSE v END AS price FROM (SELECT o_orderkey, floor(o_totalprice / 100)::BIGINT * 10000 AS v FROM orders)",
    "price_parse_thousand": "SELECT p_partkey, CASE WHEN v < 100000 THEN v * 1000 ELSE v END AS price FROM (SELECT p_partkey, floor(p_retailprice)::BIGINT * 1000 AS v FROM part)",
    "price_parse_reject": "SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 3 THEN o_orderkey + 100000 END AS price FROM orders",
    "price_shape_check": "SELECT p_partkey, p_partkey % 3 = 0 AS is_price FROM part",
    "price_range_filter": """SELECT l_orderkey, l_linenumber, l_partkey, price FROM (
  SELECT l_orderkey, l_linenumber, l_partkey, round_even(l_extendedprice * 1000, 0)::BIGINT AS price, round_even(o_totalprice * 300, 0)::BIGINT AS r FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
WHERE price BETWEEN greatest(100000, 0.3 * r) AND least(2000000000, 2 * r)""",
    "fake_price_filter": """SELECT p_partkey, p % 1000 <> 0 AND length(m) >= 3 AND (contains(p::VARCHAR, m) OR contains(m, p::VARCHAR)) AS is_fake
FROM (SELECT p_partkey, p_partkey * 7 + 1234567 AS p, concat(p_size::VARCHAR, '4', (p_partkey % 10)::VARCHAR) AS m FROM part)""",
    "normalize_text": f"SELECT doc_id, coalesce(trim({_ACCENTS.format('text')}), '') AS normalized FROM documents",
    "normalize_model": f"SELECT p_partkey, {_SQL_NORM_MODEL} AS normalized FROM part",
    "clean_model_specs": "SELECT p_partkey, concat('K-', p_partkey::VARCHAR, 'I', CASE WHEN p_partkey % 4 = 3 THEN ' Pro' ELSE '' END) AS cleaned FROM part",
    "clean_title": r"SELECT doc_id, trim(regexp_replace(replace(regexp_replace(regexp_replace(text, '\[[^\]]+\]', ' ', 'g'), '\([^)]*\)', ' ', 'g'), '|', ' '), '\s+', ' ', 'g')) AS cleaned FROM documents",
    "model_variants": f"""WITH m AS (SELECT p_partkey, trim({_SQL_MODEL}) AS m FROM part),
f AS (SELECT p_partkey, unnest([m, replace(replace(m, '-', ''), '_', ''), replace(m, ' ', ''), regexp_replace(m, '[^a-zA-Z0-9]', '', 'g')]) AS x FROM m)
SELECT DISTINCT p_partkey, unnest([x, lower(x), upper(x)]) AS variant FROM f""",
    "mask_value": "SELECT s_suppkey, CASE WHEN s_suppkey % 5 = 0 THEN '****' ELSE concat(left(s_name, 4), '****', right(s_name, 4)) END AS masked FROM supplier",
    "row_selection": """WITH s AS (SELECT p_partkey, (p_partkey % 50)::INT AS a, p_size AS b, (p_partkey % 7 + 3)::INT AS c FROM part WHERE p_partkey % 10 <> 9)
SELECT p_partkey, a AS row_number FROM s UNION SELECT p_partkey, unnest(range(least(b, c), greatest(b, c) + 1))::INT FROM s""",
    "token_explode": r"WITH t AS (SELECT unnest(regexp_extract_all(upper(strip_accents(regexp_replace(url, '([0-9]+)-([0-9]+)', '\1\2', 'g'))), '[A-Z0-9]+')) AS token FROM pages) SELECT token, count(*) AS n FROM t GROUP BY 1",
    "model_split": f"SELECT p_partkey, regexp_extract(m, '^([A-Z]*)([0-9]+)(.*)$', 1) AS prefix, regexp_extract(m, '^([A-Z]*)([0-9]+)(.*)$', 2) AS digits, regexp_extract(m, '^([A-Z]*)([0-9]+)(.*)$', 3) AS suffix FROM (SELECT p_partkey, {_SQL_NORM_MODEL} AS m FROM part)",
    "prefix_conflict": "SELECT s_suppkey, s_suppkey % 4 = 1 AS conflict FROM supplier",
    "suffix_conflict": "SELECT s_suppkey, s_suppkey % 4 = 2 AS conflict FROM supplier",
    "model_match": "SELECT s_suppkey, s_suppkey % 4 = 0 AS matched FROM supplier",
    "model_theta_join": "SELECT s_suppkey, s_suppkey AS model_key FROM supplier WHERE s_suppkey % 4 = 0 UNION ALL SELECT t.s_suppkey, m.s_suppkey FROM supplier t JOIN supplier m ON t.s_suppkey % 4 = 3 AND m.s_suppkey + 100 = concat('9', (t.s_suppkey + 100)::VARCHAR)::BIGINT",
    "model_from_title": "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN concat('SMS', p_partkey::VARCHAR, 'X') ELSE concat('Q-', p_partkey::VARCHAR) END AS model FROM part",
    "brand_detect": "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_brand WHEN p_size % 3 = 0 THEN 'Bosch' ELSE '' END AS brand FROM part",
    "url_host_counts": "SELECT lower(regexp_extract(url, '^[a-zA-Z]+://([^/:?#]+)', 1)) AS host, count(*) AS n FROM pages GROUP BY 1",
    "homepage_flag": "SELECT page_id, page_id % 3 = 0 OR regexp_full_match(url, 'https?://[^/?#]+(/|/index.html|/index.php|/index.htm)?([?#].*)?') AS is_home FROM pages",
    "detail_url_filter": f"WITH {_SQL_URLS} SELECT p_partkey, url FROM t WHERE r IN (0, 1) AND p_size % 5 <> 0",
    "relevance_score": f"WITH {_SQL_URLS} SELECT p_partkey, score FROM t",
    "search_href": "SELECT page_id, CASE WHEN page_id % 3 < 2 THEN url END AS target FROM pages",
    "category_flag": f"""WITH l AS (SELECT p_partkey, lower(CASE WHEN p_partkey % 3 = 0 THEN 'Xem Quạt ' ELSE '' END || p_name) AS txt, CASE WHEN p_partkey % 3 = 1 THEN '/may-giat/9' ELSE '/p/9' END AS path FROM part)
SELECT p_partkey, len(list_filter([{', '.join(f"'{w}'" for w in urls.CATEGORY_WORDS)}], lambda w: contains(txt, w) OR contains(path, replace(w, ' ', '-')))) > 0 AS is_category FROM l""",
    "absolute_href": """WITH h AS (SELECT page_id, url, regexp_extract(url, '^[a-z]+://[^/?#]+') AS site, coalesce(nullif(regexp_extract(url, '^[a-z]+://[^/?#]+(/(?:[^?#]*/)?)', 1), ''), '/') AS folder,
  ['//cdn.vn/x.html', '/gia/tot', 'trang.html', 'https://khac.vn/y', '../../a/./b/../c.html?x=../y', '..', '?trang=2', '#dau'][page_id % 8 + 1] AS href FROM pages),
s AS (SELECT *, string_split(folder || regexp_extract(href, '^[^?#]*'), '/')[2:] AS parts, regexp_extract(href, '^[^?#]*([?#].*)?', 1) AS tail FROM h),
f AS (SELECT *, list_reduce(list_transform([p for p in parts if p <> '.'], lambda p: [p]), lambda kept, p: CASE WHEN p[1] <> '..' THEN list_concat(kept, p) WHEN len(kept) > 1 THEN kept[:-2] ELSE kept END, ['']) AS kept FROM s)
SELECT page_id, CASE page_id % 8 WHEN 0 THEN regexp_extract(url, '^[a-z]+:') || href WHEN 1 THEN site || href WHEN 3 THEN href WHEN 6 THEN regexp_extract(url, '^[^?#]*') || href WHEN 7 THEN regexp_extract(url, '^[^#]*') || href
  ELSE site || '/' || array_to_string(kept[2:], '/') || CASE WHEN parts[-1] IN ('.', '..') AND len(kept) > 1 THEN '/' ELSE '' END || coalesce(tail, '') END AS target FROM f""",
    "bing_decode": "SELECT page_id, url AS target FROM pages",
    "topk_candidates": f"WITH {_SQL_URLS}, k AS (SELECT p_brand, url, score, row_number() OVER (PARTITION BY p_brand ORDER BY score DESC, url)::INT AS rank FROM t) SELECT p_brand, rank, url, score FROM k WHERE rank <= 50",
    "keyword_expand": """WITH p AS (SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 'Bosch' ELSE p_brand END AS b, p_size, concat('QA', p_partkey::VARCHAR) AS base, CASE WHEN p_size % 3 = 0 THEN 'Ab' ELSE '-7' END AS tail FROM part),
m AS (SELECT *, base || tail AS m FROM p),
k AS (
  SELECT p_partkey, unnest([b || ' ' || m, m, '"' || m || '"', b || ' ' || m || ' giá', b || ' ' || m || ' site:.vn', b || ' ' || m || ' khuyến mãi']) AS keyword FROM m
  UNION SELECT p_partkey, 'Máy sấy ' || b || ' ' || m FROM m WHERE p_size % 2 = 0
  UNION SELECT p_partkey, unnest(['Bosch Series 8 ' || m, 'Bosch Series 6 ' || m]) FROM m WHERE b = 'Bosch'
  UNION SELECT p_partkey, unnest([b || ' ' || base, base, '"' || base || '"', b || ' ' || base || ' giá']) FROM m WHERE tail = 'Ab'
  UNION SELECT p_partkey, unnest([v, b || ' ' || v]) FROM (SELECT p_partkey, b, unnest([m, lower(m), upper(m), replace(m, '-', ''), lower(replace(m, '-', ''))]) AS v FROM m))
SELECT p_partkey, keyword FROM k""",
}
