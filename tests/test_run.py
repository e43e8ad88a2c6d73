"""Sources, sinks and the whole run on small captured inputs."""

import json
import random

import pytest
from pyspark.sql import functions as F

from marketloom import __main__ as cli
from marketloom.config import Settings
from marketloom.operators import html, pricing, relational
from marketloom.plans import relations
from marketloom.plans.run import job_status, run_pricing, search_requests
from marketloom.sources import cache, catalogue, search, sheets
from marketloom.streaming import flush

HEADERS = ["Mã SP", "Thương hiệu", "Model", "Giá niêm yết", "Giá vốn", "Giá bán", "Thị trường 1", "Thị trường 2", "Min", "Lợi nhuận", "% Lợi nhuận", "Giá đề xuất"]


def page(model, price):
    return f'<html><head><title>Bếp Kocher {model}</title></head><body><div class="product-detail"><h1>Kocher {model}</h1><del>99.000.000đ</del><span class="current-price">{price}</span></div></body></html>'


def test_header_maps():
    found = sheets.map_headers(HEADERS)
    assert [found[k] for k in ("brand", "model", "list_price", "cost_price", "sale_price", "min_price", "gap_value", "gap_percent", "suggested_price")] == [1, 2, 3, 4, 5, 8, 9, 10, 11]
    assert set(found["market"]) == {6, 7}
    wide = ["Mã SP", "Thương hiệu", "Model", "Ngành hàng", "Giá niêm yết (₫)", "Giá vốn (₫)", "Giá bán (₫)", "Giá khuyến mãi (₫)", "Thị trường 1", "Thị trường 2", "Min", "Lợi nhuận", "% Lợi nhuận", "Giá đề xuất"]
    found = sheets.map_headers(wide)
    assert [found[k] for k in ("list_price", "cost_price", "sale_price", "min_price", "gap_value", "gap_percent", "suggested_price")] == [4, 5, 6, 10, 11, 12, 13]
    with pytest.raises(ValueError):
        sheets.map_headers(["Model"])


def test_suggested_pricing_vectors(spark):
    rows = [
        ("basic", 12_000_000, 9_000_000, 11_040_000, [9_000_000 + k * 100_000 for k in (0, 2, 3, 4, 5, 6, 7, 8, 9, 10)] + [12_000_000]), ("fallback", 12_000_000, 9_000_000, None, []),
        ("outlier", 12_000_000, 9_000_000, None, [8_000_000, 9_200_000, 9_300_000, 9_400_000]),
    ]
    df = spark.createDataFrame(rows, "k string, list_price bigint, cost_price bigint, sale_price bigint, p array<bigint>")
    out = {r.k: r for r in pricing.suggest(df.drop("p"), pricing.price_arrays(df.select("k", F.explode("p").alias("price")), ["k"]), ["k"]).collect()}
    assert (out["basic"].min_price, out["basic"].gap_value, out["basic"].gap_percent, len(out["basic"].market_prices)) == (9_000_000, 0, 0.0, 10)
    assert (out["fallback"].min_price, out["fallback"].gap_value, out["fallback"].gap_percent) == (None, 3_000_000, 0.25)
    assert out["outlier"].outlier_removed and out["outlier"].suggested_price == 9_200_000 and out["outlier"].market_prices[0] == 8_000_000


def test_run_from_sheet_to_payload(spark, tmp_path):
    values = [["P1", "Kocher", "DI-333Pro", "15.000.000", "9.000.000", "14.000.000", "", ""], ["P2", "", "DI-1", "", "", "", "", ""], ["P3", "Kocher", "DI-777", "12.000.000", "9.000.000", "", "11.000.000", ""]]
    tab = {"sheet_name": "01.Bếp từ", "headers": HEADERS, "rows": [{"rowNumber": 3 + k, "values": v} for k, v in enumerate(values)]}
    (tmp_path / "tab.json").write_text(json.dumps(tab))
    raw = sheets.read_raw(spark, str(tmp_path / "tab.json"))
    assert sheets.find_sheet(raw, "01 bep tu").count() == 1
    rows = sheets.typed_rows(sheets.find_sheet(raw, "01.Bếp từ"), sheets.map_headers(HEADERS))
    assert [r.row_number for r in sheets.typed_rows(raw, sheets.map_headers(HEADERS), rows="3, 5").collect()] == [3, 5]
    assert search_requests(rows.where("row_number = 3")).select("engine").distinct().count() == 4
    urls = [f"https://shop{k}.vn/bep-tu-kocher-di-333pro.html" for k in range(3)]
    links = spark.createDataFrame([("Kocher", "DI-333Pro", u, "Sitemap") for u in [*urls, "https://shop.vn/tin-tuc/di-333pro"]], "brand string, model string, url string, source string")
    pages = spark.createDataFrame([(urls[0], page("DI-333Pro", "12.500.000đ")), (urls[1], page("DI-333Pro", "12.900.000đ")), (urls[2], page("DI-888", "1.000.000đ"))], "url string, html string")
    run = run_pricing(rows, links, pages)
    out = {r.row_number: r for r in run.results.collect()}
    assert (out[3].status, out[3].suggested_price, out[3].gap_value, out[3].market_prices) == ("success", 12_500_000, 3_500_000, [12_500_000, 12_900_000])
    assert out[4].status == "skipped" and (out[5].status, out[5].has_new_prices, out[5].min_price) == ("success", False, 11_000_000)
    logs = {r.url: r for r in run.logs.collect()}
    assert len(logs) == 3 and logs[urls[0]].price == 12_500_000 and logs[urls[2]].reject_reason is not None
    assert job_status(run.results).first().asDict() == {"total": 3, "success": 2, "skipped": 1, "insufficient": 0}
    run.results.write.parquet(str(tmp_path / "results"))
    stream = spark.readStream.schema(run.results.schema).parquet(str(tmp_path / "results"))
    flush.flush_results(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    sent = [u for r in spark.read.json(str(tmp_path / "out")).collect() for u in json.loads(r.payload)["updates"]]
    assert {u["rowNumber"]: u["marketPrices"] for u in sent} == {3: [12_500_000, 12_900_000], 4: [], 5: []}
    stored = spark.createDataFrame([("s", 3, ["9.000.000"] + [""] * 9, None, 8_000_000), ("s", 4, ["7.000.000"] + [""] * 9, 1, None)], "sheet_name string, row_number int, cells array<string>, sale_price bigint, cost_price bigint")
    changes = spark.createDataFrame([("s", 3, [10_000_000])], "sheet_name string, row_number int, market_prices array<bigint>")
    after = {r.row_number: r for r in sheets.upsert(stored, changes).collect()}
    assert (after[3].sale_price, after[3].gap_value, after[3].gap_percent) == (10_000_000, 2_000_000, 0.25) and after[4].sale_price == 7_000_000


def test_price_cascade_stages(spark):
    cases = {
        "css": ('<div class="product-detail"><span class="current-price">12.500.000đ</span></div>', 12_500_000),
        "junk": ('<div class="product-detail"><div class="related"><span class="price">1.200.000đ</span></div><p>12.500.000đ</p></div>', 12_500_000),
        "json": ('<script type="application/ld+json">{"@type":"Product","name":"Kocher DI-333Pro","offers":{"lowPrice":"12500000"}}</script>', 12_500_000),
        "other product": ('<script type="application/ld+json">{"@type":"Product","name":"Kocher DI-888","offers":{"price":12500000}}</script>', None),
        "meta": ('<meta property="product:price:amount" content="12500000">', 12_500_000), "discount": ("<p>Tiết kiệm 1.500.000đ</p>", None),
    }
    pages = spark.createDataFrame([(k, f"<html><body>{h}</body></html>") for k, (h, _) in cases.items()], "url string, html string")
    got = html.extract(pages).select("url", html.choose_price(F.col("candidates"), F.lit("DI-333Pro"), F.lit(15_000_000.0)).alias("c")).collect()
    assert {r.url: r.c and r.c.price for r in got} == {k: v for k, (_, v) in cases.items()}
    root = html.parse("<div><p><span>a</span></p><p><span>b</span></p></div>")
    spans = [n for n in root.walk() if n.tag == "span"]
    assert (html.dom_distance(spans[0], spans[0]), html.dom_distance(spans[0], spans[0].parent.parent), html.dom_distance(*spans)) == (0, 2, 4)


def test_search_pages_and_sitemaps(spark):
    pages = [
        ("google", '<a href="/url?q=https://a.vn/di-333&x=1">1</a><a href="#top">2</a><a href="https://a.vn/di-333">3</a>'), ("bing", '<cite>b.vn/x › y</cite><li class="b_algo"><h2><a href="https://b.vn/z">z</a></h2></li>'),
        ("ddg", '<a class="result__a" href="//duckduckgo.com/l/?uddg=https%3A%2F%2Fc.vn%2Fp">c</a>'), ("coccoc", '<a href="https://d.vn/">d</a>'),
    ]
    df = spark.createDataFrame([(e, "k", h) for e, h in pages], "engine string, keyword string, html string")
    assert sorted((r.engine, r.url) for r in search.results(df).collect()) == [("bing", "https://b.vn/x"), ("bing", "https://b.vn/z"), ("coccoc", "https://d.vn/"), ("ddg", "https://c.vn/p"), ("google", "https://a.vn/di-333")]
    pad = " " * 100
    maps = [("a.vn", f"<sitemap><loc>https://a.vn/sitemap-product.xml</loc></sitemap><sitemap><loc>https://a.vn/sitemap-page.xml</loc></sitemap>{pad}"), ("https://a.vn/sitemap-product.xml", f"<loc>https://a.vn/san-pham/kocher-di-3333</loc><loc>https://a.vn/tin-tuc/di-3333</loc>{pad}")]
    found = search.sitemap_links(spark.createDataFrame(maps, "site string, document string"), spark.createDataFrame([("a.vn", "DI-3333", "Kocher")], "site string, model string, brand string"))
    assert [r.url for r in found.collect()] == ["https://a.vn/san-pham/kocher-di-3333"]
    log = spark.createDataFrame([("google", 429, False, 1_000), ("bing", 200, False, 1_000)], "engine string, status int, captcha boolean, at_ms bigint")
    assert [r.engine for r in search.blocked(log, F.lit(2_000)).collect()] == ["google"] and search.blocked(log, F.lit(700_000)).count() == 0


def test_catalogue(spark, tmp_path):
    product = {"title": "Máy rửa bát Bosch SMS6ZCI49E", "vendor": "", "variants": [{"id": 1, "sku": "X1-9", "barcode": ""}, {"id": 2, "sku": "", "barcode": ""}]}
    (tmp_path / "p.json").write_text(json.dumps({"products": [product]}))
    found = catalogue.variants(catalogue.read(spark, str(tmp_path / "p.json")))
    assert sorted((r.brand, r.model, r.variant_id) for r in found.collect()) == [("Bosch", "SMS6ZCI49E", 2), ("Bosch", "X1-9", 1)]
    rows = spark.createDataFrame([("BOSCH", "sms 6zci49e", 5_000_000), ("Bosch", "none", 1)], "brand string, model string, price bigint")
    ids = catalogue.variant_ids(rows, found)
    assert sorted(str(r.variant_id) for r in ids.collect()) == ["2", "None"]
    assert [json.loads(r.payload) for r in catalogue.price_updates(ids).collect()] == [{"variant": {"id": 2, "price": 5_000_000}}]


def test_cache(spark, tmp_path):
    path = str(tmp_path / "cache")
    rows = [("html", "u", "old", 0), ("html", "u", "new", 1_000), ("selector", "d", ".price", 0), ("errors", "e", "x", 0), ("keywords", "k", "[]", 0)]
    cache.put(spark.createDataFrame(rows, cache.SCHEMA), path)
    read = lambda now: {(r.section, r.value) for r in cache.live(spark, path, now).collect()}
    assert read(2_000) == {("html", "new"), ("selector", ".price")} and read(100 * 3_600_000) == {("selector", ".price")}


def test_relational_edges(spark):
    offers = spark.createDataFrame([("a", 5, True, 0), ("a", 9, False, 1), ("a", 7, False, 2), ("b", 3, True, 0), ("b", 1, True, 1)], "k string, price bigint, is_original boolean, position int")
    assert sorted((r.k, r.price) for r in relational.best_offer(offers, ["k"]).collect()) == [("a", 7), ("b", 3)]


def test_command_line(capsys, monkeypatch):
    monkeypatch.setenv("MARKETLOOM_NOTIFY_TOKEN", "abcdefghijkl")
    assert cli.main(["config"]) == 0 and "abcd****ijkl" in capsys.readouterr().out
    assert cli.main(["notify", "hi"]) == 0 and '"ok": false' in capsys.readouterr().out
    assert Settings.load().batch_rows == 10
    with pytest.raises(SystemExit):
        cli.main(["--help"])


def test_site_category_links(spark, tmp_path):
    anchors = [
        ("/bep-tu", "x"), ("/bep-tu?page=2", "x"), ("https://Shop.vn/a", "Tủ lạnh <b>lớn</b>"), ("quat", "x"), ("?q=1", "Quạt"),  # /bep-tu, /a, /vn/quat, /vn/home
        ("https://other.vn/bep", "Bếp"), ("/", "Bếp"), ("/index.html", "Bếp"), ("/cart/bep", "Bếp"), ("/login", "Bếp"), ("/abc", "none"), ("#bep", "Bếp"), ("javascript:bep()", "Bếp"),
    ]
    html_text = "".join(f'<a class="c" href="{h}">{t}</a>' for h, t in anchors)
    spark.createDataFrame([(1, "https://shop.vn/vn/home?x=1", html_text), (2, "https://shop.vn/", "<p>none</p>")], "page_id bigint, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    assert [tuple(r) for r in relations.site_category_links(spark, str(tmp_path)).collect()] == [(1, 4)]


def test_sheet_update_cells(spark, tmp_path):
    spark.createDataFrame([(1, 1, 9000.0), (1, 2, 9500.0)], "l_orderkey bigint, l_linenumber int, l_extendedprice double").write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.createDataFrame([(1, 10000.0), (7, 10000.0)], "o_orderkey bigint, o_totalprice double").write.parquet(str(tmp_path / "orders.parquet"))
    rows = {r[0]: tuple(r)[1:] for r in relations.sheet_update_cells(spark, str(tmp_path)).collect()}
    assert rows[1] == ("9000000|9500000" + "|" * 8, "9000000", "3000000", "0.333333333", "9000000")
    assert rows[7] == ("|" * 9, "", "", "", "")  # no prices, no cost


def test_candidate_union_whole(spark):
    sf = "/root/testdata/sf0.001"
    every = relations._product_urls(spark, sf).select("url").distinct()
    found = relations.candidate_union_whole(spark, sf)
    assert found.count() == every.count() and every.join(found, "url", "left_anti").count() == 0


def test_ttl_lookup_against_brute_force(spark):
    rng = random.Random(4)
    entries = [(rng.choice("abc"), rng.randrange(0, 2000), rng.randrange(5)) for _ in range(150)] + [(None, 5, 1), ("a", None, 2), ("a", 700, 1), ("a", 700, 4)]
    asked = [(k, rng.choice("abcd"), rng.randrange(0, 2000)) for k in range(200)] + [(200, None, 6), (201, "a", 700), (202, "a", None), (203, "a", 700)]
    cache = spark.createDataFrame(entries, "k string, written_at bigint, value int")
    requests = spark.createDataFrame(asked, "request_id int, k string, at bigint")
    for ttl in (1, 40, 5000):
        got = {r.request_id: r.value for r in relational.ttl_lookup(requests, cache, ["k"], ttl).collect()}
        want = {}
        for i, k, at in asked:
            fit = [(w, v) for key, w, v in entries if None not in (k, at, w) and key == k and 0 <= at - w <= ttl]
            want[i] = max(fit)[1] if fit else None
        assert got == want


def test_single_sale_prices_and_update_log(spark):
    stored = spark.createDataFrame(
        [("s", 2, 5, 1, None, None), ("s", 3, 20, 8, None, None), ("s", 4, 20, None, 7, 0.5), ("s", 5, 20, 8, 12, 1.5), ("s", 6, 20, 0, None, None)],
        "sheet_name string, row_number int, sale_price bigint, cost_price bigint, gap_value bigint, gap_percent double",
    )
    changes = spark.createDataFrame([("s", 2, 9), ("s", 3, 10), ("s", 3, 9), ("s", 4, 30), ("s", 6, 9), ("t", 5, 9)], "sheet_name string, row_number int, price bigint")
    out = {r.row_number: (r.sale_price, r.gap_value, r.gap_percent) for r in sheets.set_sale_prices(stored, changes).collect()}
    assert out == {2: (5, None, None), 3: (10, 2, 0.25), 4: (30, None, None), 5: (20, 12, 1.5), 6: (9, 9, None)}
    log = spark.createDataFrame([(None, "M", 5, "success"), ("B", None, None, "error: x")], "brand string, model string, price bigint, status string")
    assert [tuple(r) for r in sheets.update_log(log, "2026-01-02 03:04:05").orderBy("status").collect()] == [("2026-01-02 03:04:05", "B", "", None, "error: x"), ("2026-01-02 03:04:05", "", "M", 5, "success")]


def test_known_prices_of_verified_pages(spark):
    urls = [f"https://shop.vn/{k}" for k in range(3)]
    pages = spark.createDataFrame([(urls[0], page("DI-333Pro", "12.500.000đ")), (urls[1], page("DI-333Pro", "12.500.000đ")), (urls[2], page("DI-888", "12.500.000đ"))], "url string, html string")
    products = spark.createDataFrame([(u, "DI-333Pro", "Kocher", 12e6) for u in [*urls, "https://shop.vn/9"]], "url string, model string, brand string, reference double")
    known = spark.createDataFrame([(urls[1], 11), (urls[2], 12), ("https://shop.vn/9", 13)], "url string, price bigint")
    out = {r.url[-1]: (r.price, r.reject_reason is None) for r in html.page_prices(products, html.extract(pages), known).collect()}
    assert out == {"0": (12_500_000, True), "1": (11, True), "2": (None, False), "9": (None, False)}


def test_update_price_command(spark, tmp_path, monkeypatch):
    monkeypatch.setenv("MARKETLOOM_OUTPUT_PATH", str(tmp_path))
    for price in ("100", "200"):
        assert cli.main(["update-price", "77", price, "--write-log", "--brand", "B", "--model", "M"]) == 0
    assert cli.main(["update-price", "78", "300"]) == 0
    bodies = [json.loads(r.payload)["variant"] for r in spark.read.parquet(str(tmp_path / "price_updates")).collect()]
    assert sorted((b["id"], b["price"]) for b in bodies) == [(77, 100), (77, 200), (78, 300)]
    assert sorted(r.price for r in spark.read.parquet(str(tmp_path / "update_log")).collect()) == [100, 200]
