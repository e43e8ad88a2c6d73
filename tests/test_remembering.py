"""A run that remembers: what one run learns the next one takes, and writing it twice changes nothing."""

import json

from pyspark.sql import functions as F

from marketloom.functions import text
from marketloom.plans import run as R
from marketloom.sources import cache, sheets

HOUR = 3_600_000


def page(model, price):
    return f'<html><head><title>Bếp Kocher {model}</title></head><body><div class="product-detail"><h1>Kocher {model}</h1><span class="current-price">{price}</span></div></body></html>'


def inputs(spark):
    values = [("01.Bếp từ", 3, "P1", "Kocher", "DI-333Pro", "15.000.000", "9.000.000", "14.000.000", []), ("01.Bếp từ", 4, "P2", "Kocher", "DI-555", "15.000.000", "", "", [])]
    rows = spark.createDataFrame(values, "sheet_name string, row_number int, product_id string, brand string, model string, list_price string, cost_price string, sale_price string, market_prices array<bigint>")
    urls = [f"https://shop{k}.vn/bep-tu-kocher-di-333pro.html" for k in range(4)]
    links = spark.createDataFrame([("Kocher", "DI-333Pro", u, "Sitemap") for u in urls] + [("Kocher", "DI-555", "https://x.vn/bep-kocher-di-555.html", None)], "brand string, model string, url string, source string")
    bodies = [(urls[0], page("DI-333Pro", "12.500.000đ")), (urls[1], page("DI-333Pro", "12.900.000đ")), (urls[2], page("DI-888", "1.000.000đ"))]
    return rows, links, spark.createDataFrame(bodies, "url string, html string"), urls


def tables(out):
    return sorted(map(str, out.results.collect())), sorted(map(str, out.logs.collect()))


def test_a_second_run_opens_nothing(spark, tmp_path):
    rows, links, pages, urls = inputs(spark)
    path, now = str(tmp_path), 1_000 * HOUR
    first = R.run_remembering(rows, links, pages, path, now)
    assert {r.url: r.from_cache for r in first.priced.collect()} == {u: False for u in [*urls, "https://x.vn/bep-kocher-di-555.html"]}
    held = {(r.section, r.key.split("\n")[-1]): r.value for r in cache.live(spark, path, now).collect()}
    assert held["price", urls[0]] == "12500000" and held["errors", urls[3]] == "Page not found" and held["selector", "shop0.vn"]
    assert ("errors", urls[2]) in held and ("price", urls[2]) not in held
    version = cache.table(spark, path).version()
    cache.put(R.learned_entries(first.priced, now), path, errors=True)  # the same run written again
    assert {(r.section, r.key.split("\n")[-1]): r.value for r in cache.table(spark, path).read().collect()} == held and cache.table(spark, path).version() == version + 1

    empty = pages.where("false")  # a second run would find nothing here if it opened a page
    second = R.run_remembering(rows, links, empty, path, now + HOUR // 12)
    assert all(r.from_cache for r in second.priced.collect())
    assert tables(second) == tables(first)
    assert {(r.row_number, r.url, r.reject_reason) for r in second.summary.collect()} == {(3, "Requests: 4, Saved requests: 4", "Saved time: 2000ms"), (4, "Requests: 1, Saved requests: 1", "Saved time: 500ms")}

    later = R.run_remembering(rows, links, pages, path, now + HOUR)  # the reasons have expired, the prices have not
    assert {r.url: r.from_cache for r in later.priced.collect()} == {urls[0]: True, urls[1]: True, urls[2]: False, urls[3]: False, "https://x.vn/bep-kocher-di-555.html": False}
    assert tables(later) == tables(first)


def test_another_model_on_a_page_is_judged_anew(spark, tmp_path):
    rows, links, pages, urls = inputs(spark)
    R.run_remembering(rows, links, pages, str(tmp_path), 0)
    other = rows.where("row_number = 3").withColumn("model", F.lit("DI-888"))
    out = R.run_remembering(other, links.withColumn("model", F.lit("DI-888")), pages, str(tmp_path), 1)
    assert not any(r.from_cache for r in out.priced.collect())


def test_logs_name_three_keywords_and_go_with_the_updates(spark):
    rows, links, pages, urls = inputs(spark)
    out = R.run_pricing(rows, links, pages)
    logs = {r.url: r for r in out.logs.collect()}
    words = rows.where("row_number = 3").select(text.keywords(F.col("brand"), F.col("model"), F.col("sheet_name")).alias("k")).first().k
    assert logs[urls[0]].keyword == ", ".join(words[:3]) and logs[urls[0]].match_score == 100
    assert logs["https://x.vn/bep-kocher-di-555.html"].source == "Search Engine"
    flush = sheets.updates(out.results).withColumn("batch_no", F.lit(0))
    sent = json.loads(sheets.payloads(flush, out.logs).first().payload)
    assert [u["rowNumber"] for u in sent["updates"]] == [3, 4] and len(sent["logs"]) == 5
    by_url = {x["url"]: x for x in sent["logs"]}
    assert by_url[urls[0]]["extracted price"] == 12_500_000 and by_url[urls[0]]["reject reason"] == "" and by_url[urls[2]]["reject reason"]
    assert "logs" not in json.loads(sheets.payloads(flush).first().payload)
