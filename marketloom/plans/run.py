"""A whole pricing run as one lazy plan: sheet rows, candidates, pages, prices, statistics, results and logs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.functions import money, text, urls
from marketloom.operators import html, pricing, relational
from marketloom.session import stored
from marketloom.sources import cache

#: Candidates kept for a row, links in a crawl batch, and matches after which no batch is begun.
TOP_CANDIDATES, CRAWL_BATCH, ENOUGH = 50, 10, 5
#: Keywords named in a log row, the score from which a link counts as a match there, milliseconds that a known page saves, and the reason of a page without a price.
LOGGED_KEYWORDS, MATCH_SCORE, SAVED_MS, NOT_FOUND = 3, 40, 500, "Model mismatch or price not found"
KEYS = ["sheet_name", "row_number"]


@dataclass
class PricingRun:
    """Tables of a run: results by row, a log row for each candidate, one summary row of the log for each row, and the priced candidates."""

    results: DataFrame
    logs: DataFrame
    summary: DataFrame
    priced: DataFrame


def search_requests(rows: DataFrame) -> DataFrame:
    """(brand, model, keyword, engine): what is to be searched, each product once."""
    products = rows.select(*KEYS, "brand", "model").dropDuplicates(["brand", "model"])
    words = products.select("brand", "model", F.explode(text.keywords(F.col("brand"), F.col("model"), F.col("sheet_name"))).alias("keyword"))
    return words.select("*", F.explode(F.array(*[F.lit(e) for e in ("google", "bing", "ddg", "coccoc")])).alias("engine"))


def candidates(rows: DataFrame, links: DataFrame) -> DataFrame:
    """The fifty best links of each row. ``links``: brand, model, url, source; product pages only, first source counts."""
    known = relational.first_seen(links, ["brand", "model", "url"], ["source"], ["source"])
    met = rows.select(*KEYS, "brand", "model").join(known, ["brand", "model"])
    likely = met.where(urls.is_detail_url(F.col("url"), F.col("model"), F.col("brand")))
    scored = likely.withColumn("score", urls.relevance_score(F.col("url"), F.col("model"), F.col("brand")))
    return relational.top_k(scored, KEYS, [F.desc("score"), F.col("url")], TOP_CANDIDATES)


def known_outcomes(spark: SparkSession, cache_path: str, now_ms: int) -> tuple[DataFrame, DataFrame]:
    """What a cache still knows: (url, model_key, known_price, known_reason) of pages, and (domain, selector)."""
    entries = cache.live(spark, cache_path, now_ms)
    parts = F.split("key", "\n", 2)  # the model's key, then the URL
    pages = entries.where("section IN ('price', 'errors')").select(F.get(parts, F.lit(1)).alias("url"), F.get(parts, F.lit(0)).alias("model_key"), "section", "value")
    price, reason = F.max(F.when(F.col("section") == "price", F.col("value").try_cast("bigint"))), F.max(F.when(F.col("section") == "errors", F.col("value")))
    selectors = entries.where("section = 'selector'").select(F.col("key").alias("domain"), F.col("value").alias("selector"))
    return pages.groupBy("url", "model_key").agg(price.alias("known_price"), reason.alias("known_reason")), selectors


def learned_entries(priced: DataFrame, now_ms: int) -> DataFrame:
    """The cache entries that a run adds: prices and reasons of pages that it had to extract, and the selectors that found prices.

    The time is the run's, so writing the same run again changes nothing.
    """
    fresh = priced.where(~F.col("from_cache"))
    key, at = F.concat("model_key", F.lit("\n"), "url"), F.lit(now_ms).cast("bigint").alias("ts")
    prices = fresh.where("price IS NOT NULL").select(F.lit("price").alias("section"), key.alias("key"), F.col("price").cast("string").alias("value"), at)
    reasons = fresh.where("price IS NULL").select(F.lit("errors").alias("section"), key.alias("key"), F.coalesce("reject_reason", F.lit(NOT_FOUND)).alias("value"), at)
    found = fresh.where("price IS NOT NULL AND selector <> ''").select(F.lit("selector").alias("section"), urls.host(F.col("url")).alias("key"), F.col("selector").alias("value"), at)
    return prices.unionByName(reasons).unionByName(found).where("key IS NOT NULL")


def run_pricing(rows: DataFrame, links: DataFrame, pages: DataFrame, learned: DataFrame | None = None, known: DataFrame | None = None, keep=lambda priced: priced) -> PricingRun:
    """Results and logs for sheet rows (see sources.sheets.typed_rows), candidate links and captured pages (url, html).

    ``known`` (see known_outcomes): a page whose price or reject reason is known for a model is not opened for it.
    ``keep`` may write the priced candidates, so that results, logs and what is learned come from one extraction.
    """
    model = text.clean_model_specs(F.col("model"))
    valid = text.is_valid_brand(F.col("brand")) & text.is_valid_model(F.col("model"))
    rows = rows.withColumn("model", model).withColumn("skipped", ~valid)
    live = rows.where(~F.col("skipped"))
    chosen = candidates(live, links).withColumn("model_key", text.normalize_model(F.col("model")))
    if known is not None:
        chosen = chosen.join(known, ["url", "model_key"], "left")
    else:
        chosen = chosen.withColumns({"known_price": F.lit(None).cast("bigint"), "known_reason": F.lit(None).cast("string")})
    reference = live.select(*KEYS, F.coalesce(money.parse_price_text(F.col("sale_price")), money.parse_price_text(F.col("list_price"))).cast("double").alias("reference"))
    chosen = chosen.join(reference, KEYS).withColumn("from_cache", F.col("known_price").isNotNull() | F.col("known_reason").isNotNull())
    opened, settled = chosen.where(~F.col("from_cache")), chosen.where("from_cache")
    wanted = pages.join(opened.select("url").distinct(), "url", "left_semi")
    extracted = html.page_prices(opened, html.extract(wanted, learned))
    remembered = settled.withColumns({"price": F.col("known_price"), "reject_reason": F.when(F.col("known_price").isNull(), F.col("known_reason")), "selector": F.lit(None).cast("string")})
    priced = keep(extracted.unionByName(remembered).withColumn("matched", money.is_accepted(F.col("price"))))
    crawled = relational.progressive_stop(priced, KEYS, [F.desc("score"), F.col("url")], F.col("matched"), CRAWL_BATCH, ENOUGH)
    # the first three keywords stand in every log row
    words = live.select(*KEYS, F.array_join(F.slice(text.keywords(F.col("brand"), F.col("model"), F.col("sheet_name")), 1, LOGGED_KEYWORDS), ", ").alias("keyword"))
    logs = crawled.join(words, KEYS, "left").select(
        *KEYS, "keyword", "url", F.coalesce("source", F.lit("Search Engine")).alias("source"), "score", F.when(F.col("score") >= MATCH_SCORE, 100).otherwise(0).alias("match_score"),
        F.when(F.col("matched"), F.col("price")).alias("price"), F.when(~F.col("matched"), F.coalesce("reject_reason", F.lit(NOT_FOUND))).alias("reject_reason"),
    )
    hits = crawled.groupBy(*KEYS).agg(F.count("*").alias("n"), F.count_if("from_cache").alias("hits"))
    requests = F.concat(F.lit("Requests: "), F.col("n").cast("string"), F.lit(", Saved requests: "), F.col("hits").cast("string"))
    summary = hits.select(
        *KEYS, F.lit("STATISTICS SUMMARY").alias("keyword"), requests.alias("url"), F.lit("System Stats").alias("source"), F.lit(0).alias("score"), F.lit(0).alias("match_score"),
        F.lit(None).cast("bigint").alias("price"), F.concat(F.lit("Saved time: "), (SAVED_MS * F.col("hits")).cast("string"), F.lit("ms")).alias("reject_reason"),
    )
    found = crawled.where("matched").groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct("price", "url"))).alias("details"))
    joined = rows.join(found, KEYS, "left")
    new = F.size(F.coalesce("details", F.array().cast("array<struct<price:bigint,url:string>>"))) > 0
    used = joined.withColumn("has_new_prices", new).withColumn("used", F.when(new, F.col("details.price")).otherwise(F.col("market_prices")))
    arrays = pricing.price_arrays(used.select(*KEYS, F.explode("used").alias("price")), KEYS)
    products = used.select(*KEYS, "product_id", "brand", "model", "skipped", "has_new_prices", "details", *[money.parse_price_text(F.col(c)).alias(c) for c in ("sale_price", "list_price", "cost_price")])
    stats = pricing.suggest(products, arrays, KEYS)
    status = F.when(F.col("skipped"), "skipped").when(F.size("market_prices") > 0, "success").otherwise("insufficient_prices")
    return PricingRun(stats.withColumn("status", status).drop("prices", "distinct_prices", "kept", "skipped"), logs, summary, priced)


def run_remembering(rows: DataFrame, links: DataFrame, pages: DataFrame, cache_path: str, now_ms: int) -> PricingRun:
    """A run that takes what the cache knows at ``now_ms`` and writes back what it learns: prices, reject reasons, selectors.

    Pages are extracted once, into a written table. A second run over the same pages opens none that is settled for the
    model: prices live for twelve hours, reasons for ten minutes. Repeating a run, as a micro-batch is repeated after a
    failure, writes the same entries again.
    """
    spark = rows.sparkSession
    known, selectors = known_outcomes(spark, cache_path, now_ms)
    out = run_pricing(rows, links, pages, stored(selectors, "selectors"), stored(known, "known"), lambda priced: stored(priced, "priced"))
    cache.put(learned_entries(out.priced, now_ms), cache_path, errors=True)
    return out


def job_status(results: DataFrame) -> DataFrame:
    """Counters of a run."""
    count = lambda s: F.count_if(F.col("status") == s)
    return results.agg(F.count("*").alias("total"), count("success").alias("success"), count("skipped").alias("skipped"), count("insufficient_prices").alias("insufficient"))
