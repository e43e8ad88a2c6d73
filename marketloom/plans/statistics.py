"""Queries of price statistics over ``lineitem`` (a line is one observed price of its order's product) and ``orders``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.functions import money
from marketloom.operators import pricing, ranks, relational
from marketloom.session import table


def observations(spark: SparkSession, sf: str) -> DataFrame:
    """(l_orderkey, price): prices in dong, read as the price parser reads numbers."""
    price = money.parse_price_number(F.col("l_extendedprice") * 1000)
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", price.alias("price"))


def products(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as sheet rows: some without sale price, some without list price, some without cost."""
    k, total = F.col("o_orderkey"), F.col("o_totalprice") * 1000
    price = lambda share: money.parse_price_number(total * share)
    return table(spark, sf, "orders").select(
        k.alias("l_orderkey"), F.when(k % 3 != 0, price(0.9)).alias("sale_price"), F.when(k % 5 != 0, price(1.0)).alias("list_price"), F.when(k % 7 != 0, price(0.6)).alias("cost_price")
    )


_OBS = "SELECT l_orderkey, CASE WHEN v < 100000 THEN v * 1000 ELSE v END AS price FROM (SELECT l_orderkey, round_even(l_extendedprice * 1000, 0)::BIGINT AS v FROM lineitem) WHERE v > 0"
_QUARTILES = f"""
obs AS ({_OBS}), d AS (SELECT DISTINCT l_orderkey, price FROM obs),
q AS (SELECT l_orderkey, quantile_cont(price, 0.25) AS q1, quantile_cont(price, 0.75) AS q3, count(*) AS n FROM d GROUP BY 1),
kept AS (SELECT d.l_orderkey, price FROM d JOIN q USING (l_orderkey) WHERE n < 4 OR price BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)),
stats AS (SELECT l_orderkey, min(price) AS min_price, max(price) AS max_price, round_even(avg(price), 0)::BIGINT AS avg_price,
  round_even(quantile_cont(price, 0.5), 0)::BIGINT AS median_price, count(*) AS n_kept FROM kept GROUP BY 1)"""
_PRODUCTS = """
p AS (SELECT o_orderkey AS l_orderkey,
  CASE WHEN o_orderkey % 3 <> 0 THEN round_even(o_totalprice * 1000 * 0.9::DOUBLE, 0)::BIGINT END AS s,
  CASE WHEN o_orderkey % 5 <> 0 THEN round_even(o_totalprice * 1000 * 1.0::DOUBLE, 0)::BIGINT END AS l,
  CASE WHEN o_orderkey % 7 <> 0 THEN round_even(o_totalprice * 1000 * 0.6::DOUBLE, 0)::BIGINT END AS c FROM orders),
pp AS (SELECT l_orderkey, CASE WHEN s > 0 AND s < 100000 THEN s * 1000 WHEN s > 0 THEN s END AS sale_price,
  CASE WHEN l > 0 AND l < 100000 THEN l * 1000 WHEN l > 0 THEN l END AS list_price, CASE WHEN c > 0 AND c < 100000 THEN c * 1000 WHEN c > 0 THEN c END AS cost_price FROM p)"""


def suggested_pricing(spark, sf):
    arrays = pricing.price_arrays(observations(spark, sf), ["l_orderkey"])
    out = pricing.suggest(products(spark, sf), arrays, ["l_orderkey"])
    return out.select("l_orderkey", "min_price", "max_price", "avg_price", "median_price", "outlier_removed", "suggested_price", "gap_value", money.rounded_share(F.col("gap_percent")).alias("gap_percent"))


def price_percentiles(spark, sf):
    arrays = pricing.price_arrays(observations(spark, sf), ["l_orderkey"])
    return arrays.select("l_orderkey", *[pricing.percentile(F.col("distinct_prices"), p).alias(f"p{int(p * 100)}") for p in (0.25, 0.5, 0.75)])


def iqr_outliers(spark, sf):
    arrays = pricing.price_arrays(observations(spark, sf), ["l_orderkey"])
    gone = F.explode(F.array_except("distinct_prices", "kept"))
    return arrays.select("l_orderkey", gone.alias("outlier_price"))


def price_median(spark, sf):
    arrays = pricing.price_arrays(observations(spark, sf), ["l_orderkey"])
    return arrays.select("l_orderkey", pricing.summary(F.col("kept"))["median_price"].alias("median_price"))


def price_summary(spark, sf):
    arrays = pricing.price_arrays(observations(spark, sf), ["l_orderkey"])
    return arrays.select("l_orderkey", *[c.alias(k) for k, c in pricing.summary(F.col("kept")).items()], F.size("kept").cast("bigint").alias("n_kept"))


def lowest_ten(spark, sf):
    ranked = relational.top_k(observations(spark, sf).select("l_orderkey", "price", "l_linenumber"), ["l_orderkey"], [F.col("price"), F.col("l_linenumber")], 10)
    return ranked.select("l_orderkey", "rank", "price")


def sheet_recalc(spark, sf):
    """What the sheet's own script works out on write: lowest stored price as sale price, gap to the cost as a share of the cost."""
    lows = observations(spark, sf).groupBy("l_orderkey").agg(F.min("price").alias("min_price"))
    gap = F.col("min_price") - F.col("cost_price")
    out = products(spark, sf).join(lows, "l_orderkey", "left")
    return out.select("l_orderkey", "min_price", F.coalesce("min_price", "sale_price").alias("sale_price"), gap.alias("gap_value"), money.rounded_share(gap / F.col("cost_price")).alias("gap_percent"))


def _by_flag(spark, sf):
    """Prices by return flag: three groups that hold the whole table."""
    return table(spark, sf, "lineitem").select("l_returnflag", money.parse_price_number(F.col("l_extendedprice") * F.col("l_quantity") * 100).alias("price"))


def flag_price_summary(spark, sf):
    """Quartiles and statistics of groups that no task could hold."""
    out = ranks.price_summary(_by_flag(spark, sf), ["l_returnflag"])
    return out.select("l_returnflag", "n_distinct", "p25", "p50", "p75", "n_kept", "min_price", "max_price", "avg_price", "median_price")


def flag_outliers(spark, sf):
    return ranks.price_outliers(_by_flag(spark, sf), ["l_returnflag"])


QUERIES = {f.__name__: f for f in (suggested_pricing, price_percentiles, iqr_outliers, price_median, price_summary, lowest_ten, sheet_recalc, flag_price_summary, flag_outliers)}
_FLAGS = """v AS (SELECT l_returnflag, round_even(l_extendedprice * l_quantity * 100, 0)::BIGINT AS x FROM lineitem),
d AS (SELECT DISTINCT l_returnflag, CASE WHEN x < 100000 THEN x * 1000 ELSE x END AS price FROM v WHERE x > 0),
q AS (SELECT l_returnflag, count(*) AS n_distinct, quantile_cont(price, 0.25) AS p25, quantile_cont(price, 0.5) AS p50, quantile_cont(price, 0.75) AS p75 FROM d GROUP BY 1),
k AS (SELECT d.l_returnflag, price, n_distinct < 4 OR price BETWEEN p25 - 1.5 * (p75 - p25) AND p75 + 1.5 * (p75 - p25) AS kept FROM d JOIN q USING (l_returnflag))"""
ORACLES = {
    "flag_price_summary": f"""WITH {_FLAGS}, s AS (SELECT l_returnflag, count(*) AS n_kept, min(price) AS min_price, max(price) AS max_price, round_even(avg(price), 0)::BIGINT AS avg_price, round_even(quantile_cont(price, 0.5), 0)::BIGINT AS median_price FROM k WHERE kept GROUP BY 1)
SELECT * FROM q JOIN s USING (l_returnflag)""",
    "flag_outliers": f"WITH {_FLAGS} SELECT l_returnflag, price AS outlier_price FROM k WHERE NOT kept",
    "suggested_pricing": f"""WITH {_QUARTILES}, nd AS (SELECT l_orderkey, count(*) AS n_distinct FROM d GROUP BY 1), {_PRODUCTS}
SELECT l_orderkey, min_price, max_price, avg_price, median_price, coalesce(n_kept < n_distinct, false) AS outlier_removed, min_price AS suggested_price,
  coalesce(min_price, sale_price, list_price) - cost_price AS gap_value,
  round_even((coalesce(min_price, sale_price, list_price) - cost_price) / coalesce(min_price, sale_price, list_price), 9) AS gap_percent
FROM pp LEFT JOIN stats USING (l_orderkey) LEFT JOIN nd USING (l_orderkey)""",
    "price_percentiles": f"WITH obs AS ({_OBS}), d AS (SELECT DISTINCT l_orderkey, price FROM obs) SELECT l_orderkey, quantile_cont(price, 0.25) AS p25, quantile_cont(price, 0.5) AS p50, quantile_cont(price, 0.75) AS p75 FROM d GROUP BY 1",
    "iqr_outliers": f"WITH {_QUARTILES} SELECT l_orderkey, price AS outlier_price FROM d EXCEPT SELECT l_orderkey, price FROM kept",
    "price_median": f"WITH {_QUARTILES} SELECT l_orderkey, median_price FROM stats",
    "price_summary": f"WITH {_QUARTILES} SELECT * FROM stats",
    "lowest_ten": f"""WITH obs AS (SELECT l_orderkey, l_linenumber, CASE WHEN v < 100000 THEN v * 1000 ELSE v END AS price FROM (SELECT *, round_even(l_extendedprice * 1000, 0)::BIGINT AS v FROM lineitem)),
r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY price, l_linenumber)::INT AS rank FROM obs) SELECT l_orderkey, rank, price FROM r WHERE rank <= 10""",
    "sheet_recalc": f"""WITH obs AS ({_OBS}), lows AS (SELECT l_orderkey, min(price) AS min_price FROM obs GROUP BY 1), {_PRODUCTS}
SELECT l_orderkey, min_price, coalesce(min_price, sale_price) AS sale_price, min_price - cost_price AS gap_value, round_even((min_price - cost_price) / cost_price, 9) AS gap_percent
FROM pp LEFT JOIN lows USING (l_orderkey)""",
}
