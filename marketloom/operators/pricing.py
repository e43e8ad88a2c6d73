"""Price statistics per product: ten lowest, outliers by interquartile range, and the suggested price."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.functions.base import let


def percentile(sorted_values: Column, p: float) -> Column:
    """Linear interpolation at p * (n - 1) in a sorted array; NULL for an empty one."""

    def at(index: Column) -> Column:
        low, weight = F.floor(index).cast("int"), index - F.floor(index)
        return F.get(sorted_values, low) * (1 - weight) + F.get(sorted_values, F.ceil(index).cast("int")) * weight

    return F.when(F.size(sorted_values) > 0, let(F.lit(p) * (F.size(sorted_values) - 1), at))


def iqr_kept(sorted_distinct: Column) -> Column:
    """The values within 1.5 interquartile ranges of the quartiles; fewer than four values are all kept."""
    q1, q3 = percentile(sorted_distinct, 0.25), percentile(sorted_distinct, 0.75)
    bounds = F.struct((q1 - 1.5 * (q3 - q1)).alias("lo"), (q3 + 1.5 * (q3 - q1)).alias("hi"))
    return F.when(F.size(sorted_distinct) < 4, sorted_distinct).otherwise(let(bounds, lambda b: F.filter(sorted_distinct, lambda x: (x >= b["lo"]) & (x <= b["hi"]))))


def half_even(value: Column) -> Column:
    return F.bround(value).cast("bigint")


def price_arrays(observations: DataFrame, keys: list[str], price: str = "price") -> DataFrame:
    """Per product: all prices sorted, the distinct ones, and those that are no outliers. One shuffle.

    A product has at most as many observations as the candidate links kept for it (50), so its array is bounded.
    """
    grouped = observations.where(F.col(price) > 0).groupBy(*keys).agg(F.array_sort(F.collect_list(price)).alias("prices"))
    distinct = grouped.withColumn("distinct_prices", F.array_distinct("prices"))
    return distinct.withColumn("kept", iqr_kept(F.col("distinct_prices")))


def summary(kept: Column) -> dict[str, Column]:
    """Minimum, maximum, mean and median of kept prices, rounded half to even."""
    total = F.aggregate(kept, F.lit(0).cast("bigint"), lambda a, x: a + x)
    return {
        "min_price": F.get(kept, F.lit(0)),
        "max_price": F.get(kept, F.size(kept) - 1),
        "avg_price": F.when(F.size(kept) > 0, half_even(total / F.size(kept))),
        "median_price": half_even(percentile(kept, 0.5)),
    }


def suggest(products: DataFrame, arrays: DataFrame, keys: list[str]) -> DataFrame:
    """``products`` (keys, sale_price, list_price, cost_price in dong) with their price statistics and the gap to the cost.

    The comparison price is the suggested one (the lowest kept), else the sale price, else the list price.
    """
    joined = products.join(arrays, keys, "left")
    stats = joined.withColumns({**summary(F.col("kept")), "outlier_removed": F.coalesce(F.size("kept") < F.size("distinct_prices"), F.lit(False)), "market_prices": F.slice("prices", 1, 10)})
    comparison = F.coalesce("min_price", "sale_price", "list_price")
    gap = comparison - F.col("cost_price")
    return stats.withColumns({"suggested_price": F.col("min_price"), "gap_value": gap, "gap_percent": F.when(comparison > 0, gap / comparison)})
