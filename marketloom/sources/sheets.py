"""Sheets as tables: captured JSON of a workbook's tabs, header mapping, typed rows, and what is written back."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketloom.functions import money, text
from marketloom.sources.versions import VersionedTable

RAW_SCHEMA = "sheet_name string, headers array<string>, rows array<struct<rowNumber:int,values:array<string>>>"
#: The names by which each column of a sheet may go, in the order in which they are tried.
HEADERS = {
    "product_id": ("Mã SP", "Ma SP", "Mã sản phẩm", "Ma san pham"), "brand": ("Thương hiệu", "Thuong hieu"), "model": ("Model",),
    "list_price": ("Giá niêm yết (₫)", "Giá niêm yết (đ)", "Giá niêm yết", "Gia niem yet"), "cost_price": ("Giá vốn (₫)", "Giá vốn (đ)", "Giá vốn", "Gia von"),
    "sale_price": ("Giá bán (₫)", "Giá bán (đ)", "Giá bán", "Gia ban"), "min_price": ("Min",), "gap_value": ("Lợi nhuận", "Loi nhuan", "GAP"),
    "gap_percent": ("% Lợi nhuận", "% Loi nhuan", "%GAP"), "suggested_price": ("Giá đề xuất", "Gia de xuat"),
}
REQUIRED = ("brand", "model", "min_price", "gap_value", "gap_percent", "suggested_price")


def _fold(value: str) -> str:
    plain = "".join(c for c in unicodedata.normalize("NFD", value or "") if not unicodedata.combining(c))
    return plain.replace("đ", "d").replace("Đ", "d").strip().lower()


def header_index(headers: list[str], names: tuple[str, ...]) -> int:
    """The first header that the first matching name finds: in full, as its beginning, or inside; -1 if none. A few dozen strings, on the driver."""
    bare = lambda s: re.sub("[^a-z0-9]", "", s)
    for name in map(_fold, names):
        for k, header in enumerate(map(_fold, headers)):
            same_unit = ("%" in name) == ("%" in header)
            if header.startswith(name) or (same_unit and bare(name) and bare(name) in bare(header)):
                return k
    return -1


def map_headers(headers: list[str]) -> dict:
    """Column numbers by field, and those of the ten market columns; an error names the columns that a sheet must have and lacks."""
    if not headers:
        raise ValueError("the sheet has no header")
    found: dict = {field: header_index(headers, names) for field, names in HEADERS.items()}
    market = [header_index(headers, (f"Thị trường {k}", f"Thi truong {k}")) for k in range(1, 11)]
    found["market"] = [k for k in market if k >= 0]
    missing = [f for f in REQUIRED if found[f] < 0] + ([] if found["market"] else ["market"])
    if missing:
        raise ValueError(f"the sheet lacks columns for: {', '.join(missing)}")
    return found


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """Captured tabs as JSON documents, one for each tab."""
    return spark.read.schema(RAW_SCHEMA).option("multiLine", True).json(path)


def tab_names(tabs: DataFrame, workbook: DataFrame | None = None) -> DataFrame:
    """(position, sheet_name) of the captured tabs by name; where none was captured, of the tabs that the workbook's own page (html) shows, in its order."""
    named = tabs.select("sheet_name").distinct().select((F.row_number().over(Window.orderBy("sheet_name")) - 1).alias("position"), "sheet_name")  # a workbook has a few dozen tabs
    if workbook is None or not tabs.isEmpty():
        return named
    return workbook.select(F.posexplode(text.sheet_names_from_html(F.col("html"))).alias("position", "sheet_name"))


def find_sheet(tabs: DataFrame, name: str) -> DataFrame:
    """The tab of that name, else the first whose letters and digits are the same."""
    bare = lambda c: F.regexp_replace(text.normalize_text(c), "[^a-z0-9]", "")
    exact = F.col("sheet_name") == name
    return tabs.where(exact | (bare(F.col("sheet_name")) == bare(F.lit(name)))).orderBy(F.desc(exact), "sheet_name").limit(1)


def typed_rows(tab: DataFrame, mapping: dict, start_row: int = 3, end_row: int | None = None, rows: str | None = None) -> DataFrame:
    """Rows of one tab with typed fields, NULL for columns that it lacks. ``rows``: a selection such as '3, 5, 20-22'."""
    exploded = tab.select("sheet_name", F.explode("rows").alias("r")).select("sheet_name", F.col("r.rowNumber").alias("row_number"), F.col("r.values").alias("v"))
    cell = lambda k: F.get("v", F.lit(k)) if k >= 0 else F.lit(None).cast("string")
    kept = exploded.where(F.col("row_number") >= max(3, start_row))
    if end_row is not None:
        kept = kept.where(F.col("row_number") <= end_row)
    if rows:
        kept = kept.where(F.coalesce(F.array_contains(text.parse_row_selection(F.lit(rows)), F.col("row_number")), F.lit(True)))
    market = F.array(*[money.parse_price_text(cell(k)) for k in mapping["market"]])
    fields = [F.coalesce(cell(mapping[f]), F.lit("")).alias(f) for f in ("product_id", "brand", "model", "list_price", "cost_price", "sale_price")]
    return kept.select("sheet_name", "row_number", *fields, F.filter(market, lambda p: p > 0).alias("market_prices"))


def updates(results: DataFrame) -> DataFrame:
    """What is written back for each row; market prices only where new ones were found."""
    market = F.when(F.col("has_new_prices"), F.col("market_prices")).otherwise(F.array().cast("array<bigint>"))
    return results.select("sheet_name", "row_number", market.alias("market_prices"), "min_price", "gap_value", "gap_percent", "suggested_price", "status")


def payloads(flush: DataFrame, logs: DataFrame | None = None) -> DataFrame:
    """One JSON document for each sheet and flush of ``updates`` (with batch_no): the updates, and the log rows of the same rows.

    A flush has a fixed number of rows, and a row at most as many log rows as candidates.
    """
    row = F.struct(F.col("row_number").alias("rowNumber"), F.col("market_prices").alias("marketPrices"), F.col("min_price").alias("minPrice"), F.col("gap_value").alias("gapValue"), F.col("gap_percent").alias("gapPercent"), F.col("suggested_price").alias("suggestedPrice"), "status")
    by = ["sheet_name", "batch_no"]
    grouped = flush.groupBy(*by).agg(F.array_sort(F.collect_list(row)).alias("updates"))
    if logs is None:
        return grouped.select(*by, F.to_json(F.struct("updates")).alias("payload"))
    entry = F.struct(F.col("row_number").alias("rowNumber"), "keyword", F.col("source").alias("search engine"), "url", F.col("score").alias("relevance score"), F.col("match_score").alias("model match score"), F.col("price").alias("extracted price"), F.coalesce("reject_reason", F.lit("")).alias("reject reason"))
    kept = logs.join(flush.select("sheet_name", "row_number", "batch_no"), ["sheet_name", "row_number"]).groupBy(*by).agg(F.array_sort(F.collect_list(entry)).alias("logs"))
    none = F.array().cast(kept.schema["logs"].dataType)
    return grouped.join(kept, by, "left").select(*by, F.to_json(F.struct("updates", F.coalesce("logs", none).alias("logs"))).alias("payload"))


def upsert(stored: DataFrame, changes: DataFrame) -> DataFrame:
    """The stored cells after a write, as the sheet's own script works them out.

    ``stored``: sheet_name, row_number, cells (market cells as text), sale_price, cost_price. Rows 1 and 2 are
    protected. New prices replace all ten cells; the sale price becomes the lowest stored price; the gap is taken to
    the cost, as a share of the cost.
    """
    new = changes.select("sheet_name", "row_number", F.col("market_prices").alias("new"))
    joined = stored.join(new, ["sheet_name", "row_number"], "left")
    given = (F.size("new") > 0) & (F.col("row_number") > 2)
    filled = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda k: F.coalesce(F.get("new", k).cast("string"), F.lit("")))
    cells = joined.withColumn("cells", F.when(given, filled).otherwise(F.col("cells"))).drop("new")
    lowest = F.array_min(F.transform("cells", lambda c: money.sheet_number(c)))
    priced = cells.withColumn("min_price", lowest).withColumn("sale_price", F.coalesce(F.when(F.col("row_number") > 2, F.col("min_price")), F.col("sale_price")))
    gap = F.col("sale_price") - F.col("cost_price")
    return priced.withColumn("gap_value", gap).withColumn("gap_percent", F.when(F.col("cost_price") > 0, gap / F.col("cost_price")))


STORED = "sheet_name string, row_number int, cells array<string>, sale_price bigint, cost_price bigint, min_price bigint, gap_value bigint, gap_percent double"


def stored_rows(spark: SparkSession, path: str) -> VersionedTable:
    """The sheets' rows as they stand, changed under their readers."""
    return VersionedTable(spark, path, STORED, ("sheet_name", "row_number"))


def write_back(spark: SparkSession, path: str, changes: DataFrame) -> int:
    """Put new market prices (sheet_name, row_number, market_prices) into the stored rows, recomputed as ``upsert`` says; the version."""
    return stored_rows(spark, path).upsert(changes.select("sheet_name", "row_number", "market_prices"), upsert)


def set_sale_prices(stored: DataFrame, changes: DataFrame) -> DataFrame:
    """The stored rows after single sale prices were set (``changes``: sheet_name, row_number, price; the highest of several for a row).

    The gap and its share of the cost follow from the new price where the cost is known, as the sheet's formulas work them out.
    Rows without a change, and the two protected ones, stay as they are.
    """
    new = changes.groupBy("sheet_name", "row_number").agg(F.max("price").alias("new"))
    joined = stored.join(new, ["sheet_name", "row_number"], "left")
    given = F.col("new").isNotNull() & (F.col("row_number") > 2)
    gap = F.col("new") - F.col("cost_price")
    after = {"sale_price": F.col("new"), "gap_value": gap, "gap_percent": F.when(F.col("cost_price") > 0, gap / F.col("cost_price"))}
    return joined.withColumns({name: F.when(given, value).otherwise(F.col(name)) for name, value in after.items()}).drop("new")


def update_log(changes: DataFrame, at: str | None = None) -> DataFrame:
    """The five cells of the update log for each change (brand, model, price, status); append them to the log's table. ``at``: a timestamp, now if None."""
    stamp = F.date_format(F.lit(at).cast("timestamp") if at else F.current_timestamp(), "yyyy-MM-dd HH:mm:ss")
    cell = lambda c: F.coalesce(F.col(c), F.lit(""))
    return changes.select(stamp.alias("timestamp"), cell("brand").alias("brand"), cell("model").alias("model"), F.col("price").cast("bigint").alias("price"), cell("status").alias("status"))


def last_filled_row(rows: DataFrame, column: str) -> Column:
    """The last row with something in ``column``, 2 at least; an aggregate expression."""
    return F.greatest(F.lit(2), F.coalesce(F.max(F.when(F.trim(F.coalesce(F.col(column), F.lit(""))) != "", F.col("row_number"))), F.lit(2)))
