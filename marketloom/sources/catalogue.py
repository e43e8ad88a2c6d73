"""The store catalogue: products with variants, as rows of brand, model and id; and price updates for it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.functions import text
from marketloom.operators import relational
from marketloom.sources.versions import VersionedTable

SCHEMA = "products array<struct<title:string,vendor:string,variants:array<struct<id:bigint,sku:string,barcode:string>>>>"


def read(spark: SparkSession, path: str) -> DataFrame:
    """Captured pages of the catalogue, one JSON document for each; all of them are read, an empty one adds nothing."""
    return spark.read.schema(SCHEMA).option("multiLine", True).json(path)


def variants(pages: DataFrame) -> DataFrame:
    """(product_name, brand, model, variant_id): one row for each variant."""
    products = pages.select(F.explode("products").alias("p")).select("p.title", "p.vendor", F.explode("p.variants").alias("v"))
    brand = text.detect_brand(F.col("vendor"), F.col("title"))
    model = text.extract_model(F.col("v.sku"), F.col("v.barcode"), F.col("title"), brand)
    return products.select(F.col("title").alias("product_name"), brand.alias("brand"), model.alias("model"), F.col("v.id").alias("variant_id"))


ID_SHEET = "product_name string, brand string, model string, variant_id bigint"


def id_sheet(spark: SparkSession, path: str) -> VersionedTable:
    """The sheet of variants' ids, replaced as a whole under its readers."""
    return VersionedTable(spark, path, ID_SHEET, ("variant_id",))


def key(brand: Column, model: Column) -> Column:
    return F.concat(text.normalize_model(brand), F.lit("_"), text.normalize_model(model))


def variant_ids(rows: DataFrame, catalogue: DataFrame) -> DataFrame:
    """``rows`` (brand, model) with the id of the last variant of the same normalised brand and model."""
    known = catalogue.select(key(F.col("brand"), F.col("model")).alias("key"), "variant_id")
    return relational.lookup(rows.withColumn("key", key(F.col("brand"), F.col("model"))), known, ["key"], ["variant_id"], ["variant_id"]).drop("key")


def price_updates(rows: DataFrame) -> DataFrame:
    """(variant_id, payload): a JSON document for each variant with a price; the price is its digits."""
    body = F.struct(F.struct(F.col("variant_id").alias("id"), F.regexp_replace(F.col("price").cast("string"), r"\D", "").cast("bigint").alias("price")).alias("variant"))
    return rows.where("variant_id is not null and price is not null").select("variant_id", F.to_json(body).alias("payload"))
