"""Texts met with the models that they may speak of, through the rarest key of each form of a model.

A text that names a model holds one of its forms whole: its normal form, all its digits, or its longest segment. So it
holds every run of digits and every three letters of that form. Of these the one that fewest texts hold is the form's
key, and a form of which some piece is in no text is left out. Frequent keys are split: their texts are dealt over
several groups, and only their models are copied.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.functions import matching
from marketloom.functions.base import let
from marketloom.functions.text import normalize_model
from marketloom.session import stored

#: Texts of a key in one group at least, and keys that are split at most: with more rows the groups grow, so the list of split keys stays small.
GROUP_TEXTS, SPLIT_KEYS = 10_000, 10_000


def pieces(form: Column) -> Column:
    """Runs of digits and every three letters of a normal form."""
    three = F.transform(F.sequence(F.lit(1), F.length(form) - 2), lambda i: F.substring(form, i, F.lit(3)))
    return F.array_distinct(F.concat(F.regexp_extract_all(form, F.lit("[0-9]+"), F.lit(0)), F.when(F.length(form) >= 3, three).otherwise(F.array().cast("array<string>"))))


def candidate_pairs(texts: DataFrame, models: DataFrame) -> DataFrame:
    """(text_id, model_id): pairs among which all matches are, each once. ``texts``: text_id, text; ``models``: model_id, model.

    A model without digits and with fewer than three letters has no key and meets nothing; nor do null texts and models.
    """
    held = stored(texts.select("text_id", F.explode(matching.blocking_keys(F.col("text"))).alias("key")), "text-keys")
    frequency = stored(held.groupBy("key").agg(F.count("*").alias("n_texts")), "key-counts")
    total = frequency.agg(F.coalesce(F.sum("n_texts"), F.lit(0))).first()[0]
    group = max(GROUP_TEXTS, total // SPLIT_KEYS + 1)  # no more than SPLIT_KEYS keys can have that many texts
    split = frequency.where(F.col("n_texts") > group).select("key", F.ceil(F.col("n_texts") / group).cast("int").alias("groups"))

    digits = let(normalize_model(F.col("model")), lambda m: F.regexp_replace(m, "[^0-9]", ""))
    forms = F.array(
        F.struct(F.lit(0).alias("form"), pieces(normalize_model(F.col("model"))).alias("keys")),
        F.struct(F.lit(1).alias("form"), pieces(matching.longest_segment(F.col("model"))).alias("keys")),
        F.struct(F.lit(2).alias("form"), F.when(digits != "", F.array(digits)).otherwise(F.array().cast("array<string>")).alias("keys")),
    )
    each = models.where("model IS NOT NULL").select("model_id", F.explode(forms).alias("f")).select("model_id", "f.form", F.explode("f.keys").alias("key"))
    counted = each.join(frequency, "key", "left").groupBy("model_id", "form")
    rarest = counted.agg(F.min_by("key", F.struct("n_texts", "key")).alias("key"), F.count_if(F.col("n_texts").isNull()).alias("absent")).where("absent = 0")
    wanted = rarest.select("model_id", "key").distinct()

    known = F.broadcast(split)
    many = lambda df: df.join(known, "key", "left").withColumn("groups", F.coalesce("groups", F.lit(1)))
    dealt = many(held).select("text_id", "key", F.pmod(F.xxhash64("text_id"), F.col("groups")).cast("int").alias("part"))
    copied = many(wanted).select("model_id", "key", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("part"))
    return dealt.join(copied, ["key", "part"]).select("text_id", "model_id").distinct()


def model_join(texts: DataFrame, models: DataFrame, brand: Column | None = None) -> DataFrame:
    """(text_id, model_id) of the texts that speak of the models, by ``matching.model_match``."""
    pairs = candidate_pairs(texts, models).join(texts.select("text_id", "text"), "text_id").join(models.select("model_id", "model"), "model_id")
    return pairs.where(matching.model_match(F.col("text"), F.col("model"), F.lit("") if brand is None else brand)).select("text_id", "model_id")
