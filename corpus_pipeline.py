"""The corpus pipeline: toxicity filter, near-duplicate removal, repeated-passage removal, surrogates, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, written as Parquet and read again for the next one.
All but the last return the columns of ``documents`` and drop others, whatever their names. What the operators say of
null ids and texts, empty and long texts, and empty tables holds for the stages. Rows that repeat an id are one
document: they stay or go together in the first two stages, so two rows with one id and text both stay, and neither
removes the other's passages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.llm import minhash, packing, pii, substring_dedup, toxicity
from marketloom.llm.common import written
from marketloom.llm.queries import DEMO_KEY

#: The setting of the session that names the surrogates' key; a deployment sets its own secret, and without one the public key of the tests serves.
KEY_SETTING = "spark.marketloom.surrogateKey"
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score under 0.5; a null text has the score of one without any listed word. The lexicon is learned from the input's labelled rows."""
    lexicon = toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs.select(*COLUMNS), lexicon).where("toxic_score < 0.5").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id. Texts without words, and rows without an id, stay."""
    gone = minhash.near_duplicates(docs).where(~F.col("kept")).select("doc_id")
    return docs.select(*COLUMNS).join(gone, "doc_id", "left_anti").select(*COLUMNS)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that occur earlier; untouched texts keep their white space."""
    kept = substring_dedup.remove_repeats(docs.select(*COLUMNS))
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    return kept.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with surrogates for personal data, after a check that no two entities of the input share one; null texts stay null."""
    masked = pii.pseudonymise(docs.select(*COLUMNS), spark.conf.get(KEY_SETTING, DEMO_KEY))
    return masked.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in training sequences; a null or empty text is one piece, of its end id."""
    return packing.pack(docs).drop("ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("substring_dedup", drop_repeated_passages),
    ("surrogates", replace_personal_data),
    ("packing", pack_sequences),
]

#: SQL can't express the first stage's learned scores or the last one's tokenizer; tests hold the stages to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
