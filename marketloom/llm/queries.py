"""The registered queries op1 to op13, each over its whole table with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.llm import alignment, chunk_bpe, compaction, conversations, exact_topk, ivf, minhash, packing, pii, piece_bpe, substring_dedup, token_counts, toxicity

#: The key of the surrogates in the registered query; a deployment passes its own secret.
DEMO_KEY = "marketloom-demo-key"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", "text")


def _sha256(column: str) -> Column:
    return F.sha2(F.col(column).cast("binary"), 256)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring_dedup.remove_repeats(_documents(spark, sf_dir))
    return kept.select("doc_id", "n_words", "n_removed", _sha256("kept_text").alias("kept_sha256"))


def op2_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = compaction.ingest_and_compact(_table(spark, sf_dir, "documents"))
    return stored.select("doc_id", "lang", "source", "n_chars", _sha256("text").alias("text_sha256"), "manifest_docs", "manifest_bytes")


def op3_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(_table(spark, sf_dir, "documents"), DEMO_KEY).select("doc_id", "text", "n_entities")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_documents(spark, sf_dir)).drop("ids")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_documents(spark, sf_dir), token_counts.new_cache(spark))


def op6_chunk_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = chunk_bpe.encode_decode(_documents(spark, sf_dir))
    n_tokens = F.floor(F.octet_length("ids") / 4).cast("long")
    return coded.select("doc_id", n_tokens.alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), _sha256("decoded").alias("decoded_sha256"))


def op7_minmax_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_documents(spark, sf_dir))


def op8_ivf_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ivf.search(vectors, F.col("vec_id") % 100 == 0, k=10)


def op9_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    weights = F.transform("embedding", lambda x: F.floor(256 * x.cast("double")))
    whole = F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    terms = vectors.select("vec_id", F.when(whole, weights).alias("weights"))
    return exact_topk.search(terms, F.col("vec_id") % 50 == 0, k=5)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    lexicon = toxicity.learn(docs, _table(spark, sf_dir, "labels"))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    scored = toxicity.score(docs, lexicon)
    return scored.select("doc_id", held_out.alias("held_out"), F.col("toxic_score").alias("score"), (F.col("toxic_score") >= 0.5).cast("int").alias("predicted"))


def op11_piece_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = piece_bpe.encode_decode(_documents(spark, sf_dir))
    n_tokens = F.floor(F.octet_length("ids") / 4).cast("long")
    return coded.select("doc_id", n_tokens.alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), _sha256("decoded").alias("decoded_sha256"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = conversations.damaged(_table(spark, sf_dir, "conversations"))
    return conversations.repair(rows, absent_col="absent").drop("repaired")


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(_documents(spark, sf_dir))


QUERIES = {
    f.__name__: f
    for f in (
        op1_substring_dedup, op2_compaction, op3_surrogates, op4_packing, op5_token_counts, op6_chunk_bpe, op7_minmax_dedup, op8_ivf_search, op9_exact_topk, op10_toxicity, op11_piece_bpe,
        op12_conversation_repair, op13_alignment,
    )
}

ORACLES = {
    "op1_substring_dedup": r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (
  SELECT doc_id, s, array_to_string(w[s:s + 19], ' ') AS k
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS s FROM words WHERE len(w) >= 20)),
again AS (
  SELECT doc_id, s FROM windows
  QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, s) > 1),
covered AS (
  SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS p FROM again),
gone AS (SELECT doc_id, list(p) AS ps FROM covered GROUP BY doc_id),
kept AS (
  SELECT words.doc_id, len(w) AS n_words, len(coalesce(ps, [])) AS n_removed,
         CASE WHEN ps IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(ps, i)) END AS k
  FROM words LEFT JOIN gone USING (doc_id))
SELECT doc_id, n_words, n_removed, sha256(array_to_string(k, ' ')) AS kept_sha256 FROM kept""",
    "op2_compaction": """
SELECT doc_id, lang, source, n_chars, sha256(text) AS text_sha256, t.manifest_docs, t.manifest_bytes
FROM documents, (SELECT count(*)::BIGINT AS manifest_docs, coalesce(sum(strlen(text)), 0)::BIGINT AS manifest_bytes FROM documents) t""",
    "op9_exact_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS w FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.w, c.w), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
}
