"""The dealt operators as registered queries: name -> (spark, sf_dir) -> DataFrame, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import scratch, stored, table
from tessera.llm.compression_quality import quality
from tessera.llm.decontamination import decontaminate
from tessera.llm.hard_negatives import hard_negatives
from tessera.llm.hmm_lm import score_documents
from tessera.llm.order_minhash import as_text, with_edits, with_next
from tessera.llm.packing import pack
from tessera.llm.quality_rules import quality_rules
from tessera.llm.sharding import shard_documents
from tessera.llm.simhash import near_duplicates
from tessera.llm.token_alignment import align, with_link_counts
from tessera.llm.token_binary import read_tokens, write_tokens
from tessera.llm.token_counts import token_counts
from tessera.llm.toxicity import toxicity


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_hmm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    write_tokens(table(spark, sf_dir, "documents"), path := scratch(spark, "tokens"))
    return read_tokens(spark, path)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(stored(token_counts(table(spark, sf_dir, "documents")).select("doc_id", "n_tokens"), "lengths"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, odd = table(spark, sf_dir, "embeddings"), F.col("vec_id") % 7 == 0
    moved = rows.withColumn("label", F.when(odd, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives(moved, F.col("vec_id") % 100 == 0)


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = F.col("groups")
    aligned = align(table(spark, sf_dir, "documents")).withColumn("groups_sha256", F.when(groups == "", "").otherwise(F.sha2(groups, 256))).drop("groups")
    return with_link_counts(aligned)


def op13_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = with_edits(table(spark, sf_dir, "documents")).withColumn("edited_sha256", F.sha2("edited", 256)).drop("edited")
    out = with_next(stored(marked, "fingerprints"))
    return out.withColumns({c: as_text(F.col(c)) for c in ("fingerprint", "edited_fingerprint")})


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_decontamination, op3_quality_classifier, op4_hmm_scoring, op5_token_counts, op6_quality_rules, op7_token_binary, op8_simhash, op9_sharding, op10_packing, op11_hard_negatives, op12_token_alignment, op13_order_minhash)}
ORACLES: dict[str, str] = {
    "op11_hard_negatives": "WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS y, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0), s AS (SELECT a.vec_id AS anchor_id, r.vec_id AS id, a.y = r.y AS same, CAST(list_inner_product(a.e, r.e) AS BIGINT) AS score FROM v a JOIN v r ON a.vec_id <> r.vec_id WHERE a.vec_id % 100 = 0), p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5) SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INT) AS rank, id AS negative_id, positive_score, score AS negative_score FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) QUALIFY row_number() OVER w <= 5"
}
