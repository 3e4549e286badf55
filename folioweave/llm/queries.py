"""The queries of this subpackage, by name, and their SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioweave.llm import codes, decontam, mixing, negatives, oracles, pii, quality, search, secrets, sharding, simhash, spans, substrings, tokens, toxicity
from folioweave.llm.common import table

TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document whose id is divisible by 50, as a query by its whole text, against all documents."""
    docs = table(spark, sf_dir, "documents")
    queries = docs.where("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), "text")
    return search.search(search.build_index(docs), queries)


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_documents(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substrings.remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), F.col("longest").alias("longest_repeat"))


def op4_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_output(table(spark, sf_dir, "documents"), tokenizer_path())


def _digests(found: DataFrame, kinds: list[spans.Kind]) -> DataFrame:
    counts = [spans.count(F.col("base"), kind.name).alias(f"n_{kind.name}") for kind in kinds]
    return found.select("doc_id", *counts, F.sha2(spans.joined(F.col("base")), 256).alias("base_sha256"), spans.joined(F.col("spans")).alias("spans"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digests(pii.find_pii(table(spark, sf_dir, "documents")), pii.KINDS)


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digests(secrets.find_secrets(table(spark, sf_dir, "documents")), secrets.KINDS)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.hard_negatives(negatives.of_embeddings(table(spark, sf_dir, "embeddings")))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compress(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_search, op2_sharding, op3_substrings, op4_token_ids, op5_pii, op6_secrets, op7_decontamination, op8_simhash, op9_mixing, op10_toxicity, op11_quality, op12_hard_negatives, op13_vector_codes)}

ORACLES: dict[str, str] = oracles.ORACLES
