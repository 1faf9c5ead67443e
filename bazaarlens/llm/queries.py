"""The registered queries: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bazaarlens.llm import (
    chat,
    conversation_repair,
    decontamination,
    hard_negatives,
    language,
    mixing,
    nearest,
    packing,
    prob_minhash,
    sharding,
    tokens,
    url_filter,
    vector_links,
)
from bazaarlens.llm.staging import prepare

# Production parameters.
SEQUENCE_TOKENS, SEQUENCE_SEGMENTS, END_ID = 2048, 256, 1
PACK_TOKENIZER, COUNT_MODEL, TOKEN_LIMIT = "word_bpe_49k.json", "piece_bpe_32k.model", 4096
SHARDS, LINK_COSINE, NEIGHBOURS = 8, 0.93, 10
#: Host, path and verdict of the rules.
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
#: Fixed value: what both turns of conversation -1 say.
CONTROL_TEXT = "</s>[INST] ok [/INST]"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _binary(text: str) -> Column:
    return F.coalesce(F.col(text), F.lit("")).cast("binary")


def packed_documents(documents: DataFrame) -> DataFrame:
    """The pieces of all documents with their place in a sequence, and their ids (little-endian 32-bit)."""
    pieces = packing.token_pieces(documents, PACK_TOKENIZER, END_ID, SEQUENCE_TOKENS)
    pieces = pieces.withColumn("loss", F.col("length"))
    packed = packing.pack(pieces, SEQUENCE_TOKENS, SEQUENCE_SEGMENTS, SEQUENCE_TOKENS)
    digest = F.crc32("ids").alias("ids_crc32")
    return packed.select("doc_id", "start", "length", digest, "doc_tokens", "sequence_id", "offset", "ids")


def op1_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_documents(_table(spark, sf_dir, "documents")).drop("ids")


def op2_vector_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_links.link_vectors(_table(spark, sf_dir, "embeddings"), LINK_COSINE)


def op3_hypergeometric_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.shuffle_into_shards(_table(spark, sf_dir, "documents").select("doc_id", "text"), SHARDS)
    size = (F.length(_binary("row.text")) + 1).cast("long").alias("size")
    none = F.lit(None).cast("int").alias("grown_shard")
    return rows.select(
        "row.doc_id", size, F.crc32(_binary("row.text")).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", none
    )


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(_table(spark, sf_dir, "documents"), COUNT_MODEL, TOKEN_LIMIT)


def op5_redirect_equivalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_table(spark, sf_dir, "pages"), RULES)


def op6_low_discrepancy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken_words(mixing.mix(_table(spark, sf_dir, "documents")))


def op7_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, NEIGHBOURS)


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(CONTROL_TEXT).alias("text"),
    )
    return chat.read_back(chat.format_conversations(turns.union(extra)))


def op9_prob_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prob_minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op10_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(_table(spark, sf_dir, "documents"))


def op11_parallel_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    repaired = conversation_repair.repair(conversation_repair.damage(turns), turns.select("conv_id"))
    return conversation_repair.audits(repaired)


def op12_item_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_vertical_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = _table(spark, sf_dir, "embeddings").withColumn("label", moved)
    return hard_negatives.mine(vectors, F.col("vec_id") % 100 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_vector_packing,
        op2_vector_links,
        op3_hypergeometric_shards,
        op4_token_counts,
        op5_redirect_equivalence,
        op6_low_discrepancy_mix,
        op7_nearest_vectors,
        op8_chat_format,
        op9_prob_minhash,
        op10_language_mixture,
        op11_parallel_viterbi,
        op12_item_automaton,
        op13_vertical_scan,
    )
}
