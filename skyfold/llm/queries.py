"""The registered queries of the subpackage and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from skyfold.llm import chat, lexical, licenses, neardup, neighbours, packing, phrases, pieces, quality, rules, sharding, suffixes, warc
from skyfold.llm.common import table


def op1_warc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_and_read(table(spark, sf_dir, "pages"))


def op2_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trip_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op4_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.class_of_documents(table(spark, sf_dir, "documents"))


def op6_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"))


def op7_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return neighbours.search(vectors, vectors.where("vec_id % 100 = 0"))


def op8_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.verdicts(rules.ledger(table(spark, sf_dir, "documents")))


def op9_tree_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(
        table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, added=packing.ADDED_TOKENS
    )


def op10_suffix_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.digests(table(spark, sf_dir, "documents"))


def op11_setm_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op12_dual_tree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_chat_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    rows = chat.with_example(table(spark, sf_dir, "conversations"))
    return chat.digests(chat.format_conversations(rows, *vocabulary), *vocabulary)


QUERIES = {
    f.__name__: f
    for f in (
        op1_warc_chunks, op2_piece_codec, op3_license_scan, op4_compression_quality, op5_order_minhash, op6_hilbert_shards,
        op7_multi_index, op8_rule_ledger, op9_tree_packing, op10_suffix_arrays, op11_setm_phrases, op12_dual_tree_search,
        op13_chat_masks,
    )
}

ORACLES = {
    "op1_warc_chunks": warc.ORACLE_SQL, "op8_rule_ledger": rules.ORACLE_SQL, "op11_setm_phrases": phrases.ORACLE_SQL,
    "op12_dual_tree_search": lexical.ORACLE_SQL, "op13_chat_masks": chat.ORACLE_SQL,
}
