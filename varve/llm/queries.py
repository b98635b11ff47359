"""The queries of this subpackage: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, classifier, decontaminate, licenses, lm, neardup, packing, phrases, quality, repair, sql, sql_phrases, sql_repair, store, substrings, toxicity
from .common import cut, load, new_path

BYTE_BPE, WORD_BPE = "byte_bpe_50k.json", "word_bpe_49k.json"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table; one too small to be read by half of the cores is dealt out to all."""
    docs, cores = load(spark, sf_dir, "documents"), spark.sparkContext.defaultParallelism
    return docs.repartition(cores) if 2 * docs.rdd.getNumPartitions() <= cores else docs


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    labels = load(spark, sf_dir, "labels").select("doc_id", "toxic").where(~toxicity.held_out())
    return toxicity.score(docs, toxicity.fit(docs, labels)).withColumn("held_out", toxicity.held_out())


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    vocab = lm.vocabulary(docs)
    return lm.score(docs, vocab, lm.train(docs, vocab))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.repeats(documents(spark, sf_dir))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(documents(spark, sf_dir), public_tokenizers.path(BYTE_BPE))
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def op5_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(documents(spark, sf_dir), size=2, percent=80)


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.hits(documents(spark, sf_dir), load(spark, sf_dir, "benchmark"), size=10).drop("items")


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    same = f"{chat.END}{chat.START}assistant ok"
    extra = spark.createDataFrame([(-1, 0, "user", same), (-1, 1, "assistant", same)], "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.format_records(chat.as_records(rows.unionByName(extra), ("messages", "conversations", "turns"))))


def op8_content_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "store")
    store.write(documents(spark, sf_dir), path, public_tokenizers.path(WORD_BPE))
    return store.read(spark, path).withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir), licenses.default_templates(spark))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.measures(documents(spark, sf_dir))


def op11_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    labels = load(spark, sf_dir, "labels").select("doc_id", "quality").where(~toxicity.held_out())
    return classifier.score(docs, classifier.fit(docs, labels)).withColumn("held_out", toxicity.held_out())


def op12_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mine(documents(spark, sf_dir))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = repair.damage(load(spark, sf_dir, "conversations"))
    return repair.digests(rows, cut(spark, repair.audits(repair.signatures(rows)), "audits"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    all_queries = (op1_toxicity, op2_lm_score, op3_substring_dedup, op4_packing, op5_minhash_dedup, op6_decontaminate, op7_chat_format, op8_content_store, op9_license_scan, op10_quality_rules, op11_quality_classifier, op12_phrase_mining, op13_conversation_repair)
    return {f.__name__: f for f in all_queries}


def oracle_sql() -> dict[str, str]:
    """Of the operators that SQL expresses; tests/llm compares the others with brute force."""
    return {"op5_minhash_dedup": sql.OP5, "op6_decontaminate": sql.OP6, "op7_chat_format": sql.OP7, "op9_license_scan": sql.OP9, "op10_quality_rules": sql.OP10, "op12_phrase_mining": sql_phrases.OP12, "op13_conversation_repair": sql_repair.OP13}
