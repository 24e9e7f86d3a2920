"""Registered queries of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausegrid.llm.storage import new_folder
from clausegrid.llm import (
    byte_bpe, checksql, decontamination, jaccard, languages, line_dedup, packing, prefix_trie, quality_model, quality_rules, secrets, tokens, turn_repair, urls,
)

QUERIES = {}
CHECKS = {}


def query(name: str, check: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if check:
            CHECKS[name] = check
        return fn

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op1_token_counts")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.token_counts(table(spark, folder, "documents"))


@query("op4_best_fit_packing")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"))


@query("op2_secret_scans", secrets.SQL)
def op2(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return secrets.digest(docs, findings=secrets.update_ledger(docs, new_folder(docs, "ledger")))


@query("op9_url_filters")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return urls.judge(table(spark, folder, "pages"))


@query("op10_quality_rules")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return quality_rules.judge(docs, quality_rules.fit(docs, table(spark, folder, "labels")))


@query("op6_language_id")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    held_out = languages.in_fold("doc_id", 4, 2)
    model = languages.fit(docs.filter(~held_out))
    return languages.predict(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", F.to_json("languages").alias("languages"))


@query("op8_quality_classifier")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    held_out = languages.in_fold("doc_id", 3, 1)
    vectors = quality_model.word_vectors(docs)
    network = quality_model.fit(docs, labels.filter(~held_out), vectors)
    return quality_model.score(docs, vectors, network).select("doc_id", held_out.alias("held_out"), "score", F.col("predicted"))


@query("op5_line_dedup", line_dedup.SQL)
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return line_dedup.remove_lines(table(spark, folder, "documents")).select("doc_id", "n_lines_removed", "text")


@query("op7_benchmark_decontamination")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return decontamination.matches(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op3_ngram_jaccard_join")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.join(table(spark, folder, "documents"))


@query("op13_byte_bpe")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return byte_bpe.digest(table(spark, folder, "documents"))


@query("op11_prefix_trie", checksql.TRIE)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie.trie(table(spark, folder, "conversations"))


@query("op12_turn_repair", checksql.repair(turn_repair.AFTER))
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return turn_repair.audit(table(spark, folder, "conversations"))
