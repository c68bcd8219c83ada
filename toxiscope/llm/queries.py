"""The registered queries of the numbered operators, over their whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from toxiscope.llm import collocations, conversation_trie, decontamination, embedding_dedup, exact_dedup, jaccard_join, language_id, license_scan, line_dedup, passage_dedup, pii, sentencepiece_codec, token_count, toxicity
from toxiscope.sources.tables import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def tokenizer_file(name: str) -> str:
    """Place of a public tokenizer's file; the folder is a parameter of the machines, never of the repository."""
    import public_tokenizers

    return public_tokenizers.path(name)


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return register


@query("op2_line_dedup", line_dedup.ORACLE)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedupe_lines(docs)


@query("op5_exact_dedup", exact_dedup.ORACLE)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedupe(read_table(spark, sf_dir, "documents")).drop("n_chunks")


@query("op9_license_scan")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(read_table(spark, sf_dir, "documents"))


@query("op10_token_counts")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(read_table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


@query("op7_language_id")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(read_table(spark, sf_dir, "documents"))


@query("op6_toxicity")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


@query("op4_benchmark_decontamination")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


@query("op8_pii")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(read_table(spark, sf_dir, "documents"))


@query("op3_sentencepiece")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.round_trip(read_table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


@query("op1_jaccard_join")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(read_table(spark, sf_dir, "documents"))


@query("op2_passage_dedup")
def op2_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passage_dedup.dedupe_passages(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op13_conversation_trie", conversation_trie.ORACLE)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.branched_trie(read_table(spark, sf_dir, "conversations"))


@query("op12_embedding_dedup")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_copies(read_table(spark, sf_dir, "embeddings"))


@query("op11_collocations", collocations.ORACLE)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.best(collocations.mine(read_table(spark, sf_dir, "documents")))
