"""The queries that apply the operators to their whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from voxmill.llm import ann, chat, jaccard, lines, minhash, mixing, packing, runs, substrings, topk, toxicity, trie, urls
from voxmill.session import checkpoint


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.preference_query(table(spark, sf_dir, "conversations"))


def op4_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


def op5_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.passage_groups(checkpoint(substrings.repeated_passages(table(spark, sf_dir, "documents"))))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op7_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"))


def op8_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "deleted_lines", "text")


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op11_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.joined_documents(table(spark, sf_dir, "documents"))


def op12_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.trie_query(table(spark, sf_dir, "conversations"))


def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.digests(runs.periodic_runs(runs.with_planted_tails(table(spark, sf_dir, "documents"))))


QUERIES = {f.__name__: f for f in (op1_packing, op2_toxicity, op3_chat, op4_urls, op5_substrings, op6_mixing, op7_ann, op8_lines, op9_minhash, op10_topk, op11_jaccard, op12_trie, op13_runs)}
ORACLE_SQL = {"op9_minhash": minhash.ORACLE, "op3_chat": chat.ORACLE, "op10_topk": topk.ORACLE, "op11_jaccard": jaccard.ORACLE, "op12_trie": trie.ORACLE}
