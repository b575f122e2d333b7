"""Registered queries of this subpackage and their SQL checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wardlake.llm import chat, contamination, digests, lines, minhash, mixing, packing, sharding, toxicity, tries, urls, warc, whitening

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, check: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if check is not None:
            CHECKS[name] = check
        return fn

    return register


@query("op7_decontaminate")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op10_fingerprint")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests.against_neighbours(table(spark, sf_dir, "documents"))


@query("op3_line_dedup", lines.JUDGED_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.judged(table(spark, sf_dir, "documents"))


@query("op8_shard")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.byte_shards(table(spark, sf_dir, "documents"))


@query("op5_pack")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.judged(table(spark, sf_dir, "documents"))


@query("op2_warc", warc.ROUND_TRIP_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


@query("op6_chat_format", chat.JUDGED_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.judged(table(spark, sf_dir, "conversations"))


@query("op9_url_filter")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judged(table(spark, sf_dir, "pages"))


@query("op4_toxicity")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op1_near_dedup")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), k=4)


@query("op13_mix_sources", mixing.MIXED_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"))


@query("op12_prefix_trie", tries.TRIE_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tries.shared_head_trie(table(spark, sf_dir, "conversations"))


@query("op11_whiten")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.judged(table(spark, sf_dir, "embeddings"))
