"""The queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treesift.llm.host_reputation import Rule
from treesift.llm.oracle import best_products, filter_interactions, host_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

WORDS = "word_bpe_49k.json"
RANKS = "byte_bpe_50k.tiktoken"
END_ID = 1
URL_RULES = [
    Rule("allow", "com/"),
    Rule("block", "example.com/en/"),
    Rule("allow", "www.example.com/en/"),
    Rule("block", "net/es/"),
    Rule("block", "net/fr/"),
]
ORACLE["op2_url_filter"] = host_filter(URL_RULES)
ORACLE["op11_filter_audit"] = filter_interactions()
ORACLE["op13_topk_search"] = best_products()


def repeated_tail(doc_id: int | None, n: int):
    """The word order of the periodicity query: a tenth of the ids repeat a stretch to their end."""
    digest = zlib.crc32(str(doc_id).encode())
    if doc_id is None or digest % 10 or not n:
        return None
    rest = digest // 10
    first = rest % n
    period = 1 + (n - first) // (3 + rest % 8)
    places = np.arange(n)
    places[first:] = first + (places[first:] - first) % period
    return places


def query(name: str):
    def register(fn):
        QUERIES[name] = fn
        return fn

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


@query("op4_packing")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    from treesift.llm.packing import packed

    found = packed(table(spark, folder, "documents"), public_tokenizers.path(WORDS), END_ID)
    return found.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


@query("op7_token_files")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    from treesift.llm.token_files import digests, token_files

    tokens = token_files(table(spark, folder, "documents"), public_tokenizers.path(WORDS), END_ID)
    return digests(tokens).select("doc_id", "start", "n_tokens", "ids_crc32")


@query("op10_token_counts")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    from treesift.llm.token_counts import token_counts

    return token_counts(
        table(spark, folder, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN, rule="largest"
    )


@query("op8_language_id")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    from treesift.llm import language_id
    from treesift.llm.common import crc_of_id

    docs = table(spark, folder, "documents")
    held = F.coalesce(crc_of_id(F.col("doc_id")) % 4 == 2, F.lit(False))
    model = language_id.fit(docs, ~held & F.col("doc_id").isNotNull())
    found = language_id.predict(docs, model)
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score", "rejected")


@query("op1_toxicity")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    from treesift.llm import toxicity
    from treesift.llm.common import crc_of_id

    docs = table(spark, folder, "documents")
    remainder = crc_of_id(F.col("doc_id")) % 5
    learn = crc_of_id(F.col("id")) % 5 != 0
    model = toxicity.fit(docs, table(spark, folder, "labels"), learn)
    found = toxicity.score(docs, model)
    return found.select(
        "doc_id",
        F.coalesce(remainder == 0, F.lit(False)).alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
    )


@query("op9_near_dedup")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    from treesift.llm.near_dedup import near_duplicates

    return near_duplicates(table(spark, folder, "documents"))


@query("op6_decontamination")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    from treesift.llm.decontamination import leaks

    found = leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.where("leaked").drop("leaked")


@query("op5_embedding_dedup")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    from treesift.llm.embedding_dedup import embedding_duplicates

    return embedding_duplicates(table(spark, folder, "embeddings"))


@query("op2_url_filter")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    from treesift.llm.host_reputation import judged

    labels = table(spark, folder, "labels")
    bad = F.when((F.col("toxic") == 1) | (F.col("quality") == 0), 1).otherwise(0)
    outcomes = labels.where("toxic is not null or quality is not null")
    outcomes = outcomes.select(F.col("doc_id").alias("page_id"), bad.alias("bad"))
    return judged(table(spark, folder, "pages"), outcomes, URL_RULES)


@query("op3_licence_scan")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    from treesift.llm import licence_scan

    docs = table(spark, folder, "documents")
    return licence_scan.scan(docs, licence_scan.fit(docs))


@query("op12_periodic_runs")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    from treesift.llm.periodic_runs import periodic_runs

    found = periodic_runs(table(spark, folder, "documents"), reorder=repeated_tail)
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


@query("op13_topk_search")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    from treesift.llm.topk_search import top_k

    return top_k(table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0)


@query("op11_filter_audit")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    from treesift.llm.filter_audit import audit

    return audit(table(spark, folder, "documents"), table(spark, folder, "labels"))
