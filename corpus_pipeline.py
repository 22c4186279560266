"""The corpus pipeline: five stages, each written as Parquet and reread as the next one's documents.

Models are trained on labelled rows among the documents that a stage is given: languages by their
``lang``, toxicity by the table ``labels``. Each stage but the last keeps or drops whole documents and
returns the columns it was given; the last returns the pieces of :mod:`treesift.llm.packing`.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treesift.llm import decontamination, language_id, near_dedup, packing, queries, toxicity
from treesift.llm.common import shared_folder


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: documents whose language is rejected go.

    Null texts and texts without a letter are rejected. Long texts are read whole. Rows that repeat or tie
    are judged alike; without a labelled row every document goes. An empty table stays empty.
    """
    model = language_id.fit(docs, F.col("doc_id").isNotNull())
    return language_id.known_languages(docs, model)


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: documents that score 0.5 or more go.

    Null and empty texts have the score of no evidence. Long texts are read whole; a score of exactly 0.5 goes.
    Repeated rows are judged alike; without labels of both kinds every document stays. Empty tables stay empty.
    """
    model = toxicity.fit(docs, queries.table(spark, sf_dir, "labels"), F.lit(True))
    return toxicity.without_toxic(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: the document with the smallest id of each group stays; links from a similarity of 0.8.

    Null and empty texts and null ids are linked with nothing and stay. Of rows that repeat id and text one
    stays, of rows that repeat an id with other texts each that is kept. Long texts are compared whole.
    """
    return near_dedup.one_of_each(docs, percent=80)


def not_leaked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: documents that hold a test item go.

    Null and empty texts hold none and stay; every passage of a long text is asked for. Repeated rows are judged
    alike; an empty benchmark removes nothing.
    """
    return decontamination.without_leaks(docs, queries.table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: every piece of every document, with its place in a sequence of at most 2048 tokens.

    Null and empty texts are the end id alone; long texts are cut. Repeated rows and ids are packed apart. An
    empty table gives no piece.
    """
    return packing.packed(docs, public_tokenizers.path(queries.WORDS), queries.END_ID)


STAGES = [
    ("language", known_language),
    ("toxicity", not_toxic),
    ("near_duplicates", near_duplicates),
    ("decontamination", not_leaked),
    ("packing", packed),
]

# Classifiers, minhashes and tokenizers have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_folder(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
