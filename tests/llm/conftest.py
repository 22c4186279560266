import os

# One thread a process, as in executors; threads of a numeric library can wait for each other behind a JVM.
os.environ.setdefault("OPENBLAS_NUM_THREADS", "1")

import pytest  # noqa: E402

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text) pairs, with columns whose names clash with the operators' own."""

    def build(rows, partitions=3):
        from pyspark.sql import functions as F

        docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], SCHEMA)
        for name in ("ids", "bin", "rank", "key", "node", "score", "component", "n", "left", "words", "label"):
            docs = docs.withColumn(name, F.lit("clash"))
        return docs.repartition(partitions)

    return build


@pytest.fixture(scope="session")
def folder():
    return "/root/testdata/sf0.001"


