"""The per-file analysers over files that keep arriving.

Every analyser is a function of one file, so the same projections run on a streaming table
without state. Rules with relations between functions run per micro-batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from treesift.functions.text import utf8
from treesift.plans.scan import Scan, config_findings, scan_files, stages


def config_stream(files: DataFrame) -> DataFrame:
    """Findings of configuration files (``path``, ``content``) as a streaming table."""
    texts = files.where(F.array_contains(stages(), "config")).select("path", utf8(F.col("content")).alias("text"))
    return config_findings(texts.where("text IS NOT NULL"))


def scan_stream(
    files: DataFrame, sink: Callable[[Scan, int], None], checkpoint: str, **settings
) -> StreamingQuery:
    """Scan every micro-batch in full and hand its tables to ``sink`` with the batch number.

    The number makes the sink idempotent: a batch that is repeated after a failure has the same
    files and the same number.
    """

    def run(batch: DataFrame, number: int) -> None:
        sink(scan_files(batch, **settings), number)

    return (
        files.writeStream.foreachBatch(run)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
