"""Session setup and the one place that decides where intermediate tables live."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "treesift", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the plans rely on; cluster settings win over these."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # Source texts are wide rows: small Arrow batches keep Python workers' memory flat.
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "256")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables.

    On a cluster this is ``spark.checkpoint.dir`` and must be set there. Only a local session,
    whose executors share one disk with the driver, may fall back to a temporary folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    folder = tempfile.mkdtemp(prefix="treesift-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def written(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` once and read it back: cuts lineage, survives executor loss, prunes columns.

    Used where several branches read the output of an expensive stage, so that the stage runs
    once however many branches there are. With ``partition_by`` every branch reads only its own
    folder.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/treesift-{name}-{uuid.uuid4().hex}"
    writer = df.write.partitionBy(partition_by) if partition_by else df.write
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path).select(*df.columns)
