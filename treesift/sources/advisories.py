"""Published advisories in the open OSV JSON format, one row per advisory and package."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT = "struct<introduced:string,fixed:string,last_affected:string>"
RANGE = f"struct<type:string,events:array<{EVENT}>>"
OSV_RECORD = (
    "id string, aliases array<string>, summary string,"
    " database_specific struct<severity:string>,"
    " severity array<struct<type:string,score:string>>,"
    " affected array<struct<package:struct<name:string,ecosystem:string>,"
    f"ranges:array<{RANGE}>,versions:array<string>>>"
)
ADVISORY = (
    "id string, aliases array<string>, summary string, db_severity string, scores array<string>,"
    f" package string, ecosystem string, ranges array<{RANGE}>, versions array<string>"
)


def flatten_osv(records: DataFrame) -> DataFrame:
    """OSV records as advisory rows. Packages match in lower case."""
    return records.select(
        "id",
        "aliases",
        "summary",
        F.col("database_specific.severity").alias("db_severity"),
        F.transform("severity", lambda s: s["score"]).alias("scores"),
        F.explode("affected").alias("affected"),
    ).select(
        "id",
        "aliases",
        "summary",
        "db_severity",
        "scores",
        F.lower("affected.package.name").alias("package"),
        F.col("affected.package.ecosystem").alias("ecosystem"),
        F.col("affected.ranges").alias("ranges"),
        F.col("affected.versions").alias("versions"),
    )


def read_osv(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """Advisories from a folder of OSV JSON files (the bulk export layout)."""
    records = spark.read.schema(OSV_RECORD).option("multiLine", multiline).json(path)
    return flatten_osv(records)
