"""The counts-only scan summary: grouped findings, all of them unless the caller names limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treesift.functions.versions import is_valid_version, sanitise_rule_id
from treesift.model import kind_rank, severity_rank

# Fixed value: what stands for a version that is not one.
FALLBACK_VERSION = "0.0.0"


def finding_groups(findings: DataFrame) -> DataFrame:
    """Counts per rule, severity and kind."""
    return findings.groupBy(
        sanitise_rule_id(F.col("rule_id")).alias("rule_id"), "severity", "kind"
    ).agg(F.count(F.lit(1)).alias("count"))


def group_json(rule_id: Column, severity: Column, kind: Column, count: Column) -> Column:
    return F.to_json(
        F.struct(
            rule_id.alias("rule_id"),
            severity.alias("severity"),
            kind.alias("kind"),
            count.alias("count"),
        )
    )


def ranked_groups(
    groups: DataFrame,
    reserved: int = 0,
    max_groups: int | None = None,
    max_body_bytes: int | None = None,
) -> DataFrame:
    """Groups in priority order with the running body size and whether each one is kept.

    The size of a prefix only grows, so the largest prefix within the budget is exactly the rows
    whose running size fits. The window is unpartitioned on purpose: its input is the aggregated
    groups, bounded by rules x severities x kinds, never the findings. ``reserved`` is the size of
    the body around the list.
    """
    order = Window.orderBy(
        severity_rank(F.col("severity")).desc(),
        F.col("count").desc(),
        F.col("rule_id").asc(),
        kind_rank(F.col("kind")).asc(),
    )
    size = F.octet_length(group_json(*[F.col(c) for c in ("rule_id", "severity", "kind", "count")]))
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = groups.select(
        "*",
        F.row_number().over(order).cast("bigint").alias("position"),
        # A separating comma goes before every entry but the first.
        (F.sum(size + 1).over(upto) - 1 + reserved).cast("bigint").alias("body_bytes"),
    )
    kept = F.lit(True)
    if max_groups is not None:
        kept = kept & (F.col("position") <= max_groups)
    if max_body_bytes is not None:
        kept = kept & (F.col("body_bytes") <= max_body_bytes)
    return ranked.withColumn("kept", kept)


def skip_histogram(skips: DataFrame) -> DataFrame:
    return skips.groupBy("reason").agg(F.count(F.lit(1)).alias("entries"))


def is_partial(skips: DataFrame, cve_status: str) -> DataFrame:
    """One row: whether anything that matters could not be covered."""
    lookup_failed = cve_status in ("partial", "unreachable")
    return skips.agg(
        (
            F.coalesce(
                F.bool_or(F.col("reason").isin("unreadable", "unparseable", "unpinned")),
                F.lit(False),
            )
            | F.lit(lookup_failed)
        ).alias("partial")
    )


def reported_version(version: Column) -> Column:
    return F.when(is_valid_version(version), version).otherwise(F.lit(FALLBACK_VERSION))


def lookup_outcome(status: Column) -> Column:
    return (
        F.when(status == "checked", "ok")
        .when(status.isin("partial", "unreachable"), "failed")
        .when(status == "no_manifest", "skipped")
        .when(status == "skipped_offline", "offline")
    )


def timestamp_text(moment: Column) -> Column:
    """RFC 3339 in UTC with second precision."""
    return F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss'Z'")
