"""From raw findings to a report: merge, dedupe, count, filter, order, number, gate.

Every step is an aggregation with a map-side combine or a range-partitioned sort; none of them
brings a file's, a rule's or the whole report's findings together in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treesift.dimensions import CATEGORIES, CROSS_LAYER_RANK, SECTIONS, SKIP_REASONS
from treesift.model import (
    FINDING_FIELDS,
    SEVERITIES,
    confidence_rank,
    kind_rank,
    severity_rank,
)
from treesift.session import written

# The order analysers run within a file; it decides which duplicate survives.
ANALYSERS = ("rules", "mcp", "container", "instruction", "skill", "dotenv", "pins", "advisories")


def _whole(df: DataFrame) -> Column:
    return F.struct(*df.columns)


def _unpack(df: DataFrame, column: str, names: list[str]) -> DataFrame:
    return df.select(*[F.col(f"{column}.{name}").alias(name) for name in names])


def merge_same_location(findings: DataFrame) -> DataFrame:
    """One rule-engine finding per location; the others' ids become secondary ids.

    Best first: defects, then severity, then confidence, then the lowest rule id. Ids collected
    per location are bounded by the number of rules.
    """
    best = F.struct(
        kind_rank(F.col("kind")),
        -severity_rank(F.col("severity")),
        -confidence_rank(F.col("confidence")),
        F.col("rule_id"),
    )
    merged = findings.groupBy("location").agg(
        F.min_by(_whole(findings), best).alias("f"),
        F.collect_set("rule_id").alias("ids"),
    )
    names = findings.columns
    return merged.select(
        *[
            (
                F.array_sort(F.array_except("ids", F.array("f.rule_id"))).alias(name)
                if name == "secondary_rule_ids"
                else F.col(f"f.{name}").alias(name)
            )
            for name in names
        ]
    )


def dedupe(findings: DataFrame, order: list[str]) -> DataFrame:
    """The first finding per rule, location and title, in the given order of appearance."""
    first = findings.groupBy("rule_id", "location", "title").agg(
        F.min_by(_whole(findings), F.struct(*order)).alias("f")
    )
    return _unpack(first, "f", findings.columns)


def counts(findings: DataFrame) -> DataFrame:
    """Defects and observations, counted before observations are hidden."""
    return findings.agg(
        F.count_if(F.col("kind") == "defect").alias("defects"),
        F.count_if(F.col("kind") == "observation").alias("observations"),
    )


def visible(findings: DataFrame, include_observations: bool) -> DataFrame:
    return findings if include_observations else findings.where(F.col("kind") == "defect")


def report_order() -> list[Column]:
    return [
        kind_rank(F.col("kind")).asc(),
        severity_rank(F.col("severity")).desc(),
        confidence_rank(F.col("confidence")).desc(),
        F.col("location").asc(),
        F.col("rule_id").asc(),
        F.col("title").asc(),
    ]


def ordered(findings: DataFrame) -> DataFrame:
    return findings.orderBy(*report_order())


def numbered(findings: DataFrame, order: list[Column] | None = None, name: str = "index") -> DataFrame:
    """Findings with their 0-based position in report order.

    A window without partitions would pull everything into one task. Instead the rows are range
    sorted and written once with their partition and their place in it; the partitions' sizes (one
    row per partition) give each partition's offset.
    """
    keys = order or report_order()
    placed = written(
        findings.orderBy(*keys).select(
            "*",
            F.spark_partition_id().alias("_part"),
            F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_place"),
        ),
        "numbered",
    )
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_offset"))
    return (
        placed.join(F.broadcast(offsets), "_part")
        .withColumn(name, (F.col("_offset") + F.col("_place")).cast("bigint"))
        .drop("_part", "_place", "_offset")
    )


def section_rank(categories: Column) -> Column:
    """The smallest section of a finding's categories; none at all is cross-layer."""
    ranks = {}
    for category, _, _, _, section, _ in CATEGORIES:
        ranks.setdefault(section, []).append(category)
    expr = F.lit(CROSS_LAYER_RANK)
    for section in sorted(ranks, reverse=True):
        members = F.array(*[F.lit(c) for c in ranks[section]])
        expr = F.when(F.arrays_overlap(categories, members), F.lit(section)).otherwise(expr)
    return F.when(F.size(categories) == 0, F.lit(CROSS_LAYER_RANK)).otherwise(expr)


def section_name(categories: Column) -> Column:
    names = F.array(*[F.lit(s) for s in SECTIONS])
    return F.get(names, section_rank(categories))


def sections(findings: DataFrame) -> DataFrame:
    """Findings per section, severity and kind."""
    return (
        findings.groupBy(
            section_rank(F.col("categories")).alias("section_rank"),
            section_name(F.col("categories")).alias("section"),
            "severity",
            "kind",
        )
        .count()
        .withColumnRenamed("count", "findings")
    )


def gate(findings: DataFrame, fail_on: str | None = "high") -> DataFrame:
    """One row: exit code 1 when a defect reaches the threshold, else 0."""
    if fail_on is None:
        failing = F.lit(False)
    else:
        threshold = SEVERITIES.index(fail_on)
        failing = (F.col("kind") == "defect") & (severity_rank(F.col("severity")) >= threshold)
    return findings.agg(
        F.when(F.bool_or(failing), F.lit(1)).otherwise(F.lit(0)).cast("bigint").alias("exit_code")
    )


SKIP = "reason string, path string, detail string, line string"


def skip_rank(reason: Column) -> Column:
    expr = F.lit(len(SKIP_REASONS))
    for index, (name, _, _) in enumerate(SKIP_REASONS):
        expr = F.when(reason == name, F.lit(index)).otherwise(expr)
    return expr


def ordered_skips(skips: DataFrame) -> DataFrame:
    """Distinct coverage notes by their text."""
    return skips.distinct().orderBy("line", skip_rank(F.col("reason")), "detail")


def skip_sentence(reason: Column, count: Column) -> Column:
    expr = F.lit(None).cast("string")
    for name, one, many in SKIP_REASONS:
        text = F.when(count == 1, F.lit(one)).otherwise(F.format_string(many, count))
        expr = F.when(reason == name, text).otherwise(expr)
    return expr


def skip_groups(skips: DataFrame) -> DataFrame:
    """Count and sentence per reason, in declared order."""
    grouped = skips.distinct().groupBy("reason").agg(F.count(F.lit(1)).alias("entries"))
    return grouped.select(
        "reason",
        skip_rank(F.col("reason")).alias("reason_rank"),
        "entries",
        skip_sentence(F.col("reason"), F.col("entries")).alias("sentence"),
    )


def level(kind: Column, severity: Column) -> Column:
    """The result level of the static-analysis interchange format."""
    return (
        F.when(kind == "observation", "note")
        .when(severity.isin("critical", "high"), "error")
        .when(severity == "medium", "warning")
        .otherwise("note")
    )


def as_findings(df: DataFrame, column: str = "finding") -> DataFrame:
    return df.select(*[F.col(f"{column}.{name}").alias(name) for name in FINDING_FIELDS])
