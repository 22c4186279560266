"""The finding record, its ordered enums and the rule metadata of the fixed analysers."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Enum members in ascending order. Strings never sort in this order, hence ranks.
SEVERITIES = ("low", "medium", "high", "critical")
CONFIDENCES = ("low", "medium", "high")
KINDS = ("defect", "observation")

LOCATION = T.StructType(
    [
        T.StructField("file", T.StringType()),
        T.StructField("line", T.LongType()),
        T.StructField("column", T.LongType()),
    ]
)

# Field order is the published JSON order.
FINDING = T.StructType(
    [
        T.StructField("rule_id", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("severity", T.StringType()),
        T.StructField("confidence", T.StringType()),
        T.StructField("categories", T.ArrayType(T.StringType())),
        T.StructField("location", LOCATION),
        T.StructField("snippet", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("remediation", T.StringType()),
        T.StructField("secondary_rule_ids", T.ArrayType(T.StringType())),
        T.StructField("references", T.ArrayType(T.StringType())),
    ]
)
FINDING_FIELDS = tuple(FINDING.fieldNames())


class Rule(NamedTuple):
    """What a rule says about itself, before any file is looked at."""

    rule_id: str
    title: str
    kind: str
    severity: str
    confidence: str
    categories: tuple[str, ...]
    description: str
    remediation: str


def rank(column: Column, order: tuple[str, ...]) -> Column:
    """Position of an enum string in its declared order, as a tinyint."""
    expr = F.when(column == order[0], 0)
    for index, member in enumerate(order[1:], start=1):
        expr = expr.when(column == member, index)
    return expr.cast("tinyint")


def severity_rank(column: Column) -> Column:
    return rank(column, SEVERITIES)


def confidence_rank(column: Column) -> Column:
    return rank(column, CONFIDENCES)


def kind_rank(column: Column) -> Column:
    return rank(column, KINDS)


def literal(value: Column | str | int | None) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def string_array(values: tuple[str, ...] | list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def finding(
    rule: Rule,
    *,
    file: Column,
    line: Column | int = 1,
    column: Column | int = 1,
    snippet: Column | str = "",
    title: Column | None = None,
    kind: Column | None = None,
    severity: Column | None = None,
    confidence: Column | None = None,
    description: Column | None = None,
    remediation: Column | None = None,
    references: Column | None = None,
) -> Column:
    """One finding struct; anything not given comes from the rule."""
    values = {
        "rule_id": F.lit(rule.rule_id),
        "title": literal(rule.title) if title is None else title,
        "kind": literal(rule.kind) if kind is None else kind,
        "severity": literal(rule.severity) if severity is None else severity,
        "confidence": literal(rule.confidence) if confidence is None else confidence,
        "categories": string_array(rule.categories),
        "location": F.struct(
            file.alias("file"),
            literal(line).cast("bigint").alias("line"),
            literal(column).cast("bigint").alias("column"),
        ),
        "snippet": literal(snippet),
        "description": literal(rule.description) if description is None else description,
        "remediation": literal(rule.remediation) if remediation is None else remediation,
        "secondary_rule_ids": string_array(()),
        "references": string_array(()) if references is None else references,
    }
    return F.struct(*[values[name].alias(name) for name in FINDING_FIELDS])


def no_findings() -> Column:
    return F.array().cast(T.ArrayType(FINDING))


def only_if(condition: Column, value: Column) -> Column:
    """A one-element array when the condition holds, otherwise an empty one."""
    return F.when(condition, F.array(value)).otherwise(no_findings())
