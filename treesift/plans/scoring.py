"""Scoring a scan against a list of expectations.

``expectations``: entry (expect, expect_none, known_gap, known_false_positive), file, line, rule,
category, kind, severity. ``rule`` NULL means any rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _same_place() -> Column:
    return (
        (F.col("f.location.file") == F.col("e.file"))
        & (F.col("f.location.line") == F.col("e.line"))
        & F.array_contains(F.col("f.categories"), F.col("e.category"))
        & (F.col("e.rule").isNull() | (F.col("e.rule") == F.col("f.rule_id")))
    )


def _entries(expectations: DataFrame, entry: str) -> DataFrame:
    return expectations.where(F.col("entry") == entry)


def outcomes(expectations: DataFrame, findings: DataFrame) -> DataFrame:
    """Every expected finding as matched, mismatched (wrong kind or severity) or missing."""
    e, f = _entries(expectations, "expect").alias("e"), findings.alias("f")
    right = (F.col("f.kind") == F.col("e.kind")) & (F.col("f.severity") == F.col("e.severity"))
    columns = [F.col(f"e.{c}").alias(c) for c in ("file", "line", "rule", "category", "kind", "severity")]
    joined = e.join(f, _same_place(), "left").select(
        *columns,
        F.col("f.rule_id").isNotNull().alias("found"),
        F.coalesce(right, F.lit(False)).alias("right"),
    )
    return (
        joined.groupBy("file", "line", "rule", "category", "kind", "severity")
        .agg(F.bool_or("right").alias("right"), F.bool_or("found").alias("found"))
        .withColumn(
            "outcome",
            F.when(F.col("right"), "matched").when(F.col("found"), "mismatched").otherwise("missing"),
        )
        .drop("right", "found")
    )


def recall(expectations: DataFrame, findings: DataFrame) -> DataFrame:
    """Ready and matched expectations per kind, with the percentage."""
    return (
        outcomes(expectations, findings)
        .groupBy("kind")
        .agg(
            F.count(F.lit(1)).alias("ready"),
            F.count_if(F.col("outcome") == "matched").alias("matched"),
        )
        .withColumn("percent", F.round(F.col("matched") / F.col("ready") * 100, 2))
    )


def unaccounted(expectations: DataFrame, findings: DataFrame) -> DataFrame:
    """Findings nothing in the list explains."""
    named = expectations.where(
        F.col("entry").isin("expect", "known_gap", "known_false_positive")
    ).withColumn("rule", F.when(F.col("entry") == "expect", F.col("rule")))
    silent = _entries(expectations, "expect_none").select("file")
    rest = findings.alias("f").join(named.alias("e"), _same_place(), "left_anti")
    return rest.join(silent, F.col("location.file") == silent["file"], "left_anti")


def violations(expectations: DataFrame, findings: DataFrame) -> DataFrame:
    """Findings in files that must stay silent."""
    silent = _entries(expectations, "expect_none").select("file")
    return findings.join(silent, F.col("location.file") == silent["file"], "left_semi")


def promotable(expectations: DataFrame, findings: DataFrame) -> DataFrame:
    """Known gaps that are found by now."""
    gaps = _entries(expectations, "known_gap").withColumn("rule", F.lit(None).cast("string"))
    return gaps.alias("e").join(findings.alias("f"), _same_place(), "left_semi")


def resolved_false_positives(expectations: DataFrame, findings: DataFrame) -> DataFrame:
    """Known false positives that are no longer reported."""
    known = _entries(expectations, "known_false_positive").withColumn(
        "rule", F.lit(None).cast("string")
    )
    return known.alias("e").join(findings.alias("f"), _same_place(), "left_anti")


def precision(expectations: DataFrame, findings: DataFrame) -> DataFrame:
    """Reported defects, how many of them are expected or known gaps, and the percentage."""
    wanted = expectations.where(
        (F.col("entry") == "known_gap")
        | ((F.col("entry") == "expect") & (F.col("kind") == "defect"))
    ).withColumn("rule", F.when(F.col("entry") == "expect", F.col("rule")))
    defects = findings.where(F.col("kind") == "defect")
    correct = defects.alias("f").join(wanted.alias("e"), _same_place(), "left_semi")
    returned = defects.agg(F.count(F.lit(1)).alias("returned"))
    right = correct.agg(F.count(F.lit(1)).alias("correct"))
    return right.withColumn("returned", returned.scalar()).withColumn(
        "percent", F.round(F.try_divide(F.col("correct") * 100, F.col("returned")), 2)
    )
