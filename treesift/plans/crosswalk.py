"""Findings regrouped by the controls their categories are relevant to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treesift.dimensions import CONTROLS, FRAMEWORKS


def _controls(framework: str) -> list[tuple[int, str, str, tuple[str, ...]]]:
    return [
        (index, control, title, categories)
        for index, (name, control, title, categories) in enumerate(CONTROLS)
        if name == framework
    ]


def relevant_controls(categories: Column) -> Column:
    """``array<struct<framework, framework_rank, control, control_rank>>`` of one finding.

    The thirteen controls are literals tested against the finding's own array, so a finding with
    two categories relevant to one control is placed there once, and nothing is joined. A
    framework without any relevant control contributes one entry with a NULL control.
    """
    entries = []
    for rank, (framework, _) in enumerate(FRAMEWORKS):
        controls = _controls(framework)
        placed = F.array_compact(
            F.array(
                *[
                    F.when(
                        F.arrays_overlap(categories, F.array(*[F.lit(c) for c in members])),
                        _entry(framework, rank, F.lit(control), index),
                    )
                    for index, control, _, members in controls
                ]
            )
        )
        unmapped = F.array(_entry(framework, rank, F.lit(None).cast("string"), len(CONTROLS)))
        entries.append(F.when(F.size(placed) > 0, placed).otherwise(unmapped))
    return F.concat(*entries)


def _entry(framework: str, rank: int, control: Column, control_rank: int) -> Column:
    return F.struct(
        F.lit(framework).alias("framework"),
        F.lit(rank).alias("framework_rank"),
        control.alias("control"),
        F.lit(control_rank).alias("control_rank"),
    )


def memberships(findings: DataFrame, *keep: str) -> DataFrame:
    """One row per finding and control it belongs to; NULL control means unmapped."""
    placed = findings.select(
        *keep, "kind", F.explode(relevant_controls(F.col("categories"))).alias("c")
    )
    return placed.select(
        *keep, "kind", "c.framework", "c.framework_rank", "c.control", "c.control_rank"
    )


def groups(findings: DataFrame) -> DataFrame:
    """Counts per framework and control, empty controls left out, unmapped last."""
    return (
        memberships(findings)
        .groupBy("framework", "framework_rank", "control", "control_rank")
        .agg(
            F.count(F.lit(1)).alias("findings"),
            F.count_if(F.col("kind") == "defect").alias("defects"),
            F.count_if(F.col("kind") == "observation").alias("observations"),
        )
    )
