"""Credential-named assignments of string literals in any text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from treesift.functions import credentials as cred
from treesift.functions.text import column_at, let, line_at, snippet
from treesift.model import Rule, finding

RULE = Rule(
    "BAS-ZT1-010",
    "Hardcoded credential assigned to a credential-named variable",
    "defect",
    "high",
    "high",
    ("ZT1",),
    "A credential-named variable holds a literal.",
    "Load the value from the environment or a secret manager, and rotate it.",
)
ASSIGNMENT = r"([A-Za-z_][A-Za-z0-9_]*)[ \t]*[=:][ \t]*\"([^\"\n]+)\""


def assignments(text: Column) -> Column:
    """``array<struct<key, value, offset>>`` in text order.

    The pieces between matches and the matches themselves add up to the offsets, so equal
    assignments in one text keep their own positions.
    """
    hits = F.regexp_extract_all(text, F.lit(ASSIGNMENT), F.lit(0))
    gaps = F.split(text, ASSIGNMENT)
    paired = F.arrays_zip(hits.alias("hit"), F.slice(gaps, F.lit(1), F.size(hits)).alias("gap"))
    item = "struct<key:string,value:string,offset:int>"
    start = F.struct(
        F.array().cast(f"array<{item}>").alias("out"), F.lit(1).alias("next")
    )

    def step(acc: Column, pair: Column) -> Column:
        offset = acc["next"] + F.length(pair["gap"])
        found = F.struct(
            F.regexp_extract(pair["hit"], ASSIGNMENT, 1).alias("key"),
            F.regexp_extract(pair["hit"], ASSIGNMENT, 2).alias("value"),
            offset.alias("offset"),
        )
        return F.struct(
            F.array_append(acc["out"], found).alias("out"),
            (offset + F.length(pair["hit"])).alias("next"),
        )

    return F.aggregate(paired, start, step, lambda acc: acc["out"])


def findings(path: Column, text: Column) -> Column:
    def report(a: Column) -> Column:
        return let(
            line_at(text, a["offset"]),
            lambda line: finding(
                RULE,
                file=path,
                line=line,
                column=column_at(text, a["offset"]),
                snippet=snippet(text, line),
                severity=cred.credential_severity(a["value"]),
            ),
        )

    # The pre-filter keeps the fold away from the many texts without any assignment.
    judged = F.transform(
        F.filter(
            assignments(text),
            lambda a: cred.is_credential_key(a["key"]) & cred.is_hardcoded_value(a["value"]),
        ),
        report,
    )
    return F.when(text.rlike(ASSIGNMENT), judged)
