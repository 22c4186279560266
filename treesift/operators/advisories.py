"""Pinned dependencies against published advisories.

Dependencies are reduced to distinct pins before anything is joined: a package half the world
depends on has few versions, so the hot key disappears in the map-side combine. Only the small
result of the range join is joined back to the declarations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treesift import rulebook
from treesift.functions.versions import (
    advisory_severity,
    digits,
    is_plain_release,
    lower_bound,
    within,
)
from treesift.model import FINDING_FIELDS, SEVERITIES, finding, severity_rank

PIN = ["ecosystem", "name", "version"]
SEGMENT = "struct<introduced:string,fixed:string,last_affected:string>"


def segments(ranges: Column) -> Column:
    """``[introduced, fixed)`` segments of the ordered events of every non-GIT range.

    A ``last_affected`` event closes a segment without naming a fix; an ``introduced`` event that
    nothing closes stays open.
    """
    start = F.struct(
        F.array().cast(f"array<{SEGMENT}>").alias("done"),
        F.lit(None).cast("string").alias("introduced"),
    )

    def step(acc: Column, event: Column) -> Column:
        closes = event["introduced"].isNull() & (
            event["fixed"].isNotNull() | event["last_affected"].isNotNull()
        )
        segment = F.struct(
            acc["introduced"].alias("introduced"),
            event["fixed"].alias("fixed"),
            F.when(event["fixed"].isNull(), event["last_affected"]).alias("last_affected"),
        )
        return F.struct(
            F.when(closes, F.array_append(acc["done"], segment)).otherwise(acc["done"]).alias("done"),
            F.when(event["introduced"].isNotNull(), event["introduced"])
            .when(closes, F.lit(None).cast("string"))
            .otherwise(acc["introduced"])
            .alias("introduced"),
        )

    def finish(acc: Column) -> Column:
        rest = F.struct(
            acc["introduced"].alias("introduced"),
            F.lit(None).cast("string").alias("fixed"),
            F.lit(None).cast("string").alias("last_affected"),
        )
        return F.when(acc["introduced"].isNotNull(), F.array_append(acc["done"], rest)).otherwise(
            acc["done"]
        )

    usable = F.filter(ranges, lambda r: F.coalesce(F.upper(r["type"]) != "GIT", F.lit(True)))
    return F.coalesce(
        F.flatten(F.transform(usable, lambda r: F.aggregate(r["events"], start, step, finish))),
        F.array().cast(f"array<{SEGMENT}>"),
    )


def with_digits(advisory_segments: Column) -> Column:
    """Segments with their bounds as digit arrays, so that no pair parses a version again."""
    return F.transform(
        advisory_segments,
        lambda s: F.struct(
            s["fixed"].alias("fixed"),
            lower_bound(s["introduced"]).alias("low"),
            digits(s["fixed"]).alias("high"),
            digits(s["last_affected"]).alias("last"),
        ),
    )


def affects(version: Column, number: Column, bounds: Column, versions: Column) -> Column:
    """Whether a version is listed or lies in a segment; ``last_affected`` is inclusive."""

    def inside(s: Column) -> Column:
        upto = F.coalesce(s["last"].isNull() | (number <= s["last"]), F.lit(True))
        return within(s["low"], s["high"], number) & upto

    listed = F.coalesce(F.array_contains(versions, version), F.lit(False))
    return listed | F.exists(bounds, inside)


def fix_version(number: Column, bounds: Column) -> Column:
    """The fix that ends the segment holding the version, else the first fix published at all."""
    fixed = F.filter(bounds, lambda s: s["fixed"].isNotNull())
    holding = F.filter(fixed, lambda s: within(s["low"], s["high"], number))
    return F.coalesce(F.get(holding, F.lit(0))["fixed"], F.get(fixed, F.lit(0))["fixed"])


def prepared(advisories: DataFrame) -> DataFrame:
    """Advisory rows with the columns every match needs, computed once per advisory."""
    return advisories.select(
        "id",
        "package",
        "ecosystem",
        "summary",
        "versions",
        with_digits(segments(F.col("ranges"))).alias("bounds"),
        F.coalesce(
            F.get(F.filter("aliases", lambda a: a.startswith("CVE-")), F.lit(0)), F.col("id")
        ).alias("identifier"),
        advisory_severity(F.col("db_severity"), F.col("scores")).alias("severity"),
    )


def pins(dependencies: DataFrame) -> DataFrame:
    return dependencies.where("version IS NOT NULL").select(*PIN).distinct()


def matches(distinct_pins: DataFrame, advisories: DataFrame) -> DataFrame:
    """One row per (pin, advisory): an equi-join on the package, then the version range."""
    a = prepared(advisories)
    joined = distinct_pins.withColumn("number", digits(F.col("version"))).join(
        a.withColumnRenamed("ecosystem", "a_ecosystem"),
        (F.col("ecosystem") == F.col("a_ecosystem")) & (F.lower("name") == F.col("package")),
    )
    number, bounds = F.col("number"), F.col("bounds")
    return joined.where(affects(F.col("version"), number, bounds, F.col("versions"))).select(
        *PIN,
        "id",
        "identifier",
        "severity",
        "summary",
        fix_version(number, bounds).alias("fix"),
    )


def grouped(matched: DataFrame) -> DataFrame:
    """One row per pin: worst severity, identifiers, the fix that clears all, and the spread."""
    matched = matched.select(
        "*",
        F.coalesce(is_plain_release(F.col("fix")), F.lit(False)).alias("usable"),
        digits(F.col("fix")).alias("fix_digits"),
    )
    usable = F.col("usable")
    rank = severity_rank(F.col("severity"))
    # The same advisory may name a package twice; it counts once per pin. Both steps use one shuffle by pin.
    once = matched.repartition(*PIN).groupBy(*PIN, "id").agg(
        F.first("identifier").alias("identifier"),
        F.first("severity").alias("severity"),
        F.first("summary").alias("summary"),
        F.max(F.struct("usable", F.col("fix_digits").alias("d"), "fix")).alias("best"),
    ).select("*", "best.usable", "best.fix", F.col("best.d").alias("fix_digits"))
    return once.groupBy(*PIN).agg(
        F.max(rank).alias("worst"),
        F.array_sort(F.collect_set("identifier")).alias("references"),
        F.max(F.when(usable, F.struct("fix_digits", "fix")))["fix"].alias("target"),
        F.bool_or(~usable).alias("unfixed"),
        F.min_by("summary", "id").alias("summary"),
        *[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES],
    )


def findings(dependencies: DataFrame, advisories: DataFrame) -> DataFrame:
    """One finding per declared dependency with at least one advisory against its pin."""
    return declared(dependencies, pin_findings(dependencies, advisories))


def pin_findings(dependencies: DataFrame, advisories: DataFrame) -> DataFrame:
    """One finding per pin with at least one advisory, without place: texts are put together once for all declarations."""
    nowhere = {"file": "string", "line": "bigint", "declaration": "string"}
    per_pin = grouped(matches(pins(dependencies), advisories))
    per_pin = per_pin.select("*", *[F.lit(None).cast(t).alias(name) for name, t in nowhere.items()])
    return per_pin.select(*PIN, _finding().alias("f")).select(*PIN, *[F.col(f"f.{name}").alias(name) for name in FINDING_FIELDS])


def declared(dependencies: DataFrame, per_pin: DataFrame) -> DataFrame:
    """The findings of :func:`pin_findings` (and what columns a caller added) at every declaration of the pin."""
    columns = [c for c in per_pin.columns if c not in PIN]
    place = F.struct(F.col("file"), F.col("line").cast("bigint").alias("line"), F.lit(1).cast("bigint").alias("column"))
    here = {"location": place.alias("location"), "snippet": F.col("declaration").alias("snippet")}
    pinned = dependencies.where("version IS NOT NULL").select(*PIN, "file", "line", "declaration")
    return pinned.join(per_pin, PIN).select(*[here.get(name, F.col(name)) for name in columns])


def _finding() -> Column:
    count = F.size("references")
    label = F.concat_ws(" ", F.col("name"), F.col("version"))
    severity = F.try_element_at(F.array(*[F.lit(s) for s in SEVERITIES]), F.col("worst").cast("int") + 1)
    spread = F.array_join(
        F.array_compact(
            F.array(
                *[
                    F.when(F.col(s) > 0, F.concat_ws(" ", F.col(s).cast("string"), F.lit(s)))
                    for s in reversed(SEVERITIES)
                ]
            )
        ),
        ", ",
    )
    summary = F.when(F.trim("summary") != "", F.trim("summary"))
    description = F.when(
        count == 1,
        F.coalesce(
            F.concat(label, F.lit(": "), summary),
            F.concat(label, F.lit(" is affected by a published advisory.")),
        ),
    ).otherwise(
        F.format_string("%s has %d published advisories against it (%s).", label, count, spread)
    )
    upgrade = F.format_string("Upgrade %s to %s or later", F.col("name"), F.col("target"))
    remediation = (
        F.when(
            F.col("target").isNull(),
            F.format_string("No fixed version of %s is published yet; track the advisories.", "name"),
        )
        .when(F.col("unfixed"), F.concat(upgrade, F.lit("; at least one advisory has no fix yet.")))
        .when(count == 1, F.concat(upgrade, F.lit(".")))
        .otherwise(F.concat(upgrade, F.format_string(", which resolves all %d.", count)))
    )
    return finding(
        rulebook.ADVISORY,
        file=F.col("file"),
        line=F.col("line"),
        snippet=F.col("declaration"),
        severity=severity,
        title=F.when(
            count == 1,
            F.concat(label, F.lit(" is affected by "), F.get("references", F.lit(0))),
        ).otherwise(
            F.concat(label, F.format_string(" — %d known vulnerabilities", count))
        ),
        description=description,
        remediation=remediation,
        references=F.col("references"),
    )


def status(dependencies: DataFrame, offline: bool, incomplete: DataFrame | None = None) -> DataFrame:
    """One row: how far the advisory lookup got.

    ``incomplete`` holds the pins whose advisories could not all be read (columns of ``PIN``).
    """
    spark = dependencies.sparkSession
    shape = "status string, dependencies bigint, incomplete bigint, reason string"
    if offline:
        return spark.createDataFrame([("skipped_offline", None, None, None)], shape)
    pinned = dependencies.where("version IS NOT NULL")
    if incomplete is None:
        flagged = pinned.withColumn("missing", F.lit(False))
    else:
        marks = incomplete.select(*PIN).distinct().withColumn("missing", F.lit(True))
        flagged = pinned.join(marks, PIN, "left").withColumn(
            "missing", F.coalesce("missing", F.lit(False))
        )
    counted = flagged.agg(
        F.count(F.lit(1)).alias("n"), F.count_if("missing").alias("incomplete")
    )
    return counted.select(
        F.when(F.col("n") == 0, "no_manifest")
        .when(F.col("incomplete") > 0, "partial")
        .otherwise("checked")
        .alias("status"),
        F.when(F.col("n") > 0, F.col("n")).alias("dependencies"),
        F.when(F.col("incomplete") > 0, F.col("incomplete")).alias("incomplete"),
        F.lit(None).cast("string").alias("reason"),
    )
