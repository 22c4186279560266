"""Reports as ordered text: JSON, SARIF and a terminal page.

A document is a table of lines with a sort key. It is range sorted and written by the executors,
so a report with a billion findings passes neither the driver nor a single task; the part files
in name order are the document.
"""

from __future__ import annotations

import json
import textwrap
import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from treesift import __version__
from treesift.dimensions import CONTROLS, FRAMEWORKS, SECTIONS
from treesift.functions.hashing import fingerprint
from treesift.model import FINDING_FIELDS, SEVERITIES
from treesift.plans import crosswalk, report
from treesift.plans.scan import Scan

KEYS = ("block", "major", "minor")
LINE = "block int, major bigint, minor bigint, text string"
LAST = (1 << 62) - 1
WIDTH = 78
DISCLAIMER = "Controls are listed as relevant to a finding. Nothing here states conformity."


@F.pandas_udf(T.StringType())
def _pretty(texts: pd.Series, indents: pd.Series) -> pd.Series:
    """Two-space JSON, every line indented further."""

    def one(text: str, indent: int) -> str:
        body = json.dumps(json.loads(text), indent=2, ensure_ascii=False)
        return textwrap.indent(body, " " * indent)

    return pd.Series([one(t, i) for t, i in zip(texts, indents, strict=True)], dtype=object)


@F.pandas_udf(T.StringType())
def _wrapped(texts: pd.Series) -> pd.Series:
    """Text wrapped to the page, indented by four."""
    return texts.map(
        lambda t: textwrap.fill(t, WIDTH, initial_indent="    ", subsequent_indent="    "),
        na_action="ignore",
    )


def _or_null(array: str) -> Column:
    return F.when(F.size(array) > 0, F.col(array))


def finding_json() -> Column:
    """One finding as compact JSON in the published field order; empty lists are left out."""
    optional = ("secondary_rule_ids", "references")
    return F.to_json(
        F.struct(
            *[(_or_null(n) if n in optional else F.col(n)).alias(n) for n in FINDING_FIELDS]
        )
    )


def _lines(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, LINE)


def _rows(df: DataFrame, block: int, major: Column, minor: Column, text: Column) -> DataFrame:
    return df.select(
        F.lit(block).alias("block"),
        major.cast("bigint").alias("major"),
        minor.cast("bigint").alias("minor"),
        text.alias("text"),
    )


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def _list_items(df: DataFrame, block: int, position: str, body: Column, indent: int) -> DataFrame:
    """Items of a JSON list, a comma after each but the last; the last is found by aggregation."""
    last = df.agg(F.max(position)).scalar()
    text = F.concat(
        _pretty(body, F.lit(indent)),
        F.when(F.col(position) < F.col("_last"), F.lit(",")).otherwise(F.lit("")),
    )
    return _rows(df.withColumn("_last", last), block, F.col(position), F.lit(0), text)


def _head(scan: Scan, root: str) -> DataFrame:
    """The single row of counts and lookup status, with what is needed to open the document."""
    total = scan.findings.agg(F.count(F.lit(1))).scalar()
    cve = scan.cve.select(F.to_json(F.struct("status", "dependencies", "incomplete", "reason")))
    return scan.counts.select(
        total.alias("n"),
        F.to_json(F.struct("files_scanned", "files_skipped", "defects", "observations")).alias("summary"),
        cve.scalar().alias("cve"),
        F.lit(root).alias("root"),
    )


def json_document(scan: Scan, root: str = ".") -> DataFrame:
    """The whole report as JSON lines of text."""
    spark = scan.findings.sparkSession
    head = _head(scan, root)
    opening = F.concat(
        F.lit('{\n  "scanner_version": ' + json.dumps(__version__) + ',\n  "root": '),
        F.to_json(F.struct("root")).substr(F.lit(9), F.length(F.to_json(F.struct("root"))) - 9),
        F.lit(',\n  "summary": '),
        F.ltrim(_pretty("summary", F.lit(2))),
        F.lit(',\n  "cve": '),
        F.ltrim(_pretty("cve", F.lit(2))),
        F.when(F.col("n") > 0, F.lit(',\n  "findings": [')).otherwise(F.lit(',\n  "findings": []')),
    )
    findings = _list_items(scan.findings, 1, "index", finding_json(), 4)
    closing = _rows(head.where("n > 0"), 2, F.lit(0), F.lit(0), F.lit("  ]"))
    skips = report.numbered(
        scan.skips.select("line").distinct(), [F.col("line").asc()], name="position"
    )
    skip_json = F.to_json(F.struct("line"))
    skip_text = skip_json.substr(F.lit(9), F.length(skip_json) - 9)
    notes = _list_items(skips, 4, "position", skip_text, 4)
    any_skip = skips.agg(F.count(F.lit(1)).alias("n")).where("n > 0")
    frames = [
        _rows(head, 0, F.lit(0), F.lit(0), opening),
        findings,
        closing,
        _rows(any_skip, 3, F.lit(0), F.lit(0), F.lit('  ,"skipped": [')),
        notes,
        _rows(any_skip, 5, F.lit(0), F.lit(0), F.lit("  ]")),
        _crosswalk_lines(spark, scan.findings),
        _lines(spark, [(9, 0, 0, "}")]),
    ]
    return _union(frames)


def _crosswalk_lines(spark: SparkSession, findings: DataFrame) -> DataFrame:
    """Crosswalks with the finding numbers of each control, one number per line."""
    stride = len(CONTROLS) + 2
    member = crosswalk.memberships(findings, "index")
    place = F.col("framework_rank") * stride + F.col("control_rank") + 1
    counted = member.groupBy("framework", "framework_rank", "control", "control_rank").agg(
        F.max("index").alias("last"),
        F.count_if(F.col("kind") == "defect").alias("defects"),
        F.count_if(F.col("kind") == "observation").alias("observations"),
    )
    # Thirteen controls and three remainders at most.
    first = counted.groupBy("framework").agg(F.min("control_rank").alias("first"))
    counted = counted.join(F.broadcast(first), "framework")
    titles = F.create_map(*[F.lit(x) for _, c, t, _ in CONTROLS for x in (c, t)])
    mapped = F.col("control").isNotNull()
    lead = F.when(F.col("control_rank") > F.col("first"), F.lit(",")).otherwise(F.lit(""))
    opened = F.when(
        mapped,
        F.concat(
            lead,
            F.lit('{"id": "'),
            F.col("control"),
            F.lit('", "title": "'),
            titles[F.coalesce("control", F.lit("Art. 12"))],
            F.lit('", "findings": ['),
        ),
    ).otherwise(F.lit('], "unmapped": {"findings": ['))
    closed = F.format_string('], "defects": %d, "observations": %d}', "defects", "observations")
    numbers = member.join(
        F.broadcast(counted.select("framework", F.col("control_rank").alias("r"), "last")), "framework"
    ).where("control_rank = r")
    number = F.concat(
        F.col("index").cast("string"),
        F.when(F.col("index") < F.col("last"), F.lit(",")).otherwise(F.lit("")),
    )
    has_rest = counted.where(~mapped).select("framework_rank").withColumn("rest", F.lit(True))
    frames_table = spark.createDataFrame(
        [(rank, fid, name) for rank, (fid, name) in enumerate(FRAMEWORKS)],
        "framework_rank int, framework string, name string",
    ).join(F.broadcast(has_rest), "framework_rank", "left")
    comma = F.when(F.col("framework_rank") > 0, F.lit(",")).otherwise(F.lit(""))
    start = F.concat(
        comma,
        F.format_string(
            '{"framework": "%s", "name": "%s", "disclaimer": "' + DISCLAIMER + '", "groups": [',
            "framework",
            "name",
        ),
    )
    base = F.col("framework_rank") * stride
    stop = F.when(F.col("rest"), F.lit("}")).otherwise(
        F.lit('], "unmapped": {"findings": [], "defects": 0, "observations": 0}}')
    )
    return _union(
        [
            _lines(spark, [(6, 0, 0, '  ,"crosswalks": ['), (8, 0, 0, "  ]")]),
            _rows(frames_table, 7, base, F.lit(-1), start),
            _rows(counted, 7, place, F.lit(-1), opened),
            _rows(numbers, 7, place, F.col("index"), number),
            _rows(counted, 7, place, F.lit(LAST), closed),
            _rows(frames_table, 7, base + stride - 1, F.lit(LAST), stop),
        ]
    )


def sarif_rules(findings: DataFrame) -> DataFrame:
    """Reporting descriptors in order of first appearance; as many rows as there are rules."""
    first = findings.groupBy("rule_id").agg(
        F.min("index").alias("first"),
        F.min_by(F.struct("title", "description", "kind", "severity", "categories"), "index").alias("f"),
    )
    # Bounded by the number of rules, so one task may rank them.
    ranked = first.select("*", (F.expr("row_number() OVER (ORDER BY first)") - 1).alias("rule_index"))
    level = report.level(F.col("f.kind"), F.col("f.severity"))
    text = F.struct(F.col("f.title").alias("text"))
    body = F.struct(
        F.col("rule_id").alias("id"),
        F.col("f.title").alias("name"),
        text.alias("shortDescription"),
        F.struct(F.col("f.description").alias("text")).alias("fullDescription"),
        F.struct(level.alias("level")).alias("defaultConfiguration"),
        F.struct(
            F.col("f.categories").alias("tags"), level.alias("problem.severity")
        ).alias("properties"),
        _relationships(F.col("f.categories")).alias("relationships"),
    )
    return ranked.select("rule_id", "rule_index", F.to_json(body).alias("json"))


def _taxonomy_guid(framework: str) -> str:
    return str(uuid.uuid5(uuid.NAMESPACE_URL, framework))


def _relationships(categories: Column) -> Column:
    guids = F.create_map(
        *[F.lit(x) for fid, _ in FRAMEWORKS for x in (fid, _taxonomy_guid(fid))]
    )
    names = F.create_map(*[F.lit(x) for pair in FRAMEWORKS for x in pair])
    mapped = F.filter(crosswalk.relevant_controls(categories), lambda c: c["control"].isNotNull())
    listed = F.transform(
        mapped,
        lambda c: F.struct(
            F.struct(
                c["control"].alias("id"),
                F.struct(
                    names[c["framework"]].alias("name"), guids[c["framework"]].alias("guid")
                ).alias("toolComponent"),
            ).alias("target"),
            F.array(F.lit("relevant")).alias("kinds"),
        ),
    )
    return F.when(F.size(listed) > 0, listed)


def sarif_results(findings: DataFrame) -> DataFrame:
    """One result per finding, pointing at its rule and carrying its fingerprint."""
    rules = sarif_rules(findings).select("rule_id", "rule_index")
    body = F.struct(
        F.col("rule_id").alias("ruleId"),
        F.col("rule_index").cast("bigint").alias("ruleIndex"),
        report.level(F.col("kind"), F.col("severity")).alias("level"),
        F.struct(F.col("description").alias("text")).alias("message"),
        F.array(
            F.struct(
                F.struct(
                    F.struct(F.replace("location.file", F.lit("\\"), F.lit("/")).alias("uri")).alias(
                        "artifactLocation"
                    ),
                    F.struct(
                        F.col("location.line").alias("startLine"),
                        F.col("location.column").alias("startColumn"),
                        F.struct(F.col("snippet").alias("text")).alias("snippet"),
                    ).alias("region"),
                ).alias("physicalLocation")
            )
        ).alias("locations"),
        F.struct(
            fingerprint(
                F.col("rule_id"), F.col("location.file"), F.col("snippet"), F.col("title")
            ).alias("primaryLocationLineHash")
        ).alias("partialFingerprints"),
        F.struct("confidence", "kind", _or_null("references").alias("references")).alias("properties"),
    )
    return findings.join(F.broadcast(rules), "rule_id").select("index", F.to_json(body).alias("json"))


def sarif_document(scan: Scan) -> DataFrame:
    """A SARIF 2.1.0 log with rules, results, taxonomies and lookup notifications."""
    spark = scan.findings.sparkSession
    opening = (
        '{"$schema": "https://json.schemastore.org/sarif-2.1.0.json", "version": "2.1.0", "runs": [{'
        f'"tool": {{"driver": {{"name": "treesift", "version": "{__version__}", "rules": ['
    )
    reached = crosswalk.groups(scan.findings).where("control IS NOT NULL")
    first = reached.groupBy("framework").agg(F.min("control_rank").alias("first"))
    titles = F.create_map(*[F.lit(x) for _, c, t, _ in CONTROLS for x in (c, t)])
    taxon = F.to_json(
        F.struct(
            F.col("control").alias("id"),
            F.col("control").alias("name"),
            F.struct(titles[F.col("control")].alias("text")).alias("shortDescription"),
        )
    )
    comma = F.when(F.col("control_rank") > F.col("first"), F.lit(",")).otherwise(F.lit(""))
    taxa = _rows(
        reached.join(F.broadcast(first), "framework"),
        5,
        F.col("framework_rank"),
        F.col("control_rank") + 1,
        F.concat(comma, taxon),
    )
    frames = []
    for rank, (fid, name) in enumerate(FRAMEWORKS):
        lead = "," if rank else ""
        frames.append((5, rank, 0, f'{lead}{{"name": {json.dumps(name)}, "guid": "{_taxonomy_guid(fid)}", "taxa": ['))
        frames.append((5, rank, 1000, "]}"))
    notice = F.when(
        F.col("status") == "partial",
        F.format_string(
            "OSV vulnerability lookup incomplete: %d dependencies checked, results may be missing for %d.",
            F.coalesce("dependencies", F.lit(0)),
            F.coalesce("incomplete", F.lit(0)),
        ),
    ).when(
        F.col("status") == "unreachable",
        F.format_string("OSV vulnerability lookup skipped: %s.", "reason"),
    )
    invocation = F.to_json(
        F.struct(
            F.lit(True).alias("executionSuccessful"),
            F.array(
                F.struct(F.lit("warning").alias("level"), F.struct(F.col("notice").alias("text")).alias("message"))
            ).alias("toolExecutionNotifications"),
        )
    )
    return _union(
        [
            _lines(
                spark,
                [
                    (0, 0, 0, opening),
                    (2, 0, 0, ']}}, "results": ['),
                    (4, 0, 0, '], "taxonomies": ['),
                    *frames,
                    (6, 0, 0, '], "invocations": ['),
                    (8, 0, 0, "]}]}"),
                ],
            ),
            _list_items(sarif_rules(scan.findings), 1, "rule_index", F.col("json"), 0),
            _list_items(sarif_results(scan.findings), 3, "index", F.col("json"), 0),
            taxa,
            _rows(
                scan.cve.withColumn("notice", notice).where("notice IS NOT NULL"),
                7,
                F.lit(0),
                F.lit(0),
                invocation,
            ),
        ]
    )


def _plural(count: Column, one: str, many: str) -> Column:
    return F.when(count == 1, F.lit(f"1 {one}")).otherwise(F.format_string(f"%d {many}", count))


def counts_sentence(defects: Column, observations: Column) -> Column:
    return F.concat_ws(
        ", ",
        _plural(defects, "defect", "defects"),
        _plural(observations, "observation", "observations"),
    )


def cve_sentence(status: Column, dependencies: Column, incomplete: Column, reason: Column) -> Column:
    """How far the advisory lookup got, in one sentence."""
    checked = _plural(dependencies, "dependency", "dependencies")
    return (
        F.when(status == "checked", F.concat(F.lit("CVE lookup: "), checked, F.lit(" checked.")))
        .when(
            status == "partial",
            F.concat(
                F.lit("CVE lookup incomplete: "),
                checked,
                F.format_string(" checked, results may be missing for %d.", incomplete),
            ),
        )
        .when(status == "unreachable", F.concat(F.lit("CVE lookup skipped: "), reason, F.lit(".")))
        .when(status == "no_manifest", F.lit("CVE lookup: no pinned dependencies found."))
        .otherwise(F.lit("CVE lookup skipped: offline."))
    )


def verdict_line(scan: Scan) -> DataFrame:
    """One row: the closing line for when the document itself goes elsewhere."""
    defects = scan.findings.where(F.col("kind") == "defect")
    counted = defects.agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES]
    )
    spread = F.concat_ws(
        ", ",
        *[F.when(F.col(s) > 0, F.concat_ws(" ", F.col(s).cast("string"), F.lit(s))) for s in reversed(SEVERITIES)],
    )
    return counted.select(
        F.when(F.col("n") == 0, F.lit("✓ No defects found"))
        .otherwise(
            F.concat(
                F.lit("✖ "), _plural(F.col("n"), "defect", "defects"), F.lit(" found ("), spread, F.lit(")")
            )
        )
        .alias("text")
    )


def text_report(scan: Scan, root: str = ".") -> DataFrame:
    """A page of text: verdict, defects by section, observations, coverage, crosswalk."""
    spark = scan.findings.sparkSession
    findings = scan.findings
    section = report.section_rank(F.col("categories"))
    defect = F.col("kind") == "defect"
    head = F.concat(
        F.upper("severity"),
        F.lit("  "),
        F.col("title"),
        F.lit("\n    "),
        F.col("location.file"),
        F.format_string(":%d:%d", "location.line", "location.column"),
        F.lit("  "),
        F.col("rule_id"),
        F.when(F.col("confidence") != "high", F.format_string("  (%s confidence)", "confidence")).otherwise(
            F.lit("")
        ),
    )
    body = F.concat_ws(
        "\n",
        head,
        F.when(F.col("snippet") != "", _wrapped(F.concat(F.lit("> "), F.col("snippet")))),
        _wrapped("description"),
        _wrapped(F.concat(F.lit("Fix: "), F.col("remediation"))),
        F.lit(""),
    )
    used = findings.where(defect).select(section.alias("section")).distinct()
    names = F.array(*[F.lit(s.replace("_", "-").upper()) for s in SECTIONS])
    summary_line = scan.counts.select(
        F.concat(
            counts_sentence(F.col("defects"), F.col("observations")),
            F.format_string(" in %d files scanned; ", "files_scanned"),
            _plural(F.col("files_skipped"), "coverage note", "coverage notes"),
        ).alias("text")
    )
    spread = findings.where(defect).agg(
        *[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES]
    ).select(
        F.concat_ws(
            ", ",
            *[F.when(F.col(s) > 0, F.concat_ws(" ", F.col(s).cast("string"), F.lit(s))) for s in reversed(SEVERITIES)],
        ).alias("text")
    )
    groups = report.skip_groups(scan.skips)
    entries = scan.skips.distinct()
    walks = crosswalk.groups(findings).where("control IS NOT NULL")
    verdict = report.gate(findings).select(
        F.when(F.col("exit_code") == 1, "FAIL: a defect reaches the threshold")
        .otherwise("PASS: no defect reaches the threshold")
        .alias("text")
    )
    return _union(
        [
            _lines(spark, [(0, 0, 0, f"treesift {__version__}  {root}"), (0, 1, 0, "=" * WIDTH)]),
            _rows(verdict, 1, F.lit(0), F.lit(0), F.col("text")),
            _rows(summary_line, 1, F.lit(1), F.lit(0), F.col("text")),
            _rows(spread.where("text <> ''"), 1, F.lit(2), F.lit(0), F.col("text")),
            _rows(
                scan.cve,
                1,
                F.lit(3),
                F.lit(0),
                cve_sentence(F.col("status"), F.col("dependencies"), F.col("incomplete"), F.col("reason")),
            ),
            _rows(used, 2, F.col("section"), F.lit(-1), F.concat(F.lit("\n"), F.get(names, F.col("section")))),
            _rows(findings.where(defect), 2, section, F.col("index"), body),
            _rows(
                findings.where(~defect).limit(1),
                3,
                F.lit(0),
                F.lit(-1),
                F.lit("\nOBSERVATIONS (what the code alone cannot decide)"),
            ),
            _rows(findings.where(~defect), 3, F.lit(0), F.col("index"), body),
            _rows(groups, 4, F.col("reason_rank"), F.lit(0), F.concat(F.lit("\n"), F.col("sentence"))),
            _rows(
                entries,
                4,
                report.skip_rank(F.col("reason")),
                F.lit(1),
                F.concat(F.lit("    "), F.col("line")),
            ),
            _rows(
                walks,
                5,
                F.col("framework_rank"),
                F.col("control_rank"),
                F.concat(
                    F.rpad(F.concat_ws("  ", "framework", "control"), WIDTH - 30, " "),
                    counts_sentence(F.col("defects"), F.col("observations")),
                ),
            ),
        ]
    )


def write_document(lines: DataFrame, path: str) -> None:
    """Write the lines in order as text part files; reading them by name gives the document."""
    lines.orderBy(*KEYS, "text").select("text").write.text(path)
