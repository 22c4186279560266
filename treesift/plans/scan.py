"""The whole pipeline: files in, findings, coverage notes and counts out.

One pass decides claims, decodes and writes the claimed texts into one folder per stage, so the
input is read once and each stage reads only its own files. The configuration analysers are one
projection; the rule engines are one narrow Python pass each, followed by column expressions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treesift.functions import paths
from treesift.functions.documents import canonical_json, document_format
from treesift.functions.text import generated_measurement, generated_reason, utf8
from treesift.model import FINDING_FIELDS, no_findings
from treesift.operators import (
    advisories,
    dotenv,
    images,
    instructions,
    manifests,
    python_rules,
    script_rules,
    services,
    skills,
    tool_servers,
)
from treesift.operators.provenance import SINK_LEAVES
from treesift.plans import crosswalk, report, summary
from treesift.session import written
from treesift.sources import python_facts, script_facts
from treesift.sources.tree import WalkOptions, read_tree

DEPENDENCY = "name string, version string, constraint string, ecosystem string, file string, line bigint, declaration string, dev boolean"


@dataclass(frozen=True)
class Scan:
    """Tables of one scan. ``findings`` are numbered in report order."""

    findings: DataFrame
    counts: DataFrame
    skips: DataFrame
    dependencies: DataFrame
    cve: DataFrame
    files: DataFrame

    def crosswalk(self) -> DataFrame:
        return crosswalk.groups(self.findings)

    def summary(self) -> DataFrame:
        return summary.ranked_groups(summary.finding_groups(self.findings))

    def gate(self, fail_on: str | None = "high") -> DataFrame:
        return report.gate(self.findings, fail_on)


def stages() -> F.Column:
    """The folders a file's text is written to, one for each kind of claim; none if nothing claims it."""
    path = F.col("path")
    language = paths.language(path)
    config = paths.is_mcp_config(path) | paths.is_compose(path) | paths.is_dockerfile(path)
    config = config | paths.is_instruction_file(path) | paths.is_skill(path) | paths.is_dotenv(path)
    return F.array_compact(
        F.array(
            F.when(language == "python", "python").when(language.isNotNull(), "script"),
            F.when(paths.is_manifest(path), "manifest"),
            F.when(config, "config"),
        )
    )


def staged(files: DataFrame, skip_generated: bool) -> DataFrame:
    """Claimed files with decoded text, one row and folder per claim, and for the rules the
    generated-file measurement if ``skip_generated``."""
    rules = F.lit(skip_generated) & F.col("stage").isin("python", "script")
    sized = F.when(rules, generated_measurement(F.col("content")))
    return written(
        files.withColumn("stage", F.explode(stages()))
        .select("path", utf8(F.col("content")).alias("text"), sized.alias("generated"), "stage"),
        "staged",
        partition_by="stage",
    )


def config_findings(files: DataFrame) -> DataFrame:
    """Findings of all configuration analysers with the analyser's rank and order of appearance."""
    path, text = F.col("path"), F.col("text")
    front = skills.frontmatter(text)
    structured = paths.is_mcp_config(path) | paths.is_compose(path)
    kind = F.when(structured, document_format(path)).when(paths.is_skill(path), F.lit("yaml"))
    source = F.when(structured, text).when(paths.is_skill(path), front)
    read = files.withColumn("json", canonical_json(kind, source)).withColumn(
        "document", F.try_parse_json("json")
    )
    document = F.col("document")
    branches = [
        ("mcp", paths.is_mcp_config(path), tool_servers.findings(path, text, document)),
        (
            "container",
            paths.is_compose(path) & document.isNotNull(),
            services.findings(path, text, document),
        ),
        ("container", paths.is_dockerfile(path), images.findings(path, text)),
        ("instruction", paths.is_instruction_file(path), instructions.findings(path, text)),
        (
            "skill",
            paths.is_skill(path),
            F.concat(
                skills.frontmatter_findings(path, text, F.col("json")),
                skills.injection_findings(path, text),
                skills.confirmation_findings(path, text),
            ),
        ),
        ("dotenv", paths.is_dotenv(path), dotenv.findings(path, text)),
    ]

    def ranked_by(rank: int):
        return lambda f, i: F.struct(F.lit(rank).alias("analyser"), i.alias("seq"), f.alias("f"))

    ranked = F.concat(
        *[
            F.transform(
                F.when(condition, found).otherwise(no_findings()),
                ranked_by(report.ANALYSERS.index(name)),
            )
            for name, condition, found in branches
        ]
    )
    exploded = read.select(F.explode(ranked).alias("r")).select("r.analyser", "r.seq", "r.f.*")
    return exploded.select(*FINDING_FIELDS, "analyser", "seq")


def bad_services(files: DataFrame) -> DataFrame:
    """Compose files that do not parse."""
    compose = files.where(paths.is_compose(F.col("path")))
    parsed = compose.withColumn("json", canonical_json(F.lit("yaml"), F.col("text")))
    return parsed.where("json IS NULL").select("path")


def declared(manifest_files: DataFrame, config_files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(dependencies, manifests that do not parse)``."""
    path, text = F.col("path"), F.col("text")
    read = manifest_files.withColumn("json", canonical_json(document_format(path), text)).withColumn(
        "document", F.try_parse_json("json")
    )
    read = written(read.select("path", "text", "json"), "manifests").withColumn(
        "document", F.try_parse_json("json")
    )
    broken = read.where(document_format(path).isNotNull() & F.col("json").isNull()).select("path")
    listed = read.select(
        F.explode(manifests.dependencies(path, text, F.col("document"))).alias("d")
    ).select("d.*")
    servers = (
        config_files.where(paths.is_mcp_config(path))
        .withColumn("document", F.try_parse_json(canonical_json(document_format(path), text)))
        .select(F.explode(tool_servers.dependencies(path, text, F.col("document"))).alias("d"))
        .select("d.*")
    )
    launched = servers.select(
        "name",
        "version",
        F.col("version").alias("constraint"),
        "ecosystem",
        "file",
        "line",
        "declaration",
        F.lit(False).alias("dev"),
    )
    return written(listed.unionByName(launched), "dependencies"), broken


def _skip(paths_frame: DataFrame, reason: str) -> DataFrame:
    return paths_frame.select(
        F.lit(reason).alias("reason"),
        "path",
        F.lit("").alias("detail"),
        F.col("path").alias("line"),
    )


def scan_files(
    files: DataFrame,
    *,
    advisory_table: DataFrame | None = None,
    offline: bool = True,
    include_observations: bool = False,
    skips: DataFrame | None = None,
    skip_generated: bool = False,
    incomplete: DataFrame | None = None,
) -> Scan:
    """Scan a table of files (columns ``path`` and ``content``).

    A file that several analysers claim goes to all of them. With ``skip_generated`` the rules leave
    out files whose bytes read like generated code, and a note says so. ``incomplete`` holds the pins
    whose advisories could not all be read; the lookup then counts as partial.
    """
    spark = files.sparkSession
    texts = staged(files, skip_generated)
    readable = texts.where("text IS NOT NULL")

    def of(name: str) -> DataFrame:
        return readable.where(F.col("stage") == name).where("generated IS NULL")

    python = written(python_facts.facts(of("python"), SINK_LEAVES), "python-facts")
    script = written(script_facts.facts(of("script")), "script-facts")
    dependencies, broken = declared(of("manifest"), of("config"))

    rule_findings = python_rules.findings(python).unionByName(script_rules.findings(script))
    ranked = rule_findings.select(*FINDING_FIELDS, F.lit(0).alias("analyser"), F.lit(0).alias("seq"))
    found = ranked.unionByName(config_findings(of("config")))
    pins = dependencies.select(
        manifests.unbounded_agent_finding(F.struct(*dependencies.columns)).alias("f")
    ).where("f IS NOT NULL")
    found = found.unionByName(
        pins.select("f.*", F.lit(report.ANALYSERS.index("pins")).alias("analyser"), F.lit(0).alias("seq"))
    )
    offline = offline or advisory_table is None
    if not offline:
        matched = advisories.findings(dependencies, advisory_table)
        found = found.unionByName(
            matched.select(
                *FINDING_FIELDS,
                F.lit(report.ANALYSERS.index("advisories")).alias("analyser"),
                F.lit(0).alias("seq"),
            )
        )
    kept = written(report.dedupe(found, ["analyser", "seq"]).select(*FINDING_FIELDS), "findings")

    generated = texts.where("generated IS NOT NULL").select(
        F.lit("generated").alias("reason"),
        "path",
        generated_reason(F.col("generated")).alias("detail"),
        F.concat("path", F.lit(" — generated: "), generated_reason(F.col("generated"))).alias("line"),
    )
    unpinned = dependencies.where("version IS NULL").select(
        F.lit("unpinned").alias("reason"),
        F.format_string("%s:%d", "file", "line").alias("path"),
        F.col("name").alias("detail"),
        manifests.unpinned_skip_line(F.struct(*dependencies.columns)).alias("line"),
    )
    unparseable = (
        python.where("fact = 'unparseable'")
        .select("path")
        .unionByName(script.where("fact = 'unparseable'").select("path"))
        .unionByName(broken)
        .unionByName(bad_services(of("config")))
    )
    notes = [
        generated,
        unpinned,
        _skip(texts.where("text IS NULL"), "unreadable"),
        _skip(unparseable, "unparseable"),
        *([skips] if skips is not None else []),
    ]
    every = notes[0]
    for note in notes[1:]:
        every = every.unionByName(note)
    every = written(every.distinct(), "skips")

    uncovered = every.where(F.col("reason").isin("generated", "unreadable", "unparseable")).select("path")
    covered = texts.select("path").distinct().join(uncovered.distinct(), "path", "left_anti")
    counted = report.counts(kept).select(
        covered.agg(F.count(F.lit(1))).scalar().alias("files_scanned"),
        every.agg(F.count(F.lit(1))).scalar().alias("files_skipped"),
        "defects",
        "observations",
    )
    return Scan(
        findings=report.numbered(report.visible(kept, include_observations)),
        counts=counted,
        skips=every,
        dependencies=dependencies,
        cve=advisories.status(dependencies, offline, incomplete),
        files=texts.select("path", "stage"),
    )


def scan_tree(spark: SparkSession, root: str, options: WalkOptions | None = None, **settings) -> Scan:
    """Scan a directory."""
    files, skips = read_tree(spark, root, options)
    return scan_files(files, skips=skips, **settings)
