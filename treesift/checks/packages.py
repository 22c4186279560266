"""Dependency manifests and advisories."""

from __future__ import annotations

from pyspark.sql import functions as F

from treesift.checks.derived import (
    CARGO_FILES,
    PACKAGE_FILES,
    PYPROJECT_FILES,
    REQUIREMENT_FILES,
)
from treesift.checks.files import RAWS, _document
from treesift.checks.registry import query, with_ctes
from treesift.checks.texts import flat
from treesift.operators import advisories, manifests

SPECS = r"""SELECT path, line, body, name, rest,
    CASE WHEN regexp_matches(rest, '^==') AND trim(substr(rest, 3)) <> '' AND NOT regexp_matches(rest, '[,*]') THEN trim(substr(rest, 3)) END AS version,
    CASE WHEN rest = '' THEN '*' ELSE rest END AS "constraint"
  FROM (SELECT path, line, body, regexp_extract(spec, '^([^\[=<>!~\s]+)', 1) AS name,
      trim(regexp_replace(trim(regexp_replace(spec, '^[^\[=<>!~\s]+', '')), '^\[[^\]]*\]', '')) AS rest
    FROM (SELECT *, trim(split_part(body, ';', 1)) AS spec FROM bodies))
  WHERE name <> ''"""
BODIES = r"""SELECT path, line, trim(split_part(raw, '#', 1)) AS body FROM raws
  WHERE trim(split_part(raw, '#', 1)) <> '' AND NOT starts_with(trim(raw), '-') AND NOT contains(raw, '://')"""


def _rows(files, document):
    array = manifests.dependencies(F.col("path"), F.col("text"), document)
    return files.select(F.explode(array).alias("d")).select("d.*")


@query(
    "requirements_parse",
    with_ctes(
        """SELECT path AS file, line, name, version, "constraint", 'PyPI' AS ecosystem, body AS declaration, false AS dev FROM specs""",
        files=REQUIREMENT_FILES,
        raws=RAWS,
        bodies=BODIES,
        specs=SPECS,
    ),
)
def requirements_parse(t):
    return _rows(t.derive(REQUIREMENT_FILES), F.lit(None).cast("variant"))


_EXACT = r"regexp_matches(trim(regexp_replace(trim(spec), '^=', '')), '^[0-9]+([.][0-9]+)*([-+].*)?$')"
_DECLARED = rf"""SELECT d.path AS file, d.line, d.name, CASE WHEN {_EXACT} THEN trim(regexp_replace(trim(spec), '^=', '')) END AS version,
    spec AS "constraint", d.ecosystem, trim(r.raw) AS declaration, d.dev FROM declared d JOIN raws r ON r.path = d.path AND r.line = d.line"""


@query(
    "package_json_parse",
    with_ctes(
        _DECLARED,
        files=PACKAGE_FILES,
        raws=RAWS,
        keyed="""SELECT path, CAST(regexp_extract(path, '[0-9]+') AS BIGINT) AS k, json_valid(text) AS valid,
            CASE WHEN json_valid(text) THEN text::JSON END AS doc FROM files""",
        declared="""SELECT path, CAST(line AS BIGINT) AS line, name, spec, 'npm' AS ecosystem, dev FROM (
            SELECT path, 3 AS line, 'openai' AS name, CASE k % 4 WHEN 0 THEN '*' WHEN 1 THEN '=4.1.0-rc.1' WHEN 2 THEN '^4.0.0' ELSE 'latest' END AS spec, false AS dev, valid FROM keyed
            UNION ALL SELECT path, 4, 'part-' || k, json_extract_string(doc, '$.dependencies."part-' || k || '"'), false, valid FROM keyed WHERE valid
            UNION ALL SELECT path, 6, '@langchain/core', 'x', true, valid FROM keyed) WHERE valid""",
    ),
)
def package_json_parse(t):
    files = t.derive(PACKAGE_FILES).withColumn("document", _document("json"))
    return _rows(files, F.col("document"))


@query(
    "pyproject_parse",
    with_ctes(
        """SELECT file, line, name, version, "constraint", 'PyPI' AS ecosystem, declaration, false AS dev FROM (
          SELECT path AS file, line, name, version, "constraint", trim(raw) AS declaration FROM specs JOIN raws USING (path, line)
          UNION ALL
          SELECT path, line, split_part(raw, ' ', 1), CASE WHEN regexp_matches(v, '^=?[0-9.]+$') THEN ltrim(v, '=') END, v, trim(raw)
          FROM (SELECT *, regexp_extract(raw, '"([^"]*)"', 1) AS v FROM raws WHERE regexp_matches(raw, '^(openai|extra) = ')))""",
        files=PYPROJECT_FILES,
        raws=RAWS,
        bodies="""SELECT path, line, regexp_extract(raw, '"([^"]*)"', 1) AS body FROM raws WHERE regexp_matches(raw, '^  "')""",
        specs=SPECS,
    ),
)
def pyproject_parse(t):
    files = t.derive(PYPROJECT_FILES).withColumn("document", _document("toml"))
    return _rows(files, F.col("document"))


@query(
    "cargo_parse",
    with_ctes(
        """SELECT path AS file, line, split_part(raw, ' ', 1) AS name, CASE WHEN regexp_matches(v, '^=?[0-9.]+$') THEN ltrim(v, '=') END AS version,
          v AS "constraint", 'crates.io' AS ecosystem, trim(raw) AS declaration, false AS dev
        FROM (SELECT *, regexp_extract(raw, '"([0-9=~.]*)"', 1) AS v FROM raws WHERE line IN (4, 5))""",
        files=CARGO_FILES,
        raws=RAWS,
    ),
)
def cargo_parse(t):
    files = t.derive(CARGO_FILES).withColumn("document", _document("toml"))
    return _rows(files, F.col("document"))


@query(
    "manifest_failures",
    """SELECT concat('p', CAST(p_partkey AS STRING), '/package.json') AS path, 'unparseable' AS reason
    FROM part WHERE p_partkey % 13 = 12""",
)
def manifest_failures(t):
    files = t.derive(PACKAGE_FILES).withColumn("document", _document("json"))
    return files.where("document IS NULL").select("path", F.lit("unparseable").alias("reason"))


@query(
    "unpinned_skips",
    with_ctes(
        """SELECT DISTINCT 'unpinned' AS reason, path || ':' || line AS path, name AS detail,
          path || ':' || line || ' — ' || name || ' ' || "constraint" || ' is not pinned, so CVEs were not checked' AS line
        FROM specs WHERE version IS NULL""",
        files=REQUIREMENT_FILES,
        raws=RAWS,
        bodies=BODIES,
        specs=SPECS,
    ),
)
def unpinned_skips(t):
    rows = _rows(t.derive(REQUIREMENT_FILES), F.lit(None).cast("variant")).where("version IS NULL")
    # The four columns decide the texts: made distinct first, the rows in memory are a third as wide.
    rows = rows.select("file", "line", "name", "constraint").distinct()
    d = F.struct(*rows.columns)
    return rows.select(
        F.lit("unpinned").alias("reason"),
        F.format_string("%s:%d", "file", "line").alias("path"),
        F.col("name").alias("detail"),
        manifests.unpinned_skip_line(d).alias("line"),
    )


@query(
    "agent_pin_findings",
    with_ctes(
        r"""SELECT 'BAS-LLM04-001' AS rule_id, 'observation' AS kind, 'low' AS severity, path AS file, line, CAST(1 AS BIGINT) AS col,
          name || "constraint" AS snippet
        FROM specs WHERE version IS NULL AND name IN ('langchain', 'crewai')
          AND ("constraint" IN ('*', 'x') OR regexp_matches("constraint", '^>=? *[A-Za-z0-9.+-]+$'))""",
        files=REQUIREMENT_FILES,
        raws=RAWS,
        bodies=BODIES,
        specs=SPECS,
    ),
)
def agent_pin_findings(t):
    rows = _rows(t.derive(REQUIREMENT_FILES), F.lit(None).cast("variant"))
    found = manifests.unbounded_agent_finding(F.struct(*rows.columns))
    return flat(rows, F.array_compact(F.array(found)))


# Every line item declares a package pin; every supplier publishes an advisory with two segments.
PINS = """
SELECT concat('Pkg', CAST(l_suppkey % 40 AS STRING)) AS name, concat('1.', CAST(l_linenumber AS STRING), '.', CAST(CAST(l_quantity AS INT) AS STRING)) AS version,
  'PyPI' AS ecosystem, concat('o', CAST(l_orderkey AS STRING), '/requirements.txt') AS file, CAST(l_linenumber AS BIGINT) AS line,
  concat('row ', CAST(l_partkey AS STRING)) AS declaration
FROM lineitem
"""
ADVISORIES = """
SELECT concat('OSV-', CAST(s_suppkey AS STRING)) AS id, concat('pkg', CAST(s_suppkey % 40 AS STRING)) AS package,
  CASE s_suppkey % 5 WHEN 0 THEN 'npm' ELSE 'PyPI' END AS ecosystem,
  CASE s_suppkey % 3 WHEN 0 THEN concat('CVE-', CAST(s_suppkey % 60 AS STRING)) ELSE concat('ALIAS-', CAST(s_suppkey AS STRING)) END AS alias,
  CASE s_suppkey % 4 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'moderate' WHEN 2 THEN NULL ELSE 'CRITICAL' END AS db_severity,
  concat(CAST(s_suppkey % 10 AS STRING), '.5') AS score,
  CASE s_suppkey % 6 WHEN 0 THEN '' ELSE concat('Summary of ', s_name) END AS summary,
  CASE s_nationkey % 2 WHEN 0 THEN '0' ELSE '1.1' END AS intro1,
  concat('1.', CAST(s_nationkey % 4 AS STRING), CASE s_suppkey % 7 WHEN 0 THEN '.5-rc1' ELSE '.9' END) AS fix1,
  concat('1.', CAST(s_nationkey % 4 + 2 AS STRING)) AS intro2,
  CASE s_suppkey % 2 WHEN 0 THEN concat('1.', CAST(s_nationkey % 4 + 4 AS STRING), '.0') ELSE NULL END AS fix2,
  CASE s_suppkey % 2 WHEN 1 THEN concat('1.', CAST(s_nationkey % 4 + 3 AS STRING), '.20') ELSE NULL END AS last2
FROM supplier
"""

_D = "list_transform(regexp_extract_all({0}, '[0-9]+'), lambda d: CAST(d AS BIGINT))"


def _digits(column: str) -> str:
    return _D.format(column)


MATCHED = rf"""SELECT ecosystem, name, version, id, identifier, severity, summary, CASE WHEN in1 THEN fix1 WHEN in2f THEN fix2 ELSE fix1 END AS fix
  FROM (SELECT p.ecosystem, p.name, p.version, a.id, a.summary, a.fix1, a.fix2,
      CASE WHEN starts_with(a.alias, 'CVE-') THEN a.alias ELSE a.id END AS identifier,
      CASE upper(coalesce(a.db_severity, '')) WHEN 'HIGH' THEN 'high' WHEN 'MODERATE' THEN 'medium' WHEN 'CRITICAL' THEN 'critical'
        ELSE CASE WHEN CAST(a.score AS DOUBLE) >= 9 THEN 'critical' WHEN CAST(a.score AS DOUBLE) >= 7 THEN 'high' WHEN CAST(a.score AS DOUBLE) >= 4 THEN 'medium' ELSE 'low' END END AS severity,
      (a.intro1 = '0' OR {_digits('p.version')} >= {_digits('a.intro1')}) AND {_digits('p.version')} < {_digits('a.fix1')} AS in1,
      a.fix2 IS NOT NULL AND {_digits('p.version')} >= {_digits('a.intro2')} AND {_digits('p.version')} < {_digits('a.fix2')} AS in2f,
      a.last2 IS NOT NULL AND {_digits('p.version')} >= {_digits('a.intro2')} AND {_digits('p.version')} <= {_digits('a.last2')} AS in2l
    FROM (SELECT DISTINCT ecosystem, name, version FROM pins) p JOIN advisories a ON lower(p.name) = a.package AND p.ecosystem = a.ecosystem)
  WHERE in1 OR in2f OR in2l"""


def _advisories(t):
    def event(introduced=None, fixed=None, last=None):
        parts = {"introduced": introduced, "fixed": fixed, "last_affected": last}
        return F.struct(
            *[(F.col(v) if v else F.lit(None).cast("string")).alias(k) for k, v in parts.items()]
        )

    events = F.array(
        event(introduced="intro1"),
        event(fixed="fix1"),
        event(introduced="intro2"),
        event(fixed="fix2", last="last2"),
    )
    sha = F.array(F.struct(F.lit("0").alias("introduced"), F.lit("9f2c").alias("fixed"), F.lit(None).cast("string").alias("last_affected")))
    ranges = F.array(
        F.struct(F.lit("GIT").alias("type"), sha.alias("events")),
        F.struct(F.lit("ECOSYSTEM").alias("type"), events.alias("events")),
    )
    return t.derive(ADVISORIES).select(
        "id",
        F.array("alias").alias("aliases"),
        "summary",
        "db_severity",
        F.array("score").alias("scores"),
        "package",
        "ecosystem",
        ranges.alias("ranges"),
        F.array().cast("array<string>").alias("versions"),
    )


@query("advisory_matches", with_ctes("SELECT ecosystem, name, version, id, identifier, severity, fix FROM matched", pins=PINS, advisories=ADVISORIES, matched=MATCHED))
def advisory_matches(t):
    found = advisories.matches(advisories.pins(t.derive(PINS)), _advisories(t))
    return found.select("ecosystem", "name", "version", "id", "identifier", "severity", "fix")


@query(
    "advisory_findings",
    with_ctes(
        rf"""SELECT p.file, p.line, 'BAS-CVE-001' AS rule_id, g.severity, p.declaration AS snippet, array_to_string(g.refs, ',') AS refs,
          CASE WHEN len(g.refs) = 1 THEN p.name || ' ' || p.version || ' is affected by ' || g.refs[1]
            ELSE p.name || ' ' || p.version || ' — ' || len(g.refs) || ' known vulnerabilities' END AS title,
          CASE WHEN len(g.refs) = 1 THEN p.name || ' ' || p.version || CASE WHEN g.summary = '' THEN ' is affected by a published advisory.' ELSE ': ' || g.summary END
            ELSE p.name || ' ' || p.version || ' has ' || len(g.refs) || ' published advisories against it (' || g.spread || ').' END AS description,
          CASE WHEN g.target IS NULL THEN 'No fixed version of ' || p.name || ' is published yet; track the advisories.'
            WHEN g.unfixed THEN 'Upgrade ' || p.name || ' to ' || g.target || ' or later; at least one advisory has no fix yet.'
            WHEN len(g.refs) = 1 THEN 'Upgrade ' || p.name || ' to ' || g.target || ' or later.'
            ELSE 'Upgrade ' || p.name || ' to ' || g.target || ' or later, which resolves all ' || len(g.refs) || '.' END AS remediation
        FROM pins p JOIN grouped g USING (ecosystem, name, version)""",
        pins=PINS,
        advisories=ADVISORIES,
        matched=MATCHED,
        grouped=rf"""SELECT ecosystem, name, version, list_sort(list(DISTINCT identifier)) AS refs, arg_min(summary, id) AS summary,
            ['low', 'medium', 'high', 'critical'][max(list_position(['low', 'medium', 'high', 'critical'], severity))] AS severity,
            arg_max(fix, {_digits('fix')}) FILTER (regexp_full_match(fix, '[0-9.]+')) AS target,
            bool_or(NOT regexp_full_match(fix, '[0-9.]+')) AS unfixed,
            array_to_string(list_filter([CASE WHEN count(*) FILTER (severity = 'critical') > 0 THEN count(*) FILTER (severity = 'critical') || ' critical' END,
              CASE WHEN count(*) FILTER (severity = 'high') > 0 THEN count(*) FILTER (severity = 'high') || ' high' END,
              CASE WHEN count(*) FILTER (severity = 'medium') > 0 THEN count(*) FILTER (severity = 'medium') || ' medium' END,
              CASE WHEN count(*) FILTER (severity = 'low') > 0 THEN count(*) FILTER (severity = 'low') || ' low' END], lambda x: x IS NOT NULL), ', ') AS spread
          FROM matched GROUP BY ecosystem, name, version""",
    ),
)
def advisory_findings(t):
    pins = t.derive(PINS)
    per_pin = advisories.pin_findings(pins, _advisories(t)).withColumn("refs", F.array_join("references", ","))
    found = advisories.declared(pins, per_pin)
    return found.select(
        F.col("location.file").alias("file"),
        F.col("location.line").alias("line"),
        "rule_id",
        "severity",
        "snippet",
        "refs",
        "title",
        "description",
        "remediation",
    )


@query(
    "advisory_status",
    with_ctes(
        """SELECT 'partial' AS status, count(*) AS dependencies, count(*) FILTER (WHERE name = 'Pkg1') AS incomplete, CAST(NULL AS VARCHAR) AS reason FROM pins""",
        pins=PINS,
    ),
)
def advisory_status(t):
    pins = t.derive(PINS)
    return advisories.status(pins, offline=False, incomplete=pins.where("name = 'Pkg1'"))
