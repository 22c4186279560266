"""Report-level operators on findings derived from events."""

from __future__ import annotations

from pyspark.sql import functions as F

from treesift.checks.derived import FINDINGS, SKIPS
from treesift.checks.registry import query, with_ctes
from treesift.plans import crosswalk, report, scoring, summary

_RANKS = """list_position(['defect', 'observation'], kind) AS kr, list_position(['low', 'medium', 'high', 'critical'], severity) AS sr,
  list_position(['low', 'medium', 'high'], confidence) AS cr"""
_RANKED = f"SELECT *, {_RANKS} FROM findings"


def findings(t):
    """The derived findings in the published shape, with the event as order of appearance."""
    names = F.filter(F.split("category_list", ","), lambda c: c != "")
    return t.derive(FINDINGS).select(
        "rule_id",
        "title",
        "kind",
        "severity",
        "confidence",
        names.alias("categories"),
        F.struct("file", F.col("line").cast("bigint").alias("line"), F.col("col").cast("bigint").alias("column")).alias("location"),
        "snippet",
        F.lit("").alias("description"),
        F.lit("").alias("remediation"),
        F.array().cast("array<string>").alias("secondary_rule_ids"),
        F.array().cast("array<string>").alias("references"),
        "event_id",
    )


def _place():
    return [
        F.col("location.file").alias("file"),
        F.col("location.line").alias("line"),
        F.col("location.column").alias("col"),
    ]


@query(
    "merge_same_location",
    with_ctes(
        """SELECT file, line, col, rule_id, kind, severity, confidence, array_to_string(list_sort(list_filter(ids, lambda i: i <> rule_id)), ',') AS secondary
        FROM (SELECT *, row_number() OVER (PARTITION BY file, line, col ORDER BY kr, sr DESC, cr DESC, rule_id) AS rn,
            list(DISTINCT rule_id) OVER (PARTITION BY file, line, col) AS ids FROM ranked) WHERE rn = 1""",
        findings=FINDINGS,
        ranked=_RANKED,
    ),
)
def merge_same_location(t):
    merged = report.merge_same_location(findings(t).drop("event_id"))
    return merged.select(
        *_place(),
        "rule_id",
        "kind",
        "severity",
        "confidence",
        F.array_join("secondary_rule_ids", ",").alias("secondary"),
    )


@query(
    "dedupe_first",
    with_ctes(
        """SELECT rule_id, file, line, col, title, event_id, severity FROM findings
        QUALIFY row_number() OVER (PARTITION BY rule_id, file, line, col, title ORDER BY event_id) = 1""",
        findings=FINDINGS,
    ),
)
def dedupe_first(t):
    kept = report.dedupe(findings(t), ["event_id"])
    return kept.select("rule_id", *_place(), "title", "event_id", "severity")


@query(
    "report_counts",
    with_ctes(
        """SELECT count(*) FILTER (kind = 'defect') AS defects, count(*) FILTER (kind = 'observation') AS observations,
          count(*) FILTER (kind = 'defect') AS shown FROM findings""",
        findings=FINDINGS,
    ),
)
def report_counts(t):
    found = findings(t)
    shown = report.visible(found, include_observations=False).agg(F.count(F.lit(1)))
    return report.counts(found).withColumn("shown", shown.scalar())


@query(
    "report_order",
    with_ctes(
        """SELECT event_id, row_number() OVER (ORDER BY kr, sr DESC, cr DESC, file, line, col, rule_id, title, event_id) - 1 AS index FROM ranked""",
        findings=FINDINGS,
        ranked=_RANKED,
    ),
)
def report_order(t):
    order = [*report.report_order(), F.col("event_id").asc()]
    return report.numbered(findings(t), order).select("event_id", "index")


@query(
    "layer_sections",
    with_ctes(
        """SELECT CAST(section_rank AS INTEGER) AS section_rank, ['entry', 'amplifier', 'impact', 'cross_layer', 'defense'][section_rank + 1] AS section, severity, kind, count(*) AS findings
        FROM (SELECT severity, kind, CASE category_list WHEN 'LLM10,ZT4' THEN 3 WHEN 'LLM06' THEN 2 WHEN 'LLM02,LLM09' THEN 1 WHEN '' THEN 3 ELSE 4 END AS section_rank FROM findings)
        GROUP BY ALL""",
        findings=FINDINGS,
    ),
)
def layer_sections(t):
    return report.sections(findings(t))


@query(
    "skip_groups",
    with_ctes(
        """SELECT reason, CAST(list_position(['excluded', 'ignore_file', 'generated', 'unreadable', 'unparseable', 'unpinned'], reason) - 1 AS INTEGER) AS reason_rank,
          count(*) AS entries, CASE reason
            WHEN 'excluded' THEN count(*) || ' paths were excluded by a pattern given on the command line:'
            WHEN 'generated' THEN count(*) || ' files were not parsed because their bytes say they are generated:'
            WHEN 'unreadable' THEN count(*) || ' files could not be read, or are not valid UTF-8:'
            WHEN 'unparseable' THEN count(*) || ' files could not be parsed:'
            ELSE count(*) || ' dependencies have unpinned versions and could not be matched to CVEs:' END AS sentence
        FROM (SELECT DISTINCT * FROM skips) GROUP BY reason""",
        skips=SKIPS,
    ),
)
def skip_groups(t):
    return report.skip_groups(t.derive(SKIPS))


@query(
    "skip_set",
    with_ctes("SELECT DISTINCT line, reason, path, detail FROM skips", skips=SKIPS),
)
def skip_set(t):
    return report.ordered_skips(t.derive(SKIPS))


@query(
    "skip_histogram",
    with_ctes("SELECT reason, count(*) AS entries FROM skips GROUP BY reason", skips=SKIPS),
)
def skip_histogram(t):
    return summary.skip_histogram(t.derive(SKIPS))


_CONTROL_ROWS = ", ".join(
    "('{}', '{}', {}, {})".format(f, c, i, "[" + ", ".join(f"'{x}'" for x in members) + "]")
    for i, (f, c, _, members) in enumerate(crosswalk.CONTROLS)
)
_PLACED = f"""SELECT fr.framework, f.event_id, f.kind, c.control FROM findings f
  CROSS JOIN (VALUES ('eu-ai-act'), ('nist-ai-rmf'), ('nist-genai')) fr(framework)
  LEFT JOIN (VALUES {_CONTROL_ROWS}) c(framework, control, pos, members)
    ON c.framework = fr.framework AND list_has_any(string_split(f.category_list, ','), c.members)"""


@query(
    "crosswalk_groups",
    with_ctes(
        """SELECT framework, control, count(*) AS findings, count(*) FILTER (kind = 'defect') AS defects,
          count(*) FILTER (kind = 'observation') AS observations FROM placed GROUP BY framework, control""",
        findings=FINDINGS,
        placed=_PLACED,
    ),
)
def crosswalk_groups(t):
    return crosswalk.groups(findings(t)).drop("framework_rank", "control_rank")


@query(
    "crosswalk_memberships",
    with_ctes("SELECT event_id, framework, control FROM placed", findings=FINDINGS, placed=_PLACED),
)
def crosswalk_memberships(t):
    return crosswalk.memberships(findings(t), "event_id").select("event_id", "framework", "control")


# Many distinct rule ids, so that the size budget cuts the list.
_WIDE = FINDINGS.replace(
    "concat('R-', event_type, CASE WHEN event_id % 7 = 0 THEN '-X' ELSE '' END)",
    "concat('R-', event_type, '-', CAST(user_id % 90 AS STRING))",
)


@query(
    "summary_groups",
    with_ctes(
        """SELECT rule_id, severity, kind, count, position, body_bytes, true AS kept
        FROM (SELECT *, row_number() OVER w AS position,
            CAST(sum(strlen('{"rule_id":"' || rule_id || '","severity":"' || severity || '","kind":"' || kind || '","count":' || count || '}') + 1) OVER w - 1 AS BIGINT) AS body_bytes
          FROM (SELECT rule_id, severity, kind, kr, sr, count(*) AS count FROM ranked GROUP BY ALL)
          WINDOW w AS (ORDER BY sr DESC, count DESC, rule_id, kr))""",
        findings=_WIDE,
        ranked=_RANKED,
    ),
)
def summary_groups(t):
    found = t.derive(_WIDE)
    return summary.ranked_groups(summary.finding_groups(found))


@query(
    "gate_outcomes",
    with_ctes(
        """SELECT threshold, CAST(max(CASE WHEN kind = 'defect' AND sr >= pos THEN 1 ELSE 0 END) AS BIGINT) AS exit_code
        FROM ranked, (VALUES ('low', 1), ('medium', 2), ('high', 3), ('critical', 4), ('never', 9)) v(threshold, pos)
        GROUP BY threshold""",
        findings=FINDINGS,
        ranked=_RANKED,
    ),
)
def gate_outcomes(t):
    found = findings(t)
    frames = [
        report.gate(found, level).select(F.lit(level or "never").alias("threshold"), "exit_code")
        for level in ("low", "medium", "high", "critical", None)
    ]
    result = frames[0]
    for frame in frames[1:]:
        result = result.unionByName(frame)
    return result


EXPECTATIONS = """
SELECT CASE event_id % 10 WHEN 0 THEN 'expect_none' WHEN 1 THEN 'known_gap' WHEN 2 THEN 'known_false_positive' ELSE 'expect' END AS entry,
  CASE event_id % 10 WHEN 0 THEN concat('u', CAST(user_id AS STRING), '.py', CASE WHEN user_id % 5 = 0 THEN '' ELSE 'x' END)
    ELSE concat('u', CAST(user_id AS STRING), '.py') END AS file,
  event_id % 13 + 1 AS line,
  CASE WHEN event_id % 4 = 0 THEN concat('R-', event_type) ELSE NULL END AS rule,
  CASE event_type WHEN 'view' THEN 'ZT4' WHEN 'click' THEN 'LLM06' WHEN 'error' THEN 'LLM09' ELSE 'ZT6' END AS category,
  CASE WHEN event_id % 3 = 0 THEN 'observation' ELSE 'defect' END AS kind,
  CASE WHEN value < 5 THEN 'low' WHEN value < 15 THEN 'medium' WHEN value < 30 THEN 'high' ELSE 'critical' END AS severity
FROM events
"""


def _expectations(t):
    return t.derive(EXPECTATIONS).withColumn("line", F.col("line").cast("bigint"))


_MATCH = "f.file = e.file AND f.line = e.line AND list_contains(string_split(f.category_list, ','), e.category)"
_RULE = " AND (e.rule IS NULL OR e.rule = f.rule_id)"


@query(
    "score_outcomes",
    with_ctes(
        f"""SELECT file, line, rule, category, kind, severity, CASE WHEN bool_or(ok) THEN 'matched' WHEN bool_or(found) THEN 'mismatched' ELSE 'missing' END AS outcome
        FROM (SELECT e.*, f.event_id IS NOT NULL AS found, coalesce(f.kind = e.kind AND f.severity = e.severity, false) AS ok
          FROM expectations e LEFT JOIN findings f ON {_MATCH}{_RULE} WHERE e.entry = 'expect') GROUP BY ALL""",
        findings=FINDINGS,
        expectations=EXPECTATIONS,
    ),
)
def score_outcomes(t):
    return scoring.outcomes(_expectations(t), findings(t))


@query(
    "score_recall",
    with_ctes(
        f"""SELECT kind, count(*) AS ready, count(*) FILTER (ok) AS matched, round(count(*) FILTER (ok) / count(*) * 100, 2) AS percent
        FROM (SELECT file, line, rule, category, kind, severity, bool_or(ok) AS ok
          FROM (SELECT e.*, coalesce(f.kind = e.kind AND f.severity = e.severity, false) AS ok
            FROM expectations e LEFT JOIN findings f ON {_MATCH}{_RULE} WHERE e.entry = 'expect') GROUP BY ALL) GROUP BY kind""",
        findings=FINDINGS,
        expectations=EXPECTATIONS,
    ),
)
def score_recall(t):
    return scoring.recall(_expectations(t), findings(t))


@query(
    "score_precision",
    with_ctes(
        f"""SELECT count(*) FILTER (ok) AS correct, count(*) AS returned, round(count(*) FILTER (ok) * 100 / count(*), 2) AS percent
        FROM (SELECT EXISTS (SELECT 1 FROM expectations e WHERE {_MATCH} AND ((e.entry = 'expect' AND e.kind = 'defect' AND (e.rule IS NULL OR e.rule = f.rule_id))
            OR e.entry = 'known_gap')) AS ok FROM findings f WHERE f.kind = 'defect')""",
        findings=FINDINGS,
        expectations=EXPECTATIONS,
    ),
)
def score_precision(t):
    return scoring.precision(_expectations(t), findings(t))


@query(
    "score_unaccounted",
    with_ctes(
        f"""SELECT event_id, rule_id FROM findings f WHERE NOT EXISTS (SELECT 1 FROM expectations e WHERE {_MATCH}
            AND ((e.entry = 'expect' AND (e.rule IS NULL OR e.rule = f.rule_id)) OR e.entry IN ('known_gap', 'known_false_positive')))
          AND file NOT IN (SELECT file FROM expectations WHERE entry = 'expect_none')""",
        findings=FINDINGS,
        expectations=EXPECTATIONS,
    ),
)
def score_unaccounted(t):
    return scoring.unaccounted(_expectations(t), findings(t)).select("event_id", "rule_id")


@query(
    "score_violations",
    with_ctes(
        "SELECT event_id, file FROM findings WHERE file IN (SELECT file FROM expectations WHERE entry = 'expect_none')",
        findings=FINDINGS,
        expectations=EXPECTATIONS,
    ),
)
def score_violations(t):
    found = scoring.violations(_expectations(t), findings(t))
    return found.select("event_id", F.col("location.file").alias("file"))


@query(
    "score_promotable",
    with_ctes(
        f"""SELECT entry, file, line, category FROM expectations e WHERE
          (entry = 'known_gap' AND EXISTS (SELECT 1 FROM findings f WHERE {_MATCH}))
          OR (entry = 'known_false_positive' AND NOT EXISTS (SELECT 1 FROM findings f WHERE {_MATCH}))""",
        findings=FINDINGS,
        expectations=EXPECTATIONS,
    ),
)
def score_promotable(t):
    e, f = _expectations(t), findings(t)
    columns = ("entry", "file", "line", "category")
    found = scoring.promotable(e, f).select(*columns)
    return found.unionByName(scoring.resolved_false_positives(e, f).select(*columns))
