"""Walking, rendering, environment: the ends of the pipeline on derived rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from treesift.checks.derived import FINDINGS, PATHS
from treesift.checks.registry import query, with_ctes
from treesift.checks.reports import findings
from treesift.plans import render, report
from treesift.sources import environment
from treesift.sources.tree import WalkOptions, ignore_patterns, select_files

# A listing with hidden places, and ignore files in some of its directories.
LISTING = f"""
SELECT page_id, concat(CASE page_id % 6 WHEN 0 THEN '' WHEN 1 THEN concat('r', CAST(page_id % 10 AS STRING), '/') WHEN 2 THEN '.claude/'
    WHEN 3 THEN '.cache/' WHEN 4 THEN 'vendor/lib/' ELSE '.github/workflows/' END, path) AS path FROM ({PATHS})
"""
IGNORES = """
SELECT DISTINCT concat(CASE page_id % 10 WHEN 0 THEN '' ELSE concat('r', CAST(page_id % 10 AS STRING), '/') END, '.gitignore') AS path,
  concat('# rules', chr(10), CASE page_id % 10 WHEN 0 THEN concat('vendor/', chr(10), '*.md') WHEN 1 THEN concat('*.py', chr(10), '!main.py')
    WHEN 2 THEN '/src' WHEN 3 THEN '**/unit/*.py' ELSE 'nothing-here' END, chr(10)) AS text
FROM pages
"""

_WALK = r"""SELECT DISTINCT path FROM listing WHERE NOT regexp_matches(path, '(^|/)(node_modules|[.]git)(/|$)')
  AND len(string_split(path, '/')) <= 4
  AND (NOT regexp_matches(path, '(^|/)[.]') OR regexp_matches(path, '^[.]claude/') OR regexp_matches(path, '^[.]github/workflows/')
    OR regexp_matches(path, '^[.]env([.][^/]*)?$'))
  AND NOT regexp_matches(path, '(^|/)vendor/') AND NOT regexp_matches(path, '[.]md$')
  AND NOT (regexp_matches(path, '^r1/.*[.]py$') AND NOT regexp_matches(path, '/main[.]py$'))
  AND NOT regexp_matches(path, '^r2/src/') AND NOT regexp_matches(path, '^r3/(.*/)?unit/[^/]*[.]py$')"""


def _walk(t, **options):
    ignores = ignore_patterns(t.derive(IGNORES))
    return select_files(
        t.derive(LISTING).select("path").distinct(), ignores, WalkOptions(max_depth=4, **options)
    )


@query("walk_kept", with_ctes(f"SELECT path FROM ({_WALK}) WHERE NOT regexp_matches(path, '(^|/)contest/') AND NOT regexp_matches(path, '[.]tsx$')", paths=PATHS, listing=LISTING))
def walk_kept(t):
    kept, _ = _walk(t, excludes=("contest/", "*.tsx"))
    return kept.select("path")


@query(
    "walk_excluded",
    with_ctes(
        f"""SELECT DISTINCT 'excluded' AS reason, shown AS path, pattern AS detail, shown || ' — excluded by pattern "' || pattern || '"' AS line
        FROM (SELECT CASE WHEN regexp_matches(path, '(^|/)contest/') THEN regexp_extract(path, '^(.*?contest/)', 1) ELSE path END AS shown,
            CASE WHEN regexp_matches(path, '(^|/)contest/') THEN 'contest/' ELSE '*.tsx' END AS pattern
          FROM ({_WALK}) WHERE regexp_matches(path, '(^|/)contest/') OR regexp_matches(path, '[.]tsx$'))""",
        paths=PATHS,
        listing=LISTING,
    ),
)
def walk_excluded(t):
    _, notes = _walk(t, excludes=("contest/", "*.tsx"))
    return notes


@query(
    "finding_json",
    with_ctes(
        """SELECT event_id, '{"rule_id":"' || rule_id || '","title":"' || title || '","kind":"' || kind || '","severity":"' || severity
          || '","confidence":"' || confidence || '","categories":[' || CASE WHEN category_list = '' THEN '' ELSE '"' || replace(category_list, ',', '","') || '"' END
          || '],"location":{"file":"' || file || '","line":' || line || ',"column":' || col || '},"snippet":"' || replace(snippet, '"', chr(92) || '"')
          || '","description":"","remediation":""}' AS json FROM findings""",
        findings=FINDINGS,
    ),
)
def finding_json(t):
    return findings(t).select("event_id", render.finding_json().alias("json"))


_INDEXED = """SELECT *, row_number() OVER (ORDER BY list_position(['defect', 'observation'], kind), list_position(['low', 'medium', 'high', 'critical'], severity) DESC,
    list_position(['low', 'medium', 'high'], confidence) DESC, file, line, col, rule_id, title, event_id) - 1 AS index FROM findings"""


def _numbered(t):
    return report.numbered(findings(t), [*report.report_order(), F.col("event_id").asc()])


@query(
    "sarif_results",
    with_ctes(
        """SELECT i.index, i.rule_id, r.rule_index, CASE WHEN kind = 'observation' THEN 'note' WHEN severity IN ('critical', 'high') THEN 'error'
            WHEN severity = 'medium' THEN 'warning' ELSE 'note' END AS level, file AS uri, CAST(line AS VARCHAR) AS line
        FROM indexed i JOIN (SELECT rule_id, CAST(row_number() OVER (ORDER BY min(index)) - 1 AS VARCHAR) AS rule_index FROM indexed GROUP BY rule_id) r USING (rule_id)""",
        findings=FINDINGS,
        indexed=_INDEXED,
    ),
)
def sarif_results(t):
    results = render.sarif_results(_numbered(t))

    def at(path: str):
        return F.get_json_object("json", path)

    return results.select(
        F.col("index"),
        at("$.ruleId").alias("rule_id"),
        at("$.ruleIndex").alias("rule_index"),
        at("$.level").alias("level"),
        at("$.locations[0].physicalLocation.artifactLocation.uri").alias("uri"),
        at("$.locations[0].physicalLocation.region.startLine").alias("line"),
    )


@query(
    "sarif_rules",
    with_ctes(
        """SELECT rule_id, CAST(row_number() OVER (ORDER BY min(index)) - 1 AS BIGINT) AS rule_index, arg_min(title, index) AS name,
          CAST(CASE arg_min(category_list, index) WHEN '' THEN 0 WHEN 'LLM06' THEN 2 WHEN 'ZT6' THEN 3 WHEN 'LLM10,ZT4' THEN 3 ELSE 5 END AS INTEGER) AS relationships
        FROM indexed GROUP BY rule_id""",
        findings=FINDINGS,
        indexed=_INDEXED,
    ),
)
def sarif_rules(t):
    rules = render.sarif_rules(_numbered(t))
    related = F.from_json(F.get_json_object("json", "$.relationships"), "array<struct<kinds:array<string>>>")
    return rules.select(
        "rule_id",
        F.col("rule_index").cast("bigint").alias("rule_index"),
        F.get_json_object("json", "$.name").alias("name"),
        F.coalesce(F.when(related.isNotNull(), F.size(related)), F.lit(0)).alias("relationships"),
    )


CONFIGS = """
SELECT s_suppkey, concat('[core]', chr(10), chr(9), 'bare = false', chr(10),
  CASE s_suppkey % 5 WHEN 0 THEN '[remote `up]`] url = git@github.com:up/x.git^' WHEN 1 THEN '' ELSE '; note^' END,
  '[Remote `', CASE s_suppkey % 3 WHEN 0 THEN 'origin' ELSE 'fork' END, '`]^',
  '  URL = `https://github.com/o/r', CAST(s_suppkey AS STRING), '.git` # mine^  url = https://github.com/o/second^',
  '[branch `main`]^  url = https://github.com/o/none^') AS raw FROM supplier
"""
CONFIG_TEXTS = f"SELECT s_suppkey, replace(replace(raw, '`', chr(34)), '^', chr(10)) AS text FROM ({CONFIGS})"


@query(
    "git_config_remotes",
    """SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 OR s_suppkey % 5 <> 0 THEN 'https://github.com/o/r' || s_suppkey || '.git' END AS chosen,
      CASE WHEN s_suppkey % 3 = 0 OR s_suppkey % 5 <> 0 THEN 'github.com/o/r' || s_suppkey END AS normalised,
      CASE WHEN s_suppkey % 5 = 0 THEN 2 ELSE 1 END AS remotes FROM supplier""",
)
def git_config_remotes(t):
    from treesift.functions.remotes import normalise

    text = F.col("text")
    chosen = t.derive(CONFIG_TEXTS).select(
        "s_suppkey",
        environment.chosen_remote(text).alias("chosen"),
        F.size(environment.config_remotes(text)).alias("remotes"),
    )
    return chosen.select("s_suppkey", "chosen", normalise(F.col("chosen")).alias("normalised"), "remotes")


@query(
    "environment_kinds",
    """SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'github-actions' WHEN 1 THEN 'gitlab-ci' WHEN 2 THEN 'other-ci' WHEN 3 THEN 'other-ci' ELSE 'local' END AS kind,
      CASE event_id % 6 WHEN 0 THEN 'github.com/o/r' || user_id WHEN 1 THEN 'git.example.com/g/s/p' || user_id END AS remote FROM events""",
)
def environment_kinds(t):
    raw = t.derive(
        """SELECT event_id, CASE event_id % 6
            WHEN 0 THEN concat('GITHUB_ACTIONS=true;GITHUB_SERVER_URL=https://GitHub.com;GITHUB_REPOSITORY=O/R', CAST(user_id AS STRING))
            WHEN 1 THEN concat('GITLAB_CI=true;CI=true;CI_SERVER_HOST=git.example.com:443;CI_PROJECT_PATH=g/s/P', CAST(user_id AS STRING))
            WHEN 2 THEN 'CI=1' WHEN 3 THEN 'TRAVIS=x;CI=false' WHEN 4 THEN 'CI=False' ELSE 'HOME=/x' END AS vars FROM events"""
    )
    variables = F.str_to_map("vars", F.lit(";"), F.lit("="))
    return raw.select(
        "event_id",
        environment.environment(variables).alias("kind"),
        environment.variables_remote(variables).alias("remote"),
    )


@query(
    "status_sentences",
    """SELECT s_suppkey, CASE s_suppkey % 5 WHEN 0 THEN 'CVE lookup: ' || CASE WHEN s_nationkey = 1 THEN '1 dependency' ELSE s_nationkey || ' dependencies' END || ' checked.'
        WHEN 1 THEN 'CVE lookup incomplete: ' || CASE WHEN s_nationkey = 1 THEN '1 dependency' ELSE s_nationkey || ' dependencies' END || ' checked, results may be missing for 2.'
        WHEN 2 THEN 'CVE lookup skipped: timeout.' WHEN 3 THEN 'CVE lookup: no pinned dependencies found.' ELSE 'CVE lookup skipped: offline.' END AS cve,
      CASE WHEN s_nationkey = 1 THEN '1 defect' ELSE s_nationkey || ' defects' END || ', ' || CASE WHEN s_suppkey = 1 THEN '1 observation' ELSE s_suppkey || ' observations' END AS counts,
      CASE s_suppkey % 5 WHEN 0 THEN 'ok' WHEN 3 THEN 'skipped' WHEN 4 THEN 'offline' ELSE 'failed' END AS lookup FROM supplier""",
)
def status_sentences(t):
    from treesift.plans.summary import lookup_outcome

    names = F.array(*[F.lit(s) for s in ("checked", "partial", "unreachable", "no_manifest", "skipped_offline")])
    status = F.get(names, (F.col("s_suppkey") % 5).cast("int"))
    n = F.col("s_nationkey").cast("bigint")
    return t.supplier.select(
        "s_suppkey",
        render.cve_sentence(status, n, F.lit(2).cast("bigint"), F.lit("timeout")).alias("cve"),
        render.counts_sentence(n, F.col("s_suppkey")).alias("counts"),
        lookup_outcome(status).alias("lookup"),
    )
