"""Source rules: Python with provenance, scripts, parse failures, function relations."""

from __future__ import annotations

from pyspark.sql import functions as F

from treesift.checks.derived import COMPONENT_FILES, PYTHON_FILES, SCOPE_FILES, SCRIPT_FILES
from treesift.checks.files import RAWS
from treesift.checks.registry import query, with_ctes
from treesift.operators import name_lookup, provenance, python_rules, script_rules
from treesift.session import written
from treesift.sources import python_facts, python_names, script_facts
from treesift.sources.batches import distinct_texts, of_every_path, tasks_for


def _python(t, read, *wanted):
    """What ``read`` finds in the facts of each different text, for every path that has it."""
    texts, members = distinct_texts(t.derive(PYTHON_FILES))
    return of_every_path(read(python_facts.facts(texts, provenance.SINK_LEAVES, wanted)), members)


def _flat(findings):
    return findings.select(
        "rule_id",
        "kind",
        "severity",
        "confidence",
        F.col("location.file").alias("file"),
        F.col("location.line").alias("line"),
        F.col("location.column").alias("col"),
        "snippet",
        F.array_join("secondary_rule_ids", ",").alias("secondary"),
    )


# What each variant of a derived line must give, from the key alone; line text comes from the file.
_EXPECTED = """
  SELECT path, k, 'BAS-LLM10-004' AS rule_id, 'defect' AS kind, 'high' AS severity, 'medium' AS confidence, 6 AS line, 5 AS col, '' AS secondary
    FROM files WHERE k % 4 = 3 OR (k % 4 = 0 AND k % 3 = 1)
  UNION ALL SELECT path, k, 'BAS-LLM10-001', 'defect', 'critical', 'high', 6, 5, 'BAS-LLM10-004' FROM files WHERE k % 4 = 0 AND k % 3 <> 1
  UNION ALL SELECT path, k, 'BAS-LLM10-009', CASE WHEN k % 7 = 0 THEN 'observation' ELSE 'defect' END, 'critical', 'high', 7, 5, '' FROM files WHERE k % 7 IN (0, 2, 6)
  UNION ALL SELECT path, k, 'BAS-LLM10-017', 'defect', 'critical', 'high', 8, 5, '' FROM files WHERE k % 6 IN (0, 4)
  UNION ALL SELECT path, k, 'BAS-LLM03-001', 'observation', 'high', 'medium', 13, 1, '' FROM files WHERE k % 2 = 0 AND k % 3 <> 0
  UNION ALL SELECT path, k, 'BAS-ZT1-001', 'defect', 'critical', 'high', 16, 1, '' FROM files WHERE k % 8 = 0
  UNION ALL SELECT path, k, 'BAS-ZT1-002', 'defect', 'critical', 'high', 17, 13, '' FROM files WHERE k % 2 = 1
  UNION ALL SELECT path, k, 'BAS-LLM06-001', 'observation', 'low', 'medium', 18, 1, '' FROM files
"""


@query(
    "python_rule_findings",
    with_ctes(
        """SELECT e.rule_id, CASE WHEN starts_with(e.path, 'tests/') AND e.rule_id <> 'BAS-ZT1-001' THEN 'observation' ELSE e.kind END AS kind,
          e.severity, e.confidence, e.path AS file, CAST(e.line AS BIGINT) AS line, CAST(e.col AS BIGINT) AS col, trim(r.raw) AS snippet, e.secondary
        FROM expected e JOIN raws r ON r.path = e.path AND r.line = e.line WHERE e.k % 9 <> 8""",
        files=PYTHON_FILES,
        raws=RAWS,
        expected=_EXPECTED,
    ),
)
def python_rule_findings(t):
    texts, members = distinct_texts(t.derive(PYTHON_FILES))
    facts = written(python_facts.facts(texts, provenance.SINK_LEAVES, python_rules.WANTED), "check-python")
    return _flat(python_rules.findings(facts, members=members))


@query(
    "python_parse_failures",
    with_ctes("SELECT path, 'unparseable' AS fact FROM files WHERE contains(text, 'def broken(:')", files=PYTHON_FILES),
)
def python_parse_failures(t):
    texts, members = distinct_texts(t.derive(PYTHON_FILES))
    return of_every_path(python_facts.failures(texts), members)


@query(
    "source_returns",
    with_ctes(
        "SELECT path, 'ask' AS callee, 'model_output' AS returned FROM files WHERE k % 9 <> 8 AND regexp_matches(text, 'return client.(chat.completions|responses).create')",
        files=PYTHON_FILES,
    ),
)
def source_returns(t):
    return _python(t, python_rules.source_returns, "return")


@query(
    "wrapper_sinks",
    with_ctes(
        """SELECT path, 'go' AS callee, 'code_execution' AS sink, 0 AS position FROM files WHERE k % 9 <> 8
        UNION ALL SELECT path, 'go', 'shell_execution', 1 FROM files WHERE k % 9 <> 8 AND k % 7 = 0""",
        files=PYTHON_FILES,
    ),
)
def wrapper_sinks(t):
    return _python(t, python_rules.wrapper_sinks, "call")


@query(
    "argument_provenance",
    with_ctes(
        r"""SELECT path, line, callee, closed, guarded, quoted, cli FROM (
          SELECT path, 6 AS line, 'eval' AS callee, k % 4 = 1 AS closed, false AS guarded, k % 4 = 1 AS quoted, k % 4 = 1 AS cli FROM files WHERE k % 4 <> 2 AND k % 9 <> 8
          UNION ALL SELECT path, 7, CASE WHEN k % 7 = 2 THEN 'os.popen' ELSE 'os.system' END, k % 7 = 5, false, k % 7 IN (1, 5), k % 7 = 5 FROM files WHERE k % 7 IN (0, 1, 2, 5) AND k % 9 <> 8
          UNION ALL SELECT path, 7, CASE WHEN k % 7 = 6 THEN 'subprocess.call' ELSE 'subprocess.run' END, false, false, false, k % 7 = 3 FROM files WHERE k % 7 IN (3, 4, 6) AND k % 9 <> 8
          UNION ALL SELECT path, 11, 'exec', false, true, false, false FROM files WHERE k % 9 <> 8)""",
        files=PYTHON_FILES,
    ),
)
def argument_provenance(t):
    value = F.get("args", F.lit(0))
    callees = ("eval", "exec", "os.system", "os.popen", "subprocess.run", "subprocess.call")

    def judged(facts):
        return facts.where("fact = 'call'").where(F.col("callee").isin(*callees)).select(
            "path",
            F.col("line").cast("int").alias("line"),
            "callee",
            provenance.is_closed(value).alias("closed"),
            (provenance.is_guarded(value) & ~provenance.is_closed(value)).alias("guarded"),
            provenance.is_shell_quoted(value).alias("quoted"),
            provenance.is_cli_argument(value, F.col("fn_decorators")).alias("cli"),
        )

    return _python(t, judged, "call")


@query(
    "callee_catalogue",
    """
    SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'model_output' WHEN 1 THEN NULL WHEN 2 THEN 'http_request' WHEN 3 THEN 'model_output'
        WHEN 4 THEN NULL WHEN 5 THEN 'network_read' ELSE 'file_read' END AS source,
      CASE event_id % 7 WHEN 4 THEN 'code_execution' WHEN 5 THEN 'network_url' WHEN 1 THEN 'sql_execution' END AS sink
    FROM events
    """,
)
def callee_catalogue(t):
    callees = t.derive(
        """SELECT event_id, CASE event_id % 7 WHEN 0 THEN concat(event_type, '.messages.create') WHEN 1 THEN concat(event_type, '.execute')
            WHEN 2 THEN 'input' WHEN 3 THEN concat('x.', event_type, '.ainvoke') WHEN 4 THEN 'eval' WHEN 5 THEN 'requests.get'
            ELSE concat(event_type, '.json.loads') END AS callee FROM events"""
    )
    return callees.select(
        "event_id",
        provenance.source_kind(F.col("callee")).alias("source"),
        provenance.sink_kind(F.col("callee")).alias("sink"),
    )


_SCRIPT = """
  SELECT path, k, 'BAS-LLM10-005' AS rule_id, 'observation' AS kind, 'high' AS severity, 'medium' AS confidence, 3 AS line, 1 AS col FROM files WHERE k % 3 IN (0, 2)
  UNION ALL SELECT path, k, 'BAS-LLM10-006', 'observation', 'critical', 'high', 4, 1 FROM files WHERE k % 4 IN (0, 2)
  UNION ALL SELECT path, k, 'BAS-ZT4-003', 'observation', 'high', 'high', 5, 1 FROM files WHERE k % 2 = 0
  UNION ALL SELECT path, k, 'BAS-ZT1-003', 'defect', 'critical', 'high', 6, 16 FROM files WHERE k % 5 = 0
      AND NOT regexp_matches(md5(CAST(k AS VARCHAR)), '(foo|0{8,}|1{8,})')
  UNION ALL SELECT path, k, 'BAS-ZT1-011', 'defect', 'critical', 'high', 6, 1 FROM files WHERE k % 5 IN (0, 1)
  UNION ALL SELECT path, k, 'BAS-LLM03-002', 'observation', 'high', 'medium', 7, 1 FROM files WHERE k % 2 = 0 AND k % 3 <> 0
  UNION ALL SELECT path, k, 'BAS-LLM06-002', 'observation', 'low', 'medium', 8, 7 FROM files WHERE k % 2 = 1
  UNION ALL SELECT path, k, 'BAS-ZT2-002', 'defect', 'high', 'high', 9, 1 FROM files WHERE k % 6 = 0
"""


@query(
    "script_rule_findings",
    with_ctes(
        """SELECT e.rule_id, CASE WHEN starts_with(e.path, 'spec/') AND e.rule_id <> 'BAS-ZT1-003' THEN 'observation' ELSE e.kind END AS kind,
          e.severity, e.confidence, e.path AS file, CAST(e.line AS BIGINT) AS line, CAST(e.col AS BIGINT) AS col, trim(r.raw) AS snippet, '' AS secondary
        FROM expected e JOIN raws r ON r.path = e.path AND r.line = e.line WHERE e.k % 11 <> 10""",
        files=SCRIPT_FILES,
        raws=RAWS,
        expected=_SCRIPT,
    ),
)
def script_rule_findings(t):
    texts, members = distinct_texts(t.derive(SCRIPT_FILES))
    facts = written(script_facts.facts(texts, script_rules.WANTED), "script-facts")
    return _flat(script_rules.findings(facts, members))


@query(
    "jsx_findings",
    with_ctes(
        """SELECT 'BAS-LLM10-005' AS rule_id, path AS file, CAST(len(string_split(text, chr(10))) - 1 AS BIGINT) AS line, 'eval(reply)' AS snippet
          FROM files WHERE k % 5 <> 4
        UNION ALL SELECT 'unparseable', path, NULL, NULL FROM files WHERE k % 5 = 4""",
        files=COMPONENT_FILES,
    ),
)
def jsx_findings(t):
    """Files with brackets in the text between tags keep their findings; a bracket too many is a broken file."""
    texts, members = distinct_texts(t.derive(COMPONENT_FILES))
    facts = written(script_facts.facts(texts), "script-facts")
    found = script_rules.findings(facts).select("rule_id", F.col("location.file").alias("path"), F.col("location.line").alias("line"), "snippet")
    broken = facts.where("fact = 'unparseable'").select(F.lit("unparseable").alias("rule_id"), "path")
    shown = of_every_path(found.unionByName(broken, allowMissingColumns=True), members)
    return shown.withColumnRenamed("path", "file")


_LOOKUPS = """
  SELECT path, 3 AS line, 'x' AS name, 'parameter' AS kind, false AS sure, '' AS vals FROM files
  UNION ALL SELECT path, 5, 'x', 'binding', true, CASE WHEN k % 2 = 0 THEN '"later"' ELSE '"outer";"later"' END FROM files
  UNION ALL SELECT path, 10, 'y', 'binding', false, CASE k % 3 WHEN 0 THEN '1;1' WHEN 1 THEN '1;2' ELSE '1' END FROM files
  UNION ALL SELECT path, 12, 'y', 'binding', true, '3' FROM files
  UNION ALL SELECT path, 16, 'z', 'binding', true, '0' FROM files
  UNION ALL SELECT path, 18, 'z', 'binding', true, CAST(k AS VARCHAR) FROM files
  UNION ALL SELECT path, 19, 'z', 'binding', true, '0;' || k FROM files
  UNION ALL SELECT path, 21, 'z', 'binding', true, '0;' || k FROM files
  UNION ALL SELECT path, 21, 'missing', 'name', false, '' FROM files
  UNION ALL SELECT path, 22, 'x', 'binding', true, '"outer"' FROM files WHERE k % 2 = 1
"""


@query("name_lookups", with_ctes(f"SELECT path, line, name, kind, sure, vals FROM ({_LOOKUPS})", files=SCOPE_FILES))
def name_lookups(t):
    """Which bindings each use can meet, over scopes and branches, from name rows."""
    files = t.derive(SCOPE_FILES)
    # A name meets only bindings of that name.
    rows = python_names.names(files, tasks_for(files), ("x", "y", "z", "missing"))
    found = name_lookup.resolved(rows, in_order=True)
    return found.select("path", "line", "name", "kind", "sure", F.array_join("values", ";").alias("vals"))
