"""Configuration files: environment, image, service and tool-server analysers."""

from __future__ import annotations

from pyspark.sql import functions as F

from treesift.checks.derived import DOTENV_FILES, IMAGE_FILES, SERVER_FILES, SERVICE_FILES
from treesift.checks.registry import query, with_ctes
from treesift.checks.texts import flat
from treesift.functions.documents import canonical_json
from treesift.operators import dotenv, images, services
from treesift.operators import tool_servers as servers

RAWS = """SELECT path, text, CAST(generate_subscripts(l, 1) AS BIGINT) AS line, unnest(l) AS raw
  FROM (SELECT path, text, string_split(text, chr(10)) AS l FROM files)"""
_NAME = r"(?i)(password|passwd|pwd|secret|token|credential|api[_-]?key|access[_-]?key|private[_-]?key)"
_REFERENCE = r"^([$].*|[{][{].*[}][}]|<.*>|%.*%)$"
_PLACEHOLDER = (
    r"(?i)^(change[-_]?me|todo|xxx+|example|placeholder|dummy|true|false|yes|no|on|off|none|null|local|dev|test)$"
)
HARDCODED = (
    rf"(trim(v) <> '' AND NOT regexp_matches(v, '{_REFERENCE}') AND NOT regexp_matches(v, '{_PLACEHOLDER}')"
    r" AND NOT regexp_matches(v, '^(~|[.]{1,2})?/') AND NOT regexp_matches(v, '^[0-9]+([.][0-9]+)?$'))"
)
PROVIDER = r"(regexp_matches(v, '^sk-[A-Za-z0-9_-]{16,}$') AND NOT regexp_matches(v, '(?i)(your[-_]|replace|placeholder|example|dummy)'))"
GRADE = r"""CASE WHEN regexp_matches(v, '^(sk-|ghp_|AKIA)') OR len(list_filter(regexp_extract_all(v, '[A-Za-z0-9_-]{24,}'),
  lambda r: regexp_matches(r, '[0-9]') AND regexp_matches(r, '[A-Za-z]'))) > 0 THEN 'critical' ELSE 'high' END"""


@query(
    "dotenv_assignments",
    with_ctes(
        "SELECT path, line, k, v FROM parsed",
        files=DOTENV_FILES,
        raws=RAWS,
        parsed=r"""SELECT path, line, trim(split_part(body, '=', 1)) AS k,
            CASE WHEN regexp_matches(w, '^"[^"]*"$') OR regexp_matches(w, '^''[^'']*''$') THEN substr(w, 2, length(w) - 2) ELSE w END AS v
          FROM (SELECT *, trim(CASE WHEN regexp_matches(z, '^["'']') THEN z ELSE regexp_replace(z, '\s#.*$', '') END) AS w
            FROM (SELECT *, trim(regexp_replace(body, '^[^=]*=', '')) AS z
              FROM (SELECT path, line, regexp_replace(trim(raw), '^export ', '') AS body FROM raws
                WHERE contains(raw, '=') AND NOT starts_with(trim(raw), '#'))))""",
    ),
)
def dotenv_assignments(t):
    rows = t.derive(DOTENV_FILES).select("path", F.explode(dotenv.assignments(F.col("text"))).alias("a"))
    return rows.select("path", "a.line", F.col("a.key").alias("k"), F.col("a.value").alias("v"))


@query(
    "dotenv_findings",
    with_ctes(
        rf"""
        SELECT CASE WHEN provider THEN 'BAS-ZT1-021' ELSE 'BAS-ZT1-022' END AS rule_id, 'defect' AS kind,
          CASE WHEN provider THEN 'critical' ELSE grade END AS severity, path AS file, line, CAST(1 AS BIGINT) AS col, k || '=' || v AS snippet
        FROM (SELECT *, {PROVIDER} AS provider, {GRADE} AS grade FROM parsed)
        WHERE (provider OR (regexp_matches(k, '{_NAME}') AND {HARDCODED}))
          AND NOT regexp_matches(lower(path), '[.](example|sample|template|dist)$')
        """,
        files=DOTENV_FILES,
        raws=RAWS,
        parsed=r"""SELECT path, line, trim(split_part(body, '=', 1)) AS k,
            CASE WHEN regexp_matches(w, '^"[^"]*"$') OR regexp_matches(w, '^''[^'']*''$') THEN substr(w, 2, length(w) - 2) ELSE w END AS v
          FROM (SELECT *, trim(CASE WHEN regexp_matches(z, '^["'']') THEN z ELSE regexp_replace(z, '\s#.*$', '') END) AS w
            FROM (SELECT *, trim(regexp_replace(body, '^[^=]*=', '')) AS z
              FROM (SELECT path, line, regexp_replace(trim(raw), '^export ', '') AS body FROM raws
                WHERE contains(raw, '=') AND NOT starts_with(trim(raw), '#'))))""",
    ),
)
def dotenv_findings(t):
    return flat(t.derive(DOTENV_FILES), dotenv.findings(F.col("path"), F.col("text")))


# The SQL side joins continuation lines with islands: a kept line continues its predecessor when
# that one ends with a backslash.
STEPS = r"""SELECT path, CAST(row_number() OVER (PARTITION BY path ORDER BY start) - 1 AS BIGINT) AS seq, start AS line,
    upper(regexp_extract(body, '^(\S+)', 1)) AS keyword, regexp_extract(body, '^\S+\s+(.*)$', 1) AS arguments
  FROM (SELECT path, min(line) AS start, string_agg(trim(regexp_replace(raw, '\\$', '')), ' ' ORDER BY line) AS body
    FROM (SELECT *, sum(starts) OVER (PARTITION BY path ORDER BY line) AS island
      FROM (SELECT path, line, trim(raw) AS raw,
          CASE WHEN coalesce(lag(trim(raw)) OVER (PARTITION BY path ORDER BY line), '') LIKE '%\' THEN 0 ELSE 1 END AS starts
        FROM raws WHERE trim(raw) <> '' AND NOT starts_with(trim(raw), '#')))
    GROUP BY path, island)"""


@query(
    "image_instructions",
    with_ctes("SELECT path, seq, line, keyword, arguments FROM steps", files=IMAGE_FILES, raws=RAWS, steps=STEPS),
)
def image_instructions(t):
    rows = t.derive(IMAGE_FILES).select(
        "path", F.explode(images.instructions(F.col("text"))).alias("i")
    )
    return rows.select("path", "i.seq", "i.line", "i.keyword", "i.arguments")


_STAGES = r"""SELECT *, row_number() OVER (PARTITION BY path ORDER BY seq) AS n, lower(regexp_extract(a, '^(\S+)', 1)) AS base,
    lower(regexp_extract(a, '(?i)^\S+\s+as\s+(\S+)', 1)) AS alias
  FROM (SELECT path, seq, line, regexp_replace(arguments, '^(--\S+\s+)+', '') AS a,
      coalesce(lead(seq) OVER (PARTITION BY path ORDER BY seq), 1000000) AS until FROM steps WHERE keyword = 'FROM')"""


@query(
    "image_user",
    "WITH RECURSIVE files AS ("
    + IMAGE_FILES
    + "), raws AS ("
    + RAWS
    + "), steps AS ("
    + STEPS
    + "), stages AS ("
    + _STAGES
    + r"""), users AS (SELECT g.path, g.n, arg_max(s.arguments, s.seq) AS name, max(s.line) AS line FROM stages g JOIN steps s
        ON s.path = g.path AND s.keyword = 'USER' AND s.seq > g.seq AND s.seq < g.until GROUP BY g.path, g.n),
      chain AS (
        SELECT path, max(n) AS n, max(line) AS from_line FROM stages GROUP BY path
        UNION ALL
        SELECT c.path, (SELECT max(p.n) FROM stages p WHERE p.path = c.path AND p.n < c.n AND p.alias = g.base) AS n, c.from_line
        FROM chain c JOIN stages g ON g.path = c.path AND g.n = c.n
        WHERE NOT EXISTS (SELECT 1 FROM users u WHERE u.path = c.path AND u.n = c.n)
          AND EXISTS (SELECT 1 FROM stages p WHERE p.path = c.path AND p.n < c.n AND p.alias = g.base))
    SELECT c.path, any_value(u.name) AS name, any_value(u.line) AS line, any_value(c.from_line) AS from_line
    FROM chain c LEFT JOIN users u ON u.path = c.path AND u.n = c.n GROUP BY c.path""",
)
def image_user(t):
    steps = images.instructions(F.col("text"))
    rows = t.derive(IMAGE_FILES).select("path", images.effective_user(steps).alias("u"))
    return rows.select("path", "u.name", "u.line", "u.from_line")


@query(
    "image_findings",
    with_ctes(
        rf"""
        SELECT CASE WHEN provider THEN 'BAS-INFRA-002' ELSE 'BAS-INFRA-006' END AS rule_id, 'defect' AS kind,
          CASE WHEN provider THEN 'critical' ELSE grade END AS severity, path AS file, line, CAST(1 AS BIGINT) AS col,
          keyword || ' ' || k || '=' || v AS snippet
        FROM (SELECT *, {PROVIDER} AS provider, {GRADE} AS grade FROM pairs)
        WHERE provider OR (regexp_matches(k, '{_NAME}') AND {HARDCODED})
        UNION ALL
        SELECT 'BAS-INFRA-001', 'defect', 'high', path, line, 1, 'USER ' || arguments FROM last WHERE regexp_matches(arguments, '^(root|0)(:|$)')
        UNION ALL
        SELECT 'BAS-INFRA-001', 'observation', 'low', path, from_line, 1, 'FROM mid' FROM last WHERE arguments IS NULL
        """,
        files=IMAGE_FILES,
        raws=RAWS,
        steps=STEPS,
        words=r"""SELECT path, line, keyword, arguments, unnest(CASE WHEN contains(string_split(arguments, ' ')[1], '=')
            THEN regexp_extract_all(arguments, '(?:"[^"]*"|''[^'']*''|[^\s"''])+') ELSE [arguments] END) AS w FROM steps WHERE keyword IN ('ENV', 'ARG')""",
        pairs=r"""SELECT path, line, keyword, CASE WHEN contains(w, '=') THEN split_part(w, '=', 1) ELSE split_part(w, ' ', 1) END AS k,
            CASE WHEN contains(w, '=') THEN trim(regexp_replace(w, '^[^=]*=', ''), '"''') ELSE regexp_replace(w, '^\S+\s+', '') END AS v FROM words""",
        # By construction: the last stage is based on mid, mid on Base unless it is debian.
        last=r"""SELECT f.path, f.line AS from_line, coalesce(u3.arguments, CASE WHEN contains(m.arguments, 'debian') THEN NULL ELSE u1.arguments END) AS arguments,
            coalesce(u3.line, u1.line) AS line
          FROM (SELECT path, max(line) AS line FROM steps WHERE keyword = 'FROM' GROUP BY path) f
          JOIN steps m ON m.path = f.path AND m.line = 3
          LEFT JOIN steps u1 ON u1.path = f.path AND u1.keyword = 'USER' AND u1.line = 2
          LEFT JOIN steps u3 ON u3.path = f.path AND u3.keyword = 'USER' AND u3.line > f.line""",
    ),
)
def image_findings(t):
    return flat(t.derive(IMAGE_FILES), images.findings(F.col("path"), F.col("text")))


def _document(kind: str):
    return F.try_parse_json(canonical_json(F.lit(kind), F.col("text")))


@query(
    "service_findings",
    with_ctes(
        rf"""
        SELECT rule_id, kind, severity, f.path AS file, r.line, CAST(1 AS BIGINT) AS col, trim(r.raw) AS snippet
        FROM (
          SELECT path, 'BAS-INFRA-003' AS rule_id, 'defect' AS kind, 'critical' AS severity, 8 AS line FROM keyed WHERE k % 2 = 0
          UNION ALL SELECT path, 'BAS-INFRA-004', 'defect', 'critical', 4 FROM keyed WHERE k % 4 IN (0, 2)
          UNION ALL SELECT path, 'BAS-INFRA-005', 'observation', 'low', 5 FROM keyed WHERE k % 3 = 0
          UNION ALL SELECT path, 'BAS-INFRA-010', 'observation', 'low', 5 FROM keyed WHERE k % 3 = 2
          UNION ALL SELECT path, 'BAS-INFRA-006', 'defect', {GRADE}, line FROM (
            SELECT path, k, line, trim(regexp_replace(raw, '^[^:=]*[:=]\s*', ''), '"''') AS v FROM joined
            WHERE regexp_matches(raw, '(?i)(token|password)\s*[:=]')) WHERE {HARDCODED}
        ) f JOIN raws r ON r.path = f.path AND r.line = f.line
        """,
        files=SERVICE_FILES,
        raws=RAWS,
        keyed="SELECT path, CAST(regexp_extract(path, '[0-9]+') AS BIGINT) AS k FROM files WHERE CAST(regexp_extract(path, '[0-9]+') AS BIGINT) % 10 <> 9",
        joined="SELECT r.path, k, line, raw FROM raws r JOIN keyed USING (path)",
    ),
)
def service_findings(t):
    files = t.derive(SERVICE_FILES).withColumn("document", _document("yaml"))
    return flat(files, services.findings(F.col("path"), F.col("text"), F.col("document")))


@query(
    "service_failures",
    """
    SELECT concat('s', CAST(s_suppkey AS STRING), '/docker-compose.yml') AS path, 'unparseable' AS reason
    FROM supplier WHERE s_suppkey % 10 = 9
    """,
)
def service_failures(t):
    files = t.derive(SERVICE_FILES).withColumn("document", _document("yaml"))
    return files.where("document IS NULL").select("path", F.lit("unparseable").alias("reason"))


_SERVERS = with_ctes(
    r"""
    SELECT rule_id, kind, severity, f.path AS file, CAST(f.line AS BIGINT) AS line, CAST(1 AS BIGINT) AS col, trim(r.raw) AS snippet
    FROM (
      SELECT path, 'BAS-MCP-000' AS rule_id, 'defect' AS kind, 'medium' AS severity, 1 AS line FROM keyed WHERE NOT valid
      UNION ALL SELECT path, 'BAS-LLM03-020', 'observation', 'medium', 11 FROM keyed WHERE valid AND auto
      UNION ALL SELECT path, 'BAS-MCP-001', 'defect', 'high', min(r.line) FROM keyed JOIN raws r USING (path)
        WHERE valid AND broad <> '' AND contains(r.raw, broad) GROUP BY path
      UNION ALL SELECT path, 'BAS-MCP-004', 'defect', 'critical', 5 FROM keyed WHERE valid AND k % 3 = 0
      UNION ALL SELECT path, 'BAS-MCP-004', 'defect', 'critical', 6 FROM keyed WHERE valid
      UNION ALL SELECT path, 'BAS-MCP-005', 'defect', 'high', 3 FROM keyed WHERE valid AND k % 2 = 0
      UNION ALL SELECT path, 'BAS-MCP-002', 'observation', 'low', 7 FROM keyed WHERE valid AND k % 4 IN (0, 3) AND k % 3 <> 0
      UNION ALL SELECT path, 'BAS-MCP-002', 'defect', 'high', 7 FROM keyed WHERE valid AND k % 4 = 1 AND k % 3 <> 0
      UNION ALL SELECT path, 'BAS-MCP-003', 'defect', 'high', 9 FROM keyed WHERE valid AND k % 4 IN (0, 1)
      UNION ALL SELECT path, 'BAS-LLM03-020', 'observation', 'medium', 10 FROM keyed WHERE valid AND k % 5 = 0
    ) f JOIN raws r ON r.path = f.path AND r.line = f.line
    """,
    files=SERVER_FILES,
    raws=RAWS,
    keyed=r"""SELECT path, k, json_valid(text) AS valid, k % 6 = 0 AS auto,
        CASE k % 5 WHEN 0 THEN '/' WHEN 1 THEN '/home/me/' WHEN 2 THEN '$HOME/x' ELSE '' END AS broad
      FROM (SELECT path, text, CAST(regexp_extract(path, '[0-9]+') AS BIGINT) AS k FROM files)""",
)


@query("server_findings", _SERVERS)
def server_findings(t):
    files = t.derive(SERVER_FILES).withColumn("document", _document("json"))
    return flat(files, servers.findings(F.col("path"), F.col("text"), F.col("document")))


@query(
    "server_dependencies",
    with_ctes(
        r"""
        SELECT f.path AS file, '@scope/files' AS name, regexp_extract(raw, '@([0-9.]+)', 1) AS version, 'npm' AS ecosystem, line, trim(raw) AS declaration
        FROM files f JOIN raws r ON r.path = f.path WHERE json_valid(f.text) AND regexp_matches(raw, '@scope/files@')
        """,
        files=SERVER_FILES,
        raws=RAWS,
    ),
)
def server_dependencies(t):
    files = t.derive(SERVER_FILES).withColumn("document", _document("json"))
    rows = files.select(
        F.explode(servers.dependencies(F.col("path"), F.col("text"), F.col("document"))).alias("d")
    )
    return rows.select("d.file", "d.name", "d.version", "d.ecosystem", "d.line", "d.declaration")
