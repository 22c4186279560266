"""Text positions, phrases, hidden characters, generated files, paths."""

from __future__ import annotations

from pyspark.sql import functions as F

from treesift.checks.derived import HIDDEN_FILES, PATHS, SKILL_FILES
from treesift.checks.registry import query, with_ctes
from treesift.functions import paths, text
from treesift.functions.documents import canonical_json
from treesift.operators import instructions, literals, skills
from treesift.plans import report

FLAT = ("rule_id", "kind", "severity", "file", "line", "col", "snippet")


def flat(df, array, *extra):
    """Findings of an array column as plain columns."""
    exploded = df.select(F.explode(array).alias("f"))
    return exploded.select(
        "f.rule_id",
        "f.kind",
        "f.severity",
        F.col("f.location.file").alias("file"),
        F.col("f.location.line").alias("line"),
        F.col("f.location.column").alias("col"),
        "f.snippet",
        *extra,
    )


DOC_FILES = "SELECT concat('doc/', CAST(doc_id AS STRING), '.txt') AS path, text FROM documents"

# Documents hold assignments in large tables only; these files always do.
CREDENTIAL_FILES = DOC_FILES + """
UNION ALL SELECT concat('app/c', CAST(c_custkey AS STRING), '.cfg') AS path, concat('region = ', CAST(c_nationkey AS STRING), chr(10), '  ',
  CASE c_custkey % 3 WHEN 0 THEN 'apiKey' WHEN 1 THEN 'db_password' ELSE 'user_name' END, ': "',
  CASE c_custkey % 4 WHEN 0 THEN md5(c_name) WHEN 1 THEN c_name WHEN 2 THEN '10.25' ELSE '$HOME' END, '"; token="', c_mktsegment, '"') AS text FROM customer
"""

_ASSIGN = r'([A-Za-z_][A-Za-z0-9_]*)[ \t]*[=:][ \t]*"([^"\n]+)"'
_NAME = r"(?i)(password|passwd|pwd|secret|token|credential|api[_-]?key|access[_-]?key|private[_-]?key)"


@query(
    "credential_findings",
    with_ctes(
        rf"""
        SELECT 'BAS-ZT1-010' AS rule_id, 'defect' AS kind,
          CASE WHEN len(v) >= 24 AND regexp_full_match(v, '[A-Za-z0-9_-]+') AND regexp_matches(v, '[0-9]')
            AND regexp_matches(v, '[A-Za-z]') THEN 'critical' ELSE 'high' END AS severity,
          path AS file, line, CAST(off AS BIGINT) AS col, trim(raw) AS snippet
        FROM hits WHERE regexp_matches(k, '{_NAME}') AND NOT regexp_full_match(v, '[0-9.]+')
          AND NOT regexp_matches(v, '^[$/~.<]')
        """,
        files=CREDENTIAL_FILES,
        raws="SELECT path, generate_subscripts(l, 1) AS line, unnest(l) AS raw FROM (SELECT path, string_split(text, chr(10)) AS l FROM files)",
        found=f"SELECT path, line, raw, regexp_extract_all(raw, '{_ASSIGN}') AS h, string_split_regex(raw, '{_ASSIGN}') AS g FROM raws WHERE regexp_matches(raw, '{_ASSIGN}')",
        placed="""SELECT path, line, raw, h[i] AS hit, 1 + list_sum(list_transform(g[1:i], lambda x: length(x)))
            + coalesce(list_sum(list_transform(h[1:i - 1], lambda x: length(x))), 0) AS off
          FROM (SELECT *, unnest(range(1, len(h) + 1)) AS i FROM found)""",
        hits=f"SELECT *, regexp_extract(hit, '{_ASSIGN}', 1) AS k, regexp_extract(hit, '{_ASSIGN}', 2) AS v FROM placed",
    ),
)
def credential_findings(t):
    files = t.derive(CREDENTIAL_FILES)
    found = report.as_findings(
        files.select(F.explode(literals.findings(F.col("path"), F.col("text"))).alias("finding"))
    ).withColumn("analyser", F.lit(0))
    # Texts that a rule's id stands for need not be sorted with the rows.
    found = found.drop("description", "remediation", "categories", "secondary_rule_ids", "references")
    kept = report.ordered(report.dedupe(found, ["analyser"]))
    return kept.select(
        "rule_id",
        "kind",
        "severity",
        F.col("location.file").alias("file"),
        F.col("location.line").alias("line"),
        F.col("location.column").alias("col"),
        "snippet",
    )


@query(
    "line_column_of_match",
    r"""
    SELECT doc_id, CAST(off AS BIGINT) AS off,
      CAST(length(p) - length(replace(p, chr(10), '')) + 1 AS BIGINT) AS line,
      CAST(length(regexp_extract(p, '[^\n]*$')) + 1 AS BIGINT) AS col,
      regexp_replace(string_split(text, chr(10))[length(p) - length(replace(p, chr(10), '')) + 1], '^\s+|\s+$', '', 'g') AS snippet
    FROM (SELECT doc_id, text, instr(text, m) AS off, substr(text, 1, instr(text, m) - 1) AS p
      FROM (SELECT doc_id, text, regexp_extract(text, '[0-9]{3,}') AS m FROM documents) WHERE m <> '')
    """,
)
def line_column_of_match(t):
    off = text.regex_offset(F.col("text"), "[0-9]{3,}")
    hits = t.documents.select("doc_id", "text", off.cast("bigint").alias("off")).where("off IS NOT NULL")
    placed = hits.select(
        "doc_id",
        "off",
        text.line_at(F.col("text"), F.col("off")).alias("line"),
        text.column_at(F.col("text"), F.col("off")).alias("col"),
        "text",
    )
    return placed.select(
        "doc_id", "off", "line", "col", text.snippet(F.col("text"), F.col("line")).alias("snippet")
    )




def _place(n: int) -> str:
    """The text's n-th word, or words no text holds where that is empty or spans lines."""
    word = f"split_part(text, ' ', {n})"
    return f"CASE WHEN length({word}) = 0 OR instr({word}, chr(10)) > 0 THEN 'no such word {n}' ELSE {word} END"


_PLACES = f"SELECT doc_id, text, {_place(20)} AS needle, {_place(60)} AS anchor FROM documents"


@query(
    "locate_lines",
    with_ctes(
        """
        SELECT doc_id, (SELECT coalesce(min(line), 1) FROM raws r WHERE r.doc_id = d.doc_id AND contains(raw, needle) AND needle <> '') AS first_line,
          coalesce((SELECT min(line) FROM raws r WHERE r.doc_id = d.doc_id AND contains(raw, needle) AND line >=
              (SELECT coalesce(min(line), 1) FROM raws a WHERE a.doc_id = d.doc_id AND contains(a.raw, anchor))),
            (SELECT min(line) FROM raws r WHERE r.doc_id = d.doc_id AND contains(raw, needle)), 1) AS anchored_line
        FROM docs d
        """,
        docs=_PLACES,
        raws="SELECT doc_id, CAST(generate_subscripts(l, 1) AS BIGINT) AS line, unnest(l) AS raw FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM docs)",
    ),
)
def locate_lines(t):
    docs = t.derive(_PLACES)
    body = F.col("text")
    return docs.select(
        "doc_id",
        text.locate_line(body, F.col("needle")).alias("first_line"),
        text.locate_line_after(body, F.col("anchor"), F.col("needle")).alias("anchored_line"),
    )


@query(
    "generated_filter",
    """
    SELECT page_id, octet_length(p) // n AS mean, octet_length(p) AS size,
      format('minified, {} bytes per line on average over {} bytes', octet_length(p) // n, octet_length(p)) AS reason
    FROM (SELECT page_id, p, CAST(len(regexp_extract_all(decode(p), chr(10))) + 1 AS BIGINT) AS n
      FROM (SELECT page_id, encode(html) AS p FROM pages
        UNION ALL SELECT -1 - doc_id, encode(replace(text, chr(10), ' ')) FROM documents))
    WHERE octet_length(p) >= 1024 AND octet_length(p) // n >= 500
    """,
)
def generated_filter(t):
    files = t.derive(
        """SELECT page_id, encode(html, 'UTF-8') AS content FROM pages
        UNION ALL SELECT -1 - doc_id, encode(replace(text, chr(10), ' '), 'UTF-8') FROM documents"""
    )
    judged = files.select("page_id", text.generated_measurement(F.col("content")).alias("m"))
    return judged.where("m IS NOT NULL").select(
        "page_id",
        "m.mean",
        "m.size",
        text.generated_reason(F.col("m")).alias("reason"),
    )


@query(
    "utf8_decode",
    """
    SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE md5(text) END AS digest,
      doc_id % 7 = 0 AS unreadable FROM documents
    """,
)
def utf8_decode(t):
    raw = t.derive(
        """SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN concat(encode(text, 'UTF-8'), X'C3') ELSE
        encode(text, 'UTF-8') END AS content FROM documents"""
    )
    decoded = raw.select("doc_id", text.utf8(F.col("content")).alias("text"))
    return decoded.select(
        "doc_id", F.md5("text").alias("digest"), F.col("text").isNull().alias("unreadable")
    )


def _phrase_sql(phrases: tuple[str, ...], rule: str, severity: str) -> str:
    rows = ", ".join(
        "({}, {})".format(i, "'" + p.replace("'", "''") + "'") for i, p in enumerate(phrases)
    )
    return with_ctes(
        rf"""
        SELECT '{rule}' AS rule_id, 'defect' AS kind, '{severity}' AS severity, file,
          CAST(length(p) - length(replace(p, chr(10), '')) + 1 AS BIGINT) AS line,
          CAST(length(regexp_extract(p, '[^\n]*$')) + 1 AS BIGINT) AS col,
          regexp_replace(string_split(text, chr(10))[length(p) - length(replace(p, chr(10), '')) + 1], '^\s+|\s+$', '', 'g') AS snippet,
          occurrences, phrase
        FROM (SELECT path AS file, any_value(text) AS text, CAST(sum(n) AS BIGINT) AS occurrences,
            arg_min(phrase, off * 100 + i) AS phrase, substr(any_value(text), 1, min(off) - 1) AS p
          FROM hits GROUP BY path)
        """,
        files=SKILL_FILES,
        phrases=f"SELECT i, phrase, '(?i)' || replace(replace(phrase, ':', '[:]'), ' ', '\\s+') AS re FROM (VALUES {rows}) v(i, phrase)",
        hits="""SELECT path, text, i, phrase, len(regexp_extract_all(text, re)) AS n,
            instr(text, regexp_extract(text, re)) AS off
          FROM files, phrases WHERE regexp_matches(text, re)""",
    )


def _phrases(t, findings):
    files = t.derive(SKILL_FILES)
    hit = F.regexp_extract("f.description", r"^(\d+) occurrence\(s\), the first being \"(.*?)\"", 1)
    phrase = F.regexp_extract("f.description", r"^(\d+) occurrence\(s\), the first being \"(.*?)\"", 2)
    return flat(
        files,
        findings(F.col("path"), F.col("text")),
        hit.cast("bigint").alias("occurrences"),
        phrase.alias("phrase"),
    )


@query("injection_phrases", _phrase_sql(skills.INJECTION_PHRASES, "BAS-SKILL-002", "critical"))
def injection_phrases(t):
    return _phrases(t, skills.injection_findings)


@query("confirmation_phrases", _phrase_sql(skills.SKIP_CONFIRMATION_PHRASES, "BAS-SKILL-003", "high"))
def confirmation_phrases(t):
    return _phrases(t, skills.confirmation_findings)


@query(
    "skill_frontmatter",
    with_ctes(
        r"""
        SELECT path AS file, 'BAS-SKILL-001' AS rule_id,
          CASE doc_id % 5 WHEN 1 THEN 'description' WHEN 2 THEN 'name' ELSE 'name, description' END AS missing,
          regexp_replace(string_split(text, chr(10))[1], '^\s+|\s+$', '', 'g') AS snippet
        FROM (SELECT *, CAST(regexp_extract(path, '[0-9]+') AS BIGINT) AS doc_id FROM files)
        WHERE doc_id % 5 <> 0
        """,
        files=SKILL_FILES,
    ),
)
def skill_frontmatter(t):
    files = t.derive(SKILL_FILES)
    document = canonical_json(F.lit("yaml"), skills.frontmatter(F.col("text")))
    found = files.withColumn("document", document).select(
        F.explode(
            skills.frontmatter_findings(F.col("path"), F.col("text"), F.col("document"))
        ).alias("f")
    )
    return found.select(
        F.col("f.location.file").alias("file"),
        "f.rule_id",
        F.regexp_extract("f.description", r"Missing: (.*)\.$", 1).alias("missing"),
        "f.snippet",
    )


_HIDDEN = "[​‌‍⁣﻿‪-‮]"


@query(
    "hidden_unicode",
    with_ctes(
        rf"""
        SELECT 'BAS-LLM01-001' AS rule_id, 'defect' AS kind, 'critical' AS severity, path AS file,
          CAST(length(p) - length(replace(p, chr(10), '')) + 1 AS BIGINT) AS line,
          CAST(length(regexp_extract(p, '[^\n]*$')) + 1 AS BIGINT) AS col,
          regexp_replace(string_split(text, chr(10))[length(p) - length(replace(p, chr(10), '')) + 1], '^\s+|\s+$', '', 'g') AS snippet,
          n AS hidden
        FROM (SELECT path, text, substr(body, 1, instr(body, regexp_extract(body, '{_HIDDEN}')) - 1) AS p,
            len(regexp_extract_all(body, '{_HIDDEN}')) AS n
          FROM (SELECT path, text, CASE WHEN starts_with(text, chr(65279)) THEN 'x' || substr(text, 2) ELSE text END AS body FROM files)
          WHERE regexp_matches(body, '{_HIDDEN}'))
        """,
        files=HIDDEN_FILES,
    ),
)
def hidden_unicode(t):
    count = F.regexp_extract("f.description", r"^(\d+)", 1).cast("bigint").alias("hidden")
    return flat(
        t.derive(HIDDEN_FILES), instructions.findings(F.col("path"), F.col("text")), count
    )


@query(
    "identifier_contains",
    r"""
    SELECT doc_id, regexp_matches(text, '(^|\W)(token|der|the|des)(\W|$)') AS found
    FROM (SELECT doc_id, regexp_replace(text, '[^ -~\n]', '_', 'g') AS text FROM documents)
    """,
)
def identifier_contains(t):
    body = F.regexp_replace("text", r"[^ -~\n]", "_")
    return t.documents.select(
        "doc_id", text.contains_identifier(body, ("token", "der", "the", "des")).alias("found")
    )


@query(
    "claims_by_path",
    with_ctes(
        r"""
        SELECT page_id, path,
          array_to_string(list_filter([
            CASE WHEN regexp_matches(name, '^.+\.(py|js|mjs|cjs|jsx|ts|mts|cts|tsx)$') THEN 'rules' END,
            CASE WHEN name IN ('mcp.json', '.mcp.json') THEN 'mcp' END,
            CASE WHEN regexp_matches(lower(name), '^(docker-)?compose(\..*)?\.ya?ml$') OR lower(name) = 'dockerfile'
              OR lower(name) LIKE '%.dockerfile' THEN 'container' END,
            CASE WHEN lower(name) IN ('skill.md', 'claude.md', 'agents.md', '.cursorrules') OR lower(name) LIKE '%.prompt'
              OR name = 'mcp.json' THEN 'instruction' END,
            CASE WHEN lower(name) = 'skill.md' THEN 'skill' END,
            CASE WHEN name = '.env' OR name LIKE '.env.%' THEN 'dotenv' END,
            CASE WHEN name IN ('package.json', 'Cargo.toml') THEN 'manifest' END], lambda x: x IS NOT NULL), ',') AS claims,
          CASE WHEN name LIKE '%.py' THEN 'python' WHEN regexp_matches(name, '\.(js|mjs|cjs|jsx)$') THEN 'javascript'
            WHEN regexp_matches(name, '\.(ts|mts|cts)$') THEN 'typescript' WHEN name LIKE '%.tsx' THEN 'tsx' END AS language
        FROM (SELECT page_id, path, regexp_extract(path, '[^/]*$') AS name FROM paths)
        """,
        paths=PATHS,
    ),
)
def claims_by_path(t):
    path = F.col("path")
    return t.derive(PATHS).select(
        "page_id",
        "path",
        F.array_join(paths.analysers(path), ",").alias("claims"),
        paths.language(path).alias("language"),
    )


@query(
    "test_path_flag",
    with_ctes(
        r"""
        SELECT page_id, path, len(list_intersect(list_transform(dirs, lambda d: lower(d)),
            ['test', 'tests', 'spec', 'specs', '__tests__', '__mocks__', 'testdata'])) > 0
          OR lower(name) = 'conftest.py' OR starts_with(stem, 'test_') OR ends_with(stem, '_test')
          OR ends_with(stem, '.test') OR ends_with(stem, '.spec') AS is_test,
          len(list_intersect(string_split(path, '/'), ['.git', '.hg', '.svn', 'node_modules'])) > 0 AS always_skipped
        FROM (SELECT *, parts[:-2] AS dirs, parts[-1] AS name,
            lower(regexp_replace(parts[-1], '\.[^.]*$', '')) AS stem
          FROM (SELECT page_id, path, string_split(path, '/') AS parts FROM paths))
        """,
        paths=PATHS,
    ),
)
def test_path_flag(t):
    path = F.col("path")
    return t.derive(PATHS).select(
        "page_id",
        "path",
        paths.is_test_path(path).alias("is_test"),
        paths.skipped_directory(path).alias("always_skipped"),
    )


