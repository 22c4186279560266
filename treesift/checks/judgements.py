"""Value judgements: credentials, paths, pins, versions, ratings, remotes, fingerprints."""

from __future__ import annotations

from pyspark.sql import functions as F

from treesift.checks.registry import query, with_ctes
from treesift.functions import credentials as cred
from treesift.functions import hashing, remotes, versions
from treesift.operators import tool_servers as servers
from treesift.plans import report, summary

KEYS = """
SELECT o_orderkey, CASE o_orderkey % 8 WHEN 0 THEN concat('service', replace(o_orderpriority, '-', '_'), 'ApiKey')
    WHEN 1 THEN 'MONKEY' WHEN 2 THEN 'db-password' WHEN 3 THEN 'X TOKENS' WHEN 4 THEN 'authTokenValue'
    WHEN 5 THEN 'KEYBOARD' WHEN 6 THEN 'my__secret' ELSE concat(lower(o_orderstatus), 'Pwd') END AS k,
  CASE o_orderkey % 11 WHEN 0 THEN md5(CAST(o_orderkey AS STRING)) WHEN 1 THEN concat('sk-', CAST(o_orderkey AS STRING))
    WHEN 2 THEN ' ' WHEN 3 THEN concat(chr(36), 'NAME_1') WHEN 4 THEN '<token>' WHEN 5 THEN 'ChangeMe'
    WHEN 6 THEN 'xxxxxx' WHEN 7 THEN concat('a b ', md5(CAST(o_custkey AS STRING)), '!')
    WHEN 8 THEN 'abcdefghijklmnopqrstuvwxyz' WHEN 9 THEN concat(' AKIA', CAST(o_custkey AS STRING)) ELSE o_orderpriority END AS v
FROM orders
"""


@query(
    "secret_judgement",
    with_ctes(
        r"""
        SELECT o_orderkey, words,
          len(list_intersect(string_split(words, ' '), ['key','keys','token','tokens','secret','secrets','password','passwords','passwd','pwd','credential','credentials','apikey'])) > 0 AS key_suggests,
          placeholder, secret,
          len(list_intersect(string_split(words, ' '), ['key','keys','token','tokens','secret','secrets','password','passwords','passwd','pwd','credential','credentials','apikey'])) > 0
            AND NOT placeholder AND secret AS plausible
        FROM (SELECT o_orderkey,
            trim(regexp_replace(lower(regexp_replace(k, '([a-z])([A-Z])', '\1 \2', 'g')), '[_ -]+', ' ', 'g')) AS words,
            trim(v) = '' OR regexp_matches(trim(v), '^[$][A-Za-z0-9_]+$') OR regexp_matches(trim(v), '^<.*>$')
              OR lower(trim(v)) IN ('changeme', 'xxx', 'todo', 'example') OR regexp_matches(lower(trim(v)), '^x+$') AS placeholder,
            regexp_matches(trim(v), '^(sk-|sk_live_|ghp_|gho_|github_pat_|AKIA|xox|AIza)')
              OR len(list_filter(regexp_extract_all(v, '[A-Za-z0-9_-]{24,}'),
                lambda r: regexp_matches(r, '[0-9]') AND regexp_matches(r, '[A-Za-z]'))) > 0 AS secret
          FROM keys)
        """,
        keys=KEYS,
    ),
)
def secret_judgement(t):
    k, v = F.col("k"), F.col("v")
    return t.derive(KEYS).select(
        "o_orderkey",
        F.array_join(cred.key_words(k), " ").alias("words"),
        cred.key_suggests_secret(k).alias("key_suggests"),
        cred.is_placeholder(v).alias("placeholder"),
        cred.looks_secret(v).alias("secret"),
        cred.is_plausible_secret(k, v).alias("plausible"),
    )


ARGS = """
SELECT o_orderkey, CASE o_orderkey % 9 WHEN 0 THEN '/' WHEN 1 THEN ' ~/ ' WHEN 2 THEN concat(chr(36), 'HOME', '/x')
    WHEN 3 THEN concat('/home/u', CAST(o_custkey AS STRING)) WHEN 4 THEN '/Users/me/' WHEN 5 THEN '/home/me/work'
    WHEN 6 THEN '/home/' WHEN 7 THEN concat('/srv/', o_orderstatus) ELSE '~' END AS arg,
  CASE o_orderkey % 7 WHEN 0 THEN 'http://LOCALHOST:80/x' WHEN 1 THEN 'https://127.0.0.1' WHEN 2 THEN 'http://[::1]/x'
    WHEN 3 THEN 'localhost' WHEN 4 THEN 'http://localhost.example.com' WHEN 5 THEN concat('http://h', CAST(o_custkey AS STRING), '/') ELSE 'http://127.0.0.10/' END AS url,
  CASE o_orderkey % 5 WHEN 0 THEN '@a/b' WHEN 1 THEN '@a/b@1.0' WHEN 2 THEN 'pkg' WHEN 3 THEN concat('pkg@', CAST(o_custkey AS STRING)) ELSE 'pkg@' END AS package
FROM orders
"""


@query(
    "argument_predicates",
    with_ctes(
        r"""
        SELECT o_orderkey, trim(arg) IN ('/', '~', '~/') OR contains(arg, '$HOME')
            OR (len(p) = 3 AND p[1] = '' AND p[2] IN ('home', 'Users') AND p[3] <> '') AS broad_path,
          lower(host) = 'localhost' OR host = '127.0.0.1' OR host = '::1' AS local_url,
          contains(regexp_replace(package, '^@', ''), '@') AS pinned,
          CASE WHEN regexp_matches(package, '^.+@[^@]+$') THEN regexp_replace(package, '@[^@]*$', '') END AS pin_name,
          CASE WHEN regexp_matches(package, '^.+@[^@]+$') THEN regexp_extract(package, '[^@]*$') END AS pin_version
        FROM (SELECT *, string_split(regexp_replace(trim(arg), '/$', ''), '/') AS p,
            string_split_regex(regexp_replace(url, '^https?://', ''), '[/:]')[1] AS host FROM args)
        """,
        args=ARGS,
    ),
)
def argument_predicates(t):
    pin = servers.split_pin(F.col("package"))
    return t.derive(ARGS).select(
        "o_orderkey",
        servers.is_broad_path(F.col("arg")).alias("broad_path"),
        servers.is_localhost(F.col("url")).alias("local_url"),
        servers.is_pinned(F.col("package")).alias("pinned"),
        pin["name"].alias("pin_name"),
        pin["version"].alias("pin_version"),
    )


VERSIONS = """
SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN concat('1.', CAST(p_size AS STRING), '.0') WHEN 1 THEN concat('v2.', CAST(p_size AS STRING))
    WHEN 2 THEN concat('=', CAST(p_size AS STRING), '.0.1-rc.1') WHEN 3 THEN '^1.2.3' WHEN 4 THEN ' 1.0 ' WHEN 5 THEN '1..2'
    WHEN 6 THEN '1.0.0+build.5' ELSE '*' END AS v,
  CASE p_partkey % 9 WHEN 0 THEN '>=1.0' WHEN 1 THEN '> 2' WHEN 2 THEN '>=1,<2' WHEN 3 THEN 'LATEST' WHEN 4 THEN ' x ' WHEN 5 THEN ''
    WHEN 6 THEN '~1.2' WHEN 7 THEN '!=1' ELSE '>=' END AS c,
  CASE p_partkey % 6 WHEN 0 THEN 'langchain' WHEN 1 THEN concat('langchain_', p_brand) WHEN 2 THEN p_name WHEN 3 THEN '@mastra/core'
    WHEN 4 THEN 'mastracore' ELSE 'openai' END AS n
FROM part
"""


@query(
    "version_predicates",
    with_ctes(
        r"""
        SELECT p_partkey, regexp_full_match(trim(v), '[0-9]+([.][0-9]+)*') AS plain,
          array_to_string(regexp_extract_all(v, '[0-9]+'), '.') AS numbers,
          CASE WHEN regexp_matches(trim(regexp_replace(trim(v), '^=', '')), '^[0-9]+([.][0-9]+)*([-+].*)?$')
            THEN trim(regexp_replace(trim(v), '^=', '')) END AS pin,
          trim(c) IN ('', '*', 'x', 'X') OR lower(trim(c)) = 'latest' OR regexp_matches(trim(c), '^>=? *[A-Za-z0-9.+-]+$') AS unbounded,
          n IN ('langchain', 'openai') OR starts_with(n, 'langchain_') OR starts_with(n, '@mastra/') AS agent,
          regexp_full_match(v, '[0-9]+[.][0-9]+[.][0-9]+([-+][A-Za-z0-9.-]+)?') AS valid
        FROM versions
        """,
        versions=VERSIONS,
    ),
)
def version_predicates(t):
    v, c, n = F.col("v"), F.col("c"), F.col("n")
    numbers = F.transform(versions.digits(v), lambda d: d.cast("string"))
    return t.derive(VERSIONS).select(
        "p_partkey",
        versions.is_plain_release(v).alias("plain"),
        F.coalesce(F.array_join(numbers, "."), F.lit("")).alias("numbers"),
        versions.exact_pin(v).alias("pin"),
        versions.is_unbounded(c).alias("unbounded"),
        versions.is_agent_package(n).alias("agent"),
        versions.is_valid_version(v).alias("valid"),
    )


RATINGS = """
SELECT l_orderkey, l_linenumber, CAST(l_partkey AS BIGINT) AS k,
  concat('CVSS:3.1/AV:N/AC:L/C:', CASE l_partkey % 3 WHEN 0 THEN 'H' WHEN 1 THEN 'L' ELSE 'N' END, '/I:',
    CASE l_suppkey % 3 WHEN 0 THEN 'H' WHEN 1 THEN 'L' ELSE 'N' END, '/A:', CASE l_linenumber % 2 WHEN 0 THEN 'H' ELSE 'N' END) AS v3,
  concat('CVSS:4.0/AV:N/SC:', CASE l_partkey % 2 WHEN 0 THEN 'H' ELSE 'L' END, '/SI:H/SA:', CASE l_suppkey % 2 WHEN 0 THEN 'H' ELSE 'N' END) AS v4,
  CAST(l_partkey % 12 AS STRING) AS base,
  CASE l_orderkey % 7 WHEN 0 THEN 'Moderate' WHEN 1 THEN 'none' WHEN 2 THEN 'odd' WHEN 3 THEN 'CRITICAL' ELSE NULL END AS label
FROM lineitem
"""


@query(
    "cvss_ratings",
    with_ctes(
        r"""
        SELECT l_orderkey, l_linenumber, k, r3, r4, rb,
          CASE upper(label) WHEN 'MODERATE' THEN 'medium' WHEN 'NONE' THEN 'low' WHEN 'CRITICAL' THEN 'critical'
            ELSE ['low', 'low', 'medium', 'high', 'critical'][greatest(r3, r4, rb) + 1] END AS severity
        FROM (SELECT l_orderkey, l_linenumber, k, label,
            CASE WHEN c = 'H' AND i = 'H' AND a = 'H' THEN 4 WHEN 'H' IN (c, i, a) THEN 3 WHEN 'L' IN (c, i, a) THEN 2 ELSE 1 END AS r3,
            CASE WHEN sc = 'H' AND sa = 'H' THEN 4 ELSE 3 END AS r4,
            CASE WHEN CAST(base AS DOUBLE) >= 9 THEN 4 WHEN CAST(base AS DOUBLE) >= 7 THEN 3 WHEN CAST(base AS DOUBLE) >= 4 THEN 2
              WHEN CAST(base AS DOUBLE) > 0 THEN 1 ELSE 0 END AS rb
          FROM (SELECT *, regexp_extract(v3, '/C:(.)', 1) AS c, regexp_extract(v3, '/I:(.)', 1) AS i, regexp_extract(v3, '/A:(.)', 1) AS a,
              regexp_extract(v4, '/SC:(.)', 1) AS sc, regexp_extract(v4, '/SA:(.)', 1) AS sa FROM ratings))
        """,
        ratings=RATINGS,
    ),
)
def cvss_ratings(t):
    scores = F.array("v3", "v4", "base")
    return t.derive(RATINGS).select(
        "l_orderkey",
        "l_linenumber",
        "k",
        versions.score_rank(F.col("v3")).alias("r3"),
        versions.score_rank(F.col("v4")).alias("r4"),
        versions.score_rank(F.col("base")).alias("rb"),
        versions.advisory_severity(F.col("label"), scores).alias("severity"),
    )


REMOTES = """
SELECT page_id, CASE page_id % 14
    WHEN 0 THEN concat('https://www.GitHub.com/Owner', CAST(page_id AS STRING), '/Repo.git')
    WHEN 1 THEN concat('git@github.com:o/r', CAST(page_id AS STRING), '.git')
    WHEN 2 THEN concat('ssh://git@gitlab.com:2222/g/s/r', CAST(page_id AS STRING), '/-/tree/main')
    WHEN 3 THEN concat('https://user:pw@dev.azure.com/Org/Proj/_git/R', CAST(page_id AS STRING))
    WHEN 4 THEN concat('git@ssh.dev.azure.com:v3/org/proj/r', CAST(page_id AS STRING))
    WHEN 5 THEN concat('https://org.visualstudio.com/DefaultCollection/proj/_git/r', CAST(page_id AS STRING))
    WHEN 6 THEN concat('https://bitbucket.org/o/r', CAST(page_id AS STRING), '/?x=1#y')
    WHEN 7 THEN 'https://github.com/only-owner' WHEN 8 THEN '/srv/git/r' WHEN 9 THEN 'file:///srv/r'
    WHEN 10 THEN 'https://github.com/o/../r' WHEN 11 THEN 'https://github.com/o/r r'
    WHEN 12 THEN concat('https://org.visualstudio.com/proj/_git/r', CAST(page_id AS STRING)) ELSE url END AS remote
FROM pages
"""


@query(
    "project_ids",
    with_ctes(
        r"""
        SELECT page_id, n AS normalised, sha256('project-v1:' || n) AS id FROM (
          SELECT page_id, CASE
            WHEN regexp_matches(remote, '\s') THEN NULL
            WHEN page_id % 14 IN (0, 1, 6) AND regexp_matches(h, '^(github.com|bitbucket.org)/[^/]+/[^/]+$') THEN h
            WHEN regexp_matches(h, '^gitlab.com/') THEN regexp_replace(h, '/-/.*$', '')
            WHEN regexp_matches(h, '^dev.azure.com/[^/]+/[^/]+/_git/[^/]+$') THEN replace(h, '/_git/', '/')
            WHEN starts_with(h, 'ssh.dev.azure.com/v3/') THEN 'dev.azure.com/' || substr(h, 22)
            WHEN contains(h, '.visualstudio.com/') THEN 'dev.azure.com/org/proj/' || regexp_extract(h, '[^/]*$') END AS n
          FROM (SELECT page_id, remote, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(remote),
              '^[a-z]+://', ''), '^[^/@]*@', ''), '^www[.]', ''), '[?#].*$', ''), '/+$|[.]git$', ''), ':([0-9]+/)?', '/') AS h FROM remotes)
        ) WHERE n IS NOT NULL
        """,
        remotes=REMOTES,
    ),
)
def project_ids(t):
    named = t.derive(REMOTES).select("page_id", remotes.normalise(F.col("remote")).alias("normalised"))
    return named.where("normalised IS NOT NULL").select(
        "page_id", "normalised", remotes.project_id(F.col("normalised")).alias("id")
    )


@query(
    "ci_remotes",
    r"""
    SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'ci.example.com/g/p' || s_suppkey
        WHEN 1 THEN 'ci.example.com/g/s/p' || s_suppkey END AS loose,
      CASE s_suppkey % 4 WHEN 0 THEN 'ci.example.com/g/p' || s_suppkey END AS exact
    FROM supplier
    """,
)
def ci_remotes(t):
    source = t.derive(
        """SELECT s_suppkey, 'CI.example.com:8443' AS host, CASE s_suppkey % 4
            WHEN 0 THEN concat('G/p', CAST(s_suppkey AS STRING)) WHEN 1 THEN concat('g/s/P', CAST(s_suppkey AS STRING))
            WHEN 2 THEN 'single' ELSE 'a//b' END AS path FROM supplier"""
    )
    return source.select(
        "s_suppkey",
        remotes.ci_remote(F.col("host"), F.col("path"), None).alias("loose"),
        remotes.ci_remote(F.col("host"), F.col("path"), 2).alias("exact"),
    )


PRINTS = """
SELECT event_id, concat('R-', event_type) AS rule_id, concat('src/u', CAST(user_id AS STRING), '.py') AS file,
  concat('  ', props, ' ') AS snippet, concat('Title ', event_type) AS title FROM events
"""


@query(
    "fingerprints",
    with_ctes(
        r"""
        SELECT event_id, format('{:016x}', CAST(list_reduce(
          list_prepend(14695981039346656037::HUGEINT, list_transform(range(1, strlen(s) + 1), lambda i: CAST(ascii(substr(s, i, 1)) AS HUGEINT))),
          lambda a, b: (xor(a, b) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT) AS UBIGINT)) AS fingerprint
        FROM (SELECT event_id, rule_id || chr(0) || file || chr(0) || trim(snippet) || chr(0) || title AS s FROM prints)
        """,
        prints=PRINTS,
    ),
)
def fingerprints(t):
    columns = [F.col(c) for c in ("rule_id", "file", "snippet", "title")]
    return t.derive(PRINTS).select("event_id", hashing.fingerprint(*columns).alias("fingerprint"))


@query(
    "rule_id_sanitiser",
    r"""
    SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'unknown' ELSE
        regexp_replace(o_orderpriority || ' ' || repeat('é', CAST(o_orderkey % 140 AS BIGINT)), '[^A-Za-z0-9_.:-]', '_', 'g') END AS rule_id,
      CASE WHEN o_orderkey % 3 = 0 THEN '1.2.' || o_custkey ELSE '0.0.0' END AS version
    FROM orders
    """,
)
def rule_id_sanitiser(t):
    raw = t.derive(
        """SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE
            concat(o_orderpriority, ' ', repeat('é', CAST(o_orderkey % 140 AS INT))) END AS rule_id,
          CASE WHEN o_orderkey % 3 = 0 THEN concat('1.2.', CAST(o_custkey AS STRING)) ELSE '1.2' END AS version
        FROM orders"""
    )
    return raw.select(
        "o_orderkey",
        versions.sanitise_rule_id(F.col("rule_id")).alias("rule_id"),
        summary.reported_version(F.col("version")).alias("version"),
    )


@query(
    "levels_and_timestamps",
    """
    SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'note' WHEN value >= 15 THEN 'error'
        WHEN value >= 5 THEN 'warning' ELSE 'note' END AS level,
      strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS at
    FROM events
    """,
)
def levels_and_timestamps(t):
    severity = (
        F.when(F.col("value") < 5, "low")
        .when(F.col("value") < 15, "medium")
        .when(F.col("value") < 30, "high")
        .otherwise("critical")
    )
    kind = F.when(F.col("event_id") % 3 == 0, "observation").otherwise("defect")
    return t.events.select(
        "event_id",
        report.level(kind, severity).alias("level"),
        summary.timestamp_text(F.col("ts")).alias("at"),
    )
