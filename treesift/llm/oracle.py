"""SQL that must give the rows of a query, where SQL can express it."""

from __future__ import annotations

from itertools import permutations

from treesift.llm.host_reputation import ADDRESS, LONG_SUFFIX, LOWER, NUMERIC, UPPER


def _digamma(x: str) -> str:
    y = f"({x} + 6)"
    terms = " ".join(f"- 1 / ({x} + {k})" for k in range(6))
    return f"(ln({y}) - 1 / (2 * {y}) - 1 / (12 * {y} * {y}) + 1 / (120 * {y} * {y} * {y} * {y}) {terms})"


def _trigamma(x: str) -> str:
    y = f"({x} + 6)"
    terms = " ".join(f"+ 1 / (({x} + {k}) * ({x} + {k}))" for k in range(6))
    return f"(1 / {y} + 1 / (2 * {y} * {y}) + 1 / (6 * {y} * {y} * {y}) - 1 / (30 * {y} * {y} * {y} * {y} * {y}) {terms})"


def _last(n: int) -> str:
    """The last labels of a host, or all if it has fewer."""
    return f"array_to_string(list_reverse(list_slice(list_reverse(string_split(host, '.')), 1, {n})), '.')"


def _level(name: str, rows: str) -> str:
    """``name``: rows with their posterior; ``rows`` give ``n``, ``bad`` and the prior ``mean``."""
    return f"""{name}_prior AS ({rows}),
    {name}_moments AS (SELECT sum(n * (bad / n - mean) * (bad / n - mean)) AS seen, sum(mean * (1 - mean)) AS least,
      sum(mean * (1 - mean) * (n - 1)) AS more FROM {name}_prior WHERE n > 0),
    {name}_weight AS (SELECT CASE WHEN coalesce(more, 0) = 0 THEN 2.0
      ELSE round(1 / least(0.999, greatest(0.001, (seen - least) / more)) - 1, 6) END AS w FROM {name}_moments),
    {name} AS (SELECT *, mean * w + bad AS a, (1 - mean) * w + n - bad AS b FROM {name}_prior, {name}_weight)"""


def host_filter(rules: list, limit: float = 0.5, z: float = 1.645) -> str:
    long, address = f"regexp_matches({_last(2)}, '{LONG_SUFFIX}')", f"regexp_matches(host, '{ADDRESS}')"
    pattern = "(?s)^.*?://([^/?#]*)([^?#]*)"
    rule_rows = ", ".join(
        f"('{r.text}', '{r.verdict}', '{r.text.partition('/')[0]}', '/{r.text.partition('/')[2]}')" for r in rules
    )
    counts = "count(bad)::DOUBLE AS n, coalesce(sum(bad), 0)::DOUBLE AS bad"
    sums = "sum(n) AS n, sum(bad) AS bad"
    return f"""
    WITH p AS (SELECT page_id, translate(coalesce(regexp_extract(url, '{pattern}', 1), ''), '{UPPER}', '{LOWER}') AS host,
        coalesce(regexp_extract(url, '{pattern}', 2), '') AS path FROM pages),
    outcome AS (SELECT doc_id AS page_id, max(CASE WHEN toxic = 1 OR quality = 0 THEN 1 ELSE 0 END) AS bad FROM labels
      WHERE doc_id IS NOT NULL AND (toxic IS NOT NULL OR quality IS NOT NULL) GROUP BY 1),
    host_counts AS (SELECT host, {counts} FROM p LEFT JOIN outcome USING (page_id) GROUP BY host),
    hosts AS (SELECT *, CASE WHEN {address} THEN host WHEN {long} THEN {_last(3)} ELSE {_last(2)} END AS domain,
      CASE WHEN {address} THEN '{NUMERIC}' WHEN {long} THEN {_last(2)} ELSE {_last(1)} END AS suffix FROM host_counts),
    domains AS (SELECT domain, suffix, {sums} FROM hosts GROUP BY ALL),
    suffixes AS (SELECT suffix, {sums} FROM domains GROUP BY ALL),
    {_level("by_suffix", "SELECT *, (SELECT (sum(bad) + 1) / (sum(n) + 2) FROM suffixes) AS mean FROM suffixes")},
    {_level("by_domain", "SELECT d.*, s.a / (s.a + s.b) AS mean FROM domains d JOIN by_suffix s USING (suffix)")},
    {_level("by_host", "SELECT h.*, d.a / (d.a + d.b) AS mean FROM hosts h JOIN by_domain d USING (domain)")},
    known AS (SELECT host, round(1 / (1 + exp(-({_digamma('a')} - {_digamma('b')}
      - {z} * sqrt({_trigamma('a')} + {_trigamma('b')})))), 6) AS low FROM by_host),
    rules AS (SELECT * FROM (VALUES {rule_rows}) r(rule, verdict, own, start)),
    fits AS (SELECT u.host, u.path, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
      FROM (SELECT DISTINCT host, path FROM p) u JOIN rules r ON (u.host = own OR ends_with(u.host, '.' || own)) AND starts_with(u.path, start)
      GROUP BY ALL)
    SELECT page_id, p.host, p.path, rule, coalesce(verdict, CASE WHEN low > {limit} THEN 'block' ELSE 'allow' END) AS verdict, low
    FROM p LEFT JOIN known ON p.host = known.host LEFT JOIN fits ON p.host = fits.host AND p.path = fits.path
    """


def best_products(k: int = 5, every: int = 50, factor: int = 256) -> str:
    """Products of every row with each query; distinct ids assumed, as in the tables."""
    return f"""
    WITH v AS (SELECT vec_id, [floor({factor} * x::DOUBLE) for x in embedding] AS codes FROM embeddings
      WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
    s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.codes, c.codes)::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.codes) = len(c.codes) WHERE q.vec_id % {every} = 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
    SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {k}
    """


def filter_interactions() -> str:
    """Each row's failures as bits; a step's rows are those that no earlier bit of its order holds."""
    letters = "ABCDE"
    bit = {f: 1 << k for k, f in enumerate(letters)}
    steps = ", ".join(
        f"('{''.join(order)}', {k + 1}, '{f}', {sum(bit[g] for g in order[:k])}, {bit[f]})"
        for order in permutations(letters)
        for k, f in enumerate(order)
    )
    return f"""
    WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
        regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
    f AS (SELECT doc_id, part,
        CASE WHEN len(words) < 50 THEN 1 ELSE 0 END
        + CASE WHEN 100 * len(list_distinct(words)) < 65 * len(words) THEN 2 ELSE 0 END
        + CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 5 * length(t) THEN 4 ELSE 0 END
        + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
        + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS bits FROM d),
    l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY 1),
    c AS (SELECT part, bits, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic
        FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL),
    s AS (SELECT * FROM (VALUES {steps}) s(filter_order, step, filter, earlier, own)),
    r AS (SELECT part, filter_order, step, filter,
        sum(CASE WHEN bits & (earlier | own) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
        sum(CASE WHEN bits & earlier = 0 AND bits & own > 0 THEN n ELSE 0 END)::BIGINT AS removed,
        sum(CASE WHEN bits & earlier > 0 AND bits & own > 0 THEN n ELSE 0 END)::BIGINT AS redundant,
        sum(CASE WHEN bits = own THEN n ELSE 0 END)::BIGINT AS unique_fails,
        sum(CASE WHEN bits & earlier = 0 AND bits & own > 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
        sum(CASE WHEN bits & earlier = 0 AND bits & own > 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
        FROM c, s GROUP BY part, filter_order, step, filter)
    SELECT *, (sum(removed) OVER (PARTITION BY part, filter))::BIGINT AS shapley FROM r
    """
