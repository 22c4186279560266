"""Version strings, pins, constraints, CVSS ratings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from treesift.functions.text import let, strip

# Agent packages whose unbounded pins are reported.
AGENT_PACKAGES = (
    "mcp",
    "fastmcp",
    "@modelcontextprotocol/sdk",
    "langgraph",
    "@langchain/langgraph",
    "autogen",
    "pyautogen",
    "ag2",
    "crewai",
    "crewai-tools",
    "smolagents",
    "llama-index",
    "llama_index",
    "haystack-ai",
    "guidance",
    "dspy",
    "dspy-ai",
    "pydantic-ai",
    "semantic-kernel",
    "openai-agents",
    "@openai/agents",
    "openai",
    "anthropic",
    "@anthropic-ai/sdk",
    "langchain",
    "mastra",
)
AGENT_PACKAGE_PREFIXES = ("langchain-", "langchain_", "@langchain/", "@mastra/")


def digits(version: Column) -> Column:
    """The numbers of a version as an array; arrays compare element by element, shorter first."""
    runs = F.regexp_extract_all(version, F.lit(r"([0-9]+)"), F.lit(1))
    numbers = F.array_compact(F.transform(runs, lambda r: r.try_cast("bigint")))
    return F.when(F.size(numbers) > 0, numbers)


def is_plain_release(version: Column) -> Column:
    return strip(version).rlike(r"^[0-9]+(\.[0-9]+)*$")


def exact_pin(version: Column) -> Column:
    """The version an exact pin names, or NULL for a range."""
    bare = strip(F.regexp_replace(strip(version), r"^=", ""))
    return F.when(bare.rlike(r"^[0-9]+(\.[0-9]+)*([-+].*)?$"), bare)


def is_unbounded(constraint: Column) -> Column:
    """No upper bound at all: a wildcard, ``latest``, nothing, or one lone lower bound."""
    c = strip(constraint)
    return (
        c.isin("", "*", "x", "X")
        | (F.lower(c) == "latest")
        | c.rlike(r"^>=?\s*[A-Za-z0-9.+-]+$")
    )


def is_agent_package(name: Column) -> Column:
    prefixed = F.lit(False)
    for prefix in AGENT_PACKAGE_PREFIXES:
        prefixed = prefixed | name.startswith(prefix)
    return name.isin(*AGENT_PACKAGES) | prefixed


def is_valid_version(version: Column) -> Column:
    """``N.N.N`` with an optional suffix."""
    shape = r"^[0-9]+\.[0-9]+\.[0-9]+([-+][A-Za-z0-9.-]+)?$"
    return version.rlike(shape)


def sanitise_rule_id(rule_id: Column) -> Column:
    cleaned = F.regexp_replace(rule_id, r"[^A-Za-z0-9_.:-]", "_")
    return F.when(cleaned == "", F.lit("unknown")).otherwise(cleaned)


def within(low: Column, high: Column, version: Column) -> Column:
    """Whether version digits lie in ``[low, high)``; a missing bound is open."""
    above = low.isNull() | (version >= low)
    below = high.isNull() | (version < high)
    return F.coalesce(version.isNotNull() & above & below, F.lit(False))


def lower_bound(introduced: Column) -> Column:
    """Digits of an ``introduced`` event; ``0`` means from the beginning."""
    return F.when(introduced != "0", digits(introduced))


def cvss_vector_rank(vector: Column) -> Column:
    """1..4 from the impact metrics of a CVSS vector.

    Only the spread of C/I/A counts, or of the v4 vulnerable-system metrics; when neither is
    present, the v4 subsequent-system metrics stand in.
    """
    primary = F.regexp_extract_all(vector, F.lit(r"/(?:C|I|A|VC|VI|VA):([^/]*)"), F.lit(1))
    secondary = F.regexp_extract_all(vector, F.lit(r"/(?:SC|SI|SA):([^/]*)"), F.lit(1))

    def grade(metrics: Column) -> Column:
        high = F.array_contains(metrics, "H")
        low = F.array_contains(metrics, "L") | F.array_contains(metrics, "M")
        only_high = F.forall(metrics, lambda m: m == "H")
        return F.when(high & only_high, 4).when(high, 3).when(low, 2).otherwise(1)

    return let(
        primary, lambda p: F.when(F.size(p) > 0, grade(p)).otherwise(let(secondary, grade))
    )


def score_rank(score: Column) -> Column:

    def grade(base: Column) -> Column:
        return (
            F.when(base >= 9.0, 4)
            .when(base >= 7.0, 3)
            .when(base >= 4.0, 2)
            .when(base > 0.0, 1)
            .otherwise(0)
        )

    number = let(strip(score).try_cast("double"), grade)
    return F.when(score.startswith("CVSS:"), cvss_vector_rank(score)).otherwise(number)


def advisory_severity(label: Column, scores: Column) -> Column:
    """The database's own label wins; otherwise the worst score entry."""
    named = (
        F.when(F.upper(label) == "CRITICAL", 4)
        .when(F.upper(label) == "HIGH", 3)
        .when(F.upper(label).isin("MEDIUM", "MODERATE"), 2)
        .when(F.upper(label) == "LOW", 1)
        .when(F.upper(label) == "NONE", 0)
    )
    best = F.coalesce(F.array_max(F.transform(scores, score_rank)), F.lit(0))
    grade = F.coalesce(named, best)
    return (
        F.when(grade == 4, "critical").when(grade == 3, "high").when(grade == 2, "medium").otherwise("low")
    )
