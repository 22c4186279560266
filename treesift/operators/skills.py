"""Skill files: frontmatter, instruction overrides, skipped confirmations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from treesift import rulebook
from treesift.functions.text import column_at, let, line_at, phrase_scan, snippet
from treesift.model import Rule, finding, only_if

# Fields a frontmatter block must hold, and the two phrase lists.
REQUIRED_FIELDS = ("name", "description")
INJECTION_PHRASES = (
    "ignore all previous instructions",
    "ignore previous instructions",
    "ignore all prior instructions",
    "disregard all previous instructions",
    "disregard previous instructions",
    "disregard all prior instructions",
    "forget all previous instructions",
    "forget your previous instructions",
    "new instructions:",
    "override your instructions",
    "system prompt override",
)
SKIP_CONFIRMATION_PHRASES = (
    "do not ask for confirmation",
    "don't ask for confirmation",
    "without asking for confirmation",
    "without pausing",
    "do not pause for approval",
    "no need to confirm",
    "no confirmation needed",
    "act autonomously",
    "proceed without approval",
    "skip confirmation",
    "complete in one turn without pausing",
    "the user trusts this skill to act autonomously",
)

_FENCED = r"(?s)^\ufeff*\s*---\r?\n(.*?)(?<=\n)---[ \t]*(?:\r?\n|$)"


def frontmatter(text: Column) -> Column:
    """The YAML between the opening and closing ``---`` lines, or NULL."""
    pattern = _FENCED.replace("\\ufeff", "\ufeff")
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, 1))


def missing_fields(document: Column) -> Column:
    """Required fields a frontmatter document (canonical JSON) lacks; all of them when it is none."""
    keys = F.json_object_keys(document)
    required = F.array(*[F.lit(f) for f in REQUIRED_FIELDS])
    return F.coalesce(F.array_except(required, keys), required)


def _phrase_findings(rule: Rule, phrases: tuple[str, ...], path: Column, text: Column) -> Column:
    def report(hit: Column) -> Column:
        line = line_at(text, hit["offset"])
        return only_if(
            hit.isNotNull(),
            finding(
                rule,
                file=path,
                line=line,
                column=column_at(text, hit["offset"]),
                snippet=snippet(text, line),
                description=F.format_string(
                    '%d occurrence(s), the first being "%s". ' + rule.description,
                    hit["count"],
                    hit["phrase"],
                ),
            ),
        )

    return let(phrase_scan(text, phrases), report)


def injection_findings(path: Column, text: Column) -> Column:
    return _phrase_findings(rulebook.SKILL_INJECTION, INJECTION_PHRASES, path, text)


def confirmation_findings(path: Column, text: Column) -> Column:
    rule = rulebook.SKILL_SKIP_CONFIRMATION
    return _phrase_findings(rule, SKIP_CONFIRMATION_PHRASES, path, text)


def frontmatter_findings(path: Column, text: Column, document: Column) -> Column:
    missing = missing_fields(document)
    return only_if(
        F.size(missing) > 0,
        finding(
            rulebook.SKILL_FRONTMATTER,
            file=path,
            snippet=snippet(text, 1),
            description=F.concat(
                F.lit(rulebook.SKILL_FRONTMATTER.description + " Missing: "),
                F.array_join(missing, ", "),
                F.lit("."),
            ),
        ),
    )
