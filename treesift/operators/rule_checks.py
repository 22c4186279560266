"""What a rule must satisfy before it may run; also for rules a user adds."""

from __future__ import annotations

import re

from treesift.dimensions import CATEGORIES
from treesift.model import CONFIDENCES, KINDS, SEVERITIES
from treesift.operators.provenance import SOURCES
from treesift.operators.python_rules import Match


class RuleError(ValueError):
    """A rule that cannot mean what it says."""


_KNOWN = {row[0] for row in CATEGORIES}
_OBSERVATION_ONLY = {row[0] for row in CATEGORIES if row[5]}


def validate(rules: list[Match]) -> list[Match]:
    """The rules themselves, or the first error."""
    seen: set[str] = set()
    for match in rules:
        rule, flow = match.rule, match.flow
        where = rule.rule_id
        if where in seen:
            raise RuleError(f"{where}: duplicate id")
        seen.add(where)
        if not rule.categories:
            raise RuleError(f"{where}: no category")
        if unknown := set(rule.categories) - _KNOWN:
            raise RuleError(f"{where}: unknown categories {sorted(unknown)}")
        if rule.kind not in KINDS or rule.severity not in SEVERITIES or rule.confidence not in CONFIDENCES:
            raise RuleError(f"{where}: unknown kind, severity or confidence")
        if rule.kind == "defect" and set(rule.categories) & _OBSERVATION_ONLY:
            raise RuleError(f"{where}: a context-dependent category cannot be a defect")
        if flow is None:
            continue
        if match.value is None:
            raise RuleError(f"{where}: a flow clause needs a value")
        if unknown := set(flow.sources) - set(SOURCES):
            raise RuleError(f"{where}: unknown sources {sorted(unknown)}")
        if flow.unproven is not None:
            if rule.kind == "observation":
                raise RuleError(f"{where}: an observation cannot be unproven")
            if not flow.sources:
                raise RuleError(f"{where}: unproven without a source")
            try:
                re.compile(flow.unproven)
            except re.error as error:
                raise RuleError(f"{where}: invalid pattern: {error}") from error
        if flow.passthrough and flow.sources:
            raise RuleError(f"{where}: pass-through applies to rules without a source")
    return rules
