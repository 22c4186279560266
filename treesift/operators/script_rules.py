"""Detection rules on JavaScript and TypeScript facts: one projection, no join."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treesift.functions.credentials import CREDENTIAL_NAME
from treesift.functions.paths import is_test_path
from treesift.model import CONFIDENCES, FINDING_FIELDS, KINDS, SEVERITIES, string_array
from treesift.operators.python_rules import (
    BEARER_TEXT,
    CONFIRM,
    EXECUTED,
    KEY_TEXT,
    MODEL_NAMES,
    PARAMETERISE,
    PROMPT_NAMES,
    SHELL,
    STATE_CHANGING_VERBS,
    USER_NAMES,
    Match,
    _rule,
    credential_literal,
)
from treesift.sources.batches import of_every_path

# Callees and patterns of the script rules.
SHELL_CALLEES = (
    "cp.exec",
    "cp.execSync",
    "child_process.exec",
    "child_process.execSync",
    "childProcess.exec",
    "childProcess.execSync",
    "execSync",
)
KEY_PLACEHOLDER = (
    "(?i)(test|example|placeholder|dummy|foo|changeme|your[-_]?key[-_]?here|local|xxx|0{8,}|1{8,})"
)
GRANT_CALLEE = r"(?i)^[a-z_$][a-z0-9_$]*(tool|agent)[a-z0-9_$]*$"


def _any(*patterns: str) -> str:
    return "(?i)" + "|".join(f"(?:{p.removeprefix('(?i)')})" for p in patterns)


# What the rules below look at: names of facts by kind, of strings the content. It may find more than the rules do,
# whatever the engine; a rule whose facts it does not find would see nothing.
WANTED = {
    "call": _any("^eval$", *SHELL_CALLEES, r"\.query$", GRANT_CALLEE, "^generateText$", "^streamText$", r"\.chat\.completions\.create$"),
    "new": _any("^Function$", "^ChatOpenAI$", "^ChatAnthropic$"),
    "string": _any(KEY_TEXT, r"^Bearer\s"),
    "const": _any(PROMPT_NAMES, CREDENTIAL_NAME),
    "tool": STATE_CHANGING_VERBS,
}


def _arg(index: int) -> Column:
    return F.get(F.col("args"), F.lit(index))


def _string(argument: Column) -> Column:
    return F.coalesce(argument["kind"] == "string", F.lit(False))


def rules() -> list[Match]:
    fact, name, first = F.col("fact"), F.col("name"), _arg(0)
    one = F.size("args") == 1
    last = F.try_element_at(F.col("args"), F.lit(-1))

    def capped(key: str) -> Column:
        return one & (first["kind"] == "object") & F.array_contains(first["keys"], key)

    unlimited = (
        ((fact == "call") & name.isin("generateText", "streamText") & ~capped("maxOutputTokens"))
        | ((fact == "call") & name.endswith(".chat.completions.create") & ~capped("max_tokens"))
        | ((fact == "new") & name.isin("ChatOpenAI", "ChatAnthropic") & ~capped("maxTokens"))
    )
    return [
        Match(
            _rule("BAS-LLM10-005", "eval() or new Function() run on a non-literal expression (JS)", "observation", "high", "medium", "LLM10 ZT4", "Code that is not a fixed literal is executed.", EXECUTED),
            (((fact == "call") & (name == "eval")) | ((fact == "new") & (name == "Function"))) & one & ~_string(first),
        ),
        Match(
            _rule("BAS-LLM10-006", "Model output executed as a shell command (JS)", "observation", "critical", "high", "LLM10", "A value named like a model reply reaches a shell.", SHELL),
            (fact == "call") & name.isin(*SHELL_CALLEES) & one & first["text"].rlike(MODEL_NAMES),
        ),
        Match(
            _rule("BAS-LLM10-007", "Model output concatenated into a SQL query (JS)", "observation", "critical", "high", "LLM10", "A value named like a model reply is part of the query text.", PARAMETERISE),
            (fact == "call") & name.endswith(".query") & one & first["hole"].rlike(MODEL_NAMES),
        ),
        Match(
            _rule("BAS-ZT1-003", "Hardcoded API key (JS/TS)", "defect", "critical", "high", "ZT1", "A provider key is a literal in source.", "Load the key from the environment and rotate it."),
            (fact == "string") & first["content"].rlike(f"^{KEY_TEXT}$") & ~first["content"].rlike(KEY_PLACEHOLDER),
            report_in_tests=True,
        ),
        Match(
            _rule("BAS-ZT4-003", "Raw user input folded directly into a template-literal system prompt (JS)", "observation", "high", "high", "LLM01 ZT4", "A value named like user input is part of the instruction text.", "Pass untrusted input as a message of its own."),
            (fact == "const") & name.rlike(PROMPT_NAMES) & first["hole"].rlike(USER_NAMES) & ~F.array_contains("messages", name),
        ),
        Match(
            _rule("BAS-LLM03-002", "Unauthorized agent tool exposed without a confirmation guard (JS)", "observation", "high", "medium", "LLM03", "A state-changing tool acts without a guard.", CONFIRM),
            (fact == "tool") & name.rlike(STATE_CHANGING_VERBS) & one & (first["last_key"] == "execute") & ~first["guarded"],
        ),
        Match(
            _rule("BAS-LLM08-002", "Secret embedded inside a prompt template (JS)", "defect", "critical", "high", "LLM08", "A credential is part of the text the model reads.", "Keep credentials out of the context window."),
            (fact == "const") & name.rlike(PROMPT_NAMES) & first["content"].rlike(f"(?i){KEY_TEXT}"),
        ),
        Match(
            _rule("BAS-LLM06-002", "LLM call has no token ceiling (JS)", "observation", "low", "medium", "LLM06", "Nothing in the repository bounds the cost of one call.", "Set a token ceiling, or document what bounds the call."),
            unlimited,
        ),
        Match(
            _rule("BAS-ZT2-002", "Wildcard tool grant in agent-construction code (JS)", "defect", "high", "high", "ZT2", "An agent is granted every tool, present and future.", "List the tools the agent needs."),
            (fact == "call") & name.rlike(GRANT_CALLEE) & (F.size("args") > 0) & _string(last) & (last["content"] == "*"),
        ),
        Match(
            _rule("BAS-ZT1-011", "Hardcoded credential assigned to a credential-named constant (JS/TS)", "defect", "critical", "high", "ZT1", "A credential-named constant holds a literal.", "Load the value from the environment and rotate it."),
            (fact == "const") & credential_literal(name, first["content"]),
        ),
        Match(
            _rule("BAS-LLM02-005", "Hardcoded bearer token (JS/TS)", "defect", "high", "high", "LLM02", "An authorization header carries a literal token.", "Load the value from the environment and rotate it."),
            (fact == "string") & first["content"].rlike(BEARER_TEXT),
        ),
    ]


def findings(facts: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """Findings of all script rules, one per location.

    With ``members``, facts are those of :func:`treesift.sources.batches.distinct_texts`: rules are judged once for
    each text, and what is found is then reported for every path that has it.

    Until then a location's findings are one number with a bit for each rule, so that rows stay small. The text of
    a finding's line is joined to what matched, so ``facts`` are read twice: pass a written table.
    """
    table = rules()
    bits = [F.when(match.condition, F.lit(1 << i)).otherwise(F.lit(0)) for i, match in enumerate(table)]
    matched = facts.where("fact not in ('unparseable', 'line')").select(
        "path", "line", "col", reduce(Column.bitwiseOR, bits).alias("found")
    )
    # Filtered only when grouped: a filter before would be pushed down with a second copy of all conditions.
    places = matched.groupBy("path", "line", "col").agg(F.bit_or("found").alias("found")).where("found <> 0")
    lines = facts.where("fact = 'line'").select("path", "line", F.col("snippet").alias("shown"))
    shown = places.join(lines, ["path", "line"])
    return _merged(shown if members is None else of_every_path(shown, members), table)


def _merged(places: DataFrame, table: list[Match]) -> DataFrame:
    """The finding of each location from the bits of its rules: the best of them, the others as secondary ids.

    Best first, as :func:`treesift.plans.report.merge_same_location` has it: defects, then severity, then confidence,
    then the lowest rule id.
    """

    def has(i: int, bits: str = "found") -> Column:
        return F.col(bits).bitwiseAND(F.lit(1 << i)) != 0

    def kind(match: Match, quiet: bool) -> str:
        return "observation" if quiet and not match.report_in_tests else match.rule.kind

    def best(quiet: bool) -> Column:
        def rank(i: int) -> tuple:
            rule = table[i].rule
            levels = -SEVERITIES.index(rule.severity), -CONFIDENCES.index(rule.confidence)
            return KINDS.index(kind(table[i], quiet)), *levels, rule.rule_id

        return F.coalesce(*[F.when(has(i), F.lit(i)) for i in sorted(range(len(table)), key=rank)])

    def of_best(values: list[Column]) -> Column:
        return F.get(F.array(*values), F.col("best"))

    ids = sorted(range(len(table)), key=lambda i: table[i].rule.rule_id)
    others = F.array_compact(F.array(*[F.when(has(i, "others"), F.lit(table[i].rule.rule_id)) for i in ids]))
    values = {
        name: of_best([F.lit(getattr(match.rule, name)) for match in table])
        for name in ("rule_id", "title", "severity", "confidence", "description", "remediation")
    } | {
        "kind": F.when(F.col("quiet"), of_best([F.lit(kind(m, True)) for m in table])).otherwise(
            of_best([F.lit(kind(m, False)) for m in table])
        ),
        "categories": of_best([string_array(match.rule.categories) for match in table]),
        "location": F.struct(F.col("path").alias("file"), "line", F.col("col").alias("column")),
        "snippet": F.col("shown"),
        "secondary_rule_ids": F.when(F.col("others") == 0, string_array(())).otherwise(others),
        "references": string_array(()),
    }
    judged = places.withColumn("quiet", is_test_path(F.col("path")))
    judged = judged.withColumn("best", F.when(F.col("quiet"), best(True)).otherwise(best(False)))
    judged = judged.withColumn("others", F.col("found") - of_best([F.lit(1 << i) for i in range(len(table))]))
    return judged.select(*[values[name].alias(name) for name in FINDING_FIELDS])
