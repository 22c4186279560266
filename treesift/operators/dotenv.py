"""Environment files: one assignment per line, judged as provider key or credential."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from treesift import rulebook
from treesift.functions import credentials as cred
from treesift.functions.paths import is_dotenv_sample
from treesift.functions.text import lines, strip
from treesift.model import finding, no_findings


def unquote(value: Column) -> Column:
    quoted = r"^(?:\"(.*)\"|'(.*)')$"
    inner = F.concat(F.regexp_extract(value, quoted, 1), F.regexp_extract(value, quoted, 2))
    return F.when(value.rlike(quoted), inner).otherwise(value)


def assignments(text: Column) -> Column:
    """``array<struct<key, value, line>>`` of the text's assignments.

    Blank lines and comments are dropped, ``export`` is optional, an unquoted value ends before
    white space followed by ``#``, and one pair of matching quotes is removed.
    """

    def parse(raw: Column, index: Column) -> Column:
        body = F.regexp_replace(strip(raw), r"^export ", "")
        value = F.regexp_replace(body, r"^[^=]*=", "")
        value = F.when(value.rlike(r"^\s*[\"']"), value).otherwise(
            F.regexp_replace(value, r"\s#.*$", "")
        )
        return F.struct(
            strip(F.substring_index(body, "=", 1)).alias("key"),
            unquote(strip(value)).alias("value"),
            (index + 1).cast("bigint").alias("line"),
            (body.contains("=") & ~strip(raw).startswith("#")).alias("valid"),
        )

    parsed = F.transform(lines(text), parse)
    return F.transform(
        F.filter(parsed, lambda a: a["valid"]),
        lambda a: F.struct(a["key"].alias("key"), a["value"].alias("value"), a["line"].alias("line")),
    )


def findings(path: Column, text: Column) -> Column:
    """A provider key wins over a credential-named key; sample files are silent."""

    def judge(a: Column) -> Column:
        return F.when(
            cred.is_provider_key(a["value"]),
            _finding(rulebook.DOTENV_PROVIDER_KEY, path, a, F.lit("critical")),
        ).when(
            cred.is_credential_key(a["key"]) & cred.is_hardcoded_value(a["value"]),
            _finding(rulebook.DOTENV_CREDENTIAL, path, a, cred.credential_severity(a["value"])),
        )

    judged = F.array_compact(F.transform(assignments(text), judge))
    return F.when(is_dotenv_sample(path), no_findings()).otherwise(judged)


def _finding(rule, path: Column, assignment: Column, severity: Column) -> Column:
    return finding(
        rule,
        file=path,
        line=assignment["line"],
        snippet=F.concat(assignment["key"], F.lit("="), assignment["value"]),
        severity=severity,
    )
