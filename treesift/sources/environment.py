"""Git configurations and continuous-integration variables as columns.

Both work on tables of repositories: one configuration text, or one map of variables, per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from treesift.functions import remotes
from treesift.functions.text import let, lines, strip

OTHER_CI_VARIABLES = (
    "BUILD_NUMBER",
    "JENKINS_URL",
    "TF_BUILD",
    "CIRCLECI",
    "BITBUCKET_BUILD_NUMBER",
    "BUILDKITE",
    "TEAMCITY_VERSION",
    "TRAVIS",
    "APPVEYOR",
    "DRONE",
    "CODEBUILD_BUILD_ID",
)

_HEADER = r"^\[\s*([A-Za-z0-9.-]+)\s*(?:\"((?:[^\"\\]|\\.)*)\"\s*)?\]\s*(.*)$"
_SETTING = r"^\s*(?i:url)\s*=\s*(.*)$"


def _clean(value: Column) -> Column:
    """Quotes off, escapes resolved, an unquoted comment after white space dropped."""
    kept = F.regexp_extract(value, r"^((?:\"(?:[^\"\\]|\\.)*\"|\\.|[^\"\\#;]|(?<!\s)[#;])*)", 1)
    return strip(F.regexp_replace(F.regexp_replace(kept, r"(?<!\\)\"", ""), r"\\(.)", "$1"))


def config_remotes(text: Column) -> Column:
    """``array<struct<name, url>>``: the first url of every remote section, in file order.

    A fold over the lines carries the current section. A text above the size cap reads as empty.
    """
    start = F.struct(
        F.lit(None).cast("string").alias("section"),
        F.array().cast("array<struct<name:string,url:string>>").alias("out"),
    )

    def step(acc: Column, raw: Column) -> Column:
        line = strip(raw)
        header = line.startswith("[")
        is_remote = F.lower(F.regexp_extract(line, _HEADER, 1)) == "remote"
        name = F.regexp_replace(F.regexp_extract(line, _HEADER, 2), r"\\(.)", "$1")
        opened = F.when(line.rlike(_HEADER) & is_remote & line.contains('"'), name)
        section = F.when(header, opened).otherwise(acc["section"])
        body = F.when(header, F.regexp_extract(line, _HEADER, 3)).otherwise(line)
        seen = F.exists(acc["out"], lambda r: r["name"] == section)
        adds = section.isNotNull() & body.rlike(_SETTING) & ~F.coalesce(seen, F.lit(False))
        found = F.struct(
            section.alias("name"), _clean(F.regexp_extract(body, _SETTING, 1)).alias("url")
        )
        return F.struct(
            section.alias("section"),
            F.when(adds, F.array_append(acc["out"], found)).otherwise(acc["out"]).alias("out"),
        )

    return F.aggregate(lines(text), start, step, lambda acc: acc["out"])


def chosen_remote(text: Column) -> Column:
    """The url of ``origin``, else of the only remote, else NULL."""

    def choose(found: Column) -> Column:
        origin = F.get(F.filter(found, lambda r: r["name"] == "origin"), F.lit(0))["url"]
        only = F.when(F.size(found) == 1, F.get(found, F.lit(0))["url"])
        return F.coalesce(origin, only)

    return let(config_remotes(text), choose)


def project_remote(config: Column, variables: Column) -> Column:
    """The normalised remote of a repository: its configuration first, then the CI variables."""
    return F.coalesce(remotes.normalise(chosen_remote(config)), variables_remote(variables))


def variables_remote(variables: Column) -> Column:
    server = F.regexp_extract(F.lower(variables["GITHUB_SERVER_URL"]), r"^https?://([^/]*)", 1)
    return F.coalesce(
        remotes.ci_remote(server, variables["GITHUB_REPOSITORY"], 2),
        remotes.ci_remote(variables["CI_SERVER_HOST"], variables["CI_PROJECT_PATH"], None),
    )


def environment(variables: Column) -> Column:
    """``github-actions``, ``gitlab-ci``, ``other-ci`` or ``local`` from a map of variables."""
    generic = variables["CI"]
    known = F.lit(False)
    for name in OTHER_CI_VARIABLES:
        known = known | F.coalesce(variables[name] != "", F.lit(False))
    on = F.coalesce((generic != "") & ~F.lower(generic).isin("false", "0"), F.lit(False))
    return (
        F.when(variables["GITHUB_ACTIONS"] == "true", "github-actions")
        .when(variables["GITLAB_CI"] == "true", "gitlab-ci")
        .when(on | known, "other-ci")
        .otherwise("local")
    )
