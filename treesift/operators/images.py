"""Image definitions: logical instructions, the user an image runs as, baked-in credentials."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from treesift import rulebook
from treesift.functions import credentials as cred
from treesift.functions.text import let, lines, snippet, strip
from treesift.model import finding, no_findings
from treesift.operators.dotenv import unquote

# A control character cannot occur in a line that survived trimming and splitting.
_MARK = "\u0002"


def instructions(text: Column) -> Column:
    """``array<struct<seq, keyword, arguments, line>>``, continuations joined.

    Lines are numbered first, blank and comment lines dropped, and only then are continued lines
    glued together, so a comment inside a continuation vanishes and every instruction keeps the
    number of its first physical line. Linear in the text.
    """
    trimmed = F.transform(
        lines(text),
        lambda raw, i: F.struct((i + 1).alias("line"), strip(raw).alias("text")),
    )
    kept = F.filter(trimmed, lambda x: (x["text"] != "") & ~x["text"].startswith("#"))
    numbered = F.transform(kept, lambda x: F.concat(x["line"].cast("string"), F.lit(_MARK), x["text"]))
    joined = F.regexp_replace(F.array_join(numbered, "\n"), rf"(?:\s*\\\n[0-9]+{_MARK})+", " ")
    joined = F.regexp_replace(joined, r"\s*\\$", "")
    logical = F.split(joined, "\n")

    def parse(entry: Column, index: Column) -> Column:
        body = strip(F.substring_index(entry, _MARK, -1))
        return F.struct(
            index.cast("bigint").alias("seq"),
            F.upper(F.regexp_extract(body, r"^(\S+)", 1)).alias("keyword"),
            F.regexp_extract(body, r"(?s)^\S+\s+(.*)$", 1).alias("arguments"),
            F.substring_index(entry, _MARK, 1).try_cast("bigint").alias("line"),
        )

    return F.filter(F.transform(logical, parse), lambda x: x["arguments"] != "")


def _stage(entry: Column) -> Column:
    """Base image and alias of a ``FROM`` instruction's arguments."""
    words = F.split(F.regexp_replace(entry["arguments"], r"^(?:--\S*\s+)+", ""), r"\s+")
    alias = F.when(F.lower(F.get(words, F.lit(1))) == "as", F.lower(F.get(words, F.lit(2))))
    return F.struct(
        F.lower(F.get(words, F.lit(0))).alias("base"),
        F.coalesce(alias, F.lit("")).alias("alias"),
        entry["line"].alias("line"),
    )


def effective_user(steps: Column) -> Column:
    """``struct(name, line, from_line)`` of the user the final stage runs as; name NULL if unset.

    One backwards fold. ``wanted`` starts as the final stage and becomes its base image's alias
    whenever a stage without a user is left behind; stages can only be based on earlier ones, so a
    single pass over the reversed instructions resolves a chain of any length.
    """
    relevant = F.filter(steps, lambda s: s["keyword"].isin("FROM", "USER"))
    state = F.struct(
        F.lit(None).cast("string").alias("name"),
        F.lit(None).cast("bigint").alias("line"),
        F.lit(None).cast("bigint").alias("from_line"),
        F.lit(None).cast("string").alias("wanted"),
        F.lit(None).cast("string").alias("seen_user"),
        F.lit(None).cast("bigint").alias("seen_line"),
        F.lit(False).alias("done"),
    )

    def step(acc: Column, entry: Column) -> Column:
        is_from = entry["keyword"] == "FROM"
        stage = _stage(entry)
        first = acc["from_line"].isNull()
        chosen = is_from & ~acc["done"] & (first | (stage["alias"] == acc["wanted"]))
        found = chosen & acc["seen_user"].isNotNull()
        return F.struct(
            F.when(found, acc["seen_user"]).otherwise(acc["name"]).alias("name"),
            F.when(found, acc["seen_line"]).otherwise(acc["line"]).alias("line"),
            F.when(is_from & first, entry["line"]).otherwise(acc["from_line"]).alias("from_line"),
            F.when(chosen, stage["base"]).otherwise(acc["wanted"]).alias("wanted"),
            F.when(is_from, F.lit(None).cast("string"))
            .otherwise(F.coalesce(acc["seen_user"], strip(entry["arguments"])))
            .alias("seen_user"),
            F.when(is_from, F.lit(None).cast("bigint"))
            .otherwise(F.coalesce(acc["seen_line"], entry["line"]))
            .alias("seen_line"),
            (acc["done"] | found).alias("done"),
        )

    return F.aggregate(
        F.reverse(relevant),
        state,
        step,
        lambda acc: F.struct(
            acc["name"].alias("name"),
            acc["line"].alias("line"),
            acc["from_line"].alias("from_line"),
        ),
    )


def is_root(name: Column) -> Column:
    return F.regexp_replace(strip(F.substring_index(name, ":", 1)), r"^[\"']+|[\"']+$", "").isin(
        "root", "0"
    )


def assignments(arguments: Column) -> Column:
    """``array<struct<name, value>>`` of ENV/ARG arguments, modern or legacy form.

    A word is a run of unquoted text and quoted spans, an unclosed quote running to the end.
    """
    word = r"((?:\"[^\"]*(?:\"|$)|'[^']*(?:'|$)|[^\s\"'])+)"
    words = F.regexp_extract_all(arguments, F.lit(word), F.lit(1))
    legacy_value = F.regexp_extract(strip(arguments), r"(?s)^\S+\s+(.*)$", 1)
    pairs = F.transform(
        F.filter(words, lambda w: w.contains("=")),
        lambda w: F.struct(
            F.substring_index(w, "=", 1).alias("name"),
            unquote(strip(F.regexp_replace(w, r"(?s)^[^=]*=", ""))).alias("value"),
        ),
    )
    legacy = F.array(
        F.struct(F.get(words, F.lit(0)).alias("name"), unquote(strip(legacy_value)).alias("value"))
    )
    empty = F.array().cast("array<struct<name:string,value:string>>")
    return (
        F.when(F.size(words) == 0, empty)
        .when(F.get(words, F.lit(0)).contains("="), pairs)
        .when(legacy_value != "", legacy)
        .otherwise(empty)
    )


def _literals(path: Column, steps: Column) -> Column:
    settings = F.flatten(
        F.transform(
            F.filter(steps, lambda s: s["keyword"].isin("ENV", "ARG")),
            lambda s: F.transform(
                assignments(s["arguments"]),
                lambda a: F.struct(
                    s["keyword"].alias("keyword"),
                    s["line"].alias("line"),
                    a["name"].alias("name"),
                    a["value"].alias("value"),
                ),
            ),
        )
    )

    def judge(a: Column) -> Column:
        shown = F.concat(a["keyword"], F.lit(" "), a["name"], F.lit("="), a["value"])
        return F.when(
            cred.is_provider_key(a["value"]),
            finding(rulebook.IMAGE_PROVIDER_KEY, file=path, line=a["line"], snippet=shown),
        ).when(
            cred.is_credential_key(a["name"]) & cred.is_hardcoded_value(a["value"]),
            finding(
                rulebook.DEPLOYMENT_CREDENTIAL,
                file=path,
                line=a["line"],
                snippet=shown,
                severity=cred.credential_severity(a["value"]),
            ),
        )

    return F.array_compact(F.transform(settings, judge))


def _user(path: Column, text: Column, steps: Column) -> Column:
    def report(user: Column) -> Column:
        line = F.coalesce(user["from_line"], F.lit(1))
        unset = finding(rulebook.IMAGE_NO_USER, file=path, line=line, snippet=snippet(text, line))
        root = finding(
            rulebook.IMAGE_ROOT,
            file=path,
            line=user["line"],
            snippet=F.concat(F.lit("USER "), user["name"]),
        )
        return F.array_compact(
            F.array(F.when(user["name"].isNull(), unset).when(is_root(user["name"]), root))
        )

    return let(effective_user(steps), report)


def findings(path: Column, text: Column) -> Column:
    return let(
        instructions(text),
        lambda steps: F.when(F.size(steps) == 0, no_findings()).otherwise(
            F.concat(_user(path, text, steps), _literals(path, steps))
        ),
    )
