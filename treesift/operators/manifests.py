"""Dependency manifests as rows: exact pins, ranges, and where each one is declared."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from treesift import rulebook
from treesift.functions.documents import is_string, member
from treesift.functions.paths import file_name
from treesift.functions.text import find_from, let, line_at, lines, locate_line, snippet, strip
from treesift.functions.versions import exact_pin, is_agent_package, is_unbounded
from treesift.model import finding

# One shape for both outcomes: ``version`` is NULL when the declaration is a range.
DEPENDENCY = (
    "struct<name:string,version:string,constraint:string,ecosystem:string,file:string,line:bigint,"
    "declaration:string,dev:boolean>"
)


def _dependency(
    path: Column,
    name: Column,
    version: Column,
    constraint: Column,
    ecosystem: str,
    line: Column,
    declaration: Column,
    dev: bool = False,
) -> Column:
    return F.struct(
        name.alias("name"),
        version.alias("version"),
        constraint.alias("constraint"),
        F.lit(ecosystem).alias("ecosystem"),
        path.alias("file"),
        line.cast("bigint").alias("line"),
        declaration.alias("declaration"),
        F.lit(dev).alias("dev"),
    )


def requirement(spec: Column) -> Column:
    """``struct(name, version, constraint)`` of one requirement, or NULL when it names nothing.

    Markers after ``;`` and extras in brackets are dropped. Only a lone ``==`` without a comma or
    a wildcard is a pin; no constraint at all reads as ``*``.
    """

    def read(body: Column) -> Column:
        name = F.regexp_extract(body, r"^([^\[=<>!~\s]+)", 1)
        rest = strip(F.regexp_replace(body, r"^[^\[=<>!~\s]+", ""))
        rest = F.when(
            rest.startswith("["),
            F.when(rest.contains("]"), strip(F.regexp_replace(rest, r"^[^\]]*\]", ""))).otherwise(
                F.lit("")
            ),
        ).otherwise(rest)
        pinned = strip(F.regexp_extract(rest, r"^==(.*)$", 1))
        is_pin = (pinned != "") & ~pinned.rlike(r"[,*]")
        return F.when(
            name != "",
            F.struct(
                name.alias("name"),
                F.when(is_pin, pinned).alias("version"),
                F.when(rest == "", F.lit("*")).otherwise(rest).alias("constraint"),
            ),
        )

    return let(strip(F.substring_index(spec, ";", 1)), read)


def requirements_txt(path: Column, text: Column) -> Column:
    def read(raw: Column, index: Column) -> Column:
        return let(strip(F.substring_index(raw, "#", 1)), lambda line: parsed(line, index))

    def parsed(line: Column, index: Column) -> Column:
        skipped = (line == "") | line.startswith("-") | line.contains("://")
        return F.when(
            ~skipped,
            let(
                requirement(line),
                lambda r: F.when(
                    r.isNotNull(),
                    _dependency(
                        path, r["name"], r["version"], r["constraint"], "PyPI", index + 1, line
                    ),
                ),
            ),
        )

    return F.array_compact(F.transform(lines(text), read))


def _toml_key_line(text: Column, section: str, key: Column) -> Column:
    """Line of a key at or after its section header; the header's own line as a fallback."""
    start = F.greatest(find_from(F.lit(f"[{section}]"), text, 1), F.lit(1))
    quoted = F.concat(F.lit('"'), key, F.lit('"'))
    offsets = [
        find_from(F.concat(form, F.lit(sign)), text, start)
        for form in (key, quoted)
        for sign in (" =", "=")
    ]
    found = F.coalesce(*[F.when(offset > 0, offset) for offset in offsets], start)
    return line_at(text, found)


def _json_key_line(text: Column, section: str, key: Column) -> Column:
    start = F.greatest(find_from(F.lit(f'"{section}"'), text, 1), F.lit(1))
    marker = F.concat(F.lit('"'), key, F.lit('"'))
    offset = find_from(marker, text, start)
    return F.when(offset > 0, line_at(text, offset)).otherwise(locate_line(text, marker))


def _version_text(value: Column) -> Column:
    """A version given as text, or as the ``version`` member of a table."""
    nested = member(value, "$.version", "variant")
    return F.when(is_string(value), F.try_variant_get(value, "$", "string")).when(
        is_string(nested), F.try_variant_get(nested, "$", "string")
    )


def _table(
    path: Column, text: Column, table: Column, ecosystem: str, where, dev: bool = False, text_only=False
) -> Column:
    def read(entry: Column) -> Column:
        spec = (
            F.when(is_string(entry["value"]), F.try_variant_get(entry["value"], "$", "string"))
            if text_only
            else _version_text(entry["value"])
        )
        return let(spec, lambda version: located(entry["key"], version))

    def located(name: Column, version: Column) -> Column:
        return F.when(
            version.isNotNull(),
            let(
                where(name),
                lambda line: _dependency(
                    path,
                    name,
                    exact_pin(version),
                    version,
                    ecosystem,
                    line,
                    snippet(text, line),
                    dev,
                ),
            ),
        )

    return F.coalesce(
        F.array_compact(F.transform(F.map_entries(table), read)), F.array().cast(f"array<{DEPENDENCY}>")
    )


def pyproject(path: Column, text: Column, document: Column) -> Column:
    listed = F.filter(member(document, "$.project.dependencies", "array<variant>"), is_string)

    def read(value: Column) -> Column:
        return let(F.try_variant_get(value, "$", "string"), parsed)

    def parsed(spec: Column) -> Column:
        return F.when(
            requirement(spec).isNotNull(),
            let(
                locate_line(text, spec),
                lambda line: let(
                    requirement(spec),
                    lambda r: _dependency(
                        path,
                        r["name"],
                        r["version"],
                        r["constraint"],
                        "PyPI",
                        line,
                        snippet(text, line),
                    ),
                ),
            ),
        )

    section = "tool.poetry.dependencies"
    poetry = F.map_filter(
        member(document, f"$.{section}", "map<string,variant>"), lambda k, _: k != "python"
    )
    return F.concat(
        F.coalesce(
            F.array_compact(F.transform(listed, read)), F.array().cast(f"array<{DEPENDENCY}>")
        ),
        _table(path, text, poetry, "PyPI", lambda name: _toml_key_line(text, section, name)),
    )


def cargo(path: Column, text: Column, document: Column) -> Column:
    table = member(document, "$.dependencies", "map<string,variant>")
    return _table(
        path, text, table, "crates.io", lambda name: _toml_key_line(text, "dependencies", name)
    )


def package_json(path: Column, text: Column, document: Column) -> Column:
    def section(name: str, dev: bool) -> Column:
        table = member(document, f"$.{name}", "map<string,variant>")
        return _table(
            path, text, table, "npm", lambda key: _json_key_line(text, name, key), dev, text_only=True
        )

    return F.concat(section("dependencies", False), section("devDependencies", True))


def dependencies(path: Column, text: Column, document: Column) -> Column:
    """Declared dependencies of any manifest; ``document`` is its canonical JSON as a variant."""
    name = file_name(path)
    return (
        F.when(name == "requirements.txt", requirements_txt(path, text))
        .when(name == "pyproject.toml", pyproject(path, text, document))
        .when(name == "Cargo.toml", cargo(path, text, document))
        .when(name == "package.json", package_json(path, text, document))
        .otherwise(F.array().cast(f"array<{DEPENDENCY}>"))
    )


def unbounded_agent_finding(dependency: Column) -> Column:
    """The finding of one range on an agent package without an upper bound, or NULL."""
    name, constraint = dependency["name"], dependency["constraint"]
    return F.when(
        dependency["version"].isNull()
        & ~dependency["dev"]
        & is_agent_package(name)
        & is_unbounded(constraint),
        finding(
            rulebook.UNBOUNDED_AGENT_PIN,
            file=dependency["file"],
            line=dependency["line"],
            title=F.format_string("`%s` has no upper-bounded version pin", name),
            snippet=F.concat(name, constraint),
        ),
    )


def unpinned_skip_line(dependency: Column) -> Column:
    """The coverage note of one range."""
    return F.format_string(
        "%s:%d — %s %s is not pinned, so CVEs were not checked",
        dependency["file"],
        dependency["line"],
        dependency["name"],
        dependency["constraint"],
    )
