"""Tool-server configurations: one normal form for JSON, YAML and TOML, then column checks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from treesift import rulebook
from treesift.functions import credentials as cred
from treesift.functions.documents import is_string, member
from treesift.functions.text import let, locate_line, snippet, strip
from treesift.model import finding, no_findings, only_if

# Launchers that resolve a package at start-up, with the registry they ask.
LAUNCHERS = {"npx": "npm", "uvx": "PyPI", "pnpx": "npm", "bunx": "npm"}
AUTH_MARKERS = ("auth", "token", "bearer", "key", "secret")
GRANT_FIELDS = ("tools", "permissions", "allowedTools")
APPROVE_FIELDS = ("autoApprove", "alwaysAllow")

SERVER = (
    "struct<name:string,command:string,args:array<string>,env:array<struct<key:string,value:string>>,"
    "url:string,header_keys:array<string>,grant_field:string,approve_field:string>"
)


def grants_wildcard(value: Column) -> Column:
    items = F.transform(
        F.filter(F.try_variant_get(value, "$", "array<variant>"), is_string),
        lambda v: F.try_variant_get(v, "$", "string"),
    )
    text = F.when(is_string(value), F.try_variant_get(value, "$", "string"))
    return F.coalesce(text == "*", F.array_contains(items, "*"), F.lit(False))


def approves_everything(value: Column) -> Column:
    boolean = F.when(
        F.schema_of_variant(value) == "BOOLEAN", F.try_variant_get(value, "$", "boolean")
    )
    return F.coalesce(boolean, F.coalesce(~is_string(value), F.lit(False)) & grants_wildcard(value))


def _first_field(document: Column, fields: tuple[str, ...], test) -> Column:
    expr = F.lit(None).cast("string")
    for field in reversed(fields):
        expr = F.when(test(member(document, f"$.{field}", "variant")), F.lit(field)).otherwise(expr)
    return expr


def servers(document: Column) -> Column:
    """``array<server>`` in name order; unknown members are ignored."""
    by_name = F.coalesce(
        member(document, "$.mcpServers", "map<string,variant>"),
        member(document, "$.servers", "map<string,variant>"),
    )

    def normal(entry: Column) -> Column:
        server = entry["value"]
        env = F.map_entries(member(server, "$.env", "map<string,variant>"))
        return F.struct(
            entry["key"].alias("name"),
            member(server, "$.command").alias("command"),
            F.coalesce(
                member(server, "$.args", "array<string>"), F.array().cast("array<string>")
            ).alias("args"),
            F.coalesce(
                F.array_sort(
                    F.transform(
                        F.filter(env, lambda e: is_string(e["value"])),
                        lambda e: F.struct(
                            e["key"].alias("key"),
                            F.try_variant_get(e["value"], "$", "string").alias("value"),
                        ),
                    )
                ),
                F.array().cast("array<struct<key:string,value:string>>"),
            ).alias("env"),
            member(server, "$.url").alias("url"),
            F.coalesce(
                F.map_keys(member(server, "$.headers", "map<string,variant>")),
                F.array().cast("array<string>"),
            ).alias("header_keys"),
            _first_field(server, GRANT_FIELDS, grants_wildcard).alias("grant_field"),
            _first_field(server, APPROVE_FIELDS, approves_everything).alias("approve_field"),
        )

    return F.coalesce(
        F.array_sort(F.transform(F.map_entries(by_name), normal)),
        F.array().cast(f"array<{SERVER}>"),
    )


def is_broad_path(argument: Column) -> Column:
    a = strip(argument)
    return a.isin("/", "~", "~/") | a.contains("$HOME") | a.rlike(r"^/(home|Users)/[^/]+/?$")


def is_localhost(url: Column) -> Column:
    host = F.regexp_extract(url, r"^(?:https?://)?([^/:]*)", 1)
    return (F.lower(host) == "localhost") | (host == "127.0.0.1")


def has_auth_header(header_keys: Column) -> Column:
    markers = "|".join(AUTH_MARKERS)
    return F.exists(header_keys, lambda k: F.lower(k).rlike(markers))


def launched_package(server: Column) -> Column:
    """``struct(registry, package)`` of a resolving launcher, or NULL."""
    launcher = F.lower(F.regexp_extract(server["command"], r"([^/\\]*)$", 1))
    registry = F.lit(None).cast("string")
    for name, where in LAUNCHERS.items():
        registry = F.when(launcher == name, F.lit(where)).otherwise(registry)
    package = F.get(F.filter(server["args"], lambda a: ~a.startswith("-")), F.lit(0))
    return F.when(
        registry.isNotNull() & package.isNotNull(),
        F.struct(registry.alias("registry"), package.alias("package")),
    )


def is_pinned(package: Column) -> Column:
    return F.regexp_replace(package, "^@", "").contains("@")


def split_pin(package: Column) -> Column:
    """``struct(name, version)`` of ``name@version``; a leading scope sign belongs to the name."""
    pattern = r"^(.+)@([^@]+)$"
    return F.when(
        package.rlike(pattern),
        F.struct(
            F.regexp_extract(package, pattern, 1).alias("name"),
            F.regexp_extract(package, pattern, 2).alias("version"),
        ),
    )


def dependencies(path: Column, text: Column, document: Column) -> Column:
    """``array<struct>`` of pinned packages the servers launch."""

    def of_server(server: Column) -> Column:
        launched = launched_package(server)
        pin = split_pin(launched["package"])
        return F.when(
            pin.isNotNull(),
            let(
                locate_line(text, launched["package"]),
                lambda line: F.struct(
                    pin["name"].alias("name"),
                    pin["version"].alias("version"),
                    launched["registry"].alias("ecosystem"),
                    path.alias("file"),
                    line.alias("line"),
                    snippet(text, line).alias("declaration"),
                ),
            ),
        )

    return F.array_compact(F.transform(servers(document), of_server))


def findings(path: Column, text: Column, document: Column) -> Column:
    """All findings of one configuration; an unparseable one is itself a finding."""

    def at(rule, needle: Column | str, **extra: Column) -> Column:
        return let(
            locate_line(text, needle),
            lambda line: finding(rule, file=path, line=line, snippet=snippet(text, line), **extra),
        )

    def of_server(server: Column) -> Column:
        broad = F.get(F.filter(server["args"], is_broad_path), F.lit(0))
        url = server["url"]
        plain = F.coalesce(F.lower(url).startswith("http://"), F.lit(False))
        open_http = plain & ~has_auth_header(server["header_keys"])
        launched = launched_package(server)
        unpinned = F.coalesce(~is_pinned(launched["package"]), F.lit(False))
        secrets = F.filter(server["env"], lambda e: cred.is_plausible_secret(e["key"], e["value"]))
        return F.concat(
            only_if(broad.isNotNull(), at(rulebook.MCP_FILESYSTEM, broad)),
            only_if(open_http & is_localhost(url), at(rulebook.MCP_LOCAL_HTTP, url)),
            only_if(open_http & ~is_localhost(url), at(rulebook.MCP_PLAIN_HTTP, url)),
            only_if(server["grant_field"].isNotNull(), at(rulebook.MCP_WILDCARD, "*")),
            F.transform(secrets, lambda e: at(rulebook.MCP_CREDENTIAL, e["value"])),
            only_if(
                unpinned,
                at(
                    rulebook.MCP_UNPINNED,
                    launched["package"],
                    title=F.format_string(
                        "MCP server '%s' is launched without a version pin", server["name"]
                    ),
                ),
            ),
            only_if(
                server["approve_field"].isNotNull(),
                at(rulebook.MCP_SERVER_APPROVE, server["approve_field"]),
            ),
        )

    everywhere = _first_field(document, APPROVE_FIELDS, approves_everything)
    checked = F.concat(
        only_if(everywhere.isNotNull(), at(rulebook.MCP_GLOBAL_APPROVE, everywhere)),
        F.coalesce(F.flatten(F.transform(servers(document), of_server)), no_findings()),
    )
    malformed = F.array(finding(rulebook.MCP_MALFORMED, file=path, snippet=snippet(text, 1)))
    return F.when(document.isNull(), malformed).otherwise(checked)
