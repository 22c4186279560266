"""Compose files: what each service is allowed to reach, and the credentials it is given."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from treesift import rulebook
from treesift.functions import credentials as cred
from treesift.functions.documents import is_string, member
from treesift.functions.text import let, locate_line_after, snippet, strip
from treesift.model import finding, no_findings, only_if

DOCKER_SOCKET = "/var/run/docker.sock"


def services(document: Column) -> Column:
    """``array<struct<key, value>>`` of service names and definitions, in name order."""
    entries = F.map_entries(member(document, "$.services", "map<string,variant>"))
    return F.coalesce(
        F.array_sort(
            F.transform(
                entries,
                lambda e: F.struct(e["key"].alias("key"), F.to_json(e["value"]).alias("json")),
            )
        ),
        F.array().cast("array<struct<key:string,json:string>>"),
    )


def socket_mounts(service: Column) -> Column:
    """How many volumes, short or long form, mount the daemon's socket."""
    volumes = F.coalesce(
        member(service, "$.volumes", "array<variant>"), F.array().cast("array<variant>")
    )

    def source(volume: Column) -> Column:
        short = F.substring_index(F.try_variant_get(volume, "$", "string"), ":", 1)
        return strip(F.when(is_string(volume), short).otherwise(member(volume, "$.source")))

    return F.size(F.filter(volumes, lambda v: F.coalesce(source(v) == DOCKER_SOCKET, F.lit(False))))


def environment(service: Column) -> Column:
    """``array<struct<name, value>>`` from the mapping or the list form; string values only."""
    pair = "struct<name:string,value:string>"
    mapping = F.map_entries(member(service, "$.environment", "map<string,variant>"))
    from_mapping = F.transform(
        F.filter(mapping, lambda e: is_string(e["value"])),
        lambda e: F.struct(
            e["key"].alias("name"), F.try_variant_get(e["value"], "$", "string").alias("value")
        ),
    )
    items = F.filter(member(service, "$.environment", "array<variant>"), is_string)
    texts = F.transform(items, lambda v: F.try_variant_get(v, "$", "string"))
    from_list = F.transform(
        F.filter(texts, lambda t: t.contains("=")),
        lambda t: F.struct(
            F.substring_index(t, "=", 1).alias("name"),
            F.regexp_replace(t, r"(?s)^[^=]*=", "").alias("value"),
        ),
    )
    return F.coalesce(from_mapping, from_list, F.array().cast(f"array<{pair}>"))


def findings(path: Column, text: Column, document: Column) -> Column:
    """All service findings of one file; ``document`` is its canonical JSON as a variant."""

    def of_service(entry: Column) -> Column:
        return let(F.try_parse_json(entry["json"]), lambda service: of_parsed(entry, service))

    def of_parsed(entry: Column, service: Column) -> Column:
        anchor = F.concat(entry["key"], F.lit(":"))

        def at(rule, needle: Column | str, **extra: Column) -> Column:
            return let(
                locate_line_after(text, anchor, needle),
                lambda line: finding(
                    rule, file=path, line=line, snippet=snippet(text, line), **extra
                ),
            )

        def exactly_host(name: str) -> Column:
            value = F.try_variant_get(service, f"$.{name}", "string")
            return F.coalesce(strip(value) == "host", F.lit(False))

        privileged = F.coalesce(member(service, "$.privileged") == "true", F.lit(False))
        credentials = F.filter(
            environment(service),
            lambda e: cred.is_credential_key(e["name"]) & cred.is_hardcoded_value(e["value"]),
        )
        return F.concat(
            F.array_repeat(at(rulebook.SOCKET_MOUNT, DOCKER_SOCKET), socket_mounts(service)),
            only_if(privileged, at(rulebook.PRIVILEGED, "privileged")),
            only_if(exactly_host("network_mode"), at(rulebook.HOST_NETWORK, "network_mode")),
            only_if(exactly_host("pid"), at(rulebook.HOST_PID, "pid")),
            F.transform(
                credentials,
                lambda e: at(
                    rulebook.DEPLOYMENT_CREDENTIAL,
                    e["name"],
                    severity=cred.credential_severity(e["value"]),
                ),
            ),
        )

    return F.coalesce(F.flatten(F.transform(services(document), of_service)), no_findings())
