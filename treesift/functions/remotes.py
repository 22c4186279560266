"""Repository remotes in one spelling, and the identifier hashed from them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from treesift.functions.text import strip

REMOTE_PREFIX = "project-v1:"


def _split(raw: Column) -> tuple[Column, Column]:
    """Host and path of a URL or scp-style remote; NULL host when it is neither."""
    url = r"^(?i:https?|ssh|git)://(?:[^/]*@)?([^/:@]*)(?::[0-9]+)?/(.*)$"
    scp = r"^(?:[^/:]*@)?([^/:@]{2,}):/?(.*)$"
    is_url = raw.rlike(url)
    is_scp = ~raw.contains("://") & ~raw.rlike(r"^[/.\\~]") & raw.rlike(scp)
    host = F.when(is_url, F.regexp_extract(raw, url, 1)).when(is_scp, F.regexp_extract(raw, scp, 1))
    path = F.when(is_url, F.regexp_extract(raw, url, 2)).when(is_scp, F.regexp_extract(raw, scp, 2))
    return host, path


def normalise(remote: Column) -> Column:
    """``host/owner/repo`` in lower case, or NULL for anything that is not a known forge."""
    raw = strip(remote)
    host, path = _split(raw)
    host = F.regexp_replace(F.lower(host), r"^www\.", "")
    path = F.lower(F.regexp_replace(path, r"[?#].*$", ""))
    path = F.regexp_replace(F.regexp_replace(path, r"/+$", ""), r"\.git$", "")
    parts = F.split(path, "/")
    clean = (
        (raw != "")
        & ~raw.rlike(r"[\s\p{Cntrl}%]")
        & host.rlike(r"^[a-z0-9.-]+$")
        & ~F.exists(parts, lambda p: p.isin("", ".", "..") | p.contains("\\"))
    )
    size = F.size(parts)

    def at(index: int) -> Column:
        return F.get(parts, F.lit(index))

    def azure(org: Column, project: Column, repo: Column) -> Column:
        return F.concat_ws("/", F.lit("dev.azure.com"), org, project, repo)

    dash = F.array_position(parts, "-")
    kept = F.when(dash > 0, F.slice(parts, F.lit(1), (dash - 1).cast("int"))).otherwise(parts)
    legacy_org = F.regexp_extract(host, r"^([^.]+)\.visualstudio\.com$", 1)
    name = (
        F.when(
            host.isin("github.com", "bitbucket.org"),
            F.when(size == 2, F.concat_ws("/", host, path)),
        )
        .when(
            host == "gitlab.com",
            F.when(F.size(kept) >= 2, F.concat_ws("/", host, F.array_join(kept, "/"))),
        )
        .when(
            host == "dev.azure.com",
            F.when((size == 4) & (at(2) == "_git"), azure(at(0), at(1), at(3))),
        )
        .when(
            host.isin("ssh.dev.azure.com", "vs-ssh.visualstudio.com"),
            F.when((size == 4) & (at(0) == "v3"), azure(at(1), at(2), at(3))),
        )
        .when(
            legacy_org != "",
            F.when((size == 3) & (at(1) == "_git"), azure(legacy_org, at(0), at(2))).when(
                (size == 4) & (at(0) == "defaultcollection") & (at(2) == "_git"),
                azure(legacy_org, at(1), at(3)),
            ),
        )
    )
    return F.when(clean, name)


def ci_remote(host: Column, path: Column, exact_segments: int | None) -> Column:
    """A remote from continuous-integration variables: a bare host and a project path."""
    bare = F.regexp_replace(F.lower(host), r":[0-9]+$", "")
    parts = F.split(path, "/")
    count = F.size(parts) == exact_segments if exact_segments else F.size(parts) >= 2
    ok = (
        bare.rlike(r"^[a-z0-9.-]+$")
        & ~path.rlike(r"[\s\p{Cntrl}%]")
        & ~F.exists(parts, lambda p: p.isin("", ".", "..") | p.contains("\\"))
        & count
    )
    return F.when(ok, F.lower(F.concat_ws("/", bare, path)))


def project_id(normalised: Column, prefix: str = REMOTE_PREFIX) -> Column:
    return F.sha2(F.concat(F.lit(prefix), normalised), 256)
