"""Queries over the given tables, each paired with plain SQL that must give the same rows."""

from importlib import import_module

MODULES = ("texts", "judgements", "files", "packages", "reports", "code", "pipeline")


def all_checks():
    """All registered queries and all SQL counterparts."""
    from treesift.checks import registry

    for module in MODULES:
        import_module(f"treesift.checks.{module}")
    return registry.QUERIES, registry.ORACLE
