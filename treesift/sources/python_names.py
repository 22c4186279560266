"""Scopes, bindings and uses of Python names as rows; which binding a use meets is decided over these rows."""

from __future__ import annotations

import ast

from pyspark.sql import DataFrame

from treesift.sources.batches import rows_from_texts
from treesift.sources.python_facts import _File

NAMES = (
    "path string, kind string, scope int, scopes array<int>, name string, line int, col int,"
    " branches array<string>, ordinal int, value string"
)
_COLUMNS = ("kind", "scope", "scopes", "name", "line", "col", "branches", "ordinal", "value")


def _rows(text: str, wanted: frozenset[str] | None) -> list[tuple]:
    """:func:`names_of` as tuples in the order of the columns, for the ``wanted`` names only if they are given."""
    try:
        file = _File(text, frozenset())
    except (SyntaxError, ValueError, RecursionError):
        return []
    # Scopes and branching nodes are numbered by their identity, in the order they are met.
    number: dict[int, int] = {}
    chains: dict[tuple, list[str]] = {(): []}
    around: dict[ast.AST, list[int]] = {}

    def chain(branches: tuple) -> list[str]:
        chains[branches] = found = [f"{number.setdefault(place, len(number))}:{arm}" for place, arm in branches]
        return found

    def scopes(scope: ast.AST) -> list[int]:
        around[scope] = found = [number.setdefault(id(scope), len(number))]
        while scope is not file.tree:
            scope = file.outer[scope]
            found.append(number.setdefault(id(scope), len(number)))
        return found

    rows = []
    for scope, bindings in file.bindings.items():
        here = (around.get(scope) or scopes(scope))[0]
        for name, found in bindings.items():
            if wanted is None or name in wanted:
                if len(found) > 1:
                    found = sorted(found, key=lambda b: b[0])
                for k, ((line, col), branches, value) in enumerate(found):
                    arms = chains.get(branches) or chain(branches)
                    shown = file.text(value) if value is not None and hasattr(value, "lineno") else None
                    rows.append(("binding", here, None, name, line, col, arms, k + 1, shown))
        if scope is not file.tree:
            for name in file.parameters(scope):
                if wanted is None or name in wanted:
                    rows.append(("parameter", here, None, name, None, None, None, None, None))
    for node, (_, _, scope, branches) in zip(file.nodes, file.places, strict=True):
        if type(node) is ast.Name and (wanted is None or node.id in wanted) and type(node.ctx) is ast.Load:
            places = around.get(scope) or scopes(scope)
            arms = chains.get(branches) or chain(branches)
            rows.append(("use", places[0], places, node.id, node.lineno, node.col_offset, arms, None, None))
    return rows


def names_of(text: str) -> list[dict]:
    """Rows of one text; none if it does not parse.

    ``binding``: where it ends, the branches it stands in, its ``ordinal`` among the bindings of its scope and
    name in order of their ends, and its value's text. ``parameter``: a scope's parameter. ``use``: a name that
    is read, with its scope and those around it from the inside out.
    """
    return [dict(zip(_COLUMNS, row, strict=True)) for row in _rows(text, None)]


def names(files: DataFrame, tasks: int | None = None, wanted: tuple[str, ...] | None = None) -> DataFrame:
    """Rows of all files (columns ``path`` and ``text``), or those of the ``wanted`` names; a file's follow one another."""
    asked = None if wanted is None else frozenset(wanted)
    return rows_from_texts(files, lambda text: _rows(text, asked), NAMES, tasks, in_order=True)
