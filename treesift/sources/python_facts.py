"""Python source texts as fact rows: calls, literals, assignments, functions, imports, returns.

A small syntax helper: it knows Python's grammar and scoping and nothing about security. For the
calls it is asked about, every argument carries its *slice*: the leaves its value is built from,
each with the chain of calls, attributes and subscripts between the leaf and the argument. What a
leaf means (closed, quoted, a source, a sink) is decided by column expressions over these rows.
"""

from __future__ import annotations

import ast
import re
import sys
from collections.abc import Collection, Iterator, Mapping
from functools import cached_property
from typing import get_args

from pyspark.sql import DataFrame

from treesift.sources.batches import rows_from_texts

ATOM = "struct<kind:string,name:string,via:array<string>>"
GUARD = f"struct<name:string,atoms:array<{ATOM}>,conflict:boolean>"
ARGUMENT = (
    "struct<name:string,text:string,kind:string,quote:string,content:string,callee:string,"
    f"atoms:array<{ATOM}>,conflict:boolean,names:array<string>,guards:array<{GUARD}>,"
    "parameter:string,bare:boolean>"
)
STATEMENT = (
    "struct<kind:string,target:string,value:string,quote:string,callee:string,first:string,arity:int>"
)
FACTS = (
    "path string, fact string, line bigint, col bigint, name string, text string, quote string,"
    f" callee string, receiver string, args array<{ARGUMENT}>, fn string, fn_decorators array<string>,"
    " fn_params array<string>, fn_unique boolean, local boolean, shadowed boolean,"
    f" outer array<array<string>>, statements array<{STATEMENT}>, keywords array<string>,"
    " messages array<string>, snippet string, start_line bigint, start_col bigint, start_snippet string"
)
_STRING = re.compile(
    r"(?s)([A-Za-z]*)(\"\"\"|'''|\"|')((?:[^\\]|\\.)*?)\2$"
)
_RECURSION = 1_000_000
# A path of steps this long ends in an unknown leaf: paths grow with the square of the depth.
MAX_DEPTH = 64
_SCOPES = (ast.FunctionDef, ast.AsyncFunctionDef, ast.Lambda)
_FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)
# The fact each kind of node gives, if any.
_FACT = {
    ast.Call: "call",
    ast.Constant: "string",
    ast.Assign: "assign",
    ast.AugAssign: "augassign",
    ast.Return: "return",
    ast.ImportFrom: "import",
    ast.FunctionDef: "function",
    ast.AsyncFunctionDef: "function",
}
_BRANCHING = (ast.If, ast.While, ast.For, ast.AsyncFor, ast.Try, ast.TryStar, ast.ExceptHandler, ast.match_case)
_NOT_BRANCHES = ("test", "iter", "target")
_BINDING = (ast.Assign, ast.AnnAssign, ast.AugAssign, ast.For, ast.AsyncFor, ast.ExceptHandler, ast.withitem)


def _below(kind: type) -> Iterator[type]:
    yield kind
    for further in kind.__subclasses__():
        yield from _below(further)


def _node_fields(kind: type) -> tuple[tuple[str, bool], ...]:
    """The fields of a kind of node that hold nodes with a place of their own, and whether they are lists with gaps.

    Contexts and operators are shared objects without a place; the other fields hold plain values.
    """

    def holds(declared) -> bool:
        if get_args(declared):
            return any(map(holds, get_args(declared)))
        placed = isinstance(declared, type) and issubclass(declared, ast.AST)
        return placed and any(k._fields for k in _below(declared))

    return tuple((f, f in ("keys", "kw_defaults")) for f in kind._fields if holds(kind._field_types[f]))


class _Kinds(dict):
    """By kind of node: its fields, and whether it is a scope, branches, or binds. Found when first met."""

    def __missing__(self, kind: type) -> tuple:
        found = _node_fields(kind), *(issubclass(kind, of) for of in (_SCOPES, _BRANCHING, _BINDING))
        self[kind] = found
        return found


_KINDS = _Kinds()


_REBINDING = (ast.Name, *_FUNCTIONS, ast.ClassDef, ast.ExceptHandler, ast.Import, ast.ImportFrom, ast.arg)


def _walk(node: ast.AST) -> list[ast.AST]:
    """The node and all below it that have a place of their own."""
    found = [node]
    for above in found:
        for field, gaps in _KINDS[type(above)][0]:
            value = getattr(above, field)
            if type(value) is list:
                found += [child for child in value if child is not None] if gaps else value
            elif value is not None:
                found.append(value)
    return found


class _File:
    """One parsed text: parents, positions, scopes, bindings, and slices on demand."""

    def __init__(self, text: str, sinks: frozenset[str]):
        # A byte-order mark is no Python, but it is a column of the first line.
        self.mark = int(text.startswith("\ufeff"))
        text = text[self.mark :]
        self.tree = _parsed(text)
        self.source = text
        self.sinks = sinks
        self.bindings: dict[ast.AST, dict[str, list[tuple]]] = {self.tree: {}}
        self.outer: dict[ast.AST, ast.AST] = {}
        self.functions: dict[str, int] = {}
        self.memo: dict[ast.AST, tuple] = {}
        self.cut = False
        self.disturbances: dict[ast.AST, tuple[set[str], set[str]]] = {}
        self.rebinders: dict[str, list[ast.AST]] | None = None
        self.described: dict[ast.AST, dict] = {}
        self.leaving: dict[tuple, list[tuple]] = {}
        # Every node with its place: the node above, the field there, the scope, the branches. Nodes of a field share one.
        self.nodes: list[ast.AST] = [self.tree]
        self.places: list[tuple] = [(None, None, self.tree, ())]
        binding = []
        for node, place in zip(self.nodes, self.places, strict=True):
            fields, opens, branching, binds = _KINDS[type(node)]
            if not fields:
                continue
            around = place[2]
            outside = () if opens else place[3]
            for field, gaps in fields:
                value = getattr(node, field)
                if not value:
                    continue
                # Defaults and decorators are evaluated outside the scope they belong to.
                scope = node if opens and field in ("body", "args") else around
                chain = (*outside, (id(node), field)) if branching and field not in _NOT_BRANCHES else outside
                below = (node, field, scope, chain)
                if type(value) is list:
                    children = [child for child in value if child is not None] if gaps else value
                    self.nodes += children
                    self.places += [below] * len(children)
                else:
                    self.nodes.append(value)
                    self.places.append(below)
            if opens:
                self.bindings[node] = {}
                self.outer[node] = around
                if isinstance(node, _FUNCTIONS):
                    self.functions[node.name] = self.functions.get(node.name, 0) + 1
            elif binds:
                binding.append((node, around, place[3]))
        for found in binding:
            self._bind(*found)

    @cached_property
    def place(self) -> dict[ast.AST, tuple]:
        return dict(zip(self.nodes, self.places, strict=True))

    @cached_property
    def rows(self) -> list[bytes]:
        """The lines as bytes, in which the parser counts columns."""
        return [*self.source.encode().splitlines(keepends=True), b""]

    @cached_property
    def lines(self) -> list[str] | None:
        """The lines as texts if a byte is a character in all of them."""
        return [row.decode() for row in self.rows] if self.source.isascii() else None

    # -- positions and texts -------------------------------------------------------------------
    def text(self, node: ast.AST) -> str:
        first, last = node.lineno - 1, node.end_lineno - 1
        if first == last:
            if self.lines is not None:
                return self.lines[first][node.col_offset : node.end_col_offset]
            return self.rows[first][node.col_offset : node.end_col_offset].decode()
        parts = [self.rows[first][node.col_offset :], *self.rows[first + 1 : last]]
        return b"".join([*parts, self.rows[last][: node.end_col_offset]]).decode()

    def position(self, node: ast.AST) -> tuple[int, int]:
        mark = self.mark if node.lineno == 1 else 0
        if self.lines is not None:
            return node.lineno, mark + node.col_offset + 1
        return node.lineno, mark + len(self.rows[node.lineno - 1][: node.col_offset].decode()) + 1

    def line_text(self, line: int) -> str:
        return (self.rows[line - 1].decode() if self.lines is None else self.lines[line - 1]).strip()

    # -- scopes --------------------------------------------------------------------------------
    def ancestors(self, node: ast.AST) -> Iterator[ast.AST]:
        while (node := self.place[node][0]) is not None:
            yield node

    def scope(self, node: ast.AST) -> ast.AST:
        return self.place[node][2]

    def branches(self, node: ast.AST) -> tuple:
        """The branches a node stands in within its function, from the outside in."""
        return self.place[node][3]

    def _add(self, target: ast.AST, value: ast.AST | None, at: ast.AST, scope: ast.AST, chain: tuple) -> None:
        if isinstance(target, ast.Name):
            end = (at.end_lineno, at.end_col_offset)
            self.bindings[scope].setdefault(target.id, []).append((end, chain, value))
        elif isinstance(target, (ast.Tuple, ast.List)):
            for item in target.elts:
                self._add(item, None, at, scope, chain)
        elif isinstance(target, ast.Starred):
            self._add(target.value, None, at, scope, chain)

    def _bind(self, node: ast.AST, scope: ast.AST, chain: tuple) -> None:
        """What a node binds in its scope; what it binds to stands in the node's own branches."""
        if isinstance(node, ast.Assign):
            for target in node.targets:
                self._add(target, node.value, node, scope, chain)
        elif isinstance(node, ast.AnnAssign) and node.value is not None:
            self._add(node.target, node.value, node, scope, chain)
        elif isinstance(node, ast.AugAssign):
            self._add(node.target, None, node, scope, chain)
        elif isinstance(node, (ast.For, ast.AsyncFor)):
            self._add(node.target, node.iter, node.iter, scope, chain)
        elif isinstance(node, ast.ExceptHandler) and node.name is not None:
            place = node.type or node
            end = (place.end_lineno, place.end_col_offset)
            self.bindings[scope].setdefault(node.name, []).append((end, (*chain, (id(node), "body")), node.type))
        elif isinstance(node, ast.withitem) and node.optional_vars is not None:
            self._add(node.optional_vars, node.context_expr, node.context_expr, scope, chain)

    @staticmethod
    def parameters(function: ast.AST) -> list[str]:
        a = function.args
        rest = [x for x in (a.vararg, a.kwarg) if x is not None]
        return [x.arg for x in [*a.posonlyargs, *a.args, *a.kwonlyargs, *rest]]

    # -- slices --------------------------------------------------------------------------------
    def callee(self, node: ast.AST) -> str:
        """Dotted path of a callee, subscripts and calls collapsed."""
        if isinstance(node, ast.Name):
            return node.id
        if isinstance(node, ast.Attribute):
            inner = self.callee(node.value)
            return f"{inner}.{node.attr}" if inner else node.attr
        if isinstance(node, (ast.Subscript, ast.Await)):
            return self.callee(node.value)
        if isinstance(node, ast.Call):
            return self.callee(node.func)
        return ""

    def slice(self, node: ast.AST | None, depth: int = 0, seen: frozenset = frozenset()):
        """``(atoms, conflict)``: the leaves a value is built from."""
        if node is None or depth > MAX_DEPTH or node in seen:
            self.cut = self.cut or depth > MAX_DEPTH
            return frozenset({("unknown", "", ())}), False
        if node in self.memo:
            return self.memo[node]
        before, self.cut = self.cut, False
        found = self._slice(node, depth, seen | {node})
        if not self.cut:  # what was cut short here may be whole from a nearer place
            self.memo[node] = found
        self.cut = self.cut or before
        return found

    def _slice(self, node: ast.AST, depth: int, seen: frozenset):
        literal, unknown = ("literal", "", ()), ("unknown", "", ())

        def union(parts, step: str | None = None):
            atoms, conflict = set(), False
            for part in parts:
                inner, c = self.slice(part, depth + 1, seen)
                conflict = conflict or c
                atoms |= {(k, n, (step, *v) if step else v) for k, n, v in inner}
            return frozenset(atoms or {literal}), conflict

        match node:
            case ast.Constant() | ast.Compare() | ast.UnaryOp(op=ast.Not()):
                return frozenset({literal}), False
            case ast.Name(id="__file__"):
                return frozenset({literal}), False
            case ast.Name():
                return self._lookup(node, depth, seen)
            case ast.JoinedStr():
                return union([v.value for v in node.values if isinstance(v, ast.FormattedValue)])
            case ast.Attribute():
                if self.callee(node) == "sys.argv":
                    return frozenset({("global", "sys.argv", ())}), False
                return union([node.value], f".{node.attr}")
            case ast.Subscript():
                return union([node.value], "[]")
            case ast.Await() | ast.UnaryOp() | ast.Starred():
                return union([node.operand if isinstance(node, ast.UnaryOp) else node.value])
            case ast.BinOp():
                return union([node.left, node.right])
            case ast.BoolOp():
                return union(node.values)
            case ast.IfExp():
                return union([node.body, node.orelse])
            case ast.List() | ast.Tuple() | ast.Set():
                return union(node.elts)
            case ast.Dict():
                return union(node.values)
            case ast.Call():
                return self._call(node, depth, seen)
        return frozenset({unknown}), False

    def _call(self, node: ast.Call, depth: int, seen: frozenset):
        callee = self.callee(node.func)
        arity = len(node.args) + len(node.keywords)
        values = [*node.args, *[k.value for k in node.keywords]]
        receiver = node.func.value if isinstance(node.func, ast.Attribute) else None
        if isinstance(receiver, (ast.Constant, ast.JoinedStr)) and node.func.attr == "format":
            parts = [self.slice(part, depth + 1, seen) for part in [receiver, *values]]
            return frozenset().union(*[a for a, _ in parts]), any(c for _, c in parts)
        atoms, conflict = set(), False
        for role, parts in (("arg", values), ("recv", [receiver] if receiver is not None else [])):
            for part in parts:
                inner, c = self.slice(part, depth + 1, seen)
                conflict = conflict or (c and role == "arg")
                step = f"{role}:{callee}/{arity}"
                atoms |= {(k, n, (step, *v)) for k, n, v in inner}
        return frozenset(atoms | {("call", callee, (f"self:{callee}/{arity}",))}), conflict

    def _lookup(self, use: ast.Name, depth: int, seen: frozenset):
        at, here = (use.lineno, use.col_offset), self.scope(use)
        scope, chain = here, self.branches(use)
        while True:
            found = self.bindings[scope].get(use.id, [])
            if scope is here:
                found = [b for b in found if b[0] <= at]
            if found:
                return self._decide(found, chain if scope is here else (), depth, seen)
            if scope is not self.tree and use.id in self.parameters(scope):
                return frozenset({("parameter", use.id, ())}), False
            if scope is self.tree:
                return frozenset({("name", use.id, ())}), False
            scope = self.scope(scope)

    def _decide(self, found: list[tuple], chain: tuple, depth: int, seen: frozenset):
        """The latest binding sure to have run, joined by later ones that may have."""
        found = sorted(found, key=lambda b: b[0])
        sure = [i for i, b in enumerate(found) if chain[: len(b[1])] == b[1]]
        live = found[sure[-1] :] if sure else found
        slices = [self.slice(value, depth + 1, seen) for _, _, value in live]
        atoms = frozenset().union(*[a for a, _ in slices])
        disagree = len({a for a, _ in slices}) > 1 or not sure
        return atoms, disagree or any(c for _, c in slices)

    # -- guards and parameters -----------------------------------------------------------------
    @staticmethod
    def names(node: ast.AST) -> list[str]:
        found = _walk(node)
        skip = {n.func for n in found if isinstance(n, ast.Call)}
        return sorted({n.id for n in found if isinstance(n, ast.Name) and n not in skip})

    def guards(self, node: ast.AST) -> list[dict]:
        """Membership tests that must have held where the node runs."""
        tests, child = [], node
        while (place := self.place[child])[0] is not None:
            above, field = place[:2]
            if isinstance(child, ast.stmt):
                tests += [(test, ast.NotIn) for at, test in self._leaving(above, field) if at < (child.lineno, child.col_offset)]
            if isinstance(above, ast.If) and field == "body":
                tests.append((above.test, ast.In))
            if isinstance(above, _SCOPES):
                break
            child = above
        out = []
        for test, operator in tests:
            match test:
                case ast.Compare(left=ast.Name(id=name), ops=[op], comparators=[pool]) if isinstance(
                    op, operator
                ):
                    atoms, conflict = self.slice(pool)
                    out.append({"name": name, "atoms": _atoms(atoms), "conflict": conflict})
        return out

    def _leaving(self, above: ast.AST, field: str) -> list[tuple]:
        """Place and test of each statement of a block that leaves it if the test holds; found once for each block."""
        if (above, field) not in self.leaving:
            block = getattr(above, field)
            self.leaving[above, field] = [
                ((s.lineno, s.col_offset), s.test)
                for s in (block if isinstance(block, list) else ())
                if isinstance(s, ast.If) and any(map(self._leaves, s.body))
            ]
        return self.leaving[above, field]

    def _leaves(self, statement: ast.stmt) -> bool:
        if isinstance(statement, (ast.Raise, ast.Return, ast.Continue, ast.Break)):
            return True
        value = statement.value if isinstance(statement, ast.Expr) else None
        return isinstance(value, ast.Call) and self.callee(value.func) in (
            "sys.exit",
            "exit",
            "os._exit",
            "quit",
        )

    def function(self, node: ast.AST) -> ast.AST | None:
        scope = self.scope(node)
        return scope if isinstance(scope, _FUNCTIONS) else None

    def parameter(self, node: ast.AST) -> tuple[str | None, bool]:
        """The parameter a value passes on, and whether it is provably nothing else.

        Allowed are the name itself, one attribute or literal subscript, and one alias that is
        bound once; any other store to the names involved voids the proof.
        """
        function = self.function(node)
        if function is None:
            return None, False
        root, hops = node, 0
        if isinstance(root, ast.Attribute) or (
            isinstance(root, ast.Subscript) and isinstance(root.slice, ast.Constant)
        ):
            root = root.value
        path = self.text(node)
        params = self.parameters(function)
        bound = self.bindings[function]
        while isinstance(root, ast.Name):
            if root.id in params:
                clean = root.id not in bound and self._unshared(function, {root.id}, path)
                return root.id, clean
            stores = bound.get(root.id, [])
            if hops == 1 or len(stores) != 1 or not isinstance(stores[0][2], ast.Name):
                return None, False
            if not self._unshared(function, {root.id}, path):
                return None, False
            root, hops = stores[0][2], hops + 1
        return None, False

    def _unshared(self, function: ast.AST, names: set[str], path: str) -> bool:
        if function not in self.disturbances:
            self.disturbances[function] = self._disturbances(function)
        renamed, stored = self.disturbances[function]
        return not names & renamed and path not in stored

    def _disturbances(self, function: ast.AST) -> tuple[set[str], set[str]]:
        """Names rebound in hidden ways inside a function, and paths it stores to."""
        renamed: set[str] = set()
        stored: set[str] = set()
        for node in _walk(function):
            if isinstance(node, (ast.Nonlocal, ast.Global)):
                renamed |= set(node.names)
            elif isinstance(node, (ast.NamedExpr, ast.comprehension)):
                renamed |= {n.id for n in _walk(node.target) if isinstance(n, ast.Name)}
            elif isinstance(node, (ast.Attribute, ast.Subscript)):
                if isinstance(node.ctx, (ast.Store, ast.Del)):
                    stored.add(self.text(node))
            elif isinstance(node, _SCOPES) and node is not function:
                renamed |= set(self.parameters(node))
        return renamed, stored

    def shadowed(self, node: ast.AST, name: str) -> bool:
        """Whether a bare name is bound where a node sees it, other than to the builtin itself."""
        if self.rebinders is None:
            self.rebinders = {}
            for n in self.nodes:
                if isinstance(n, _REBINDING):
                    for bound in self._rebinds(n):
                        self.rebinders.setdefault(bound, []).append(n)
        visible = {self.tree, *[a for a in self.ancestors(node) if isinstance(a, _FUNCTIONS)]}
        for n in self.rebinders.get(name, ()):
            owner = self.place[self.place[n][0]][0] if isinstance(n, ast.arg) else self.scope(n)
            in_class = owner is self.tree and any(
                isinstance(a, ast.ClassDef) for a in self.ancestors(n)
            )
            if owner in visible and not in_class:
                return True
        return False

    def _rebinds(self, node: ast.AST) -> list[str]:
        kind = type(node)
        if kind is ast.Name:
            if not isinstance(node.ctx, ast.Store):
                return []
            above = self.place[node][0]
            value = getattr(above, "value", None)
            itself = (
                isinstance(above, ast.Assign)
                and isinstance(value, ast.Attribute)
                and self.callee(value) == f"builtins.{node.id}"
            )
            return [] if itself else [node.id]
        if kind in _FUNCTIONS or kind is ast.ClassDef or kind is ast.ExceptHandler:
            return [node.name] if node.name else []
        if kind is ast.Import:
            return [a.asname or a.name.split(".")[0] for a in node.names]
        if kind is ast.ImportFrom:
            return [] if node.module == "builtins" else [a.asname or a.name for a in node.names]
        return [node.arg] if kind is ast.arg else []

    # -- rows ----------------------------------------------------------------------------------
    def literal(self, node: ast.AST) -> tuple[str, str | None, str | None]:
        """Kind, quote and raw content of an expression."""
        if isinstance(node, ast.Constant) and isinstance(node.value, (str, bytes)):
            found = _STRING.match(self.text(node))
            if not found or found.end() != len(self.text(node)):
                return "concat", None, None
            return "string", found[2], found[3]
        if isinstance(node, ast.JoinedStr):
            found = re.match(r"[A-Za-z]*(\"\"\"|'''|\"|')", self.text(node))
            return "fstring", found[1] if found else None, None
        return type(node).__name__.lower(), None, None

    def argument(self, node: ast.AST, name: str | None, deep: bool) -> dict:
        kind, quote, content = self.literal(node)
        atoms, conflict = self.slice(node) if deep else (frozenset(), False)
        parameter, bare = self.parameter(node) if deep else (None, False)
        if kind == "call" and len(node.args) == 1 and not node.keywords:
            inner_kind, quote, content = self.literal(node.args[0])
            kind = "call_of_string" if inner_kind == "string" else "call"
        if kind == "dict":
            content = _thread_id(node)
        return {
            "name": name,
            "text": self.text(node),
            "kind": kind,
            "quote": quote,
            "content": content,
            "callee": self.callee(node.func) if isinstance(node, ast.Call) else None,
            "atoms": _atoms(atoms),
            "conflict": conflict,
            "names": self.names(node) if deep else [],
            "guards": self.guards(node) if deep else [],
            "parameter": parameter,
            "bare": bare,
        }

    def decorators(self, function: ast.AST) -> list[str]:
        """Decorator texts without white space; an application object is named by its class."""
        return [self._decorator(d) for d in function.decorator_list]

    def _decorator(self, node: ast.AST) -> str:
        text = re.sub(r"\s+", "", self.text(node))
        target = node.func if isinstance(node, ast.Call) else node
        if isinstance(target, ast.Attribute) and isinstance(target.value, ast.Name):
            values = [v for _, _, v in self.bindings[self.tree].get(target.value.id, [])]
            if any(isinstance(v, ast.Call) and self.callee(v.func) == "typer.Typer" for v in values):
                return "typer.Typer." + text.split(".", 1)[1]
        return text

    def row(self, fact: str, node: ast.AST, **more) -> dict:
        line, col = self.position(node)
        function = self.function(node)
        base = {"fact": fact, "line": line, "col": col, "snippet": self.line_text(line)}
        if function is not None:
            if function not in self.described:
                self.described[function] = {
                    "fn": function.name,
                    "fn_decorators": self.decorators(function),
                    "fn_params": self.parameters(function),
                    "fn_unique": self.functions[function.name] == 1,
                }
            base |= self.described[function]
        return base | more

    def statement(self, node: ast.stmt) -> dict:
        value = getattr(node, "value", None)
        target = None
        if isinstance(node, ast.Assign) and len(node.targets) == 1:
            target = self.text(node.targets[0])
        kind = type(node).__name__.lower()
        if isinstance(node, ast.Assert) or (
            isinstance(node, ast.If)
            and isinstance(node.test, ast.UnaryOp)
            and isinstance(node.test.op, ast.Not)
            and not node.orelse
            and len(node.body) == 1
            and (
                (isinstance(node.body[0], ast.Raise) and node.body[0].exc is not None)
                or (isinstance(node.body[0], ast.Return) and node.body[0].value is not None)
            )
        ):
            kind = "guard"
        call = isinstance(value, ast.Call)
        plain = call and len(value.args) == 1 and not value.keywords
        return {
            "kind": kind,
            "target": target,
            "value": self.literal(value)[0] if value is not None else None,
            "quote": self.literal(value)[1] if value is not None else None,
            "callee": self.text(value.func) if call else None,
            "first": self.text(value.args[0]) if plain else None,
            "arity": len(value.args) + len(value.keywords) if call else None,
        }

    @cached_property
    def messages(self) -> list[str]:
        return sorted({m for n in self.nodes if isinstance(n, ast.Dict) for m in self._message(n)})

    def facts(self, wanted: Collection[str] | Mapping[str, re.Pattern | None] | None = None) -> Iterator[dict]:
        """All facts, or those of the ``wanted`` kinds.

        A pattern beside a kind leaves out facts in which it is not found: of calls in the function's text or last
        name, unless they are sinks or the file's own functions; of strings in the content; of assignments in the
        target or the content; of functions in their text, unless they or a function around them are decorated; of
        imports in the name.
        """
        nodes = self.nodes if wanted is None else [n for n in self.nodes if _FACT.get(type(n)) in wanted]
        patterns = wanted if isinstance(wanted, Mapping) else {}

        def asked(fact: str, *texts: str | None) -> bool:
            pattern = patterns.get(fact)
            return pattern is None or any(text is not None and pattern.search(text) for text in texts)

        for node in nodes:
            kind = type(node)
            if kind is ast.Call:
                callee = self.callee(node.func)
                leaf = callee.rsplit(".", 1)[-1]
                if leaf in self.sinks or leaf in self.functions or asked("call", self.text(node.func), leaf):
                    yield self._call_row(node, callee, leaf)
            elif kind is ast.Constant:
                if isinstance(node.value, (str, bytes)) and not isinstance(
                    self.place[node][0], (ast.JoinedStr, ast.FormattedValue)
                ):
                    literal, quote, content = self.literal(node)
                    if literal == "string" and asked("string", content):
                        yield self.row(
                            "string", node, text=content, quote=quote, keywords=self._enclosing(node)
                        )
            elif kind is ast.Assign:
                if len(node.targets) == 1:
                    if asked("assign", self.text(node.targets[0]), self.literal(node.value)[2]):
                        yield self._assignment("assign", node, node.targets[0], node.value)
            elif kind is ast.AugAssign:
                if isinstance(node.op, ast.Add) and asked("augassign", self.text(node.target)):
                    yield self._assignment("augassign", node, node.target, node.value)
            elif kind is ast.Return:
                if node.value is not None:
                    yield self.row("return", node, args=[self.argument(node.value, None, True)])
            elif kind is ast.ImportFrom:
                for alias in node.names:
                    if alias.asname is None and asked("import", alias.name):
                        yield self.row("import", node, name=alias.name, text=node.module)
            elif kind in _FUNCTIONS:
                chain = [n for n in [node, *self.ancestors(node)] if isinstance(n, _FUNCTIONS)]
                if any(n.decorator_list for n in chain) or asked("function", self.text(node)):
                    yield self._function(node, chain)

    def _call_row(self, node: ast.Call, callee: str, leaf: str) -> dict:
        deep = leaf in self.sinks or leaf in self.functions
        bare = isinstance(node.func, ast.Name)
        return self.row(
            "call",
            node,
            name=leaf,
            text=self.text(node.func),
            callee=callee,
            receiver=self.text(node.func.value) if isinstance(node.func, ast.Attribute) else None,
            args=[
                *[self.argument(a, None, deep) for a in node.args],
                *[self.argument(k.value, k.arg or "**", deep) for k in node.keywords],
            ],
            local=leaf in self.functions,
            shadowed=bare and leaf in self.sinks and self.shadowed(node, leaf),
        )

    def _assignment(self, fact: str, node, target, value) -> dict:
        kind, quote, content = self.literal(value)
        parts = []
        if kind == "fstring":
            parts = [v.value for v in value.values if isinstance(v, ast.FormattedValue)]
        elif isinstance(value, ast.BoolOp) and isinstance(value.op, ast.Or):
            parts = value.values
        elif isinstance(value, ast.BinOp) and isinstance(value.op, ast.Add):
            parts = [value.left, value.right]
        elif fact == "augassign":
            parts = [value]
        shape = {ast.BoolOp: "or", ast.BinOp: "add"}.get(type(value), kind)
        return self.row(
            fact,
            node,
            name=self.text(target),
            text=content,
            quote=quote,
            callee=shape,
            args=[self.argument(p, None, True) for p in parts],
            messages=self.messages,
        )

    def _function(self, node, chain: list[ast.AST]) -> dict:
        first = node.body[0]
        docstring = isinstance(first, ast.Expr) and self.literal(first.value)[0] == "string"
        _, quote, content = self.literal(first.value) if docstring else (None, None, None)
        row = self.row("function", node)
        start = (row["line"], row["col"], row["snippet"])
        if node.decorator_list:
            line, col = self.position(node.decorator_list[0])
            start = (line, col - 1, self.line_text(line))
        return row | {
            "name": node.name,
            "text": content,
            "quote": quote,
            "fn_decorators": self.decorators(node),
            "start_line": start[0],
            "start_col": start[1],
            "start_snippet": start[2],
            "outer": [self.decorators(n) for n in chain],
            "statements": [self.statement(s) for s in node.body],
        }

    def _enclosing(self, node: ast.AST) -> list[str]:
        """``callee|keyword|content|arity`` of every literal keyword of the calls around a node."""
        out = []
        for above in self.ancestors(node):
            if isinstance(above, ast.stmt):
                break
            if isinstance(above, ast.Call):
                arity = len(above.args) + len(above.keywords)
                for k in above.keywords:
                    kind, _, content = self.literal(k.value)
                    if kind == "string":
                        out.append(f"{self.callee(above.func)}|{k.arg}|{content}|{arity}")
        return out

    def _message(self, node: ast.Dict) -> list[str]:
        pairs = {
            k.value: v
            for k, v in zip(node.keys, node.values, strict=True)
            if isinstance(k, ast.Constant) and isinstance(k.value, str)
        }
        if len(node.keys) == 2 and set(pairs) == {"role", "content"}:
            role = pairs["role"]
            if isinstance(role, ast.Constant) and role.value == "user":
                return [self.text(pairs["content"])]
        return []


def _thread_id(node: ast.Dict) -> str | None:
    """``configurable.thread_id`` when a dict of exactly that shape holds a literal."""
    match node:
        case ast.Dict(keys=[ast.Constant(value="configurable")], values=[ast.Dict() as inner]):
            for key, value in zip(inner.keys, inner.values, strict=True):
                if isinstance(key, ast.Constant) and key.value == "thread_id":
                    if isinstance(value, ast.Constant) and isinstance(value.value, str):
                        return value.value
    return None


def _atoms(atoms: frozenset) -> list[dict]:
    return [{"kind": k, "name": n, "via": list(v)} for k, n, v in sorted(atoms)]


def _parsed(text: str) -> ast.Module:
    # Calls between Python functions take no C stack, so depth is bounded by the parser alone.
    sys.setrecursionlimit(max(sys.getrecursionlimit(), _RECURSION))
    return ast.parse(text)


def facts_of(
    text: str, sinks: frozenset[str], wanted: Collection[str] | Mapping[str, re.Pattern | None] | None = None
) -> list[dict]:
    """Fact rows of one text; a text that does not parse gives one ``unparseable`` row."""
    try:
        read = _File(text, sinks)
    except (SyntaxError, ValueError, RecursionError):
        return [{"fact": "unparseable"}]
    return list(read.facts(wanted))


def facts(
    files: DataFrame, sinks: tuple[str, ...], wanted: tuple[str, ...] | Mapping[str, str | None] | None = None
) -> DataFrame:
    """Facts of Python files (columns ``path`` and ``text``), one narrow pass over the texts.

    With ``wanted``, only facts of these kinds are built, beside ``unparseable``; a pattern with a kind leaves out
    more, see :meth:`_File.facts`.
    """
    leaves = frozenset(sinks)
    if isinstance(wanted, Mapping):
        kinds = {kind: None if pattern is None else re.compile(pattern) for kind, pattern in wanted.items()}
    else:
        kinds = None if wanted is None else frozenset(wanted)

    return rows_from_texts(files, lambda text: facts_of(text, leaves, kinds), FACTS)


def failures_of(text: str) -> list[dict]:
    """One ``unparseable`` row if the text does not parse; nothing beyond its syntax is looked at."""
    try:
        _parsed(text.removeprefix("\ufeff"))
    except (SyntaxError, ValueError, RecursionError):
        return [{"fact": "unparseable"}]
    return []


def failures(files: DataFrame) -> DataFrame:
    """``path`` and ``fact`` of Python files that do not parse."""
    return rows_from_texts(files, failures_of, "path string, fact string")
