"""Name lookup by joins against walking the scopes of each use."""

import ast
import random

from treesift.operators.name_lookup import resolved
from treesift.sources.python_facts import _File
from treesift.sources.python_names import names, names_of


def walked(text):
    """(line, col, name) -> kind, sure, values: scope by scope, binding by binding."""
    file, out = _File(text, frozenset()), {}
    for use in file.nodes:
        if not (isinstance(use, ast.Name) and isinstance(use.ctx, ast.Load)):
            continue
        at, here = (use.lineno, use.col_offset), file.scope(use)
        scope, result = here, None
        while result is None:
            found = sorted(file.bindings[scope].get(use.id, []), key=lambda b: b[0])
            chain = file.branches(use) if scope is here else ()
            if scope is here:
                found = [b for b in found if b[0] <= at]
            if found:
                sure = [i for i, b in enumerate(found) if chain[: len(b[1])] == b[1]]
                live = found[sure[-1] :] if sure else found
                result = ("binding", bool(sure), [file.text(v) if v is not None else "?" for _, _, v in live])
            elif scope is not file.tree and use.id in file.parameters(scope):
                result = ("parameter", False, [])
            elif scope is file.tree:
                result = ("name", False, [])
            else:
                scope = file.scope(scope)
        out[(*at, use.id)] = result
    return out


def program(rng, depth=0, indent=""):
    lines = []
    for _ in range(rng.randint(1, 5)):
        kind = rng.randint(0, 9 if depth < 3 else 5)
        a, b = rng.choice("xyz"), rng.choice("xyzw")
        if kind < 3:
            lines.append(f"{indent}{a} = {rng.choice([b, rng.randint(0, 9)])}")
        elif kind < 5:
            lines.append(f"{indent}use({a}, {b})")
        elif kind == 5:
            lines.append(f"{indent}{a}, w = {b}")
        elif kind == 6:
            lines.append(f"{indent}def f({a}):")
            lines += program(rng, depth + 1, indent + "    ")
        elif kind == 7:
            lines.append(f"{indent}if {a}:")
            lines += program(rng, depth + 1, indent + "    ")
            lines.append(f"{indent}else:")
            lines += program(rng, depth + 1, indent + "    ")
        elif kind == 8:
            lines.append(f"{indent}for {a} in {b}:")
            lines += program(rng, depth + 1, indent + "    ")
        else:
            lines.append(f"{indent}try:")
            lines += program(rng, depth + 1, indent + "    ")
            lines.append(f"{indent}except E as {a}:")
            lines += program(rng, depth + 1, indent + "    ")
    return lines


def test_random_programs(spark):
    rng = random.Random(3)
    texts = {f"p{k}.py": "\n".join(program(rng) + program(rng)) + "\n" for k in range(120)}
    texts["long.py"] = "x = 1\n" + "x = x + 1\nuse(x)\n" * 3000
    texts["broken.py"] = "def (:\n"
    texts["empty.py"] = ""
    files = spark.createDataFrame(list(texts.items()), "path string, text string")
    got = {
        (r["path"], r["line"], r["col"], r["name"]): (r["kind"], r["sure"], list(r["values"]))
        for r in resolved(names(files)).collect()
    }
    want = {(p, *place): v for p, t in texts.items() if p != "broken.py" for place, v in walked(t).items()}
    assert len(want) > 6000 and got == want


def test_rows_of_a_text():
    rows = names_of("def f(a):\n    return a\n")
    assert [(r["kind"], r["name"]) for r in rows] == [("parameter", "a"), ("use", "a")]
    assert names_of("x = (") == []


def test_wanted_names_in_order(spark):
    rng = random.Random(4)
    texts = {f"q{k}.py": "\n".join(program(rng) + program(rng)) + "\n" for k in range(60)}
    # A path that comes again counts once.
    files = spark.createDataFrame([*texts.items(), *list(texts.items())[:20]], "path string, text string").repartition(7)
    rows = names(files, 3, ("x", "w"))
    assert {r["name"] for r in rows.select("name").distinct().collect()} == {"x", "w"}
    found = resolved(rows, in_order=True).collect()
    got = {(r["path"], r["line"], r["col"], r["name"]): (r["kind"], r["sure"], list(r["values"])) for r in found}
    want = {(p, *place): v for p, t in texts.items() for place, v in walked(t).items() if place[2] in "xw"}
    assert len(found) == len(want) > 500 and got == want


def test_names_in_any_order_and_scopes_around(spark):
    text = "x = 1\nif x:\n    x = 2\ndef f(p):\n    def g():\n        return x, p, q\n    return g\n"
    rows = names(spark.createDataFrame([("a.py", text), ("b.py", text)], "path string, text string")).orderBy("col", "kind")
    got = {(r["path"], r["name"], r["line"]): (r["kind"], r["sure"], list(r["values"])) for r in resolved(rows).collect()}
    assert got == {
        (path, *use): met
        for path in ("a.py", "b.py")
        for use, met in {
            ("x", 2): ("binding", True, ["1"]),
            ("x", 6): ("binding", True, ["1", "2"]),
            ("p", 6): ("parameter", False, []),
            ("q", 6): ("name", False, []),
            ("g", 7): ("name", False, []),
        }.items()
    }
