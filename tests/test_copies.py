"""Copies of a text are read and judged once, and reported for every path."""

from pyspark.sql import functions as F
from test_python_rules import CASES

from treesift.operators import python_rules
from treesift.operators.provenance import SINK_LEAVES
from treesift.sources.batches import distinct_texts, of_every_path
from treesift.sources.python_facts import FACTS, facts, facts_of, failures

EVAL = "def go(q):\n    eval(q)\n    return client.responses.create(q)\n"
FILES = [("app/a.py", EVAL), ("app/b.py", EVAL), ("tests/a.py", EVAL), ("app/c.py", EVAL + "\n"), ("app/d.py", "def (:\n"), ("d.py", "def (:\n")]


def test_texts_once_paths_all(spark):
    files = spark.createDataFrame(FILES, "path string, text string")
    texts, members = distinct_texts(files)
    assert texts.count() == 3 and members.count() == 6
    broken = of_every_path(failures(texts), members)
    assert sorted(r.path for r in broken.collect()) == ["app/d.py", "d.py"]
    table = facts(texts, SINK_LEAVES).persist()
    shown = ["rule_id", "kind", F.col("location.file").alias("file"), F.col("location.line").alias("line"), "snippet"]
    got = python_rules.findings(table, members=members).select(*shown).collect()
    want = python_rules.findings(facts(files, SINK_LEAVES).persist()).select(*shown).collect()
    assert sorted(got) == sorted(want) and {r.file for r in got} == {p for p, _ in FILES[:4]}
    assert {r.kind for r in got if r.file == "tests/a.py" and r.line == 2} == {"observation"}


def test_wanted_facts_are_the_same_rows():
    leaves = frozenset(SINK_LEAVES)
    rows = facts_of(EVAL, leaves)
    for kind in {r["fact"] for r in rows}:
        assert facts_of(EVAL, leaves, frozenset([kind])) == [r for r in rows if r["fact"] == kind]


# What the cases of the rules' own tests do not show.
MORE = (
    "from langchain import LLMMathChain, PandasQueryEngine\nos.system(client.responses.create(q))\n"
    "def f(cursor):\n    cursor.execute(client.responses.create(q))\n"
    "GraphCypherQAChain.from_llm(allow_dangerous_requests=True)\n"
)
SHOWN = ["rule_id", "kind", "severity", "confidence", "location", "snippet", "description", "categories", "secondary_rule_ids"]


def _found(findings):
    return sorted(map(repr, findings.select(*SHOWN).collect()))


def test_same_findings_with_and_without_copies(spark):
    """What is found at a place is one for a path, whether its rows come twice, with several texts, or in tests."""
    rows = [(p, t) for p, (t, _) in CASES.items()]
    rows += [(f"tests/{p}", t) for p, t in rows] + rows[:5] + [("app/a.py", EVAL), ("app/a.py", "import a\n" + EVAL), ("app/a.py", "\neval(q)\n")]
    files = spark.createDataFrame(rows, "path string, text string")
    texts, members = distinct_texts(files)
    got = _found(python_rules.findings(facts(texts, SINK_LEAVES, python_rules.WANTED).persist(), members=members))
    want = _found(python_rules.findings(facts(files, SINK_LEAVES).persist()))
    assert got == want and len(got) > 60


def test_one_finding_a_place_of_a_path_with_several_texts(spark):
    rows = [("a.py", "def f(q):\n    eval(q)\n"), ("a.py", "def f(q):\n    eval(client.responses.create(q))\n"), ("b.py", "def f(q):\n    eval(q)\n")]
    texts, members = distinct_texts(spark.createDataFrame(rows, "path string, text string"))
    found = python_rules.findings(facts(texts, SINK_LEAVES).persist(), members=members).collect()
    got = {(r.location.file, r.rule_id, tuple(r.secondary_rule_ids), r.snippet) for r in found}
    assert len(found) == 2 and got == {
        ("a.py", "BAS-LLM10-001", ("BAS-LLM10-004",), "eval(client.responses.create(q))"),
        ("b.py", "BAS-LLM10-004", (), "eval(q)"),
    }


def test_wanted_facts_are_all_that_rules_find(spark):
    rows = [(p, t) for p, (t, _) in CASES.items()] + FILES + [("one.py", MORE)]
    files = spark.createDataFrame(rows, "path string, text string")
    got, want = facts(files, SINK_LEAVES, python_rules.WANTED).persist(), facts(files, SINK_LEAVES).persist()
    assert got.count() < want.count()
    assert _found(python_rules.findings(got)) == _found(python_rules.findings(want))
    ids = {i for r in python_rules.findings(got).collect() for i in (r.rule_id, *r.secondary_rule_ids)}
    assert ids == {m.rule.rule_id for m in python_rules.rules()}


def test_findings_hold_numbers_until_paths_are_joined(spark):
    table = spark.createDataFrame([], FACTS)
    members = spark.createDataFrame([], "path string, key string")
    plan = python_rules.findings(table, members=members)._jdf.queryExecution().optimizedPlan().toString()
    assert "min_by" not in plan and plan.count("bit_or") > 0
