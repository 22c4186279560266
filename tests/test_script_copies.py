"""Copies of a script are read and judged once, and reported for every path."""

import re

from test_script_rules import CASES

from treesift.operators import script_rules
from treesift.sources.batches import distinct_texts
from treesift.sources.script_facts import facts, facts_of

KEY = "sk-" + "a1B2" * 5
# One location with a defect that tests make an observation, beside a better one that stays a defect or a worse one.
TWO = f"const systemPromptToken = '{KEY}'\neval(x)\n"
FILES = [("web/a.ts", TWO), ("web/b.ts", TWO), ("spec/a.ts", TWO), ("web/c.ts", TWO + "\n"), ("web/d.ts", "f(\n"), ("d.ts", "f(\n")]
SHOWN = ["rule_id", "kind", "location.file", "location.line", "snippet", "secondary_rule_ids"]


def test_texts_once_paths_all(spark):
    texts, members = distinct_texts(spark.createDataFrame(FILES, "path string, text string"))
    table = facts(texts).persist()
    assert table.where("fact = 'call'").count() == 2
    got = script_rules.findings(table, members).select(*SHOWN).collect()
    assert {r.file for r in got} == {path for path, _ in FILES[:4]}
    both = {(r.file, r.rule_id, r.kind, *r.secondary_rule_ids) for r in got if r.line == 1 and r.secondary_rule_ids}
    assert ("web/a.ts", "BAS-LLM08-002", "defect", "BAS-ZT1-011") in both
    assert ("spec/a.ts", "BAS-LLM08-002", "observation", "BAS-ZT1-011") in both
    keys = {(r.file, r.kind) for r in got if r.rule_id == "BAS-ZT1-003"}
    assert keys == {(path, "defect") for path, _ in FILES[:4]}  # provider keys count in tests too
    assert {r.snippet for r in got if r.line == 2} == {"eval(x)"}


def test_same_findings_as_without_copies(spark):
    files = spark.createDataFrame(FILES, "path string, text string")
    texts, members = distinct_texts(files)
    got = script_rules.findings(facts(texts).persist(), members)
    want = script_rules.findings(facts(files).persist())
    assert got.schema == want.schema
    assert sorted(got.collect(), key=repr) == sorted(want.collect(), key=repr)


def test_wanted_facts_are_all_that_rules_find(spark):
    files = spark.createDataFrame([(p, t) for p, (t, _) in CASES.items()] + FILES, "path string, text string")
    got, want = facts(files, script_rules.WANTED).persist(), facts(files).persist()
    assert got.count() < want.count()
    found, wanted = (sorted(script_rules.findings(f).collect(), key=repr) for f in (got, want))
    assert found == wanted and len({r.rule_id for r in found}) == len(script_rules.rules())


def test_wanted_facts_are_the_same_rows():
    wanted = {kind: re.compile(pattern) for kind, pattern in script_rules.WANTED.items()}
    for text, _ in CASES.values():
        rows = [r for r in facts_of(text) if r["fact"] != "line"]
        assert [r for r in facts_of(text, wanted) if r["fact"] != "line"] == [
            r for r in rows if wanted[r["fact"]].search(r["args"][0]["content"] if r["fact"] == "string" else r["name"])
        ]
