"""Script rules on small texts of our own."""

import pytest

from treesift.operators import script_rules
from treesift.sources.script_facts import facts

KEY = "sk-" + "a1B2" * 5
CASES = {
    "a.js": (
        "eval(code)\neval('1')\nnew Function(body)\ncp.exec(reply.text)\nexecSync(`ls ${output}`)\n"
        "cp.exec(cmd)\nre.exec(message)\ndb.query(`select ${completion.x} from t`)\n// eval(x)\n",
        {("BAS-LLM10-005", 1), ("BAS-LLM10-005", 3), ("BAS-LLM10-006", 4), ("BAS-LLM10-006", 5), ("BAS-LLM10-007", 8)},
    ),
    "b.ts": (
        f"const key = '{KEY}'\nconst t = \"sk-test-{'a' * 20}\"\nconst systemPrompt = `Hi ${{userName}}, ${{x}}`\n"
        f"const promptB = `use {KEY} now`;\nconst note = `Hi ${{userName}}`\n",
        {("BAS-ZT1-003", 1), ("BAS-ZT4-003", 3), ("BAS-LLM08-002", 4)},
    ),
    "t.ts": (
        "const authToken = 'q8Z1x7Lm2Pw9'\nconst apiKey = `${env}`\nh({ A: \"Bearer " + "a1B2" * 5 + "\" })\n",
        {("BAS-ZT1-011", 1), ("BAS-LLM02-005", 3)},
    ),
    "c.ts": ("const prompt = `Hi ${user}`\nsend([{ role: 'user', content: prompt }])\n", set()),
    "d.tsx": (
        "const r = await generateText({ model, prompt })\nconst s = streamText({ model, maxOutputTokens: 5 })\n"
        "openai.chat.completions.create({ model: 'm', max_tokens: 1 })\nnew ChatOpenAI()\n"
        "createAgent(model, '*')\ncreateThing(model, '*')\nconst re = /['\"`(]/g;\n",
        {("BAS-LLM06-002", 1), ("BAS-LLM06-002", 4), ("BAS-ZT2-002", 5)},
    ),
    "e.mjs": (
        "export const deleteUser = tool({ name: 'x', execute: async (p) => { await db.del(p) } })\n"
        "const createUser = tool({ execute: async (p) => { if (!p.ok) { throw new Error('x') } return db.add(p) } })\n"
        "const updateUser = tool({ execute: (p) => { if (!p.ok) throw new Error('x'); return 1 } })\n"
        "const readUser = tool({ execute: (p) => { return 1 } })\n",
        {("BAS-LLM03-002", 1)},
    ),
    "f.js": ("x = `a ${ y(`b ${ eval(z) }`) } c`\n", {("BAS-LLM10-005", 1)}),
}


@pytest.fixture(scope="module")
def found(spark):
    rows = [*[(p, t) for p, (t, _) in CASES.items()], ("broken.js", "f(\n")]
    table = facts(spark.createDataFrame(rows, "path string, text string")).persist()
    assert table.where("fact = 'unparseable'").select("path").collect() == [("broken.js",)]
    return script_rules.findings(table).select("rule_id", "location.file", "location.line").collect()


@pytest.mark.parametrize("path", CASES)
def test_case(found, path):
    assert {(r.rule_id, r.line) for r in found if r.file == path} == CASES[path][1]


@pytest.mark.parametrize(
    "line",
    ["const a = <li>a) first</li>", "const p = <p>Hello :) world</p>;", r"if (a) /\(/.test(b)", "const s = <p>`</p>"],
)
def test_brackets_in_markup_and_patterns_cost_no_other_finding(line):
    from treesift.sources.script_facts import facts_of

    found = facts_of(line + "\neval(x)\n")
    assert ("call", "eval", 2) in {(r["fact"], r["name"], r["line"]) for r in found}


@pytest.mark.parametrize("text", ["f(\n", "x = {\n eval(z)", "f({a: [1, 2)\neval(y)"])
def test_broken_texts_give_nothing_else(text):
    from treesift.sources.script_facts import facts_of

    assert [r["fact"] for r in facts_of(text)] == ["unparseable"]


def test_facts_of_one_long_line_are_no_larger_than_the_text():
    from treesift.sources.script_facts import facts_of

    text = "f('a');" * 6000
    rows = facts_of(text)
    assert len(rows) > 12000 and sum(len(r["snippet"] or "") for r in rows) == len(text)


def test_many_stray_openers_between_tags(spark):
    text = "const a = () => {\n" + "out.push(<b>(</b>)\n" * 200 + "}\neval(x)\n"
    table = facts(spark.createDataFrame([("a.tsx", text)], "path string, text string"))
    found = script_rules.findings(table).select("rule_id", "location.line", "snippet").collect()
    assert [tuple(r) for r in found] == [("BAS-LLM10-005", 203, "eval(x)")]
