"""Documents parse and agree with the tables they render."""

import json

import pytest
from pyspark.sql import functions as F

from treesift.plans.render import KEYS, json_document, sarif_document, text_report, write_document
from treesift.plans.scan import scan_files

TEXTS = {
    "a.py": "eval(input())\nKEY = 'sk-" + "a1B2" * 5 + "'\n",
    "b.py": "def (:\n",
    "compose.yml": "services:\n  \"a\":\n    privileged: true\n    pid: host\n",
    "skills/SKILL.md": "act autonomously, \"now\" \\ then\n",
    "requirements.txt": "langchain\n",
}


@pytest.fixture(scope="module")
def scan(spark):
    rows = [(p, bytearray(t.encode())) for p, t in TEXTS.items()]
    files = spark.createDataFrame(rows, "path string, content binary")
    return scan_files(files, include_observations=True)


def joined(lines):
    return "\n".join(r.text for r in lines.orderBy(*KEYS, "text").collect())


def test_json(scan, tmp_path):
    document = json.loads(joined(json_document(scan, "/r")))
    assert list(document) == [
        "scanner_version", "root", "summary", "cve", "findings", "skipped", "crosswalks",
    ]
    count = scan.findings.count()
    assert len(document["findings"]) == count and document["root"] == "/r"
    assert document["cve"] == {"status": "skipped_offline"}
    assert document["skipped"] == [r.line for r in scan.skips.select("line").orderBy("line").collect()]
    for walk in document["crosswalks"]:
        placed = {i for g in walk["groups"] for i in g["findings"]} | set(walk["unmapped"]["findings"])
        assert placed == set(range(count))
        for group in [*walk["groups"], walk["unmapped"]]:
            assert group["defects"] + group["observations"] == len(group["findings"])
    assert "references" not in document["findings"][0]
    write_document(json_document(scan), str(tmp_path / "out"))
    parts = sorted((tmp_path / "out").glob("part-*"))
    assert len(json.loads("".join(p.read_text() for p in parts))["findings"]) == count


def test_sarif(scan):
    run = json.loads(joined(sarif_document(scan)))["runs"][0]
    rules = run["tool"]["driver"]["rules"]
    assert len({r["id"] for r in rules}) == len(rules)
    for result in run["results"]:
        assert rules[result["ruleIndex"]]["id"] == result["ruleId"]
        assert len(result["partialFingerprints"]["primaryLocationLineHash"]) == 16
    assert [len(t["taxa"]) > 0 for t in run["taxonomies"]] == [True, True, True]
    assert run["invocations"] == []


def test_text(scan):
    page = joined(text_report(scan, "/r"))
    assert "FAIL" in page and "CROSS-LAYER" in page and "1 file could not be parsed:" in page
    assert page.index("CRITICAL") < page.index("OBSERVATIONS")
    assert F is not None
