"""Rule validation, added rules, streaming, ignore patterns against brute force."""

import fnmatch
import itertools

import pytest
from pyspark.sql import functions as F

from treesift.model import Rule
from treesift.operators import python_rules
from treesift.operators.provenance import SINK_LEAVES
from treesift.operators.python_rules import Flow, Match
from treesift.operators.rule_checks import RuleError, validate
from treesift.sources.python_facts import facts
from treesift.sources.tree import WalkOptions, ignore_patterns, select_files
from treesift.streaming.arrivals import config_stream, scan_stream

RULE = Rule("X-1", "t", "defect", "high", "high", ("LLM10",), "d", "r")


def test_shipped_rules_are_valid(spark):
    ids = [m.rule.rule_id for m in validate(python_rules.rules())]
    assert len(ids) == len(set(ids)) == 38


@pytest.mark.parametrize(
    "rule, flow, message",
    [
        (RULE._replace(categories=()), None, "no category"),
        (RULE._replace(categories=("ZZ",)), None, "unknown categories"),
        (RULE._replace(categories=("LLM06",)), None, "context-dependent"),
        (RULE, Flow(sources=("nowhere",)), "unknown sources"),
        (RULE, Flow(unproven="x"), "without a source"),
        (RULE, Flow(sources=("file_read",), unproven="("), "invalid pattern"),
        (RULE._replace(kind="observation"), Flow(sources=("file_read",), unproven="x"), "observation"),
        (RULE, Flow(sources=("file_read",), passthrough=True), "pass-through"),
    ],
)
def test_invalid_rules(spark, rule, flow, message):
    with pytest.raises(RuleError, match=message):
        validate([Match(rule, F.lit(True), F.lit(1), flow)])


def test_duplicate_rule(spark):
    with pytest.raises(RuleError, match="duplicate"):
        validate([Match(RULE, F.lit(True)), Match(RULE, F.lit(True))])


def test_added_rule(spark):
    files = spark.createDataFrame([("a.py", "secret_call(1)\n")], "path string, text string")
    added = Match(RULE, (F.col("fact") == "call") & (F.col("name") == "secret_call"))
    found = python_rules.findings(facts(files, SINK_LEAVES), [added]).collect()
    assert [(r.rule_id, r.location.line) for r in found] == [("X-1", 1)]


def test_streaming(spark, tmp_path):
    source = str(tmp_path / "in")
    rows = [(".env", bytearray(b"A_SECRET=hunter2\n")), ("a.py", bytearray(b"eval(x)\n"))]
    spark.createDataFrame(rows, "path string, content binary").write.parquet(source)
    stream = spark.readStream.schema("path string, content binary").parquet(source)
    config = (
        config_stream(stream)
        .writeStream.format("memory")
        .queryName("config_findings")
        .option("checkpointLocation", str(tmp_path / "c1"))
        .start()
    )
    config.processAllAvailable()
    config.stop()
    assert [r.rule_id for r in spark.table("config_findings").collect()] == ["BAS-ZT1-022"]
    seen = {}
    query = scan_stream(
        stream,
        lambda scan, n: seen.update({n: {r.rule_id for r in scan.findings.collect()}}),
        str(tmp_path / "c2"),
    )
    query.awaitTermination()
    assert seen == {0: {"BAS-ZT1-022", "BAS-LLM10-004"}}


def test_ignore_patterns_against_brute_force(spark):
    names = ["f", "b.py", "c.md"]
    paths = [
        "/".join(p) for n in (1, 2, 3) for p in itertools.product(["a", "b"], repeat=n - 1) for p in [(*p, x) for x in names]
    ]
    lines = ["*.py", "!b.py", "a/", "/b/f", "c.*"]
    ignores = spark.createDataFrame([(".gitignore", "\n".join(lines))], "path string, text string")
    listing = spark.createDataFrame([(p,) for p in paths], "path string")
    kept, _ = select_files(listing, ignore_patterns(ignores), WalkOptions())

    def ignored(path):
        parts = path.split("/")
        for n in range(1, len(parts) + 1):
            name, whole, is_dir = parts[n - 1], "/".join(parts[:n]), n < len(parts)
            verdict = False
            for line in lines:
                body = line.lstrip("!")
                if body.endswith("/"):
                    hit = is_dir and name == body[:-1]
                elif body.startswith("/"):
                    hit = whole == body[1:]
                else:
                    hit = fnmatch.fnmatchcase(name, body)
                if hit:
                    verdict = not line.startswith("!")
            if verdict:
                return True
        return False

    assert {r.path for r in kept.collect()} == {p for p in paths if not ignored(p)}
