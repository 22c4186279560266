"""The filter audit against applying every order of filters one by one."""

import re
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from treesift.llm.filter_audit import audit, measures

DOCS = "doc_id bigint, text string, source string, id string, n string, good string, fails string, gone string"
LABELS = "doc_id bigint, quality int, toxic int, part string"


def fails(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    capitals = len(re.findall("[A-Z]", text))
    return {
        "A": len(words) < 50,
        "B": 100 * len(set(words)) < 65 * len(words),
        "C": 100 * capitals > 5 * len(text),
        "D": bool(re.search("[#$%&*|]", text)),
    }


def brute(docs, labels):
    first = {}
    for i, text, _ in docs:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    rows = []
    for i, text, source in docs:
        failed = fails(text or "")
        failed["E"] = i is not None and i > first[text or ""]
        good = any(d == i and q == 1 for d, q, _ in labels if i is not None)
        toxic = any(d == i and t == 1 for d, _, t in labels if i is not None)
        rows.append((source or "", {f for f in failed if failed[f]}, good, toxic))
    out = []
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        steps, shapley = [], dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = own
            for k, f in enumerate(order):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                failing = sum(f in r[1] for r in own)
                shapley[f] += len(gone)
                alone = sum(r[1] == {f} for r in own)
                lost = [sum(r[c] for r in gone) for c in (2, 3)]
                steps.append((part, "".join(order), k + 1, f, len(left), len(gone), failing - len(gone), alone, *lost))
        out += [(*s, shapley[s[3]]) for s in steps]
    return sorted(out)


def found(spark, docs, labels, **options):
    frame = spark.createDataFrame([(*d, "x", "x", "x", "x", "x") for d in docs], DOCS).repartition(3)
    return audit(frame, spark.createDataFrame([(*x, "x") for x in labels], LABELS), **options)


def test_every_order(spark):
    rng = np.random.default_rng(0)
    docs = []
    for i in range(150):
        n = int(rng.choice([0, 3, 49, 50, 51, 80]))
        words = [f"w{rng.integers(rng.choice([30, 3000]))}" for _ in range(n)]
        words += ["AAAA"] * int(rng.choice([0, 0, 12])) + ["#"] * int(rng.choice([0, 0, 1]))
        docs.append((i, " ".join(words), str(rng.choice(["a", "b"]))))
    docs += [(200 + i, docs[i][1], "c") for i in range(40)]
    docs += [(5, docs[5][1], "a"), (5, docs[5][1], "a"), (5, "another text of a repeated id", "b")]
    docs += [(None, docs[3][1], "a"), (None, None, None), (300, None, None), (301, "", ""), (302, "\x0b \t", "")]
    labels = [(int(i), int(rng.integers(2)), int(rng.integers(2))) for i in rng.integers(0, 250, 120)]
    labels += [(None, 1, 1), (5, None, 1), (5, 1, None)]
    assert sorted(map(tuple, found(spark, docs, labels).collect())) == brute(docs, labels)


def test_a_third_of_all_rows_share_a_text(spark):
    docs = [(i, "one text for many" if i % 3 == 0 else f"text {i} " * 40, "hot") for i in range(900)]
    assert sorted(map(tuple, found(spark, docs, []).collect())) == brute(docs, [])


def test_empty_table_and_all_clean(spark):
    assert found(spark, [], []).collect() == []
    docs = [(1, " ".join(f"w{k}" for k in range(60)), "s")]
    assert sorted(map(tuple, found(spark, docs, [(1, 1, 1)]).collect())) == brute(docs, [(1, 1, 1)])


def test_other_filters(spark):
    docs = [(1, "a A", "s"), (2, "a A B", "s"), (3, "a b", "s")]
    filters = {"X": F.col("n_capitals") > 0, "Y": F.col("n_capitals") != 1}
    rows = found(spark, docs, [], filters=filters, repeats=None).collect()
    got = {(r["filter_order"], r["step"]): (r["kept"], r["removed"], r["redundant"], r["unique_fails"]) for r in rows}
    assert got == {("XY", 1): (1, 2, 0, 1), ("XY", 2): (0, 1, 1, 1), ("YX", 1): (1, 2, 0, 1), ("YX", 2): (0, 1, 1, 1)}
    assert {r["filter"]: r["shapley"] for r in rows} == {"X": 3, "Y": 3}
    with pytest.raises(ValueError):
        found(spark, docs, [], filters={"E": F.col("n_words") > 0})


def test_measures():
    texts = ["", "a\u00a0b a\u00a0b\tX", "É É #|", "\x1c \x0b"]
    got = measures(pa.array(texts))
    assert got["n_words"].tolist() == [0, 3, 3, 1] and got["n_different"].tolist() == [0, 2, 2, 1]
    assert got["n_capitals"].tolist() == [0, 1, 0, 0] and got["n_marks"].tolist() == [0, 0, 2, 0]
    assert got["n_points"].tolist() == [len(t) for t in texts]
