"""Periodic runs against every stretch, one by one."""

import hashlib
import re
from fractions import Fraction

import duckdb
import numpy as np
import pytest

from treesift.llm.periodic_runs import find_runs, occurrences, periodic_runs
from treesift.llm.queries import QUERIES, repeated_tail


def plain_runs(words):
    """Runs by comparing the words of every distance."""
    found, n = [], len(words)
    for period in range(1, n // 4 + 1):
        i = 0
        while i < n - period:
            start = i
            while i < n - period and words[i] == words[i + period]:
                i += 1
            length = i - start + period
            part = words[start : start + length]
            if i > start and length >= max(6, 4 * period):
                if not any(part[q:] == part[:-q] for q in range(1, period)):
                    found.append((start, length, period))
            i += 1
    return sorted(found)


def expected(doc_id, text):
    """A row of the query, by the definition."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    order = repeated_tail(doc_id, len(words))
    if order is not None:
        words = [words[i] for i in order]
    runs = plain_runs(words)
    dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
    kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None,) * 3)
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    milli = None if best[0] is None else 1000 * best[1] // best[2]
    shas = [hashlib.sha256(x.encode()).hexdigest() for x in (lines, kept)]
    return (doc_id, len(runs), *best, milli, *shas)


def test_runs_of_random_words():
    rng = np.random.default_rng(1)
    for _ in range(1500):
        n, size = int(rng.integers(1, 90)), int(rng.integers(1, 5))
        words = rng.integers(1, size + 1, n)
        if rng.random() < 0.7:
            period, first = int(rng.integers(1, 12)), int(rng.integers(0, n))
            places = np.arange(n)
            words = np.where(places >= first, words[(first + (places - first) % period).clip(0, n - 1)], words)
        assert find_runs(words) == plain_runs(words.tolist())


def test_neighbouring_and_nested_runs():
    rng = np.random.default_rng(2)
    for _ in range(150):
        parts = []
        for _ in range(4):
            period = int(rng.integers(1, 40))
            base = rng.integers(1, 4, period)
            parts.append(np.tile(base, 9)[: int(rng.integers(period, 9 * period))])
        words = np.concatenate(parts)
        assert find_runs(words) == plain_runs(words.tolist())


def test_long_runs():
    assert find_runs(np.ones(300_000, dtype=np.int64)) == [(0, 300_000, 1)]
    base = np.random.default_rng(3).integers(1, 50, 5_000)
    assert find_runs(np.tile(base, 40)) == [(0, 200_000, 5_000)]


def test_zeros_part_texts():
    assert find_runs(np.array([1] * 6 + [0] + [1] * 7 + [0, 0, 0, 0, 0, 0, 0])) == [(0, 6, 1), (7, 7, 1)]


def test_occurrences_are_exact():
    rng = np.random.default_rng(4)
    for size in (1, 2, 8, 64):
        blocks = rng.integers(0, 2**20, (size, 5)).astype(np.uint64)
        windows = rng.integers(0, 2**20, (2 * size, 5)).astype(np.uint64)
        for column in range(5):
            windows[column % size : column % size + size, column] = blocks[:, column]
        found = occurrences(blocks, windows)
        for offset in range(size):
            assert (found[offset] == (windows[offset : offset + size] == blocks).all(axis=0)).all()


def test_fewer_periods_are_refused(make):
    with pytest.raises(ValueError):
        find_runs(np.ones(9, dtype=np.int64), least_periods=2)


def test_odd_rows(make):
    rows = [
        (1, "a a a a a a b"),
        (1, "a a a a a a b"),
        (2, None),
        (3, ""),
        (4, " \t\n "),
        (None, "x y x y x y x y z"),
        (5, "é é é é é é\u00a0é"),
        (6, "ab " * 20_000),
    ]
    found = periodic_runs(make(rows)).collect()
    assert {c for c in found[0].asDict()} == {"doc_id", "n_words", "runs", "best", "collapsed"}
    got = sorted((repr(r["doc_id"]), [tuple(x) for x in r["runs"]], bytes(r["collapsed"]).decode()) for r in found)
    assert got == sorted(
        [
            ("1", [(0, 6, 1)], "a b"),
            ("1", [(0, 6, 1)], "a b"),
            ("2", [], ""),
            ("3", [], ""),
            ("4", [], ""),
            ("None", [(0, 8, 2)], "x y z"),
            ("5", [], "é é é é é é\u00a0é"),
            ("6", [(0, 20_000, 1)], "ab"),
        ]
    )
    assert periodic_runs(make(rows).where("false")).collect() == []


def test_query_equals_every_stretch(spark, folder):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{folder}/documents.parquet'").fetchall()
    columns = "doc_id n_runs start length period exponent_milli runs_sha256 collapsed_sha256".split()
    short = {i: t for i, t in rows if len((t or "").split()) < 1500}
    got = {r["doc_id"]: tuple(r) for r in QUERIES["op12_periodic_runs"](spark, folder).select(columns).collect()}
    assert len(got) == len(rows) and len(short) > 100
    assert any(r[1] for r in got.values())
    assert {i: got[i] for i in short} == {i: expected(i, t) for i, t in short.items()}
