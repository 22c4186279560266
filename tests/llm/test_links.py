"""Near-duplicates, embeddings, components and decontamination against brute force."""

import re
from collections import defaultdict

import numpy as np
import pytest

from samples import words


def classes(nodes, pairs):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def plain_set(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def plain_links(sets, percent):
    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            n = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * n >= percent * len(sets[a] | sets[b]):
                yield a, b


def family(rng, base, copies, edits):
    out = []
    for _ in range(copies):
        w = base.split()
        for _ in range(edits):
            w[int(rng.integers(len(w)))] = f"e{rng.integers(10**6)}"
        out.append(" ".join(w))
    return out


def near_rows():
    rng = np.random.default_rng(4)
    texts = [words(rng, int(rng.integers(1, 200))) for _ in range(60)]
    for edits, copies in ((1, 12), (2, 20), (4, 25)):
        base = words(rng, 220)
        texts += [base, base.upper()] + family(rng, base, copies, edits)
    chain = words(rng, 300).split()
    texts += [" ".join(chain[5 * k : 5 * k + 240]) for k in range(8)]
    texts += [None, "", " \t\n", "one two", "ONE  two", "one two three four", "a\x1cb c", "a b c", "long " * 30_000]
    return [(int(i), t) for i, t in zip(rng.permutation(len(texts)) + 3, texts)]


@pytest.mark.parametrize("percent", [85, 80])
def test_near_duplicates_against_all_pairs(make, percent):
    from treesift.llm.near_dedup import near_duplicates

    rows = near_rows()
    sets = {i: plain_set(t) for i, t in rows}
    roots = classes(sets, plain_links(sets, percent))
    found = near_duplicates(make(rows + rows[:5] + [(None, "one two")]), percent).collect()
    assert len(found) == len(rows) + 6
    for r in found:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            i = r["doc_id"]
            assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[i]), roots[i], roots[i] == i)


def test_documents_across_a_large_group_are_compared(make, monkeypatch):
    """Without the first buckets, tables alone must find the same groups."""
    from treesift.llm import near_dedup

    monkeypatch.setattr(near_dedup, "FIRST_BUCKETS", 0)
    rows = near_rows()
    sets = {i: plain_set(t) for i, t in rows}
    roots = classes(sets, plain_links(sets, 85))
    assert {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(make(rows)).collect()} == roots


def test_near_duplicates_of_nothing(make):
    from treesift.llm.near_dedup import near_duplicates, one_of_each

    assert near_duplicates(make([])).count() == 0
    assert [r["component_id"] for r in near_duplicates(make([(1, None), (2, None)])).orderBy("doc_id").collect()] == [1, 2]
    docs = make([(1, "a b c"), (2, "A b c"), (3, None)])
    kept = one_of_each(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 3]


def test_components(spark):
    from treesift.llm.components import components

    rng = np.random.default_rng(2)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(1000 + k, 1001 + k) for k in range(90)]
    pairs += [(5000, 5001 + k) for k in range(300)] + [(7, 7)]
    links = spark.createDataFrame([*pairs, (None, 3)], "a bigint, b bigint")
    roots = classes({x for p in pairs for x in p}, pairs)
    found = {r["node"]: r["component"] for r in components(links).collect()}
    assert found == {n: r for n, r in roots.items() if n != r}


def vector_rows():
    rng = np.random.default_rng(8)
    rows, i = [], 0
    for label in (0, 1, None):
        base = rng.normal(size=(40, 24))
        for v in base:
            rows.append((i := i + 1, v.tolist(), label))
        for v in base[:8]:
            for scale in (0.02, 0.1, 0.13, 0.2):
                near = v + scale * rng.normal(size=24)
                rows += [((i := i + 1), near.tolist(), label), ((i := i + 1), (near * 1e3).tolist(), label)]
        rows += [((i := i + 1), base[0].tolist(), label) for _ in range(5)]
    odd = [None, [], [0.0] * 24, [1.0, None] + [0.0] * 22, [float("nan")] * 24, [float("inf")] + [1.0] * 23, [1.0] * 3, [2.0] * 3]
    return rows + [((i := i + 1), v, 0) for v in odd]


@pytest.mark.parametrize("block_bytes", [128 << 10, 24 * 4 * 7])
def test_embeddings_against_all_pairs(spark, block_bytes):
    from treesift.llm.embedding_dedup import embedding_duplicates

    rows = vector_rows()
    docs = spark.createDataFrame([(*r, "x") for r in rows] + [(None, rows[0][1], 0, "x")], "vec_id bigint, embedding array<float>, label int, node string")
    sound = {}
    for i, v, label in rows:
        if v and label is not None and None not in v:
            x = np.array(v, dtype=np.float32).astype(float)
            if np.isfinite(x).all() and x.any():
                sound[i] = (label, x / np.linalg.norm(x))
    pairs = [
        (a, b)
        for a in sound
        for b in sound
        if a < b and sound[a][0] == sound[b][0] and len(sound[a][1]) == len(sound[b][1]) and sound[a][1] @ sound[b][1] >= 0.98
    ]
    roots = classes([i for i, _, _ in rows], pairs)
    links = defaultdict(int)
    for a, b in pairs:
        links[a] += 1
        links[b] += 1
    found = embedding_duplicates(docs, block_bytes=block_bytes).collect()
    assert len(found) == len(rows) + 1
    for r in found:
        i = r["vec_id"]
        if i is not None:
            assert (r["n_links"], r["component_id"], r["kept"]) == (links[i], roots[i], roots[i] == i)
        else:
            assert r["n_links"] == 0 and r["component_id"] is None and r["kept"]
    assert embedding_duplicates(docs.limit(0)).count() == 0


def test_embeddings_with_empty_blocks(spark):
    from treesift.llm.embedding_dedup import embedding_duplicates

    base = np.random.default_rng(5).normal(size=16)
    rows = [(i, (base * (i + 1)).tolist(), 0) for i in range(12)]
    docs = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    found = embedding_duplicates(docs, block_bytes=16 * 4).collect()
    assert {(r["vec_id"], r["n_links"], r["component_id"]) for r in found} == {(i, 11, 0) for i in range(12)}


def test_quantisation_bound_holds():
    from treesift.llm.embedding_dedup import Block

    rng = np.random.default_rng(3)
    x, y = (Block(range(200), [1] * 200, rng.normal(size=(200, 70)) ** 3) for _ in range(2))
    near = (x.codes.astype(float) * x.step[:, None]) @ (y.codes.astype(float) * y.step[:, None]).T
    bound = x.size[:, None] * y.error + x.error[:, None] * (y.size + y.error)
    assert (np.abs(x.unit @ y.unit.T - near) <= bound).all()


ITEMS = [
    (0, "What is the colour of the harbour lamp at dusk near the mill? A deep amber that fades to red."),
    (1, "A river runs past nine old mills before it meets the salted lake.\nIt then turns north again."),
    (2, "short item"),
    (3, None),
    (4, ""),
    (5, "A river runs past nine old mills before it meets the salted lake.\nIt then turns south for a while."),
]


def test_leaks_against_plain_search(make, spark, monkeypatch):
    from treesift.llm import decontamination as D

    rng = np.random.default_rng(6)
    pool = sorted({w for _, t in ITEMS if t for w in D.words_of(t)})
    texts = []
    for k in range(150):
        w = [str(x) for x in rng.choice(pool + [f"w{j}" for j in range(40)], int(rng.integers(0, 120)))]
        item = ITEMS[int(rng.integers(len(ITEMS)))][1]
        if k % 3 == 0 and item:
            own = item.split()
            if k % 2:
                own[int(rng.integers(len(own)))] = "edited"
            at = int(rng.integers(0, len(w) + 1))
            w[at:at] = own
        texts.append((k, " ".join(w)))
    texts += [(200, None), (201, ""), (None, ITEMS[0][1]), (202, "pad " * 70_000 + ITEMS[1][1])]

    def plain(text):
        have = D.words_of(text or "")
        for i, item in ITEMS:
            w = D.words_of(item or "")
            if not w:
                continue
            q, a = D.question_and_answer(item)
            spans = [have[k : k + 2 * 24] for k in range(0, max(1, len(have)), 12)]
            if any(D.is_leak(D.overlap(q, s), D.overlap(a, s), D.overlap(w, s), 80) for s in spans):
                yield i

    items = spark.createDataFrame([(i, t, "x") for i, t in ITEMS], "item_id bigint, text string, score string")
    expected = {(d, i) for d, t in texts for i in plain(t)}
    docs = make(texts)
    for size in (1024, 2):
        monkeypatch.setattr(D, "SHARD_ITEMS", size)
        found = D.leaks(docs, items).where("leaked").collect()
        got = {(r["doc_id"], r["item_id"]) for r in found}
        # Scores do not see order: whole items are always retrieved, and nothing is that brute force refuses.
        assert {p for p in expected if p[1] != 2} <= got | {p for p in expected if p not in got and p[1] == 2}
        assert {p for p in got if p[1] != 2} <= expected
        kept = D.without_leaks(docs, items)
        assert kept.columns == docs.columns
        assert {r["doc_id"] for r in kept.collect()} == {d for d, _ in texts} - {d for d, _ in got}
    assert D.leaks(make([]), items).count() == 0
    assert D.leaks(docs, items.limit(0)).count() == 0


def test_results_do_not_depend_on_shards(make, spark, monkeypatch):
    from treesift.llm import decontamination as D

    rng = np.random.default_rng(9)
    items = [(k, " ".join(f"w{int(x)}" for x in rng.zipf(1.4, int(rng.integers(4, 60))) % 80)) for k in range(24)]
    table = spark.createDataFrame(items + [items[0]] * 9 + [(50, None), (51, "...")], "item_id bigint, text string")
    texts = [(k, " ".join([words(rng, 50, 80), items[k][1][: int(rng.integers(20, 300))], words(rng, 50, 80)])) for k in range(24)]
    docs = make(texts)
    found = []
    for size in (1024, 8):
        monkeypatch.setattr(D, "SHARD_ITEMS", size)
        rows = D.leaks(docs, table).collect()
        found.append({(r["doc_id"], r["item_id"]): tuple(round(x, 9) for x in r[2:]) for r in rows})
    assert found[0] and found[0] == found[1]


def test_a_leak_is_not_hidden_by_a_better_whole_overlap(make, spark):
    from treesift.llm import decontamination as D

    question, answer = "one two three four five six", "red blue green gold pink grey"
    items = spark.createDataFrame([(1, f"{question}? {answer}.")], "item_id bigint, text string")
    parted = f"{question} pad pad pad pad pad {answer}"
    partial = f"{question} red blue green"
    docs = make([(1, parted), (2, partial), (3, " ".join([parted, "pad " * 60, partial])), (4, " ".join([partial, "pad " * 63, parted]))])
    found = {r["doc_id"]: r for r in D.leaks(docs, items).collect()}
    assert {i for i, r in found.items() if r["leaked"]} == {1, 3, 4}
    assert found[3]["item_overlap"] == found[2]["item_overlap"] > found[1]["item_overlap"]
    assert [r["doc_id"] for r in D.without_leaks(docs, items).collect()] == [2]


def test_wand_retrieves_all_above_the_threshold():
    from treesift.llm import decontamination as D

    rng = np.random.default_rng(7)
    items = [(k, " ".join(f"w{int(x)}" for x in rng.zipf(1.4, int(rng.integers(3, 30))) % 300)) for k in range(100)]
    index = D.ItemIndex.build(items)
    for k in range(60):
        text = " ".join(f"w{int(x)}" for x in rng.zipf(1.4, 40) % 300) + " " + items[k][1]
        ids = np.array([index.vocabulary.get(w, -1) for w in D.words_of(text)])
        terms = sorted(set(ids[ids >= 0].tolist()))
        scores = np.zeros(len(index.ids))
        for t in terms:
            for at, impact in index.postings[t]:
                scores[at] += impact
        found = {i for b in range(index.blocks) for i, _ in index.wand(terms, b)}
        assert found == set(np.flatnonzero(scores >= index.thresholds * (1 - 1e-9)).tolist())


def test_embeddings_that_share_an_id(spark):
    from treesift.llm.embedding_dedup import embedding_duplicates

    rows = [(1, [1.0, 0.0], 0), (1, [0.0, 1.0], 0), (2, [1.0, 0.001], 0), (3, [0.001, 1.0], 0), (4, [1.0, 0.002], 0), (1, [1.0, 0.0], 0)]
    docs = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    found = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in embedding_duplicates(docs).collect())
    assert found == [(1, 1, 1), (1, 3, 1), (1, 3, 1), (2, 3, 1), (3, 1, 1), (4, 3, 1)]


def test_one_row_of_each_repeated_row(make):
    from treesift.llm.near_dedup import one_of_each

    text = "one two three four five six seven eight"
    rows = [(1, text), (1, text), (2, text + " nine"), (3, "other words"), (3, "quite another text"), (None, "x"), (None, "x"), (4, None), (4, None)]
    kept = one_of_each(make(rows), percent=80)
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=repr) == sorted(
        [(1, text), (3, "other words"), (3, "quite another text"), (None, "x"), (4, None)], key=repr
    )
