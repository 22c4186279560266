"""Token files, packing and token counts against plain encodings of whole texts."""

import zlib
from functools import lru_cache

import numpy as np
import public_tokenizers
import pytest

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    (5, None),
    (1, ""),
    (2, "<|endoftext|> x <|ENDOFTEXT|>y"),
    (3, "İstanbul áB ́c it's I'LL 12ab,,.. «x». a\x1cb a b　c É. ß, ××. +1 (499) 555-6503%%% a***."),
    (4, "the and of " * 9000),
    (7, "x" * 5000 + " " + "ab " * 3000),
    (6, "the same text"),
    (8, "the same text"),
    (9, "Σίσυφος ΑΣ ǅ ﬁ한국어 𝔘𝔫𝔦 🙂🙂,"),
    (None, "no id"),
]


@lru_cache
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def plain_ids(text):
    return [*tokenizer().encode(text or "", add_special_tokens=False).ids, 1]


def crc(ids):
    return zlib.crc32(np.asarray(ids, dtype="<u4").tobytes())


@pytest.fixture(scope="module")
def truth():
    return {i: plain_ids(t) for i, t in ODD}


def test_streams_round_trip():
    from treesift.llm.token_files import pack_ranks, unpack_ranks

    rng = np.random.default_rng(1)
    for n in (0, 1, 3, 4, 5, 1000, (1 << 20) + 3):
        ranks = (rng.integers(0, 1 << 32, n, dtype=np.uint64) >> rng.integers(0, 32, n).astype(np.uint64)).astype(np.uint32)
        control, data = pack_ranks(ranks)
        assert len(control) == -(-n // 4)
        assert (unpack_ranks(control, data, n) == ranks).all()


def test_token_files(spark, make, truth):
    from treesift.llm.token_files import digests, token_files

    rows = digests(token_files(make(ODD), PATH, 1)).collect()
    start, expected = 0, []
    for i in sorted(truth, key=lambda i: (i is not None, i)):
        expected.append((i, start, len(truth[i]), crc(truth[i])))
        start += len(truth[i])
    assert sorted(map(tuple, rows), key=lambda r: r[1]) == expected
    assert digests(token_files(make([]), PATH, 1)).count() == 0


def test_files_rank_by_frequency_and_keep_blocks_small(spark, make, truth, tmp_path):
    from collections import Counter

    from treesift.llm.token_files import read_token_files, write_token_files

    path = str(tmp_path / "files")
    write_token_files(make(ODD), path, PATH, 1, block_tokens=64)
    counts = Counter(x for ids in truth.values() for x in ids)
    ranks = [r["id"] for r in spark.read.parquet(f"{path}/ranks").orderBy("rank").collect()]
    assert ranks[: len(counts)] == sorted(counts, key=lambda i: (-counts[i], i))
    assert {r["doc_id"]: list(np.frombuffer(r["ids"], "<u4")) for r in read_token_files(spark, path).collect()} == truth


def test_packing_places_every_id_once(spark, make, truth):
    from treesift.llm.packing import packed, sequences

    twice = [r for r in ODD if r[0] is not None] + [(100 + k, "again and again " * (k % 7)) for k in range(60)]
    docs = make(twice)
    rows = packed(docs, PATH, 1).collect()
    truth = {i: plain_ids(t) for i, t in twice}
    by_sequence, covered = {}, {}
    for r in rows:
        ids = truth[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(ids) == r["length"] and crc(ids) == r["ids_crc32"] and r["doc_tokens"] == len(truth[r["doc_id"]])
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"], ids))
        covered.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
    for pieces in by_sequence.values():
        at = 0
        for offset, length, _ in sorted(pieces, key=lambda p: p[0]):
            assert offset == at
            at += length
        assert at <= 2048
    for i, ids in truth.items():
        assert sum(n for _, n in covered[i]) == len(ids) and len({s for s, _ in covered[i]}) == len(covered[i])
    whole = {r["sequence_id"]: list(np.frombuffer(r["ids"], "<u4")) for r in sequences(docs, packed(docs, PATH, 1), PATH, 1).collect()}
    assert whole == {s: [x for _, _, ids in sorted(p, key=lambda q: q[0]) for x in ids] for s, p in by_sequence.items()}
    assert packed(make([]), PATH, 1).count() == 0


def test_repeated_rows_are_packed_apart(make):
    from treesift.llm.packing import packed

    rows = packed(make([(1, "a b"), (1, "a b"), (None, None), (None, None)]), PATH, 1).collect()
    assert len(rows) == 4 and len({(r["sequence_id"], r["offset"]) for r in rows}) == 4


def test_patterns_hold_the_demand_with_little_padding():
    from treesift.llm.packing import whole_patterns

    rng = np.random.default_rng(0)
    for lengths in (rng.integers(1, 257, 3000), np.full(500, 100), np.array([256]), np.minimum(256, rng.lognormal(3, 1, 4000).astype(int) + 1)):
        sizes, demand = np.unique(lengths, return_counts=True)
        plan = whole_patterns(sizes, demand, 256)
        assert (sum(p * k for p, k in plan) == demand).all()
        assert all((p * sizes).sum() <= 256 for p, _ in plan)
        used = sum(k for _, k in plan)
        # No plan beats the volume, nor one sequence for each two pieces longer than a half.
        least = max(-(-int((sizes * demand).sum()) // 256), int(demand[sizes > 128].sum()), -(-len(lengths) // (256 // sizes.min())))
        assert used <= 1.02 * least + 2


@pytest.mark.parametrize("rule", ["first", "last", "largest"])
def test_token_counts_against_every_token(make, rule):
    from treesift.llm.encoders import span_encoder
    from treesift.llm.token_counts import token_counts

    ranks, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    texts = [(1, "a\n\n\nb  \n c"), (2, None), (3, ""), (4, "é ü\n🙂\n\n" * 200), (None, "x\ny\n"), (5, "\n")]
    found = token_counts(make(texts), ranks, pattern, rule=rule).collect()
    for i, text in texts:
        text = text or ""
        _, ends = span_encoder(ranks, pattern).encode(text)
        raw = text.encode()
        lines = raw.splitlines(keepends=True) if raw else [b""]
        starts = np.cumsum([0, *map(len, lines)])
        counts, begin = [0] * len(lines), 0
        for end in ends:
            shares = [min(end, starts[k + 1]) - max(begin, starts[k]) for k in range(len(lines))]
            touched = [k for k, s in enumerate(shares) if s > 0]
            k = {"first": touched[0], "last": touched[-1], "largest": max(touched, key=lambda k: (shares[k], -k))}[rule]
            counts[k] += 1
            begin = end
        rows = sorted((r for r in found if r["doc_id"] == i), key=lambda r: r["section"])
        assert [r["n_tokens"] for r in rows] == counts
        assert sum(counts) == len(ends) == rows[0]["doc_tokens"]
        assert [r["n_chars"] for r in rows] == [len(x.decode()) for x in lines]
    assert token_counts(make([]), ranks, pattern).count() == 0


def test_token_counts_of_fields(spark):
    from treesift.llm.token_counts import token_counts

    ranks, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    docs = spark.createDataFrame([(1, "title", None, "one two\nthree")], "doc_id bigint, a string, b string, c string")
    rows = token_counts(docs, ranks, pattern, fields=("a", "b", "c")).orderBy("start").collect()
    assert [(r["field"], r["section"]) for r in rows] == [(0, 0), (1, 0), (2, 0), (2, 1)]
    assert sum(r["n_tokens"] for r in rows) == rows[0]["doc_tokens"]
