"""Benchmark decontamination: a BM25 inverted index of test items, block-max WAND, overlap checks.

Test items are the indexed documents, passages of training texts are the queries. An item scores the sum
of its BM25 impacts over the passage's distinct words; it is retrieved if that reaches ``SHARE`` of the
sum over all its own words. Items lie in blocks of ``BLOCK``; for each word and block the index keeps the
largest impact. A passage's sum of these bounds every score in the block; blocks that stay below their
smallest threshold are left out (for all passages of a text at once, in numpy), in the others WAND moves
cursors of the postings from pivot to pivot. Nothing above a threshold is missed.

A passage is two neighbouring cells of a text, a cell being as many words as the longest item of the
benchmark, so that every item that a text holds lies in one passage. The index is broadcast in shards of at
most ``SHARD_ITEMS`` items and ``SHARD_BYTES`` of text; each shard is one more pass over the texts. Item
count, word frequencies, mean and greatest length are those of the whole benchmark without repeated rows.

Verification: 5-word shingles (or the whole, if shorter) of the item's question and answer within the
passage. The answer is what follows the last question mark, else the last sentence if there are several.
An item is leaked if in any retrieved passage both overlaps, or the overlap of the whole item, reach
``percent`` / 100; scores and overlaps are reported of the passage with the best whole overlap.

Null and empty texts hold nothing; null and empty items match nothing; a null item id is kept as null.
Items that repeat an id count as one id, with the best of their scores. Rows that repeat a document
repeat its results once per document id. Ties do not matter. Empty tables give no rows; other columns
are not read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treesift.llm.common import keep_texts, map_texts, narrow, raw_texts, stored

SHARE = 0.7
BLOCK = 8
SHARD_ITEMS = 1024
SHARD_BYTES = 8 << 20
K1, B = 1.2, 0.75
SHINGLE = 5
_WORD = re.compile(r"\w+")
_BREAK = re.compile(r"(?<=[.!?])\s+|\n+")
_CELLS = 1 << 15


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """Words of the question and of the answer, which may be empty."""
    head, mark, tail = text.rstrip().rstrip("?").rpartition("?")
    if mark and words_of(head):
        return words_of(head), words_of(tail)
    parts = [p for p in _BREAK.split(text) if words_of(p)]
    if len(parts) < 2:
        return words_of(text), []
    return words_of(" ".join(parts[:-1])), words_of(parts[-1])


def shingles(ids: list[int]) -> set[tuple[int, ...]]:
    if len(ids) < SHINGLE:
        return {tuple(ids)} if ids else set()
    return {tuple(ids[k : k + SHINGLE]) for k in range(len(ids) - SHINGLE + 1)}


def overlap(wanted: list[int], there: list[int]) -> float:
    """Share of the shingles of ``wanted`` in ``there``; 1 if nothing is wanted."""
    goal = shingles(wanted)
    if not goal:
        return 1.0
    width = min(len(wanted), SHINGLE)
    have = {tuple(there[k : k + width]) for k in range(len(there) - width + 1)}
    return len(goal & have) / len(goal)


@dataclass(frozen=True)
class Totals:
    """What scores and passages take from the whole benchmark, however it is dealt into shards."""

    items: int
    mean: float  # words of an item
    longest: int
    frequency: dict[str, int]  # items that hold a word


@dataclass
class ItemIndex:
    """Postings and block maxima of one shard of items."""

    ids: list
    vocabulary: dict[str, int] = field(default_factory=dict)

    @classmethod
    def build(cls, items: list[tuple[object, str]], totals: Totals | None = None) -> ItemIndex:
        """The index of a shard; without ``totals`` the shard is the whole benchmark."""
        items = [(i, t, words_of(t)) for i, t in items if t]
        items = sorted((x for x in items if x[2]), key=lambda x: len(x[2]))  # like lengths share blocks
        index = cls([i for i, _, _ in items])
        known = index.vocabulary
        index.items, index.parts = [], []
        for _, text, words in items:
            index.items.append([known.setdefault(w, len(known)) for w in words])
            index.parts.append(tuple([known[w] for w in part] for part in question_and_answer(text)))
        n, size = len(items), len(known)
        frequency = np.zeros(size)
        for row in index.items:
            frequency[list(set(row))] += 1
        if totals is None:
            mean, longest = sum(map(len, index.items)) / max(n, 1), max(map(len, index.items), default=1)
            idf = np.log1p((n - frequency + 0.5) / (frequency + 0.5))
        else:
            mean, longest = totals.mean, totals.longest
            frequency = np.array([totals.frequency[w] for w in known], dtype=float)
            idf = np.log1p((totals.items - frequency + 0.5) / (frequency + 0.5))
        index.blocks = -(-n // BLOCK)
        index.maxima = np.zeros((size, index.blocks), dtype=np.float32)
        index.postings = [[] for _ in range(size)]
        own = np.zeros(n)
        for at, row in enumerate(index.items):
            counts: dict[int, int] = {}
            for t in row:
                counts[t] = counts.get(t, 0) + 1
            for t, c in counts.items():
                impact = float(idf[t] * c * (K1 + 1) / (c + K1 * (1 - B + B * len(row) / mean)))
                index.postings[t].append((at, impact))
                own[at] += impact
                index.maxima[t, at // BLOCK] = max(index.maxima[t, at // BLOCK], impact * (1 + 1e-6))
        index.own = own
        index.thresholds = own * SHARE
        index.least = np.array([index.thresholds[b * BLOCK : (b + 1) * BLOCK].min() for b in range(index.blocks)])
        index.cell = longest
        return index

    def wand(self, terms: list[int], block: int) -> list[tuple[int, float]]:
        """Items of ``block`` whose score reaches their threshold."""
        low, high = block * BLOCK, (block + 1) * BLOCK
        cursors = []  # [postings within the block, place, bound]
        for t in terms:
            bound = float(self.maxima[t, block])
            if bound > 0:
                cursors.append([[p for p in self.postings[t] if low <= p[0] < high], 0, bound])
        found, border = [], float(self.least[block]) * (1 - 1e-6)
        while cursors:
            cursors.sort(key=lambda c: c[0][c[1]][0])
            total, pivot = 0.0, -1
            for k, c in enumerate(cursors):
                total += c[2]
                if total >= border:
                    pivot = k
                    break
            if pivot < 0:
                break
            item = cursors[pivot][0][cursors[pivot][1]][0]
            if cursors[0][0][cursors[0][1]][0] == item:
                score = 0.0
                for c in cursors:
                    if c[0][c[1]][0] == item:
                        score += c[0][c[1]][1]
                        c[1] += 1
                if score >= self.thresholds[item] * (1 - 1e-9):
                    found.append((item, score))
            else:
                for c in cursors[:pivot]:
                    while c[1] < len(c[0]) and c[0][c[1]][0] < item:
                        c[1] += 1
            cursors = [c for c in cursors if c[1] < len(c[0])]
        return found

    def open_blocks(self, ids: np.ndarray) -> list[tuple[int, int]]:
        """(cell, block) of passages, each two cells from there, whose bound reaches the block's border."""
        at = np.flatnonzero(ids >= 0)
        if not len(at):
            return []
        size = len(self.vocabulary)
        key = np.unique(at // self.cell * size + ids[at])
        cells, terms = key // size, key % size
        edges = np.flatnonzero(np.concatenate([[True], cells[1:] != cells[:-1]]))
        sums = np.zeros((-(-len(ids) // self.cell) + 1, self.blocks), dtype=np.float32)
        sums[cells[edges]] = np.add.reduceat(self.maxima[terms], edges, axis=0)
        bounds = sums[:-1] + sums[1:]
        rows, blocks = np.nonzero(bounds >= self.least[None, :] * (1 - 1e-5))
        return list(zip(rows.tolist(), blocks.tolist()))

    def search(self, text: str, percent: int) -> dict[int, tuple[float, float, float, float, bool]]:
        """By item: the best score, overlaps of question, answer and whole, and whether any passage leaks it."""
        words = words_of(text)
        best: dict[int, tuple[float, float, float, float, bool]] = {}
        step = self.cell * max(1, _CELLS // self.cell)
        for k in range(0, len(words), step):  # long texts in parts that share a cell
            ids = np.fromiter(map(self.vocabulary.get, words[k : k + step + self.cell], repeat(-1)), dtype=np.int64)
            for cell, block in self.open_blocks(ids):
                passage = ids[cell * self.cell : (cell + 2) * self.cell]
                terms = np.unique(passage[passage >= 0])
                # A word of both cells counted twice in the first bound.
                bounds = self.maxima[terms, block]
                if bounds.sum() < self.least[block] * (1 - 1e-5):
                    continue
                there = passage.tolist()
                for item, score in self.wand(terms[bounds > 0].tolist(), block):
                    question, answer = self.parts[item]
                    seen = (score, overlap(question, there), overlap(answer, there), overlap(self.items[item], there))
                    old = best.get(item)
                    leaked = is_leak(*seen[1:], percent) or (old is not None and old[4])
                    if old is not None and (old[3], old[:4]) >= (seen[3], seen):
                        seen = old[:4]
                    best[item] = (*seen, leaked)
        return best


def _shards(items: DataFrame):
    """Lists of (id, text) within the bounds of a shard, with the totals of all shards if there are several."""
    items = items.distinct()
    size = items.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()
    shards = max(1, -(-size["n"] // SHARD_ITEMS), -(-size["b"] // SHARD_BYTES))
    if shards > 1:  # hashing is even, with room for chance
        shards = -(-shards * 5 // 4)
    if shards == 1:
        if size["n"]:
            yield [(r["item_id"], r["text"]) for r in items.collect()], None
        return
    items = stored(items.withColumn("shard", F.pmod(F.xxhash64("item_id", "text"), F.lit(shards))), "items")

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [words_of(t.decode()) for t in raw_texts(batch, "text")]
        arrays = [batch.column("shard"), pa.array(map(len, rows), pa.int64()), pa.array([sorted(set(r)) for r in rows], pa.list_(pa.string()))]
        return pa.RecordBatch.from_arrays(arrays, ["shard", "n", "words"])

    counted = stored(map_texts(items.select("shard", "text"), count, "shard bigint, n bigint, words array<string>"), "item-words")
    whole = counted.where("n > 0").agg(F.count("*").alias("n"), F.avg("n").alias("mean"), F.max("n").alias("longest")).first()
    words = counted.select("shard", F.explode("words").alias("word")).groupBy("word", "shard").count()
    held = words.groupBy("word").agg(F.sum("count").alias("items"))
    held = stored(words.join(held, "word").select("shard", "word", "items"), "item-frequencies")
    for k in range(shards):
        frequency = {r["word"]: r["items"] for r in held.where(F.col("shard") == k).collect()}
        totals = Totals(whole["n"], whole["mean"] or 0.0, whole["longest"] or 1, frequency)
        yield [(r["item_id"], r["text"]) for r in items.where(F.col("shard") == k).collect()], totals


def leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    percent: int = 80,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """Retrieved pairs: ``doc_id``, ``item_id``, ``score`` (share of the item's own), ``question_overlap``,
    ``answer_overlap``, ``item_overlap`` and ``leaked``."""
    docs = narrow(docs, doc_id=id_col, text=text_col)
    spark = docs.sparkSession
    schema = (
        "doc_id bigint, item_id bigint, score double, question_overlap double, answer_overlap double, item_overlap double,"
        " leaked boolean"
    )
    found = spark.createDataFrame([], schema)
    for items, totals in _shards(narrow(benchmark, item_id=item_col, text=item_text_col)):
        index = ItemIndex.build(items, totals)
        if not index.ids:
            continue
        shared = spark.sparkContext.broadcast(index)  # bounded by SHARD_ITEMS and SHARD_BYTES

        def worker(batch: pa.RecordBatch, shared=shared) -> pa.RecordBatch:
            index = shared.value
            owner, rows = [], []
            for i, text in enumerate(raw_texts(batch, "text")):
                for item, (score, q, a, whole, leaked) in index.search(text.decode(), percent).items():
                    owner.append(i)
                    rows.append((index.ids[item], score / float(index.own[item]), q, a, whole, leaked))
            columns = list(zip(*rows)) or [()] * 6
            arrays = [batch.column("doc_id").take(pa.array(owner, pa.int64())), pa.array(columns[0], pa.int64())]
            arrays += [pa.array(c, pa.float64()) for c in columns[1:5]] + [pa.array(columns[5], pa.bool_())]
            return pa.RecordBatch.from_arrays(arrays, [c.split()[0] for c in schema.split(", ")])

        found = found.union(map_texts(docs, worker, schema))
    names = ["score", "question_overlap", "answer_overlap", "item_overlap", "leaked"]
    return found.groupBy("doc_id", "item_id").agg(*[F.max(n).alias(n) for n in names])


def is_leak(question: float, answer: float, whole: float, percent: int) -> bool:
    border = percent / 100
    return (question >= border and answer >= border) or whole >= border


def without_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    percent: int = 80,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """The rows of ``docs``, with all their columns, that hold no test item."""
    kept = docs
    for items, totals in _shards(narrow(benchmark, item_id=item_col, text=item_text_col)):
        index = ItemIndex.build(items, totals)
        if not index.ids:
            continue
        shared = docs.sparkSession.sparkContext.broadcast(index)  # bounded by SHARD_ITEMS and SHARD_BYTES

        def decide(texts: list[bytes], shared=shared) -> list[bool]:
            found = (shared.value.search(t.decode(), percent).values() for t in texts)
            return [not any(leaked for *_, leaked in hits) for hits in found]

        kept = keep_texts(kept, decide, text_col)
    return kept
