"""MinHash near-duplicates with tensored banding, links confirmed on full shingle sets.

Two collections of ``SIDE`` hashes each join ``ROWS`` minhashes; table keys are all pairs of one hash of
either collection. So ``2 * SIDE * ROWS`` minhashes serve ``SIDE ** 2`` tables of ``2 * ROWS`` rows. Two
sets of similarity s meet in a table with probability ``(1 - (1 - s**ROWS) ** SIDE) ** 2``: at 0.85 all
but 2 pairs in 100,000, at 0.8 all but 4 in 10,000.

Documents with equal sets are one class, which its smallest id stands for. Table keys are formed late:
a pair that meets in a table meets in a hash of the first collection, so only documents whose first
hash is shared go on. Candidates are not all pairs of a table:

1. in a few buckets of the first collection every document is compared with the smallest, by joins;
2. documents of tables that still hold several components form clusters (a cluster is what shared tables
   connect). In each, the documents outside the cluster's main component are compared with all others, in
   tiles of two blocks of bounded size. A tile compares minhashes first, then full sets from the most
   similar pair on, skips pairs that are connected by then, and returns links, never its pairs.

A pair left out is inside one component already, or its minhashes agree so seldom that a linked pair does
so once in ``1 / MISSED``. So no component is lost, and a group's size costs no square of pairs unless its
documents are in truth unlike one another.

A document's set is that of its 5-word shingles (words between ASCII white space, A-Z lower-cased), the
whole sequence if it has fewer words. Null texts and texts without words have empty sets and are linked
with nothing. A null id is linked with nothing either: its component is null, and it is kept. Rows that
repeat id and text get the same result; rows that share an id are one node, linked through any of their
texts. An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treesift.llm.common import map_texts, narrow, raw_texts, stored
from treesift.llm.components import components

WORDS = 5
ROWS = 3
SIDE = 12
FIRST_BUCKETS = 3
BLOCK_SHINGLES = 100_000
MISSED = 1e-5
_WORDS_KEPT = 300_000
_STEP = 1 << 14
_P = np.uint64(0x9E3779B97F4A7C15)
_Q = np.uint64(0xBF58476D1CE4E5B9)
_RNG = np.random.default_rng(20_061)
_FACTORS = _RNG.integers(1, 1 << 63, 2 * SIDE * ROWS, dtype=np.uint64) | np.uint64(1)
_SHIFTS = _RNG.integers(0, 1 << 63, 2 * SIDE * ROWS, dtype=np.uint64)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > _WORDS_KEPT:
            self.clear()
        self[word] = found = xxhash.xxh3_64_intdigest(word)
        return found


_HASHES = _WordHashes()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _Q
    return x ^ (x >> np.uint64(29))


def shingle_hashes(text: bytes, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles."""
    parts = text.lower().split()  # bytes: A-Z and ASCII white space only
    if not parts:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(_HASHES.__getitem__, parts), dtype=np.uint64, count=len(parts))
    width = min(words, len(h))
    mix = h[: len(h) - width + 1].copy()
    for k in range(1, width):
        mix = mix * _P + h[k : len(h) - width + 1 + k]
    return np.unique(_mixed(mix + np.uint64(width)))


def minhashes(found: np.ndarray) -> np.ndarray:
    """The smallest value of each hash function; ``found`` is not empty."""
    least = np.full(len(_FACTORS), np.iinfo(np.uint64).max, dtype=np.uint64)
    for k in range(0, len(found), _STEP):
        values = found[None, k : k + _STEP] * _FACTORS[:, None]
        values += _SHIFTS[:, None]
        np.minimum(least, values.min(axis=1), out=least)
    return least


def sketches(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``h1`` and ``h2`` (digest of the set), ``left`` and ``right`` hashes."""

    def worker(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes, h1, h2, left, right = [], [], [], [], []
        place = np.arange(2 * SIDE, dtype=np.uint64)
        for text in raw_texts(batch, "text"):
            found = shingle_hashes(text)
            sizes.append(len(found))
            if not len(found):
                h1.append(None), h2.append(None), left.append(None), right.append(None)
                continue
            digest = np.frombuffer(hashlib.blake2b(found.tobytes(), digest_size=16).digest(), dtype="<i8")
            h1.append(int(digest[0])), h2.append(int(digest[1]))
            rows = minhashes(found).reshape(2 * SIDE, ROWS)
            keys = place.copy()
            for r in range(ROWS):
                keys = _mixed(keys * _P + rows[:, r])
            keys = keys.view(np.int64)
            left.append(keys[:SIDE].tolist()), right.append(keys[SIDE:].tolist())
        long, longs = pa.int64(), pa.list_(pa.int64())
        columns = [pa.array(x, t) for x, t in ((sizes, long), (h1, long), (h2, long), (left, longs), (right, longs))]
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *columns], ["doc_id", "n_shingles", "h1", "h2", "left", "right"]
        )

    schema = "doc_id bigint, n_shingles bigint, h1 bigint, h2 bigint, left array<bigint>, right array<bigint>"
    return map_texts(docs, worker, schema)


def shingle_sets(docs: DataFrame) -> DataFrame:
    """``node`` and the full ``shingles`` of its text."""

    def worker(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingle_hashes(t).view(np.int64) for t in raw_texts(batch, "text")]
        return pa.RecordBatch.from_arrays(
            [batch.column("node"), pa.array(sets, pa.list_(pa.int64()))], ["node", "shingles"]
        )

    return map_texts(docs, worker, "node bigint, shingles array<bigint>")


def similar(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` (``a``, ``b``) whose full sets have 100 * intersection >= percent * union."""
    first = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    second = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    common = F.size(F.array_intersect("x", "y"))
    both = pairs.join(first, "a").join(second, "b").select("a", "b", common.alias("n"), (F.size("x") + F.size("y")).alias("t"))
    return stored(both.where(100 * F.col("n") >= percent * (F.col("t") - F.col("n"))).select("a", "b"), "confirmed")


def least_matches(percent: int, hashes: int = 2 * SIDE * ROWS) -> int:
    """Agreeing minhashes that a pair of similarity ``percent`` / 100 falls short of with a chance of at
    most ``MISSED``."""
    p, tail, chance = percent / 100, 0.0, (1 - percent / 100) ** hashes
    for k in range(hashes + 1):
        tail += chance
        if tail > MISSED:
            return k
        chance *= (hashes - k) / (k + 1) * p / (1 - p) if p < 1 else 0.0
    return hashes


def _tile(percent: int):
    least = least_matches(percent)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["side", "node"])
        nodes, parts = frame["node"].to_numpy(), frame["component"].to_numpy()
        sets = [np.asarray(x, dtype=np.int64).view(np.uint64) for x in frame["shingles"]]
        sizes = np.array([len(x) for x in sets])
        marks = np.stack([_mixed(minhashes(x)).astype(np.uint8) for x in sets])
        side = frame["side"].to_numpy()
        rows, columns = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        own = not len(columns)  # a block with itself
        columns = rows if own else columns
        found: list[tuple[int, int, int]] = []
        for i in rows.tolist():
            others = columns[columns > i] if own else columns
            fits = 100 * np.minimum(sizes[others], sizes[i]) >= percent * np.maximum(sizes[others], sizes[i])
            others = others[fits & (parts[others] != parts[i])]
            agree = (marks[others] == marks[i]).sum(axis=1)
            found += [(-int(n), i, int(j)) for n, j in zip(agree, others) if n >= least]
        above: dict[int, int] = {}

        def root(x: int) -> int:
            while above.get(x, x) != x:
                above[x] = x = above.get(above[x], above[x])
            return x

        a, b = [], []
        for _, i, j in sorted(found):
            x, y = root(int(parts[i])), root(int(parts[j]))
            if x == y:
                continue
            n = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if 100 * n >= percent * (sizes[i] + sizes[j] - n):
                above[max(x, y)] = min(x, y)
                a.append(int(nodes[i])), b.append(int(nodes[j]))
        return pd.DataFrame({"a": pd.Series(a, dtype="int64"), "b": pd.Series(b, dtype="int64")})

    return run


def _across(tables: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between components of one cluster. ``tables``: ``node``, ``key``, ``component``."""
    least = tables.groupBy("key").agg(F.min("node").alias("b"))
    clusters = components(tables.join(least, "key").select(F.col("node").alias("a"), "b"))
    members = tables.select("node", "component").distinct().join(clusters.withColumnRenamed("component", "cluster"), "node", "left")
    members = members.withColumn("cluster", F.coalesce("cluster", "node"))
    main = members.groupBy("cluster", "component").agg(F.count("*").alias("n"))
    main = main.groupBy("cluster").agg(F.max_by("component", F.struct("n", "component")).alias("main"))
    members = members.join(main, "cluster").withColumn("rest", F.col("component") != F.col("main")).drop("main")
    members = stored(members.join(sets, "node"), "cluster-sets")
    # Blocks of about BLOCK_SHINGLES; those of the rest meet all blocks, those of the main part the rest.
    weight = members.groupBy("cluster").agg(
        *[
            F.ceil(F.sum(F.when(F.col("rest") == r, F.size("shingles"))) / BLOCK_SHINGLES).alias(name)
            for name, r in (("rests", True), ("mains", False))
        ]
    )
    dealt = members.join(weight, "cluster").withColumn(
        "block", F.pmod(F.xxhash64("node"), F.when(F.col("rest"), F.col("rests")).otherwise(F.col("mains")))
    )

    def tile(kind: str, low, high, side: int):
        return F.struct(F.lit(kind).alias("kind"), low.alias("low"), high.alias("high"), F.lit(side).alias("side"))

    def each(n):
        return F.sequence(F.lit(0).cast("bigint"), n - 1)

    block = F.col("block")
    with_rests = F.transform(
        each(F.col("rests")),
        lambda k: F.struct(
            F.lit("rest").alias("kind"), F.least(block, k).alias("low"), F.greatest(block, k).alias("high"),
            F.when(block <= k, 0).otherwise(1).alias("side"),
        ),
    )
    with_mains = F.transform(each(F.col("mains")), lambda k: tile("main", block, k, 0))
    to_rests = F.transform(each(F.col("rests")), lambda k: tile("main", k, block, 1))
    sent = dealt.withColumn("tile", F.explode(F.when(F.col("rest"), F.concat(with_rests, with_mains)).otherwise(to_rests)))
    sent = sent.select("cluster", "tile.*", "node", "component", "shingles")
    tiles = sent.groupBy("cluster", "kind", "low", "high")
    return stored(tiles.applyInPandas(_tile(percent), "a bigint, b bigint"), "tile-links")


def near_duplicates(docs: DataFrame, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` and ``kept`` of every document."""
    docs = narrow(docs, doc_id=id_col, text=text_col)
    sketched = stored(sketches(docs), "sketches")
    able = sketched.where("doc_id is not null and n_shingles > 0")
    classes = stored(able.groupBy("h1", "h2").agg(F.min("doc_id").alias("node")), "classes")
    # One sketch and one text per class: rows of the smallest id, of that very set.
    own = able.join(classes.select("h1", "h2", F.col("node").alias("doc_id")), ["h1", "h2", "doc_id"])
    own = stored(
        own.groupBy("doc_id", "h1", "h2").agg(F.any_value("left").alias("left"), F.any_value("right").alias("right")),
        "class-sketches",
    ).withColumnRenamed("doc_id", "node")

    hashed = own.select("node", F.posexplode("left").alias("i", "key"))
    shared = hashed.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("centre")).where("n > 1")
    buckets = stored(hashed.join(shared.drop("n"), "key"), "buckets")
    # Texts meet their ids by a merge join at every size; a broadcast of ids would have no bound.
    wanted = buckets.select("node").distinct().hint("merge")
    texts = docs.withColumnRenamed("doc_id", "node").join(wanted, "node", "left_semi")
    sets = stored(shingle_sets(texts), "sets")
    tried = buckets.where((F.col("i") < FIRST_BUCKETS) & (F.col("node") != F.col("centre")))
    tried = tried.select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct()
    links = similar(tried, sets, percent)
    labels = components(links)

    def labelled(rows: DataFrame) -> DataFrame:
        found = rows.join(labels, "node", "left")
        return found.select(*rows.columns, F.coalesce("component", "node").alias("component"))

    def mixed(rows: DataFrame) -> DataFrame:
        """Rows of keys that hold more than one component, with their component."""
        rows = labelled(rows)
        several = rows.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y")
        return rows.join(several.select("key"), "key", "left_semi")

    open_buckets = mixed(buckets.select("node", "key")).select("node", F.col("key").alias("lefts"))
    tables = open_buckets.join(own.select("node", F.explode("right").alias("rights")), "node")
    tables = stored(tables.select("node", F.xxhash64("lefts", "rights").alias("key")), "tables")
    tables = stored(mixed(tables), "mixed-tables")
    if not tables.isEmpty():
        links = links.union(_across(tables, sets, percent))
        labels = components(links)
    named = labelled(classes.select("h1", "h2", "node")).select("h1", "h2", "component")
    found = sketched.select("doc_id", "n_shingles", "h1", "h2").join(named, ["h1", "h2"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return found.select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"),
    )


def one_of_each(docs: DataFrame, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that stand for their group: of rows that
    repeat id and text, one."""
    found = near_duplicates(docs, percent, id_col, text_col)
    gone = found.where("not kept").select(F.col("doc_id").alias(id_col)).distinct()
    left = docs.join(gone.hint("merge"), id_col, "left_anti").select(*docs.columns)
    # Only ids that repeat are compared further; texts of the others are not shuffled.
    repeated = docs.groupBy(F.col(id_col).alias("again")).agg(F.count("*").alias("times")).where("times > 1")
    repeated = stored(repeated.select("again"), "repeated-ids").hint("merge")
    same = F.col(id_col).eqNullSafe(F.col("again"))
    several = left.join(repeated, same, "left_semi").dropDuplicates([id_col, text_col])
    return left.join(repeated, same, "left_anti").unionByName(several)
