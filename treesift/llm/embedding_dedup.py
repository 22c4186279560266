"""Embedding near-duplicates: int8 tile products with rigorous error bounds.

Vectors of one label and length are compared with one another. Equal vectors are one class first. Classes
are dealt by hash into blocks of about ``BLOCK_BYTES``; a tile is a pair of groups of blocks. Within a tile
every vector is scaled to length one and quantised to int8 with its own step; ``x = s q + e`` gives

    |x.y - s s' (q.q')| <= |s q| |e'| + |s' q'| |e| + |e| |e'|

so pairs whose quantised product plus this bound stays below the threshold are done, and the rest are
computed in double precision. Integer products are exact: they run in float32 over at most 1,024
components at a time. A tile returns, for each vector with a link in it, the number of linked vectors
and the smallest vector it reaches inside the tile, never its pairs; components are joined from these.

A block travels to as many tiles as there are groups of blocks: at most ``GROUPS`` of them while a tile
fits ``TILE_BLOCKS`` blocks a side, then in proportion to the label's size. The work is quadratic within
a label, as comparing all its rows asks for.

Vectors that are null, empty, zero, or hold null or non-finite components link with nothing, and so do
rows without a label. A null id links with nothing; its component is null, and it is kept. Rows that
repeat id, label and vector are separate vectors. An empty table gives no rows; other columns are not
read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treesift.llm.common import narrow, stored
from treesift.llm.components import components

BLOCK_BYTES = 128 << 10
GROUPS = 32
TILE_BLOCKS = 64
_EXACT = 1024


class Block:
    """Unit vectors of one block with their quantised form."""

    def __init__(self, nodes, keys, copies, vectors):
        self.nodes = np.asarray(nodes, dtype=np.int64)
        self.keys = np.asarray(keys, dtype=np.int64)
        self.copies = np.asarray(copies, dtype=np.int64)
        raw = np.array(vectors, dtype=np.float64)
        raw /= np.abs(raw).max(axis=1, keepdims=True)  # so that squares neither vanish nor overflow
        self.unit = raw / np.sqrt((raw * raw).sum(axis=1, keepdims=True))
        self.step = np.abs(self.unit).max(axis=1) / 127
        self.codes = np.rint(self.unit / self.step[:, None]).astype(np.int8)
        near = self.codes * self.step[:, None]
        # A little above the true norms, so that rounding cannot undo the bound.
        self.error = np.sqrt(((self.unit - near) ** 2).sum(axis=1)) * (1 + 1e-9) + 1e-12
        self.size = np.sqrt((near**2).sum(axis=1)) * (1 + 1e-9)


def linked_pairs(x: Block, y: Block, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of all pairs with a cosine of at least ``threshold``."""
    product = np.zeros((len(x.nodes), len(y.nodes)))
    for k in range(0, x.codes.shape[1], _EXACT):
        product += x.codes[:, k : k + _EXACT].astype(np.float32) @ y.codes[:, k : k + _EXACT].astype(np.float32).T
    product *= x.step[:, None] * y.step[None, :]
    # Adding the bound's three parts as two products of one factor each.
    product += x.size[:, None] * y.error[None, :]
    product += x.error[:, None] * (y.size + y.error)[None, :]
    i, j = np.nonzero(product >= threshold)
    if len(i) * 4 > product.size:  # so many that a whole product costs less
        exact = (x.unit @ y.unit.T)[i, j]
    else:
        exact = np.concatenate(
            [np.einsum("ij,ij->i", x.unit[i[k : k + 65536]], y.unit[j[k : k + 65536]]) for k in range(0, len(i), 65536)]
            or [np.zeros(0)]
        )
    keep = exact >= threshold
    return i[keep], j[keep]


def _tile(threshold: float):
    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.drop_duplicates(["side", "block"]).sort_values(["side", "block"])
        sides = {0: [], 1: []}
        for row in frame.itertuples():
            if len(row.rows):
                parts = zip(*((r["id"], r["key"], r["copies"], r["vector"]) for r in row.rows))
                sides[row.side].append((row.block, Block(*parts)))
        own = key[2] == key[3]  # a group with itself; the other one may have no vector
        blocks, starts, total = [], {}, 0
        for side in (0, 1):
            for block, b in sides[side]:
                starts[side, block] = total
                blocks.append(b)
                total += len(b.nodes)
        nodes, keys = (np.concatenate([getattr(b, x) for b in blocks] or [np.zeros(0, np.int64)]) for x in ("nodes", "keys"))
        order = np.lexsort((keys, nodes))
        label = np.empty(total, dtype=np.int64)  # places in order of id and key
        label[order] = np.arange(total)
        count = np.zeros(total, dtype=np.int64)
        for m, (bx, x) in enumerate(sides[0]):
            for by, y in sides[0][m:] if own else sides[1]:
                i, j = linked_pairs(x, y, threshold)
                if own and bx == by:
                    i, j = i[i < j], j[i < j]
                sx, sy = starts[0, bx], starts[0 if own else 1, by]
                np.add.at(count, i + sx, y.copies[j])
                np.add.at(count, j + sy, x.copies[i])
                while len(i):  # smallest label over links, until nothing moves
                    both = np.minimum(label[i + sx], label[j + sy])
                    moving = (both < label[i + sx]) | (both < label[j + sy])
                    if not moving.any():
                        break
                    np.minimum.at(label, i + sx, both)
                    np.minimum.at(label, j + sy, both)
        found = np.flatnonzero(count)
        least = order[label[found]]
        columns = {"id": nodes[found], "key": keys[found], "n": count[found], "to_id": nodes[least], "to_key": keys[least]}
        return pd.DataFrame(columns)

    return run


def embedding_duplicates(
    vectors: DataFrame,
    threshold: float = 0.98,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id`` and ``kept`` of every vector."""
    if not 0 < threshold <= 1:
        raise ValueError("the threshold must lie above 0 and at most at 1")
    rows = narrow(vectors, vec_id=id_col, vector=vector_col, label=label_col)
    limit = F.lit(float("inf"))
    sound = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < limit))
    sound = sound & F.exists("vector", lambda x: x != 0)
    sound = F.coalesce(sound & F.col("label").isNotNull() & F.col("vec_id").isNotNull(), F.lit(False))
    good = rows.where(sound)
    # Rows may share an id but not the vector, so a class is known by its smallest id and a hash of itself.
    classes = good.groupBy("label", "vector").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies"))
    classes = classes.withColumn("key", F.xxhash64("label", "vector"))
    classes = stored(classes.withColumn("dim", F.size("vector")), "vector-classes")
    sizes = classes.groupBy("label", "dim").agg(F.count("*").alias("n"))
    sizes = sizes.withColumn("blocks", F.ceil(F.col("n") * F.col("dim") * 4 / block_bytes))
    sizes = sizes.withColumn("width", F.greatest(F.lit(1), F.least(F.lit(TILE_BLOCKS), F.ceil(F.col("blocks") / GROUPS))))
    dealt = classes.join(sizes, ["label", "dim"]).withColumn("block", F.pmod(F.xxhash64("id", "key"), F.col("blocks")))
    packed = dealt.groupBy("label", "dim", "block", "blocks", "width").agg(
        F.collect_list(F.struct("id", "key", "copies", "vector")).alias("rows")  # about BLOCK_BYTES
    )
    packed = stored(packed, "vector-blocks")
    group = F.floor(F.col("block") / F.col("width"))
    groups = F.ceil(F.col("blocks") / F.col("width"))
    sent = packed.withColumn("own", group).select(
        "*", F.explode(F.sequence(F.lit(0).cast("bigint"), groups - 1)).alias("other")
    )
    sent = sent.select(
        "label",
        "dim",
        F.least("own", "other").alias("low"),
        F.greatest("own", "other").alias("high"),
        F.when(F.col("own") <= F.col("other"), 0).otherwise(1).alias("side"),
        "block",
        "rows",
    )
    tiles = sent.groupBy("label", "dim", "low", "high")
    found = tiles.applyInPandas(_tile(threshold), "id bigint, key bigint, n bigint, to_id bigint, to_key bigint")
    links = stored(found, "tile-links")
    counts = links.groupBy("id", "key").agg(F.sum("n").alias("n"))
    ends = [F.struct(F.col(i).alias("id"), F.col(k).alias("key")) for i, k in (("id", "key"), ("to_id", "to_key"))]
    roots = components(links.select(ends[0].alias("a"), ends[1].alias("b")))
    roots = roots.select("node.*", F.col("component.id").alias("component"))
    named = classes.join(counts, ["id", "key"], "left").join(roots, ["id", "key"], "left")
    named = named.select(
        "label",
        "vector",
        (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"),
        F.coalesce("component", "id").alias("component"),
    )
    plain = rows.withColumn("sound", sound)
    keys = [F.when(F.col("sound"), F.col(c)).alias(c) for c in ("label", "vector")]
    found = plain.select("vec_id", *keys).join(named, ["label", "vector"], "left")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("component", "vec_id"))
    return found.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"),
    )
