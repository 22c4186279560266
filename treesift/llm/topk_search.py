"""Exact top-k inner products of whole numbers by a three-phase uniform threshold.

Components are cut into ``slices`` neighbouring parts; the score of a vector is the sum of its scores in
the slices. Vectors lie in blocks of bounded bytes and rows, queries too, and a tile is a pair of blocks.

1. Every tile gathers, for each query and slice, the local list of the ``k`` greatest scores of its
   vectors, and resolves their whole scores. The k-th best of all of them is a safe cutoff ``t``: no
   vector below it can be among a query's best.
2. With ``m`` slices and greatest scores ``M_b``, a vector of score ``t`` or more has a slice in which its
   score is at least ``M_b - (sum M - t) / m``: the uniform threshold. It is sent to the tiles. A local list
   that ends below it was sufficient; only the others are visited again for the rest of their entries.
3. Entries found there are resolved to whole scores, and those under the cutoff go. Each tile returns
   at most ``k`` a query; a window that limits groups before its shuffle ranks them.

Products are exact: in double precision while no sum can reach 2**53, else in 64-bit integers, and beyond
2**63 in Python integers (a score above a long is an error). Cutoffs travel as rows, by tile, as their number
grows with the queries. A block is copied to as many tiles as the other side has blocks; the work is
that of comparing the query set with all rows, in blocks.

Vectors that are null or hold null or non-finite components take no part, as query or candidate; those of
unlike lengths have no score with each other, and vectors without components score 0. Rows that repeat an
id are separate candidates, and each other's; a query leaves out its own row only. A query of fewer than
``k`` candidates gets them all. Ties go to the smaller id, a null id last. An empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treesift.llm.common import narrow, stored

BLOCK_BYTES = 2 << 20
BLOCK_ROWS = 4096
SLICES = 2
# Queries of a tile scored together.
_CHUNK = 256
_TILE = ("dim", "cblock", "qblock")
_QUERY = ("dim", "qblock", "qpos")


class _Block:
    def __init__(self, row: dict, dim: int):
        self.ids = np.frombuffer(row["ids"], dtype="<i8")
        self.no_id = np.frombuffer(row["no_id"], dtype=bool)
        self.copies = np.frombuffer(row["copies"], dtype="<i8")
        self.codes = np.frombuffer(row["codes"], dtype="<i8").reshape(len(self.ids), dim)

    def repeated(self, most: int) -> _Block:
        """Each class as many rows as it has copies, ``most`` at most."""
        found = object.__new__(_Block)
        places = np.repeat(np.arange(len(self.ids)), np.minimum(self.copies, most))
        for name in ("ids", "no_id", "copies", "codes"):
            setattr(found, name, getattr(self, name)[places])
        return found


def _number_type(x: np.ndarray, y: np.ndarray):
    """The cheapest type in which products of rows and all their partial sums are exact."""
    greatest = [max(abs(int(a.min(initial=0))), abs(int(a.max(initial=0)))) for a in (x, y)]
    bound = greatest[0] * greatest[1] * max(1, x.shape[1])
    return np.float64 if bound < 1 << 53 else np.int64 if bound < 1 << 62 else object


def _bounds(dim: int, slices: int) -> list[tuple[int, int]]:
    edges = [dim * b // slices for b in range(slices + 1)]
    return list(zip(edges, edges[1:]))


class _Tile:
    """Slice scores of one tile; the query's own row is marked."""

    def __init__(self, candidates: _Block, queries: _Block, slices: int, k: int):
        self.c, self.q = candidates.repeated(k + 1), queries
        kind = _number_type(self.c.codes, self.q.codes)
        self.columns, self.rows = self.c.codes.astype(kind), self.q.codes.astype(kind)
        self.bounds = _bounds(self.c.codes.shape[1], slices)
        by_id: dict[int, list[int]] = {}
        wanted = set(self.q.ids.tolist())
        for i in np.flatnonzero(np.isin(self.c.ids, self.q.ids) & ~self.c.no_id):
            if int(self.c.ids[i]) in wanted:
                by_id.setdefault(int(self.c.ids[i]), []).append(int(i))
        self.own = np.full(len(self.q.ids), -1)
        for r, i in enumerate(self.q.ids.tolist()):
            for c in by_id.get(i, ()):
                if np.array_equal(self.c.codes[c], self.q.codes[r]):
                    self.own[r] = c  # equal rows are alike, so any one of them will do
                    break

    def scores(self, rows: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """Scores by slice, and which of them count."""
        parts = [self.rows[rows, a:b] @ self.columns[:, a:b].T for a, b in self.bounds]
        counts = np.ones(parts[0].shape, dtype=bool)
        mine = np.flatnonzero(self.own[rows] >= 0)
        counts[mine, self.own[rows][mine]] = False
        return parts, counts

    def best(self, row: np.ndarray, column: np.ndarray, total: np.ndarray, k: int):
        """Places of the ``k`` best entries of each row, in order of row and rank."""
        order = np.lexsort((self.c.ids[column], self.c.no_id[column], -total, row))
        row = row[order]
        first = np.searchsorted(row, row, side="left")
        return order[np.arange(len(row)) - first < k]


def _sides(table: pa.Table) -> dict[int, dict]:
    return {row["side"]: row for row in table.to_pylist()}


def _gather(k: int, slices: int):
    """Phase 1: local lists. ``floors`` holds the least listed score where the list leaves entries out."""
    fields = [("dim", pa.int64()), ("cblock", pa.int64()), ("qblock", pa.int64()), ("qpos", pa.int64())]
    fields += [("query_id", pa.int64()), ("copies", pa.int64())]
    fields += [(name, pa.list_(pa.int64())) for name in ("floors", "tops", "ids", "totals")]
    schema = pa.schema(fields)

    def run(key: tuple, table: pa.Table) -> pa.Table:
        sides, out = _sides(table), []
        dim, cblock, qblock = (x.as_py() for x in key)
        if len(sides) == 2:
            tile = _Tile(_Block(sides[0], dim), _Block(sides[1], dim), slices, k)
            for start in range(0, len(tile.q.ids), _CHUNK):
                rows = np.arange(start, min(start + _CHUNK, len(tile.q.ids)))
                parts, counts = tile.scores(rows)
                listed = np.zeros(counts.shape, dtype=bool)
                floors, tops = [], []
                n = counts.shape[1]
                for part in parts:
                    part = np.where(counts, part, part.min(initial=0) - 1)  # one's own row is below all
                    at = np.argpartition(part, n - k, axis=1)[:, n - k :] if n > k else np.tile(np.arange(n), (len(rows), 1))
                    np.put_along_axis(listed, at, True, axis=1)
                    values = np.take_along_axis(part, at, axis=1)
                    floors.append(values.min(axis=1) if n > k else None)
                    tops.append(values.max(axis=1))
                row, column = np.nonzero(listed & counts)
                total = sum(part[row, column] for part in parts)
                kept = tile.best(row, column, total, k)
                row, column, total = row[kept], column[kept], total[kept]
                ends = np.searchsorted(row, np.arange(len(rows) + 1))
                for r, q in enumerate(rows.tolist()):
                    if ends[r] == ends[r + 1]:
                        continue  # no candidate but itself
                    these = slice(ends[r], ends[r + 1])
                    ids = [None if self_no else i for i, self_no in zip(tile.c.ids[column[these]].tolist(), tile.c.no_id[column[these]])]
                    out.append(
                        {
                            "dim": dim,
                            "cblock": cblock,
                            "qblock": qblock,
                            "qpos": q,
                            "query_id": int(tile.q.ids[q]),
                            "copies": int(tile.q.copies[q]),
                            "floors": [None if f is None else int(f[r]) for f in floors],
                            "tops": [int(t[r]) for t in tops],
                            "ids": ids,
                            "totals": [int(t) for t in total[these]],
                        }
                    )
        return pa.Table.from_pylist(out, schema)

    return run


def _collect(k: int, slices: int):
    """Phases 2 and 3: entries at or above the threshold in any slice, with whole scores from the cutoff on."""
    names = ("dim", "qblock", "qpos", "query_id", "copies", "vec_id", "score")
    schema = pa.schema([(name, pa.int64()) for name in names])

    def run(key: tuple, table: pa.Table) -> pa.Table:
        sides, out = _sides(table), {name: [] for name in names}
        dim, _, qblock = (x.as_py() for x in key)
        if len(sides) == 3:
            tile = _Tile(_Block(sides[0], dim), _Block(sides[1], dim), slices, k)
            wanted = sorted(sides[2]["asked"], key=lambda r: r["qpos"])
            for start in range(0, len(wanted), _CHUNK):
                some = wanted[start : start + _CHUNK]
                rows = np.array([r["qpos"] for r in some])
                parts, counts = tile.scores(rows)
                enough = np.zeros(counts.shape, dtype=bool)
                for b, part in enumerate(parts):
                    enough |= part >= np.array([r["thresholds"][b] for r in some], dtype=part.dtype)[:, None]
                row, column = np.nonzero(enough & counts)
                total = sum(part[row, column] for part in parts)
                over = total >= np.array([r["cutoff"] for r in some], dtype=total.dtype)[row]
                row, column, total = row[over], column[over], total[over]
                kept = tile.best(row, column, total, k)
                row, column, total = rows[row[kept]], column[kept], total[kept]
                out["qpos"] += row.tolist()
                out["query_id"] += tile.q.ids[row].tolist()
                out["copies"] += tile.q.copies[row].tolist()
                out["vec_id"] += [None if tile.c.no_id[c] else int(tile.c.ids[c]) for c in column]
                out["score"] += [int(t) for t in total]
        n = len(out["qpos"])
        out["dim"], out["qblock"] = [dim] * n, [qblock] * n
        return pa.Table.from_pydict(out, schema)

    return run


def _pack(key: tuple, table: pa.Table) -> pa.Table:
    dim, block = (x.as_py() for x in key)
    ids = table.column("vec_id").combine_chunks()
    codes = table.column("codes").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    row = {
        "dim": dim,
        "block": block,
        "ids": ids.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes(),
        "no_id": ids.is_null().to_numpy(zero_copy_only=False).tobytes(),
        "copies": table.column("copies").to_numpy().astype("<i8").tobytes(),
        "codes": codes.astype("<i8").tobytes(),
    }
    kinds = [("dim", pa.int64()), ("block", pa.int64())]
    kinds += [(name, pa.binary()) for name in ("ids", "no_id", "copies", "codes")]
    return pa.Table.from_pylist([row], pa.schema(kinds))


def _blocks(classes: DataFrame, name: str, block_bytes: int, block_rows: int) -> tuple[DataFrame, int]:
    """Packed blocks, and how many of them a length may have."""
    row = classes.agg(F.count("*").alias("n"), F.sum(F.col("dim") + 2).alias("numbers")).first()
    n = max(1, -(-row["n"] // block_rows), -(-8 * (row["numbers"] or 0) // block_bytes))
    dealt = classes.withColumn("block", F.pmod(F.xxhash64("vec_id", "codes"), F.lit(n)))
    schema = "dim bigint, block bigint, ids binary, no_id binary, copies binary, codes binary"
    return stored(dealt.groupBy("dim", "block").applyInArrow(_pack, schema), name), n


def whole_numbers(vector: str, factor: int) -> Column:
    """Components times ``factor``, rounded down; null for vectors that take no part."""
    infinite = F.lit(float("inf"))
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < infinite))
    return F.when(sound, F.transform(vector, lambda x: F.floor(x.cast("double") * factor).cast("bigint")))


def top_k(
    vectors: DataFrame,
    is_query: Column,
    k: int = 5,
    factor: int = 256,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    slices: int = SLICES,
    block_bytes: int = BLOCK_BYTES,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: the ``k`` best of every row that ``is_query`` (a condition
    on ``vec_id``) selects."""
    if k < 1 or slices < 1:
        raise ValueError("k and slices start at 1")
    rows = narrow(vectors, vec_id=id_col, vector=vector_col).withColumn("codes", whole_numbers("vector", factor))
    classes = rows.where("codes is not null").groupBy("vec_id", "codes").agg(F.count("*").alias("copies"))
    classes = stored(classes.withColumn("dim", F.size("codes").cast("bigint")), "vectors")
    candidates, n_c = _blocks(classes, "vector-blocks", block_bytes, block_rows)
    asked = classes.where(is_query & F.col("vec_id").isNotNull())
    queries, n_q = _blocks(asked, "query-blocks", block_bytes, block_rows)

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")))

    data = ("ids", "no_id", "copies", "codes")
    c_side = candidates.select("dim", F.col("block").alias("cblock"), every(n_q).alias("qblock"), F.lit(0).alias("side"), *data)
    q_side = queries.select("dim", every(n_c).alias("cblock"), F.col("block").alias("qblock"), F.lit(1).alias("side"), *data)
    tiles = c_side.unionByName(q_side)
    lists = stored(
        tiles.groupBy(*_TILE).applyInArrow(
            _gather(k, slices),
            "dim bigint, cblock bigint, qblock bigint, qpos bigint, query_id bigint, copies bigint,"
            " floors array<bigint>, tops array<bigint>, ids array<bigint>, totals array<bigint>",
        ),
        "score-lists",
    )
    by_query = Window.partitionBy(*_QUERY)
    ranked = lists.select(*_QUERY, F.explode("totals").alias("total")).withColumn(
        "place", F.row_number().over(by_query.orderBy(F.desc("total")))
    )
    cutoffs = ranked.where(F.col("place") <= k).groupBy(*_QUERY).agg(
        F.max(F.when(F.col("place") == k, F.col("total"))).alias("cutoff")
    )
    tops = lists.groupBy(*_QUERY).agg(F.array(*[F.max(F.col("tops")[b]) for b in range(slices)]).alias("tops"))
    excess = (F.aggregate("tops", F.lit(0).cast("bigint"), lambda a, x: a + x) - F.col("cutoff")) / slices
    bars = tops.join(cutoffs, list(_QUERY)).select(
        *_QUERY, "cutoff", F.transform("tops", lambda top: top - F.floor(excess).cast("bigint")).alias("thresholds")
    )
    judged = stored(
        lists.join(bars, list(_QUERY)).withColumn(
            "unfinished",
            F.coalesce(F.exists(F.zip_with("floors", "thresholds", lambda f, t: f >= t), lambda x: x), F.lit(False)),
        ),
        "judged-lists",
    )
    unfinished = judged.where("unfinished").groupBy(*_TILE).agg(
        F.collect_list(F.struct("qpos", "thresholds", "cutoff")).alias("asked")  # at most the queries of a block
    )
    again = tiles.join(unfinished.select(*_TILE), list(_TILE), "left_semi").withColumn(
        "asked", F.lit(None).cast("array<struct<qpos: bigint, thresholds: array<bigint>, cutoff: bigint>>")
    )
    bar_side = unfinished.select(
        *_TILE, F.lit(2).alias("side"), *[F.lit(None).cast("binary").alias(name) for name in data], "asked"
    )
    rest = again.unionByName(bar_side).groupBy(*_TILE).applyInArrow(
        _collect(k, slices),
        "dim bigint, qblock bigint, qpos bigint, query_id bigint, copies bigint, vec_id bigint, score bigint",
    )
    listed = judged.where("not unfinished").select(
        *_QUERY, "query_id", "copies", "cutoff", F.explode(F.arrays_zip("ids", "totals")).alias("entry")
    )
    listed = listed.select(
        *_QUERY, "query_id", "copies", "cutoff", F.col("entry.ids").alias("vec_id"), F.col("entry.totals").alias("score")
    ).where("cutoff is null or score >= cutoff")
    entries = rest.unionByName(listed.drop("cutoff"))
    order = by_query.orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    best = entries.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    best = best.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))))
    return best.select("query_id", "rank", "vec_id", "score")
