"""Packing of token sequences by column generation for the cutting-stock problem.

A document's ids are cut into full pieces of ``capacity`` and one rest. Rests are binned by length
(``grain`` tokens to a bin, rounded up), which leaves a histogram of at most ``capacity / grain`` bins
whatever the number of documents. A linear program over patterns (how many pieces of each bin share a
sequence) is solved by column generation: knapsack dynamic programming over the bins prices new
patterns. The solution is rounded; what rounding leaves, one sequence per pattern at most, is packed
best-fit decreasing. Patterns then own ranges of ranks: the pieces of each bin are ranked on executors,
within salted groups of bounded size, and a rank decides sequence and slot.

Null and empty texts are the end id alone. Repeated rows and repeated ids stay separate documents (rows
equal in id take the order of their checksums). A null ``doc_id`` is packed like any other. An empty
table gives no rows.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from treesift.llm.common import map_texts, narrow, stored
from treesift.llm.encoders import word_encoder

CAPACITY = 2048
GRAIN = 8
# Column generation ends when total / value of the best pattern, a lower bound, is this near the total, or
# when as many steps as there are bins have lowered the total by less than a quarter of this share.
GAP = 0.001
# Steps for each bin at most; patterns found so far are used, best fit takes what they leave.
STEPS = 4


def cut_pieces(
    docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id``, ``start``, ``length``, ``ids_crc32``, ``doc_tokens`` of every piece; no ids are kept."""

    def worker(batch: pa.RecordBatch) -> pa.RecordBatch:
        encoder = word_encoder(tokenizer)
        owner, starts, lengths, checks, totals = [], [], [], [], []
        for i, packed_ids in enumerate(encoder.encode_all(batch.column("text"), end_id)):
            ids = np.frombuffer(packed_ids, dtype=encoder.dtype).astype("<u4")
            raw = memoryview(ids.tobytes())
            for start in range(0, len(ids), capacity):
                piece = raw[4 * start : 4 * (start + capacity)]
                owner.append(i)
                starts.append(start)
                lengths.append(len(piece) // 4)
                checks.append(zlib.crc32(piece))
                totals.append(len(ids))
        columns = [batch.column("doc_id").take(pa.array(owner, pa.int64()))]
        columns += [pa.array(x, pa.int64()) for x in (starts, lengths, checks, totals)]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    schema = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"
    return map_texts(narrow(docs, doc_id=id_col, text=text_col), worker, schema)


def _price(values: np.ndarray, sizes: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """The most valuable pattern: unbounded knapsack by dynamic programming over the room."""
    best = np.zeros(room + 1)
    took = np.full(room + 1, -1)
    for space in range(1, room + 1):
        fits = int(np.searchsorted(sizes, space, side="right"))  # sizes ascend
        if fits:
            gains = values[:fits] + best[space - sizes[:fits]]
            i = int(gains.argmax())
            if gains[i] > best[space - 1] + 1e-12:
                best[space], took[space] = gains[i], i
                continue
        best[space] = best[space - 1]
    pattern = np.zeros(len(sizes))
    space = room
    while space > 0:
        if took[space] < 0:
            space -= 1
        else:
            pattern[took[space]] += 1
            space -= int(sizes[took[space]])
    return float(best[room]), pattern


def solve_patterns(
    sizes: np.ndarray, demand: np.ndarray, room: int, gap: float = GAP
) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (columns) and amounts that cover ``demand`` with the least sequences, in fractions.

    Revised simplex: the basis starts from first-fit patterns, each used until it exhausts a bin that no
    later one holds (so the basis is triangular); a dense inverse is kept, and columns come from
    :func:`_price` until none lowers the total.
    """
    m = len(sizes)
    # Distinct tiny surcharges keep the steps from being of length zero.
    demand = demand + 1e-4 * (1 + np.arange(m) / m)
    basis, left, alive = np.zeros((m, m)), demand.copy(), np.ones(m, dtype=bool)
    for _ in range(m):
        pattern, space = np.zeros(m), room
        for i in np.flatnonzero(alive)[::-1]:
            pattern[i] = space // sizes[i]
            space -= int(pattern[i] * sizes[i])
        lasts = np.where(pattern > 0, left / np.where(pattern > 0, pattern, 1), np.inf)
        out = int(lasts.argmin())
        left -= lasts[out] * pattern
        basis[:, out] = pattern
        alive[out] = False
    inverse = np.linalg.inv(basis)
    amounts = inverse @ demand
    marked = amounts.sum()
    for step in range(STEPS * m):
        if step % m == m - 1:
            if marked - amounts.sum() < 0.25 * gap * marked:
                break
            marked = amounts.sum()
        prices = np.maximum(inverse.sum(axis=0), 0)
        value, column = _price(prices, sizes, room)
        if value <= 1 + gap:
            break
        direction = inverse @ column
        steps = np.where(direction > 1e-9, amounts / np.where(direction > 1e-9, direction, 1), np.inf)
        out = int(steps.argmin())
        if not np.isfinite(steps[out]):
            break
        amounts = amounts - steps[out] * direction
        amounts[out] = steps[out]
        basis[:, out] = column
        pivot = inverse[out] / direction[out]
        inverse = inverse - np.outer(direction, pivot)
        inverse[out] = pivot
    return basis, np.maximum(np.linalg.solve(basis, demand), 0)


def whole_patterns(sizes: np.ndarray, demand: np.ndarray, room: int) -> list[tuple[np.ndarray, int]]:
    """Whole numbers of patterns that hold exactly ``demand``."""
    basis, amounts = solve_patterns(sizes, demand.astype(float), room)
    left = demand.astype(np.int64).copy()
    plan: list[tuple[np.ndarray, int]] = []

    def use(pattern: np.ndarray, times: int) -> None:
        nonlocal left
        if times > 0 and pattern.any():
            plan.append((pattern.astype(np.int64), int(times)))
            left = left - pattern.astype(np.int64) * int(times)

    for j in np.argsort(-amounts, kind="stable"):
        pattern = basis[:, j].astype(np.int64)
        if pattern.any():
            use(pattern, min(int(amounts[j] + 1e-6), int((left[pattern > 0] // pattern[pattern > 0]).min())))
    for j in np.argsort(-(amounts - np.floor(amounts + 1e-6)), kind="stable"):
        pattern = basis[:, j].astype(np.int64)
        if pattern.any() and amounts[j] - np.floor(amounts[j] + 1e-6) > 0.05 and (left >= pattern).all():
            use(pattern, 1)
    # Best fit, largest first, over what rounding left: at most one sequence's worth per pattern.
    open_rooms: list[list] = []
    for i in np.argsort(-sizes, kind="stable"):
        for _ in range(int(left[i])):
            fitting = [r for r in open_rooms if r[0] >= sizes[i]]
            best = min(fitting, key=lambda r: r[0]) if fitting else [room, np.zeros(len(sizes), np.int64)]
            if not fitting:
                open_rooms.append(best)
            best[0] -= int(sizes[i])
            best[1][i] += 1
    return plan + [(pattern, 1) for _, pattern in open_rooms]


@dataclass
class Slots:
    """Ranges of ranks by bin: rank r of a range is in sequence ``first + (r - low) // per``."""

    rows: list[tuple[int, int, int, int, int, int]]
    sequences: int


def slots(histogram: dict[int, int], capacity: int, grain: int) -> Slots:
    """From counts by bin to ranges of ranks. A bin is a length in grains, rounded up."""
    room = capacity // grain
    bins = np.array(sorted(b for b, n in histogram.items() if n), dtype=np.int64)
    if not len(bins):
        return Slots([], 0)
    demand = np.array([histogram[int(b)] for b in bins], dtype=np.int64)
    used = np.zeros(len(bins), dtype=np.int64)
    rows, first = [], 0
    full = bins == room
    plan = [(full.astype(np.int64), int(demand[full].sum()))] if full.any() else []
    rest = np.flatnonzero(~full)
    if len(rest):
        for pattern, times in whole_patterns(bins[rest], demand[rest], room):
            whole = np.zeros(len(bins), dtype=np.int64)
            whole[rest] = pattern
            plan.append((whole, times))
    for pattern, times in plan:
        place = 0
        for i in np.flatnonzero(pattern):
            per = int(pattern[i])
            rows.append((int(bins[i]), int(used[i]), int(used[i] + per * times), first, per, place))
            used[i] += per * times
            place += per
        first += times
    return Slots(rows, first)


def pack(pieces: DataFrame, capacity: int = CAPACITY, grain: int = GRAIN) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``."""
    if capacity % grain:
        raise ValueError("the grain must divide the capacity")
    spark = pieces.sparkSession
    pieces = pieces.withColumn("bin", F.ceil(F.col("length") / grain).cast("int"))
    # At most capacity / grain rows, however many documents there are.
    histogram = {r["bin"]: r["n"] for r in pieces.groupBy("bin").agg(F.count("*").alias("n")).collect()}
    plan = slots(histogram, capacity, grain)
    table = spark.createDataFrame(
        plan.rows or [(0, 0, 0, 0, 1, 0)], "bin int, low bigint, high bigint, first bigint, per bigint, place bigint"
    )
    # Ranks: count within (bin, salt), then add the counts of the bin's smaller salts. A bin has as many
    # salts as its pieces need, so no group grows with a frequent length.
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    target = max(200, sum(histogram.values()) // (8 * tasks))
    salts = spark.createDataFrame(
        [(b, -(-n // target)) for b, n in histogram.items()] or [(0, 1)], "bin int, salts bigint"
    )
    salted = pieces.join(F.broadcast(salts), "bin").withColumn(
        "salt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.col("salts"))
    )
    before = salted.groupBy("bin", "salt").agg(F.count("*").alias("n"))
    in_bin = Window.partitionBy("bin").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    before = before.select("bin", "salt", F.coalesce(F.sum("n").over(in_bin), F.lit(0)).alias("before"))
    in_group = Window.partitionBy("bin", "salt").orderBy("doc_id", "start", "ids_crc32")
    ranked = (
        salted.withColumn("rank", F.row_number().over(in_group) - 1)
        .join(before, ["bin", "salt"])
        .withColumn("rank", F.col("rank") + F.col("before"))
    )
    placed = ranked.alias("p").join(
        F.broadcast(table).alias("t"),
        (F.col("p.bin") == F.col("t.bin")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")),
    )
    into = F.col("rank") - F.col("low")
    placed = placed.select(
        "doc_id",
        "start",
        "length",
        "ids_crc32",
        "doc_tokens",
        (F.col("first") + F.floor(into / F.col("per"))).cast("bigint").alias("sequence_id"),
        (F.col("place") + into % F.col("per")).alias("slot"),
    )
    # A sequence holds at most ``capacity`` pieces.
    earlier = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("length").over(earlier), F.lit(0)).cast("bigint")
    return placed.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", offset.alias("offset")
    )


def packed(
    docs: DataFrame,
    tokenizer: str,
    end_id: int,
    capacity: int = CAPACITY,
    grain: int = GRAIN,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Every piece of ``docs`` with its place. The texts are encoded once; only pieces are stored."""
    return pack(stored(cut_pieces(docs, tokenizer, end_id, capacity, id_col, text_col), "pieces"), capacity, grain)


def sequences(
    docs: DataFrame, places: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``sequence_id`` and its ``ids`` (32-bit, gapless, without padding) for documents of distinct ids."""
    width = 4

    def encode(batches):
        encoder = word_encoder(tokenizer)
        for batch in batches:
            packed_ids = encoder.encode_all(batch.column("text"), end_id)
            ids = [np.frombuffer(x, dtype=encoder.dtype).astype("<u4").tobytes() for x in packed_ids]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.binary())], ["doc_id", "all_ids"])

    tokens = narrow(docs, doc_id=id_col, text=text_col).mapInArrow(encode, "doc_id bigint, all_ids binary")
    pieces = places.join(tokens, "doc_id").select(
        "sequence_id",
        "offset",
        F.expr(f"substring(all_ids, CAST(start * {width} + 1 AS INT), CAST(length * {width} AS INT))").alias("piece"),
    )
    gathered = F.array_sort(F.collect_list(F.struct("offset", F.hex("piece").alias("piece"))))
    ids = F.unhex(F.array_join(F.transform(gathered, lambda x: x["piece"]), ""))
    return pieces.groupBy("sequence_id").agg(ids.alias("ids"))
