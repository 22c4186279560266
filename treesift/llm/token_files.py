"""Token-ID files: frequency-ranked ids in byte-aligned codes of 1 to 4 bytes.

Layout of the folder:

* ``ranks``: one row per id of the vocabulary, the most frequent id first (ties: the smaller id).
* ``blocks``: Parquet rows of about ``block_tokens`` ids. ``part`` and ``block`` order them; ``doc_ids``
  and ``n_tokens`` describe the documents, ``control`` holds two bits per id (its bytes less one, four
  ids to a byte, the lowest bits first) and ``data`` the little-endian ranks without leading zeros.
  ``before`` counts the ids of the part's earlier blocks. A document never spans blocks: one longer than
  ``block_tokens`` is a block of its own.

Parquet carries the two byte streams, so that Spark's own commit protocol writes them in any store and
lost executors leave no half-written file. Frequencies are counted over all documents; only the counts,
one per id of the vocabulary, and one total per part pass the driver.

Null and empty texts are documents of the end id alone. A null ``doc_id`` sorts first. Repeated ids stay
separate documents; rows equal in id are ordered by the checksum of their ids. An empty table gives no
blocks. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treesift.llm.common import narrow, shared_folder, stored, text_slices
from treesift.llm.encoders import word_encoder

BLOCK_TOKENS = 1 << 18
# Bytes of ids in a part of the files.
PART_BYTES = 16 << 20
_STEP = 1 << 20

# By control byte: the lengths of its four codes.
_LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.uint8) + 1


def pack_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of a row of ranks."""
    ranks = np.ascontiguousarray(ranks, dtype="<u4")
    if len(ranks) > _STEP:  # whole control bytes at a time, so that long rows need little memory
        parts = [pack_ranks(ranks[k : k + _STEP]) for k in range(0, len(ranks), _STEP)]
        return b"".join(c for c, _ in parts), b"".join(d for _, d in parts)
    sizes = 1 + (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    keep = np.arange(4) < sizes[:, None]
    data = ranks.view(np.uint8).reshape(-1, 4)[keep]
    codes = np.zeros(-(-len(ranks) // 4) * 4, dtype=np.uint8)
    codes[: len(ranks)] = sizes - 1
    control = (codes.reshape(-1, 4) << np.array([0, 2, 4, 6], dtype=np.uint8)).sum(axis=1, dtype=np.uint8)
    return control.tobytes(), data.tobytes()


def unpack_ranks(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ``n`` ranks behind both streams: code lengths by table, then one gather per byte place."""
    sizes = _LENGTHS[np.frombuffer(control, dtype=np.uint8)].ravel()[:n]
    raw = np.frombuffer(data, dtype=np.uint8)
    at = np.cumsum(sizes, dtype=np.int64) - sizes
    ranks = raw[at].astype(np.uint32) if n else np.zeros(0, dtype=np.uint32)
    for place in range(1, int(sizes.max(initial=1))):
        longer = np.flatnonzero(sizes > place)
        ranks[longer] |= raw[at[longer] + place].astype(np.uint32) << np.uint32(8 * place)
    return ranks


def encoded(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``ids`` (packed little-endian, the end id last) and ``row``, another number for each document.

    Each task adds a row of its own with the ids it met (``found``) and their ``times``; its ``row`` is null.
    """
    names = ["doc_id", "ids", "row", "found", "times"]

    def run(batches):
        encoder = word_encoder(tokenizer)
        size = max(encoder.size, end_id + 1)
        total, row = np.zeros(size, dtype=np.int64), TaskContext.get().partitionId() << 40
        for batch in text_slices(batches, "text"):
            ids = encoder.encode_all(batch.column("text"), end_id)
            total += np.bincount(np.frombuffer(b"".join(ids), dtype=encoder.dtype), minlength=size)
            n = len(ids)
            nothing = pa.nulls(n, pa.binary())
            rows = pa.array(np.arange(row, row + n))
            row += n
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.binary()), rows, nothing, nothing], names)
        found = np.flatnonzero(total)
        if len(found):
            counts = [pa.array([x.astype("<i8").tobytes()], pa.binary()) for x in (found, total[found])]
            none = [pa.nulls(1, kind) for kind in (pa.int64(), pa.binary(), pa.int64())]
            yield pa.RecordBatch.from_arrays([*none, *counts], names)

    schema = "doc_id bigint, ids binary, row bigint, found binary, times binary"
    return narrow(docs, doc_id=id_col, text=text_col).mapInArrow(run, schema)


def id_counts(tokens: DataFrame, size: int) -> np.ndarray:
    """Occurrences of every id over all documents."""

    def count(batches):
        total = np.zeros(size, dtype=np.int64)
        for batch in batches:
            for ids, times in zip(batch.column("found").to_pylist(), batch.column("times").to_pylist()):
                total[np.frombuffer(ids, dtype="<i8")] += np.frombuffer(times, dtype="<i8")
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], ["id", "n"])

    rows = tokens.where("found is not null").select("found", "times").mapInArrow(count, "id bigint, n bigint")
    counts = np.zeros(size, dtype=np.int64)
    for row in rows.groupBy("id").agg(F.sum("n").alias("n")).collect():  # at most one row per id of the vocabulary
        counts[row["id"]] = row["n"]
    return counts


def write_token_files(
    docs: DataFrame,
    path: str,
    tokenizer: str,
    end_id: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    block_tokens: int = BLOCK_TOKENS,
) -> None:
    """Write the files of ``docs`` in ascending ``id_col`` order."""
    spark = docs.sparkSession
    encoder = word_encoder(tokenizer)
    size, width = max(encoder.size, end_id + 1), encoder.dtype.itemsize
    if end_id >= 1 << 8 * width:
        raise ValueError("the end id does not fit the vocabulary's width")
    tokens = stored(encoded(docs, tokenizer, end_id, id_col, text_col), "ids")
    counts = id_counts(tokens, size)
    by_rank = np.argsort(-counts, kind="stable")
    rank_of = np.empty(size, dtype=np.uint32)
    rank_of[by_rank] = np.arange(size, dtype=np.uint32)
    shared = spark.sparkContext.broadcast(rank_of)  # four bytes for each id of the vocabulary

    def blocks(batches):
        def block(part, doc_ids, sizes, ranks):
            control, data = pack_ranks(np.concatenate(ranks))
            row = [part, state["block"], state["before"], doc_ids, sizes, control, data]
            state["block"] += 1
            state["before"] += sum(sizes)
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds)], names)

        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary()]
        names = ["part", "block", "before", "doc_ids", "n_tokens", "control", "data"]
        state = {"block": 0, "before": 0}
        part, doc_ids, sizes, ranks, held = None, [], [], [], 0
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("part", "doc_id", "ids"))
            for part, doc_id, row in zip(*columns):
                found = shared.value[np.frombuffer(row, dtype=f"<u{width}")]
                if held and held + len(found) > block_tokens:
                    yield block(part, doc_ids, sizes, ranks)
                    doc_ids, sizes, ranks, held = [], [], [], 0
                doc_ids.append(doc_id)
                sizes.append(len(found))
                ranks.append(found)
                held += len(found)
        if held:
            yield block(part, doc_ids, sizes, ranks)

    ids = tokens.where("row is not null").select("doc_id", F.crc32("ids").alias("crc"), "row", "ids")
    parts = max(1, -(-int(counts.sum()) * width // PART_BYTES))
    order = ("doc_id", "crc", "row")  # of repeated ids and rows, too, no part takes more than its share
    ordered = (
        ids.repartitionByRange(parts, *order)
        .sortWithinPartitions(*order)
        .select(F.spark_partition_id().cast("bigint").alias("part"), "doc_id", "ids")
    )
    schema = "part bigint, block bigint, before bigint, doc_ids array<bigint>, n_tokens array<bigint>, control binary, data binary"
    ordered.mapInArrow(blocks, schema).write.option("compression", "zstd").parquet(f"{path}/blocks")
    ranks = spark.createDataFrame([(int(r), int(i)) for r, i in enumerate(by_rank)], "rank int, id int")
    ranks.coalesce(1).write.parquet(f"{path}/ranks")


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """Decoded documents: ``doc_id``, ``start`` (ids of all documents before it), ``ids`` (packed, 32-bit)."""
    by_rank = np.zeros(0, dtype="<u4")
    rows = spark.read.parquet(f"{path}/ranks").collect()  # one row per id of the vocabulary
    if rows:
        by_rank = np.zeros(len(rows), dtype="<u4")
        by_rank[[r["rank"] for r in rows]] = [r["id"] for r in rows]
    shared = spark.sparkContext.broadcast(by_rank)
    blocks = spark.read.parquet(f"{path}/blocks")
    totals = blocks.groupBy("part").agg(F.sum(F.expr("aggregate(n_tokens, 0L, (a, x) -> a + x)")).alias("n"))
    starts, total = {}, 0
    for row in totals.orderBy("part").collect():  # one number for each written part
        starts[row["part"]] = total
        total += row["n"]

    def decode(batches):
        for batch in batches:
            for row in batch.to_pylist():
                n = sum(row["n_tokens"])
                ids = shared.value[unpack_ranks(row["control"], row["data"], n)]
                ends = np.cumsum(row["n_tokens"])
                first = starts[row["part"]] + row["before"]
                begin = ends - np.asarray(row["n_tokens"])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row["doc_ids"], pa.int64()),
                        pa.array(begin + first, pa.int64()),
                        pa.array([ids[a:b].tobytes() for a, b in zip(begin, ends)], pa.binary()),
                    ],
                    ["doc_id", "start", "ids"],
                )

    return blocks.mapInArrow(decode, "doc_id bigint, start bigint, ids binary")


def digests(tokens: DataFrame) -> DataFrame:
    """``doc_id``, ``start``, ``n_tokens`` and the unsigned ``ids_crc32`` of decoded documents."""
    return tokens.select(
        "doc_id",
        "start",
        (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.crc32("ids").alias("ids_crc32"),
    )


def token_files(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Write ``docs`` to new files in the shared folder and read them back, decoded."""
    spark = docs.sparkSession
    path = shared_folder(spark, "token-files")
    write_token_files(docs, path, tokenizer, end_id)
    return read_token_files(spark, path)
