"""Token counts of fields and sections from one encoding of the whole document.

A document's fields are joined by a separator and encoded once. Token spans are then joined as
intervals with the spans of fields and of sections (lines of a field), both sorted, by binary search.
A token that crosses a boundary goes whole to one side by ``rule``:

* ``first``: where it starts;
* ``last``: where its last byte lies;
* ``largest``: where most of its bytes lie, the earlier section if equal.

The separator and the line end that closes a section belong to that section, so sections tile the
document and their counts add up to the document's. Offsets are characters of the joined text.

Null fields read as empty. An empty document has one section without tokens. Repeated rows give
repeated results, a null id is kept, an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treesift.llm.common import map_texts
from treesift.llm.encoders import span_encoder

RULES = ("first", "last", "largest")


def allocate(token_ends: np.ndarray, starts: np.ndarray, total: int, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens by section, and how many tokens touch another section as well.

    ``token_ends``: byte offsets at which the tokens end, tiling the text; ``starts``: byte offsets at
    which the sections begin, the first at 0.
    """
    n = len(starts)
    if not len(token_ends):
        return np.zeros(n, np.int64), np.zeros(n, np.int64)
    begins = np.concatenate([[0], token_ends[:-1]])
    low = np.searchsorted(starts, begins, side="right") - 1
    high = np.searchsorted(starts, token_ends - 1, side="right") - 1
    owner = low if rule == "first" else high
    crossing = np.flatnonzero(low != high)
    if rule == "largest":
        owner = low.copy()
        ends = np.append(starts[1:], total)
        for i in crossing.tolist():  # few tokens span a boundary
            parts = np.arange(low[i], high[i] + 1)
            shares = np.minimum(ends[parts], token_ends[i]) - np.maximum(starts[parts], begins[i])
            owner[i] = parts[int(shares.argmax())]
    return np.bincount(owner, minlength=n), np.bincount(owner[crossing], minlength=n)


def token_counts(
    docs: DataFrame,
    ranks_path: str,
    pattern: str,
    fields: tuple[str, ...] = ("text",),
    id_col: str = "doc_id",
    rule: str = "first",
    separator: str = "\n",
) -> DataFrame:
    """One row per section: ``doc_id``, ``field`` (its place in ``fields``), ``section`` (its place in
    the field), ``start`` and ``n_chars``, ``n_tokens``, ``n_crossing``, and ``doc_tokens``."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in fields]
    joined = docs.select(
        F.col(id_col).alias("doc_id"),
        F.concat_ws(separator, *parts).alias("text"),
        F.array(*[F.octet_length(p).cast("bigint") for p in parts]).alias("sizes"),
    )
    gap = len(separator.encode())
    names = ["doc_id", "field", "section", "start", "n_chars", "n_tokens", "n_crossing", "doc_tokens"]

    def worker(batch: pa.RecordBatch) -> pa.RecordBatch:
        encoder = span_encoder(ranks_path, pattern)
        owner, columns = [], [[] for _ in names[1:]]
        for i, (text, sizes) in enumerate(zip(batch.column("text").to_pylist(), batch.column("sizes").to_pylist())):
            ids, ends = encoder.encode(text)
            raw = np.frombuffer(text.encode(), dtype=np.uint8)
            # A field begins after the separator; a section after each line end inside a field.
            field_starts = np.concatenate([[0], np.cumsum(np.asarray(sizes[:-1], dtype=np.int64) + gap)])
            starts = np.union1d(field_starts, np.flatnonzero(raw[:-1] == 10) + 1).astype(np.int64)
            field = np.searchsorted(field_starts, starts, side="right") - 1
            counts, crossing = allocate(ends, starts, len(raw), rule)
            chars = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
            edges = chars[np.append(starts, len(raw))]
            owner.extend([i] * len(starts))
            section = np.arange(len(starts)) - np.searchsorted(field, field, side="left")
            found = (field, section, edges[:-1], np.diff(edges), counts, crossing, np.full(len(starts), len(ids)))
            for column, x in zip(columns, found):
                column.append(x)
        arrays = [batch.column("doc_id").take(pa.array(owner, pa.int64()))]
        arrays += [pa.array(np.concatenate(c).astype(np.int64), pa.int64()) for c in columns]
        return pa.RecordBatch.from_arrays(arrays, names)

    return map_texts(joined, worker, ", ".join(f"{n} bigint" for n in names))
