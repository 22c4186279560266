"""Which bindings a use of a name can meet: as-of lookups over nested scopes and branches.

Inside its own scope a use meets bindings that end before it; in scopes around it, all of them. The innermost
scope with a binding or a parameter of the name decides, bindings before parameters. Of its bindings the
latest that is sure to have run counts, and later ones that may have: a binding is sure where the branches it
stands in are the first of those the use stands in.

A name is looked up within its file, so the rows of a file are brought together once, in order of the path, and one
pass over each partition holds the rows of one file at a time.

No step compares the bindings of a name with its uses pairwise. The bindings of a scope and name are put in order
once, as a whole and for each chain of branches, each place with the greatest ordinal so far; the latest binding
before a use, and the latest sure one, are then found by bisection, the latter for each of the use's branches from
the outside in. Scopes around a use are the few its row lists. Bindings between both ordinals are fetched by ordinal,
as many as the result holds.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from treesift.sources.batches import ROWS_PER_BATCH

LOOKUPS = "path string, line int, col int, name string, kind string, sure boolean, values array<string>"


class _Bound:
    """The bindings of one name in one scope: the greatest ordinal up to a place, and values by ordinal."""

    def __init__(self, bindings: list[tuple]):
        self.values: dict[int, str] = {}
        self.bare: int | None = None
        self.chains: dict[tuple, tuple[list, list]] = {}
        self.places: list[tuple] = []
        self.ordinals: list[int] = []
        for place, ordinal, chain, value in sorted(bindings, key=lambda b: b[:2]):
            known = self.values.get(ordinal)
            self.values[ordinal] = value if known is None or known < value else known
            if not chain and (self.bare is None or ordinal > self.bare):
                self.bare = ordinal
            for places, ordinals in ((self.places, self.ordinals), self.chains.setdefault(chain, ([], []))):
                places.append(place)
                ordinals.append(max(ordinal, ordinals[-1]) if ordinals else ordinal)
        self.last = self.ordinals[-1]

    @staticmethod
    def _before(places: list[tuple], ordinals: list[int], place: tuple) -> int | None:
        met = bisect_right(places, place)
        return ordinals[met - 1] if met else None

    def latest(self, place: tuple) -> int | None:
        return self._before(self.places, self.ordinals, place)

    def latest_sure(self, place: tuple, chain: tuple) -> int | None:
        first = None
        for depth in range(len(chain) + 1):
            found = self.chains.get(chain[:depth])
            ordinal = self._before(*found, place) if found else None
            if ordinal is not None and (first is None or ordinal > first):
                first = ordinal
        return first

    def between(self, first: int | None, last: int) -> list[str | None]:
        return [self.values.get(number) for number in range(1 if first is None else first, last + 1)]


class _Names:
    """What one file holds of one name."""

    __slots__ = ("bindings", "parameters", "uses")

    def __init__(self):
        self.bindings: dict[int, list[tuple]] = {}
        self.parameters: set[int] = set()
        self.uses: dict[tuple, tuple] = {}

    def found(self) -> Iterator[tuple]:
        """``place``, ``kind``, ``sure`` and ``values`` of every use."""
        bound = {scope: _Bound(bindings) for scope, bindings in self.bindings.items()}
        for place, (scopes, chain) in self.uses.items():
            own = bound.get(scopes[0])
            last = own.latest(place) if own else None
            if last is not None:
                first = own.latest_sure(place, chain)
                yield place, "binding", first is not None, own.between(first, last)
                continue
            for step, scope in enumerate(scopes):
                if step and scope in bound:
                    there = bound[scope]
                    yield place, "binding", there.bare is not None, there.between(there.bare, there.last)
                    break
                if scope in self.parameters:
                    yield place, "parameter", False, []
                    break
            else:
                yield place, "name", False, []


def _lists(column: pa.ListArray) -> tuple[list[int], list]:
    """Offsets and items: the list of row ``i`` is ``items[offsets[i] : offsets[i + 1]]``, empty for a null."""
    return column.offsets.to_numpy().tolist(), column.values.to_numpy(zero_copy_only=False).tolist()


def _numbers(column: pa.Array) -> list[int]:
    return column.fill_null(0).to_numpy().tolist()


def _texts(column: pa.Array) -> list[str | None]:
    return column.to_numpy(zero_copy_only=False).tolist()


def _files(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str | None, dict[str, _Names]]]:
    """Each file's names, from rows in order of the path."""
    begun, at, names = False, None, {}
    for batch in batches:
        path, kind, name, value = (_texts(batch.column(c)) for c in ("path", "kind", "name", "value"))
        scope, line, col, ordinal = (_numbers(batch.column(c)) for c in ("scope", "line", "col", "ordinal"))
        (arounds, scopes), (arms, branches) = _lists(batch.column("scopes")), _lists(batch.column("branches"))
        for i, of in enumerate(path):
            if of != at or not begun:
                if names:
                    yield at, names
                begun, at, names = True, of, {}
            found = names.get(name[i])
            if found is None:
                found = names[name[i]] = _Names()
            if kind[i] == "use":
                chain = tuple(branches[arms[i] : arms[i + 1]])
                found.uses.setdefault((line[i], col[i]), (scopes[arounds[i] : arounds[i + 1]], chain))
            elif kind[i] == "binding":
                chain = tuple(branches[arms[i] : arms[i + 1]])
                found.bindings.setdefault(scope[i], []).append(((line[i], col[i]), ordinal[i], chain, value[i]))
            else:
                found.parameters.add(scope[i])
    if names:
        yield at, names


def _looked_up(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Batches are bounded by rows and by the values in them, so that memory does not grow with a file's uses."""
    rows: list[tuple] = []
    size = 0
    for path, names in _files(batches):
        for name, found in names.items():
            for (line, col), kind, sure, values in found.found():
                rows.append((path, line, col, name, kind, sure, values))
                size += 1 + len(values)
                if size >= 4 * ROWS_PER_BATCH:
                    yield _batch(rows, schema)
                    rows, size = [], 0
    if rows:
        yield _batch(rows, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    *plain, values = zip(*rows, strict=True)
    offsets, items = [0], []
    for row in values:
        items += row
        offsets.append(len(items))
    columns = [pa.array(column, field.type) for column, field in zip(plain, schema, strict=False)]
    lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(items, pa.string()))
    return pa.RecordBatch.from_arrays([*columns, lists.cast(schema.field(len(plain)).type)], schema=schema)


def resolved(rows: DataFrame, in_order: bool = False) -> DataFrame:
    """``path``, ``line``, ``col``, ``name`` of every use with ``kind`` (``binding``, ``parameter``, or ``name`` if
    nothing binds it), ``sure`` (a binding is sure to have run) and the ``values`` bound, in order.

    ``rows`` are those of :func:`treesift.sources.python_names.names`; a row that comes again counts once. The key of
    a use is its place. With ``in_order`` the rows of a file follow one another in one partition already, as they
    leave ``names``, and are not dealt out once more.
    """
    shown = F.when(F.col("kind") == "binding", F.coalesce("value", F.lit("?"))).alias("value")
    kept = rows.select("path", "kind", "scope", "scopes", "name", "line", "col", "branches", "ordinal", shown)
    # Sorting compares the hash first, which is one number; paths that share it are still told apart.
    together = kept if in_order else kept.repartition("path").sortWithinPartitions(F.xxhash64("path"), "path")
    shaped = rows.sparkSession.createDataFrame([], LOOKUPS).schema
    schema = to_arrow_schema(shaped)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _looked_up(batches, schema)

    return together.mapInArrow(run, shaped)
