"""Filter interaction audit: what each filter removes behind every prefix of every filter order.

Each filter has a relation of the ids that fail it, stored once. The survivors of a prefix are the ids
left by left-anti joins with its filters' relations. They depend on the set of filters only, so ``n``
filters need ``2**n`` sets and not ``n!`` orders; an order's step is the difference between two of them.
Left-semi joins find the ids that any filter touches: the others survive every prefix and are counted
once. All joins share one shuffle of the touched ids and one of each relation, and are aggregated by part
before the next shuffle.

From the survivors, counted as rows, rows labelled good and rows labelled toxic, follow for every order and
step what is kept and removed, what fails its filter but was removed earlier (redundant), what fails this
filter alone, the labels lost, and the removals summed over all orders (the Shapley value times ``n!``).

An id is a digest of ``doc_id`` and text, so that rows which repeat an id with another text stand for
themselves; rows equal in both are one id with a count. Rows are judged in one pass over the texts without a
shuffle of texts. A text shared by more than a thousandth of all rows is looked up by broadcast (at most
1,000 such texts), others by a join. Null and empty texts are empty texts: they have no words and repeat
one another. A null ``doc_id`` is neither larger nor smaller than another and has no labels. A null part is
the empty string. Of repeated labels of a document, any that says good (toxic) counts. An empty table gives
no rows; other columns are not read.
"""

from __future__ import annotations

from functools import reduce
from hashlib import sha256
from itertools import combinations, permutations
from math import factorial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treesift.llm.common import map_texts, narrow, raw_texts, shared_folder, split_words, stored

MOST_FILTERS = 7
_HOT_SHARE = 1000
_COUNTS = ("n", "good", "toxic")


MARKS = b"#$%&*|"


def measures(texts: pa.Array) -> dict[str, np.ndarray]:
    """Words, different words, capitals A-Z, code points and marks of each text."""
    values, offsets = split_words(texts)
    sizes = np.diff(offsets)
    words = values.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    pairs = np.unique(row * (len(values) + 1) + words)
    texts = texts.cast(pa.large_binary())
    bounds = np.concatenate([[0], np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))])
    raw = np.frombuffer(b"".join(texts.to_pylist()), dtype=np.uint8)

    def count(kinds: np.ndarray) -> np.ndarray:
        before = np.concatenate([[0], np.cumsum(kinds[raw], dtype=np.int64)])
        return np.diff(before[bounds])

    byte = np.arange(256)
    return {
        "n_words": sizes,
        "n_different": np.bincount(pairs // (len(values) + 1), minlength=len(sizes)),
        "n_capitals": count((byte >= ord("A")) & (byte <= ord("Z"))),
        "n_points": count(byte & 0xC0 != 0x80),
        "n_marks": count(np.isin(byte, list(MARKS))),
    }


def text_filters() -> dict[str, Column]:
    """Failure conditions by letter over the measures: few words, repetitive, capitals, marks."""
    return {
        "A": F.col("n_words") < 50,
        "B": 100 * F.col("n_different") < 65 * F.col("n_words"),
        "C": 100 * F.col("n_capitals") > 5 * F.col("n_points"),
        "D": F.col("n_marks") > 0,
    }


def _measured(docs: DataFrame) -> DataFrame:
    names = ("n_words", "n_different", "n_capitals", "n_points", "n_marks")

    def worker(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = pc.fill_null(batch.column("text"), "")
        found = measures(texts)
        digests = pa.array([sha256(t).digest() for t in raw_texts(batch, "text")], pa.binary())
        columns = [batch.column("doc_id"), batch.column("part"), digests]
        columns += [pa.array(found[name], pa.int64()) for name in names]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "part", "digest", *names])

    schema = "doc_id bigint, part string, digest binary, " + ", ".join(f"{name} bigint" for name in names)
    return map_texts(docs, worker, schema)


def _judged(docs: DataFrame, filters: dict[str, Column], repeats: str | None) -> DataFrame:
    """``doc_id``, ``part``, ``id`` and the filters that each row ``fails``."""
    failed = F.filter(F.array(*[F.when(c, F.lit(name)) for name, c in filters.items()]), lambda x: x.isNotNull())
    rows = stored(_measured(docs).select("doc_id", "part", "digest", failed.alias("fails")), "verdicts")
    identity = F.unhex(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit(":"), F.hex("digest"))))
    if repeats is None:
        return rows.select("doc_id", "part", identity.alias("id"), "fails")
    shared = rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("rows"))
    shared = stored(shared.where("rows > 1"), "shared-texts")
    total = rows.count()
    common = F.broadcast(shared.where(F.col("rows") * _HOT_SHARE > total))  # fewer than _HOT_SHARE texts
    found = rows.join(common, "digest").unionByName(
        rows.join(common, "digest", "left_anti").join(
            shared.where(F.col("rows") * _HOT_SHARE <= total), "digest", "left"
        ),
        allowMissingColumns=True,
    )
    later = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))
    fails = F.when(later, F.array_append("fails", F.lit(repeats))).otherwise(F.col("fails"))
    return found.select("doc_id", "part", identity.alias("id"), fails.alias("fails"))


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows with ``good`` and ``toxic``, 1 or 0."""
    flags = labels.where("doc_id is not null").groupBy("doc_id").agg(
        F.max((F.coalesce("quality", F.lit(0)) == 1).cast("bigint")).alias("good"),
        F.max((F.coalesce("toxic", F.lit(0)) == 1).cast("bigint")).alias("toxic"),
    )
    flags = flags.where("good = 1 or toxic = 1")
    known = rows.where("doc_id is not null").join(flags, "doc_id", "left")
    return known.unionByName(rows.where("doc_id is null"), allowMissingColumns=True).fillna(0, ["good", "toxic"])


def survivors(ids: DataFrame, failing: dict[str, DataFrame], letters: list[str]) -> DataFrame:
    """``part``, ``gone`` (a set of filters as sorted letters) and the counts of the ids that pass them all.

    ``ids`` has ``id``, ``part``, ``n``, ``good`` and ``toxic``; ``failing`` one table of ids per filter.
    """
    columns = ("part", *_COUNTS)
    any_filter = reduce(DataFrame.union, [failing[f] for f in letters]).distinct()
    touched = stored(ids.join(any_filter, "id", "left_semi").select("id", *columns), "touched-ids")
    untouched = ids.join(any_filter, "id", "left_anti").select("part", F.lit(None).cast("string").alias("gone"), *_COUNTS)
    left = {"": touched}
    for size in range(1, len(letters) + 1):
        for chosen in combinations(letters, size):
            left["".join(chosen)] = left["".join(chosen[:-1])].join(failing[chosen[-1]], "id", "left_anti")
    branches = [rows.select("part", F.lit(gone).alias("gone"), *_COUNTS) for gone, rows in left.items()]
    found = reduce(DataFrame.union, [*branches, untouched])
    return found.groupBy("part", "gone").agg(*[F.sum(c).alias(c) for c in _COUNTS])


def _steps(letters: list[str]) -> list[tuple[str, int, str, str, str, str]]:
    """(order, step, filter, set before, set after, all others) of every order."""
    rows = []
    for order in permutations(letters):
        for k, f in enumerate(order):
            before, after = "".join(sorted(order[:k])), "".join(sorted(order[: k + 1]))
            rows.append(("".join(order), k + 1, f, before, after, "".join(sorted(set(letters) - {f}))))
    return rows


def interactions(survived: DataFrame, letters: list[str]) -> DataFrame:
    """One row per part, order and step from the counts of :func:`survivors`."""
    entry = F.struct("gone", F.struct(*_COUNTS).alias("left"))
    by_part = survived.groupBy("part").agg(
        F.map_from_entries(F.collect_list(F.when(F.col("gone").isNotNull(), entry))).alias("left"),  # 2**n entries
        *[F.coalesce(F.sum(F.when(F.col("gone").isNull(), F.col(c))), F.lit(0)).alias(f"clean_{c}") for c in _COUNTS],
    )

    def left(gone: Column, count: str) -> Column:
        return F.coalesce(F.col("left")[gone][count], F.lit(0)) + F.col(f"clean_{count}")

    def removed(f: str, before: tuple[str, ...]) -> Column:
        return left(F.lit("".join(before)), "n") - left(F.lit("".join(sorted((*before, f)))), "n")

    shares = []
    for f in letters:
        others, terms = [x for x in letters if x != f], []
        for size in range(len(letters)):
            orders = factorial(size) * factorial(len(letters) - 1 - size)
            terms += [removed(f, before) * orders for before in combinations(others, size)]
        shares.append(reduce(Column.__add__, terms).alias(f))
    steps = F.array(
        *[
            F.struct(*[F.lit(v).alias(n) for v, n in zip(row, ("filter_order", "step", "filter", "before", "after", "others"))])
            for row in _steps(letters)
        ]
    )
    everything = F.lit("".join(letters))
    rows = by_part.withColumn("share", F.struct(*shares)).withColumn("at", F.explode(steps)).select("*", "at.*")
    fails = left(F.lit(""), "n") - left(F.col("filter"), "n")
    gone = left(F.col("before"), "n") - left(F.col("after"), "n")
    share = F.coalesce(*[F.when(F.col("filter") == f, F.col("share")[f]) for f in letters])
    return rows.select(
        "part",
        "filter_order",
        "step",
        "filter",
        left(F.col("after"), "n").alias("kept"),
        gone.alias("removed"),
        (fails - gone).alias("redundant"),
        (left(F.col("others"), "n") - left(everything, "n")).alias("unique_fails"),
        (left(F.col("before"), "good") - left(F.col("after"), "good")).alias("good_lost"),
        (left(F.col("before"), "toxic") - left(F.col("after"), "toxic")).alias("toxic_lost"),
        share.alias("shapley"),
    )


def audit(
    docs: DataFrame,
    labels: DataFrame,
    part_col: str = "source",
    id_col: str = "doc_id",
    text_col: str = "text",
    filters: dict[str, Column] | None = None,
    repeats: str | None = "E",
) -> DataFrame:
    """The audit of ``filters`` (failure conditions by letter over the :func:`measures`) and, unless ``repeats``
    is None, of a filter of that letter that fails rows whose text a smaller id has."""
    docs = narrow(docs, doc_id=id_col, text=text_col, part=part_col)
    docs = docs.withColumn("part", F.coalesce("part", F.lit("")))
    conditions = text_filters() if filters is None else filters
    letters = sorted([*conditions, *([repeats] if repeats else [])])
    if not letters or len(letters) > MOST_FILTERS or len(set(letters)) < len(letters) or any(len(x) != 1 for x in letters):
        raise ValueError(f"1 to {MOST_FILTERS} filters with different one-letter names")
    rows = _judged(docs, conditions, repeats)
    rows = _labelled(rows, narrow(labels, doc_id="doc_id", quality="quality", toxic="toxic"))
    rows = stored(rows.groupBy("id", "part", "good", "toxic", "fails").agg(F.count("*").alias("rows")), "ids")
    counts = [F.col("rows").alias("n")] + [(F.col("rows") * F.col(c)).alias(c) for c in ("good", "toxic")]
    folder = shared_folder(docs.sparkSession, "failing-ids")
    failing = rows.select("id", F.explode("fails").alias("filter")).distinct()
    failing.write.partitionBy("filter").parquet(folder)
    relations = docs.sparkSession.read.schema("id binary, filter string").parquet(folder)
    by_filter = {f: relations.where(F.col("filter") == f).select("id") for f in letters}
    survived = stored(survivors(rows.select("id", "part", *counts), by_filter, letters), "survivors")
    return interactions(survived, letters)
