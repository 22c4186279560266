"""Bounded training samples, the same for the same rows however they are partitioned."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Code points a text teaches with at most (predictions read whole texts): of a longer one, a window drawn by its id.
WINDOW_POINTS = 50_000


def sample_by_class(keys: DataFrame, per_class: int, seed: str) -> list[tuple]:
    """(``id``, ``label``) of about ``per_class`` ids of each label at most; an id with several labels has the
    one that sorts first.

    Counts by label come first; a row is taken if a hash of its id falls under its label's share. The
    draw is Poisson, trimmed to ``per_class``, so that its size does not grow with the table.
    """
    keys = keys.groupBy("id").agg(F.min("label").alias("label"))
    counts = {r["label"]: r["n"] for r in keys.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return []
    kind = dict(keys.dtypes)["label"]
    shares = [(c, min(1.0, 1.2 * per_class / n)) for c, n in counts.items()]
    shares = keys.sparkSession.createDataFrame(shares, f"label {kind}, share double")
    drawn = keys.withColumn("draw", F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1_000_003)))
    drawn = drawn.join(F.broadcast(shares), "label").where(F.col("draw") < F.col("share") * 1_000_003)
    kept: dict = {}
    for row in sorted(drawn.select("id", "label", "draw").collect(), key=lambda r: (r["draw"], repr(r["id"]))):
        group = kept.setdefault(row["label"], [])
        if len(group) < per_class:
            group.append((row["id"], row["label"]))
    return [pair for c in sorted(kept, key=repr) for pair in kept[c]]


def sampled_texts(
    docs: DataFrame, sample: list[tuple], seed: int = 3, window: int = WINDOW_POINTS
) -> list[tuple[str, object]]:
    """(text, label) of the sampled ids, in an order that mixes the labels. ``docs``: ``id``, ``text``.

    Of rows that repeat an id, the text that sorts first teaches, so that no more come than were sampled.
    """
    if not sample:
        return []
    ids = docs.sparkSession.createDataFrame([(i,) for i in dict(sample)], f"id {dict(docs.dtypes)['id']}")
    size = F.length("text")
    start = F.pmod(F.xxhash64(F.lit("window"), "id"), F.greatest(size - window, F.lit(0)) + 1).cast("int") + 1
    text = F.when(size <= window, F.col("text")).otherwise(F.substring("text", start, F.lit(window)))
    found = docs.where(F.col("text").isNotNull()).join(F.broadcast(ids), "id").select("id", text.alias("text"))
    found = found.groupBy("id").agg(F.min("text").alias("text")).collect()
    labels = dict(sample)
    rows = [(r["text"], labels[r["id"]]) for r in sorted(found, key=lambda r: (repr(r["id"]), r["text"]))]
    return [rows[i] for i in np.random.default_rng(seed).permutation(len(rows))]


def platt(margins: np.ndarray, labels: np.ndarray, steps: int = 200) -> tuple[float, float]:
    """Slope and offset of a logistic curve, by Newton's method on smoothed targets."""
    positive, negative = float(labels.sum()), float((1 - labels).sum())
    target = np.where(labels > 0, (positive + 1) / (positive + 2), 1 / (negative + 2))
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -40, 40)))
        w = p * (1 - p) + 1e-9
        g = np.array([((p - target) * margins).sum() + 1e-3 * a, (p - target).sum()])
        h = np.array([[(w * margins**2).sum() + 1e-3, (w * margins).sum()], [(w * margins).sum(), w.sum() + 1e-9]])
        step = np.linalg.solve(h, g)
        size = np.abs(step).max()
        a, b = a - step[0] * min(1, 2 / max(size, 1e-12)), b - step[1] * min(1, 2 / max(size, 1e-12))
        if size < 1e-8:
            break
    return float(a), float(b)
