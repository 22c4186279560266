"""Periodic runs of words: maximal stretches that repeat with a period, and texts without the repeats.

A run is a stretch of words whose smallest period is ``q``, at least ``least_periods * q`` and ``least_words``
words long, that no neighbouring word continues. At each dyadic scale ``B`` the words are cut into blocks
of ``B``; an exact integer number-theoretic transform correlates each block with the window that follows
it and gives, for every distance in ``[B, 2 B)``, the sum of squared differences of word numbers. A sum of
zero is an occurrence; its distance seeds an extension to both sides, and what is long enough and has no
smaller period is a run. With four periods or more, a run of period ``q`` in ``[B, 2 B)`` holds two whole
neighbouring blocks whose words all come again within ``2 B`` words, so other blocks need no transform.
Sums are taken modulo as many primes as their greatest value asks for; the extension compares words
themselves, so a result never rests on a residue.

Texts are read once, in slices of about 4 MiB (a longer text is a slice of its own: memory and time grow
with it, at most about ``n log^2 n``); nothing is shuffled. Words are maximal stretches without ASCII white
space, compared as bytes. Null and empty texts, and texts of white space, have no words: no runs and an
empty collapsed text. Each row stands for itself, so repeated rows and null ids come back as they are. An
empty table gives no rows; other columns are not read. Texts of over 2**27 words are refused.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from treesift.llm.common import map_texts, narrow, split_words

# Primes k * 2**m + 1, each with 3 as a primitive root.
PRIMES = (469762049, 167772161, 998244353)
# Points of one batch of transforms.
BATCH_POINTS = 1 << 19

SCHEMA = """doc_id bigint, n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>,
    best struct<start: bigint, length: bigint, period: bigint>, collapsed binary"""
_RUN = pa.struct([(name, pa.int64()) for name in ("start", "length", "period")])


def _twiddles(size: int, prime: int, inverse: bool) -> list[np.ndarray]:
    """Powers of the root for each halving of ``size``."""
    found, half = [], size // 2
    while half:
        root = pow(3, (prime - 1) // (2 * half), prime)
        powers = np.ones(half, dtype=np.uint64)
        step = pow(root, -1, prime) if inverse else root
        done = 1
        while done < half:
            take = min(done, half - done)
            powers[done : done + take] = powers[:take] * np.uint64(pow(step, done, prime)) % np.uint64(prime)
            done += take
        found.append(powers[:, None])
        half //= 2
    return found


def _forward(a: np.ndarray, prime: int) -> np.ndarray:
    """Transforms of the columns, in bit-reversed order."""
    size, columns = a.shape
    m = np.uint64(prime)
    for powers in _twiddles(size, prime, inverse=False):
        half = len(powers)
        a = a.reshape(-1, 2, half, columns)
        out = np.empty_like(a)
        out[:, 0] = (a[:, 0] + a[:, 1]) % m
        out[:, 1] = (a[:, 0] + (m - a[:, 1])) * powers % m
        a = out
    return a.reshape(size, columns)


def _backward(a: np.ndarray, prime: int) -> np.ndarray:
    """The inverse of ``_forward``, in natural order."""
    size, columns = a.shape
    m = np.uint64(prime)
    for powers in reversed(_twiddles(size, prime, inverse=True)):
        half = len(powers)
        a = a.reshape(-1, 2, half, columns)
        turned = a[:, 1] * powers % m
        out = np.empty_like(a)
        out[:, 0] = (a[:, 0] + turned) % m
        out[:, 1] = (a[:, 0] + (m - turned)) % m
        a = out
    return a.reshape(size, columns) * np.uint64(pow(size, -1, prime)) % m


def occurrences(blocks: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Where each block occurs in its window: rows are offsets, columns blocks.

    ``blocks`` has ``B`` rows, ``windows`` ``2 B``; the offsets are 0 to ``B - 1``.
    """
    size = len(blocks)
    greatest = int(max(blocks.max(initial=0), windows.max(initial=0)))
    zero, reach = np.ones((size, blocks.shape[1]), dtype=bool), 1
    for prime in PRIMES:
        if (prime - 1) % (2 * size):
            continue
        m = np.uint64(prime)
        b, w = blocks % m, windows % m
        padded = np.zeros_like(w)
        padded[:size] = b[::-1]
        product = _backward(_forward(padded, prime) * _forward(w, prime) % m, prime)[size - 1 : 2 * size - 1]
        before = np.zeros((2 * size + 1, w.shape[1]), dtype=np.uint64)
        np.cumsum(w * w % m, axis=0, out=before[1:])
        squares = (before[size : 2 * size] - before[:size] + (b * b % m).sum(axis=0, dtype=np.uint64)) % m
        zero &= squares == product * np.uint64(2) % m
        reach *= prime
        if reach > size * greatest * greatest:
            break
    return zero


def _same_ahead(words: np.ndarray, i: int, distance: int) -> int:
    """How many words from ``i`` on equal the word ``distance`` later."""
    n, step, done = len(words) - distance, 64, 0
    while i + done < n:
        end = min(n, i + done + step)
        differs = words[i + done : end] != words[i + done + distance : end + distance]
        if differs.any():
            return done + int(differs.argmax())
        done, step = end - i, step * 2
    return done


def _same_behind(words: np.ndarray, i: int, distance: int) -> int:
    """How many words before ``i`` equal the word ``distance`` later."""
    step, done = 64, 0
    while done < i:
        start = max(0, i - done - step)
        differs = (words[start : i - done] != words[start + distance : i - done + distance])[::-1]
        if differs.any():
            return done + int(differs.argmax())
        done, step = i - start, step * 2
    return done


def _has_smaller_period(words: np.ndarray, start: int, period: int) -> bool:
    """Whether a stretch of at least two periods from ``start`` has a period that divides ``period``."""
    rest, factor = period, 2
    while rest > 1:
        if factor * factor > rest:
            factor = rest
        if rest % factor == 0:
            part = period // factor
            if np.array_equal(words[start : start + period], words[start + part : start + part + period]):
                return True
            while rest % factor == 0:
                rest //= factor
        factor += 1
    return False


def find_runs(words: np.ndarray, least_words: int = 6, least_periods: int = 4) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs in order of start and period.

    ``words`` are numbers from 1; a 0 equals nothing, not even another 0, and so parts texts.
    """
    if least_periods < 4:
        raise ValueError("blocks find runs of four periods or more")
    n = len(words)
    order = np.argsort(words, kind="stable")
    gap = np.full(n, n + 1, dtype=np.int64)
    again = words[order[1:]] == words[order[:-1]]
    gap[order[:-1][again]] = np.diff(order)[again]
    gap[words == 0] = n + 1
    padded = words
    runs: list[tuple[int, int, int]] = []
    scale = 1
    while least_periods * scale <= n:
        near = gap < 2 * scale
        starts = np.flatnonzero(near[:-1] & near[1:]) * scale
        if runs and len(starts):  # blocks whose window stays inside a run of a smaller period add nothing
            runs.sort()
            ends = np.maximum.accumulate([s + length for s, length, _ in runs])
            at = np.searchsorted([s for s, _, _ in runs], starts, side="right") - 1
            starts = starts[(at < 0) | (ends[at] < starts + 3 * scale)]
        if len(starts):
            if len(padded) < n + 3 * scale:
                padded = np.concatenate([words, np.zeros(3 * scale, words.dtype)])
            runs += _runs_of_scale(words, padded, starts, scale, runs, least_words, least_periods)
        gap = gap[: len(gap) // 2 * 2].reshape(-1, 2).max(axis=1)
        scale *= 2
    return sorted(runs)


def _runs_of_scale(words, padded, starts, scale, known, least_words, least_periods):
    """New runs with a period in ``[scale, 2 scale)`` among the blocks at ``starts``."""
    known = sorted(known)
    begins, reach = [s for s, _, _ in known], []
    for s, length, _ in known:
        reach.append(max(s + length, reach[-1] if reach else 0))
    found: dict[tuple[int, int], tuple[int, int, int]] = {}
    latest: dict[int, tuple[int, int]] = {}
    batch = max(1, BATCH_POINTS // (2 * scale))
    for k in range(0, len(starts), batch):
        part = starts[k : k + batch]
        around = padded[part[None, :] + np.arange(3 * scale)[:, None]]
        _, around = np.unique(around, return_inverse=True)  # small numbers, so that one prime often suffices
        around = around.reshape(3 * scale, len(part)).astype(np.uint64)
        zero = occurrences(around[:scale], around[scale:])
        for column, offset in np.argwhere(zero.T).tolist():
            i, distance = int(part[column]), scale + offset
            stretch = latest.get(distance)
            if stretch and stretch[0] <= i and i + scale + distance <= stretch[1]:
                continue  # the same stretch of this period
            j, inside = bisect_right(begins, i) - 1, False
            while j >= 0 and reach[j] >= i + scale + distance and not inside:
                s, length, period = known[j]
                inside = s + length >= i + scale + distance and distance % period == 0
                j -= 1
            if inside:
                continue
            ahead = _same_ahead(words, i, distance)
            if ahead < scale:
                continue  # zero only as a residue
            start = i - _same_behind(words, i, distance)
            length = i + ahead + distance - start
            latest[distance] = (start, start + length)
            if length >= max(least_words, least_periods * distance) and not _has_smaller_period(words, start, distance):
                found[start, distance] = (start, length, distance)
    return list(found.values())


def _kept(runs: list[tuple[int, int, int]], n: int) -> np.ndarray:
    """Which of ``n`` words no run repeats."""
    level = np.zeros(n + 1, dtype=np.int64)
    for start, length, period in runs:
        level[start + period] += 1
        level[start + length] -= 1
    return np.cumsum(level[:-1]) == 0


def _best(runs):
    """The run of the greatest exponent; ties go to the smallest start, then period."""
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    return best and dict(zip(("start", "length", "period"), best))


def periodic_runs(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    least_words: int = 6,
    least_periods: int = 4,
    reorder: Callable[[int | None, int], np.ndarray | None] | None = None,
) -> DataFrame:
    """``doc_id``, ``n_words``, ``runs``, ``best`` (null without runs) and ``collapsed`` of every row.

    ``collapsed`` joins by one space the words that are in no run or among the first period of each run that
    holds them. ``reorder`` may name, by id and number of words, the words to read in their stead.
    """

    def worker(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = batch.column("doc_id").to_pylist()
        values, offsets = split_words(batch.column("text"))
        if len(values) > 1 << 27:
            raise ValueError("a text of over 2**27 words")
        sizes = np.diff(offsets)
        if reorder is not None:
            places = np.arange(len(values))
            for k, (doc_id, n) in enumerate(zip(ids, sizes.tolist())):
                moved = reorder(doc_id, n)
                if moved is not None:
                    places[offsets[k] : offsets[k + 1]] = offsets[k] + moved
            values = values.take(pa.array(places))
        numbers = values.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64) + 1
        # One 0 behind each text.
        shifted = np.arange(len(numbers)) + np.repeat(np.arange(len(sizes)), sizes)
        row = np.zeros(len(numbers) + len(sizes), dtype=np.int64)
        row[shifted] = numbers
        begins = offsets[:-1] + np.arange(len(sizes))
        runs = [[] for _ in ids]
        keep = np.ones(len(numbers), dtype=bool)
        for start, length, period in find_runs(row, least_words, least_periods):
            k = bisect_right(begins, start) - 1
            runs[k].append((start - int(begins[k]), length, period))
        for k, some in enumerate(runs):
            if some:
                keep[offsets[k] : offsets[k + 1]] = _kept(some, int(sizes[k]))
        before = np.concatenate([[0], np.cumsum(keep)]).astype(np.int32)
        kept = pa.ListArray.from_arrays(pa.array(before[offsets]), values.filter(pa.array(keep)))
        flat = [r for some in runs for r in some]
        columns = [pa.array([r[c] for r in flat], pa.int64()) for c in range(3)]
        ends = pa.array(np.cumsum([0, *map(len, runs)]), pa.int32())
        return pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.array(sizes, pa.int64()),
                pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(columns, fields=list(_RUN))),
                pa.array([_best(some) for some in runs], _RUN),
                pc.binary_join(kept, " ").cast(pa.binary()),
            ],
            ["doc_id", "n_words", "runs", "best", "collapsed"],
        )

    return map_texts(narrow(docs, doc_id=id_col, text=text_col), worker, SCHEMA)
