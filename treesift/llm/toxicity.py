"""Toxicity by a subsequence string kernel, Nystroem landmarks and a linear support vector machine.

A unit is a word, a run of single characters that white space separates, or two neighbouring words that
together begin and end like a known insult. The kernel of two units sums, over the character triples both
contain in order within ``SPAN`` characters, ``DECAY`` to the power of the spans they take in each; it is
divided by the roots of both self kernels. A unit's two ends count as characters. Marks and spaces match
nothing and only widen a span, so ``i.d-i_o t`` stays close to ``idiot``. Units longer than ``WINDOW`` are
read in overlapping windows.

Training takes sentences of labelled documents (a bounded sample of ``per_class`` documents of each
label, of near copies the first, of a text of over 50,000 code points a window) as bags of units: no unit of a benign sentence is an insult, and a toxic
document has a sentence with one. Units that toxic documents hold significantly more often start as
positive; landmarks are spread over these and over frequent benign units; a linear machine with squared
hinge loss is solved exactly on the Nystroem features of the units, then the choice of positive units is
repeated with its margins, and the worst benign units are added. A logistic curve, fitted on sampled
documents kept out of training, turns a document's greatest margin and how many of its units lean to
insults (all, per unit, different ones) into its score.

The kernel with a landmark is an inner product over triples, so the trained machine is one weight per
triple: a unit's margin is a sum over its triples, divided by the root of its self kernel.

Null and empty texts get the score of no evidence (the curve at the margin -1 and no hits). A text that
repeats in the sample teaches once. Without labels of both kinds every score is 0. Repeated rows get the same
result; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from dataclasses import dataclass, replace
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treesift.llm.common import keep_texts, map_texts, narrow, raw_texts
from treesift.llm.sampling import sample_by_class, sampled_texts

DECAY = 0.6
SPAN = 9
WINDOW = 24
CODES = 64
_UNITS_KEPT = 250_000
_SPACED = re.compile(r"(?<!\S)(?:\S\s+){2,}\S(?!\S)")
_SENTENCE = re.compile(r"[.!?]\s|\n")
_FIRST, _LAST = "\x02", "\x03"  # a unit's ends, which count as characters
_EDGES = ".,;:!?*#$%&()\"'"
_NO_EVIDENCE = -1.0
_FAR = -0.6
_TRIPLES: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def code_of(ch: str) -> int:
    """0 for marks and space; letters a-z and digits apart, other letters share the remaining codes."""
    if "a" <= ch <= "z":
        return ord(ch) - 96
    if ch == _FIRST:
        return CODES - 2
    if ch == _LAST:
        return CODES - 1
    if not ch.isalnum():
        return 0
    return 27 + ord(ch) * 31 % (CODES - 29)


class _Codes(dict):
    def __missing__(self, ch: str) -> int:
        self[ch] = found = code_of(ch)
        return found


_CODE = _Codes()


def unit_times(text: str, edges: frozenset[str] = frozenset()) -> Counter:
    """Units of a text, lower-cased, and how often it holds each.

    Two neighbouring words are a unit too if together they begin and end like one of ``edges``.
    """
    low = text.lower()
    words = low.split()
    times: Counter = Counter()
    for word, n in Counter(words).items():
        times[word.strip(_EDGES)] += n
    if edges:
        heads = {edge[:3] for edge in edges}
        for i, pair in enumerate(map(str.__add__, words, words[1:])):
            if pair[:3] in heads:
                first, second = words[i], words[i + 1].rstrip(_EDGES)
                if len(first) + len(second) < WINDOW - 2 and pair[:3] + (first + second)[-3:] in edges:
                    times[f"{first} {second}"] += 1
    if _SPACED.search(low):
        for m in _SPACED.finditer(low):
            times[" ".join(m.group().split())] += 1
    return times


def units(text: str) -> list[str]:
    return list(unit_times(text))


def windows(unit: str) -> list[str]:
    """The unit between its ends, or overlapping windows of a long one."""
    if not unit:
        return []
    unit = f"{_FIRST}{unit}{_LAST}"
    if len(unit) <= WINDOW:
        return [unit]
    return [unit[k : k + WINDOW] for k in range(0, len(unit) - WINDOW // 2, WINDOW // 2)]


def _places(n: int) -> tuple[np.ndarray, np.ndarray]:
    if n not in _TRIPLES:
        at = [x for x in combinations(range(n), 3) if x[2] - x[0] < SPAN]
        at = np.array(at, dtype=np.int64).reshape(-1, 3)
        _TRIPLES[n] = at, DECAY ** (at[:, 2] - at[:, 0] + 1.0)
    return _TRIPLES[n]


def triples(same_length: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Codes and weights of all triples of equally long units; a code of 0 counts nothing."""
    n = len(same_length[0])
    joined = "".join(same_length)
    codes = np.fromiter(map(_CODE.__getitem__, joined), dtype=np.int32, count=len(joined)).reshape(-1, n)
    at, weight = _places(n)
    a, b, c = codes[:, at[:, 0]], codes[:, at[:, 1]], codes[:, at[:, 2]]
    code = (a * CODES + b) * CODES + c
    if (codes == 0).any():
        valid = (a > 0) & (b > 0) & (c > 0)
        return np.where(valid, code, 0), np.where(valid, weight, 0.0)
    return code, np.broadcast_to(weight, code.shape)


def self_roots(code: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Roots of the self kernels, which add a triple's weights before squaring."""
    if not code.size:
        return np.zeros(len(code))
    key = (np.arange(len(code))[:, None] * CODES**3 + code).ravel()
    order = np.argsort(key)
    key, flat = key[order], weights.ravel()[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    sums = np.add.reduceat(flat, first)
    return np.sqrt(np.bincount(key[first] // CODES**3, weights=sums**2, minlength=len(code)))


def by_length(items: list[str]) -> dict[int, list[int]]:
    groups: dict[int, list[int]] = {}
    for i, u in enumerate(items):
        if len(u) >= 3:
            groups.setdefault(len(u), []).append(i)
    return groups


def unit_margins(items: list[str], weights: np.ndarray, bias: float) -> np.ndarray:
    """Margins of units no longer than a window; those without triples have no evidence.

    Without repeated triples the self kernel is the sum of squared weights, and never less. The margin
    by that sum is a bound from above; far below the border it stands for the margin.
    """
    out = np.full(len(items), _NO_EVIDENCE)
    for n, places in by_length(items).items():
        step = max(1, 200_000 // max(1, len(_places(n)[0])))
        for k in range(0, len(places), step):
            part = np.array(places[k : k + step])
            code, weight = triples([items[i] for i in part])
            value = np.einsum("ij,ij->i", weights[code], weight)
            least = np.sqrt(np.einsum("ij,ij->i", weight, weight))
            value = np.where(least > 0, np.maximum(value, 0) / np.where(least > 0, least, 1) + bias, _NO_EVIDENCE)
            near = np.flatnonzero(value > _FAR)
            if len(near):
                exact = self_roots(code[near], weight[near])
                value[near] = (value[near] - bias) * least[near] / exact + bias
            out[part] = value
    return out


def kernel_columns(items: list[str], landmarks: list[str]) -> np.ndarray:
    """Normalised kernel of every item with every landmark."""
    tables = np.zeros((len(landmarks), CODES**3), dtype=np.float32)
    for j, mark in enumerate(landmarks):
        code, weight = triples([mark])
        np.add.at(tables[j], code[0], weight[0] / max(self_roots(code, weight)[0], 1e-12))
    tables[:, 0] = 0
    out = np.zeros((len(items), len(landmarks)))
    for n, places in by_length(items).items():
        step = max(1, 200_000 // max(1, len(_places(n)[0])))
        for k in range(0, len(places), step):
            part = places[k : k + step]
            code, weight = triples([items[i] for i in part])
            norm = self_roots(code, weight)
            norm = np.where(norm > 0, norm, 1)
            for j in range(len(landmarks)):
                out[part, j] = np.einsum("ij,ij->i", tables[j][code], weight) / norm
    return out


@dataclass(frozen=True)
class ToxicityModel:
    weights: np.ndarray  # one per triple of codes
    bias: float
    edges: frozenset[str]  # first and last three characters of units that count against a text
    curve: np.ndarray  # one weight per feature of a text, then the offset
    trained: bool

    def score(self, features: np.ndarray) -> np.ndarray:
        """Scores of the rows of :meth:`_Scorer.features`."""
        if not self.trained:
            return np.zeros(len(features))
        return 1 / (1 + np.exp(-np.clip(features @ self.curve[:-1] + self.curve[-1], -40, 40)))


def summary(margins: np.ndarray, times: np.ndarray) -> tuple[float, float, float, float]:
    """Features of a text: its worst unit, and how many units (all, per unit, different) lean to insults."""
    if not len(margins):
        return _NO_EVIDENCE, 0.0, math.log(0.3 / 15), 0.0
    lean = np.clip(margins + 0.5, 0, 1)
    hits, n = float((lean * times).sum()), float(times.sum())
    return float(margins.max()), math.log1p(hits), math.log((hits + 0.3) / (n + 15)), math.log1p(float(lean.sum()))


def _logistic(features: np.ndarray, truth: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Weights and offset of a logistic curve, by Newton steps with a ridge on standardised features."""
    mean, spread = features.mean(axis=0), features.std(axis=0) + 1e-9
    x = np.hstack([(features - mean) / spread, np.ones((len(features), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        curve = (x.T * (p * (1 - p) + 1e-9)) @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(curve, x.T @ (p - truth) + ridge * w)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return np.append(w[:-1] / spread, w[-1] - (w[:-1] * mean / spread).sum())


def _spread(ranked: list[str], most: int, near: float) -> list[str]:
    """The first of ``ranked``, each not too near to those already taken."""
    taken: list[str] = []
    nearest = np.zeros(len(ranked))
    for i, unit in enumerate(ranked):
        if len(taken) == most:
            break
        if nearest[i] < near:
            taken.append(unit)
            nearest = np.maximum(nearest, kernel_columns(ranked, [unit])[:, 0])
    return taken


def _machine(features: np.ndarray, labels: np.ndarray, weight: np.ndarray, ridge: float = 1e-5) -> tuple[np.ndarray, float]:
    """Squared hinge loss with a squared norm, by Newton steps until the gradient vanishes."""
    x = np.hstack([features, np.ones((len(features), 1))])
    share = weight / weight.sum()
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-9
    w = np.zeros(x.shape[1])

    def loss(v):
        slack = np.maximum(0, 1 - labels * (x @ v))
        return (share * slack**2).sum() + (penalty * v * v).sum()

    for _ in range(100):
        slack = 1 - labels * (x @ w)
        active = slack > 0
        gradient = -2 * x[active].T @ (share[active] * labels[active] * slack[active]) + 2 * penalty * w
        if np.abs(gradient).max() < 1e-9:
            break
        curve = 2 * (x[active].T * share[active]) @ x[active] + 2 * np.diag(penalty)
        step, size, now = np.linalg.solve(curve, gradient), 1.0, loss(w)
        while size > 1e-6 and loss(w - size * step) > now:
            size /= 2
        w = w - size * step
    return w[:-1], float(w[-1])


def unlike(texts: list[str], labels: list[int], hashes: int = 24, same: int = 15) -> list[int]:
    """Places of texts to learn from: of those with one label that share most of their words, the first.

    Copies of one document would otherwise count as so much evidence for each of its words.
    """
    if not texts:
        return []
    rng = np.random.default_rng(1)
    factors = rng.integers(1, 1 << 32, hashes, dtype=np.uint64) | np.uint64(1)
    sketches = np.zeros((len(texts), hashes), dtype=np.uint64)
    for i, text in enumerate(texts):
        words = np.array([zlib.crc32(w.encode()) for w in set(text.lower().split())] or [0], dtype=np.uint64)
        mixed = words[:, None] * factors
        sketches[i] = ((mixed ^ (mixed >> np.uint64(29))) * factors).min(axis=0)
    kept: list[int] = []
    marks = np.array(labels)
    for i in range(len(texts)):
        before = np.array(kept, dtype=int)
        before = before[marks[before] == marks[i]]
        if (sketches[before] == sketches[i]).sum(axis=1).max(initial=0) < same:
            kept.append(i)
    return kept


def train(
    texts: list[str], labels: list[int], landmarks: int = 200, negatives: int = 8000, rounds: int = 2, seed: int = 5
) -> ToxicityModel:
    """A model of a bounded list of labelled texts; every third one is kept for calibration."""
    nothing = ToxicityModel(np.zeros(CODES**3, np.float32), 0.0, frozenset(), np.zeros(5), False)
    bags, held = [], []
    for i, k in enumerate(unlike(texts, labels)):
        text, label = texts[k], labels[k]
        if i % 3 == 2:
            held.append((text, label))
        else:
            sentences = [set(units(s)) for s in _SENTENCE.split(text)] + [set(units(text))]
            bag = {w for u in set().union(*sentences) for w in windows(u) if len(w) >= 3}
            bags.append((bag, label))
    toxic, benign = sum(y for _, y in bags), sum(1 - y for _, y in bags)
    if not toxic or not benign:
        return nothing
    counts: dict[str, list[int]] = {}
    for bag, label in bags:
        for u in bag:
            counts.setdefault(u, [0, 0])[label] += 1

    def evidence(u: str) -> float:
        """Log-likelihood ratio of the unit's presence by label; below 0 if it speaks for benign."""
        b, t = counts[u]
        p, q, r = t / toxic, b / benign, (t + b) / (toxic + benign)

        def ll(k, n, x):
            return (k * np.log(x) if k else 0.0) + ((n - k) * np.log(1 - x) if n > k else 0.0)

        g = 2 * (ll(t, toxic, p) + ll(b, benign, q) - ll(t, toxic, r) - ll(b, benign, r))
        return float(g if p > q else -g)

    names = sorted(counts)
    strength = {u: evidence(u) for u in names if counts[u][1]}
    ranked = sorted((u for u in strength if strength[u] > 6.63), key=lambda u: (-strength[u], u))
    # Units in more benign than expected toxic documents are no insults, however significant.
    positive = {u for u in ranked if counts[u][0] / benign <= 0.1 * counts[u][1] / toxic}
    if not positive:
        return nothing
    common = sorted((u for u in names if counts[u][0] and u not in positive), key=lambda u: (-counts[u][0], u))
    marks = _spread([u for u in ranked if u in positive], landmarks // 2, 0.7)
    marks += _spread(common[:400], landmarks - len(marks), 0.7)
    gram = kernel_columns(marks, marks)
    values, vectors = np.linalg.eigh((gram + gram.T) / 2)
    keep = values > 1e-6 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])  # features: kernel columns times this
    rng = np.random.default_rng(seed)
    drawn = set(common[: negatives // 2])
    rest = np.array(common[negatives // 2 :], dtype=object)
    drawn |= set(rng.permutation(rest)[: negatives // 2].tolist())
    table = np.zeros(CODES**3, dtype=np.float32)
    bias = 0.0
    for _ in range(rounds):
        chosen, refused = sorted(positive), sorted(drawn - positive)
        features = kernel_columns(chosen + refused, marks) @ root
        y = np.array([1.0] * len(chosen) + [-1.0] * len(refused))
        size = np.array([np.sqrt(counts[u][1]) for u in chosen] + [1.0] * len(refused))
        size[: len(chosen)] *= 1.0 / size[: len(chosen)].sum()
        size[len(chosen) :] *= 3.0 / size[len(chosen) :].sum()
        w, bias = _machine(features, y, size)
        gamma = root @ w
        table = np.zeros(CODES**3)
        for g, mark in zip(gamma, marks):
            code, weight = triples([mark])
            np.add.at(table, code[0], g * weight[0] / max(self_roots(code, weight)[0], 1e-12))
        table[0] = 0
        table = table.astype(np.float32)
        margins = dict(zip(names, unit_margins(names, table, bias)))
        # Witnesses: a toxic document's best unit, if no benign document holds it; and hard benign units.
        for bag, label in bags:
            if label and bag:
                best = max(sorted(bag), key=lambda u: margins[u])
                if margins[best] > 0 and not counts[best][0] and counts[best][1] > 1:
                    positive.add(best)
        drawn |= set(sorted((u for u in common if counts[u][0]), key=lambda u: -margins[u])[: negatives // 4])
    ends = frozenset(u[1:4] + u[-4:-1] for u in positive if u[0] == _FIRST and u[-1] == _LAST and len(u) > 6)
    model = ToxicityModel(table, float(bias), ends, np.array([4.0, 0, 0, 0, 0]), True)
    scorer = _Scorer(model)
    truth = np.array([y for _, y in held])
    if truth.sum() and (1 - truth).sum():
        curve = _logistic(scorer.features([t for t, _ in held]), truth)
        model = replace(model, curve=curve)
    return model


class _Scorer:
    """Features of texts from the margins of their units, remembered up to a bound."""

    def __init__(self, model: ToxicityModel):
        self.model = model
        self.known: dict[str, float] = {}

    def _margins(self, found: list[str]) -> dict[str, float]:
        pieces = [(u, w) for u in found for w in windows(u)]
        values = unit_margins([w for _, w in pieces], self.model.weights, self.model.bias)
        margins = dict.fromkeys(found, _NO_EVIDENCE)
        for (u, _), v in zip(pieces, values.tolist()):
            if v > margins[u]:
                margins[u] = v
        return margins

    def features(self, texts: list[str]) -> np.ndarray:
        """One row per text. Units not yet known are judged together."""
        rows = np.empty((len(texts), 4))
        waiting: list[tuple[int, Counter]] = []
        missing: dict[str, None] = {}

        def settle() -> None:
            if missing:
                self.known.update(self._margins(list(missing)))
            for k, times in waiting:
                margins = np.fromiter(map(self.known.__getitem__, times), dtype=float, count=len(times))
                rows[k] = summary(margins, np.fromiter(times.values(), dtype=float, count=len(times)))
            waiting.clear()
            missing.clear()

        for k, text in enumerate(texts):
            times = unit_times(text, self.model.edges)
            if len(times) > _UNITS_KEPT:  # a text of very many units needs no more memory
                rows[k] = summary(self._long(list(times)), np.fromiter(times.values(), dtype=float, count=len(times)))
                continue
            if len(self.known) + len(missing) + len(times) > 2 * _UNITS_KEPT:
                settle()
                self.known.clear()
            missing.update(dict.fromkeys(u for u in times if u not in self.known))
            waiting.append((k, times))
        settle()
        return rows

    def _long(self, distinct: list[str]) -> np.ndarray:
        parts = [distinct[k : k + _UNITS_KEPT] for k in range(0, len(distinct), _UNITS_KEPT)]
        return np.concatenate([list(self._margins(part).values()) for part in parts])


_CURRENT: list = []  # the worker's model and its scorer


def worker_scorer(model: ToxicityModel) -> _Scorer:
    """The worker's scorer of ``model``; another model takes its place."""
    if not _CURRENT or _CURRENT[0] is not model:
        _CURRENT[:] = [model, _Scorer(model)]
    return _CURRENT[1]


def fit(
    docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text",
    label_col: str = "toxic", per_class: int = 1200,
) -> ToxicityModel:
    """Train on labelled documents for which ``learn`` (over the id, named ``id``) holds."""
    ids = narrow(docs, id=id_col).where(learn & F.col("id").isNotNull())
    marks = narrow(labels, id=id_col, label=label_col).where("label in (0, 1)").groupBy("id").agg(F.max("label").alias("label"))
    sample = sample_by_class(ids.join(marks, "id"), per_class, "toxicity")
    rows = sampled_texts(narrow(docs, id=id_col, text=text_col), sample)
    return train([t for t, _ in rows], [int(y) for _, y in rows])


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``score`` of every text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # one number per triple of codes

    def worker(batch: pa.RecordBatch) -> pa.RecordBatch:
        scorer = worker_scorer(shared.value)
        features = scorer.features([t.decode() for t in raw_texts(batch, "text")])
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(shared.value.score(features), pa.float64())], ["doc_id", "score"]
        )

    return map_texts(narrow(docs, doc_id=id_col, text=text_col), worker, "doc_id bigint, score double")


def without_toxic(docs: DataFrame, model: ToxicityModel, border: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, that score below ``border``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def decide(texts: list[bytes]) -> list[bool]:
        scorer = worker_scorer(shared.value)
        return (shared.value.score(scorer.features([t.decode() for t in texts])) < border).tolist()

    return keep_texts(docs, decide, text_col)
