"""Language identification by averaged hashed subword embeddings and a linear softmax.

A word is its letters between boundary marks; its subwords are all byte runs of 1 to 5 bytes of it,
hashed into buckets. A text is the mean of its subwords' embeddings, a linear layer and a softmax give
the language. Both layers are trained by stochastic gradient descent in numpy on windows of labelled
texts (a bounded sample, ``per_class`` documents of each language at most; a text of over 50,000 code points
teaches with a window of it). Since the layers are linear,
prediction adds one row of logits per subword, and a word's sum is remembered by each worker.

Calibration, on sampled documents kept out of training: a temperature, and a rejection threshold at which
at most ``false_rejections`` of labelled documents would be rejected, never above ``threshold_cap``.

A text that is null or has no letter gets ``und``, score 0, and is rejected. Without any labelled row
every text is ``und``. Ties go to the language that sorts first. Repeated rows get the same result. An
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treesift.llm.common import keep_texts, map_texts, narrow, raw_texts
from treesift.llm.sampling import sample_by_class, sampled_texts

UNDETERMINED = "und"
BUCKETS = 1 << 15
LONGEST = 5
_LETTERS = re.compile(r"[^\W\d_]+")
_WORDS_KEPT = 400_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[str]:
    """Stretches of letters, lower-cased."""
    found = _LETTERS.findall(text.lower())
    if all(map(str.isalpha, found)):
        return found
    # Superscripts, fractions and other numbers are word characters, but no letters.
    parts = ("".join(c if c.isalpha() else " " for c in w).split() if not w.isalpha() else (w,) for w in found)
    return [w for part in parts for w in part]


def subword_buckets(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every subword, and the word it belongs to."""
    raw = np.frombuffer("".join(f"<{w}>" for w in words).encode(), dtype=np.uint8)
    owner = np.cumsum(raw == ord("<")) - 1
    codes = raw.astype(np.uint64) + np.uint64(1)
    rolling = np.zeros(len(raw), dtype=np.uint64)
    found, owners = [], []
    for n in range(1, LONGEST + 1):
        if len(raw) < n:
            break
        rolling = (rolling[: len(raw) - n + 1] * np.uint64(1_000_003)) ^ codes[n - 1 :]
        inside = owner[: len(raw) - n + 1] == owner[n - 1 :]
        mixed = (rolling + np.uint64(n)) * _MIX
        found.append((mixed[inside] >> np.uint64(40)) % np.uint64(BUCKETS))
        owners.append(owner[: len(raw) - n + 1][inside])
    return np.concatenate(found).astype(np.int64), np.concatenate(owners)


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    logits: np.ndarray  # bucket x language: embeddings times the linear layer
    bias: np.ndarray
    temperature: float
    threshold: float


class _Scorer:
    """Logit sums by word, remembered up to a bound."""

    def __init__(self, model: LanguageModel):
        self.model = model
        self.at: dict[str, int] = {}
        self.rows = np.zeros((1024, len(model.languages) + 1), dtype=np.float32)

    def _learn(self, words: list[str]) -> None:
        if len(self.at) + len(words) > _WORDS_KEPT:
            self.at.clear()
        need = len(self.at) + len(words)
        if need > len(self.rows):
            grown = np.zeros((max(need, 2 * len(self.rows)), self.rows.shape[1]), dtype=np.float32)
            grown[: len(self.rows)] = self.rows
            self.rows = grown
        buckets, owner = subword_buckets(words)
        first = len(self.at)
        for c in range(len(self.model.languages)):
            sums = np.bincount(owner, weights=self.model.logits[buckets, c], minlength=len(words))
            self.rows[first : first + len(words), c] = sums
        self.rows[first : first + len(words), -1] = np.bincount(owner, minlength=len(words))
        for i, w in enumerate(words):
            self.at[w] = first + i

    def logits(self, text: str) -> np.ndarray | None:
        words = words_of(text)
        if not words:
            return None
        total = np.zeros(self.rows.shape[1])
        for k in range(0, len(words), _WORDS_KEPT // 4):
            part = words[k : k + _WORDS_KEPT // 4]
            missing = [w for w in dict.fromkeys(part) if w not in self.at]
            if missing:
                if len(self.at) + len(missing) > _WORDS_KEPT:
                    self.at.clear()
                    missing = list(dict.fromkeys(part))
                self._learn(missing)
            places = np.fromiter(map(self.at.__getitem__, part), dtype=np.int64, count=len(part))
            total += self.rows[places].sum(axis=0, dtype=np.float64)
        return total[:-1] / total[-1] + self.model.bias


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(
    texts: list[str],
    labels: list[str],
    width: int = 16,
    window: int = 48,
    windows_per_text: int = 2,
    epochs: int = 6,
    rate: float = 0.5,
    false_rejections: float = 0.001,
    threshold_cap: float = 0.5,
    seed: int = 7,
) -> LanguageModel:
    """A model of a bounded list of texts; every fifth one is kept for calibration."""
    languages = tuple(sorted(set(labels)))
    n = len(languages)
    if not n:
        return LanguageModel((), np.zeros((BUCKETS, 0), np.float32), np.zeros(0), 1.0, 0.0)
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / width, 1 / width, (BUCKETS, width))
    seen = np.zeros(BUCKETS, dtype=bool)
    bias = np.zeros(n)
    examples, targets, held = [], [], []
    for i, (text, label) in enumerate(zip(texts, labels)):
        words = words_of(text)
        if not words:
            continue
        if i % 5 == 4:
            held.append((text, languages.index(label)))
            continue
        starts = range(0, max(1, len(words) - window // 2), window)
        for start in rng.permutation(np.array(starts))[:windows_per_text]:
            buckets, _ = subword_buckets(words[start : start + window])
            examples.append(buckets)
            targets.append(languages.index(label))
    if examples:
        seen[np.concatenate(examples)] = True
    vectors[~seen] = 0  # a subword never met says nothing
    share = np.bincount(targets, minlength=n)
    weights = len(targets) / (n * np.maximum(share, 1))
    # Steps are scaled by the squares of earlier gradients: per row of embeddings, per weight of the layer.
    row_scale, layer_scale, bias_scale = np.full(BUCKETS, 1e-12), np.full((width, n), 1e-12), np.full(n, 1e-12)
    layer = rng.normal(0, 0.5, (width, n))
    batch = 32
    for epoch in range(epochs):
        order = rng.permutation(len(examples))
        step = rate * (1 - epoch / epochs)
        for k in range(0, len(order), batch):
            chosen = order[k : k + batch]
            sizes = np.array([len(examples[i]) for i in chosen])
            ids = np.concatenate([examples[i] for i in chosen])
            owner = np.repeat(np.arange(len(chosen)), sizes)
            edges = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            mean = np.add.reduceat(vectors[ids], edges, axis=0) / sizes[:, None]
            goal = [targets[i] for i in chosen]
            p = _softmax(mean @ layer + bias)
            p[np.arange(len(chosen)), goal] -= 1
            p *= weights[goal][:, None] / len(chosen)
            back = (p @ layer.T) / sizes[:, None]
            pull = mean.T @ p
            layer_scale += pull**2
            layer -= step * pull / np.sqrt(layer_scale)
            bias_scale += p.sum(axis=0) ** 2
            bias -= 0.1 * step * p.sum(axis=0) / np.sqrt(bias_scale)
            unique, place = np.unique(ids, return_inverse=True)
            change = np.stack([np.bincount(place, weights=back[owner, c], minlength=len(unique)) for c in range(width)], axis=1)
            row_scale[unique] += (change**2).mean(axis=1)
            vectors[unique] -= step * change / np.sqrt(row_scale[unique])[:, None]
    model = LanguageModel(languages, (vectors @ layer).astype(np.float32), bias, 1.0, 0.0)
    if not held:
        return model
    scorer = _Scorer(model)
    raw = np.array([scorer.logits(t) for t, _ in held])
    truth = np.array([y for _, y in held])
    # The temperature with the best likelihood on texts that were not trained on, never a sharp one: few
    # texts, all told apart, say nothing about doubt.
    candidates = np.geomspace(0.5, 5, 40)
    loss = [-np.log(_softmax(raw / t)[np.arange(len(truth)), truth] + 1e-12).mean() for t in candidates]
    temperature = float(candidates[int(np.argmin(loss))])
    top = _softmax(raw / temperature).max(axis=1)
    threshold = min(threshold_cap, float(np.quantile(top, false_rejections)) * (1 - 1e-9))
    return LanguageModel(languages, model.logits, bias, temperature, threshold)


def fit(
    docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang",
    per_class: int = 500,
) -> LanguageModel:
    """Train on labelled rows for which ``learn`` holds."""
    labelled = docs.where(learn & F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    sample = sample_by_class(narrow(labelled, id=id_col, label=label_col), per_class, "language")
    rows = sampled_texts(narrow(labelled, id=id_col, text=text_col), sample)
    return train([t for t, _ in rows], [y for _, y in rows])


_CURRENT: list = []  # the worker's model and its scorer


def worker_scorer(model: LanguageModel) -> _Scorer:
    """The worker's scorer of ``model``; another model takes its place."""
    if not _CURRENT or _CURRENT[0] is not model:
        _CURRENT[:] = [model, _Scorer(model)]
    return _CURRENT[1]


def predict(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``lang_pred``, ``score``, ``rejected`` of every text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # buckets x languages numbers

    def worker(batch: pa.RecordBatch) -> pa.RecordBatch:
        model = shared.value
        scorer = worker_scorer(model)
        names, scores = [], []
        for text in raw_texts(batch, "text"):
            found = scorer.logits(text.decode()) if model.languages else None
            if found is None:
                names.append(UNDETERMINED)
                scores.append(0.0)
            else:
                p = _softmax(found / model.temperature)
                names.append(model.languages[int(p.argmax())])
                scores.append(float(p.max()))
        none = [n == UNDETERMINED and s == 0.0 for n, s in zip(names, scores)]
        rejected = [x or s < model.threshold for x, s in zip(none, scores)]
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected)],
            ["doc_id", "lang_pred", "score", "rejected"],
        )

    schema = "doc_id bigint, lang_pred string, score double, rejected boolean"
    return map_texts(narrow(docs, doc_id=id_col, text=text_col), worker, schema)



def known_languages(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, whose language the model does not reject."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def decide(texts: list[bytes]) -> list[bool]:
        model = shared.value
        if not model.languages:
            return [False] * len(texts)
        found = [worker_scorer(model).logits(t.decode()) for t in texts]
        return [x is not None and float(_softmax(x / model.temperature).max()) >= model.threshold for x in found]

    return keep_texts(docs, decide, text_col)
