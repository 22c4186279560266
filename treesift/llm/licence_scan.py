"""Licence scan: sparse logistic regression over word n-grams of paragraphs, confirmed by templates.

The scan is made of DataFrame functions alone. A paragraph is a line of a text, or a run of neighbouring
lines up to a blank one that a wrapped notice starting in the first of them can take; comment marks count
as white space. A run stands for itself where a template crosses its lines. Features are the runs
of one to three words of the templates that hold an *anchor*, a template word that is no function word;
what the corpus holds does not change them. A multinomial logistic regression with an elastic net is trained on templates, on parts of
them, on parts amid corpus words, on their names alone, and on a bounded sample of corpus paragraphs
(``sample_docs`` of at most ``sample_bytes``) for the class *unknown*.

A paragraph without an anchor has no feature and is unknown, so only lines with an anchor, and runs with
two, go on; their n-grams meet the table of weights, and sums by paragraph give the classes' odds. The
table is bounded by the templates and broadcast. The unknown class is calibrated on paragraphs kept out
of training: a temperature, and the least probability at which a family is believed, above what all but
``false_share`` of corpus paragraphs reach. A prediction is confirmed if the best template of its family
has at least ``border`` of its word trigrams in the paragraph.

Result: one row per line at which paragraphs that are not unknown start, and family. Null and empty texts have none. Rows that repeat both
id and paragraph at the same place count once; a null id is kept as null. Ties between classes go to the
name that sorts first. An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treesift.llm.common import narrow
from treesift.llm.licence_templates import NO_LICENCE, TEMPLATES

UNKNOWN = "unknown"
# Fixed values. Words that say nothing of licences: every other template word is an anchor, whatever the corpus holds.
FUNCTION_WORDS = frozenset(
    "a all an and are as at be by can for from has have in is it its may not of on or that the this to with you your".split()
)
# A line with several of these resembles a notice; it teaches nothing about the unknown.
NAMES = frozenset(
    "affero apache attribution bsd cc commons creative gnu lesser mit mozilla nc noncommercial sa sharealike unencumbered".split()
)
_WORD = re.compile(r"[a-z0-9]+")
# Comment marks made of letters; all others are no words anyway.
_MARKS = r"(?i)^\s*(?:rem|dnl|@rem)\s+"


def _words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _grams(words: list[str], most: int = 3) -> list[str]:
    return [" ".join(words[k : k + n]) for n in range(1, most + 1) for k in range(len(words) - n + 1)]


LONGEST = max(len(_words(text)) for _, _, text in TEMPLATES)


def words_of(paragraph: Column) -> Column:
    return F.filter(F.split(F.lower(paragraph), "[^a-z0-9]+"), lambda w: w != "")


def line_words(line: Column) -> Column:
    """Words of a line without the comment marks that are words."""
    return words_of(F.regexp_replace(line, _MARKS, ""))


def notice_run(lines: Column, at: Column) -> Column:
    """Words of the lines that a notice starting in line ``at`` can take, line by line, up to a blank one.

    A notice has at most ``LONGEST`` words: so many at the end of its first line and at the start of its
    last, and no more between them.
    """
    first = F.get(lines, at)
    start = F.struct(
        F.array(F.slice(first, F.greatest(F.lit(1), F.size(first) - (LONGEST - 1)), LONGEST)).alias("parts"),
        F.lit(0).alias("between"),
        (F.size(first) > 0).alias("open"),
    )

    def add(run: Column, line: Column) -> Column:
        longer = F.struct(
            F.concat(run["parts"], F.array(F.slice(line, 1, LONGEST))).alias("parts"),
            (run["between"] + F.size(line)).alias("between"),
            (run["between"] + F.size(line) < LONGEST - 1).alias("open"),
        )
        closed = F.struct(run["parts"].alias("parts"), run["between"].alias("between"), F.lit(False).alias("open"))
        return F.when(run["open"] & (F.size(line) > 0), longer).otherwise(closed)

    return F.aggregate(F.slice(lines, at + 2, LONGEST), start, add, lambda run: run["parts"])


def grams_of(words: Column, n: int) -> Column:
    """Runs of ``n`` words; none if there are fewer."""
    starts = F.sequence(F.lit(1), F.size(words) - (n - 1))
    runs = F.transform(starts, lambda k: F.array_join(F.slice(words, k, n), " "))
    return F.when(F.size(words) >= n, runs).otherwise(F.array().cast("array<string>"))


@dataclass(frozen=True)
class LicenceModel:
    families: tuple[str, ...]  # with the unknown class
    bias: tuple[float, ...]
    weights: dict[str, tuple[float, ...]]  # by n-gram, in the order of the families
    temperature: float
    least: float
    anchors: tuple[str, ...]  # every n-gram with a weight holds one


def _sample(docs: DataFrame, sample_docs: int, sample_bytes: int) -> list[str]:
    """One paragraph of about ``sample_docs`` documents at most, drawn by hashes of their ids; of rows that
    repeat an id, one."""
    share = min(1.0, sample_docs / max(1, docs.select("doc_id").distinct().count()))
    lines = F.split("text", "\n")
    draw = F.pmod(F.xxhash64(F.lit("licence"), "doc_id"), F.lit(1_000_003)) < share * 1_000_003
    one = F.element_at(lines, (F.pmod(F.xxhash64(F.lit("line"), "doc_id"), F.size(lines)) + 1).cast("int"))
    rows = docs.where(draw & F.col("text").isNotNull()).select("doc_id", one.alias("line"))
    rows = rows.where((F.octet_length("line") <= sample_bytes) & (F.trim("line") != ""))
    return sorted(r["line"] for r in rows.groupBy("doc_id").agg(F.min("line").alias("line")).collect())


def fit(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    false_share: float = 0.001,
    seed: int = 11,
    sample_docs: int = 3000,
    sample_bytes: int = 4000,
) -> LicenceModel:
    """A model from the templates and a bounded sample of corpus paragraphs of at most ``sample_bytes``."""
    spark = docs.sparkSession
    rng = np.random.default_rng(seed)
    lines = [_words(t) for t in _sample(narrow(docs, doc_id=id_col, text=text_col), sample_docs, sample_bytes)]
    templates = [(family, _words(text)) for family, _, text in TEMPLATES]
    known = [set(_grams(w, 2)) - set(w) for _, w in templates]
    # The corpus holds notices too: what resembles a template teaches nothing about the unknown.
    lines = [w for w in lines if w and len(NAMES & set(w)) < 2]
    lines = [w for w in lines if all(len(k & set(_grams(w, 2))) < 0.5 * len(k) for k in known)]
    anchors = {w for _, t in templates for w in t} - FUNCTION_WORDS
    vocabulary = sorted({g for _, t in templates for g in _grams(t) if anchors & set(g.split())})
    families = sorted({family for family, _ in templates} | {UNKNOWN})
    # Words around notices: whatever the corpus holds, function words are as many.
    filler = [w for line in lines[:400] for w in line[:12] if w not in anchors]
    filler += sorted(FUNCTION_WORDS) * max(1, len(filler) // len(FUNCTION_WORDS))
    rows: list[tuple[str, list[str]]] = []
    for family, words in templates:
        rows += [(family, words)] * 4
        for _ in range(12):
            size = int(rng.integers(max(4, math.ceil(0.7 * len(words))), len(words) + 1))
            start = int(rng.integers(0, len(words) - size + 1))
            around = [str(w) for w in rng.choice(filler, int(rng.integers(0, 12)))]
            cut = int(rng.integers(0, len(around) + 1))
            rows.append((family, around[:cut] + words[start : start + size] + around[cut:]))
        for _ in range(4):  # as in a run, whose first and last line hold other words
            around = [[str(w) for w in rng.choice(filler, int(rng.integers(0, 50)))] for _ in range(2)]
            rows.append((family, around[0] + words + around[1]))
        named = [k for k, w in enumerate(words) if w in NAMES]
        if len({words[k] for k in named}) > 1:  # the licence's name alone, as in a footer
            for _ in range(12):
                around = [[str(w) for w in rng.choice(filler, int(rng.integers(0, 9)))] for _ in range(2)]
                rows.append((family, around[0] + words[named[0] : named[-1] + 1] + around[1]))
        for _ in range(2):  # a few words of a template without its name are no notice
            size = max(1, len(words) // 5)
            start = int(rng.integers(0, len(words) - size + 1))
            if len(NAMES & set(words[start : start + size])) < 2:
                rows.append((UNKNOWN, [str(w) for w in rng.choice(filler, 8)] + words[start : start + size]))
    rows += [(UNKNOWN, _words(t)) for t in NO_LICENCE for _ in range(3)]
    rows += [(UNKNOWN, w) for w in lines]
    rows = [rows[i] for i in rng.permutation(len(rows))]
    train, held = [r for i, r in enumerate(rows) if i % 5], [r for i, r in enumerate(rows) if not i % 5]
    frame = spark.createDataFrame([(float(families.index(f)), _grams(w)) for f, w in train], "label double, grams array<string>")
    vectors = CountVectorizerModel.from_vocabulary(vocabulary, "grams", "features").setBinary(True)
    learner = LogisticRegression(family="multinomial", regParam=1e-3, elasticNetParam=0.3, maxIter=60)
    features = vectors.transform(frame.coalesce(2)).cache()
    fitted = learner.fit(features)
    features.unpersist()
    matrix = fitted.coefficientMatrix.toArray()
    bias = fitted.interceptVector.toArray()
    if matrix.shape[0] < len(families):  # no rows of the last classes
        matrix = np.vstack([matrix, np.zeros((len(families) - matrix.shape[0], matrix.shape[1]))])
        bias = np.append(bias, [-30.0] * (len(families) - len(bias)))
    weights = {g: tuple(map(float, matrix[:, j])) for j, g in enumerate(vocabulary) if np.abs(matrix[:, j]).max() > 1e-6}
    odds = np.array([bias + sum((np.array(weights[g]) for g in set(_grams(w)) if g in weights), np.zeros(len(bias))) for _, w in held])
    truth = np.array([families.index(f) for f, _ in held])

    def probabilities(t: float) -> np.ndarray:
        e = np.exp((odds - odds.max(axis=1, keepdims=True)) / t)
        return e / e.sum(axis=1, keepdims=True)

    scale = np.geomspace(0.2, 5, 40)
    loss = [-np.log(probabilities(t)[np.arange(len(truth)), truth] + 1e-12).mean() for t in scale]
    temperature = float(scale[int(np.argmin(loss))])
    unknown = families.index(UNKNOWN)
    most = np.delete(probabilities(temperature), unknown, axis=1).max(axis=1)[truth == unknown]
    least = max(0.5, float(np.quantile(most, 1 - false_share))) if len(most) else 0.5
    used = tuple(sorted(anchors & {w for g in weights for w in g.split()}))
    return LicenceModel(tuple(families), tuple(map(float, bias)), weights, temperature, min(least, 0.9), used)


def scan(
    docs: DataFrame, model: LicenceModel, id_col: str = "doc_id", text_col: str = "text", border: float = 0.8
) -> DataFrame:
    """``doc_id``, ``paragraph`` (its first line), ``family``, ``probability``, ``template``, ``similarity`` and
    ``confirmed`` of every paragraph that is not unknown."""
    spark = docs.sparkSession
    docs = narrow(docs, doc_id=id_col, text=text_col)
    weights = spark.createDataFrame(
        [(g, list(w)) for g, w in model.weights.items()] or [("", [0.0] * len(model.families))], "gram string, weight array<double>"
    )
    templates = spark.createDataFrame([(f, n, _words(t)) for f, n, t in TEMPLATES], "family string, template string, tw array<string>")
    lines = F.transform(F.split("text", "\n"), line_words)
    docs = docs.select("doc_id", F.xxhash64("text").alias("body"), lines.alias("lines"))
    # A single line, and the run of lines that a notice starting in it can take.
    place = ["doc_id", "body", "paragraph"]
    forms = F.transform("lines", lambda line, at: F.array(F.array(line), notice_run(F.col("lines"), at)))
    met = docs.select("doc_id", "body", F.posexplode(forms).alias("paragraph", "forms"))
    met = met.select(*place, F.posexplode("forms").alias("run", "parts")).where(F.size("parts") > F.col("run"))
    met = met.withColumn("words", F.flatten("parts"))
    shared = F.size(F.array_intersect("words", F.array(*map(F.lit, model.anchors or ("",)))))
    met = met.where(shared > F.col("run")).distinct()
    key = [*place, "run", "parts", "words"]
    grams = F.array_distinct(F.concat(*[grams_of(F.col("words"), n) for n in (1, 2, 3)]))
    hits = met.select(*key, F.explode(grams).alias("gram")).join(F.broadcast(weights), "gram")
    sums = hits.groupBy(*key).agg(*[F.sum(F.col("weight")[i]).alias(f"s{i}") for i in range(len(model.families))])
    odds = [(F.col(f"s{i}") + b) / model.temperature for i, b in enumerate(model.bias)]
    top = F.greatest(*odds)
    total = sum((F.exp(o - F.col("top")) for o in odds[1:]), F.exp(odds[0] - F.col("top")))
    unknown = model.families.index(UNKNOWN)
    best, family = F.lit(-1.0), F.lit(UNKNOWN)
    for i, name in enumerate(model.families):
        if i != unknown:
            p = F.exp(odds[i] - F.col("top"))
            family = F.when(p > best, name).otherwise(family)
            best = F.greatest(best, p)
    named = sums.withColumn("top", top).select(*key, family.alias("family"), (best / total).alias("probability"))
    named = named.where(F.col("probability") >= model.least)
    goal = grams_of(F.col("tw"), 3)

    def similarity(words: Column) -> Column:
        return F.size(F.array_intersect(grams_of(words, 3), goal)) / F.size(F.array_distinct(goal))

    compared = named.join(F.broadcast(templates), "family").withColumn("similarity", similarity(F.col("words")))
    # A run counts where a template crosses its lines, at the last line from which the whole of it follows.
    neighbours = Window.partitionBy("doc_id", "body", "run", "family", "template").orderBy("paragraph")
    beside = {}
    for way, step in ((F.lead, 1), (F.lag, -1)):
        near = way(F.struct("paragraph", "similarity")).over(neighbours)
        beside[step] = F.when(near["paragraph"] == F.col("paragraph") + step, near["similarity"])
    best = F.array_max(F.transform("parts", similarity))
    compared = compared.withColumn("after", beside[1]).withColumn("before", beside[-1])
    crossing = (F.col("similarity") > best) & (F.col("similarity") > F.coalesce("after", F.lit(0.0)))
    crossing = crossing & (F.col("similarity") >= F.coalesce("before", F.lit(0.0)))
    compared = compared.where((F.col("run") == 0) | crossing)
    found = compared.groupBy(*place, "family").agg(
        F.max_by(F.struct("template", "similarity", "probability"), F.struct("similarity", "template", -F.col("run"))).alias("best")
    )
    return found.select(
        "doc_id", "paragraph", "family", "best.probability", "best.template", "best.similarity",
        (F.col("best.similarity") >= border).alias("confirmed"),
    )
