"""Toxicity: a logistic classifier with a counterfactual penalty.

A text's features are its words and their first letters (each once). In every labelled text that names a
group, the name is swapped for each other name of its kind; the learner is penalised for the squared change of
its logit, so weight can't settle on the names themselves and neutral mentions stay unflagged.

Learning takes a bounded sample: the SAMPLE labelled rows of the learning folds with the smallest hashes of doc_id (all, if fewer).
The driver gets feature numbers of the VOCABULARY best features for those rows, never texts. Scoring takes every whole text.

Defined results: null and empty texts have no features and score the bias's logistic; labels of null or without a document teach nothing; with one class
or none labelled the score is the smoothed share of label 1; repeated documents get a row each, and repeated labels of an id count each; texts of any length count whole; an empty table gives no rows. Other columns are
never read, whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinth.llm.common import column, crc_mod, small

FOLDS, HELD_OUT, THRESHOLD = 4, 2, 0.3
#: Bounds of what is learnt from: labelled rows, features, characters of a prefix, rows in which a feature must occur, and its least G statistic.
SAMPLE, VOCABULARY, PREFIX, LEAST_ROWS, LEAST_G = 20_000, 3_000, 5, 5, 12.0
#: Weights of the counterfactual penalty and of the squared weights; steps of learning.
PENALTY, L2, STEPS = 1.0, 1e-4, 200
#: Kinds of group names whose members can stand for each other (fixed values; a parameter of the operator).
IDENTITY_TERMS = [
    ["women", "men", "girls", "boys"],
    ["woman", "man", "girl", "boy"],
    ["christians", "muslims", "jews", "hindus", "buddhists", "atheists"],
    ["christian", "muslim", "jewish", "hindu", "buddhist", "atheist"],
    ["black", "white", "asian", "latino", "arab", "african", "european"],
    ["gay", "straight", "lesbian", "bisexual", "transgender"],
    ["immigrants", "refugees", "foreigners", "natives", "locals"],
    ["frauen", "männer"],
    ["femmes", "hommes"],
    ["mujeres", "hombres"],
]
_EDGE = ".,;:!?\"'()[]{}*#$%&|<>-_/\\"


def words(text: str | None) -> set[str]:
    """The distinct words, lower-cased, without marks at their edges."""
    return {w.strip(_EDGE) for w in set((text or "").lower().split())} - {""}


def features(found: set[str]) -> set[str]:
    return found | {w[:PREFIX] + "~" for w in found if len(w) > PREFIX}


@dataclass
class Model:
    index: dict[str, int]
    weights: np.ndarray
    bias: float

    def score(self, text: str | None) -> float:
        found, index = words(text), self.index
        at = {index[w] for w in found if w in index} | {index[p] for w in found if len(w) > PREFIX and (p := w[:PREFIX] + "~") in index}
        z = self.bias + float(self.weights[list(at)].sum()) if at else self.bias
        return 1 / (1 + math.exp(-min(30.0, max(-30.0, z))))


def sampled(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """text and y of the learning rows: at most `most` labels, which are broadcast."""
    known = labels.select(F.col("doc_id").cast("long").alias("label_id"), F.col("toxic").cast("int").alias("y")).filter(F.col("y").isin(0, 1) & F.col("label_id").isNotNull() & (crc_mod(F.col("label_id"), FOLDS) != HELD_OUT))
    known = known.orderBy(F.xxhash64("label_id"), "label_id", "y").limit(most)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(known), F.col("doc_id") == F.col("label_id")).select("text", "y")


def choose_features(sample: DataFrame, terms: list[list[str]], most: int = VOCABULARY) -> tuple[list[str], dict[int, int]]:
    """The features with the largest G statistic against the label, and the rows of each label."""

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(c: Counter) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([k[0] for k in c], pa.string()), pa.array([k[1] for k in c], pa.int32()), pa.array(list(c.values()), pa.int64())], ["feature", "y", "n"])

        c: Counter = Counter()
        for b in small(batches):
            for t, y in zip(column(b, "text"), column(b, "y"), strict=True):
                c.update((f, y) for f in features(words(t)))
                c[("", y)] += 1  # the rows of this label
                if len(c) > 200_000:
                    yield out(c)
                    c.clear()
        yield out(c)

    found = sample.mapInArrow(counts, "feature string, y int, n long").groupBy("feature").agg(F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("b"))
    found = found.persist()
    try:
        totals = found.filter("feature = ''").first()
        if totals is None or not totals.a or not totals.b:
            return [], {1: totals.a if totals else 0, 0: totals.b if totals else 0}
        pos, neg = float(totals.a), float(totals.b)

        def part(x, expected):
            return F.when(x > 0, x * F.ln(x / expected)).otherwise(0.0)

        n = F.col("a") + F.col("b")
        g = part(F.col("a"), n * pos / (pos + neg)) + part(F.col("b"), n * neg / (pos + neg)) + part(pos - F.col("a"), (pos + neg - n) * pos / (pos + neg)) + part(neg - F.col("b"), (pos + neg - n) * neg / (pos + neg))
        rows = found.filter((n >= LEAST_ROWS) & (F.col("feature") != "")).select("feature", g.alias("g")).filter(F.col("g") >= LEAST_G).orderBy(F.col("g").desc(), "feature").limit(most).collect()
    finally:
        found.unpersist()
    names = [r.feature for r in rows]
    # Names of groups are always features, else swapping them could not show.
    names += sorted({t for kind in terms for t in kind} - set(names))
    return names, {1: totals.a, 0: totals.b}


def fit(docs: DataFrame, labels: DataFrame, terms: list[list[str]] | None = None, penalty: float = PENALTY, most: int = SAMPLE) -> Model:
    terms = IDENTITY_TERMS if terms is None else terms
    sample = sampled(docs, labels, most)
    names, counts = choose_features(sample, terms)
    if not names:
        return Model({}, np.zeros(0), math.log((counts[1] + 1) / (counts[0] + 1)))
    index = {f: i for i, f in enumerate(names)}
    kinds = {t: [x for x in kind if x != t] for kind in terms for t in kind}

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            at, swapped = [], []
            for t in column(b, "text"):
                found = words(t)
                own = {index[f] for f in features(found) if f in index}
                at.append(sorted(own))
                # The swapped text's features: the name and its prefix go, unless another word keeps it, and the other's come.
                twins = []
                for name in sorted(found & kinds.keys()):
                    for other in kinds[name]:
                        twin = {index[f] for f in features((found - {name}) | {other}) if f in index}
                        twins.append(sorted(twin - own) + [-1 - i for i in sorted(own - twin)])
                swapped.append([x for x in twins if x])
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(at, pa.list_(pa.int32())), pa.array(swapped, pa.list_(pa.list_(pa.int32())))], ["y", "at", "swapped"])

    rows = sample.mapInArrow(encode, "y int, at array<int>, swapped array<array<int>>").collect()  # at most `most` rows of numbers
    return learn(names, [(r.y, r["at"], r.swapped) for r in rows], penalty)


def learn(names: list[str], rows: list[tuple[int, list[int], list[list[int]]]], penalty: float = PENALTY) -> Model:
    """Minimises the mean log loss, the counterfactual penalty and the squared weights (bias aside): a convex function of a few thousand numbers."""
    y = np.array([r[0] for r in rows], float)
    row = np.repeat(np.arange(len(rows)), [len(r[1]) for r in rows])
    col = np.array([i for r in rows for i in r[1]], np.int64)
    pairs = [p for r in rows for p in r[2]]
    p_row = np.repeat(np.arange(len(pairs)), [len(p) for p in pairs])
    p_all = np.array([i for p in pairs for i in p], np.int64)
    p_col, p_sign = np.where(p_all < 0, -1 - p_all, p_all), np.where(p_all < 0, -1.0, 1.0)
    n, m, d = len(rows), len(pairs), len(names)
    weight = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, n - y.sum()))
    # Half way between equal classes and the given shares: rare toxic rows count, and the bias stays honest.
    weight = 0.5 * weight + 0.5 / n

    def loss(x: np.ndarray) -> tuple[float, np.ndarray]:
        w = x[:d]
        z = np.bincount(row, w[col], minlength=n) + x[d]
        e = (0.5 * (1 + np.tanh(z / 2)) - y) * weight
        g = np.append(np.bincount(col, e[row], minlength=d) + L2 * w, e.sum())
        total = float((weight * (np.logaddexp(0, z) - y * z)).sum() + L2 / 2 * w @ w)
        if m:
            change = np.bincount(p_row, p_sign * w[p_col], minlength=m)
            total += penalty / m * float(change @ change)
            g[:d] += 2 * penalty / m * np.bincount(p_col, p_sign * change[p_row], minlength=d)
        return total, g

    x = descend(loss, np.zeros(d + 1))
    return Model({f: i for i, f in enumerate(names)}, x[:d], float(x[d]))


def descend(loss, x: np.ndarray, steps: int = STEPS, memory: int = 10) -> np.ndarray:
    """Limited-memory BFGS with a halving line search."""
    f, g = loss(x)
    past: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(steps):
        step, alphas = -g, []
        for s, t, r in reversed(past):
            alphas.append(a := r * (s @ step))
            step = step - a * t
        if past:
            s, t, _ = past[-1]
            step = step * ((s @ t) / (t @ t))
        for (s, t, r), a in zip(past, reversed(alphas), strict=True):
            step = step + (a - r * (t @ step)) * s
        rate, slope = 1.0, float(g @ step)
        while (new := loss(x + rate * step))[0] > f + 1e-4 * rate * slope and rate > 1e-8:
            rate /= 2
        s, t = rate * step, new[1] - g
        done = f - new[0] < 1e-9
        x, f, g = x + s, *new
        if done or rate <= 1e-8:
            break
        if (st := float(s @ t)) > 1e-12:
            past = [*past, (s, t, 1 / st)][-memory:]
    return x


def toxicity_scores(docs: DataFrame, labels: DataFrame, terms: list[list[str]] | None = None) -> DataFrame:
    """doc_id, held_out, score (higher: label 1 likelier) and predicted for each row of docs."""
    model = fit(docs, labels, terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([model.score(t) for t in column(b, "text")], pa.float64())], ["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", (crc_mod(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
