"""Toxicity scores by non-negative positive-unlabelled learning.

Positives are confirmed toxic texts; unlabelled are any texts, toxic ones among them. With the class
prior p, the risk of a linear classifier on words is

    p * E_pos[loss(+)] + max(0, E_unl[loss(-)] - p * E_pos[loss(-)])

and where the bracket turns negative, its gradient is followed backwards, which keeps the classifier
from fitting the unlabelled sample's noise. It is trained in numpy on a bounded sample: at most
``POSITIVES`` positive and ``UNLABELLED`` unlabelled texts, those with the least hashes of their ids.
Features are a text's distinct words, lower-cased and cut to their letters, and words' beginnings of
3 to 7 letters that occur several times, which catch inflected forms: the ``FEATURES`` of them that stand out most in the
positives of the sample, by ``LEAST_Z`` standard deviations at least. The prior is the share of positives among all
labelled rows of the training part.

Every whole text is scored in Arrow tasks; what each word counts for is looked up in a bounded cache. Texts
without words, null ones among them, get the score of the intercept alone; without a positive, every
score is 0. A label that is null says nothing, of several labels of an id the highest counts, and an id
gives one text to each sample (of several, the one with the least hash), however often its rows repeat.
Repeated rows are scored alike; further columns are ignored; an empty table gives no rows. Ids are whole
numbers; a null one is scored and not learned from.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from floodspark.llm.text import Scratch

POSITIVES, UNLABELLED, FEATURES = 3000, 6000, 2000
#: A feature stands in at least so many positives of the sample, so far above what unlabelled texts let expect.
LEAST_POSITIVES, LEAST_Z = 3, 4.0
BEGINNINGS, TIMES = (3, 4, 5, 6, 7), (2, 3, 5)
STEPS, RATE, SHRINK, SLACK = 400, 0.05, 1e-4, 0.0
CACHE = 200_000

_WORD = re.compile(r"[^\W\d_]+")


def features(text: str | None, stems: set[str] | None = None) -> set[str]:
    """A text's words, and beginnings of words (of stems, if given) with how often they occur: twice, three, five times or more."""
    words = Counter(_WORD.findall((text or "").lower()))
    heads: Counter[str] = Counter()
    for w, c in words.items():
        for n in BEGINNINGS:
            if len(w) >= n and (stems is None or w[:n] in stems):
                heads[w[:n]] += c
    return words.keys() | {f"{h}-{k}" for h, c in heads.items() for k in TIMES if c >= k}


class Model:
    def __init__(self, weights: dict[str, float], bias: float) -> None:
        self.weights, self.bias = weights, bias
        self.stems = {w.partition("-")[0] for w in weights if "-" in w}
        self.known: _Known | None = None  # each worker fills its own

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self.known is None:
            self.known = _Known(self.weights, self.stems)
        known = self.known
        sums = np.full(len(texts), self.bias)
        for i, text in enumerate(texts):
            heads: Counter[str] = Counter()
            seen: set[str] = set()
            for w, stems in filter(None, map(known.__getitem__, _WORD.findall((text or "").lower()))):
                seen.add(w)
                heads.update(stems)
            sums[i] += sum(self.weights.get(w, 0.0) for w in sorted(seen))
            sums[i] += sum(self.weights.get(f"{h}-{k}", 0.0) for h, c in sorted(heads.items()) for k in TIMES if c >= k)
        return 1 / (1 + np.exp(-np.clip(sums, -60, 60)))


class _Known(dict):
    """A word to itself and its beginnings that the model weighs; None where it weighs neither."""

    def __init__(self, weights: dict[str, float], stems: set[str]) -> None:
        self.weights, self.stems = weights, stems

    def __missing__(self, w: str) -> tuple[str, list[str]] | None:
        if len(self) > CACHE:
            self.clear()
        stems = [w[:n] for n in BEGINNINGS if len(w) >= n and w[:n] in self.stems]
        self[w] = out = (w, stems) if stems or w in self.weights else None
        return out


def train(words: list[str], xp: np.ndarray, xu: np.ndarray, prior: float) -> Model:
    """The words' weights that minimise the non-negative risk, by Adam; xp, xu: positive and unlabelled texts by words."""
    np_, nu = len(xp), max(len(xu), 1)
    if not np_:
        return Model({}, -60.0)
    theta, bias = np.zeros(len(words), np.float32), float(np.log(prior / (1 - prior)))
    m = v = np.zeros(len(words) + 1)
    sigmoid = lambda s: 1 / (1 + np.exp(-s))
    for k in range(1, STEPS + 1):
        sp, su = sigmoid(xp @ theta + bias), sigmoid(xu @ theta + bias)
        # Logistic loss: log(1 + exp(-s)) for +, log(1 + exp(s)) for -.
        risk = np.mean(-np.log1p(-np.clip(su, 0, 1 - 1e-7))) if len(su) else 0.0
        corrected = risk - prior * np.mean(-np.log1p(-np.clip(sp, 0, 1 - 1e-7)))
        gp = prior * (sp - 1) / np_
        gn_p, gn_u = -prior * sp / np_, su / nu
        if corrected >= -SLACK:
            gp, gu = gp + gn_p, gn_u
        else:
            gp, gu = -gn_p, -gn_u
        grad = np.append(xp.T @ gp + xu.T @ gu + SHRINK * theta, gp.sum() + gu.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        step = RATE * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
        theta, bias = (theta - step[:-1]).astype(np.float32), bias - float(step[-1])
    return Model({w: float(t) for w, t in zip(words, theta) if abs(t) > 1e-6}, bias)


def _with_features(texts: DataFrame, words: list[str] | None = None) -> DataFrame:
    """(positive, text) to (positive, features), or with words to (positive, places): which of them each text has."""
    place = {w: i for i, w in enumerate(words or [])}
    stems = {w.partition("-")[0] for w in place if "-" in w}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                if words is None:
                    out = pa.array([sorted(features(t.as_py())) for t in part.column(1)], pa.list_(pa.string()))
                else:
                    found = [sorted(place[w] for w in features(t.as_py(), stems) if w in place) for t in part.column(1)]
                    out = pa.array(found, pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), out], names=["positive", "features"])

    kind = "string" if words is None else "int"
    return texts.select("positive", "text").mapInArrow(run, f"positive boolean, features array<{kind}>")


def fit(docs: DataFrame, labels: DataFrame, train_rows) -> Model:
    """docs (doc_id, text), labels (doc_id, toxic); train_rows: a condition on doc_id."""
    scratch = Scratch(docs.sparkSession)
    known = labels.filter(train_rows & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n, n_toxic = known.agg(F.count("*"), F.count_if(F.col("toxic") == 1)).first()
    if not n_toxic:
        return train([], np.zeros((0, 0)), np.zeros((0, 0)), 0.5)
    order = [F.xxhash64("doc_id"), "doc_id"]
    chosen = known.filter("toxic = 1").orderBy(*order).limit(POSITIVES).select("doc_id", F.lit(True).alias("positive"))
    others = docs.filter(train_rows & F.col("doc_id").isNotNull()).select("doc_id").distinct().orderBy(*order).limit(UNLABELLED).select("doc_id", F.lit(False).alias("positive"))
    # Both lists have a bound of their own, so they are broadcast.
    both = F.broadcast(chosen.unionByName(others))
    one = F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")
    sample = scratch.written(docs.select("doc_id", "text").join(both, "doc_id").groupBy("doc_id", "positive").agg(one).select("positive", "text"), "sample")
    counts = (
        _with_features(sample)
        .select("positive", F.explode("features").alias("word"))
        .groupBy("word")
        .agg(F.count_if("positive").alias("p"), F.count_if(~F.col("positive")).alias("u"))
    )
    sizes = sample.agg(F.count_if("positive").alias("np"), F.count_if(~F.col("positive")).alias("nu")).first()
    q = (F.col("u") + 0.5) / (sizes.nu + 1)
    z = (F.col("p") - sizes.np * q) / F.sqrt(sizes.np * q * (1 - q))
    stand_out = counts.filter(F.col("p") >= min(LEAST_POSITIVES, sizes.np)).select("word", z.alias("z")).filter(F.col("z") >= LEAST_Z)
    words = [r.word for r in stand_out.orderBy(F.round("z", 9).desc(), "word").limit(FEATURES).collect()]
    rows = _with_features(sample, words).collect()
    scratch.keep_only()

    def matrix(texts: list[list[int]]) -> np.ndarray:
        x = np.zeros((len(texts), len(words)), np.float32)
        for row, at in zip(x, texts):
            row[at] = 1
        return x

    xp, xu = (matrix(sorted(list(r.features) for r in rows if r.positive == kind)) for kind in (True, False))
    return train(words, xp, xu, min(max(n_toxic / n, 0.01), 0.9))


SCHEMA = "doc_id long, held_out boolean, score double, predicted int"


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs (doc_id, text, held_out) to SCHEMA; a row is predicted 1 from a score of 0.5."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            s = np.concatenate([np.zeros(0), *(model.scores(batch.column(1).slice(i, 512).to_pylist()) for i in range(0, batch.num_rows, 512))])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(s), pa.array((s >= 0.5).astype(np.int32))],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text", "held_out").mapInArrow(run, SCHEMA)
