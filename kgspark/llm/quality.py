"""Operator 4: a quality classifier by Bradley-Terry pairwise ranking.

Each labelled good document is preferred to labelled bad ones; P(i before j) = sigmoid(w.(x_i - x_j)), so w is learnt by
logistic loss on differences of features.  The learnt worth w.x ranks documents; the threshold is the quantile of the
training worths at which the fewest labels are missed, and the worth is shifted there, so that a score of 0.7 is that
quantile.

Features are shares over the whole text: punctuation and digits by bytes, words in capitals, words like the one before,
distinct words, the most frequent word, repeated lines, table bars, mean word length.  Null or empty text: all shares 0.
No labels of one kind: no preference can be learnt; every score is then the share of good labels (1 without labels).
Repeated rows: each gets its row.  An id with several texts trains with the smallest of them.  Very long texts are read
whole.  Further columns are carried along only where asked for, whatever their names; the caller names the score.
"""

from __future__ import annotations

import operator
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgspark.llm.shared import held_out, lazily, table, trimmed
from kgspark.llm.supervised import FIT_ROWS, labelled_sample, logistic, sigmoid

PARTS, TEST_PART, THRESHOLD = 4, 2, 0.7
#: Bad documents that each good one is compared with, and the other way round.
PARTNERS = 8
DIGITS, BLANKS, BARS = b"0123456789", b" \t\n\r\x0b\x0c", b"|"
PUNCTUATION = bytes(c for c in range(33, 127) if not chr(c).isalnum())
MARKS = bytes(c for c in PUNCTUATION if chr(c) not in ".,;:'-")


def features(text: str | None) -> tuple[float, ...]:
    text = text or ""
    raw, words, lines = text.encode("utf-8", "replace"), text.split(), [x for x in text.split("\n") if x]
    size, n = max(len(raw), 1), max(len(words), 1)
    share = [(len(raw) - len(raw.translate(None, which))) / size for which in (PUNCTUATION, MARKS, DIGITS, BARS)]
    counts = Counter(words)
    most = max(counts.values(), default=0) / n
    shouted = sum(map(str.isupper, words)) / n
    same = sum(map(operator.eq, words, words[1:])) / n
    repeated = 1 - len(counts) / n if words else 0.0
    lines_again = 1 - len(set(lines)) / len(lines) if lines else 0.0
    length = (len(raw) - (len(raw) - len(raw.translate(None, BLANKS)))) / n / 10
    base = [*share, shouted, same, most, repeated, lines_again]
    return (*base, *(np.sqrt(x) for x in base), *(float(x > 0.02) for x in (share[1], share[3], shouted, same)), min(length, 5.0), np.log1p(len(words)) / 10, float(not words))


@dataclass
class Model:
    mean: list[float]
    scale: list[float]
    weights: list[float]
    threshold: float
    share: float


def fit(docs: DataFrame, labels: DataFrame, parts: int = PARTS, part: int = TEST_PART, rows: int = FIT_ROWS) -> Model:
    @trimmed
    def measured(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"doc_id": frame["doc_id"], "x": [list(features(t)) for t in frame["text"]], "label": frame["label"]})

    sample = labelled_sample(docs, labels, "quality", parts, part, rows).mapInPandas(measured, "doc_id long, x array<double>, label int")
    found = sorted(sample.collect(), key=lambda r: r["doc_id"])  # at most ``rows`` short rows
    x, y = np.array([r["x"] for r in found], float), np.array([r["label"] for r in found])
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return Model([], [], [], 0.0, 1.0 if not len(found) else float(y.mean()))
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    z = (x - mean) / scale
    dice = np.random.default_rng(4)
    first = np.concatenate([np.repeat(good, PARTNERS), dice.choice(good, PARTNERS * len(bad))])
    second = np.concatenate([dice.choice(bad, PARTNERS * len(good)), np.repeat(bad, PARTNERS)])
    turn = dice.integers(0, 2, len(first)) * 2 - 1  # either one first, so that the loss sees both outcomes
    w = logistic((z[first] - z[second]) * turn[:, None], (turn > 0).astype(float), 2.0)
    worth = z @ w
    order = np.argsort(worth, kind="stable")
    # Missed labels at the quantile below which k training worths lie: good ones below it and bad ones above.
    missed = np.concatenate([[0], np.cumsum(y[order] == 1)]) + np.concatenate([[0], np.cumsum(y[order] == 0)])[-1] - np.concatenate([[0], np.cumsum(y[order] == 0)])
    at = int(np.argmin(missed))
    edges = np.concatenate([[worth.min() - 1], np.sort(worth), [worth.max() + 1]])
    return Model(mean.tolist(), scale.tolist(), w.tolist(), float((edges[at] + edges[at + 1]) / 2), float(y.mean()))


def scores(model: Model, texts: Iterable[str | None], n: int) -> list[float]:
    if not model.weights:
        return [model.share] * n
    x = np.array([features(t) for t in texts], float).reshape(-1, len(model.weights))
    worth = ((x - np.array(model.mean)) / np.array(model.scale)) @ np.array(model.weights)
    return sigmoid(worth - model.threshold + np.log(THRESHOLD / (1 - THRESHOLD))).tolist()


def with_score(docs: DataFrame, model: Model, columns: list[str], name: str = "score") -> DataFrame:
    """The given columns of the documents and a score."""

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(scores(model, lazily(batch.column("text")), batch.num_rows), pa.float64())], names=[*columns, name])

    schema = docs.select(*columns).schema.add(name, "double")
    return docs.select(*dict.fromkeys([*columns, "text"])).mapInArrow(run, schema)


def op4_quality_bradley_terry(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = with_score(docs, fit(docs, table(spark, sf_dir, "labels")), ["doc_id"])
    return found.select("doc_id", held_out(F.col("doc_id"), PARTS, TEST_PART).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
