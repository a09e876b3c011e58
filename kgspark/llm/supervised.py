"""What the two document classifiers share: the labelled sample they are fitted on, and logistic loss by Newton's method."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.llm.shared import held_out

#: Labelled rows a classifier is fitted on at most.  The sample is the rows with the smallest id hashes, so it does not
#: depend on partitions; everything else covers every document.
FIT_ROWS = 20_000


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, parts: int, part: int, rows: int = FIT_ROWS) -> DataFrame:
    """(doc_id, text, label 0/1) of at most ``rows`` labelled ids outside the held-out part; labels that are null are left out.

    An id with several texts counts once, with the smallest of them."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & ~held_out(F.col("doc_id"), parts, part))
    known = known.groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))  # one label an id; contradicting ones count as 1
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)  # at most ``rows`` rows of 12 bytes: a bounded broadcast
    # of several texts under one id, the smallest, so that the sample does not depend on the order of rows
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("label").alias("label"))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float, weight: np.ndarray | None = None, rounds: int = 30) -> np.ndarray:
    """Weights that minimise logistic loss plus ridge, by Newton steps."""
    w, c = np.zeros(x.shape[1]), np.ones(len(x)) if weight is None else weight
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (c * p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1]), x.T @ (c * (p - y)) + ridge * w)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))
