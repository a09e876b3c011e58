"""Operator 3: approximate nearest neighbours by low-dimensional stable projections and a kd-tree.

Vectors are projected to M dimensions by Gaussian (2-stable) directions: for a vector at distance d, the squared
projected distance is d^2 times a chi-square variable of M degrees.  A shard indexes its projections with a kd-tree.  A
query first descends to the leaf whose box is nearest, unless it knows a k-th distance, then through all nodes that the
stopping test leaves open, level by level.  It reads their leaves nearest first, in groups that grow, so that a search
takes few steps on arrays, and verifies a group's open vectors by true distance, the nearest in projection before the others.
The test closes nodes, leaves and vectors whose projected distance is so large that a vector as near as the k-th found
would have a smaller one with probability at least STOP: chi-square test of (projected distance / k-th distance)^2.  Every
row is indexed; nothing is fitted.

Vectors that are null, zero or have null or non-finite components take no part; see ``vectors`` for repeated ids, lengths
and further columns.  Fewer candidates than k: all of them.  Equal distances: smaller id first; among vectors as near as
the k-th, verification goes on until no projected distance is 0, so many equal vectors are ordered by id exactly.  An
empty table has no result.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from kgspark.llm.shared import table
from kgspark.llm.vectors import best_of, searched

K, EVERY = 10, 100
#: Even, so that the chi-square distribution has a closed form.
M, STOP, LEAF, AT_ONCE = 12, 0.95, 64, 64
#: Leaves are read in groups that grow by this factor.
GROW = 4


@functools.cache
def directions(dim: int, m: int = M) -> np.ndarray:
    return np.random.default_rng([dim, m]).standard_normal((dim, m))


def chi_square(x: float, m: int = M) -> float:
    """Its distribution function for an even number of degrees."""
    half = x / 2
    return 1.0 if half > 700 else 1 - math.exp(-half) * sum(half**i / math.factorial(i) for i in range(m // 2))


def _reach(stop: float = STOP) -> float:
    """The smallest value at which the distribution function is ``stop``."""
    low, high = 0.0, 1400.0
    while low < (middle := (low + high) / 2) < high:
        low, high = (low, middle) if chi_square(middle) >= stop else (middle, high)
    return high


REACH = _reach()


def kd_tree(points: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """The order of the points by leaf, and the nodes: spans of that order, boxes, and the first of two children (0 at a leaf).

    A node is split at the median of its widest dimension; the root is node 0, and a node's children stand side by side.
    """
    order, spans, child = np.arange(len(points)), [(0, len(points))], []
    for low, high in spans:  # grows as nodes are split
        child.append(0)
        if high - low > leaf:
            part = order[low:high]
            x = points[part]
            half = (high - low) // 2
            order[low:high] = part[np.argpartition(x[:, int(np.argmax(np.ptp(x, axis=0)))], half)]
            child[-1] = len(spans)
            spans += [(low, low + half), (low + half, high)]
    boxes = np.stack([np.stack([points[order[a:b]].min(0), points[order[a:b]].max(0)]) for a, b in spans])
    return order, {"spans": np.array(spans, np.int64), "boxes": boxes, "child": np.array(child, np.int64)}


def _index(_context):
    def index(vectors: np.ndarray):
        flat = vectors @ directions(vectors.shape[1])
        order, tree = kd_tree(flat)
        return order, tree | {"flat": flat[order]}

    return index


class Shard:
    """A shard's tree, its projections and vectors."""

    def __init__(self, held: dict):
        self.spans, self.child = np.frombuffer(held["spans"], np.int64).reshape(-1, 2).tolist(), np.frombuffer(held["child"], np.int64).tolist()
        self.boxes, self.flat = np.frombuffer(held["boxes"], np.float64).reshape(len(self.child), 2, M), np.frombuffer(held["flat"], np.float64).reshape(-1, M)
        self.vectors, self.ids, self.row = held["vector"], held["vec_id"], held["row"]
        self.leaves = self.verified = 0  # what the queries have read so far
        self.children = np.array(self.child, np.int64)

    def gaps(self, nodes: np.ndarray, flat: np.ndarray) -> np.ndarray:
        """Squared distances of boxes."""
        box = self.boxes[nodes]
        gap = np.maximum(np.maximum(box[:, 0] - flat, flat - box[:, 1]), 0)
        return (gap * gap).sum(1)

    def reached(self, flat: np.ndarray, open_: Callable[[np.ndarray], np.ndarray], but: int | None) -> tuple[np.ndarray, np.ndarray]:
        """The leaves that a descent with all open nodes of a level at once reaches, nearest first, and their distances; ``but``: one read before."""
        nodes, leaves, gaps = np.zeros(1, np.int64), [], []
        while len(nodes):
            gap = self.gaps(nodes, flat)
            left = open_(gap)
            nodes, gap = nodes[left], gap[left]
            child = self.children[nodes]
            end = (child == 0) & (nodes != but) if but is not None else child == 0
            leaves.append(nodes[end])
            gaps.append(gap[end])
            child = child[child > 0]
            nodes = np.concatenate([child, child + 1])
        every, away = np.concatenate(leaves), np.concatenate(gaps)
        turn = np.argsort(away, kind="stable")
        return every[turn], away[turn]


def neighbours(shard: Shard, q: np.ndarray, row: int, bound: float, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and distances of the nearest that the stopping test lets through; ``bound``: a k-th distance known before, or NaN."""
    flat = q @ directions(len(q))
    known = math.inf if math.isnan(bound) else bound
    found, distance = np.empty(0, np.int64), np.empty(0)

    def kth() -> float:
        return min(distance[-1] if len(distance) == k else math.inf, known)

    def open_(squared: np.ndarray) -> np.ndarray:
        return _open(squared, kth())

    def verify(rows: np.ndarray) -> None:
        nonlocal found, distance
        shard.verified += len(rows)
        all_rows, all_d = np.concatenate([found, rows]), np.concatenate([distance, _lengths(shard.vectors[rows] - q)])
        best = best_of(all_d, shard.ids[all_rows], k)
        found, distance = all_rows[best], all_d[best]

    def read(leaves: np.ndarray) -> None:
        shard.leaves += len(leaves)
        rows = np.concatenate([np.arange(*shard.spans[x]) for x in leaves.tolist()])
        step = shard.flat[rows] - flat
        away = (step * step).sum(1)
        left = np.flatnonzero((shard.row[rows] != row) & open_(away))
        left = left[np.argsort(away[left], kind="stable")]
        while len(left):
            now = AT_ONCE if len(distance) < k or len(left) > 2 * AT_ONCE else len(left)  # the nearest bound the others
            verify(rows[left[:now]])
            left = left[now:][open_(away[left[now:]])]
            if len(left) and not math.isinf(kth()):
                verify(rows[left])
                break

    first = None
    if math.isinf(known):
        first = 0
        while shard.child[first]:
            first = shard.child[first] + int(np.argmin(shard.gaps(np.array([shard.child[first], shard.child[first] + 1]), flat)))
        read(np.array([first]))
    leaves, gap = shard.reached(flat, open_, first)
    many = GROW
    while len(leaves):
        read(leaves[:many])
        left = open_(gap[many:])
        leaves, gap = leaves[many:][left], gap[many:][left]
        many *= GROW
    return found, distance


def _lengths(d: np.ndarray) -> np.ndarray:
    """Euclidean lengths; scaled where squares would leave the range of doubles."""
    with np.errstate(over="ignore"):
        squares = (d * d).sum(1)
    if squares.min(initial=1.0) > 1e-280 and squares.max(initial=1.0) < 1e280:
        return np.sqrt(squares)
    most = np.abs(d).max(initial=0)
    return np.sqrt(squares) if 1e-140 < most < 1e140 or not most else most * np.sqrt(((d / most) ** 2).sum(1))


def _open(squared: np.ndarray, kth: float) -> np.ndarray:
    """Which projected distances the stopping test leaves open."""
    if math.isinf(kth):
        return np.ones(len(squared), bool)
    if not kth:
        return squared == 0
    with np.errstate(over="ignore"):
        return (squared == 0) | (squared / kth / kth < REACH)


def _search(_context):
    def search(held, q, row, bound, k):
        if "searched" not in held:
            held["searched"] = Shard(held)
        return neighbours(held["searched"], q, row, bound, k)

    return search


def nearest(df: DataFrame, every: int = EVERY, k: int = K) -> DataFrame:
    return searched(df, every, k, True, _index, "spans binary, boxes binary, child binary, flat binary", _search, "double")


def op3_ann_projections_kdtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))
