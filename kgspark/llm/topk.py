"""Operator 6: exact top-k inner products of integer vectors, norm-sorted with rotated partial sums.

Components become floor(256 x).  A shard keeps its vectors by descending length, rotated to the principal axes of all
vectors (the eigenvectors of the Gram matrix, which is what a singular value decomposition gives), so that the first
coordinates hold most of a product.  A query walks the shard in slices: it ends when length times length falls below the
k-th score.  Within a slice the product is summed up in PARTS parts, the largest axes first; after each part only those
vectors stay whose partial sum plus the product of the residual lengths (Cauchy-Schwarz) reaches the k-th score.  What
stays to the end is multiplied exactly.  Bounds are floating-point, of vectors scaled to lengths near 1, with a margin, and
a bound that is not finite prunes nothing; scores are exact integers.

Vectors that are null or have null or non-finite components take no part; zero vectors do.  See ``vectors`` for repeated
ids, lengths and further columns.  Components beyond the range of exact products are multiplied as Python integers; a score
that does not fit 64 bits is an error.  Fewer candidates than k: all of them.  Equal scores: smaller id first.  An empty
table has no result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgspark.llm.shared import table
from kgspark.llm.vectors import best_of, searched

K, EVERY, SCALE = 5, 50, 256
PARTS, SLICE = 4, 512


def whole(vectors: np.ndarray) -> np.ndarray:
    """floor(256 x), kept as (integral) doubles: doubles from 2**53 on are integers too."""
    return np.floor(vectors * SCALE)


def rotations(rows: DataFrame) -> dict[int, np.ndarray]:
    """For each vector length the principal axes, from Gram matrices summed over all rows (length squared numbers each)."""

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            lists = batch.column("embedding")
            for dim in set(x for x in batch.column("dim").to_pylist()):
                part = lists.filter(pa.compute.equal(batch.column("dim"), dim))
                x = whole(part.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim))
                x = x / np.maximum(np.abs(x).max(initial=1.0), 1.0)
                sums[dim] = sums.get(dim, 0) + x.T @ x
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([m.reshape(-1) for m in sums.values()], pa.list_(pa.float64()))], names=["dim", "gram"])

    parts = rows.select("embedding", F.size("embedding").alias("dim")).mapInArrow(grams, "dim int, gram array<double>")
    places = parts.select("dim", F.posexplode("gram").alias("at", "x")).groupBy("dim", "at").agg(F.sum("x").alias("x"))
    found: dict[int, np.ndarray] = {}
    for r in places.groupBy("dim").agg(F.sort_array(F.collect_list(F.struct("at", "x"))).alias("m")).collect():
        gram = np.array([x["x"] for x in r["m"]]).reshape(r["dim"], r["dim"])
        found[r["dim"]] = np.linalg.eigh((gram + gram.T) / 2)[1][:, ::-1].copy()
    return found


def _edges(dim: int) -> list[int]:
    """Where the parts of a product end, but for the last."""
    return sorted({dim * (i + 1) // PARTS for i in range(PARTS - 1)} - {0, dim})


def _lengths(x: np.ndarray) -> tuple[np.ndarray, float]:
    """Lengths of rows over the largest component of all, and that component: no square leaves the range of doubles."""
    scale = max(float(np.abs(x).max(initial=0)), 1.0)
    y = x / scale
    return np.sqrt((y * y).sum(1)), scale


def _index(axes: dict[int, np.ndarray]):
    def index(vectors: np.ndarray):
        x = whole(vectors)
        norm, scale = _lengths(x)
        order = np.argsort(-norm, kind="stable")
        turned = (x[order] / scale) @ axes[x.shape[1]]
        rest = np.stack([np.sqrt((turned[:, e:] ** 2).sum(1)) for e in _edges(x.shape[1])] or [np.zeros(len(x))], 1)
        return order, {"norm": norm[order], "turned": turned, "rest": rest, "scale": np.array([scale])}

    return index


def products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact inner products of integral doubles."""
    most = np.abs(x).max(initial=0) * np.abs(q).max(initial=0) * len(q)
    if most < 2**53:
        return (x @ q).astype(np.int64)
    if most < 2**62 and max(np.abs(x).max(initial=0), np.abs(q).max(initial=0)) < 2**62:
        return x.astype(np.int64) @ q.astype(np.int64)
    exact = [sum(int(a) * int(b) for a, b in zip(row, q, strict=True)) for row in x]
    if any(not -(2**63) <= s < 2**63 for s in exact):
        raise OverflowError("an inner product does not fit 64 bits")
    return np.array(exact, np.int64)


class Shard:
    """A shard's integer vectors and what bounds their products."""

    def __init__(self, held: dict):
        self.x = whole(held["vector"])
        n, dim = self.x.shape
        self.row, self.ids, self.edges = held["row"], held["vec_id"], _edges(dim)
        self.norm, self.turned = np.frombuffer(held["norm"], np.float64), np.frombuffer(held["turned"], np.float64).reshape(n, dim)
        self.rest, self.scale = np.frombuffer(held["rest"], np.float64).reshape(n, -1), float(np.frombuffer(held["scale"], np.float64)[0])
        self.multiplied = 0  # vectors multiplied in full so far


def best_in(shard: Shard, axes: np.ndarray, q: np.ndarray, row: int, bound: float, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and scores of the k best; ``bound``: a k-th score known before, or NaN."""
    (q_norm,), q_scale = _lengths(q[None])
    turned = (q / q_scale) @ axes
    q_rest = [np.sqrt((turned[e:] ** 2).sum()) for e in shard.edges]
    best_rows, best = np.empty(0, np.int64), np.empty(0, np.int64)
    for start in range(0, len(shard.x), SLICE):
        rows = np.arange(start, min(start + SLICE, len(shard.x)))
        known = max(float(best[-1]) if len(best) == k else -np.inf, -np.inf if np.isnan(bound) else bound)
        kth = known / shard.scale / q_scale
        margin = 1e-9 * (q_norm * shard.norm[start] + abs(kth) + 1 / shard.scale / q_scale)
        if q_norm * shard.norm[start] + margin < kth:
            break
        partial, begin = np.zeros(len(rows)), 0
        for i, end in enumerate(shard.edges if np.isfinite(kth) else []):
            partial = partial + shard.turned[rows, begin:end] @ turned[begin:end]
            stay = ~(partial + shard.rest[rows, i] * q_rest[i] + margin < kth)
            rows, partial, begin = rows[stay], partial[stay], end
        rows = rows[shard.row[rows] != row]
        if len(rows):
            shard.multiplied += len(rows)
            all_rows, every = np.concatenate([best_rows, rows]), np.concatenate([best, products(shard.x[rows], q)])
            at = best_of(-every, shard.ids[all_rows], k)
            best_rows, best = all_rows[at], every[at]
    return best_rows, best


def _search(axes: dict[int, np.ndarray]):
    def search(held, q, row, bound, k):
        if "searched" not in held:
            held["searched"] = Shard(held)
        return best_in(held["searched"], axes[len(q)], whole(q), row, bound, k)

    return search


def best_products(df: DataFrame, every: int = EVERY, k: int = K) -> DataFrame:
    return searched(df, every, k, False, _index, "norm binary, turned binary, rest binary, scale binary", _search, "long", rotations)


def op6_topk_inner_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_products(table(spark, sf_dir, "embeddings"))


OP6_SQL = """
WITH v AS (
  SELECT vec_id, row_number() OVER () AS n, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
), p AS (
  SELECT q.vec_id AS query_id, q.n AS query_row, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.n <> c.n AND len(q.e) = len(c.e)
  WHERE q.vec_id % 50 = 0
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_row ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM p
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
