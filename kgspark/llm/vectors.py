"""What the two vector searches share: a stated query set, in blocks, against all rows, in shards.

Rows without an id, null vectors and vectors with a null, NaN or infinite component take no part.  Every other row counts,
also where rows repeat an id or a vector: a query is a row, its candidates are all rows but that one, so what repeats may
stand in a result more than once.  Vectors of different lengths are never compared with each other.  Columns besides
vec_id and embedding are not read.

Rows go to shards by a hash of their number, so equal vectors spread; a shard holds SHARD_BYTES at most, and with more
rows there are more shards.  A shard goes once to the task that searches it, and the blocks of queries follow it there:
what is moved is the rows once and the queries once a shard.  A first search of one shard alone tells each query how good
its k-th result is at least, which the searches of the other shards start from.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kgspark.llm.shared import discard, written

SHARD_LEAST, SHARD_BYTES, SHARDS, BLOCK = 2_048, 32 << 20, 24, 512
PACKED = "dim int, part long, row binary, vec_id binary, vector binary"


def usable(df: DataFrame, nonzero: bool) -> DataFrame:
    """(vec_id, embedding array<double>) of the rows that take part."""
    vector = F.col("embedding")
    fine = vector.isNotNull() & F.col("vec_id").isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    if nonzero:
        fine &= F.exists(vector, lambda x: x != 0)
    return df.select(F.col("vec_id").cast("long").alias("vec_id"), vector.cast("array<double>").alias("embedding")).filter(F.coalesce(fine, F.lit(False)))


def packed(rows: DataFrame, part, index: Callable | None = None, extra: str = "") -> DataFrame:
    """One row for each (vector length, part): row numbers, ids, vectors and, of queries, bounds, as bytes, and what ``index`` makes of the vectors."""
    names = [x.split()[0] for x in extra.split(", ") if x]

    def pack(group: pa.Table) -> pa.Table:
        dim = group.column("dim")[0].as_py()
        row = group.column("row").to_numpy()
        order = np.argsort(row, kind="stable")
        vectors = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in group.column("embedding").chunks]).reshape(-1, dim)[order]
        at, made = index(vectors) if index else (slice(None), {"bound": group.column("bound").to_numpy()[order]})
        columns = {"row": row[order][at], "vec_id": group.column("vec_id").to_numpy()[order][at], "vector": vectors[at]} | {n: made[n] for n in names}
        return pa.table({"dim": group.column("dim").slice(0, 1), "part": group.column("part").slice(0, 1)} | {n: pa.array([np.ascontiguousarray(x).tobytes()], pa.binary()) for n, x in columns.items()})

    return rows.withColumns({"dim": F.size("embedding"), "part": part}).groupBy("dim", "part").applyInArrow(pack, PACKED + (", " + extra if extra else ""))


def searched(df: DataFrame, every: int, k: int, nonzero: bool, index, extra: str, search, score: str, prepare=None) -> DataFrame:
    """The k best rows of each query (ids divisible by ``every``): (query_id, rank, vec_id, score).

    ``index(context)`` -> function(vectors) -> (order of the rows, arrays by name as in ``extra``); ``search(context)`` -> function
    (shard's arrays, query, its row number, bound, k) -> (row places, scores).  The best score is the smallest of type
    double, the largest of type long; equal ones go by the smaller id.
    """
    rows = written(usable(df, nonzero).withColumn("row", F.monotonically_increasing_id()), "vectors")  # written once, so the numbers last
    n = rows.agg(F.count("*").alias("n"), F.count_if(F.col("vec_id") % every == 0).alias("q"), F.max(F.size("embedding")).alias("dim")).first()
    shards = max(1, math.ceil(n["n"] / max(1, min(max(n["n"] // SHARDS, SHARD_LEAST), SHARD_BYTES // (8 * (n["dim"] or 1))))))
    blocks = max(1, math.ceil(n["q"] / BLOCK))
    context = prepare(rows) if prepare else None
    names = [x.split()[0] for x in extra.split(", ") if x]
    shard = written(packed(rows, F.pmod(F.xxhash64("row"), F.lit(shards)), index(context), extra), "shards")
    queries = rows.filter(F.col("vec_id") % every == 0)
    worst = "double" if score == "double" else "long"
    run_search = search(context)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                dim = row["dim"]
                numbers, ids, vectors = np.frombuffer(row["row"], np.int64), np.frombuffer(row["vec_id"], np.int64), np.frombuffer(row["vector"], np.float64).reshape(-1, dim)
                if not row["kind"]:
                    held = {"key": (dim, row["part"]), "row": numbers, "vec_id": ids, "vector": vectors} | {c: row[c] for c in names}
                    continue
                if held.get("key") != (dim, row["part"]):
                    continue
                bounds = np.frombuffer(row["bound"], np.float64)
                found = [(number, query_id, *run_search(held, q, number, bound, k)) for number, query_id, q, bound in zip(numbers.tolist(), ids.tolist(), vectors, bounds.tolist(), strict=True)]
                counts = [len(f[2]) for f in found]
                if sum(counts):
                    places, value = (np.concatenate([f[i] for f in found]) for i in (2, 3))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.repeat([f[0] for f in found], counts), pa.int64()), pa.array(np.repeat([f[1] for f in found], counts), pa.int64()), pa.array(held["vec_id"][places], pa.int64()), pa.array(value, pa.int64() if worst == "long" else pa.float64())],
                        names=["row", "query_id", "vec_id", "score"],
                    )

    def met(part: str, bounds: DataFrame | None) -> DataFrame:
        asked = queries.join(bounds, "row", "left") if bounds is not None else queries.withColumn("bound", F.lit(None).cast("double"))
        block = packed(asked.withColumn("bound", F.coalesce("bound", F.lit(float("nan")))), F.pmod(F.xxhash64(F.lit(7), "row"), F.lit(blocks)), extra="bound binary")
        parts = F.filter(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long")), lambda p: (p == 0) if part == "first" else (p != 0))
        sent = block.drop("part").select("dim", F.explode(parts).alias("part"), F.lit(1).alias("kind"), "row", "vec_id", "vector", *(F.lit(None).cast("binary").alias(c) for c in names), "bound")
        mine = shard.filter("part = 0" if part == "first" else "part <> 0").select("dim", "part", F.lit(0).alias("kind"), "row", "vec_id", "vector", *names, F.lit(None).cast("binary").alias("bound"))
        dealt = mine.union(sent).repartition(shards, "part").sortWithinPartitions("part", "dim", "kind")
        return written(dealt.mapInArrow(run, f"row long, query_id long, vec_id long, score {score}"), "best")

    first = met("first", None)
    order = [F.col("score") if score == "double" else F.col("score").desc(), F.col("vec_id")]
    best = first
    if shards > 1:
        kth = first.groupBy("row").agg(F.count("*").alias("n"), (F.max("score") if score == "double" else F.min("score")).cast("double").alias("bound")).filter(F.col("n") >= k).select("row", "bound")
        best = first.union(met("others", kth))
    discard(shard)
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("row").orderBy(*order))).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def best_of(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k smallest scores, ties to the smaller id."""
    if len(scores) > 4 * k:
        limit = np.partition(scores, k - 1)[k - 1]
        at = np.flatnonzero(scores <= limit)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], scores[at]))[:k]]
