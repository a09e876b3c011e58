"""Operator 2: language-model scores by deleted interpolation.

P(w | v) = a2(b) c(v w) / c(v) + a1(b) c(w) / N + a0(b) / (V + 1), where b is the bucket of the context's frequency c(v)
(its binary logarithm) and the weights of each bucket are learnt by expectation-maximisation on counts held out of the
maximum-likelihood estimates.  The context of a text's first word is the end token.

How it runs.  Texts are encoded once into chunks: the sorted 64-bit hashes of a chunk's distinct words, and for every
token the index of its word.  Counting goes by hash buckets: every chunk sends each bucket its distinct keys with its
counts, pre-aggregated, as one row of packed arrays; the bucket adds them up and answers every chunk with the totals in
the order asked, so keys never travel back.  That is done once for words and once for pairs, the pairs carrying what is
known of their words by then, so that a pair bucket can also gather the held-out statistics.  A frequent word, or a
frequent pair, reaches its bucket once a chunk.  The statistics for EM are a histogram over (context bucket, log-ratios
of the three estimates), whose size is bounded by its bins.

Words are told apart by 64-bit hashes: two words with one hash would count as one.

Null text: the empty text, one end token.  Very long texts are one document of a chunk, whole.  Columns besides doc_id and
text are not read.  Repeated rows count and are scored each.  Null ids: crc32 of the empty text.
No training tokens: N = V = 0 and the model is uniform over one unknown word, log10 probability 0 a token.
"""

from __future__ import annotations

import math
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgspark.llm.shared import WordHashes, crc_part, mixed, table, written

PARTS, TEST_PART, DELETED_PART = 7, 2, 3
CHUNK_WORDS = 1_000_000
#: Keys that one bucket adds up, by which the number of buckets follows the input.
BUCKET_KEYS = 4_000_000
CONTEXTS, STEP, ROUNDS = 32, 4, 30
#: The key of the end token: the hash of a blank, which no word holds.
END = np.uint64(xxhash.xxh3_64_intdigest(b" "))
UPPER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")

CHUNK = "chunk binary, doc_ids array<long>, part binary, n_tokens binary, words binary, tokens binary, n_words long, total_tokens long"


def squeezed(x: np.ndarray) -> bytes:
    """An integer array by byte planes, then zstandard: small integers shrink to about their entropy."""
    width = x.dtype.itemsize
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, width).T).tobytes())


def expanded(blob: bytes, dtype: str) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    width = np.dtype(dtype).itemsize
    return np.ascontiguousarray(raw.reshape(width, -1).T).view(dtype).reshape(-1)


def _batch(names: str, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns), names=names.split())


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    """The rows of a batch one by one: they are of several MB."""
    return (batch.slice(k, 1).to_pylist()[0] for k in range(batch.num_rows))


def encoded(docs: DataFrame) -> DataFrame:
    """Documents as chunks of about CHUNK_WORDS tokens; a document is never split."""

    def chunk(hashes: WordHashes, ids: list, lists: list[list[bytes]]) -> pa.RecordBatch:
        sizes = np.array([len(x) + 1 for x in lists], np.uint32)
        every = np.empty(int(sizes.sum()), np.uint64)
        at = 0
        for words, size in zip(lists, sizes.tolist(), strict=True):
            every[at : at + size - 1] = hashes.of(words)
            every[at + size - 1] = END
            at += size
        words, tokens, counts = np.unique(every, return_inverse=True, return_counts=True)
        by_count = np.argsort(-counts, kind="stable")  # frequent words get small numbers, which pack well
        number = np.empty(len(words), np.uint32)
        number[by_count] = np.arange(len(words), dtype=np.uint32)
        words, tokens = words[by_count], number[tokens]
        part = bytes(crc_part(x, PARTS) for x in ids)
        name = uuid.uuid4().bytes  # the table is written once, so the name lasts
        return _batch(
            "chunk doc_ids part n_tokens words tokens n_words total_tokens",
            pa.array([name], pa.binary()), pa.array([ids], pa.list_(pa.int64())), pa.array([part], pa.binary()), pa.array([squeezed(sizes)], pa.binary()), pa.array([words.tobytes()], pa.binary()), pa.array([squeezed(tokens)], pa.binary()), pa.array([len(words)], pa.int64()), pa.array([len(every)], pa.int64()),
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        ids, lists, size = [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                words = (text or "").encode("utf-8", "replace").translate(UPPER).split()
                ids.append(doc_id)
                lists.append(words)
                size += len(words) + 1
                if size >= CHUNK_WORDS:
                    yield chunk(hashes, ids, lists)
                    ids, lists, size = [], [], 0
        if ids:
            yield chunk(hashes, ids, lists)

    return docs.select("doc_id", "text").mapInArrow(run, CHUNK)


def _dealt(keys: np.ndarray, n_buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of a chunk's keys by bucket and, within a bucket, by key; and where each bucket begins."""
    by_key = np.argsort(keys)
    bucket = ((keys >> np.uint64(40)) % np.uint64(n_buckets))[by_key]
    by_bucket = np.argsort(bucket, kind="stable")
    return by_key[by_bucket], np.searchsorted(bucket[by_bucket], np.arange(n_buckets + 1, dtype=np.uint64))


def _sent(keys: np.ndarray, n_buckets: int, columns: list[np.ndarray]) -> Iterator[tuple[int, bytes, list[bytes]]]:
    """The keys of one chunk by bucket: (bucket, gaps between the sorted keys, columns)."""
    order, bounds = _dealt(keys, n_buckets)
    for k in range(n_buckets):
        at = order[bounds[k] : bounds[k + 1]]
        if len(at):
            yield k, squeezed(np.diff(keys[at], prepend=np.uint64(0))), [squeezed(x[at]) for x in columns]


def _received(blobs: list[bytes]) -> tuple[np.ndarray, list[int]]:
    """The keys of all chunks, and how many each sent."""
    every = [np.cumsum(expanded(x, "<u8"), dtype=np.uint64) for x in blobs]
    return np.concatenate(every), [len(x) for x in every]


def _answered(n: int, keys: np.ndarray, n_buckets: int, answers: dict[int, list[np.ndarray]]) -> list[np.ndarray]:
    """The buckets' answers put back into the order of the chunk's keys."""
    order, _ = _dealt(keys, n_buckets)
    out = []
    for k in range(n):
        x = np.empty(len(keys), np.int64)
        x[order] = np.concatenate([answers[b][k] for b in sorted(answers)])
        out.append(x)
    return out


def _in_training(part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return part != TEST_PART, part == DELETED_PART


def _local(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, tokens, lengths, and for each token whether it trains and whether it is held out of the estimates."""
    words, tokens, sizes = np.frombuffer(row["words"], np.uint64), expanded(row["tokens"], "<u4"), expanded(row["n_tokens"], "<u4")
    train, deleted = _in_training(np.frombuffer(row["part"], np.uint8))
    return words, tokens, sizes, np.repeat(train, sizes), np.repeat(deleted, sizes)


def _pairs(row: dict) -> tuple[np.ndarray, ...]:
    """Per token the index of its pair, and for each distinct pair its hash, context and word."""
    words, tokens, sizes, train, deleted = _local(row)
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    end = np.flatnonzero(words == END)[0]
    before[np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)] = end
    pair, which = np.unique(before.astype(np.uint64) * np.uint64(len(words)) + tokens, return_inverse=True)
    context, word = (pair // np.uint64(len(words))).astype(np.int64), (pair % np.uint64(len(words))).astype(np.int64)
    keys = mixed(words[context] * np.uint64(0x9E3779B97F4A7C15) + mixed(words[word]))
    return tokens, sizes, train, deleted, which, keys, context, word


def word_counts(chunks: DataFrame, n_buckets: int) -> DataFrame:
    """For every (chunk, bucket): counts of its words in training and in the part the estimates are made from; and totals."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                words, tokens, _, train, deleted = _local(row)
                n = len(words)
                columns = [np.bincount(tokens[which], minlength=n).astype(np.uint32) for which in (train, train & ~deleted)]
                rows = list(_sent(words, n_buckets, columns))
                if rows:
                    yield _batch("bucket chunk keys train kept", pa.array([r[0] for r in rows], pa.int64()), pa.array([row["chunk"]] * len(rows), pa.binary()), pa.array([r[1] for r in rows], pa.binary()), *(pa.array([r[2][k] for r in rows], pa.binary()) for k in range(2)))

    def add(tables: pa.Table) -> pa.Table:
        keys, sizes = _received(tables.column("keys").to_pylist())
        every, which = np.unique(keys, return_inverse=True)
        sums = []
        for name in ("train", "kept"):
            x = np.concatenate([expanded(b, "<u4") for b in tables.column(name).to_pylist()])
            sums.append(np.bincount(which, x, minlength=len(every)).astype(np.int64))
        ends = np.cumsum(sizes)
        answers = [[squeezed(s[which[e - n : e]]) for e, n in zip(ends, sizes, strict=True)] for s in sums]
        rows = len(sizes)
        totals = [int(sums[0].sum()), int((sums[0] > 0).sum()), int(sums[1].sum()), int((sums[1] > 0).sum())]
        return pa.table({"bucket": tables.column("bucket"), "chunk": tables.column("chunk"), "train": pa.array(answers[0], pa.binary()), "kept": pa.array(answers[1], pa.binary())} | {c: pa.array([x] + [0] * (rows - 1), pa.int64()) for c, x in zip(("n", "v", "n_kept", "v_kept"), totals, strict=True)})

    sent = chunks.select("chunk", "part", "n_tokens", "words", "tokens").mapInArrow(send, "bucket long, chunk binary, keys binary, train binary, kept binary")
    return sent.groupBy("bucket").applyInArrow(add, "bucket long, chunk binary, train binary, kept binary, n long, v long, n_kept long, v_kept long")


def with_answers(chunks: DataFrame, answers: DataFrame, *columns: str) -> DataFrame:
    """Chunks with the answers of all buckets, as one array a chunk (at most one element a bucket)."""
    gathered = answers.groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("bucket", *columns))).alias("answers"))
    return chunks.join(gathered, "chunk")


def _word_answers(row: dict, n_buckets: int) -> list[np.ndarray]:
    return _answered(2, np.frombuffer(row["words"], np.uint64), n_buckets, {a["bucket"]: [expanded(a["train"], "<i8"), expanded(a["kept"], "<i8")] for a in row["answers"]})


def contexts_of(count: np.ndarray) -> np.ndarray:
    """Bucket of a context's frequency: 0 for none, else one more than its binary logarithm."""
    return np.minimum(np.where(count > 0, np.log2(np.maximum(count, 1)).astype(np.int64) + 1, 0), CONTEXTS - 1)


def pair_counts(chunks: DataFrame, n_buckets: int, word_buckets: int, n_kept: int, v_kept: int) -> DataFrame:
    """For every (chunk, bucket): training counts of its pairs; and, once a bucket, held-out statistics of those pairs."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                _, kept_words = _word_answers(row, word_buckets)
                _, _, train, deleted, which, keys, context, word = _pairs(row)
                n = len(keys)
                count = [np.bincount(which[x], minlength=n).astype(np.uint32) for x in (train, train & ~deleted, deleted)]
                # What the held-out statistics need of a pair's words goes along only where the pair is held out.
                asked = count[2] > 0
                held = [np.where(asked, kept_words[x], 0).astype(np.uint32) for x in (context, word)]
                rows = list(_sent(keys, n_buckets, [*count, *held]))
                names = ("train", "kept", "deleted", "context", "word")
                if rows:
                    yield _batch("bucket chunk keys " + " ".join(names), pa.array([r[0] for r in rows], pa.int64()), pa.array([row["chunk"]] * len(rows), pa.binary()), pa.array([r[1] for r in rows], pa.binary()), *(pa.array([r[2][k] for r in rows], pa.binary()) for k in range(5)))

    def add(tables: pa.Table) -> pa.Table:
        keys, sizes = _received(tables.column("keys").to_pylist())
        every, which = np.unique(keys, return_inverse=True)
        got = {c: np.concatenate([expanded(b, "<u4") for b in tables.column(c).to_pylist()]) for c in ("train", "kept", "deleted", "context", "word")}
        total = {c: np.bincount(which, got[c], minlength=len(every)).astype(np.int64) for c in ("train", "kept")}
        at = got["deleted"] > 0
        bins, weight = _bins(total["kept"][which[at]], got["context"][at].astype(np.int64), got["word"][at].astype(np.int64), got["deleted"][at], n_kept, v_kept)
        ends = np.cumsum(sizes)
        rows = len(sizes)
        return pa.table({
            "bucket": tables.column("bucket"), "chunk": tables.column("chunk"), "train": pa.array([squeezed(total["train"][which[e - n : e]]) for e, n in zip(ends, sizes, strict=True)], pa.binary()),
            "bins": pa.array([bins.tolist()] + [[]] * (rows - 1), pa.list_(pa.int64())), "weights": pa.array([weight.tolist()] + [[]] * (rows - 1), pa.list_(pa.float64())),
        })

    sent = chunks.select("chunk", "part", "n_tokens", "words", "tokens", "answers").mapInArrow(send, "bucket long, chunk binary, keys binary, train binary, kept binary, deleted binary, context binary, word binary")
    return sent.groupBy("bucket").applyInArrow(add, "bucket long, chunk binary, train binary, bins array<long>, weights array<double>")


def _bins(pair: np.ndarray, context: np.ndarray, word: np.ndarray, times: np.ndarray, n: int, v: int) -> tuple[np.ndarray, np.ndarray]:
    """Held-out tokens by (context bucket, log-ratio of the pair's and of the word's estimate to the uniform one).

    A log-ratio is rounded to a STEP-th of an octave; 0 stands for an estimate of nothing.
    """
    uniform = 1 / (v + 1)

    def level(p: np.ndarray) -> np.ndarray:
        return np.where(p > 0, np.clip(np.round(np.log2(np.maximum(p, 1e-300) / uniform) * STEP).astype(np.int64) + 500, 1, 999), 0)

    if not len(pair):
        return np.empty(0, np.int64), np.empty(0, np.float64)
    key = (contexts_of(context) * 1000 + level(pair / np.maximum(context, 1))) * 1000 + level(word / max(n, 1))
    found, which = np.unique(key, return_inverse=True)
    return found, np.bincount(which, times)


def fitted(bins: list[tuple[int, float]]) -> np.ndarray:
    """Weights (pair, word, uniform) of each context bucket by EM; a bucket without held-out tokens takes its lower neighbour's."""
    weights, known = np.tile(np.array([0.0, 0.5, 0.5]), (CONTEXTS, 1)), np.array([0.0, 0.5, 0.5])
    for b in range(CONTEXTS):
        rows = [(k, n) for k, n in bins if k // 1_000_000 == b]
        if rows:
            keys, n = np.array([k for k, _ in rows]), np.array([x for _, x in rows], float)
            levels = np.stack([keys // 1000 % 1000, keys % 1000], 1)
            ratio = np.concatenate([np.where(levels > 0, 2.0 ** ((levels - 500) / STEP), 0), np.ones((len(keys), 1))], 1)
            w = np.full(3, 1 / 3)
            for _ in range(ROUNDS):
                share = ratio * w
                share /= share.sum(1, keepdims=True)
                w = (share * n[:, None]).sum(0) / n.sum()
            w = np.maximum(w, 1e-6)  # no word is impossible
            known = w / w.sum()
        weights[b] = known
    return weights


def scored(chunks: DataFrame, n_buckets: int, word_buckets: int, n: int, v: int, weights: np.ndarray) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                words, _ = _word_answers(row, word_buckets)
                tokens, sizes, _, _, which, keys, context, word = _pairs(row)
                (pair,) = _answered(1, keys, n_buckets, {a["bucket"]: [expanded(a["train"], "<i8")] for a in row["pair_answers"]})
                w = weights[contexts_of(words[context])]
                p = w[:, 0] * pair / np.maximum(words[context], 1) + w[:, 1] * words[word] / max(n, 1) + w[:, 2] / (v + 1)
                # Without a known context the first estimate says nothing; its share goes to the others.
                p = np.where(words[context] > 0, p, p / (1 - w[:, 0])) if n else np.ones(len(keys))
                firsts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
                log_p, base = np.log10(p)[which], np.log10((words[tokens] + 1) / (n + v + 1))
                part = np.frombuffer(row["part"], np.uint8)
                sums = [np.add.reduceat(x, firsts) for x in ((words[tokens] > 0).astype(np.int64), base, log_p)]
                yield _batch(
                    "doc_id held_out n_tokens n_known train_tokens base_score score",
                    pa.array(row["doc_ids"], pa.int64()), pa.array(part == TEST_PART), pa.array(sizes.astype(np.int64)), pa.array(sums[0]), pa.array(np.full(len(sizes), n, np.int64)), pa.array(sums[1]), pa.array(sums[2]),
                )

    return chunks.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def score(docs: DataFrame) -> DataFrame:
    """Scores of every document by a model trained on those whose id does not fall in the test part."""
    spark = docs.sparkSession
    chunks = written(encoded(docs), "chunks")
    size = chunks.agg(F.sum("n_words").alias("w"), F.sum("total_tokens").alias("t")).first()
    least = int(re.sub(r"\D", "", spark.conf.get("spark.sql.shuffle.partitions")) or 1)
    word_buckets, pair_buckets = (max(1, min(least, 4 * math.ceil((x or 0) / 100_000)), math.ceil((x or 0) / BUCKET_KEYS)) for x in (size["w"], size["t"]))
    counted = written(word_counts(chunks, word_buckets), "words")
    total = counted.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "v", "n_kept", "v_kept"))).first()
    known = with_answers(chunks, counted, "train", "kept")
    pairs = written(pair_counts(known, pair_buckets, word_buckets, total["n_kept"], total["v_kept"]), "pairs")
    held = pairs.select(F.explode(F.arrays_zip("bins", "weights")).alias("x")).groupBy(F.col("x.bins").alias("bin")).agg(F.sum("x.weights").alias("n"))
    weights = fitted(sorted((r["bin"], r["n"]) for r in held.collect()))  # bounded by the bins
    answers = pairs.groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("bucket", "train"))).alias("pair_answers"))
    return written(scored(known.join(answers, "chunk"), pair_buckets, word_buckets, total["n"], total["v"], weights), "scores")


def op2_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))

