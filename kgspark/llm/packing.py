"""Operator 8: packing tokenised documents into fixed windows by minimum bin slack.

A document (its ids, then one end id) is cut into whole windows and one shorter rest.  Whole windows fill sequences of
their own.  How the rests go together depends on their lengths alone, and there are fewer than ``window`` of those, so
the plan is made from a histogram: the longest rest left opens a sequence, and a subset-sum over the lengths left, kept
as the bits of one integer, finds the multiset that leaves the least slack; backtracking through the stored bitsets
gives the count of each length.  A pattern is used as often as its counts last, which at least halves what is left of
one length, so that the plan stays small however many documents there are.  Pieces then find their place from their
rank within their length: ranks come from counts of salted sub-groups, so a length that most documents share is spread.

Null text: an empty document, one end id.  Repeated rows: each is a document of its own.  No documents: no pieces.  Null
ids stay null.  Very long texts: cut into pieces of a window's length and a rest.  Columns besides doc_id and text are not
read, so their names do not matter.
"""

from __future__ import annotations

import json
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kgspark.llm.bpe import byte_letters, default_path, encode_ids
from kgspark.llm.shared import lazily, table, text_pieces, trimmed, written

WINDOW, END = 2048, 1
#: Pieces of one length that one task ranks.
RANKED_AT_ONCE = 500_000
#: Longer runs of white space are left to the trie encoder; the merging library gives up on them.
LONG_BLANK = regex.compile(r"\s{50000}")
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


_CODERS: dict[str, tiktoken.Encoding] = {}


def coder(path: str) -> tiktoken.Encoding:
    """The same byte-level vocabulary in a library that merges faster; its ids are in the order of the merges."""
    if path not in _CODERS:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(letters[c] for c in word): i for word, i in spec["model"]["vocab"].items() if word not in special}
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        _CODERS[path] = tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
    return _CODERS[path]


def token_ids(path: str, text: str | None) -> bytes:
    """The ids of a text as little-endian unsigned 32-bit integers."""
    found = []
    for piece in text_pieces(text or ""):
        if len(piece) >= 50_000 and LONG_BLANK.search(piece):
            found += encode_ids(path, [piece])
        else:
            found.append(coder(path).encode_to_numpy(piece, allowed_special="all").astype("<u4").tobytes())
    return b"".join(found)


def pieces(docs: DataFrame, path: str, window: int = WINDOW, end: int = END) -> DataFrame:
    """Whole windows and the rest of every document, with the checksum of each piece's ids."""
    last = end.to_bytes(4, "little")

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), lazily(batch.column("text")), strict=True):
                ids = token_ids(path, text) + last
                total = len(ids) // 4
                for start in range(0, total, window):
                    piece = memoryview(ids)[4 * start : 4 * (start + window)]
                    for column, value in zip(out, (doc_id, start, len(piece) // 4, zlib.crc32(piece), total), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select("doc_id", "text").mapInArrow(run, PIECES)


def best_fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of lengths, each at most its count times, whose sum comes closest to ``room`` from below.

    Bit s of a state says that some multiset of the lengths seen so far sums to s.  A length that may occur n times is
    taken up in batches of 1, 2, 4, ... (a bounded knapsack), longest first; the states are kept for the way back.
    """
    mask, full = (1 << (room + 1)) - 1, 1 << room
    states, taken, bits = [1], [], 1
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, batch = min(counts[length], room // length), 1
        while left and not bits & full:
            n = min(batch, left)
            bits = (bits | (bits << (n * length))) & mask
            states.append(bits)
            taken.append((length, n))
            left, batch = left - n, batch * 2
        if bits & full:
            break
    at, found = bits.bit_length() - 1, {}
    for k in range(len(taken) - 1, -1, -1):
        if not states[k] >> at & 1:
            length, n = taken[k]
            found[length] = found.get(length, 0) + n
            at -= n * length
    return found


def plan(histogram: dict[int, int], window: int = WINDOW) -> list[tuple[int, dict[int, int]]]:
    """(how often, lengths with their counts) of every pattern, in the order of the sequences."""
    left, made = {k: n for k, n in histogram.items() if n}, []
    while left:
        seed = max(left)
        pattern = {seed: 1}
        left[seed] -= 1
        for length, n in best_fill({k: n for k, n in left.items() if n}, window - seed).items():
            pattern[length] = pattern.get(length, 0) + n
        left[seed] += 1
        times = min(left[k] // n for k, n in pattern.items())
        made.append((times, pattern))
        for k, n in pattern.items():
            left[k] -= times * n
            if not left[k]:
                del left[k]
    return made


def places(made: list[tuple[int, dict[int, int]]]) -> dict[int, tuple[list[int], list[tuple[int, int, int]]]]:
    """For each length: the first ranks of its stretches, and for each stretch (count in a sequence, first sequence, offset)."""
    used: dict[int, int] = {}
    found: dict[int, tuple[list[int], list[tuple[int, int, int]]]] = {}
    sequence = 0
    for times, pattern in made:
        offset = 0
        for length in sorted(pattern, reverse=True):
            n = pattern[length]
            firsts, stretches = found.setdefault(length, ([], []))
            firsts.append(used.get(length, 0))
            stretches.append((n, sequence, offset))
            used[length] = used.get(length, 0) + times * n
            offset += n * length
        sequence += times
    return found


def ranked(found: DataFrame, histogram: dict[int, int]) -> DataFrame:
    """Adds ``rank``, from 0, among the pieces of the same length: sub-group offsets plus ranks within sub-groups."""
    spark = found.sparkSession
    # At most one row a length (window rows), and below one sub-group for RANKED_AT_ONCE pieces more: bounded broadcasts.
    groups = spark.createDataFrame([(k, 1 + n // RANKED_AT_ONCE) for k, n in sorted(histogram.items())], "length long, n_groups long")
    dealt = found.join(F.broadcast(groups), "length").withColumn("part", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), "n_groups")).drop("n_groups")
    sizes = dealt.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    within = Window.partitionBy("length", "part").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")
    return dealt.withColumn("rank", F.row_number().over(within) - 1).join(F.broadcast(offsets), ["length", "part"]).withColumn("rank", F.col("rank") + F.col("first")).drop("first", "part")


def pack(docs: DataFrame, path: str, window: int = WINDOW, end: int = END) -> DataFrame:
    """Every piece with its sequence and offset there."""
    found = written(pieces(docs, path, window, end), "pieces")
    histogram = {r["length"]: r["n"] for r in found.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most ``window`` rows
    where = places(plan(histogram, window))

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequences, offsets = [], []
            for length, rank in zip(batch.column("length").to_pylist(), batch.column("rank").to_pylist(), strict=True):
                firsts, stretches = where[length]
                k = bisect_right(firsts, rank) - 1
                n, sequence, offset = stretches[k]
                turn, at = divmod(rank - firsts[k], n)
                sequences.append(sequence + turn)
                offsets.append(offset + at * length)
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sequences, pa.int64()), pa.array(offsets, pa.int64())], names=[*names, "sequence_id", "offset"])

    return ranked(found, histogram).mapInArrow(run, f"{PIECES}, sequence_id long, offset long")


def op8_packing_min_slack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), default_path())
