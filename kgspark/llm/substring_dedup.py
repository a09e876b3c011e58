"""Operator 1: removal of repeated word windows, with a log-structured fingerprint index.

A window is WORDS consecutive words of one document.  A word goes if a window that covers it starts anywhere else too,
the same document included; windows are judged on the input, so every copy of a repeated window goes.

Fingerprints.  Every window elects the leftmost smallest of its GRAM-word hashes as anchor; consecutive windows with one
anchor are a segment.  Equal windows elect equal anchors, so a repeated window lies in segments with equal anchors:
 * segments equal in all their words (a digest of the words themselves, and the anchor) repeat as a whole;
 * under an anchor with different segments, single windows are verified on their words, read from the texts again: once
   for each different segment, by 128-bit digests of the words.
So about one row for fifteen windows is kept instead of one for each.  Results depend on texts alone, so documents are
keyed by their text, and exact copies within a batch of rows are one fingerprint with a count.  Equal segments of a batch
of rows are one row with the list of their spots, so that what many documents share is gathered before any shuffle.

Index.  ``FingerprintIndex`` keeps the segments of all batches as immutable runs: tables bucketed by anchor and sorted in
each bucket.  A batch is written as a run of its own (``add``) and merge-joined with every older run, bucket by bucket,
so history is not shuffled (``met``: the anchors that it shares with history, or repeats itself).  ``stretches`` verifies
what lies under such anchors and answers for new and for old documents; ``compact`` merges the runs of a level into one
of the next once there are FAN_IN of them.  Only texts with different segments under such an anchor are read again.
The query and the pipeline stage take the documents in BATCHES batches, by id, and compact after the last.

Verdicts.  Where windows repeat goes back to the texts in packed rows, one for a task and a bucket of texts, and from
there one row a text, so a passage that many documents share costs no row for each place.

Null text: no words.  Texts of fewer than WORDS words are kept whole.  Repeated rows count as copies; each gets its row.
Further columns do not matter, whatever their names: they travel in one struct.  Very long texts are one row and are
handled whole.  A text is keyed by a 64-bit hash and its length.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kgspark.llm.shared import WordHashes, discard, gram_hashes, lazily, mixed, scratch, shipped, signed, table, trimmed, written

WORDS, GRAM = 35, 6
BATCHES, FAN_IN = 4, 4
SEGMENTS = "anchor long, content long, copies int, spots array<long>"
#: A spot is four numbers: the hash of the text, an id of a document that has it, its length and the first word, windows.
SPOT, SPOTS_A_ROW = 4, 4096
#: Verdicts that a task gathers before it hands them on; a memory bound.
VERDICTS_AT_ONCE = 2_000_000


def keyed(docs: DataFrame) -> DataFrame:
    """Adds the key of a document's text, and an id that is never null."""
    return docs.withColumns({"id": F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), "text_hash": F.xxhash64("text"), "size": F.coalesce(F.length("text"), F.lit(0))})


def _segments(words: int, gram: int):
    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            seen: dict[tuple[int, int], list[int]] = {}
            for k, key in enumerate(zip(batch.column("text_hash").to_pylist(), batch.column("size").to_pylist(), strict=True)):
                seen.setdefault(key, []).append(k)
            out: list[list[np.ndarray]] = [[] for _ in range(4)]
            ids, texts = batch.column("id").to_pylist(), batch.column("text")
            for (text_hash, size), rows in seen.items():
                found = (texts[rows[0]].as_py() or "").encode("utf-8", "replace").split()
                if len(found) < words:
                    continue
                g = gram_hashes(hashes.of(found), gram)
                at = anchors(g, words - gram + 1)
                first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
                n = np.diff(np.append(first, len(at)))
                content = digests_of(found, first, first + n - 1 + words, 8)[:, 0] ^ mixed_place(at[first] - first)
                m = len(first)
                spots = np.stack([np.full(m, text_hash), np.full(m, min(ids[k] for k in rows)), (size << 32) + first, n], 1)
                for column, x in zip(out, (signed(g[at[first]]), signed(content), np.full(m, len(rows)), spots), strict=True):
                    column.append(x)
            if out[0]:
                yield gathered(*map(np.concatenate, out))

    return run


def gathered(anchor: np.ndarray, content: np.ndarray, copies: np.ndarray, spots: np.ndarray) -> pa.RecordBatch:
    """One row for equal segments, with their spots: SPOTS_A_ROW at most, then another row."""
    order = np.lexsort((content, anchor))
    anchor, content = anchor[order], content[order]
    new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (content[1:] != content[:-1])])
    group = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    first = np.flatnonzero((np.arange(len(order)) - group) % SPOTS_A_ROW == 0)
    edges = pa.array(np.append(first, len(order)) * SPOT, pa.int32())
    lists = pa.ListArray.from_arrays(edges, pa.array(spots[order].astype(np.int64).reshape(-1)))
    return pa.RecordBatch.from_arrays([pa.array(anchor[first]), pa.array(content[first]), pa.array(np.add.reduceat(copies[order], first).astype(np.int32)), lists], names=["anchor", "content", "copies", "spots"])


def mixed_place(x: np.ndarray) -> np.ndarray:
    """The anchor's place in its segment, spread over 64 bits."""
    return x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def digests_of(found: list[bytes], starts: np.ndarray, ends: np.ndarray, size: int) -> np.ndarray:
    """Digests (size / 8 columns of 64 bits) of the spans [start, end) of a text's words, over the words with single blanks."""
    edges = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
    text, digest = memoryview(b" ".join(found)), xxhash.xxh3_64_digest if size == 8 else xxhash.xxh3_128_digest
    begins = np.concatenate([[0], edges])[starts].tolist()
    return np.frombuffer(b"".join([digest(text[a:b]) for a, b in zip(begins, (edges[ends - 1] - 1).tolist(), strict=True)]), np.uint64).reshape(-1, size // 8)


def anchors(grams: np.ndarray, width: int) -> np.ndarray:
    """For every run of ``width`` grams, the place of the leftmost smallest."""
    best = np.arange(len(grams))
    low, span = grams, 1
    while span < width:  # doubling: the best of two overlapping halves, the left one first
        step = min(span, width - span)
        n = len(low) - step
        right = low[step : step + n] < low[:n]
        best = np.where(right, best[step : step + n], best[:n])
        low = np.where(right, low[step : step + n], low[:n])
        span += step
    return best


def _open_windows(words: int):
    """Digests of the words of every window of the segments listed with a text."""

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list[np.ndarray]] = [[] for _ in range(5)]
            texts, rows = batch.column("text"), batch.column("segments")
            for k, id_ in enumerate(batch.column("id").to_pylist()):
                segments = [s for s in rows[k].as_py() if s["of"] == id_]
                if not segments:
                    continue
                found = (texts[k].as_py() or "").encode("utf-8", "replace").split()
                n = np.array([s["n"] for s in segments], np.int64)
                first = np.array([s["start"] for s in segments], np.int64)
                offset = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                at = np.repeat(first, n) + offset
                digest = digests_of(found, at, at + words, 16).view(np.int64)
                columns = (digest[:, 0], digest[:, 1], np.repeat(np.array([s["anchor"] for s in segments], np.int64), n), np.repeat(np.array([s["content"] for s in segments], np.int64), n), offset.astype(np.int32))
                for column, x in zip(out, columns, strict=True):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x) if x else np.empty(0, np.int64 if k < 4 else np.int32)) for k, x in enumerate(out)], names=["window", "check", "anchor", "content", "offset"])

    return run


class FingerprintIndex:
    """Immutable runs of segments, bucketed by anchor and sorted in each bucket, under one folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str | None = None, words: int = WORDS, gram: int = GRAM, buckets: int | None = None):
        if not 1 <= gram <= words:
            raise ValueError("a gram is 1 to words long")
        self.spark, self.path, self.words, self.gram = shipped(spark), path or scratch(spark, "fingerprints"), words, gram
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.runs: list[tuple[int, DataFrame]] = []  # level and table
        self.made = 0

    def _write(self, segments: DataFrame, level: int) -> DataFrame:
        name = f"kgspark_run_{uuid.uuid4().hex}"
        dealt = segments.repartition(self.buckets, "anchor")
        dealt.write.bucketBy(self.buckets, "anchor").sortBy("anchor", "content").option("compression", "zstd").option("path", f"{self.path}/run-{self.made:06d}-{level}").saveAsTable(name)
        run = self.spark.table(name)
        run._kgspark_path = f"{self.path}/run-{self.made:06d}-{level}"
        self.spark.sql(f"DROP TABLE {name}")  # only the name goes: the files and what is known of their buckets stay with ``run``
        self.made += 1
        self.runs.append((level, run))
        return run

    def add(self, docs: DataFrame) -> DataFrame:
        """Writes the segments of keyed documents as a new run."""
        return self._write(docs.select("text_hash", "size", "id", "text").mapInArrow(_segments(self.words, self.gram), SEGMENTS), 0)

    def compact(self) -> None:
        """Merges the runs of every level that has FAN_IN of them into one run of the next level.

        The old runs are deleted: what ``met`` and ``stretches`` give does not read them any more.
        """
        level = 0
        while any(x >= level for x, _ in self.runs):
            due = [run for x, run in self.runs if x == level]
            if len(due) >= FAN_IN:
                self.runs = [(x, run) for x, run in self.runs if x != level]
                self._write(reduce(DataFrame.union, due), level + 1)
                for run in due:
                    discard(run)
            level += 1

    def met(self, run: DataFrame) -> DataFrame:
        """(anchor) that ``run`` repeats or shares with another run: merge joins of buckets, no shuffle of either."""
        own = run.groupBy("anchor").agg(F.sum("copies").alias("n"))
        found = own.filter("n > 1").select("anchor")
        for _, other in self.runs:
            if other is not run:
                found = found.union(own.select("anchor").join(other.select("anchor").hint("merge"), "anchor", "left_semi"))
        return written(found.distinct(), "met")

    def stretches(self, met: DataFrame, documents: DataFrame) -> DataFrame:
        """(text_hash, size, stretches): where windows under the anchors ``met`` start that occur elsewhere in any run.

        ``documents``: keyed texts of all runs, read for anchors with different segments.
        """
        every = reduce(DataFrame.union, [run for _, run in self.runs])
        by_anchor = Window.partitionBy("anchor")  # as the runs are bucketed
        asked = every.join(met.distinct().hint("shuffle_hash"), "anchor", "left_semi")
        shared = written(asked.withColumn("open", F.min("content").over(by_anchor) != F.max("content").over(by_anchor)), "shared")
        open_ = shared.filter("open")
        kinds = open_.groupBy("anchor", "content").agg(F.sum("copies").alias("all"), F.min(F.slice("spots", 1, SPOT)).alias("one"))
        one = kinds.select("anchor", "content", *_spot(F.col("one"), F.lit(0)))
        wanted = one.groupBy("text_hash", "size").agg(F.collect_list(F.struct("start", "n", "anchor", "content", F.col("id").alias("of"))).alias("segments"))
        # All columns go along, and ids are compared later, so that this reads the shuffle that ``with_stretches`` makes.
        texts = documents.join(wanted.hint("shuffle_hash"), ["text_hash", "size"])
        windows = texts.mapInArrow(_open_windows(self.words), "window long, check long, anchor long, content long, offset int")
        same = Window.partitionBy("window", "check")
        # A text that stands twice under one id is read twice: the same window of the same segment counts once.
        counted = windows.repartition("window", "check").dropDuplicates().withColumn("k", F.count("*").over(same)).filter("k > 1")
        offsets = counted.groupBy("anchor", "content").agg(F.sort_array(F.collect_list("offset")).alias("offsets"))
        judged = kinds.select("anchor", "content", "all").join(offsets, ["anchor", "content"], "left").filter("all > 1 OR offsets IS NOT NULL")
        hits = open_.join(judged, ["anchor", "content"]).select("spots", F.when(F.col("all") == 1, F.col("offsets")).alias("offsets"))
        verdicts = shared.filter("NOT open").select("spots", F.lit(None).cast("array<int>").alias("offsets")).unionByName(hits)
        packed = verdicts.mapInArrow(_packed(self.buckets), "bucket int, verdicts array<long>")
        return packed.repartition(self.buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(_unpacked, "text_hash long, size int, stretches array<struct<start:int,n:int>>")


def _packed(buckets: int):
    """Verdicts by bucket of texts: three numbers each, the text's hash, its length and the first window, and how many windows."""

    def rows(found: list[np.ndarray]) -> pa.RecordBatch:
        x = np.concatenate(found)
        bucket = (mixed(x[:, 0].view(np.uint64)) % np.uint64(buckets)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        kinds, first = np.unique(bucket[order], return_index=True)
        return pa.RecordBatch.from_arrays([pa.array(kinds), pa.ListArray.from_arrays(pa.array(np.append(first, len(x)) * 3, pa.int32()), pa.array(x[order].reshape(-1)))], names=["bucket", "verdicts"])

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[np.ndarray] = []
        for batch in batches:
            spots, offsets = batch.column("spots"), batch.column("offsets")
            flat = spots.flatten().to_numpy(zero_copy_only=False).reshape(-1, SPOT)
            sizes = np.array(spots.value_lengths()) // SPOT
            ends = np.cumsum(sizes)
            whole = np.repeat(np.array(offsets.is_null()), sizes)
            found.append(np.ascontiguousarray(flat[whole][:, [0, 2, 3]]))
            for k in np.flatnonzero(np.array(offsets.is_valid())).tolist():
                at = np.array(offsets[k].as_py(), np.int64)
                cut = np.flatnonzero(np.diff(at, prepend=-2) > 1)  # runs of consecutive windows
                part = np.repeat(flat[ends[k] - sizes[k] : ends[k]][:, [0, 2, 3]], len(cut), 0)
                part[:, 1] += np.tile(at[cut], sizes[k])
                part[:, 2] = np.tile(np.diff(np.append(cut, len(at))), sizes[k])
                found.append(part)
            if sum(map(len, found)) >= VERDICTS_AT_ONCE:
                yield rows(found)
                found = []
        if sum(map(len, found)):
            yield rows(found)

    return run


@trimmed
def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a text, from rows sorted by bucket; a bucket of verdicts is held at once."""

    def rows(found: list[np.ndarray]) -> pa.RecordBatch:
        x = np.unique(np.concatenate(found).reshape(-1, 3), axis=0)
        size = x[:, 1] >> 32
        first = np.flatnonzero(np.concatenate([[True], (x[1:, 0] != x[:-1, 0]) | (size[1:] != size[:-1])]))
        stretch = pa.StructArray.from_arrays([pa.array((x[:, 1] & 0xFFFFFFFF).astype(np.int32)), pa.array(x[:, 2].astype(np.int32))], names=["start", "n"])
        return pa.RecordBatch.from_arrays([pa.array(x[first, 0]), pa.array(size[first].astype(np.int32)), pa.ListArray.from_arrays(pa.array(np.append(first, len(x)), pa.int32()), stretch)], names=["text_hash", "size", "stretches"])

    at, found = None, []
    for batch in batches:
        for bucket, verdicts in zip(batch.column("bucket").to_pylist(), batch.column("verdicts"), strict=True):
            if bucket != at and found:
                yield rows(found)
                found = []
            at = bucket
            found.append(verdicts.values.to_numpy(zero_copy_only=False).copy())
    if found:
        yield rows(found)


def _spot(spots: Column, at: Column) -> list[Column]:
    place = spots[at + 2]
    return [spots[at].alias("text_hash"), spots[at + 1].alias("id"), F.shiftright(place, 32).cast("int").alias("size"), place.bitwiseAND(0xFFFFFFFF).cast("int").alias("start"), spots[at + 3].cast("int").alias("n")]


def _kept(words: int):
    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: tuple[list, ...] = ([], [], [])
            for text, stretches in zip(lazily(batch.column("text")), lazily(batch.column("stretches")), strict=True):
                found, gone = kept_words(text, stretches, words)
                kept = [found[k] for k in np.flatnonzero(~gone)] if gone.any() else found
                for column, x in zip(rows, (len(found), int(gone.sum()), hashlib.sha256(b" ".join(kept)).hexdigest()), strict=True):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return run


def kept_words(text: str | None, stretches: list | None, words: int) -> tuple[list[bytes], np.ndarray]:
    """The words, and for each whether a repeated window covers it."""
    found = (text or "").encode("utf-8", "replace").split()
    edge = np.zeros(len(found) + 1, np.int64)
    if stretches:
        first = np.array([s["start"] for s in stretches])
        np.add.at(edge, first, 1)
        np.add.at(edge, first + np.array([s["n"] for s in stretches]) + words - 1, -1)
    return found, np.cumsum(edge[: len(found)]) > 0


def with_stretches(docs: DataFrame, words: int = WORDS, batches: int = BATCHES) -> DataFrame:
    """Documents with the stretches of windows that occur elsewhere among them, null where there are none."""
    known = keyed(docs)
    index = FingerprintIndex(docs.sparkSession, words=words, gram=min(GRAM, words))
    met = [index.met(index.add(known.filter(F.pmod(F.xxhash64("id"), F.lit(batches)) == k))) for k in range(batches)]
    index.compact()
    return known.join(index.stretches(reduce(DataFrame.union, met), known).hint("shuffle_hash"), ["text_hash", "size"], "left")


def digests(docs: DataFrame, words: int = WORDS) -> DataFrame:
    found = with_stretches(docs.select("doc_id", "text"), words)
    return found.mapInArrow(_kept(words), "doc_id long, n_words long, n_removed long, kept_sha256 string")


def removed(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """The documents with repeated windows taken out of their texts; an untouched text stays as it is, white space too."""
    columns = docs.columns

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, stretches in zip(lazily(batch.column("text")), lazily(batch.column("stretches")), strict=True):
                found, gone = kept_words(text, stretches, words)
                texts.append(b" ".join([found[k] for k in np.flatnonzero(~gone)]).decode("utf-8", "replace") if gone.any() else text)
            row = batch.column("row")
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if c == "text" else row.field(k) for k, c in enumerate(columns)], names=columns)

    # The other columns travel in a struct, so that no name of theirs clashes.
    found = with_stretches(docs.select("doc_id", "text", F.struct(*[F.lit(None).cast("string").alias(c) if c == "text" else F.col(c) for c in columns]).alias("row")), words)
    return found.mapInArrow(run, docs.schema)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
