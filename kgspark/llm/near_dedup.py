"""Operator 7: near-duplicate documents by DartMinHash.

Documents are sets of SHINGLE-word shingles (a shorter one is its whole word sequence), weighted by their counts unless
asked otherwise; two are linked if their weighted Jaccard similarity is at least THRESHOLD, and classes are what links connect.

Signatures.  Over every element's weight axis lie strips [0, 1), [1, 2), [2, 4), ...; in each strip hashed darts arrive in
order of rank, by a Poisson process whose rate is the strip's width, and hit a weight in the strip and one of the
coordinates.  A document keeps the darts below its elements' weights and, of those, the earliest of each coordinate.  Two
documents agree in a coordinate with the probability of their weighted Jaccard similarity; the work is about
K (ln K + 2) darts however long the document is.

Joining.  BANDS bands of ROWS coordinates are dealt into buckets; a pair at the threshold shares none of them with a
probability of about 2e-5.  Within a bucket pairs are not listed.  Its hub, the document with the largest buckets (in a
group of copies, the one they were made from), is compared with the others: a star.  Only where a bucket still holds
different classes after that are members of different classes compared, every one with every other, in blocks of at most
about BLOCK members that are dealt over all tasks; members of one class are not.  Two bounds, neither of which loses a
link, decide there which pairs are listed at all, so that many variants of one text that are not near-duplicates of each
other cost few pairs: a document's shingles that no other of these documents has bound how much it shares with any of
them; and where PARITY_WORDS x 64 bits, each the parity of how many shingles fall on it, differ between two documents,
their shingles differ at least as often.  Similarities are computed from the texts.  So a link is lost only if the two
documents share no bucket.

Exact copies are one node with a count.  Null texts and texts without words are not duplicates of anything: each is its
own class.  Repeated rows are copies.  Null ids stay null; a class is named by its smallest id.  Very long texts are
handled whole, a part of their shingles' darts at a time.  ``representatives`` carries further columns in one struct,
so that their names never clash; ``grouped`` does not read them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgspark.llm.shared import WordHashes, discard, gram_hashes, mixed, signed, span_hashes, table, trimmed, written

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 36, 6
BLOCK, PARITY_WORDS = 256, 8
#: Memory bounds of a task: documents and shingles taken up at once, and shingles and darts of one throw.
DOCS_AT_ONCE, SHINGLES_AT_ONCE, SHINGLES_A_THROW, DARTS_A_THROW = 4_000, 1_000_000, 200_000, 1_000_000
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
SHORT_BASE = 0xD1342543DE82EF95


def shingles(hashes: WordHashes, text: str | None, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of a text, sorted, and their counts."""
    h = hashes.of((text or "").encode("utf-8", "replace").split())
    if not len(h):
        return h, np.empty(0, np.int64)
    grams = gram_hashes(h, n) if len(h) >= n else span_hashes(h, np.array([0]), np.array([len(h)]), SHORT_BASE)
    return np.unique(grams, return_counts=True)


def _uniform(x: np.ndarray) -> np.ndarray:
    """(0, 1] from the upper 53 bits."""
    return ((x >> np.uint64(11)) + np.uint64(1)).astype(np.float64) * 2.0**-53


def signatures(elements: list[np.ndarray], weights: list[np.ndarray], k: int) -> np.ndarray:
    """DartMinHash signatures (a row a document, k dart ids) of non-empty weighted sets."""
    n_docs = len(elements)
    doc = np.repeat(np.arange(n_docs), [len(x) for x in elements])
    element, weight = np.concatenate(elements), np.concatenate(weights).astype(np.float64)
    total = np.bincount(doc, weight, n_docs)
    bound = k * (math.log(k) + 2) / total
    # One strip for each power of two that an element's weight reaches into.
    strips, low = [(doc, element, weight, np.zeros(len(doc)), np.ones(len(doc)))], 1.0
    while (up := np.flatnonzero(weight > low)).size:
        strips.append((doc[up], element[up], weight[up], np.full(len(up), low), np.full(len(up), low)))
        low *= 2
    seed = np.concatenate([mixed(s[1] + np.uint64(int(GOLDEN) * (i + 1) % 2**64)) for i, s in enumerate(strips)])
    doc, element, weight, base, width = (np.concatenate([s[i] for s in strips]) for i in range(5))
    rank, step = np.zeros(len(doc)), np.zeros(len(doc), np.uint64)
    best, found = np.full(n_docs * k, np.inf), np.zeros(n_docs * k, np.uint64)
    pending = np.arange(len(doc))
    # Each strip's next dart is drawn; it counts if it lies below the bound, else it waits until the bound is raised.
    drawn = mixed(seed)
    rank += -np.log(_uniform(drawn)) / width
    while True:
        active = pending[rank[pending] <= bound[doc[pending]]]
        while len(active):
            dart = mixed(drawn[active] ^ GOLDEN)
            hit = base[active] + width[active] * ((dart & np.uint64(0xFFFFFFFF)).astype(np.float64) * 2.0**-32)
            slot, at = doc[active] * k + ((dart >> np.uint64(32)) % np.uint64(k)).astype(np.int64), rank[active]
            good = (hit < weight[active]) & (at < best[slot])
            slot, at = slot[good], at[good]
            np.minimum.at(best, slot, at)
            first = best[slot] == at
            found[slot[first]] = dart[good][first]
            step[active] += np.uint64(1)
            draw = drawn[active] = mixed(seed[active] + step[active] * GOLDEN)
            then = rank[active] = rank[active] - np.log(_uniform(draw)) / width[active]
            active = active[then <= bound[doc[active]]]
        open_docs = np.flatnonzero(np.isinf(best.reshape(n_docs, k)).any(1))
        if not len(open_docs):
            return found.reshape(n_docs, k)
        bound[open_docs] *= 2
        pending = np.flatnonzero(np.isin(doc, open_docs))


def band_hashes(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    out = np.tile(np.arange(1, bands + 1, dtype=np.uint64) * GOLDEN, (len(signature), 1))
    parts = signature.reshape(len(signature), bands, rows)
    for r in range(rows):
        out = mixed(out * np.uint64(0xD1342543DE82EF95) + parts[:, :, r])
    return out


def _banded(n: int, bands: int, rows: int, weighted: bool):
    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        most_docs = max(1, int(DARTS_A_THROW / (bands * rows * (math.log(bands * rows) + 2))))

        def thrown(sets: list) -> Iterator[pa.RecordBatch]:
            sets.sort(key=lambda s: len(s[1]))  # documents of one size need as many draws
            while sets:
                size, take = 0, 0
                while take < min(len(sets), most_docs) and (not take or size + len(sets[take][1]) <= SHINGLES_A_THROW):
                    size += len(sets[take][1])
                    take += 1
                part, sets = sets[:take], sets[take:]
                signature = signatures([s[1] for s in part], [s[2] if weighted else np.ones(len(s[1])) for s in part], bands * rows)
                yield pa.RecordBatch.from_arrays([pa.array(signed(band_hashes(signature, bands, rows).reshape(-1))), pa.array(np.repeat(np.array([s[0] for s in part], np.int64), bands))], names=["bucket", "node"])

        for batch in batches:
            texts, sets, size = batch.column("text"), [], 0
            for node, k in {node: k for k, node in enumerate(batch.column("node").to_pylist())}.items():
                s = (node, *shingles(hashes, texts[k].as_py(), n))
                if len(s[1]):
                    sets.append(s)
                    size += len(s[1])
                if len(sets) >= DOCS_AT_ONCE or size >= SHINGLES_AT_ONCE:
                    yield from thrown(sets)
                    sets, size = [], 0
            yield from thrown(sets)

    return run


def _similar(n: int, threshold: float, weighted: bool):
    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        known: dict[int, tuple[np.ndarray, np.ndarray]] = {}

        def of(node: int, text: str):
            if node not in known:
                if len(known) > 256:
                    known.clear()
                known[node] = shingles(hashes, text, n)
            return known[node]

        for batch in batches:
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            text_a, text_b = batch.column("text_a"), batch.column("text_b")
            linked = []
            for k, (x, y) in enumerate(zip(a, b, strict=True)):
                (s, w), (t, v) = shingles(hashes, text_a[k].as_py(), n), of(y, text_b[k].as_py())
                both, i, j = np.intersect1d(s, t, assume_unique=True, return_indices=True)
                shared, total = (np.minimum(w[i], v[j]).sum(), w.sum() + v.sum()) if weighted else (len(both), len(s) + len(t))
                linked.append(shared >= threshold * (total - shared) - 1e-9)
            keep = pa.array(linked, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], names=["a", "b"])

    return run


def components(edges: DataFrame) -> DataFrame:
    """(node, comp): the smallest node that links lead to, by label spreading and pointer jumping."""
    both = written(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    every = labels = written(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("comp")).withColumnRenamed("a", "node"), "labels")
    while True:
        spread = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("comp").alias("near")).withColumnRenamed("a", "node")
        nearer = labels.join(spread, "node").select("node", F.least("comp", "near").alias("comp"), F.col("comp").alias("old"))
        ends = nearer.select(F.col("node").alias("comp"), F.col("comp").alias("end"))
        new = written(nearer.join(ends, "comp", "left").select("node", F.least("comp", F.coalesce("end", "comp")).alias("comp"), "old"), "labels")
        discard(every)
        every, labels = new, new.select("node", "comp")
        if new.filter("comp <> old").isEmpty():
            discard(both)
            return labels


def _listed(n: int, weighted: bool):
    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for node, text in zip(batch.column("node").to_pylist(), batch.column("text").to_pylist(), strict=True):
                grams, counts = shingles(hashes, text, n)
                weight = counts if weighted else np.ones(len(grams), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(grams), node, np.int64)), pa.array(signed(grams)), pa.array(weight)], names=["node", "shingle", "weight"])

    return run


def _parities(n: int, weighted: bool):
    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            totals, bits = [], []
            for text in batch.column("text").to_pylist():
                grams, counts = shingles(hashes, text, n)
                totals.append(int(counts.sum()) if weighted else len(grams))
                odd = np.bincount((mixed(grams) >> np.uint64(32)).astype(np.int64) % (64 * PARITY_WORDS), minlength=64 * PARITY_WORDS) % 2
                bits.append(np.packbits(odd.astype(np.uint8)).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(totals, pa.int64()), pa.array(bits, pa.list_(pa.int64()))], names=["node", "total", "parity"])

    return run


def bounds_of(texts: DataFrame, n: int, threshold: float, weighted: bool) -> DataFrame:
    """(node, total, parity, reach): the weight of a text's shingles, their parities, and the most that a similar text weighs.

    What is shared with another text is at most the weight of the shingles that some other text has too.
    """
    every = texts.select("node", "text").mapInArrow(_listed(n, weighted), "node long, shingle long, weight long")
    owned = every.groupBy("shingle").agg(F.count("*").alias("texts"), F.min("node").alias("node"), F.sum("weight").alias("weight"))
    alone = owned.filter("texts = 1").groupBy("node").agg(F.sum("weight").alias("alone"))
    total = texts.select("node", "text").mapInArrow(_parities(n, weighted), "node long, total long, parity array<long>")
    shared = F.col("total") - F.coalesce("alone", F.lit(0))
    return written(total.join(alone, "node", "left").select("node", "total", "parity", (shared * (1 + threshold) / threshold - F.col("total") + 1e-6).alias("reach")), "bounds")


def linked(pairs: DataFrame, texts: DataFrame, n: int, threshold: float, weighted: bool) -> DataFrame:
    """The pairs (a, b) whose texts are similar.  ``texts``: one text a node."""
    named = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    return written(named.select("a", "b", "text_a", "text_b").mapInArrow(_similar(n, threshold, weighted), "a long, b long"), "links")


def _able(threshold: float):
    """The pairs (a, b) of two blocks that are of different classes and that both bounds leave open."""
    slack = (1 - threshold) / (1 + threshold)

    def columns(block: pa.Scalar) -> tuple[np.ndarray, ...]:
        x = block.values
        node, comp, total, reach = (x.field(k).to_numpy(zero_copy_only=False) for k in ("node", "comp", "total", "reach"))
        return node, comp, total, reach, x.field("parity").flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(len(node), PARITY_WORDS)

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[np.ndarray] = []
            for left, right in zip(batch.column("left"), batch.column("right"), strict=True):
                one, two = columns(left), columns(right)
                fine = (one[1][:, None] != two[1]) & (one[3][:, None] >= two[2]) & (two[3] >= one[2][:, None])
                i, j = np.nonzero(fine)
                near = np.bitwise_count(one[4][i] ^ two[4][j]).sum(1) <= slack * (one[2][i] + two[2][j]) + 1e-6
                pair = np.stack([one[0][i[near]], two[0][j[near]]], 1)
                found.append(np.sort(pair, 1))
            pairs = np.unique(np.concatenate(found), axis=0) if found else np.empty((0, 2), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    return run


def open_pairs(open_: DataFrame, threshold: float) -> DataFrame:
    """(a, b) of different classes in one bucket that the bounds leave open.

    ``open_``: (bucket, node, comp, total, reach, parity).  A class with more than BLOCK members in a bucket has blocks of
    its own, smaller classes share blocks; blocks of one and the same class do not meet.
    """
    of_class = open_.groupBy("bucket", "comp").agg(F.count("*").alias("n"))
    pooled = of_class.filter(F.col("n") <= BLOCK).groupBy("bucket").agg(F.sum("n").alias("pool"))
    sized = of_class.join(pooled, "bucket", "left")
    large = F.col("n") > BLOCK
    parts = F.ceil(F.when(large, F.col("n")).otherwise(F.col("pool")) / BLOCK)
    own = F.when(large, F.col("comp"))
    dealt = open_.join(sized, ["bucket", "comp"]).withColumns({"own": own, "part": F.pmod(F.xxhash64(F.when(large, F.col("node")).otherwise(F.col("comp"))), parts)})
    packed = written(dealt.groupBy("bucket", "own", "part").agg(F.collect_list(F.struct("node", "comp", "total", "reach", "parity")).alias("block")).withColumn("id", F.xxhash64("own", "part")), "blocks")
    left = packed.select("bucket", F.col("own").alias("own_a"), F.col("id").alias("id_a"), F.col("block").alias("left"))
    right = packed.select("bucket", F.col("own").alias("own_b"), F.col("id").alias("id_b"), F.col("block").alias("right"))
    met = left.join(right, "bucket").filter("id_a <= id_b AND (own_a IS NULL OR own_b IS NULL OR own_a <> own_b)")
    return met.select("left", "right").mapInArrow(_able(threshold), "a long, b long").distinct()


def classes(docs: DataFrame, n: int = SHINGLE, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, weighted: bool = True) -> DataFrame:
    """(node, comp) for every text that is linked to another; nodes are 64-bit hashes of texts."""
    named = docs.select("doc_id", "text", F.xxhash64("text").alias("node"))
    dealt = written(named.select("node", "text").mapInArrow(_banded(n, bands, rows, weighted), "bucket long, node long"), "bands")
    sizes = dealt.groupBy("bucket").agg(F.count("*").alias("size"), F.min("node").alias("low"), F.max("node").alias("high")).filter("low <> high").select("bucket", "size")
    live = written(dealt.join(sizes, "bucket").dropDuplicates(["bucket", "node"]), "live")
    discard(dealt)
    weight = live.groupBy("node").agg(F.sum("size").alias("degree"))
    hubs = live.join(weight, "node").groupBy("bucket").agg(F.max(F.struct("degree", "node"))["node"].alias("hub"))
    star = written(live.join(hubs, "bucket").filter("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct(), "pairs")
    needed = live.select("node").distinct()
    # One text a node: of its copies, the first in id order (nulls last); repeated rows are dropped on so few rows only.
    first = named.groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    wanted = first.join(needed, "node", "left_semi").withColumnRenamed("doc_id", "first_id").withColumnRenamed("node", "first_node")
    texts = written(named.join(wanted, (F.col("node") == F.col("first_node")) & F.col("doc_id").eqNullSafe(F.col("first_id"))).groupBy("node").agg(F.first("text").alias("text")), "texts")
    links = linked(star, texts, n, threshold, weighted)
    comp = components(links)
    open_ = written(_unsettled(live.select("bucket", "node").join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))), "open")
    if open_.isEmpty():
        return comp
    bounds = bounds_of(texts.join(open_.select("node").distinct(), "node", "left_semi"), n, threshold, weighted)
    bounded = open_.drop("size").join(bounds, "node")
    least = bounded.groupBy("bucket").agg(F.min("total").alias("least"))
    settled = written(_unsettled(bounded.join(least, "bucket").filter("reach >= least").drop("least")), "open")
    new = written(open_pairs(settled, threshold).join(star.union(star.select("b", "a")), ["a", "b"], "left_anti"), "pairs")
    found = linked(new, texts, n, threshold, weighted)
    for done in (open_, settled, bounds, new, star, live, texts):
        discard(done)
    return comp if found.isEmpty() else components(links.union(found))


def _unsettled(member: DataFrame) -> DataFrame:
    """The members of the buckets that hold more than one class, with how many there are."""
    sizes = member.groupBy("bucket").agg(F.count("*").alias("size"), F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low <> high").select("bucket", "size")
    return member.join(sizes, "bucket")


def _blank():
    return F.trim(F.translate(F.coalesce("text", F.lit("")), "\t\n\r\x0b\x0c", "     ")) == ""


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.xxhash64("text").alias("node"), _blank().alias("blank"))


def _nodes(docs: DataFrame, **options) -> DataFrame:
    """(node, first_id, copies, comp) of every text with words; a text without links is its own component."""
    nodes = _keyed(docs).filter("NOT blank").groupBy("node").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies"))
    return nodes.join(classes(docs, **options), "node", "left").withColumn("comp", F.coalesce("comp", "node"))


def grouped(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, node, class_id, class_size): every document with the smallest id of its class and how many rows are in it."""
    named, of = _keyed(docs), _nodes(docs, **options)
    named_classes = of.groupBy("comp").agg(F.min("first_id").alias("class_id"), F.sum("copies").alias("class_size"))
    known = of.select("node", "comp").join(named_classes, "comp").select("node", "class_id", "class_size")
    found = named.filter("NOT blank").join(known, "node").select("doc_id", "node", "class_id", "class_size")
    return found.union(named.filter("blank").select("doc_id", "node", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size")))


def representatives(docs: DataFrame, **options) -> DataFrame:
    """The documents of which one stays for each class, the one with its smallest id; all columns as they are."""
    row = docs.select("doc_id", "text", F.struct(*docs.columns).alias("row"))  # so that no column's name clashes
    first = _nodes(docs, **options).groupBy("comp").agg(F.min(F.struct(F.col("first_id").isNull().alias("none"), "first_id", "node")).alias("one")).select(F.col("one.node").alias("node"), F.col("one.first_id").alias("first_id"))
    keyed = row.select(F.xxhash64("text").alias("node"), "doc_id", "text", "row")
    kept = keyed.join(first.hint("shuffle_hash"), "node").filter(F.col("doc_id").eqNullSafe(F.col("first_id"))).dropDuplicates(["node", "doc_id"])
    return kept.select("row.*").union(keyed.filter(_blank()).select("row.*"))


def op7_near_dedup_dartminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouped(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size")
