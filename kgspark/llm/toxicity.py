"""Operator 9: toxicity by compression distance.

Two zstandard dictionaries are trained, one on windows of ordinary documents and one on windows of toxic documents.  A
text is cut into windows of WINDOW words, and each is compressed with the ordinary dictionary alone and with both; the
bytes that the toxic one saves are the window's distance.  A document's score is a logistic function, calibrated on
labelled documents, of how many of its windows save how many bytes (at the thresholds STEPS), the most that one saves,
their mean, and the document's length.

Words enter the compressor as codes, not letters: six bytes for the hash of a word, eight for that of its first six letters
and ten for that of its first four.  Chance substrings then never match, a word or a stem matches as a whole, and a short
insult is worth as many bytes as a long one: with letters it costs no more as literals than as a match (with letters,
held-out recall of toxic documents was below 0.12 with every setting tried; with codes it is 0.84 to 0.91 there).

Most windows of a toxic document are ordinary.  So the toxic dictionary is trained in ROUNDS: first on all windows of toxic
documents, then again on those that saved at least KEPT bytes with the dictionary before.  The ordinary one is completed by
windows among CHECKED ordinary ones on which the toxic one would still save bytes.  Exact copies of a text train once.  Training windows are the TRAINING ones of each kind with the smallest hashes, from the labelled sample of at
most FIT_ROWS documents (``supervised``); calibration and scores use every window of a whole text.

Null or empty text: no window, and the score that the calibration gives to that.  No labels, or only one kind of label:
the score is the share of toxic labels (0 without labels).  Repeated rows: each gets its row.  Very long texts: their
windows are taken one by one.  Further columns are carried along whatever their names; the caller names the score.
Too few windows to train on: the dictionary is the windows themselves.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgspark.llm.shared import held_out, lazily, released, table, trimmed
from kgspark.llm.supervised import FIT_ROWS, labelled_sample, logistic, sigmoid

PARTS, TEST_PART, THRESHOLD = 5, 0, 0.5
WINDOW = 12
#: Bytes of the codes of a word, of its first six and of its first four letters.
WORD_BYTES, STEMS = 6, ((6, 8), (4, 10))
ORDINARY, TOXIC = 49_152, 8_192
TRAINING, ROUNDS, KEPT = 60_000, 3, 5
#: Binary logarithm of the trainer's table of frequencies (six bytes each).
FREQUENCIES = 22
FILLERS = 6
#: Ordinary windows that the toxic dictionary must save nothing on.
CHECKED = 500
STEPS = (3, 6, 10, 14)
CODES = 200_000
EDGES = ".,;:!?|#$%&*\"'()[]{}<>=-_/\\+~`^@"


def words_of(text: str | None) -> list[str]:
    """Lower-case words without the punctuation around them."""
    return [w for w in (x.strip(EDGES) for x in (text or "").lower().split()) if w]


class Codes(dict):
    """The code of a word: its hash, then those of its stems, the longest first, so that what matches is the longest part known."""

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CODES:
            self.clear()
        found = self[word] = xxhash.xxh3_128_digest(f"w:{word}")[:WORD_BYTES] + b"".join([xxhash.xxh3_128_digest(f"{n}:{word[:n]}")[:size] for n, size in STEMS])
        return found


STEP = WINDOW * (WORD_BYTES + sum(size for _, size in STEMS))


@dataclass
class Model:
    ordinary: bytes
    toxic: bytes
    weights: list[float]
    share: float


def compressor(content: bytes):
    params = zstandard.ZstdCompressionParameters(window_log=18, hash_log=17, chain_log=18, search_log=2, min_match=4, strategy=zstandard.STRATEGY_LAZY, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_checksum=0, write_dict_id=0)
    dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    dictionary.precompute_compress(compression_params=params)
    return zstandard.ZstdCompressor(compression_params=params, dict_data=dictionary).compress


_READY: dict[tuple[bytes, bytes], tuple] = {}
_CODES = Codes()


def windows(words: list[str]) -> Iterator[bytes]:
    for i in range(0, len(words), WINDOW):
        yield b"".join(map(_CODES.__getitem__, words[i : i + WINDOW]))


def savings(ordinary: bytes, toxic: bytes, coded: Iterable[bytes]) -> np.ndarray:
    """Bytes that the toxic dictionary saves on each window."""
    if (ordinary, toxic) not in _READY:
        _READY.clear()
        _READY[ordinary, toxic] = (compressor(ordinary), compressor(ordinary + toxic))
    plain, both = _READY[ordinary, toxic]
    return np.array([len(plain(x)) - len(both(x)) for x in coded], np.int64)


def features(model: Model, text: str | None) -> tuple[float, ...]:
    words = words_of(text)
    saved = savings(model.ordinary, model.toxic, windows(words)) if words else np.zeros(1, np.int64)
    reached = [(saved >= step) for step in STEPS]
    return (1.0, *(np.log1p(x.sum()) for x in reached), *(10 * x.mean() for x in reached), min(saved.max(), 30) / 10, np.clip(saved, 0, 99).mean() / 2, saved.mean() / 2, np.log1p(max(len(words), 1)) / 10)


@trimmed
def _training_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(label, hash, words) of every window."""
    for batch in batches:
        texts = batch.column("text")
        for k, label in enumerate(batch.column("label").to_pylist()):
            words = words_of(texts[k].as_py())
            found = [" ".join(words[i : i + WINDOW]) for i in range(0, len(words), WINDOW)]
            hashes = [xxhash.xxh3_64_intdigest(f"{i}:{x}") >> 1 for i, x in enumerate(found)]
            yield pa.RecordBatch.from_arrays([pa.array([label] * len(found), pa.int32()), pa.array(hashes, pa.int64()), pa.array(found, pa.string())], names=["label", "hash", "words"])


def filler(size: int, coded: list[bytes]) -> list[bytes]:
    """Samples that the trainer takes its first picks from.

    It fills a dictionary from the end with its best picks, one from each stretch of the samples in turn, and then cuts the end
    off to make room for a header.  So that the header costs no word, the first FILLERS stretches hold nothing but one
    pattern each.
    """
    word = STEP // WINDOW
    stretch = sum(map(len, coded)) // max(1, size // word // 4)
    return [xxhash.xxh3_128_digest(f"filler {i}").ljust(word, b"\xff") * WINDOW for i in range(FILLERS) for _ in range(max(stretch, 10 * word) // STEP + 1)]


def trained(size: int, coded: list[bytes]) -> bytes:
    """A dictionary trained on these windows."""
    try:
        return zstandard.train_dictionary(size, filler(size, coded) + coded, k=STEP // WINDOW, d=8, f=FREQUENCIES).as_bytes()
    except zstandard.ZstdError:  # too few windows to train on
        return b"".join(coded)[-size:]


def completed(plain: bytes, toxic: bytes, ordinary: list[bytes]) -> bytes:
    """The ordinary dictionary with those of some ordinary windows in front that the toxic one would save bytes on."""
    hard, added = ordinary[:CHECKED], b""
    while len(added) < ORDINARY:
        hard = [x for x, saved in zip(hard, savings(added + plain, toxic, hard), strict=True) if saved >= KEPT]
        if not hard:
            break
        added += hard.pop(0)
    return added + plain


def dictionaries(ordinary: list[bytes], toxic: list[bytes]) -> tuple[bytes, bytes]:
    plain, kept, content = trained(ORDINARY, ordinary), toxic, b""
    for _ in range(ROUNDS):
        content = trained(TOXIC, kept)
        kept = [x for x, saved in zip(toxic, savings(plain, content, toxic), strict=True) if saved >= KEPT]
        if not kept:
            break
    return completed(plain, content, ordinary), content


def fit(docs: DataFrame, labels: DataFrame, parts: int = PARTS, part: int = TEST_PART, rows: int = FIT_ROWS) -> Model:
    sample = labelled_sample(docs, labels, "toxic", parts, part, rows).persist()
    n = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    if len(n) < 2:
        sample.unpersist()
        return Model(b"", b"", [], 1.0 if 1 in n else 0.0)
    found = sample.groupBy(F.xxhash64("text")).agg(F.max_by("text", "label").alias("text"), F.max("label").alias("label")).mapInArrow(_training_windows, "label int, hash long, words string")
    kinds: list[list[bytes]] = []
    for label in (0, 1):
        chosen = found.filter(F.col("label") == label).orderBy("hash", "words").limit(TRAINING).select("words").toArrow()  # a bound that is a parameter
        kinds.append([b"".join(map(_CODES.__getitem__, words.split(" "))) for words in lazily(chosen.column("words"))])
    model = Model(*dictionaries(*kinds), [], n[1] / (n[0] + n[1]))
    del kinds, chosen
    _CODES.clear()
    _READY.clear()
    released()

    @trimmed
    def measured(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"x": [list(features(model, t)) for t in frame["text"]], "label": frame["label"]})

    rows_ = sample.select("text", "label").mapInPandas(measured, "x array<double>, label int").collect()  # at most ``rows`` short rows
    sample.unpersist()
    x, y = np.array([r["x"] for r in rows_]), np.array([r["label"] for r in rows_], float)
    model.weights = logistic(x, y, 1.0).tolist()
    return model


def scores(model: Model, texts: Iterable[str | None], n: int) -> list[float]:
    if not model.weights:
        return [model.share] * n
    return sigmoid(np.array([features(model, t) for t in texts], float).reshape(-1, len(model.weights)) @ np.array(model.weights)).tolist()


def with_score(docs: DataFrame, model: Model, columns: list[str], name: str = "score") -> DataFrame:
    """The given columns of the documents and a score."""

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(scores(model, lazily(batch.column("text")), batch.num_rows), pa.float64())], names=[*columns, name])
        _CODES.clear()

    schema = docs.select(*columns).schema.add(name, "double")
    return docs.select(*dict.fromkeys([*columns, "text"])).mapInArrow(run, schema)


def op9_toxicity_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = with_score(docs, fit(docs, table(spark, sf_dir, "labels")), ["doc_id"])
    return found.select("doc_id", held_out(F.col("doc_id"), PARTS, TEST_PART).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
