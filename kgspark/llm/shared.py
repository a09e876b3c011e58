"""What the corpus operators share: reading tables, written intermediate tables, words, hashes, driver-sized checks.

Words are maximal runs of anything but the six ASCII white-space characters (0x20, 0x09-0x0D); ``bytes.split()``
cuts at exactly those.  A null text is handled as an empty one everywhere.
"""

from __future__ import annotations

import atexit
import ctypes
import functools
import gc
import shutil
import tempfile
import uuid
import zipfile
import zlib
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Distinct words whose hashes a Python worker keeps; beyond that it starts anew (a memory bound, never a result).
WORD_CACHE = 400_000


def shipped(spark: SparkSession) -> SparkSession:
    """Sends this package to the Python workers once a session, so that they need not have it installed."""
    context = spark.sparkContext
    if getattr(context, "_kgspark_shipped", None) is None:
        folder, top = tempfile.mkdtemp(prefix="kgspark-"), Path(__file__).resolve().parents[2]
        atexit.register(shutil.rmtree, folder, ignore_errors=True)  # the driver serves the file as long as it lives
        with zipfile.ZipFile(f"{folder}/kgspark-package.zip", "w") as z:
            for path in sorted((top / "kgspark").rglob("*.py")):
                z.write(path, path.relative_to(top))
        context.addPyFile(f"{folder}/kgspark-package.zip")
        context._kgspark_shipped = True
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    shipped(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see: ``spark.checkpoint.dir``, or a temporary one of a local session without it."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='kgspark-')}"
        spark.sparkContext.setCheckpointDir(found)
    return found


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the session's JVM ends."""
    path = f"{shared_dir(spark)}/kgspark/{name}-{uuid.uuid4().hex}"
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: cuts the lineage, survives lost executors."""
    spark = shipped(df.sparkSession)
    path = scratch(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found._kgspark_path = path
    return found


def discard(df: DataFrame) -> None:
    """Deletes a table that ``written`` made, once nothing that is still to run reads it."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._kgspark_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def released() -> None:
    """Hands memory that is free in this process back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        return


def trimmed(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A task's function that releases its memory at the end, so that idle Python workers stay small."""

    @functools.wraps(run)
    def outer(batches: Iterator) -> Iterator:
        yield from run(batches)
        released()

    return outer


def lazily(column: pa.Array) -> Iterator:
    """The values of a column one by one: a batch of long texts is not copied as a whole."""
    return (x.as_py() for x in column)


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    """Whether crc32 of the id's decimal digits falls in that part; a null id counts as the empty text (crc32 0)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts == part


def crc_part(doc_id: int | None, parts: int) -> int:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % parts


class WordHashes(dict):
    """64-bit hashes of words, looked up at dictionary speed."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORD_CACHE:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer (splitmix64's finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64, at least n of each."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        size = max(1024, 1 << int(n - 1).bit_length())
        up, down = np.full(size, base, np.uint64), np.full(size, pow(base, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        have = _POWERS[base] = (np.cumprod(up), np.cumprod(down))
    return have


def gram_hashes(hashes: np.ndarray, n: int, base: int = _BASE) -> np.ndarray:
    """A hash of every n consecutive word hashes: differences of polynomial prefix sums modulo 2**64."""
    size = len(hashes) - n + 1
    if size <= 0:
        return np.empty(0, np.uint64)
    up, down = _powers(len(hashes), base)
    prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * up[: len(hashes)], dtype=np.uint64)])
    return mixed((prefix[n:] - prefix[:size]) * down[:size])


def span_hashes(hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Hashes of the spans [start, end) of a document's word hashes; the length is part of the hash."""
    up, down = _powers(len(hashes) + 1, base)
    prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * up[: len(hashes)], dtype=np.uint64)])
    return mixed((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def text_pieces(text: str, size: int = 1 << 20) -> Iterator[str]:
    """A long text in pieces that no word, and no run of white space, spans: each ends before a blank after a non-blank."""
    start, n = 0, len(text)
    while n - start > size:
        at = start + size
        while at < n and not (text[at] == " " and not text[at - 1].isspace()):
            at += 1
        yield text[start:at]
        start = at
    yield text[start:] if start else text


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
