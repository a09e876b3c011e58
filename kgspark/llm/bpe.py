"""Operator 10: byte-level BPE encoding and decoding by prefix-sharing trie traversal.

A text is cut into pre-tokens by the tokenizer's own pattern.  The distinct pre-tokens of a block of texts form a trie;
sorted, they are that trie laid out depth first, so walking them in order with a stack of prefix states visits every
node once.  The state of a node is the last token of its prefix's encoding: the one token t that is a suffix of the
prefix, encodes as itself, and is compatible with the last token of the prefix before it.  Two neighbouring tokens are
compatible when no merge across their border would have come before the merges that built them.  Encodings of shared
prefixes are so computed once, in time linear in the trie.

Null text: encoded as the empty text (no ids).  Special tokens in a text are ids of their own, as in the library.
Repeated rows: each gets its row.  Null ids stay null.  Very long texts are encoded in blocks, with the ids of the whole.
Columns besides doc_id and text are not read, so their names do not matter.  No documents: no rows.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from kgspark.llm.shared import table, text_pieces

PRETOKENS = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
#: Distinct pre-tokens a worker remembers, and characters it takes up at once: memory bounds only.
CACHE, BLOCK = 600_000, 2_000_000
#: Longer pre-tokens, in bytes, are encoded outside the trie: a state holds its whole encoding there.
LONG = 256
NEVER = 1 << 60


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies, as letter -> byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBpe:
    """A byte-level BPE vocabulary; encodes blocks of distinct pre-tokens through their trie."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        raw = {word: bytes(letters[c] for c in word) for word in spec["model"]["vocab"] if all(c in letters for c in word)}
        self.ids = {raw[word]: i for word, i in spec["model"]["vocab"].items() if word in raw}
        self.bytes = {i: word for word, i in self.ids.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes |= {i: word.encode() for word, i in self.special.items()}
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}  # id -> left, right, rank
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = (raw[x] for x in (pair.split(" ") if isinstance(pair, str) else pair))
            left, right, made = self.ids[a], self.ids[b], self.ids[a + b]
            self.rank[left, right] = rank
            self.parts.setdefault(made, (left, right, rank))
        # Every prefix of a token, with its id if it is one itself and -1 if not.
        self.prefixes = {word[:n]: -1 for word in self.ids for n in range(1, len(word))} | self.ids
        self.packed = {i: i.to_bytes(4, "little") for i in self.bytes}
        self.special_pattern = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.fits: dict[tuple[int, int], bool] = {}
        self.itself: dict[int, bool] = {}
        self.right_edge: dict[int, list[tuple[int, int]]] = {}
        self.left_edge: dict[int, list[tuple[int, int]]] = {}
        self.encoded: dict[str, bytes] = {}
        #: What a pre-token's ids decode to, where that is not the pre-token itself.
        self.altered: dict[str, bytes] = {}

    def edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """Tokens that stand at one border while the token is built, each with the rank of the merge that takes it up."""
        known = self.right_edge if side else self.left_edge
        if token not in known:
            found, until, at = [], NEVER, token
            while True:
                found.append((at, until))
                if at not in self.parts:
                    break
                until = self.parts[at][2]
                at = self.parts[at][side]
            known[token] = found
        return known[token]

    def compatible(self, left: int, right: int) -> bool:
        found = self.fits.get((left, right))
        if found is None:
            if len(self.fits) > 2_000_000:
                self.fits.clear()
            found = True
            for a, a_until in self.edge(left, 1):
                for b, b_until in self.edge(right, 0):
                    rank = self.rank.get((a, b), NEVER)
                    if rank < a_until and rank <= b_until and rank < NEVER:
                        found = False
            self.fits[left, right] = found
        return found

    def stands(self, token: int) -> bool:
        """Whether a token's own bytes encode as that token."""
        found = self.itself.get(token)
        if found is None:
            parts = self.parts.get(token)
            found = self.itself[token] = parts is None or (self.stands(parts[0]) and self.stands(parts[1]) and self.merged(self.bytes[token]) == [token])
        return found

    def merged(self, word: bytes) -> list[int]:
        """Plain merging, lowest rank and leftmost first; for single tokens only."""
        ids = [self.ids[word[i : i + 1]] for i in range(len(word))]
        while len(ids) > 1:
            rank, at = min((self.rank.get(pair, NEVER), i) for i, pair in enumerate(zip(ids, ids[1:], strict=False)))
            if rank == NEVER:
                break
            ids[at : at + 2] = [self.ids[self.bytes[ids[at]] + self.bytes[ids[at + 1]]]]
        return ids

    def learn(self, words: set[str]) -> None:
        """Encodes distinct pre-tokens: a depth-first walk of their trie, with one state per prefix on the stack.

        A state is the prefix's last token, its encoding, and the places where a token may have begun that goes on.
        """
        get, fits, compatible, stands, packed, whole = self.prefixes.get, self.fits, self.compatible, self.stands, self.packed, self.bytes
        before, last, encoding, begun = b"", [-1], [b""], [[]]
        for raw, word in sorted((word.encode("utf-8", "replace"), word) for word in words):
            if len(raw) > LONG:
                self.encoded[word] = self.walked(raw)
                continue
            shared, most = 0, min(len(raw), len(before))
            while shared < most and raw[shared] == before[shared]:
                shared += 1
            del last[shared + 1 :], encoding[shared + 1 :], begun[shared + 1 :]
            for end in range(shared + 1, len(raw) + 1):
                going, found = [], -1
                for start in (*begun[end - 1], end - 1):
                    token = get(raw[start:end])
                    if token is not None:
                        going.append(start)
                        if token >= 0 > found and stands(token):
                            if not start:
                                found, at = token, start
                            else:
                                fit = fits.get((last[start], token))
                                if fit or (fit is None and compatible(last[start], token)):
                                    found, at = token, start
                if found < 0:
                    raise ValueError(f"no token for {raw[:end]!r}")
                last.append(found)
                encoding.append(encoding[at] + packed[found])
                begun.append(going)
            before = raw
            ids = self.encoded[word] = encoding[-1]
            back = b"".join([whole[int.from_bytes(ids[i : i + 4], "little")] for i in range(0, len(ids), 4)])
            if back != raw:
                self.altered[word] = back

    def walked(self, raw: bytes) -> bytes:
        """A long pre-token by itself: the same states without a copy of the encoding in each, read from the end."""
        last, begun = [-1], []
        for end in range(1, len(raw) + 1):
            begun = [s for s in (*begun, end - 1) if raw[s:end] in self.prefixes]
            tokens = ((s, self.prefixes[raw[s:end]]) for s in begun)
            last.append(next(t for s, t in tokens if t >= 0 and self.stands(t) and (not s or self.compatible(last[s], t))))
        ids, at = [], len(raw)
        while at:
            ids.append(self.packed[last[at]])
            at -= len(self.bytes[last[at]])
        return b"".join(reversed(ids))

    def back(self, words: list[str]) -> bytes:
        """The bytes that the ids of these pre-tokens decode to."""
        if self.altered and not self.altered.keys().isdisjoint(words):
            return b"".join([self.altered.get(word) or word.encode() for word in words])
        return "".join(words).encode()

    def blocks(self, texts: list[str | None]) -> Iterator[tuple[int, list[str]]]:
        """(index of the text, its next pre-tokens); the words of a block are encoded before it is handed out."""
        held: list[tuple[int, list[str]]] = []
        size = 0

        def ready() -> Iterator[tuple[int, list[str]]]:
            if len(self.encoded) > CACHE:
                self.encoded.clear()
                self.altered.clear()
            for word, token in self.special.items():
                self.encoded[word] = self.packed[token]
            new: set[str] = set()
            for _, words in held:
                new.update(words)
            self.learn(new.difference(self.encoded))
            yield from held
            held.clear()

        for k, text in enumerate(texts):
            for part in self.special_pattern.split(text or "") if self.special_pattern else [text or ""]:
                if part in self.special:
                    held.append((k, [part]))
                    continue
                for piece in text_pieces(part):
                    if piece:
                        held.append((k, PRETOKENS.findall(piece)))
                        size += len(piece)
                        if size >= BLOCK:
                            yield from ready()
                            size = 0
        yield from ready()


_LOADED: dict[str, ByteBpe] = {}


def loaded(path: str) -> ByteBpe:
    """One vocabulary a Python worker; it and what it has learnt serve all tasks of that worker."""
    if path not in _LOADED:
        _LOADED[path] = ByteBpe(path)
    return _LOADED[path]


def encode_ids(path: str, texts: list[str | None]) -> Iterator[bytes]:
    """Each text's ids as little-endian unsigned 32-bit integers, in order."""
    bpe, parts, at = loaded(path), [], 0
    for k, words in bpe.blocks(texts):
        while at < k:
            yield b"".join(parts)
            parts, at = [], at + 1
        parts.append(b"".join(map(bpe.encoded.__getitem__, words)))
    while at < len(texts):
        yield b"".join(parts)
        parts, at = [], at + 1


def decode_ids(path: str, ids: bytes) -> str:
    bpe = loaded(path)
    return b"".join(bpe.bytes[int.from_bytes(ids[i : i + 4], "little")] for i in range(0, len(ids), 4)).decode("utf-8", "replace")


def _digests(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            counts = [0] * len(texts)
            ids, back = [hashlib.sha256() for _ in texts], [hashlib.sha256() for _ in texts]
            for k, words in bpe.blocks(texts):
                encoded = b"".join(map(bpe.encoded.__getitem__, words))
                counts[k] += len(encoded) // 4
                ids[k].update(encoded)
                back[k].update(bpe.back(words))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array([h.hexdigest() for h in ids]), pa.array([h.hexdigest() for h in back])],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return run


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids array<int>) of (doc_id, text)."""
    import numpy as np

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [np.frombuffer(ids, "<u4").astype(np.int32) for ids in encode_ids(path, batch.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of (doc_id, ids); a null list of ids decodes to the empty text."""
    import numpy as np

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [decode_ids(path, np.asarray(ids or [], "<u4").tobytes()) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """One row a document, repeated rows included: n_tokens and the digests of its ids and of the decoded text."""
    return docs.select("doc_id", "text").mapInArrow(_digests(path), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op10_bpe_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), default_path())
