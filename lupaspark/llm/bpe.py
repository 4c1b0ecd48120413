"""Byte-level BPE: whole pre-tokens by a minimal perfect hash, the others by a heap over linked bytes."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words and pre-tokens whose ids a Python worker remembers, and the most characters of one.
MEMO, MEMO_BYTES = 500_000, 64
#: Words of a text that are taken at a time.
PIECES = 1 << 16
_M1, _M2 = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
_U = (1 << 64) - 1


def read_ranks(path: str) -> list[bytes]:
    """Tokens by rank of a file with a base64 token and its rank in each line."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    tokens = [b""] * len(pairs)
    for token, rank in pairs:
        tokens[int(rank)] = base64.b64decode(token)
    return tokens


class PerfectHash:
    """Minimal perfect hash of distinct byte strings: one slot for each, in as many slots.

    A key's 64-bit hash names a bucket of about four keys; the bucket's pilot moves all of its keys to free slots. Buckets are placed by
    size, largest first; those of one key keep the slot itself, as -1 - slot.
    """

    def __init__(self, keys: list[bytes]) -> None:
        self.keys, self.n, self.m = keys, max(1, len(keys)), len(keys) // 4 + 1
        h = np.array([xxhash.xxh64_intdigest(k) for k in keys], dtype=np.uint64)
        assert len(np.unique(h)) == len(keys), "keys must be distinct"
        bucket = (h % np.uint64(self.m)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        sizes = np.bincount(bucket, minlength=self.m)
        begins = np.concatenate([[0], np.cumsum(sizes)])
        free, pilots = np.ones(self.n, dtype=bool), np.zeros(self.m, dtype=np.int64)
        self.slots = np.full(self.n, -1, dtype=np.int64)
        for b in np.argsort(-sizes, kind="stable"):
            own = order[begins[b] : begins[b + 1]]
            if len(own) < 2:
                break
            pilot = 0
            while True:
                tries = np.arange(pilot, pilot + 256, dtype=np.uint64)
                at = self._slot(h[own][None, :], tries[:, None])
                fits = free[at].all(axis=1)
                for row in np.flatnonzero(fits):
                    if len(set(at[row].tolist())) == len(own):
                        break
                else:
                    pilot += 256
                    continue
                pilots[b], self.slots[at[row]] = pilot + row, own
                free[at[row]] = False
                break
        left = iter(np.flatnonzero(free).tolist())
        for b in np.flatnonzero(sizes == 1):
            slot = next(left)
            pilots[b], self.slots[slot] = -1 - slot, order[begins[b]]
        self.pilots = pilots.tolist()
        self.slots = self.slots.tolist()

    def _slot(self, h: np.ndarray, pilot: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            mixed = (h ^ (pilot * np.uint64(_M1))) * np.uint64(_M2)
        return ((mixed >> np.uint64(32)) % np.uint64(self.n)).astype(np.int64)

    def get(self, key: bytes) -> int:
        """Index of key among the keys, -1 if it is none of them."""
        h = xxhash.xxh64_intdigest(key)
        pilot = self.pilots[h % self.m]
        slot = -1 - pilot if pilot < 0 else ((((h ^ (pilot * _M1 & _U)) * _M2) & _U) >> 32) % self.n
        at = self.slots[slot]
        return at if at >= 0 and self.keys[at] == key else -1


def pretokens(pattern: str) -> regex.Pattern:
    """The pattern with white space by its Unicode property, as the tiktoken library reads it."""
    return regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))


def _joined(words: list[str]) -> list[str]:
    """Words of a text split at spaces, put together again where a space lies beside other white space or an end of the text."""
    out = [[words[0]]]
    for w in words[1:]:
        last = out[-1][-1]
        if not w or not last or w[0].isspace() or last[-1].isspace():
            out[-1].append(w)
        else:
            out.append([w])
    return [" ".join(x) for x in out]


class Encoder:
    """Encodes and decodes with tokens by rank. The memo of pre-tokens is bounded and only saves time."""

    def __init__(self, tokens: list[bytes], pattern: str, hashed: PerfectHash | None = None) -> None:
        self.tokens, self.split = tokens, pretokens(pattern)
        self.whole = hashed or PerfectHash(tokens)
        self.bytes = np.array([len(t) for t in tokens], dtype=np.int64)
        self.packed = [i.to_bytes(4, "little") for i in range(len(tokens))]
        ranks = {t: i for i, t in enumerate(tokens)}
        self.single = [ranks[bytes([i])] for i in range(256)]
        #: Of two adjacent tokens whose bytes make a token, (left << 32 | right) -> that token.
        self.pairs = {(a << 32) | b: i for i, t in enumerate(tokens) for at in range(1, len(t)) if (a := ranks.get(t[:at])) is not None and (b := ranks.get(t[at:])) is not None}
        self.pieces: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}

    def merges(self, word: bytes) -> list[int]:
        """Ids of a pre-token that is no token: the lowest-ranked adjacent pair is merged again and again, the left one first."""
        n, pair = len(word), self.pairs.get
        single = self.single
        ids = [single[c] for c in word]  # of the part that starts at a byte
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))  # the parts beside it; after is 0 if no part starts here
        heap = [(r << 32) | i for i in range(n - 1) if (r := pair((ids[i] << 32) | ids[i + 1])) is not None]
        heapify(heap)
        while heap:
            top = heappop(heap)
            i, r = top & 0xFFFFFFFF, top >> 32
            j = after[i]
            if not 0 < j < n or pair((ids[i] << 32) | ids[j]) != r:
                continue  # a part has grown since
            k = after[j]
            ids[i], after[i], after[j] = r, k, 0
            if k < n:
                before[k] = i
                if (x := pair((r << 32) | ids[k])) is not None:
                    heappush(heap, (x << 32) | i)
            h = before[i]
            if h >= 0 and (x := pair((ids[h] << 32) | r)) is not None:
                heappush(heap, (x << 32) | h)
        out, i = [], 0
        while i < n:
            out.append(ids[i])
            i = after[i]
        return out

    def piece(self, token: str) -> bytes:
        """Ids of a pre-token as little-endian 32-bit integers."""
        out = self.pieces.get(token)
        if out is None:
            word, packed = token.encode("utf-8", "surrogatepass"), self.packed
            at = self.whole.get(word)
            out = packed[at] if at >= 0 else b"".join([packed[i] for i in self.merges(word)])
            if len(word) <= MEMO_BYTES:
                if len(self.pieces) >= MEMO:
                    self.pieces.clear()
                self.pieces[token] = out
        return out

    def chunk(self, text: str) -> bytes:
        """Ids of a part of a text that begins with its only outer white space, or of a whole text."""
        piece = self.piece
        if len(text) <= PIECES:
            out = b"".join([piece(w) for w in self.split.findall(text)])
        else:
            out = b"".join(piece(m.group()) for m in self.split.finditer(text))
        if len(text) <= MEMO_BYTES:
            if len(self.chunks) >= MEMO:
                self.chunks.clear()
            self.chunks[text] = out
        return out

    def encode(self, text: str) -> Iterator[bytes]:
        """Ids of the text, as little-endian 32-bit integers, in parts of a bounded number of words.

        A single space between two characters that are no white space always begins a pre-token, so what lies between such
        spaces can be encoded, and remembered, by itself. Other spaces stay within their part.
        """
        known, chunk = self.chunks.get, self.chunk
        words = text.split(" ")
        if any(not w or w[0].isspace() or w[-1].isspace() for w in words):
            words = _joined(words)
        for at in range(0, len(words), PIECES):
            part = words[at : at + PIECES]
            if at == 0:
                yield chunk(part[0])
                part = part[1:]
            yield b"".join([known(w) or chunk(w) for w in map(" ".__add__, part)])

    def decode(self, ids: bytes) -> bytes:
        tokens = self.tokens
        return b"".join([tokens[i] for i in np.frombuffer(ids, dtype="<u4").tolist()])


_encoders: dict[tuple, Encoder] = {}


def shared_encoder(spark: SparkSession, path: str, pattern: str):
    """Function that gives the encoder on an executor; a Python worker builds it once and keeps it for its later tasks.

    The driver reads the file and sends its tokens and their perfect hash: their size is the file's, whatever the input.
    """
    tokens = read_ranks(path)
    sent = spark.sparkContext.broadcast((tokens, PerfectHash(tokens)))
    key = (hashlib.sha256(b"\n".join(tokens)).hexdigest(), pattern)

    def get() -> Encoder:
        if key not in _encoders:
            _encoders[key] = Encoder(sent.value[0], pattern, sent.value[1])
        return _encoders[key]

    return get


def as_text(value: bytes | None) -> str:
    return (value or b"").decode("utf-8", "replace")


def digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row: its whole text encoded, and the ids decoded again. Null is empty."""
    encoder = shared_encoder(docs.sparkSession, path, pattern)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder()
        for b in it:
            counts, ids_of, decoded_of = [], [], []
            for t in b.column(1):
                n, ids, decoded = 0, hashlib.sha256(), hashlib.sha256()
                for part in e.encode(as_text(t.as_py())):
                    n += len(part) // 4
                    ids.update(part)
                    decoded.update(e.decode(part))
                counts.append(n)
                ids_of.append(ids.hexdigest())
                decoded_of.append(decoded.hexdigest())
            yield pa.record_batch([b.column(0), pa.array(counts, pa.int64()), pa.array(ids_of, pa.string()), pa.array(decoded_of, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return picked.mapInArrow(batches, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encoded(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) of every row. Null is empty."""
    encoder = shared_encoder(docs.sparkSession, path, pattern)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder()
        for b in it:
            for at in range(0, b.num_rows, 64):  # ids take more room than text
                ids = [np.frombuffer(b"".join(e.encode(as_text(t.as_py()))), dtype="<i4") for t in b.column(1)[at : at + 64]]
                yield pa.record_batch([b.column(0)[at : at + 64], pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return picked.mapInArrow(batches, "doc_id long, ids array<int>")


def decoded(ids: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, text) of (doc_id, ids): bytes that are no UTF-8 become the replacement character. Null ids give a null text."""
    encoder = shared_encoder(ids.sparkSession, path, pattern)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder()
        for b in it:
            texts = [None if x.as_py() is None else as_text(e.decode(np.array(x.as_py(), dtype="<u4").tobytes())) for x in b.column(1)]
            yield pa.record_batch([b.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return ids.select(F.col("doc_id").cast("long"), F.col("ids").cast("array<int>")).mapInArrow(batches, "doc_id long, text string")
