"""Suffix-array dedup: bytes covered by a string of `length` bytes that also starts in an earlier document are taken out.

Suffixes matter to a depth of `length` bytes only. A difference cover of period 21 samples 5 of 21 positions, so that of any two equal strings of 50 bytes some
sampled positions stand at one distance from both starts, with 30 equal bytes from there. First the sample is ranked: its 30-byte strings are hashed, sorted
bucket by bucket, and only those of more than one document are kept. Suffixes none of whose sampled positions is among them tie with no other document and are
never sorted. The others go to suffix buckets, by the smallest hash of a 16-byte string in them, as pieces of text: equal strings share it. Buckets are sorted one
at a time: by their first and last bytes, and long ties by the ranks of a cover sample of period 7 inside the bucket (`earlier`). Memory is that of one block or bucket.

Copies of a piece in one block, and in one bucket, are sorted once; exact copies of a text are collapsed by a partial aggregate. So a passage of a third of all rows sends one row a block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lupaspark.llm.common import looked_up, written
from lupaspark.llm.rolling import WINDOW, rolling

LENGTH = 50
#: Difference covers: of every distance some two members have it, modulo the period.
PERIOD, COVER = 21, (0, 1, 6, 8, 18)
TIE_PERIOD, TIE_COVER = 7, (0, 1, 3)
#: Bytes of text in a block; sampled keys in a bucket of the sample, bytes of text for each suffix bucket.
BLOCK, KEYS, BUCKET = 4 << 20, 1 << 22, 8 << 20
#: Hashes of the sample have so many bits more than the input's bytes ask for: about one sampled position in 500 is kept by chance.
SPARE_BITS = 7
_PAD = b"\0" * 64
_LAST = (1 << 63) - 1
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]


def words_at(data: bytes, offset: int, step: int, n: int, kind: str = "<u8") -> np.ndarray:
    """Eight bytes at offset, offset + step, ... as numbers."""
    return np.ndarray((n,), kind, data, offset=offset, strides=(step,))


class Keys:
    """How strings of the cover sample are hashed and dealt: total is the bytes of all texts."""

    def __init__(self, total: int, length: int):
        self.width = length - PERIOD + 1
        bits = total.bit_length() + SPARE_BITS
        self.bucket_bits = max(4, (total * len(COVER) // PERIOD // KEYS).bit_length())
        self.rest = max(bits - self.bucket_bits, 16)
        self.kind = np.uint32 if self.rest <= 32 else np.uint64

    def sample(self, data: bytes, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(positions, keys, text numbers) of the sampled strings that lie within one of the texts that end at `ends`; data has _PAD behind."""
        total, places, keys = int(ends[-1]), [], []
        for r in COVER:
            n = max(0, (total - r - self.width) // PERIOD + 1)
            z = np.zeros(n, dtype=np.uint64)
            for k, mix in zip((*range(0, self.width - 8, 8), self.width - 8), [*_MIX, *_MIX]):
                z = (z ^ words_at(data, r + k, PERIOD, n)) * mix
                z ^= z >> np.uint64(29)
            places.append(np.arange(n, dtype=np.int64) * PERIOD + r)
            keys.append((z * _MIX[0]) >> np.uint64(64 - self.bucket_bits - self.rest))
        places, keys = np.concatenate(places), np.concatenate(keys)
        text = np.searchsorted(ends, places, side="right")
        within = places + self.width <= ends[text]
        return places[within], keys[within], text[within]

    def dealt(self, keys: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(bucket, what is left of its keys); keys are sorted."""
        bucket = (keys >> np.uint64(self.rest)).astype(np.int64)
        first = np.flatnonzero(np.diff(bucket, prepend=-1))
        low = (keys & np.uint64((1 << self.rest) - 1)).astype(self.kind)
        for i, j in zip(first.tolist(), [*first[1:].tolist(), len(keys)]):
            yield int(bucket[i]), low[i:j]


def owned_twice(keys: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct keys, whether a key has more than one owner)."""
    order = np.argsort(keys, kind="stable")
    keys, owners = keys[order], owners[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, dtype=np.int64)
    if not len(first):
        return keys, np.zeros(0, dtype=bool)
    return keys[first], np.minimum.reduceat(owners, first) != np.maximum.reduceat(owners, first)


def ranked(columns: list[np.ndarray]) -> np.ndarray:
    """Dense ranks of the rows of columns, the first column first."""
    order = np.lexsort(columns[::-1])
    new = np.zeros(len(order), dtype=bool)
    for c in columns:
        s = c[order]
        new[1:] |= s[1:] != s[:-1]
    ranks = np.empty(len(order), dtype=np.int64)
    ranks[order] = np.cumsum(new)
    return ranks


def earlier(texts: list[bytes], owners: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(first string of each text, found): of all strings of `length` bytes, text by text and by start, whether the same string stands in a text of a smaller owner.

    One suffix bucket. Starts are sorted by a number made of their first, middle and last 7 bytes; those alone with theirs are done. The others fall into blocks by
    their first and last 7 bytes. Two of one block, i and j, have a distance d at which both i + d and j + d are in the cover sample. Sampled strings of
    length - 6 bytes are ranked once; the two are equal if their block and the ranks at i + d and j + d are. So each start meets all its equals in the groups of three distances.
    """
    data, sizes = b"".join(texts) + _PAD, np.array([len(t) for t in texts], dtype=np.int64)
    begins = np.cumsum(sizes) - sizes
    counts = np.maximum(sizes - length + 1, 0)
    text = np.repeat(np.arange(len(texts)), counts)
    base = np.cumsum(counts) - counts
    start = np.arange(int(counts.sum()), dtype=np.int64) - base[text] + begins[text]
    found = np.zeros(len(start), dtype=bool)
    head = words_at(data, 0, 1, len(data) - 7, ">u8").astype(np.uint64) >> np.uint64(8)
    mixed = head[start] * _MIX[0] + head[start + length // 2] * _MIX[1] + head[start + length - 7] * _MIX[2]
    order = np.argsort(mixed, kind="stable")
    same = mixed[order[1:]] == mixed[order[:-1]]
    tied = order[np.concatenate((same, [False])) | np.concatenate(([False], same))] if len(order) else order
    at, owner = start[tied], owners[text[tied]]
    block = ranked([head[at], head[at + length - 7]])
    residue = at % TIE_PERIOD
    wanted = np.zeros(len(data), dtype=bool)
    distances = [(d, np.flatnonzero(np.isin((residue + d) % TIE_PERIOD, TIE_COVER))) for d in range(TIE_PERIOD)]
    for d, who in distances:
        wanted[at[who] + d] = True
    sampled, width = np.flatnonzero(wanted), length - TIE_PERIOD + 1
    rank = np.zeros(len(data), dtype=np.int64)
    rank[sampled] = ranked([words_at(data, k, 1, len(data) - 7 - k, ">u8")[sampled].astype(np.uint64) for k in (*range(0, width - 8, 8), width - 8)])
    least = owner.copy()
    for d, who in distances:
        key = (block[who] << 32) | rank[at[who] + d]
        order = np.argsort(key, kind="stable")
        new = np.diff(key[order], prepend=-1) != 0
        first = np.flatnonzero(new)
        if len(first):
            smallest = np.repeat(np.minimum.reduceat(owner[who[order]], first), np.diff(np.append(first, len(order))))
            least[who[order]] = np.minimum(least[who[order]], smallest)
    found[tied] = least < owner
    return base, found


def covered(base: np.ndarray, found: np.ndarray, length: int) -> dict[int, list[tuple[int, int]]]:
    """By text: runs of bytes, from and to, under the starts found; texts without any are left out."""
    begins = np.zeros(len(found) + 1, dtype=bool)
    begins[base] = begins[-1] = True  # a run ends with its text
    first = np.flatnonzero(found & (begins[:-1] | ~np.concatenate(([False], found[:-1]))))
    last = np.flatnonzero(found & (begins[1:] | ~np.concatenate((found[1:], [False]))))
    text = np.searchsorted(base, first, side="right") - 1
    out: dict[int, list[tuple[int, int]]] = {}
    for t, i, j in zip(text.tolist(), (first - base[text]).tolist(), (last - base[text] + length).tolist()):
        out.setdefault(t, []).append((i, j))
    return out


def candidates(places: np.ndarray, ends: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Runs of starts, from and to, whose strings lie within one text and have a sampled position of `places` in their first PERIOD bytes."""
    total = int(ends[-1])
    near = np.cumsum(np.bincount(np.maximum(places - PERIOD + 1, 0), minlength=total + 2) - np.bincount(places + 1, minlength=total + 2)) > 0
    begins = np.concatenate(([0], ends[:-1]))
    change = np.zeros(total + 2, dtype=np.int64)
    np.add.at(change, begins, 1)
    np.add.at(change, np.maximum(begins, ends - length + 1), -1)
    edges = np.flatnonzero(np.diff((near & (np.cumsum(change) > 0)).astype(np.int8), prepend=0, append=0))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


def least_hashes(data: np.ndarray, length: int) -> np.ndarray:
    """For each start: the hash (upper half) and place (lower half) of the smallest 16-byte string within `length` bytes; of equals the first."""
    h = rolling(data)[WINDOW - 1 :]
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B)
    h ^= h >> np.uint32(13)
    m = (h.astype(np.uint64) << np.uint64(32)) | np.arange(len(h), dtype=np.uint64)
    span, width = 1, length - WINDOW + 1
    while span * 2 <= width:
        m, span = np.minimum(m[:-span], m[span:]), span * 2
    return np.minimum(m[: len(m) - (width - span)], m[width - span :])


def pieces(data: bytes, runs: list[tuple[int, int]], length: int) -> Iterator[tuple[int, int, bytes]]:
    """(hash, place, text) of the pieces of the runs: neighbouring starts with one smallest string are a piece."""
    texts = [data[i : j - 1 + length] for i, j in runs]
    least = least_hashes(np.frombuffer(b"".join(texts), dtype=np.uint8), length)
    at = 0
    for (i, j), t in zip(runs, texts):
        own = least[at : at + j - i]
        at += len(t)
        cuts = (np.flatnonzero(own[1:] != own[:-1]) + 1).tolist()
        for a, b in zip([0, *cuts], [*cuts, j - i]):
            yield int(own[a]) >> 32, i + a, t[a : b - 1 + length]


def _ints(values, kind) -> bytes:
    return np.asarray(values, dtype=kind).tobytes()


def _blocks(texts: DataFrame) -> DataFrame:
    """texts(doc, text) as rows of about BLOCK bytes: (block, docs, sizes, data)."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, docs, held, size = TaskContext.get().partitionId() << 32, [], [], 0

        def row():
            return pa.record_batch([pa.array([block], pa.int64()), *[pa.array([x], pa.binary()) for x in (_ints(docs, np.int64), _ints([len(t) for t in held], np.int64), b"".join(held))]], names=["block", "docs", "sizes", "data"])

        for b in it:
            for d, t in zip(b.column(0).to_pylist(), b.column(1)):
                docs.append(d)
                held.append(t.as_py())
                size += len(held[-1])
                if size >= BLOCK:
                    yield row()
                    block, docs, held, size = block + 1, [], [], 0
        if docs:
            yield row()

    return texts.mapInArrow(batches, "block long, docs binary, sizes binary, data binary")


def _unpacked(b: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, bytes, int]]:
    """(block, docs, ends, data, row) of each row of a batch."""
    for k in range(b.num_rows):
        docs, sizes = (np.frombuffer(b.column(i)[k].as_py(), dtype=np.int64) for i in (1, 2))
        yield b.column(0)[k].as_py(), docs, np.cumsum(sizes), b.column(3)[k].as_py() + _PAD, k


def _sampled(blocks: DataFrame, keys: Keys) -> DataFrame:
    """(block, bucket, keys): the sampled strings of more than one document, for each block that has them."""

    def sample(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for block, docs, ends, data, _ in _unpacked(b):
                _, found, text = keys.sample(data, ends)
                found, twice = owned_twice(found, docs[text])
                found = np.repeat(found, 1 + twice)  # a key of several documents of the block stands twice
                rows = [(bucket, low.tobytes()) for bucket, low in keys.dealt(found)]
                if rows:
                    yield pa.record_batch([pa.array([r[0] for r in rows], pa.int64()), pa.array([block] * len(rows), pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["bucket", "block", "keys"])

    def repeated(group: pa.Table) -> pa.Table:
        each = [np.frombuffer(x.as_py(), dtype=keys.kind) for x in group.column("keys")]
        every, owner = np.concatenate(each), np.repeat(np.arange(len(each)), [len(x) for x in each])
        order = np.argsort(every, kind="stable")
        every, owner = every[order], owner[order]
        same = every[1:] == every[:-1]
        keep = np.concatenate((same, [False])) | np.concatenate(([False], same))
        every, owner = every[keep], owner[keep]
        order = np.argsort(owner, kind="stable")  # keys of one block stay sorted
        parts = np.split(every[order], np.searchsorted(owner[order], np.arange(1, len(each))))
        rows = [(block, np.unique(p).tobytes()) for block, p in zip(group.column("block").to_pylist(), parts) if len(p)]
        return pa.table([pa.array([r[0] for r in rows], pa.int64()), pa.array([group.column("bucket")[0].as_py()] * len(rows), pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["block", "bucket", "keys"])

    return blocks.mapInArrow(sample, "bucket long, block long, keys binary").groupBy("bucket").applyInArrow(repeated, "block long, bucket long, keys binary")


def _pieces(blocks: DataFrame, sampled: DataFrame, keys: Keys, length: int, buckets: int) -> DataFrame:
    """(bucket, block, docs, places, sizes, data): the pieces to be sorted; bucket -1 has those that repeat a piece of an earlier document of their block, without data."""
    found = sampled.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("bucket", "keys"))).alias("found"))  # no more than the block's own sample
    fields = ["bucket", "block", "docs", "places", "sizes", "data"]

    def row(block, bucket, each):
        blobs = (_ints([x[0] for x in each], np.int64), _ints([x[1] for x in each], np.int64), _ints([len(x[2]) for x in each], np.int64), b"" if bucket < 0 else b"".join([x[2] for x in each]))
        return (bucket, block, *blobs)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for block, docs, ends, data, k in _unpacked(b):
                known = np.concatenate([(np.uint64(x["bucket"]) << np.uint64(keys.rest)) | np.frombuffer(x["keys"], dtype=keys.kind).astype(np.uint64) for x in b.column(4)[k].as_py()])
                places, own, _ = keys.sample(data, ends)
                at = np.minimum(np.searchsorted(known, own), len(known) - 1)
                runs = candidates(places[known[at] == own], ends, length)
                if not runs:
                    continue
                texts = np.searchsorted(ends, [i for i, _ in runs], side="right")
                owner = {i: int(docs[t]) for (i, _), t in zip(runs, texts)}
                begins, least, every = sorted(owner), {}, []
                for h, place, t in pieces(data, runs, length):
                    every.append((h, place, t))
                of = np.searchsorted(begins, [p for _, p, _ in every], side="right") - 1
                every = [(owner[begins[o]], p, t, h) for o, (h, p, t) in zip(of.tolist(), every)]
                for d, _, t, _ in every:
                    if least.setdefault(t, d) > d:
                        least[t] = d
                dealt: dict[int, list] = {}
                for d, p, t, h in every:
                    dealt.setdefault(h % buckets if least[t] == d else -1, []).append((d, p, t))
                rows = [row(block, bucket, each) for bucket, each in dealt.items()]
                kinds = (pa.int64(), pa.int64(), *[pa.binary()] * 4)
                yield pa.record_batch([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=fields)

    return blocks.join(found, "block").select("block", "docs", "sizes", "data", "found").mapInArrow(batches, "bucket long, block long, docs binary, places binary, sizes binary, data binary")


def _removed(dealt: DataFrame, length: int) -> DataFrame:
    """(block, starts, stops): bytes to be taken out, places in the block."""

    def bucket(group: pa.Table) -> pa.Table:
        owners, places, texts, blocks = [], [], [], []
        for block, docs, at, sizes, data in zip(*[group.column(c).to_pylist() for c in ("block", "docs", "places", "sizes", "data")]):
            ends = np.cumsum(np.frombuffer(sizes, dtype=np.int64)).tolist()
            owners += np.frombuffer(docs, dtype=np.int64).tolist()
            places += np.frombuffer(at, dtype=np.int64).tolist()
            texts += [data[i:j] for i, j in zip([0, *ends], ends)]
            blocks += [block] * len(ends)
        least: dict[bytes, int] = {}
        for d, t in zip(owners, texts):
            if least.setdefault(t, d) > d:
                least[t] = d
        spans = covered(*earlier(list(least), np.fromiter(least.values(), dtype=np.int64, count=len(least)), length), length)
        number = {t: n for n, t in enumerate(least)}
        out: dict[int, tuple[list, list]] = {}
        for d, p, t, block in zip(owners, places, texts, blocks):
            for i, j in [(0, len(t))] if least[t] < d else spans.get(number[t], ()):
                starts, stops = out.setdefault(block, ([], []))
                starts.append(p + i)
                stops.append(p + j)
        return pa.table([pa.array(list(out), pa.int64()), pa.array([_ints(x[0], np.int64) for x in out.values()], pa.binary()), pa.array([_ints(x[1], np.int64) for x in out.values()], pa.binary())], names=["block", "starts", "stops"])

    def whole(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            places = [np.frombuffer(x.as_py(), dtype=np.int64) for x in b.column(1)]
            sizes = [np.frombuffer(x.as_py(), dtype=np.int64) for x in b.column(2)]
            yield pa.record_batch([b.column(0), b.column(1), pa.array([_ints(p + s, np.int64) for p, s in zip(places, sizes)], pa.binary())], names=["block", "starts", "stops"])

    schema = "block long, starts binary, stops binary"
    return dealt.where("bucket >= 0").groupBy("bucket").applyInArrow(bucket, schema).union(dealt.where("bucket < 0").select("block", "places", "sizes").mapInArrow(whole, schema))


def _left(blocks: DataFrame, removed: DataFrame) -> DataFrame:
    """(doc, digest, n_bytes, spans, kept) of each text."""
    spans = removed.groupBy("block").agg(F.collect_list("starts").alias("starts"), F.collect_list("stops").alias("stops"))  # no more than the block's own pieces
    schema = "doc long, digest binary, n_bytes long, spans array<struct<start: bigint, stop: bigint>>, kept binary"
    kinds = (pa.int64(), pa.binary(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])), pa.binary())

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for _, docs, ends, data, k in _unpacked(b):
                change = np.zeros(int(ends[-1]) + 1, dtype=np.int64)
                for column, sign in ((4, 1), (5, -1)):
                    for x in b.column(column)[k].as_py() or []:
                        np.add.at(change, np.frombuffer(x, dtype=np.int64), sign)
                gone, out = (np.cumsum(change) > 0).astype(np.int8), []
                for d, end, size in zip(docs.tolist(), ends.tolist(), np.diff(ends, prepend=0).tolist()):
                    begin = end - size
                    edges = np.flatnonzero(np.diff(gone[begin:end], prepend=0, append=0)).tolist()
                    keep = [0, *edges, size]
                    out.append((d, hashlib.sha256(data[begin:end]).digest(), size, [{"start": i, "stop": j} for i, j in zip(edges[::2], edges[1::2])], b"".join([data[begin + i : begin + j] for i, j in zip(keep[::2], keep[1::2])])))
                columns = list(zip(*out))
                yield pa.record_batch([pa.array(c, kind) for c, kind in zip(columns, kinds)], names=["doc", "digest", "n_bytes", "spans", "kept"])

    return blocks.join(spans, "block", "left").select("block", "docs", "sizes", "data", "starts", "stops").mapInArrow(batches, schema)


def _settled(df: DataFrame, tag: str) -> DataFrame:
    """Written, and the shuffle files of that job removed at once, as the table stands for them."""
    spark, name = df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        return written(df, tag)
    finally:
        spark.conf.set(name, before)


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """(doc_id, n_bytes, spans, kept) of every row: spans are the runs of bytes taken out of the text in UTF-8, kept what is left of it.

    A byte goes if a string of `length` bytes that covers it also starts in a document with a smaller doc_id; all is judged on the input. Null texts are empty. Texts under
    `length` bytes stay whole. A task's memory is some fifteen times the larger of BLOCK and the longest text. Rows without doc_id come after all others and are one document. Rows that repeat an id are one document, whose texts take nothing from each other.
    """
    assert length >= 2 * PERIOD, "the cover sample needs strings of twice its period"
    text = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)).alias("doc"), text.alias("text"))
    short = rows.where(F.length("text") < length).select("doc", F.length("text").cast("long").alias("n_bytes"), F.array().cast("array<struct<start: bigint, stop: bigint>>").alias("spans"), F.col("text").alias("kept"))
    long = rows.where(F.length("text") >= length)
    ids = _settled(long.select("doc", F.unhex(F.sha2("text", 256)).alias("digest"), F.length("text").cast("long").alias("n_bytes")), "digests")
    firsts = ids.groupBy("digest").agg(F.min("doc").alias("least"), F.count("*").alias("n")).where("n > 1")
    copies = _settled(looked_up(ids, firsts, ["digest"], "doc"), "copies")
    later = copies.where("doc > least").select("doc", "n_bytes", F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("stop"))).alias("spans"), F.lit(b"").alias("kept"))
    again = copies.where("doc = least").groupBy("doc", "digest").agg((F.count("*")).cast("int").alias("times")).where("times > 1")

    blocks = _settled(_blocks(long.groupBy("text").agg(F.min("doc").alias("doc")).select("doc", "text")), "blocks")
    total = int(ids.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0])
    keys = Keys(total, length)
    sampled = _settled(_sampled(blocks, keys), "sample")
    dealt = _settled(_pieces(blocks, sampled, keys, length, max(16, total // BUCKET)), "pieces")
    left = _left(blocks, _removed(dealt, length))
    if not again.isEmpty():  # a row for each row of a text that stands several times under its smallest id
        left = left.join(again, ["doc", "digest"], "left").withColumn("_", F.explode(F.array_repeat(F.lit(0), F.coalesce("times", F.lit(1))))).drop("_")
    out = left.select("doc", "n_bytes", "spans", "kept").unionByName(later).unionByName(short)
    return out.select(F.when(F.col("doc") < _LAST, F.col("doc")).alias("doc_id"), "n_bytes", "spans", "kept")
