"""Importance resampling towards a target: documents are drawn by how much likelier their hashed n-grams are in the target than in the corpus.

A 256-byte table lower-cases A-Z and blanks separators in UTF-8, bytes.split gives the words, CRC-32 is carried on from a word to the next
for longer n-grams, and Counters of at most `buckets` keys add up what a task has read, so that a shuffle gets one row for each bucket and task.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lupaspark.llm.common import written

ORDER, BUCKETS, SEED, LEAST_WORDS, PERCENT = 1, 10_000, 2024, 20, 10
#: Digits, letters (lower-cased) and all bytes beyond ASCII stay; others are blanks.
TABLE = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))
#: Bytes translated at a time: words of a text of any length take bounded memory.
BLOCK = 1 << 20
_DRAWN = "doc_id long, n_features long, n_words long, weight long, score long"


def words(text: bytes, block: int = BLOCK) -> Iterator[list[bytes]]:
    """The words, in lists; a word that a block's end cuts goes to the next list."""
    rest = b""
    for at in range(0, len(text), block):
        part = rest + text[at : at + block].translate(TABLE)
        cut = len(part) if at + block >= len(text) else part.rfind(b" ") + 1
        rest = part[cut:]
        yield part[:cut].split()


def features(text: bytes, order: int = ORDER, block: int = BLOCK) -> tuple[int, int, Counter]:
    """(words, features, Counter of the CRC-32 of the n-grams of 1 to order words)."""
    n_words, counts, tail = 0, Counter(), []
    for part in words(text, block):
        n_words += len(part)
        old = len(tail)  # words whose shorter n-grams are counted already
        run = tail + part
        hashes = [crc32(w) for w in run]
        counts.update(hashes[old:])
        spaced = [b" " + w for w in run] if order > 1 else []
        for k in range(1, order):
            hashes = list(map(crc32, spaced[k:], hashes))
            counts.update(hashes[max(0, old - k) :])
        tail = run[max(0, len(run) - order + 1) :] if order > 1 else []
    return n_words, sum(max(0, n_words - k) for k in range(order)), counts


def bucket_counts(texts: DataFrame, text_col: str, order: int = ORDER, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n) over all texts; null texts have no words."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for b in it:
            for t in b.column(0):
                for h, n in features(t.as_py() or b"", order)[2].items():
                    total[h % buckets] += n
        yield pa.record_batch([pa.array(list(total), pa.int32()), pa.array(list(total.values()), pa.int64())], names=["bucket", "n"])

    return texts.select(F.col(text_col).cast("binary").alias("text")).mapInArrow(batches, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: dict[int, int], target: dict[int, int], buckets: int = BUCKETS) -> list[int]:
    """floor(1000 ln ratio) of each bucket, counts smoothed by one."""
    s_all, t_all = sum(source.values()), sum(target.values())
    return [math.floor(1000 * math.log(float(target.get(b, 0) + 1) * float(s_all + buckets) / (float(source.get(b, 0) + 1) * float(t_all + buckets)))) for b in range(buckets)]


def noise(doc_id: int, seed: int = SEED) -> int:
    """A Gumbel number of the id, in thousandths."""
    h = int.from_bytes(hashlib.sha256(f"{seed}:{doc_id}".encode()).digest()[:4], "big")
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weighted(docs: DataFrame, gain: list[int], id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, seed: int = SEED) -> DataFrame:
    """(doc_id, n_features, n_words, weight, score) of every row. gain: of each bucket; its size is the parameter `buckets`, whatever the input."""
    sent = docs.sparkSession.sparkContext.broadcast(gain)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = sent.value
        buckets = len(gain)
        for b in it:
            out = []
            for i, t in zip(b.column(0).to_pylist(), b.column(1)):
                n_words, n_features, counts = features(t.as_py() or b"", order)
                weight = sum([gain[h % buckets] * n for h, n in counts.items()])
                out.append((i, n_features, n_words, weight, None if i is None else weight + noise(i, seed)))
            columns = list(zip(*out)) or [()] * 5
            yield pa.record_batch([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "n_features", "n_words", "weight", "score"])

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return picked.mapInArrow(batches, _DRAWN)


def numbered(rows: DataFrame, order: list) -> DataFrame:
    """rows with `rank`: 1, 2, 3... over the whole table in the given order, whose keys should tell rows apart.

    Ranges of the order are dealt to tasks, sorted there and written with their places; a place becomes a rank by the sizes of the
    ranges before it, one row for each range. No task sees all rows.
    """
    place = F.monotonically_increasing_id()
    ranges = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).select("*", F.shiftright(place, 33).cast("int").alias("_range"), place.bitwiseAND(F.lit((1 << 33) - 1)).alias("_at")), "ranges")
    before = F.coalesce(F.sum("n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = ranges.groupBy("_range").agg(F.count("*").alias("n")).select("_range", before.alias("_before"))
    return ranges.join(F.broadcast(sizes), "_range").withColumn("rank", F.col("_before") + F.col("_at") + 1).drop("_range", "_at", "_before")


def drawn(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", order: int = ORDER, buckets: int = BUCKETS, seed: int = SEED, least_words: int = LEAST_WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row; rank is null for rows that are not drawn.

    Of the N rows with at least least_words words, floor(percent * N / 100) are drawn by score, which is Gumbel top-k: without replacement, in proportion to
    the weights. Null texts have no words. Rows without doc_id count for the corpus and have a weight, but no score, and are not among the N. Ties go to the smaller
    doc_id; rows that repeat an id each have a place, in the order of weight and features. Empty tables give gains of zero or of smoothing alone.
    """
    counts = lambda df, col: {r.bucket: r.n for r in bucket_counts(df, col, order, buckets).collect()}  # noqa: E731  at most `buckets` rows
    gain = gains(counts(docs, text_col), counts(target, target_col), buckets)
    rows = written(weighted(docs, gain, id_col, text_col, order, seed), "weights")
    eligible = (F.col("n_words") >= least_words) & F.col("doc_id").isNotNull()
    k = rows.where(eligible).count() * percent // 100
    ranked = numbered(rows.where(eligible), [F.desc("score"), F.asc("doc_id"), F.asc("weight"), F.asc("n_features")])
    rank = F.when(F.col("rank") <= k, F.col("rank")).alias("rank")
    rest = rows.where(~eligible).select("doc_id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank"))
    return ranked.select("doc_id", "n_features", "weight", "score", rank).unionByName(rest)
