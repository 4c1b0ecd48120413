"""SimHash near-duplicates by multi-index hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lupaspark.llm.common import connected_components, looked_up, quoted, written

SEED = 42
SHINGLE_WORDS = 3
MAX_BITS = 2
SEGMENTS = 4
SEGMENT_BITS = 64 // SEGMENTS
#: Shingles whose bits are added up at a time: memory stays the same for a text of any length.
CHUNK = 1 << 15


def fingerprint(text: bytes, words: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """A bit is 1 if it is set in over half of the shingles' XXH64; fewer words make one shingle, none give zero."""
    tokens = text.lower().split()
    if not tokens:
        return 0
    line = b" ".join(tokens)
    ends = np.cumsum([len(t) + 1 for t in tokens]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    ends = ends.tolist()
    width = min(words, len(tokens))
    n = len(tokens) - width + 1
    digest, totals = xxhash.xxh64_digest, np.zeros(64, dtype=np.int64)
    for at in range(0, n, CHUNK):
        stop = min(n, at + CHUNK)
        joined = b"".join([digest(line[a:b], seed) for a, b in zip(starts[at:stop], ends[at + width - 1 : stop + width - 1])])
        bits = np.unpackbits(np.frombuffer(joined, dtype=np.uint8).reshape(-1, 8), axis=1)
        totals += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(totals * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): fp is the fingerprint's 64 bits as a signed long. Null texts count as empty."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            fps = np.fromiter((fingerprint(t.as_py() or b"") for t in b.column(1)), dtype=np.uint64, count=b.num_rows)
            yield pa.record_batch([b.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return picked.mapInArrow(batches, "doc_id long, fp long")


def _segment_mask(segment: int) -> int:
    return ((1 << SEGMENT_BITS) - 1) << (SEGMENT_BITS * segment)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(reps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Pairs (a, b) of rep ids whose fingerprints differ in at most 2 bits; reps(rep, fp) has each fp once.

    Table j of the index is keyed by the fingerprint without its segment j. Two fingerprints that differ in one
    segment only meet under the key that leaves it out. Differences in two segments i < j are one bit each: they meet
    in table j once the ball of radius 1 around segment i is enumerated, and one side suffices, that which
    has the bit set. Every key fixes 48 bits, so a group of near copies spreads over many keys.
    """
    assert max_bits == 2, "the tables are laid out for two bits"
    keys = [F.struct(F.lit(j).alias("j"), F.col("fp").bitwiseAND(F.lit(_signed(~_segment_mask(j) & (2**64 - 1)))).alias("key")) for j in range(SEGMENTS)]
    index = reps.select("rep", "fp", F.explode(F.array(*keys)).alias("k")).select("rep", "fp", "k.j", "k.key")
    flips = [(j, 1 << bit, ~_segment_mask(j) & (2**64 - 1)) for i in range(SEGMENTS) for j in range(i + 1, SEGMENTS) for bit in range(SEGMENT_BITS * i, SEGMENT_BITS * (i + 1))]
    ball = F.array(*[F.struct(F.lit(j).alias("j"), F.lit(_signed(bit)).alias("bit"), F.lit(_signed(mask)).alias("mask")) for j, bit, mask in flips])
    near = (
        reps.select("rep", "fp", F.explode(F.filter(ball, lambda x: F.col("fp").bitwiseAND(x["bit"]) != 0)).alias("x"))
        .select("rep", "fp", "x.j", F.col("fp").bitwiseXOR(F.col("x.bit")).bitwiseAND(F.col("x.mask")).alias("key"), F.lit(True).alias("flipped"))
    )
    probes = near.unionByName(index.withColumn("flipped", F.lit(False)))
    a, b = index.alias("a"), probes.alias("b")
    return a.join(
        b,
        (F.col("a.j") == F.col("b.j"))
        & (F.col("a.key") == F.col("b.key"))
        & (F.col("b.flipped") | (F.col("a.fp") < F.col("b.fp")))
        & (F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= max_bits),
    ).select(F.col("a.rep").alias("a"), F.col("b.rep").alias("b"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row: groups that links of at most 2 differing bits connect.

    Exact copies share a fingerprint and are one node. Null and blank texts have fingerprint zero and are linked
    like any other. Rows that repeat a doc_id are returned each, and count as one node. A null doc_id
    names no group: such a row takes the group of its fingerprint, null if it has no other row.
    """
    fps = written(fingerprints(docs, id_col, text_col), "fingerprints")
    reps = fps.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n"))
    groups = connected_components(links(reps.where("rep is not null")))
    by_fp = reps.join(groups, reps.rep == groups.node, "left").select("fp", "n", F.coalesce("component", "rep").alias("component_id"))
    return looked_up(fps, by_fp, ["fp"], "doc_id").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def deduplicated(docs: DataFrame) -> DataFrame:
    """The documents with one kept of each group, that with the smallest doc_id; columns as in docs.

    Rows that repeat the kept doc_id stay with it; rows without doc_id stay.
    """
    gone = near_duplicates(docs).where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*[quoted(c) for c in docs.columns])
