"""Embedding near-duplicates: cross-polytope LSH after fast Hadamard rotations, multiprobe buckets, verified pairs."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lupaspark.llm.common import connected_components, looked_up, written

COSINE = 0.9
#: Tables (see tables_for), and buckets of each that a vector visits: its own and the next likeliest.
TABLES, PROBES = 12, 3
#: Members of a bucket that are compared at a time; a larger bucket is dealt out as pairs of blocks of so many.
BLOCK = 512
SEED = 1_700_001


def tables_for(parts: int) -> int:
    """Tables that keep the recall of pairs at the least cosine near 0.98 as hashes take more rotations: each rotation about halves the chance that two buckets agree."""
    return max(TABLES, math.ceil(14 * 1.9 ** (parts - 3)))


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows, whose length is a power of two, scaled to keep their norms."""
    n, d = x.shape
    h = 1
    while h < d:
        x = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(n, d)
        h *= 2
    return x / math.sqrt(d)


class CrossPolytope:
    """Buckets of unit vectors: a table rotates them `parts` times at random and takes the nearest signed axis of each rotation.

    A rotation is three rounds of random signs and a Hadamard transform. Probes replace the axis that is the least clear, by loss of
    the projection, with the next one.
    """

    def __init__(self, dim: int, parts: int, tables: int = TABLES, probes: int = PROBES) -> None:
        self.dim, self.parts, self.tables, self.probes = dim, parts, tables, probes
        self.width = 1 << max(2, (dim - 1).bit_length())
        rng = np.random.default_rng(SEED)
        self.signs = rng.choice([-1.0, 1.0], size=(tables, parts, 3, self.width))

    def buckets(self, unit: np.ndarray) -> np.ndarray:
        """(vector, table, probe): probe 0 is the vector's own bucket."""
        n = len(unit)
        x0 = np.zeros((n, self.width))
        x0[:, : self.dim] = unit
        out = np.zeros((n, self.tables, self.probes), dtype=np.int64)
        rows = np.arange(n)
        for t in range(self.tables):
            axis, loss, other = [], [], []
            for p in range(self.parts):
                x = x0
                for r in range(3):
                    x = hadamard(x * self.signs[t, p, r])
                top = np.argpartition(-np.abs(x), self.probes - 1, axis=1)[:, : self.probes] if self.probes > 1 else np.abs(x).argmax(axis=1)[:, None]
                size = np.take_along_axis(np.abs(x), top, axis=1)
                order = np.argsort(-size, axis=1, kind="stable")
                top, size = np.take_along_axis(top, order, axis=1), np.take_along_axis(size, order, axis=1)
                code = 2 * top + (np.take_along_axis(x, top, axis=1) < 0)
                axis.append(code[:, 0])
                other.append(code[:, 1:])
                loss.append(size[:, :1] - size[:, 1:])
            base = self._join(axis)
            out[:, t, 0] = base
            losses = np.concatenate(loss, axis=1)  # part by part, the next axes of each
            ranked = np.argsort(losses, axis=1, kind="stable")
            for k in range(1, self.probes):
                pick = ranked[:, k - 1]
                part, nth = pick // (self.probes - 1), pick % (self.probes - 1)
                codes = [np.where(part == p, other[p][rows, np.minimum(nth, self.probes - 2)], axis[p]) for p in range(self.parts)]
                out[:, t, k] = self._join(codes)
        return out

    def _join(self, codes: list[np.ndarray]) -> np.ndarray:
        out = np.zeros(len(codes[0]), dtype=np.int64)
        for c in codes:
            out = out * (2 * self.width) + c
        return out


def _spread(links: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[list[int], list[int]]:
    """Spanning links of the groups that a block pair's links make: each member with the smallest id of its group."""
    rows, cols = np.nonzero(links)
    if not len(rows):
        return [], []
    ids, where = np.unique(np.concatenate([a[rows], b[cols]]), return_inverse=True)
    u, v = where[: len(rows)], where[len(rows) :]
    least = np.arange(len(ids))
    while True:
        m = np.minimum(least[u], least[v])
        after = least.copy()
        np.minimum.at(after, u, m)
        np.minimum.at(after, v, m)
        after = after[after]
        if (after == least).all():
            break
        least = after
    far = np.flatnonzero(least != np.arange(len(ids)))
    return ids[far].tolist(), ids[least[far]].tolist()


def _counts(id_col: str, vec_col: str) -> Column:
    """Whether a row can have links: an id, and components that are finite and not all zero."""
    whole = F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & (F.size(vec_col) > 0) & whole & F.exists(vec_col, lambda x: x != 0), F.lit(False))


def _plain(vec_col: str) -> Column:
    return F.transform(F.col(vec_col).cast("array<double>"), lambda x: x + F.lit(0.0))  # one zero, not two


def distinct_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(rep, copies, embedding array<double>): equal vectors once, by smallest id; null, zero and non-finite ones are left out."""
    ok = vectors.where(_counts(id_col, vec_col))
    return ok.select(F.col(id_col).cast("long").alias("id"), _plain(vec_col).alias("embedding")).groupBy("embedding").agg(F.min("id").alias("rep"), F.countDistinct("id").alias("copies"))


def links(reps: DataFrame, cosine: float = COSINE, probes: int = PROBES) -> DataFrame:
    """(kind, a, b): counted links of distinct vectors (kind 0: rep a has b links to it or its copies) and links that span their groups (kind 1).

    Each vector is a member of its own bucket of each table and a guest of the buckets it probes; members meet members and
    guests. The hash has as many rotations as make about one bucket for each vector, and as many tables as they need. A pair meets in several buckets and
    counts in the first of them, which both vectors' codes tell. A bucket of many is split into pairs of blocks; only sums and
    spanning links leave a task, so that a large group never becomes a row for each of its pairs.
    """
    spark = reps.sparkSession
    # Vectors of different sizes never link; each size is hashed by itself.
    sizes = [(r[0], r[1]) for r in reps.groupBy(F.size("embedding").alias("d")).count().collect()]
    parts = {d: max(1, round(math.log(max(n, 2)) / math.log(2 * (1 << max(2, (d - 1).bit_length()))))) for d, n in sizes}

    tables_of = {d: tables_for(p) for d, p in parts.items()}

    def entries(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = {d: CrossPolytope(d, p, tables_of[d], probes) for d, p in parts.items()}
        for whole in it:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                lists = b.column(2).to_pylist()
                for d in sorted({len(v) for v in lists}):
                    rows = [i for i, v in enumerate(lists) if len(v) == d]
                    x = np.array([lists[i] for i in rows], dtype=np.float64)
                    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])  # by powers of two: cosines stay as they are
                    codes = hashes[d].buckets(x / np.linalg.norm(x, axis=1, keepdims=True))
                    tables = tables_of[d]
                    n, m = len(rows), tables * probes
                    names, seen = np.repeat(np.arange(tables), probes), np.tile(np.arange(probes), tables)
                    pick = np.repeat(np.arange(n), m)
                    yield pa.record_batch(
                        [
                            pa.array(np.full(n * m, d), pa.int32()), pa.array(np.tile(names, n), pa.int32()), pa.array(codes.reshape(-1)), pa.array(np.tile(seen > 0, n)),
                            pa.array(b.column(0).to_numpy()[rows][pick]), pa.array(b.column(1).to_numpy()[rows][pick]),
                            pa.array([x[i].tobytes() for i in range(n)]).take(pa.array(pick)), pa.array([codes[i].tobytes() for i in range(n)]).take(pa.array(pick)),
                        ],
                        names=["d", "t", "bucket", "guest", "rep", "copies", "x", "codes"],
                    )

    fields = "d int, t int, bucket long, guest boolean, rep long, copies long, x binary, codes binary"
    rows = reps.select("rep", "copies", "embedding").mapInArrow(entries, fields)
    bucket = ["d", "t", "bucket"]
    # Buckets with one vector hold no pair; large ones are split. Both are told from counts of keys alone.
    sizes_of = rows.groupBy(*bucket).agg(F.count("*").alias("n"), F.sum((~F.col("guest")).cast("int")).alias("own")).where("n > 1 and own > 0").withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    dealt = looked_up(rows, sizes_of.select(*bucket, "n", "blocks"), bucket, "rep").withColumn("block", F.pmod(F.xxhash64("rep", F.lit(1)), "blocks").cast("int"))
    # Block pair (i, j) with i <= j goes to one group; a block takes part in as many groups as there are blocks.
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = dealt.withColumn("other", other).select(*bucket, F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "guest", "rep", "copies", "x", "codes")
    group = [*bucket, "i", "j"]
    ordered = dealt.repartition(*[F.col(c) for c in group]).sortWithinPartitions(*group)

    def compare(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs(key: tuple, block: np.ndarray, guest: np.ndarray, rep: np.ndarray, copies: np.ndarray, packed: list, codes: list) -> tuple[list, list, list]:
            d, t, _, i, j = key
            first = np.flatnonzero(block == i)
            second = first if i == j else np.flatnonzero(block == j)
            if not len(first) or not len(second):
                return [], [], []
            x = np.frombuffer(b"".join(packed), dtype=np.float64).reshape(len(packed), d)
            unit = x / np.linalg.norm(x, axis=1, keepdims=True)
            close = unit[first] @ unit[second].T >= cosine - 1e-9
            close &= ~(guest[first][:, None] & guest[second][None, :]) & (rep[first][:, None] != rep[second][None, :])
            if i == j:
                close &= np.triu(np.ones(close.shape, dtype=bool), 1)
            r, c = np.nonzero(close)
            if not len(r):
                return [], [], []
            # In double precision from the given components, and only where the pair meets first.
            a, b = x[first[r]], x[second[c]]
            exact = (a * b).sum(axis=1) / np.sqrt((a * a).sum(axis=1) * (b * b).sum(axis=1)) >= cosine
            close[r[~exact], c[~exact]] = False
            r, c = r[exact], c[exact]
            code = np.frombuffer(b"".join(codes), dtype=np.int64).reshape(len(codes), tables_of[d], probes)
            earlier = np.zeros(len(r), dtype=bool)
            here = np.zeros(len(r), dtype=np.int64)
            for at in range(t + 1):
                p, q = code[first[r], at], code[second[c], at]
                if at < t:
                    earlier |= (p == q[:, :1]).any(axis=1) | (q == p[:, :1]).any(axis=1)
                else:  # in this table two vectors may meet in the bucket of each
                    own_p, own_q = p[:, 0], q[:, 0]
                    meets_p, meets_q = (q == own_p[:, None]).any(axis=1), (p == own_q[:, None]).any(axis=1)
                    smaller = np.where(meets_p & meets_q, np.minimum(own_p, own_q), np.where(meets_p, own_p, own_q))
                    here = smaller
            counts = ~earlier & (here == key[2])
            kinds, aa, bb = [], [], []
            for ids, weights in ((rep[first[r[counts]]], copies[second[c[counts]]]), (rep[second[c[counts]]], copies[first[r[counts]]])):
                u, where = np.unique(ids, return_inverse=True)
                s = np.bincount(where, weights=weights, minlength=len(u)).astype(np.int64) if len(u) else []
                kinds += [0] * len(u)
                aa += u.tolist()
                bb += list(map(int, s))
            far, least = _spread(close, rep[first], rep[second])
            return kinds + [1] * len(far), aa + far, bb + least

        held: list[pa.RecordBatch] = []
        now: tuple | None = None

        def done() -> pa.RecordBatch | None:
            t = pa.Table.from_batches(held).combine_chunks()
            got = pairs(now, *(t.column(k).to_numpy() for k in ("block", "guest", "rep", "copies")), t.column("x").to_pylist(), t.column("codes").to_pylist())
            return pa.record_batch([pa.array(got[0], pa.int32()), pa.array(got[1], pa.int64()), pa.array(got[2], pa.int64())], names=["kind", "a", "b"]) if got[0] else None

        for b in it:
            if not b.num_rows:
                continue
            keys = np.stack([b.column(b.schema.get_field_index(c)).to_numpy() for c in group], axis=1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            for lo, hi in zip(cuts, cuts[1:]):
                key = tuple(keys[lo].tolist())
                if now is not None and key != now:
                    if sum(x.num_rows for x in held) > 1 and (out := done()) is not None:
                        yield out
                    held = []
                now = key
                held.append(b.slice(lo, hi - lo))
        if held and sum(x.num_rows for x in held) > 1 and (out := done()) is not None:
            yield out

    return ordered.mapInArrow(compare, "kind int, a long, b long")


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row: how many other vectors lie within the cosine, and the smallest id reachable.

    Null, empty and zero vectors and those with null or non-finite components link with nothing. Equal vectors link with each other and share all links.
    Rows that repeat a vec_id with one vector are one vector; each is returned. A null vec_id links with nothing.
    """
    reps = written(distinct_vectors(vectors, id_col, vec_col), "vectors")
    found = written(links(reps, cosine), "vector-links")
    counts = found.where("kind = 0").groupBy("a").agg(F.sum("b").alias("n")).select(F.col("a").alias("rep"), "n")
    groups = connected_components(found.where("kind = 1").select("a", "b")).withColumnRenamed("node", "rep")
    name = [F.xxhash64("embedding").alias("h"), F.xxhash64(F.lit(7), "embedding").alias("g")]  # two hashes tell vectors apart
    told = reps.join(counts, "rep", "left").join(groups, "rep", "left").select(*name, F.col("copies").alias("n"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.when(_counts(id_col, vec_col), _plain(vec_col)).alias("embedding"))
    out = looked_up(rows.where("embedding is not null").select("vec_id", *name), written(told, "vectors-told"), ["h", "g"], "vec_id").select("vec_id", "n_links", "component_id")
    alone = rows.where("embedding is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = out.withColumn("n_links", F.col("n_links").cast("long")).unionByName(alone)
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))
