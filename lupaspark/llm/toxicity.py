"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over a block-max inverted index."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lupaspark.llm.common import written
from lupaspark.llm.simhash import fingerprint

#: Bound of what the classifier is fitted on: labelled rows of each label. All their terms are indexed.
MAX_EXAMPLES = 500
#: A term's weight grows with the likelihood ratio of its association with the label, from LEAST to 1; half of that is reached at HALF.
LEAST, HALF = 0.02, 24.0
#: Examples whose fingerprints differ in so few bits count once in the likelihood ratio.
COPY_BITS = 3
NEIGHBOURS, BLOCK, FIRST_BLOCKS = 15, 64, 4
#: A term of more than one in so many examples keeps its postings as a row of a table, most of which is filled.
LONG = 24
THRESHOLD = 0.3
FOLDS, HELD_OUT = 4, 2
#: Word beginnings count as terms too: inflected forms share them.
PREFIXES = (5, 6)
#: Words, and texts' scores, that a Python worker remembers.
MEMO, TEXTS = 300_000, 20_000
_TRIM = ".,;:!?\"'()[]{}<>|*#%&-_/\\"


def words_of(text: bytes | None) -> list[str]:
    return (text or b"").decode("utf-8", "replace").lower().split()


def terms_of(word: str) -> list[str]:
    word = word.strip(_TRIM)
    return [word, *(f"{word[:n]}*" for n in PREFIXES if len(word) > n)] if word else []


def fold(id_col: str) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS


def hashed(term: str) -> int:
    """A term's name: 64 bits, signed."""
    x = xxhash.xxh64_intdigest(term)
    return x - (1 << 64) if x >> 63 else x


def ranges(starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of the ranges start:stop, one after another, and how many each range has."""
    n = stops - starts
    return np.repeat(starts - (np.cumsum(n) - n), n) + np.arange(int(n.sum())), n


class Terms:
    """Counts of terms in texts; with a vocabulary (sorted names), of its terms by their numbers. Words met before are remembered."""

    def __init__(self, vocabulary: np.ndarray | None = None) -> None:
        self.at = None if vocabulary is None else {t: i for i, t in enumerate(vocabulary.tolist())}
        self.met: dict[str, list[int]] = {}
        self.begins: dict[str, int | None] = {}

    def counts(self, text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
        met = self.met
        if len(met) > MEMO:
            met.clear()
            self.begins.clear()
        names, times = [], []
        counted = Counter(words_of(text))
        for word, n, own in zip(counted, counted.values(), map(met.get, counted)):
            if own is None:
                met[word] = own = self._own(word)
            if own:  # most words of a text are no term
                names += own
                times += [n] * len(own)
        ids, where = np.unique(np.array(names, dtype=np.int64), return_inverse=True)
        return ids, np.bincount(where, weights=times, minlength=len(ids)).astype(np.int64)

    def _own(self, word: str) -> list[int]:
        if self.at is None:
            return [hashed(t) for t in terms_of(word)]
        word, own = word.strip(_TRIM), []
        for n in PREFIXES:  # where a beginning is unknown, what it begins is too
            if len(word) <= n:
                break
            begin = word[:n]
            if begin not in self.begins:
                self.begins[begin] = self.at.get(hashed(f"{begin}*"))
            if (i := self.begins[begin]) is None:
                return own
            own.append(i)
        if word and (i := self.at.get(hashed(word))) is not None:
            own.append(i)
        return own


class Scores:
    """Scores of texts. Texts met before are remembered by their terms: copies cost nothing."""

    def __init__(self, index: Index, steps: tuple[np.ndarray, np.ndarray]) -> None:
        self.index, self.steps, self.terms, self.met = index, steps, Terms(index.vocabulary), {}

    def of(self, text: bytes | None) -> tuple[float, list[tuple[int, float, float]]]:
        return self.of_terms(*self.terms.counts(text))

    def of_terms(self, ids: np.ndarray, n: np.ndarray) -> tuple[float, list[tuple[int, float, float]]]:
        key = xxhash.xxh3_128_digest(ids.astype(np.int64).tobytes() + n.astype(np.int64).tobytes())
        if (got := self.met.get(key)) is None:
            if len(self.met) > TEXTS:
                self.met.clear()
            self.met[key] = got = self.index.score(ids, n, self.steps)
        return got


class Index:
    """Labelled examples as unit vectors of weighted terms, each distinct one once, in an inverted index whose postings fall into blocks of examples.

    Examples are (doc_id, toxic, term numbers, counts). Blocks hold examples with like leading terms; for each term and block that has it the index keeps the
    largest weight and the place of the postings.
    """

    def __init__(self, vocabulary: np.ndarray, weight: np.ndarray, examples: list[tuple[int, int, np.ndarray, np.ndarray]], units: tuple[float, float]) -> None:
        self.vocabulary, self.weight, self.unit = vocabulary, weight, np.array(units)
        grouped: dict[tuple[bytes, bytes], list] = {}
        for doc, toxic, ids, n in examples:
            g = grouped.setdefault((ids.tobytes(), n.tobytes()), [ids, n, np.zeros(2), doc])
            g[2][toxic] += units[toxic]
            g[3] = min(g[3], doc)
        blank = grouped.pop((b"", b""), None)
        self.blank = blank[2] if blank else np.zeros(2)
        rows = [(*self.vector(g[0], g[1]), g[2], g[3]) for g in grouped.values()]
        rows.sort(key=lambda r: (r[0][np.lexsort((r[0], -r[1]))[:8]].tolist(), r[3]))
        self.votes = np.array([r[2] for r in rows]).reshape(-1, 2)
        self.docs = [r[3] for r in rows]
        total = self.blank + self.votes.sum(axis=0)
        self.prior = float(total[1] / total.sum()) if total.sum() else 0.0
        self.blocks = -(-len(rows) // BLOCK)
        term = np.concatenate([r[0] for r in rows]) if rows else np.zeros(0, dtype=np.int64)
        x = np.concatenate([r[1] for r in rows]) if rows else np.zeros(0)
        who = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
        order = np.lexsort((who, term))
        term, x, who = term[order], x[order].astype(np.float32), who[order]
        # Long lists of postings are rows of a table, the others lists; both have a bound for each block.
        has = np.bincount(term, minlength=len(vocabulary))
        long = np.flatnonzero(has * LONG > len(rows)) if len(rows) >= BLOCK else np.zeros(0, dtype=np.int64)
        self.row_of = np.full(len(vocabulary), -1, dtype=np.int32)
        self.row_of[long] = np.arange(len(long))
        self.table = np.zeros((self.blocks, len(long), BLOCK), dtype=np.float32)
        is_long = self.row_of[term] >= 0
        self.table[who[is_long] // BLOCK, self.row_of[term[is_long]], who[is_long] % BLOCK] = x[is_long]
        self.table_most = self.table.max(axis=2).T.copy()
        term, x, who = term[~is_long], x[~is_long], who[~is_long]
        cell = term * max(1, self.blocks) + who // BLOCK
        begins = np.flatnonzero(np.diff(cell, prepend=-1))
        self.who, self.x = who.astype(np.int32), x
        self.cells = np.append(begins, len(cell))  # where the postings of a term and block begin
        self.block = (cell[begins] % max(1, self.blocks)).astype(np.int32)
        self.most = np.maximum.reduceat(x, begins) if len(begins) else np.zeros(0, dtype=np.float32)
        self.of_term = np.searchsorted(term[begins], np.arange(len(vocabulary) + 1))

    def vector(self, ids: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w = (1 + np.log(n)) * self.weight[ids]
        return ids, w / (np.linalg.norm(w) or 1.0)

    def nearest(self, ids: np.ndarray, w: np.ndarray, k: int = NEIGHBOURS) -> list[tuple[float, int]]:
        """(cosine, -row) of the k nearest rows, best first; ties go to the earlier row. A block whose bound can't reach the k-th is passed over."""
        if not len(ids) or not self.blocks:
            return []
        row = self.row_of[ids]
        table, own = row[row >= 0], w[row >= 0].astype(np.float32)
        ids, w = ids[row < 0], w[row < 0]
        cells, n = ranges(self.of_term[ids], self.of_term[ids + 1])
        weights = np.repeat(w, n)
        bound = np.bincount(self.block[cells], weights=weights * self.most[cells], minlength=self.blocks) + np.einsum("i,ij->j", own, self.table_most[table])
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > 0]
        best = self._best(cells, weights, table, own, order[:FIRST_BLOCKS], k)
        least = best[-1][0] if len(best) == k else 0.0
        rest = order[FIRST_BLOCKS:]
        rest = rest[bound[rest] >= least - 1e-5]  # no other block can hold one of the k nearest
        return sorted(best + self._best(cells, weights, table, own, rest, k), reverse=True)[:k] if len(rest) else best

    def _best(self, cells: np.ndarray, weights: np.ndarray, table: np.ndarray, own: np.ndarray, blocks: np.ndarray, k: int) -> list[tuple[float, int]]:
        """The k nearest rows of some blocks."""
        wanted = np.zeros(self.blocks, dtype=bool)
        wanted[blocks] = True
        inside = wanted[self.block[cells]]
        cells = cells[inside]
        at, n = ranges(self.cells[cells], self.cells[cells + 1])
        score = np.bincount(self.who[at], weights=np.repeat(weights[inside], n) * self.x[at], minlength=self.blocks * BLOCK).astype(float)
        if len(table):
            for block in blocks.tolist():
                score[block * BLOCK : (block + 1) * BLOCK] += np.einsum("i,ij->j", own, self.table[block].take(table, axis=0))  # small: threads would cost more than they save
        score = score.round(5)
        hit = np.flatnonzero(score)
        if len(hit) > 4 * k:  # no need to sort those below the k-th
            hit = hit[score[hit] >= np.partition(score[hit], -k)[-k]]
        top = hit[np.lexsort((hit, -score[hit]))[:k]]
        return [(float(score[i]), -i) for i in top.tolist()]

    def vote(self, near: list[tuple[float, int]], without: tuple[int, int] | None = None) -> float:
        """Share of toxic examples, weighted by closeness; without: a row and label of which one example does not vote."""
        totals = np.zeros(2)
        for cosine, row in near:
            own = self.votes[-row].copy()
            if without and without[0] == -row:
                own[without[1]] -= self.unit[without[1]]
            totals += own * cosine / (1.1 - cosine)
        smooth = 0.5 * self.unit.min()
        return float((totals[1] + smooth * self.prior) / (totals.sum() + smooth))

    def left_out(self, ids: np.ndarray, n: np.ndarray, toxic: int) -> float | None:
        """The vote on an example by the others; none if it has no terms."""
        if not len(ids):
            return None
        near = self.nearest(*self.vector(ids, n))
        own = -near[0][1] if near and near[0][0] > 1 - 1e-4 else None
        return self.vote(near, None if own is None else (own, toxic))

    def calibrated(self, votes: list[tuple[float, int]]) -> tuple[np.ndarray, np.ndarray]:
        """Increasing steps from left-out votes (vote, toxic) to the share of toxic examples among them (pooled adjacent violators)."""
        pools: list[list[float]] = []
        for x, toxic in sorted(votes):
            weight = self.unit[toxic]
            pools.append([x, weight * toxic, weight])
            while len(pools) > 1 and pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]:
                x2, t2, w2 = pools.pop()
                pools[-1] = [(pools[-1][0] * pools[-1][2] + x2 * w2) / (pools[-1][2] + w2), pools[-1][1] + t2, pools[-1][2] + w2]
        smooth = self.unit.min()
        return np.array([p[0] for p in pools]), np.array([(p[1] + smooth * self.prior) / (p[2] + smooth) for p in pools])

    def score(self, ids: np.ndarray, n: np.ndarray, steps: tuple[np.ndarray, np.ndarray]) -> tuple[float, list[tuple[int, float, float]]]:
        """The calibrated score and the evidence (doc_id, cosine, share of toxic examples) of the five nearest."""
        near = self.nearest(*self.vector(ids, n))
        if not near:
            every = self.blank.sum() + self.unit.min()
            return float((self.blank[1] + self.unit.min() * self.prior) / every) if self.prior else 0.0, []
        vote = self.vote(near)
        score = float(np.interp(vote, *steps)) if len(steps[0]) else vote
        return min(1.0, max(0.0, score)), [(self.docs[-r], c, float(self.votes[-r][1] / self.votes[-r].sum())) for c, r in near[:5]]


def label_weights(term: np.ndarray, row: np.ndarray, toxic: np.ndarray, terms: int) -> np.ndarray:
    """Weight of each term by the likelihood ratio of its association with the label, either way, over examples; (term, row) says who has what."""
    n, n1 = len(toxic), int(toxic.sum())
    a = np.bincount(term, weights=toxic[row], minlength=terms)
    both = np.bincount(term, minlength=terms).astype(float)
    if not 0 < n1 < n:
        return np.full(terms, 1.0)

    def part(x: np.ndarray, expected: np.ndarray) -> np.ndarray:
        return x * np.log(np.where(x > 0, x, 1) / np.where(expected > 0, expected, 1)) * (x > 0)

    b = both - a
    ratio = 2 * (part(a, both * n1 / n) + part(b, both * (n - n1) / n) + part(n1 - a, (n - both) * n1 / n) + part(n - n1 - b, (n - both) * (n - n1) / n))
    ratio = np.maximum(ratio, 0.0)
    return LEAST + (1 - LEAST) * ratio**2 / (ratio**2 + HALF**2)


def originals(prints: np.ndarray) -> np.ndarray:
    """Which fingerprints have none within COPY_BITS bits before them. Prints are as many as examples."""
    out = np.ones(len(prints), dtype=bool)
    for i in range(1, len(prints)):
        out[i] = not (np.bitwise_count(prints[:i] ^ prints[i]) <= COPY_BITS).any()
    return out


def fit(docs: DataFrame, labels: DataFrame) -> tuple[Broadcast, tuple[np.ndarray, np.ndarray], DataFrame]:
    """The index, sent to the executors, the steps of its calibration, and (doc_id, ids, n): the terms of each row of docs, looked up once. Learns from labelled rows outside the held-out fold: at most MAX_EXAMPLES of each label, by
    hash of doc_id.

    Terms are the words and word beginnings of those examples, all of them. A term's weight is its idf, by document frequencies over all of docs, times
    its label weight. Votes are weighted by what each label's sampling left out. Only the examples' terms and their frequencies reach the driver.
    """
    spark = docs.sparkSession
    known = labels.where("toxic is not null and doc_id is not null").where(fold("doc_id") != HELD_OUT).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic")).where("toxic in (0, 1)")
    sizes = {r[0]: r[1] for r in known.groupBy("toxic").count().collect()}
    sampled = [known.where(f"toxic = {y}").orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_EXAMPLES) for y in (0, 1)]
    picked = spark.createDataFrame([tuple(r) for s in sampled for r in s.collect()], known.schema)  # at most 2 * MAX_EXAMPLES ids
    texts = written(docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).join(F.broadcast(picked), "doc_id"), "toxicity-sample")

    def described(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms()
        for b in it:
            got = [terms.counts(x.as_py()) for x in b.column("text")]
            prints = np.array([fingerprint(x.as_py() or b"") for x in b.column("text")], dtype=np.uint64)
            yield pa.record_batch(
                [b.column("doc_id"), b.column("toxic"), pa.array(prints.view(np.int64)), pa.array([g[0] for g in got], pa.list_(pa.int64())), pa.array([g[1] for g in got], pa.list_(pa.int64()))],
                names=["doc_id", "toxic", "print", "terms", "n"],
            )

    rows = texts.mapInArrow(described, "doc_id long, toxic int, print long, terms array<long>, n array<long>").toArrow().combine_chunks()
    columns = [rows.column(c).to_pylist() for c in ("doc_id", "toxic", "print")] + [[x.values.to_numpy() for x in rows.column(c)] for c in ("terms", "n")]
    examples = sorted(zip(*columns, strict=True), key=lambda x: (x[0], x[1], x[2], x[3].tobytes(), x[4].tobytes()))
    vocabulary = np.unique(np.concatenate([x[3] for x in examples])) if examples else np.zeros(0, dtype=np.int64)
    numbered = [(doc, toxic, np.searchsorted(vocabulary, terms), n) for doc, toxic, _, terms, n in examples]
    first = [x for x, is_first in zip(numbered, originals(np.array([x[2] for x in examples], dtype=np.int64).view(np.uint64)), strict=True) if is_first]
    term = np.concatenate([x[2] for x in first]) if first else np.zeros(0, dtype=np.int64)
    told = label_weights(term, np.repeat(np.arange(len(first)), [len(x[2]) for x in first]), np.array([x[1] for x in first]), len(vocabulary))

    sent_terms = spark.sparkContext.broadcast(vocabulary)

    def looked(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, kind = Terms(sent_terms.value), pa.list_(pa.int32())
        for b in it:
            got = [terms.counts(x.as_py()) for x in b.column(1)]
            yield pa.record_batch([b.column(0), *[pa.array([g[k].astype(np.int32) for g in got], kind) for k in (0, 1)]], names=["doc_id", "ids", "n"])

    def frequencies(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(len(sent_terms.value) + 1, dtype=np.int64)
        for b in it:
            df[:-1] += np.bincount(b.column(0).flatten().to_numpy(), minlength=len(df) - 1)
            df[-1] += b.num_rows
        used = np.flatnonzero(df)
        yield pa.record_batch([pa.array(used, pa.int32()), pa.array(df[used])], names=["t", "n"])

    rows_of = written(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(looked, "doc_id long, ids array<int>, n array<int>"), "toxicity-terms")
    found = rows_of.select("ids").mapInArrow(frequencies, "t int, n long").groupBy("t").agg(F.sum("n").alias("n")).toArrow()
    df = np.zeros(len(vocabulary) + 1)
    df[found.column("t").to_numpy()] = found.column("n").to_numpy()
    idf = np.log((1 + df[-1]) / (1 + df[:-1])) + 1
    index = Index(vocabulary, idf * told, numbered, tuple(max(1.0, sizes.get(y, 0) / MAX_EXAMPLES) for y in (0, 1)))
    sent = spark.sparkContext.broadcast(index)

    def votes(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        terms = Terms(own.vocabulary)
        for b in it:
            got = [own.left_out(*terms.counts(x.as_py()), y) for x, y in zip(b.column("text"), b.column("toxic").to_pylist(), strict=True)]
            yield pa.record_batch([pa.array(got, pa.float64()), b.column("toxic")], names=["vote", "toxic"])

    left_out = [tuple(r) for r in texts.mapInArrow(votes, "vote double, toxic int").where("vote is not null").collect()]  # as many as examples
    return sent, index.calibrated(left_out), rows_of


def scored(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted, evidence) for every row of docs(doc_id, text).

    Scores are calibrated to the share of label 1 among labelled rows. A text without any term of the examples, as empty and null ones,
    gets the share among such examples; without labels every score is 0. Rows may repeat; a null doc_id is not held out.
    Of labels(doc_id, toxic) rows with nulls are passed over, and of several for a document the highest counts. Other columns are not read.
    """
    sent, steps, terms = fit(docs, labels)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = Scores(sent.value, steps)
        kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("toxic_share", pa.float64())]))
        for b in it:
            got = [scores.of_terms(ids.values.to_numpy(), n.values.to_numpy()) for ids, n in zip(b.column(1), b.column(2))]
            evidence = [[{"doc_id": d, "cosine": c, "toxic_share": s} for d, c, s in near] for _, near in got]
            yield pa.record_batch([b.column(0), pa.array([s for s, _ in got], pa.float64()), pa.array(evidence, kind)], names=["doc_id", "score", "evidence"])

    out = terms.select("doc_id", "ids", "n").mapInArrow(batches, "doc_id long, score double, evidence array<struct<doc_id: long, cosine: double, toxic_share: double>>")
    held = F.coalesce(fold("doc_id") == HELD_OUT, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "evidence")


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that are not predicted toxic, columns as in docs. Each row is judged by its own text, where it lies: nothing is shuffled.
    Null and empty texts, repeated rows and rows without an id are judged like any other (see scored)."""
    sent, steps, _ = fit(docs, labels)

    def toxic(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scores = Scores(sent.value, steps)
        for part in texts:
            yield pd.Series([scores.of(x)[0] >= threshold for x in part])

    return docs.where(~F.pandas_udf(toxic, "boolean", F.PandasUDFType.SCALAR_ITER)(F.col("text").cast("binary")))
