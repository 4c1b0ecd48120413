"""LM scoring: a subword lattice that spells any word, with the words of the training texts in it."""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lupaspark.llm.common import written

FOLDS, HELD_OUT = 5, 1
#: Kinds of text that get counts of their own, and strengths of the pull towards words that a text has used before.
KINDS, BURSTS = 8, (300.0, 3000.0)
#: Chance that a word ends after a piece, and the rank added to a piece's own, in the weights of the pieces.
STOP, RANK_SHIFT = 0.25, 10.0
#: Share of the byte pieces, and pieces that the weights before a refit stand for.
BYTE_SHARE, PRIOR_PIECES = 1e-4, 100.0
#: A batch of documents closes at so many distinct words or bytes of text.
BATCH_WORDS, BATCH_BYTES = 500_000, 32 << 20
#: Entries of texts whose chances are added up at a time.
CHUNK = 100_000
SPACE = "▁"


def read_scores(path: str) -> dict[str, float]:
    """Pieces of a sentencepiece model and their own scores; byte pieces keep their <0x..> names."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return {model.id_to_piece(i): model.get_score(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i))}


class Lattice:
    """Chance of a word's spelling: the sum over all ways to cut it into pieces, by forward recursion over its characters in log space.

    The pieces' first weights come from the vocabulary's own scores. Scores that are merge ranks (0, -1, -2, ...) weigh a piece by 1 / (rank + RANK_SHIFT); log
    probabilities are taken as they are. The first piece of a word carries the space mark; first and later pieces are
    normalised apart. After each piece the word ends with chance `stop`, so that the chances of all words add up to at most 1.
    A character that no piece spells is spelled by byte pieces.
    """

    def __init__(self, scores: dict[str, float]) -> None:
        ranks = min(scores.values(), default=0.0) < -1000
        known = {f"<0x{b:02X}>" for b in range(256)}
        weight = {p: 1 / (RANK_SHIFT - s) if ranks else math.exp(s) for p, s in scores.items() if p not in known}
        weight.setdefault(SPACE, min(weight.values(), default=1.0))
        self._set(weight, STOP)

    def _set(self, weight: dict[str, float], stop: float) -> None:
        self.weight, self.stop = weight, stop
        firsts = sum(w for p, w in weight.items() if p[0] == SPACE)
        laters = sum(w for p, w in weight.items() if p[0] != SPACE) or 1.0
        on = math.log(1 - stop)
        self.logp = {p: math.log(w / (firsts if p[0] == SPACE else laters) * (1 if p[0] == SPACE else 1 - BYTE_SHARE)) + on for p, w in weight.items() if w > 0}
        self.byte = math.log(BYTE_SHARE / 256) + on
        self.trie: dict[str, list] = {}
        for piece, p in self.logp.items():  # a node is {character: [node, log weight of the piece that ends here]}
            node = self.trie
            for c in piece[:-1]:
                node = node.setdefault(c, [{}, None])[0]
            node.setdefault(piece[-1], [{}, None])[1] = p
        self.last = math.log(stop) - on

    def refitted(self, expected: dict[str, float], words: int) -> Lattice:
        """The weights that follow from the expected numbers of pieces in so many words; the weights before count as PRIOR_PIECES pieces."""
        out = Lattice.__new__(Lattice)
        firsts = sum(w for p, w in self.weight.items() if p[0] == SPACE)
        laters = sum(w for p, w in self.weight.items() if p[0] != SPACE) or 1.0
        weight = {p: expected.get(p, 0.0) + PRIOR_PIECES * w / (firsts if p[0] == SPACE else laters) for p, w in self.weight.items()}
        pieces = sum(expected.values())
        out._set(weight, (words + 1) / (max(pieces, words) + 1 / STOP))
        return out

    def _forward(self, text: str, edges: list[list[tuple[int, float, str]]] | None = None) -> list[float | None]:
        """Log chances of each beginning of text; edges gets the pieces (begin, log weight, piece) that end at each place."""
        n, exp, log, trie = len(text), math.exp, math.log1p, self.trie
        alpha: list[float | None] = [None] * (n + 1)
        alpha[0] = 0.0
        for begin in range(n):
            so_far = alpha[begin]
            node, end = trie, begin
            spelled = False
            if begin and text[begin] == SPACE:
                node = {}  # no later piece begins with the mark: one in the word itself is spelled by bytes
            while end < n and (step := node.get(text[end])) is not None:
                end += 1
                node, p = step
                if p is not None:
                    spelled = spelled or end == begin + 1
                    new, old = so_far + p, alpha[end]
                    alpha[end] = new if old is None else new + log(exp(old - new)) if new > old else old + log(exp(new - old))
                    if edges is not None:
                        edges[end].append((begin, p, text[begin:end]))
            if not spelled:  # byte pieces stand for the character
                p = self.byte * len(text[begin].encode("utf-8", "replace"))
                new, old = so_far + p, alpha[begin + 1]
                alpha[begin + 1] = new if old is None else new + log(exp(old - new)) if new > old else old + log(exp(new - old))
                if edges is not None:
                    edges[begin + 1].append((begin, p, ""))
        return alpha

    def log_chance(self, word: str) -> float:
        return self._forward(SPACE + word)[-1] + self.last

    def expect(self, word: str, into: dict[str, float]) -> float:
        """Adds the expected numbers of the word's pieces over all ways to cut it; returns its log chance."""
        text = SPACE + word
        n, exp = len(text), math.exp
        edges: list[list[tuple[int, float, str]]] = [[] for _ in range(n + 1)]
        alpha = self._forward(text, edges)
        share = [0.0] * n + [1.0]  # chance that a cut lies here
        for end in range(n, 0, -1):
            here = share[end]
            if here:
                for begin, p, piece in edges[end]:
                    x = here * exp(alpha[begin] + p - alpha[end])
                    share[begin] += x
                    if piece:
                        into[piece] = into.get(piece, 0.0) + x
        return alpha[n] + self.last


_WORD_COUNTS = [f"c{k}" for k in range(KINDS)]
_FIELDS = pa.schema(
    [("batch", pa.int64()), ("word", pa.binary()), ("wid", pa.int32()), *((c, pa.int32()) for c in _WORD_COUNTS)]
    + [("doc_id", pa.int64()), ("held_out", pa.bool_()), ("kind", pa.int32()), ("ids", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32()))]
)
_PASSED = (
    f"batch long, word binary, wid int, {', '.join(c + ' int' for c in _WORD_COUNTS)}, "
    "doc_id long, held_out boolean, kind int, ids array<int>, counts array<int>"
)


class _Numbers(dict):
    """Words numbered in the order in which they are first asked for."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def kind_of(counts: dict[bytes, int]) -> int:
    """The kind of a text: a hash of its commonest word (the largest among equals), so that texts of one language and manner mostly fall together. 0 without words."""
    return zlib.crc32(max(counts.items(), key=lambda x: (x[1], x[0]))[0]) % KINDS if counts else 0


def _rows(**columns: pa.Array) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    return pa.record_batch([columns[f.name] if f.name in columns else pa.nulls(n, f.type) for f in _FIELDS], schema=_FIELDS)


def _batched(docs: DataFrame) -> DataFrame:
    """One pass over docs(doc_id, text, held_out). Rows with a word: its number in the batch and its training count by kind. Rows without: a document as numbers of its words and their counts."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch = TaskContext.get().partitionId() << 32
        words, seen, rows, held = _Numbers(), np.zeros((KINDS, 1 << 16), dtype=np.int32), [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            names = list(words)
            for at in range(0, len(names), 50_000):
                part = names[at : at + 50_000]
                own = {c: pa.array(seen[k, at : at + len(part)]) for k, c in enumerate(_WORD_COUNTS)}
                yield _rows(batch=pa.array(np.full(len(part), batch)), word=pa.array(part, pa.binary()), wid=pa.array(np.arange(at, at + len(part), dtype=np.int32)), **own)
            for at in range(0, len(rows), 500):
                doc, held_out, kind, ids, ns = zip(*rows[at : at + 500], strict=True)
                lists = [pa.ListArray.from_arrays(np.cumsum([0, *map(len, x)], dtype=np.int32), np.concatenate(x)) for x in (ids, ns)]
                yield _rows(batch=pa.array(np.full(len(doc), batch)), doc_id=pa.array(doc, pa.int64()), held_out=pa.array(held_out), kind=pa.array(kind, pa.int32()), ids=lists[0], counts=lists[1])

        for b in it:
            for doc, text, held_out in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
                text = text.as_py() or b""
                own = Counter(text.lower().split())
                ids = np.fromiter(map(words.__getitem__, own), dtype=np.int32, count=len(own))
                n = np.fromiter(own.values(), dtype=np.int32, count=len(own))
                kind = kind_of(own)
                if len(words) > seen.shape[1]:
                    seen = np.pad(seen, ((0, 0), (0, 2 * len(words) - seen.shape[1])))
                if not held_out:
                    seen[kind, ids] += n
                rows.append((doc, held_out, kind, ids, n))
                held += len(text)
                if len(words) >= BATCH_WORDS or held >= BATCH_BYTES:
                    yield from flush()
                    words, rows, held, batch = _Numbers(), [], 0, batch + 1
                    seen[:] = 0
        if rows:
            yield from flush()

    return docs.mapInArrow(batches, _PASSED)


def _spelled(counted: DataFrame, lattice: Lattice) -> DataFrame:
    """Words with their log chance under the lattice (plain), and, in rows without a word, the expected numbers of the pieces in the
    distinct training words (piece "": the number of those words). A task sends each piece once."""
    sent = counted.sparkSession.sparkContext.broadcast(lattice)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, sums, words = sent.value, {}, 0
        for b in it:
            trained = b.column("c").to_numpy() > 0
            logs = [own.expect(w.decode("utf-8", "replace"), sums) if t else own.log_chance(w.decode("utf-8", "replace")) for w, t in zip(b.column("word").to_pylist(), trained.tolist(), strict=True)]
            words += int(trained.sum())
            yield pa.record_batch([*b.columns, pa.array(logs, pa.float64()), pa.nulls(b.num_rows, pa.string()), pa.nulls(b.num_rows, pa.float64())], names=[*b.schema.names, "plain", "piece", "expected"])
        n = len(sums) + 1
        nulls = [pa.nulls(n, f.type) for f in _spelled_schema]
        yield pa.record_batch([*nulls, pa.array([*sums, ""], pa.string()), pa.array([*sums.values(), float(words)], pa.float64())], names=[*_spelled_schema.names, "piece", "expected"])

    _spelled_schema = pa.schema([("word", pa.binary()), ("c", pa.int64()), *((c, pa.int64()) for c in _WORD_COUNTS), ("plain", pa.float64())])
    return counted.mapInArrow(batches, f"word binary, c long, {', '.join(c + ' long' for c in _WORD_COUNTS)}, plain double, piece string, expected double")


class Model:
    """Chances of whole texts. What the corpus tells is a fixed number of totals; words bring their own counts and spelling.

    A word's chance is (c - D) / N + D V / N * spelling: c is its training count, N all of them, V the distinct words, D a discount from the words
    seen once and twice. Each kind of training text (kind_of) has counts of its own, which fall back on these chances with the weight of its words seen once.
    In a text, words that came before are likelier: after i tokens, m of them this word, its chance is (a p + m) / (a + i). A text's chance is the
    sum of that over kinds, by their shares of the training texts, and over the strengths a (BURSTS; without end: none). Words, kinds and strengths all sum to at most 1.
    """

    def __init__(self, ends: np.ndarray, words: int, ones: int, twos: int, sums: np.ndarray, backs: np.ndarray) -> None:
        self.end = float(ends.sum())
        self.n = float(sums.sum()) + self.end
        self.v = words + (1 if self.end else 0)
        self.discount = ones / (ones + 2 * twos) if ones else 0.5
        self.sums, self.backs = sums + ends, np.maximum(1.0, backs)
        if words:
            self.back_mass, self.end_chance = self.discount * words / self.n, self.end / self.n
        else:  # no word was seen: what an end leaves is for spellings
            self.back_mass, self.end_chance = 1 / (self.n + 2), (self.end + 1) / (self.n + 2)
        self.shares = np.log((ends + 1) / (self.end + len(ends)))
        self.end_logs = np.log((ends + self.backs * self.end_chance) / (self.sums + self.backs))
        self.norm = self.n + 0.5 * (self.v + 1)
        self.base_end = math.log10((self.end + 0.5) / self.norm)

    def logs(self, c: np.ndarray, by_kind: np.ndarray, spelling: np.ndarray) -> np.ndarray:
        """Log chances (word, kind) of words by their counts, (word, kind) counts and log chances of their spelling."""
        with np.errstate(divide="ignore"):  # the log of nothing is -inf, which adds nothing
            known = np.log(np.maximum(c - self.discount, 0) / self.n) if self.n else np.full(len(c), -np.inf)
            chance = np.logaddexp(known, np.log(self.back_mass) + spelling)
            return np.logaddexp(np.log(by_kind), np.log(self.backs) + chance[:, None]) - np.log(self.sums + self.backs)

    def texts(self, doc: np.ndarray, word: np.ndarray, m: np.ndarray, n_docs: int, logs: np.ndarray) -> np.ndarray:
        """Log chances of texts that hold words (rows of logs) m times: entries (doc, word, m)."""
        kinds = logs.shape[1]
        flat, bursts = np.zeros((kinds, n_docs)), np.zeros((len(BURSTS), kinds, n_docs))
        for at in range(0, len(doc), CHUNK):
            d, w, k = doc[at : at + CHUNK], word[at : at + CHUNK], m[at : at + CHUNK]
            own = logs[w]
            again = np.maximum(k - 1, 0)
            for i in range(kinds):
                flat[i] += np.bincount(d, weights=k * own[:, i], minlength=n_docs)
                first = np.bincount(d, weights=own[:, i], minlength=n_docs)
                for a in range(len(BURSTS)):
                    bursts[a, i] += first
            if again.any():
                ends = np.cumsum(again)
                for lo in range(0, int(ends[-1]), CHUNK):  # a word may come again more often than memory would hold
                    spot = np.arange(lo, min(lo + CHUNK, int(ends[-1])))
                    e = np.searchsorted(ends, spot, side="right")
                    j = spot - (ends[e] - again[e]) + 1
                    p = np.exp(own[e])
                    for a, strength in enumerate(BURSTS):
                        x = np.log(strength * p + j[:, None]) - math.log(strength)
                        for i in range(kinds):
                            bursts[a, i] += np.bincount(d[e], weights=x[:, i], minlength=n_docs)
        tokens = np.bincount(doc, weights=m, minlength=n_docs) + 1
        parts = [flat]
        for a, strength in enumerate(BURSTS):
            lasting = np.array([math.lgamma(strength + t) for t in tokens.tolist()]) - math.lgamma(strength) - tokens * math.log(strength)
            parts.append(bursts[a] - lasting)
        every = np.concatenate([p + (self.end_logs + self.shares)[:, None] for p in parts]) - math.log(len(parts))
        top = every.max(axis=0)
        return top + np.log(np.exp(every - top).sum(axis=0))


def scored(docs: DataFrame, scores: dict[str, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, lattice_score) of every row; log10 chances of the whole text.

    Words are lower-cased (A-Z) runs without ASCII white space; one end follows. Null texts are empty. Rows whose crc32(doc_id) mod 5 is 1 are held out,
    all others train; a null doc_id trains. Repeated rows are scored each, and train each. Nothing but id and text is read.

    lattice_score is the marginal chance over all segmentations by the vocabulary's own scores alone, with the training texts' chance of an end. In
    score the training words stand in the lattice too, beside the ways to spell a word by pieces, whose weights are
    refitted to the training words from those scores (see Model).
    """
    spark = docs.sparkSession
    held = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"), held.alias("held_out"))
    passed = written(_batched(rows), "lm-batches")
    seen, texts = passed.where("word is not null"), passed.where("word is null")

    every = [F.sum(c).alias(c) for c in _WORD_COUNTS]
    total = F.lit(0).cast("long")
    for c in _WORD_COUNTS:
        total = total + F.col(c)
    counted = seen.groupBy("word").agg(*every).select("word", total.alias("c"), *_WORD_COUNTS)
    plain = Lattice(scores)
    counted = written(_spelled(counted, plain), "lm-words")
    words = counted.where("piece is null").drop("piece", "expected")
    got = {r[0]: r[1] for r in counted.where("piece is not null").groupBy("piece").agg(F.sum("expected")).collect()}  # at most the vocabulary
    n_words = int(got.pop("", 0))
    fitted = plain.refitted(got, n_words) if n_words else plain
    sums = words.agg(
        F.count_if(F.col("c") > 0), F.count_if(F.col("c") == 1), F.count_if(F.col("c") == 2),
        *[F.coalesce(F.sum(c), F.lit(0)) for c in _WORD_COUNTS], *[F.count_if(F.col(c) == 1) for c in _WORD_COUNTS],
    ).first()
    ends = np.zeros(KINDS)
    for r in texts.where("not held_out").groupBy("kind").count().collect():
        ends[r[0]] = r[1]
    model = Model(ends, sums[0], sums[1], sums[2], np.array(sums[3 : 3 + KINDS], dtype=float), np.array(sums[3 + KINDS :], dtype=float))
    sent = spark.sparkContext.broadcast(fitted)

    def spelled(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for b in it:
            logs = [own.log_chance(w.decode("utf-8", "replace")) for w in b.column("word").to_pylist()]
            yield pa.record_batch([*b.columns, pa.array(logs, pa.float64())], names=[*b.schema.names, "own"])

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        wid = right.column("wid").to_numpy()
        size = int(wid.max()) + 1 if len(wid) else 1
        c, by_kind, spelling, pieces = np.zeros(size), np.zeros((size, KINDS)), np.zeros(size), np.zeros(size)
        c[wid], spelling[wid], pieces[wid] = (right.column(x).to_numpy() for x in ("c", "own", "plain"))
        for k, name in enumerate(_WORD_COUNTS):
            by_kind[wid, k] = right.column(name).to_numpy()
        left = left.combine_chunks()
        lists = left.column("ids").combine_chunks()
        per_doc, n_docs = np.diff(lists.offsets.to_numpy()), left.num_rows
        ids, m = lists.flatten().to_numpy(), left.column("counts").combine_chunks().flatten().to_numpy()
        doc = np.repeat(np.arange(n_docs), per_doc)

        def added(x: np.ndarray) -> np.ndarray:
            return np.bincount(doc, weights=x, minlength=n_docs)

        out = [
            added(m).astype(np.int64) + 1,
            added(m * (c[ids] > 0)).astype(np.int64) + (model.end > 0),
            added(m * np.log10((c + 0.5) / model.norm)[ids]) + model.base_end,
            model.texts(doc, ids, m, n_docs, model.logs(c, by_kind, spelling)) / math.log(10),
            (added(m * (pieces[ids] + math.log1p(-model.end_chance))) + np.log(model.end_chance)) / math.log(10),
        ]
        return pa.table([left.column("doc_id"), left.column("held_out"), *map(pa.array, out)], names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "lattice_score"])

    valued = words.mapInArrow(spelled, f"word binary, c long, {', '.join(c + ' long' for c in _WORD_COUNTS)}, plain double, own double")
    numbers = seen.select(F.col("batch").alias("of_batch"), "word", "wid").join(valued, "word").drop("word")
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, lattice_score double"
    found = texts.select("batch", "doc_id", "held_out", "ids", "counts").groupBy("batch").cogroup(numbers.groupBy("of_batch")).applyInArrow(score, schema)
    return found.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(int(model.n)).cast("long").alias("train_tokens"), "base_score", "score", "lattice_score")
