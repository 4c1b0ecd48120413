"""Benchmark decontamination: CGK embedding, bit-sampling LSH over windows of the whole item, exact edit verification; short items by exact phrase."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lupaspark.llm.common import written

#: Share of an item's words that may differ in a copy.
MAX_EDITS = 0.2
#: Independent walks, samples of positions taken from each walk, and positions in a sample.
WALKS, SAMPLES, BITS = 6, 6, 5
#: Windows of texts begin at every STRIDE-th word. Items are entered with windows at every word, so that each stretch of a copy has windows in step.
STRIDE = 4
#: Words that a walk reads on average, in twice as many steps; the end of a text ends it earlier.
WALK_WORDS = 24
#: Fewest words, besides pads, in a key of an item: keys of pads alone would meet the end of every text.
REAL_WORDS = 3
#: Items of fewer words are common phrases: they are looked for without edits.
MIN_WORDS = 8
#: Items of fewer words have too few positions to sample: they fall into one part more than edits allowed, and a part is looked for as a phrase.
MIN_WALKED = 20
#: A copy of the shortest items may lack so many words.
MAX_SHORT = 2
#: Bits of each of the two tables of item keys that tasks hold, whatever the number of items.
FILTER_BITS = 1 << 25
SEED = 20_240_131
#: Texts are walked over together up to so many words, and words whose hashes a task remembers.
PIECE, MEMO = 1 << 16, 300_000
_WORD = re.compile(r"\w+")
_PAD = 0x5BD1E995
#: The second table of keys goes by their bits from here on.
_SECOND = 32


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


class Memo(dict):
    """32-bit hashes of words, each found when it is first asked for."""

    def __missing__(self, word: str) -> int:
        self[word] = h = xxhash.xxh64_intdigest(word) & 0xFFFFFFFF
        return h


def hashed(words: list[str], memo: Memo) -> np.ndarray:
    """Hashes of the words; memo is bounded."""
    if len(memo) > MEMO:
        memo.clear()
    return np.fromiter(map(memo.__getitem__, words), dtype=np.uint64, count=len(words))


class Walks:
    """CGK walks over sequences of word hashes, and the sampled positions that make the LSH keys.

    A walk copies the word at its pointer and moves on or stays, by a coin of the step and the word. Two texts a few edits apart fall in step again soon, so
    that the copies differ in few positions: edit distance becomes Hamming distance. A sample of positions agrees if
    none of them lies where the walks differ.
    """

    def __init__(self, words: int = WALK_WORDS) -> None:
        rng = np.random.default_rng(SEED)
        self.steps = 2 * words
        self.coins = rng.integers(1, 2**63, size=(WALKS, self.steps), dtype=np.uint64) | np.uint64(1)
        reach = np.linspace(0.4, 1, SAMPLES)  # some samples keep to the beginning: short items and copies that differ later on
        self.picks = [[np.sort(rng.choice(int(self.steps * r), BITS, replace=False)) for r in reach] for _ in range(WALKS)]
        self.mix = rng.integers(1, 2**63, size=(WALKS, SAMPLES, BITS), dtype=np.uint64) | np.uint64(1)

    def laid(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The texts one after another, each followed by as many pads as a walk may read, and where they begin."""
        pads = np.full(self.steps, _PAD, dtype=np.uint64)
        sizes = np.array([len(t) + self.steps for t in texts])
        return np.concatenate([x for t in texts for x in (t, pads)]), np.cumsum(sizes) - sizes

    def keys(self, words: np.ndarray, starts: np.ndarray, end: int | None = None, real: np.ndarray | None = None) -> np.ndarray:
        """Keys (window, walk and sample) of the windows that begin at starts. real(walk and sample, window) counts the words before end in each key."""
        out = np.zeros((WALKS * SAMPLES, len(starts)), dtype=np.uint64)
        with np.errstate(over="ignore"):
            for w in range(WALKS):
                taken: dict[int, list[tuple[int, np.uint64]]] = {}
                for s, pick in enumerate(self.picks[w]):
                    for b, step in enumerate(pick.tolist()):
                        taken.setdefault(step, []).append((w * SAMPLES + s, self.mix[w, s, b]))
                at = starts.copy()
                for step in range(max(taken) + 1):
                    c = words.take(at)
                    for row, mix in taken.get(step, ()):
                        out[row] += (c ^ np.uint64(step + 1)) * mix
                        if real is not None:
                            real[row] += at < end
                    c *= self.coins[w, step]
                    c >>= np.uint64(63)
                    at += c.view(np.int64)
            out = (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            out += np.arange(WALKS * SAMPLES, dtype=np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15)
        return (out ^ (out >> np.uint64(32))).T


def allowed(n: int, max_edits: float) -> int:
    """Edits allowed in a copy of an item of n words."""
    return 0 if n < MIN_WORDS else int(n * max_edits)


def phrase_parts(n: int, max_edits: float) -> list[tuple[int, int]]:
    """(start, words) of the parts of an item of n words, fewer than MIN_WALKED: the allowed edits leave one of them whole."""
    cuts = np.linspace(0, n, min(n, allowed(n, max_edits) + 1) + 1).astype(int).tolist()
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def phrase_keys(words: np.ndarray, n: int) -> np.ndarray:
    """A key of each run of n words, by its first word."""
    out = np.full(max(0, len(words) - n + 1), n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(n):
            out = (out ^ words[i : i + len(out)]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
    return out


def may_hold(item: Counter[str], n: int, words: list[str], most: int) -> bool:
    """Whether so many of the item's n words occur among words as any span within `most` edits must have."""
    have = item.keys() & {*words}
    if n - sum(map(item.__getitem__, have)) > most:
        return False
    return n - (item & Counter(words)).total() <= most


def best_span(item: list[str], text: list[str], most: int) -> tuple[int, int, int] | None:
    """(edits, start, stop) of the span of text that is the fewest word edits from item, if those are at most `most`; the earliest such end, then the longest such span."""

    def ends(pattern: list[str], words: list[str], anchored: bool) -> list[int]:
        """Distance of pattern to a span of words that ends at each word; anchored: the span begins with the first word. Bit-parallel."""
        m = len(pattern)
        full, peq = (1 << m) - 1, {}
        for i, w in enumerate(pattern):
            peq[w] = peq.get(w, 0) | 1 << i
        vp, vn, dist, out = full, 0, m, [m]
        for w in words:
            x = peq.get(w, 0)
            d0 = (((x & vp) + vp) ^ vp) | x | vn
            hp = (vn | ~(d0 | vp)) & full
            hn = d0 & vp & full
            dist += (hp >> (m - 1) & 1) - (hn >> (m - 1) & 1)
            hp = (hp << 1 | anchored) & full
            vp = (hn << 1 | ~(d0 | hp)) & full
            vn = d0 & hp
            out.append(dist)
        return out

    found = ends(item, text, False)
    dist = min(found)
    if dist > most:
        return None
    stop = found.index(dist)
    back = ends(item[::-1], text[:stop][::-1], True)
    length = max(i for i, d in enumerate(back) if d == dist)
    return dist, stop - length, stop


def _item_words(items: DataFrame) -> DataFrame:
    """(item_id, words) of the items that have words, each once; an item_id may have several texts."""

    def rows(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            found = [(item, words_of(text or "")) for item, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            found = [(item, words) for item, words in found if words]
            yield pa.record_batch([pa.array([i for i, _ in found], pa.int64()), pa.array([" ".join(w) for _, w in found], pa.string())], names=["item_id", "words"])

    return items.select(F.col("item_id").cast("long"), "text").mapInArrow(rows, "item_id long, words string").distinct()


def item_starts(n: int, max_edits: float) -> np.ndarray:
    """Where the windows of an item of n words begin: each full window, and in short items as many as edits of the opening and windows out of step can make useless."""
    return np.arange(min(n, max(n - WALK_WORDS, int(n * max_edits)) + STRIDE))


def _item_keys(items: DataFrame, max_edits: float) -> DataFrame:
    """Keys of items(item_id, words) and the place in the item of the window they stand for."""
    walks = Walks()

    def rows(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for item, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = text.split(" ")
                if len(words) < MIN_WALKED:
                    h, parts = hashed(words, Memo()), phrase_parts(len(words), max_edits)
                    key = np.array([phrase_keys(h[at : at + n], n)[0] for at, n in parts])
                    yield pa.record_batch([pa.array(key.view(np.int64)), pa.array([at for at, _ in parts], pa.int32()), pa.array([item] * len(parts), pa.int64())], names=["key", "skip", "item_id"])
                    continue
                starts = item_starts(len(words), max_edits)
                real = np.zeros((WALKS * SAMPLES, len(starts)), dtype=np.int64)
                keys = walks.keys(walks.laid([hashed(words, Memo())])[0], starts, len(words), real).view(np.int64)
                window, row = np.nonzero(real.T >= REAL_WORDS)
                yield pa.record_batch([pa.array(keys[window, row]), pa.array(starts[window], pa.int32()), pa.array([item] * len(window), pa.int64())], names=["key", "skip", "item_id"])

    return items.mapInArrow(rows, "key long, skip int, item_id long")


def _key_table(keyed: DataFrame, shift: int) -> np.ndarray:
    """Bits that are set where the keys, without their lowest `shift` bits, fall."""
    spot = F.pmod(F.shiftright("key", shift), F.lit(FILTER_BITS))
    longs = keyed.select(F.shiftright(spot, 6).alias("at"), F.expr(f"shiftleft(1L, cast(pmod(shiftright(key, {shift}), {FILTER_BITS}) & 63 as int))").alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("bits")).toPandas()
    table = np.zeros(FILTER_BITS // 64, dtype=np.uint64)
    table[longs["at"].to_numpy(dtype=np.int64)] = longs["bits"].to_numpy(dtype=np.int64).view(np.uint64)
    return table


def _in_table(table: np.ndarray, keys: np.ndarray, shift: int) -> np.ndarray:
    spots = ((keys >> shift) % FILTER_BITS).view(np.uint64)
    return (table[(spots >> np.uint64(6)).view(np.int64)] >> (spots & np.uint64(63))) & np.uint64(1) == 1


def leaks(docs: DataFrame, items: DataFrame, max_edits: float = MAX_EDITS, id_type: str = "long") -> DataFrame:
    """(doc_id, item_id, edits, item_words, start_word, n_words): where a text holds an item or a near copy of it.

    Words are runs of letters, digits and underscores, in lower case. A copy is a span of at most max_edits * words of the item insertions, removals or
    replacements of words; of an item's copies in a document the nearest is returned, the first among equals.
    Items under MIN_WORDS words are found without edits, as phrases. Null texts and items without words have no copies. Equal doc_ids are one document; an item_id with several
    texts stands for each of them, a null item_id too. Rows without doc_id are left out here, but not in `clean`. doc_id is cast to id_type.

    Windows whose keys may be an item's (by two tables of fixed size that tasks hold) go on to the join, with the words around them;
    the exact edit distance then decides.
    """
    spark = docs.sparkSession
    known = written(_item_words(items), "items")
    longest = known.agg(F.max(F.size(F.split("words", " ")))).first()[0]
    if longest is None:
        return spark.createDataFrame([], f"doc_id {id_type}, item_id long, edits int, item_words int, start_word int, n_words int")
    sizes = [r[0] for r in known.select(F.size(F.split("words", " ")).alias("n")).where(F.col("n") < MIN_WALKED).distinct().collect()]  # lengths of short items
    phrases = {n: size < MIN_WORDS for size in sorted(sizes) for _, n in phrase_parts(size, max_edits)}  # and of their parts: are they only whole items?
    ids = pa.int64() if id_type == "long" else pa.string()
    keyed = written(_item_keys(known, max_edits), "item-keys")
    sent = spark.sparkContext.broadcast([_key_table(keyed, 0), _key_table(keyed, _SECOND)])
    fewest = min([*phrases, MIN_WORDS - MAX_SHORT])
    walks, margin = Walks(), int(longest * (1 + max_edits)) + WALK_WORDS // 2

    def windows(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (first, second), memo = sent.value, Memo()

        def walked(texts: list[tuple[int, list[str]]]) -> pa.RecordBatch | None:
            """Probes of some texts, whose windows are walked over together."""
            h, begins = walks.laid([hashed(w, memo) for _, w in texts])
            ends = begins + np.array([len(w) for _, w in texts])
            starts = np.concatenate([np.arange(a, z, STRIDE) for a, z in zip(begins.tolist(), ends.tolist(), strict=True)])
            keys = walks.keys(h, starts).view(np.int64)
            at, which = np.nonzero(_in_table(first, keys, 0))
            both = _in_table(second, keys[at, which], _SECOND)
            found, key = [starts[at[both]]], [keys[at[both], which[both]]]
            for n, whole in phrases.items():
                keys = phrase_keys(h, n).view(np.int64)
                at = np.flatnonzero(_in_table(first, keys, 0))
                at = at[_in_table(second, keys[at], _SECOND)]
                text = np.searchsorted(begins, at, side="right") - 1
                inside = at + n <= ends[text]
                at, text = at[inside], text[inside]
                if whole:  # it counts where it first stands in a text
                    at = at[np.unique(np.stack([text, keys[at]]), axis=1, return_index=True)[1]]
                found.append(at)
                key.append(keys[at])
            start, key = np.concatenate(found), np.concatenate(key)
            if not len(start):
                return None
            order = np.argsort(start, kind="stable")
            start, key = start[order], key[order]
            start, begun = np.unique(start, return_index=True)
            own = pa.ListArray.from_arrays(pa.array(np.append(begun, len(key)), pa.int32()), pa.array(key))
            of = np.searchsorted(begins, start, side="right") - 1
            pos = start - begins[of]
            lows = np.maximum(0, pos - margin)
            around = [" ".join(texts[t][1][lo : p + margin]) for t, lo, p in zip(of.tolist(), lows.tolist(), pos.tolist(), strict=True)]
            return pa.record_batch([pa.array([texts[t][0] for t in of.tolist()], ids), own, pa.array(pos, pa.int32()), pa.array(lows, pa.int32()), pa.array(around)], names=["doc_id", "keys", "pos", "low", "around"])

        for b in it:
            texts, held = [], 0
            for i in range(b.num_rows):
                words = words_of((b.column(1)[i].as_py() or b"").decode("utf-8", "replace"))
                if len(words) < fewest:
                    continue
                texts.append((b.column(0)[i].as_py(), words))
                held += len(words)
                if held >= PIECE:
                    if (out := walked(texts)) is not None:
                        yield out
                    texts, held = [], 0
            if texts and (out := walked(texts)) is not None:
                yield out

    probes = docs.where("doc_id is not null").select(F.col("doc_id").cast(id_type), F.col("text").cast("binary")).mapInArrow(windows, f"doc_id {id_type}, keys array<long>, pos int, low int, around string")
    probes = written(probes, "windows")
    begin = (F.col("pos") - F.col("skip")).alias("begin")
    places = probes.select("doc_id", "pos", F.explode("keys").alias("key")).join(keyed, "key").groupBy("doc_id", "item_id", begin).agg(F.min("pos").alias("pos"))
    held = places.join(probes.drop("keys").distinct(), ["doc_id", "pos"]).withColumnRenamed("item_id", "of_item")
    pairs = held.join(known, F.col("of_item").eqNullSafe(F.col("item_id"))).select("doc_id", "item_id", "begin", "low", "around", "words")

    def verified(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "item_id", "edits", "item_words", "start_word", "n_words"]
        split: dict[str, tuple[list[str], Counter[str]]] = {}
        for b in it:
            out = []
            if len(split) > 10_000:
                split.clear()
            for doc, item, begin, low, around, words in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if words not in split:
                    split[words] = (own := words.split(" ")), Counter(own)
                own, bag = split[words]
                most = allowed(len(own), max_edits)
                slack = most + (WALK_WORDS // 2 if len(own) >= MIN_WALKED else 0)  # walks may meet out of step
                near = max(low, begin - slack)
                text = around.split(" ")[near - low : begin + len(own) + slack - low]
                if may_hold(bag, len(own), text, most) and (found := best_span(own, text, most)):
                    out.append((doc, item, found[0], len(own), near + found[1], found[2] - found[1]))
            if out:
                kinds = [ids, pa.int64(), *[pa.int32()] * 4]
                yield pa.record_batch([pa.array(c, k) for k, c in zip(kinds, zip(*out, strict=True), strict=True)], names=names)

    schema = f"doc_id {id_type}, item_id long, edits int, item_words int, start_word int, n_words int"
    best = F.min(F.struct("edits", "start_word", "n_words", "item_words")).alias("best")
    return pairs.mapInArrow(verified, schema).groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.edits", "best.item_words", "best.start_word", "best.n_words")


def clean(docs: DataFrame, items: DataFrame, max_edits: float = MAX_EDITS) -> DataFrame:
    """The rows of docs without a copy of an item; columns as in docs. Equal doc_ids are one document; rows without one are told apart by their text."""
    name = F.coalesce(F.concat(F.lit("id"), F.col("doc_id").cast("string")), F.concat(F.lit("text"), F.sha2(F.coalesce("text", F.lit("")), 256)))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), name.alias("name"))
    found = leaks(docs.select(name.alias("doc_id"), "text"), items, max_edits, "string").select(F.col("doc_id").alias("name")).distinct()
    return rows.join(found, "name", "left_anti").select(*[F.col(f"row.`{c}`") for c in docs.columns])
