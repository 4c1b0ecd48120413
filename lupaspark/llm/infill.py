"""Fill-in-the-middle documents: texts are cut at tokens that a hash of their id draws, and their three parts are put in another order behind sentinels.

A text is cut into chunks that its content defines (rolling hash). A chunk's summary says how many runs of non-blanks and code points it
holds and whether it begins and ends inside a run; summaries of neighbours combine to counts of the whole text. Chunks that texts share are
summed up once a Python worker: the cache is keyed by the chunk's bytes themselves, so that a hit is verified by content. A
cut is located by the chunks' running counts; only the chunk that it falls into is read again.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lupaspark.llm import rolling

SEED = 42
#: Mean and largest bytes of a chunk; bytes of chunks that a worker's cache holds.
MEAN, MOST, CACHE = 512, 8192, 32 << 20
SENTINELS = (b"<P>", b"<S>", b"<M>")
RUN, BLANK = re.compile(rb"[^\x20\x09-\x0D]+"), re.compile(rb"[\x20\x09-\x0D]")
BLANKS = frozenset(b" \t\n\v\f\r")
#: Bytes that continue a code point in UTF-8.
CONTINUATION = bytes(range(0x80, 0xC0))


def code_points(data: bytes) -> int:
    return len(data.translate(None, CONTINUATION))


def summary(chunk: bytes) -> tuple[int, int, bool, bool]:
    """(runs of non-blanks, code points, begins in a run, ends in a run)."""
    return len(chunk.split()), code_points(chunk), chunk[0] not in BLANKS, chunk[-1] not in BLANKS


class Summaries:
    """Summaries by content. Emptied when its chunks hold over `most` bytes: that costs time, never results."""

    def __init__(self, most: int = CACHE):
        self.most, self.held, self.known, self.hits = most, 0, {}, 0

    def get(self, chunk: bytes) -> tuple[int, int, bool, bool]:
        s = self.known.get(chunk)
        if s is None:
            if self.held + len(chunk) > self.most:
                self.known, self.held = {}, 0
            s = self.known[chunk] = summary(chunk)
            self.held += len(chunk)
        else:
            self.hits += 1
        return s


class Counted:
    """A text's counts, combined from its chunks' summaries."""

    def __init__(self, text: bytes, cuts: list[int], summaries: Summaries):
        """cuts: ascending offsets inside the text, its end the last."""
        self.text, self.starts, self.runs_before, self.chars_before, self.joined = text, [], [], [], []
        runs = chars = at = 0
        closed = False
        for cut in cuts:
            while at < cut:  # no chunk is over MOST bytes
                chunk = text[at : min(cut, at + MOST)]
                n, c, opens, closes = summaries.get(chunk)
                self.starts.append(at)
                self.runs_before.append(runs)
                self.chars_before.append(chars)
                self.joined.append(closed and opens)
                runs, chars, closed, at = runs + n - (closed and opens), chars + c, closes, at + len(chunk)
        self.runs = runs
        #: Tokens: each run with the blanks before it, and blanks at the end.
        self.n = runs + bool(text and not closed)

    def end_of(self, token: int) -> tuple[int, int]:
        """(offset, code points before it) of the end of the token-th token; of the text's beginning for 0."""
        if token == 0:
            return 0, 0
        k = bisect_left(self.runs_before, token) - 1 if token <= self.runs else len(self.starts) - 1  # the chunk in which the token's run begins
        at, end = self.starts[k], len(self.text)
        if token <= self.runs:
            stop = self.starts[k + 1] if k + 1 < len(self.starts) else end
            nth = token - self.runs_before[k] + self.joined[k]
            run = next(islice(RUN.finditer(self.text, at, stop), nth - 1, nth))
            end = run.end()
            if end == stop:  # it may go on in the next chunks
                blank = BLANK.search(self.text, end)
                end = blank.start() if blank else len(self.text)
        return end, self.chars_before[k] + code_points(self.text[at:end])


def draws(doc_id: int | None, seed: int = SEED) -> list[int]:
    """h1 to h4: the first 8-digit groups of the hex SHA-256 of `seed:doc_id`; no id, nothing after the colon."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[i : i + 4], "big") for i in (0, 4, 8, 12)]


def arranged(counted: Counted, h: list[int], rate: int, spm: int) -> tuple[str, int | None, int | None, bytes]:
    """(form, code points of the prefix, of the middle, output)."""
    text = counted.text
    if not text or h[2] % 100 >= rate or any(s in text for s in SENTINELS):
        return "plain", None, None, text
    a, b = sorted((h[0] % (counted.n + 1), h[1] % (counted.n + 1)))
    (a, before), (b, within) = counted.end_of(a), counted.end_of(b)
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    p, s, m = SENTINELS
    if h[3] % 100 < spm:
        return "spm", before, within - before, b"".join([s, suffix, p, prefix, m, middle])
    return "psm", before, within - before, b"".join([p, prefix, s, suffix, m, middle])


def cut_points(column: pa.Array) -> Iterator[tuple[bytes, list[int]]]:
    """Each text of a batch with its cuts; the batch is hashed as one buffer, and windows that reach over a text's beginning cut nothing."""
    texts = [t.as_py() or b"" for t in column]
    found = rolling.cuts(np.frombuffer(b"".join(texts), dtype=np.uint8), MEAN)
    ends = np.cumsum([len(t) for t in texts])
    first = np.searchsorted(found, ends - [len(t) for t in texts] + rolling.WINDOW, side="left")
    last = np.searchsorted(found, ends, side="left")
    for t, end, i, j in zip(texts, ends.tolist(), first.tolist(), last.tolist()):
        yield t, [*(found[i:j] - (end - len(t))).tolist(), len(t)]


_summaries = Summaries()


def transformed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, rate: int = 50, spm: int = 80) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of every row, in one narrow pass.

    n: tokens. form: plain, psm or spm; rate: texts of 100 that are rearranged; spm: of 100 of those, the ones whose suffix comes first. A null text is empty; an empty
    text, and one that holds a sentinel, stays plain. Rows that repeat an id and text are rearranged alike. A row without doc_id is drawn for as one with an empty id.
    """

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            out = []
            for i, (text, cuts) in zip(b.column(0).to_pylist(), cut_points(b.column(1))):
                counted = Counted(text, cuts, _summaries)
                out.append((i, counted.n, *arranged(counted, draws(i, seed), rate, spm)))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary())
            columns = list(zip(*out)) or [()] * len(kinds)
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    out = picked.mapInArrow(batches, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output binary")
    return out.withColumn("output", F.col("output").cast("string"))


def restored(form: Column, output: Column) -> Column:
    """The text, from form and output alone: parts hold no sentinel, and none can arise where a part and a sentinel meet."""
    part = F.split(output, "<P>|<S>|<M>", -1)
    at = lambda k: F.get(part, F.lit(k))
    return F.when(form == "plain", output).when(form == "psm", F.concat(at(1), at(3), at(2))).otherwise(F.concat(at(2), at(3), at(1)))
