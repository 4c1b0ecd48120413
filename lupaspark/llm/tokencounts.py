"""Token counts by section: whole texts are encoded once and token spans are laid over section spans."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lupaspark.llm.bpe import as_text, shared_encoder

RULES = ("start", "end", "largest")
#: Section rows that a task gathers before it hands them on.
BATCH_ROWS = 20_000


def char_ends(text: str, byte_ends: np.ndarray) -> np.ndarray:
    """Character offset of each byte offset; within a character, its end."""
    raw = text.encode("utf-8", "replace")
    if len(raw) == len(text):
        return byte_ends
    leads = np.concatenate([[0], np.cumsum((np.frombuffer(raw, dtype=np.uint8) & 0xC0) != 0x80)])
    return leads[byte_ends]


def section_of(starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray, rule: str) -> np.ndarray:
    """Section of each token span; sections are [bounds[i], bounds[i + 1])."""
    first = np.searchsorted(bounds, starts, side="right") - 1
    last = np.maximum(np.searchsorted(bounds, ends, side="left") - 1, first)
    first, last = (np.clip(x, 0, len(bounds) - 2) for x in (first, last))
    if rule == "start":
        return first
    if rule == "end":
        return last
    out = first.copy()
    for t in np.flatnonzero(last > first):
        edges = np.concatenate([[starts[t]], bounds[first[t] + 1 : last[t] + 1], [ends[t]]])
        out[t] = first[t] + int(np.argmax(np.diff(edges)))
    return out


def attributed(docs: DataFrame, path: str, pattern: str, mark: str = "\n", rule: str = "start", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, section, start, stop, n_tokens, crossing, doc_tokens): a row for each section of each row's text.

    A section runs to a mark, which belongs to it; offsets count characters. The text is encoded whole, so a token may
    cross sections. It counts once: by rule 'start' where its first character lies, by 'end' where its last one lies, by 'largest' where
    most of its characters lie (the earliest among equals). A token that begins within a character starts at that
    character's end. crossing is the number of a section's tokens that reach beyond it. The counts of a text's sections add up to
    doc_tokens. Null and empty texts have one empty section. Repeated rows are returned each.
    """
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    encoder = shared_encoder(docs.sparkSession, path, pattern)
    names = ["doc_id", "section", "start", "stop", "n_tokens", "crossing", "doc_tokens"]

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder()
        rows: list[list[np.ndarray]] = []
        held, absent = 0, np.iinfo(np.int64).min

        def flush() -> pa.RecordBatch:
            cols = [np.concatenate(c) for c in zip(*rows, strict=True)]
            return pa.record_batch([pa.array(cols[0], pa.int64(), mask=cols[7]), *(pa.array(c, pa.int64()) for c in cols[1:7])], names=names)

        for b in it:
            for i in range(b.num_rows):
                text, doc = as_text(b.column(1)[i].as_py()), b.column(0)[i].as_py()
                sizes = [e.bytes[np.frombuffer(part, dtype="<u4")] for part in e.encode(text)]
                ends = char_ends(text, np.cumsum(np.concatenate(sizes))) if text else np.zeros(0, dtype=np.int64)
                starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
                cuts, at = [0], text.find(mark)
                while at >= 0:
                    cuts.append(at + len(mark))
                    at = text.find(mark, at + len(mark))
                if cuts[-1] < len(text) or len(cuts) == 1:
                    cuts.append(len(text))
                bounds = np.array(cuts, dtype=np.int64)
                n = len(bounds) - 1
                own = section_of(starts, ends, bounds, rule)
                over = (ends > bounds[own + 1]) | (starts < bounds[own]) if len(own) else own
                rows.append([np.full(n, absent if doc is None else doc), np.arange(n), bounds[:-1], bounds[1:], np.bincount(own, minlength=n), np.bincount(own, weights=over, minlength=n).astype(np.int64), np.full(n, len(ends)), np.full(n, doc is None)])
                held += n
                if held >= BATCH_ROWS:
                    yield flush()
                    rows, held = [], 0
        if rows:
            yield flush()

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return picked.mapInArrow(batches, ", ".join(f"{n} long" for n in names))
