"""Ordered folds inside a section: parents and the items that add up to them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Segments:
    """The fold's state: rows from the first that may still be a parent on. No more rows are held than one parent's items."""

    def __init__(self) -> None:
        self.rows: list[tuple] = []

    def add(self, row: tuple) -> Iterator[tuple]:
        self.rows.append(row)
        yield from self.settle(False)

    def settle(self, ended: bool) -> Iterator[tuple]:
        """Rows whose place is certain: (label, value, index, parent, items)."""
        while self.rows:
            label, value, _ = self.rows[0]
            slack, total, closed, over = max(1.0, abs(value) * 1e-6), 0.0, 0, False
            for k, (_, v, _) in enumerate(self.rows[1:], 1):
                over = total + v > value + slack
                if over:
                    break
                total += v
                if abs(total - value) <= slack:
                    closed = k
                    break
            if closed:
                yield (*self.rows[0], None, closed)
                for r in self.rows[1 : closed + 1]:
                    yield (*r, label, None)
                self.rows = self.rows[closed + 1 :]
            elif over or ended:
                yield (*self.rows[0], None, None)
                self.rows = self.rows[1:]
            else:
                return


def segment_by_sum(df: DataFrame, section: str, order: list[str], label: str, value: str) -> DataFrame:
    """Df with `parent`, the label of the row whose value the rows after it add up to, and `items`, their number, on that row.

    Rows of a section are read in order. A row is a parent if those behind it reach its value, within a millionth or one unit; their run ends there and
    the next row may be a parent again. Rows that close nothing stand alone. A null value counts as zero. Sections are dealt over tasks, sorted there and folded as a stream with a
    carry, so that a section of any length takes the memory of one parent's items. Columns named parent and items are replaced.
    """
    df = df.drop("parent", "items")
    order_by = [section, *order]
    names = df.columns
    place, at, worth = names.index(section), names.index(label), names.index(value)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, now, held = Segments(), None, []

        def out(done: list[tuple]) -> pa.RecordBatch:
            """The first rows held, in order, with what is known of them."""
            nonlocal held
            rows = pa.Table.from_batches(held)
            head, held = rows.slice(0, len(done)), rows.slice(len(done)).to_batches()
            head = head.append_column("parent", pa.array([d[3] for d in done], pa.string())).append_column("items", pa.array([d[4] for d in done], pa.int32()))
            return head.combine_chunks().to_batches()[0]

        for b in it:
            held.append(b)
            done = []
            for s, x, v in zip(b.column(place).to_pylist(), b.column(at).to_pylist(), b.column(worth).to_pylist()):
                if s != now:
                    done += state.settle(True)
                    now = s
                done += state.add((None if x is None else str(x), float(v or 0), None))
            if done:
                yield out(done)
        done = list(state.settle(True))
        if done:
            yield out(done)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.repartition(section).sortWithinPartitions(*order_by).mapInArrow(batches, f"{fields}, parent string, items int")
