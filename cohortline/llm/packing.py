"""Packing by sums of squares: documents into windows of a fixed number of tokens.

Each task packs its own documents in one pass. A document's tokens end with ``end_id``. Whole windows are cut off
first; the rest, of ``s`` tokens, goes to the fill level ``h`` (an open window with ``h`` tokens, or a new one)
for which the sum of squares of the counts of open windows by fill level grows least, which keeps all levels
in use, so that complements can be found. At the end of a task the pieces in windows still open are joined and
cut anew into full windows, and the remainder into windows whose sizes are powers of two, so that nothing is padded
if those need no padding. A task holds the counts, the open windows and their pieces, nothing else.

Null texts are empty: such a document is its ``end_id`` alone. Null or repeated keys are packed like others; equal
rows are packed once each. No documents give no rows. Only the key and the text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from cohortline.llm import tokens

TASK_BITS = 33


class LevelArray:
    """Open windows by fill level, and the choice of level for a piece."""

    def __init__(self, limit: int):
        self.limit = limit
        self.counts = np.zeros(limit + 1, dtype=np.int64)
        self.open: list[list[int]] = [[] for _ in range(limit + 1)]
        self.made = 0

    def place(self, size: int) -> tuple[int, int, bool]:
        """Window, offset in it, and whether it is full now, of a piece of ``1 <= size <= limit`` tokens."""
        n = self.counts
        room = self.limit - size + 1  # levels 0 .. limit - size
        change = 1 - 2 * n[:room]  # a window leaves its level
        change[0] = 0
        change += 2 * n[size:] + 1  # and comes to another one
        change[-1] -= 2 * n[self.limit] + 1  # which doesn't count if it is full
        usable = n[:room] > 0
        usable[0] = True
        change = np.where(usable, change, np.iinfo(np.int64).max)
        level = room - 1 - int(np.argmin(change[::-1]))  # of equal ones, the fullest
        if level:
            window = self.open[level].pop()
            n[level] -= 1
        else:
            window, self.made = self.made, self.made + 1
        if level + size == self.limit:
            return window, level, True
        self.open[level + size].append(window)
        n[level + size] += 1
        return window, level, False


def powers_of_two(n: int) -> list[int]:
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


def pack_stream(documents: Iterator[tuple[object, np.ndarray]], limit: int):
    """Rows ``(key, start, ids, n_tokens, window, offset)`` of a stream of ``(key, ids)``."""
    levels = LevelArray(limit)
    held: dict[int, list] = {}
    for key, ids in documents:
        whole = len(ids) // limit * limit
        for start in range(0, whole, limit):
            yield key, start, ids[start:start + limit], len(ids), levels.made, 0
            levels.made += 1
        if whole < len(ids):
            piece = ids[whole:]
            window, offset, full = levels.place(len(piece))
            row = (key, whole, piece, len(ids), window, offset)
            if full:
                yield from held.pop(window, [])
                yield row
            else:
                held.setdefault(window, []).append(row)
    rest = [row for rows in held.values() for row in rows]
    total = sum(len(row[2]) for row in rest)
    sizes = iter([limit] * (total // limit) + powers_of_two(total % limit))
    room = offset = 0
    for key, start, ids, n, _, _ in rest:
        while len(ids):
            if not room:
                room, offset = next(sizes), 0
                levels.made += 1
            take = min(room, len(ids))
            yield key, start, ids[:take], n, levels.made - 1, offset
            start, ids, room, offset = start + take, ids[take:], room - take, offset + take


def pack(docs: DataFrame, tokenizer: str, limit: int = 1024, end_id: int = 0, key: str = "doc_id",
         text: str = "text") -> DataFrame:
    """One row per piece: key, ``start`` in its document, ``length``, ``ids`` (little-endian unsigned 32-bit numbers),
    ``doc_tokens``, ``sequence_id`` and ``offset``. Needs no shuffle."""
    narrow = docs.select(key, text)
    schema = T.StructType([T.StructField(key, narrow.schema[0].dataType),
                           *[T.StructField(c, T.LongType()) for c in ("start", "length")],
                           T.StructField("ids", T.BinaryType()),
                           *[T.StructField(c, T.LongType()) for c in ("doc_tokens", "sequence_id", "offset")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << TASK_BITS
        end = np.array([end_id], dtype="<u4")

        def documents():
            for batch in batches:
                texts = (x.as_py() for x in batch.column(1))
                for k, ids in zip(batch.column(0), tokens.encode(tokenizer, texts), strict=True):
                    yield k.as_py(), np.concatenate([ids, end])

        rows: list = []
        for row in pack_stream(documents(), limit):
            rows.append(row)
            if len(rows) == 2000:
                yield _batch(rows, kind, base)
                rows = []
        if rows:
            yield _batch(rows, kind, base)

    def _batch(rows, kind, base):
        keys, starts, ids, totals, windows, offsets = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays(
            [pa.array(keys, kind), pa.array(starts, pa.int64()), pa.array([len(x) for x in ids], pa.int64()),
             pa.array([x.tobytes() for x in ids], pa.binary()), pa.array(totals, pa.int64()),
             pa.array([base + w for w in windows], pa.int64()), pa.array(offsets, pa.int64())], names=names)

    from pyspark.sql.pandas.types import to_arrow_type

    kind, names = to_arrow_type(narrow.schema[0].dataType), schema.names
    return narrow.mapInArrow(run, schema)
