"""Packing of tokenised documents into windows of fixed length by the sum-of-squares rule.

A document's ids, then the end id, are cut into whole windows and a rest. The rest goes, on line, to the fill level
that makes the sum of squared counts of partially filled windows smallest; the counts are kept in an array by level,
as are the open windows. Ties go to the fullest level, then to a window already open.

Each input partition is a packer of its own: no shuffle, memory for the open windows only (at most `capacity` ids each),
and a lost task is simply done again. At the end of a partition the open windows are closed: the emptiest are cut up to
fill the fullest, and the last one is split into windows whose lengths are powers of two, which need no padding.

A null text is empty and so has the end id alone. A null id stays null; repeated rows are packed one by one. Empty
input gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokenizer
from .common import documents

CAPACITY = 2048
END_ID = 1
_ROWS = 20_000
_FIELDS = [(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]


class Packer:
    """Windows under construction. Pieces are (doc_id, start, ids, doc_tokens); closed windows are lists of pieces."""

    def __init__(self, capacity: int = CAPACITY):
        self.capacity = capacity
        self.count = np.zeros(capacity + 1, np.int64)  # of open windows by fill level; 0 at both ends
        self.open: dict[int, list[list]] = {}

    def choose(self, size: int) -> int:
        """The level to place a piece of this size on; 0 for a new window. Half the change of the sum of squares is compared."""
        n = self.count
        levels = np.flatnonzero(n[: self.capacity - size + 1])
        new = n[size] + 0.5 if size < self.capacity else 0.0
        if not len(levels):
            return 0
        change = (n[levels + size] - n[levels] + 1).astype(float)
        if levels[-1] + size == self.capacity:
            change[-1] -= 0.5
        best = len(change) - 1 - int(np.argmin(change[::-1]))
        return int(levels[best]) if change[best] <= new else 0

    def add(self, piece) -> list | None:
        """Place a piece; a window that it fills is returned."""
        size = len(piece[2])
        level = self.choose(size)
        window = self.open[level].pop() if level else []
        if level:
            self.count[level] -= 1
        window.append(piece)
        if level + size == self.capacity:
            return window
        self.count[level + size] += 1
        self.open.setdefault(level + size, []).append(window)
        return None

    def close(self) -> Iterator[list]:
        """The open windows, filled up from each other; the last in powers of two."""
        windows = [(level, w) for level in sorted(self.open, reverse=True) for w in self.open[level]]
        first, last = 0, len(windows) - 1
        gap = self.capacity - windows[0][0] if windows else 0
        while first < last:
            doc, start, ids, total = windows[last][1].pop()
            take = min(gap, len(ids))
            windows[first][1].append((doc, start + len(ids) - take, ids[len(ids) - take :], total))
            if take < len(ids):
                windows[last][1].append((doc, start, ids[: len(ids) - take], total))
            gap -= take
            if not windows[last][1]:
                last -= 1
            if not gap:
                yield windows[first][1]
                first += 1
                if first <= last:
                    gap = self.capacity - sum(len(p[2]) for p in windows[first][1])
        if first == last and windows:
            yield from self._powers(windows[first][1])
        self.open, self.count[:] = {}, 0

    @staticmethod
    def _powers(pieces: list) -> Iterator[list]:
        left = sum(len(p[2]) for p in pieces)
        pieces = pieces[::-1]
        while left:
            want = 1 << (left.bit_length() - 1)
            left, window = left - want, []
            while want:
                doc, start, ids, total = pieces.pop()
                window.append((doc, start, ids[:want], total))
                if len(ids) > want:
                    pieces.append((doc, start + want, ids[want:], total))
                want -= len(window[-1][2])
            yield window


def pack_rows(rows: Iterator[tuple], capacity: int) -> Iterator[list]:
    """rows: (doc_id, ids as a numpy array). Closed windows, in order."""
    packer = Packer(capacity)
    for doc, ids in rows:
        whole = len(ids) // capacity * capacity
        for at in range(0, whole, capacity):
            yield [(doc, at, ids[at : at + capacity], len(ids))]
        if whole < len(ids):
            # A copy, so that an open window does not hold on to all ids of a long document.
            if window := packer.add((doc, whole, ids[whole:].copy(), len(ids))):
                yield window
    yield from packer.close()


def pack_documents(docs: DataFrame, tokenizer_path: str | None = None, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids if wanted."""
    path = tokenizer_path or tokenizer.default_path()
    fields = _FIELDS + [("ids", pa.list_(pa.int32()))] * with_ids
    schema = pa.schema(fields)

    def pack(batches):
        bpe = tokenizer.load(path)

        def rows():
            for batch in batches:
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    yield doc, np.array(bpe.encode(text.as_py() or "") + [end_id], "<u4")

        out, sequence = [], TaskContext.get().partitionId() << 40
        for window in pack_rows(rows(), capacity):
            offset = 0
            for doc, start, ids, total in window:
                out.append((doc, start, len(ids), zlib.crc32(ids.tobytes()), total, sequence, offset, *([ids.astype(np.int32)] * with_ids)))
                offset += len(ids)
            sequence += 1
            if len(out) >= _ROWS:
                yield _batch(out, schema)
                out = []
        if out:
            yield _batch(out, schema)

    kinds = ", ".join(f"{n} bigint" for n, _ in _FIELDS) + ", ids array<int>" * with_ids
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(pack, kinds)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def query(spark, sf_dir):
    return pack_documents(documents(spark, sf_dir), with_ids=False)
