"""Packing token sequences: bounded-space online best fit, then a merge of leftovers.

Each task keeps a fixed number of open windows. A piece goes to the window it
fills best; where it fits none, the fullest window is emitted and a fresh one
opened. Documents longer than a window are cut into full windows and one rest.
What is still open at the end of a task is repacked, best fit in descending
order, with the leftovers of a few neighbouring tasks: their number is bounded
by the open windows, not by the data.

A NULL or empty text is its end id alone. Repeated rows are packed each on
their own, NULL ids are kept; an empty table gives no pieces.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage
from .common import hand_back
from .units import unit_encoder

PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
MERGED = 1 << 62  # sequence ids of merged leftovers start here


class Windows:
    """Windows of ``size`` tokens, at most ``limit`` of them open."""

    def __init__(self, size: int, limit: int):
        self.size, self.limit = size, limit
        self.room: list[tuple[int, int]] = []  # (free tokens, window), ascending
        self.content: dict[int, list] = {}
        self.made = 0

    def place(self, length: int, piece: tuple) -> tuple[int, list] | None:
        """Puts a piece somewhere; returns a window that had to be emitted, or is full."""
        emitted = None
        at = bisect_left(self.room, (length, -1))
        if at < len(self.room):
            free, window = self.room.pop(at)
        else:
            if len(self.room) >= self.limit:
                _, full = self.room.pop(0)
                emitted = (full, self.content.pop(full))
            free, window = self.size, self.made
            self.made += 1
            self.content[window] = []
        self.content[window].append((piece, self.size - free))
        if free > length:
            insort(self.room, (free - length, window))
            return emitted
        # never both: an emission opens a fresh window, and full-size pieces bypass this class
        return window, self.content.pop(window)


class _Rows:
    def __init__(self):
        self.columns: list[list] = [[] for _ in range(8)]

    def add(self, piece: tuple, sequence: int, offset: int, is_open: bool) -> None:
        for column, value in zip(self.columns, (*piece, sequence, offset, is_open)):
            column.append(value)

    def batch(self) -> pa.RecordBatch:
        kinds = [pa.int64()] * 7 + [pa.bool_()]
        names = [f.split()[0] for f in PIECES.split(", ")] + ["open"]
        out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(self.columns, kinds)], names=names)
        self.__init__()
        return out


def pack(docs: DataFrame, tokenizer: str, window: int = 2048, end_id: int = 1, open_windows: int = 64, merge_tasks: int = 16,
         doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: see ``PIECES``.

    ``tokenizer`` is the path of a tokenizers file on every executor. The
    leftovers of ``merge_tasks`` consecutive tasks are merged together.
    """

    def run(batches):
        encoder = unit_encoder(tokenizer)
        task = TaskContext.get().partitionId() << 32
        # sequence numbers of full windows and of shared windows interleave by parity
        shared, alone, rows = Windows(window, open_windows), 0, _Rows()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                for name, ids in zip(part.column(0).to_pylist(), encoder.encode(part.column(1).to_pylist())):
                    ids += end_id.to_bytes(4, "little")
                    total = len(ids) // 4
                    for start in range(0, total, window):
                        end = min(total, start + window)
                        piece = (name, start, end - start, zlib.crc32(ids[4 * start : 4 * end]), total)
                        if end - start == window:
                            rows.add(piece, task + 2 * alone, 0, False)
                            alone += 1
                        elif done := shared.place(end - start, piece):
                            for inner, offset in done[1]:
                                rows.add(inner, task + 2 * done[0] + 1, offset, False)
                if len(rows.columns[0]) > 50_000:
                    yield rows.batch()
        for number, content in shared.content.items():
            for piece, offset in content:
                rows.add(piece, task + 2 * number + 1, offset, True)
        yield rows.batch()
        # the worker outlives the task
        encoder.ids.clear()
        hand_back()

    texts = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    pieces = cut_lineage(texts.mapInArrow(run, f"{PIECES}, open boolean"))

    def merge(table: pa.Table) -> pa.Table:
        group = (table.column("task")[0].as_py() << 32) + MERGED
        items = sorted(zip(*[table.column(c).to_pylist() for c in ("length", "doc_id", "start", "ids_crc32", "doc_tokens")]),
                       key=lambda r: (-r[0], r[1] is None, r[1] or 0, r[2], r[3]))
        shared, rows = Windows(window, len(items)), _Rows()
        for length, name, start, crc, total in items:
            if done := shared.place(length, (name, start, length, crc, total)):
                for piece, offset in done[1]:
                    rows.add(piece, group + done[0], offset, False)
        for number, content in shared.content.items():
            for piece, offset in content:
                rows.add(piece, group + number, offset, False)
        return pa.Table.from_batches([rows.batch()]).drop_columns(["open"])

    leftovers = pieces.where("open").withColumn("task", F.floor(F.shiftright("sequence_id", 32) / merge_tasks).cast("bigint"))
    merged = leftovers.groupBy("task").applyInArrow(merge, PIECES)
    return pieces.where("not open").drop("open").unionByName(merged)
