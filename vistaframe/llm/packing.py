"""Operator 3: bounded-space online packing.

Every partition keeps at most ``windows`` open windows of ``size`` tokens. A
piece goes to the open window that it fits best. If none fits and all windows
are in use, the fullest is emitted and a new one opened. A document longer than
a window is first cut to fill the fullest open one, then into whole windows and
a rest.

What stays open at the end of a partition is merged: the pieces of ``fan_in``
neighbouring partitions' leftovers are packed again by the same rule, round
after round, until one group is left, whose last open windows are poured
together (a piece may be cut there, so one sequence at most stays short). A
group holds ``fan_in * windows`` windows at most, so no task ever gathers an
unbounded number of rows.

Defined results: a null or empty text is the single end id; repeated rows are
packed each for itself; an empty table gives no rows; further columns are
ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import map_batches
from ..storage import written
from .common import table
from .tokens import VOCABULARY, ids_of, vocabulary_path

SIZE, WINDOWS, FAN_IN, END_ID = 1024, 64, 256, 0
#: The least piece that fills a window with the head of a longer document.
LEAST_CUT = 8

SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, part long, open boolean"
_ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("part", pa.int64()), ("open", pa.bool_())])


class OpenWindows:
    """The open windows of one partition, by free space; best fit, fullest out."""

    def __init__(self, size: int, windows: int, first_id: int):
        self.size, self.windows, self.next_id = size, windows, first_id
        self.free: list[tuple[int, int]] = []  # (free tokens, window), ascending
        self.held: dict[int, list[tuple]] = {}

    def _open(self) -> int:
        self.next_id += 1
        self.held[self.next_id - 1] = []
        return self.next_id - 1

    def place(self, piece: tuple) -> Iterator[tuple[int, list[tuple]]]:
        """Put a piece (doc_id, start, length, ids, doc_tokens) away; yields what is emitted."""
        need = piece[2]
        at = bisect_left(self.free, (need, -1))
        if at < len(self.free):
            free, window = self.free.pop(at)
        else:
            if len(self.free) >= self.windows:
                _, fullest = self.free.pop(0)
                yield fullest, self.held.pop(fullest)
            free, window = self.size, self._open()
        self.held[window].append(piece)
        if free == need:
            yield window, self.held.pop(window)
        else:
            insort(self.free, (free - need, window))

    def gap(self, least: int) -> int:
        """Free tokens of the fullest open window with ``least`` or more; 0 if there is none."""
        at = bisect_left(self.free, (least, -1))
        return self.free[at][0] if at < len(self.free) else 0

    def rest(self) -> Iterator[tuple[int, list[tuple]]]:
        for _, window in self.free:
            yield window, self.held.pop(window)
        self.free = []

    def poured(self) -> Iterator[tuple[int, list[tuple]]]:
        """The open windows merged for good: poured into whole windows, the
        fullest first, and a piece cut where a window ends."""
        pieces = [p for _, held in self.rest() for p in held]
        window, room = [], self.size
        for doc_id, start, length, ids, doc_tokens in pieces:
            while length:
                n = min(length, room)
                window.append((doc_id, start, n, ids and ids[: 4 * n], doc_tokens))
                start, length, ids, room = start + n, length - n, ids and ids[4 * n :], room - n
                if not room:
                    self.next_id += 1
                    yield self.next_id - 1, window
                    window, room = [], self.size
        if window:
            self.next_id += 1
            yield self.next_id - 1, window


class _Rows:
    """Collects emitted windows as columns and hands out Arrow batches."""

    def __init__(self, part: int):
        self.part, self.columns, self.tokens = part, [[] for _ in _ARROW], 0

    def add(self, window: int, pieces: list[tuple], is_open: bool) -> None:
        offset = 0
        for doc_id, start, length, ids, doc_tokens in pieces:
            for column, value in zip(self.columns, (doc_id, start, length, ids, doc_tokens, window, offset, self.part, is_open), strict=True):
                column.append(value)
            offset += length
        self.tokens += offset

    def batch(self) -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(self.columns, _ARROW, strict=True)], schema=_ARROW)
        self.columns, self.tokens = [[] for _ in _ARROW], 0
        return out


def _first(size: int, windows: int, vocabulary: str, with_ids: bool):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, part = vocabulary_path(vocabulary), TaskContext.get().partitionId()
        packer, out, end = OpenWindows(size, windows, part << 32), _Rows(part), np.array([END_ID], "<u4")
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.concatenate([ids_of(text.as_py(), path), end])
                total = len(ids)
                # a document that must be cut anyway is first cut to fill the fullest window
                head = packer.gap(LEAST_CUT) if total > size else 0
                for start in [*([0] if head else []), *range(head, total, size)]:
                    cut = ids[start : start + (head if start < head else size)]
                    for window, pieces in packer.place((doc_id, start, len(cut), cut.tobytes() if with_ids else None, total)):
                        out.add(window, pieces, False)
                if out.tokens >= 1 << 20:
                    yield out.batch()
        for window, pieces in packer.rest():
            out.add(window, pieces, True)
        yield out.batch()

    return kernel


def _again(size: int, windows: int, first_id: int, last: bool):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, packer, out = None, None, None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[0] != group:
                    if group is not None:
                        for window, pieces in packer.poured() if last else packer.rest():
                            out.add(window, pieces, not last)
                        yield out.batch()
                    group = row[0]
                    packer, out = OpenWindows(size, windows, first_id + (group << 32)), _Rows(group)
                for window, pieces in packer.place(row[1:6]):
                    out.add(window, pieces, False)
            if out is not None and out.tokens >= 1 << 20:
                yield out.batch()
        if group is not None:
            for window, pieces in packer.poured() if last else packer.rest():
                out.add(window, pieces, not last)
            yield out.batch()

    return kernel


def pack(docs: DataFrame, size: int = SIZE, windows: int = WINDOWS, fan_in: int = FAN_IN, vocabulary: str = VOCABULARY, with_ids: bool = True) -> DataFrame:
    """Packed pieces of all documents: doc_id, start, length, ids (little-endian
    unsigned 32-bit), doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    state = written(map_batches(docs.select(F.col("doc_id").cast("long"), "text"), _first(size, windows, vocabulary, with_ids), SCHEMA), "packed")
    done = [state.where(~F.col("open"))]
    parts = int(state.agg(F.coalesce(F.max("part"), F.lit(-1))).first()[0]) + 1
    level = 0
    while parts:
        level, parts = level + 1, -(-parts // fan_in)
        left = state.where("open").select(F.expr(f"part div {fan_in}").alias("g"), "doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset")
        dealt = left.repartition(min(parts, 4096), "g").sortWithinPartitions("g", "sequence_id", "offset")
        packed = map_batches(dealt.select("g", "doc_id", "start", "length", "ids", "doc_tokens"), _again(size, windows, level << 56, parts == 1), SCHEMA)
        if parts == 1:
            done.append(packed)
            break
        state = written(packed, "packed")
        done.append(state.where(~F.col("open")))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.drop("part", "open")


def padding(pieces: DataFrame, size: int = SIZE) -> DataFrame:
    """Sequences, tokens and padding; a length that is a power of two is not padded."""
    by = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    whole = F.bit_count(F.col("n")) == 1
    return by.agg(F.count("*").alias("sequences"), F.sum("n").alias("tokens"), F.sum(F.when(whole, 0).otherwise(size - F.col("n"))).alias("padding"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents")).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
