"""Operator 9: token ids packed best-fit-decreasing, as binary matrices.

Documents become ids with an end id; those longer than a row are cut without
loss. Pieces are packed longest first, each into the row with the least room
that still takes it, which a segment tree over room sizes finds in
``log2(size)`` steps. A task packs its rows in chunks of ``chunk_tokens`` ids,
so its memory is bounded, whatever the size of a partition.

A row of the matrix is ``size`` ids (little-endian, 16 bits if the vocabulary
allows, else 32), padded with the end id. ``cu_seqlens`` are the cumulative
segment lengths, from 0; positions start anew at each of them but the last.

Defined results: a null or empty text is the end id alone; repeated rows are
packed each for itself; an empty table gives no rows; further columns are
ignored.
"""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import map_batches
from ..storage import delete, shared_dir
from .common import table
from .tokens import VOCABULARY, ids_of, vocabulary_path

SIZE, END_ID, CHUNK_TOKENS = 2048, 50256, 1 << 22
SCHEMA = "sequence_id long, input_ids binary, n_tokens int, cu_seqlens array<int>, doc_ids array<long>, starts array<long>"


class Rooms:
    """Segment tree over room sizes 0..size; a leaf counts the rows with that room."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(size + 1)]

    def add(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        k = self.leaves + room
        while k:
            self.count[k] += 1
            k >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """Remove and return (room, row) of the least room of at least ``need``."""
        k, count = self.leaves + need, self.count
        while not count[k]:
            while k & 1:  # up, past right children
                k >>= 1
            if k <= 1:
                return None
            k += 1
            if k & (k - 1) == 0:  # wrapped to the next level's first node
                return None
        while k < self.leaves:
            k = 2 * k if count[2 * k] else 2 * k + 1
        room = k - self.leaves
        row = self.rows[room].pop()
        while k:
            count[k] -= 1
            k >>= 1
        return room, row


def pack_decreasing(lengths: list[int], size: int) -> list[list[int]]:
    """Rows of piece numbers: best-fit-decreasing, ties in order of arrival."""
    rooms, rows = Rooms(size), []
    for k in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        found = rooms.take(lengths[k])
        if found is None:
            rows.append([k])
            room, row = size, len(rows) - 1
        else:
            room, row = found
            rows[row].append(k)
        if room > lengths[k]:
            rooms.add(room - lengths[k], row)
    return rows


def packed_rows(docs: DataFrame, size: int = SIZE, vocabulary: str = VOCABULARY, end_id: int = END_ID, chunk_tokens: int = CHUNK_TOKENS) -> DataFrame:
    """One row for each packed row of ids, see ``SCHEMA``."""
    kind = "<u2" if end_id < 1 << 16 else "<u4"

    def pack(pieces: list[tuple], first_id: int) -> pa.RecordBatch:
        end = np.array([end_id], kind).tobytes()
        width = len(end)
        columns: list[list] = [[] for _ in range(6)]
        for number, row in enumerate(pack_decreasing([len(p[2]) // width for p in pieces], size)):
            own = [pieces[k] for k in row]
            ids = b"".join(p[2] for p in own)
            ends = np.cumsum([0, *(len(p[2]) // width for p in own)]).tolist()
            for column, value in zip(columns, (first_id + number, ids + end * (size - ends[-1]), ends[-1], ends, [p[0] for p in own], [p[1] for p in own]), strict=True):
                column.append(value)
        kinds = (pa.int64(), pa.binary(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["sequence_id", "input_ids", "n_tokens", "cu_seqlens", "doc_ids", "starts"])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, next_id = vocabulary_path(vocabulary), TaskContext.get().partitionId() << 40
        pieces, held = [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.append(ids_of(text.as_py(), path), np.uint32(end_id)).astype(kind)
                for start in range(0, len(ids), size):
                    pieces.append((doc_id, start, ids[start : start + size].tobytes()))
                held += len(ids)
                if held >= chunk_tokens:
                    out = pack(pieces, next_id)
                    yield out
                    next_id, pieces, held = next_id + out.num_rows, [], 0
        if pieces:
            yield pack(pieces, next_id)

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), kernel, SCHEMA)


def position_resets(cu_seqlens: Column) -> Column:
    """Offsets in a row at which positions start at 0 again."""
    return F.slice(cu_seqlens, 1, F.size(cu_seqlens) - 1)


def write_packed(docs: DataFrame, path: str, **options) -> DataFrame:
    """Write the packed rows under ``path`` (Parquet with one fixed-length binary a
    row, committed as a whole by Spark) and return them as read back."""
    packed_rows(docs, **options).withColumn("position_resets", position_resets(F.col("cu_seqlens"))).write.parquet(path)
    return docs.sparkSession.read.parquet(path)


def op9_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/packed-{uuid.uuid4().hex}"
    atexit.register(delete, spark, folder)
    rows = write_packed(table(spark, sf_dir, "documents"), folder)
    return rows.select("sequence_id", "n_tokens", F.crc32("input_ids").alias("row_crc32"), F.octet_length("input_ids").alias("row_bytes"), "cu_seqlens", "position_resets", "doc_ids", "starts")
