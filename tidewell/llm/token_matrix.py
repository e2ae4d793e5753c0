"""Token-id matrices: documents packed by best-fit decreasing and written as rows of ids.

Each task packs what it reads, so ids are never shuffled. Documents longer than a row are split without loss
into row-long segments and a rest. A group of up to ``GROUP`` tokens is sorted by falling length, and each
segment goes to the open row with the least room that is enough, found by descending a segment tree over the
possible rooms. All rows of a group are then written and forgotten, so memory is bounded and a lost task
is simply run again; a group leaves at most a few rows unfilled.

A row holds its ids as little-endian 16-bit numbers padded to the row's length, the cumulative segment lengths
(from 0), each segment's document and the place of its first id in that document, and the position resets
(where in the row positions start again at 0).

Defined cases: a null or empty text has no tokens and is in no row; rows that repeat an id are packed each for
itself; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.bpe import byte_bpe
from tidewell.llm.common import modest_batches, texts_of

LENGTH, PADDING = 2048, 0
#: Tokens packed together.
GROUP = 4 << 20


class Rooms:
    """The open rows by the room they have, in a segment tree of counts over 0 to ``capacity``."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.counts = [0] * (2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        self._count(room, 1)

    def take(self, length: int) -> tuple[int, int] | None:
        """Removes and returns a row with the least room of at least ``length``, and that room."""
        counts, node = self.counts, self.size + length
        if not counts[node]:
            # Up to the first right sibling that has rows, then down its left side.
            while node > 1 and (node & 1 or not counts[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.size:
                node = 2 * node if counts[2 * node] else 2 * node + 1
        room = node - self.size
        self._count(room, -1)
        return self.rows[room].pop(), room

    def _count(self, room: int, change: int) -> None:
        node = self.size + room
        while node:
            self.counts[node] += change
            node >>= 1


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """Which items (by position) each row holds, in the order they were placed."""
    rooms, rows = Rooms(capacity), []
    for k in sorted(range(len(lengths)), key=lambda k: (-lengths[k], k)):
        found = rooms.take(lengths[k])
        if found is None:
            row, room = len(rows), capacity
            rows.append([])
        else:
            row, room = found
        rows[row].append(k)
        rooms.add(room - lengths[k], row)
    return rows


def matrix(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, group: int = GROUP) -> DataFrame:
    """One row per packed sequence; ``ids_sha256`` is of the ids without padding, in decimal and joined by commas."""
    modest_batches(docs)
    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    schema = (f"sequence_id long, n_tokens int, n_segments int, doc_ids array<{kind}>, starts array<long>, cu_seqlens array<int>, "
              "position_resets array<int>, ids binary, ids_sha256 string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, number = byte_bpe(path), TaskContext.get().partitionId() << 40
        held: list[tuple] = []
        tokens = 0
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for doc, text in zip(ids, texts_of(batch.column(1))):
                found = array("H", bpe.ids(text))
                held += [(doc, at, found[at: at + length]) for at in range(0, len(found), length)]
                tokens += len(found)
                if tokens >= group:
                    yield from written(held, number, batch.column(0).type, bpe)
                    number += len(held)
                    held, tokens = [], 0
            kind_of = batch.column(0).type
        if held:
            yield from written(held, number, kind_of, bpe)

    def written(held: list[tuple], number: int, id_type: pa.DataType, bpe) -> Iterator[pa.RecordBatch]:
        rows = best_fit_decreasing([len(x) for _, _, x in held], length)
        for at in range(0, len(rows), 256):
            out: list[tuple] = []
            for n, members in enumerate(rows[at: at + 256], number + at):
                parts = [held[k] for k in members]
                ids = array("H", b"".join([x.tobytes() for _, _, x in parts]))
                bounds = [0, *accumulate(len(x) for _, _, x in parts)]
                digest = hashlib.sha256(",".join(map(bpe.decimal.__getitem__, ids)).encode()).hexdigest()
                padded = np.array(ids + array("H", [PADDING]) * (length - len(ids)), "<u2").tobytes()
                out.append((n, len(ids), len(parts), [d for d, _, _ in parts], [s for _, s, _ in parts], bounds, bounds[:-1], padded, digest))
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.list_(id_type), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary(), pa.string()]
            names = ["sequence_id", "n_tokens", "n_segments", "doc_ids", "starts", "cu_seqlens", "position_resets", "ids", "ids_sha256"]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), kinds)], names=names)

    return chosen.mapInArrow(run, schema)


def write(docs: DataFrame, path: str, to: str, **options) -> None:
    """Writes the matrices as parquet, one file for each task."""
    matrix(docs, path, **options).write.parquet(to)
