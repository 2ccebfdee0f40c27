"""Packing token sequences in bounded space (operator 12).

A document is its token ids and an end id. Each task packs the documents of its partition online: whole windows of
a document go out at once, what is left of it goes to the open window in which it fits best. A task keeps a fixed
number of windows open. Where none fits, the fullest takes as much of the head of the piece as it has room for and
is emitted full; the rest of the piece is placed again. So a cut is made only where a window would be padded.

When a partition ends, its open windows are leftovers: at most ``open_windows`` of them, each under a window long.
They are merged in rounds: the leftovers of ``fan_in`` tasks are packed in the same way by one task, until one is
left. That one lays its last pieces end to end, cuts them at whole windows and cuts the remaining tokens into powers of
two, the largest first. A sequence is padded to the window unless its length is a power of two, so none has padding.

Packed pieces and leftovers are written before anything reads them, so a lost executor changes nothing. Each task
holds ``open_windows`` windows, each merging one ``fan_in`` times as many, and the texts of one slice of a batch; no task and no
driver sees more, however large the table is.

Null texts are empty, and so a document of the end id alone; null ids and repeated rows are documents of their own.
A text of any length is one row, its ids are held by one task. Extra columns are not read. An empty table gives no
pieces. Which documents stand together follows the order of the rows in their files.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import WordEncoder
from .common import written

WINDOW, END_ID = 2048, 1
#: Windows that a task keeps open, and tasks whose leftovers one task merges.
OPEN_WINDOWS, FAN_IN = 64, 8
#: Characters that a task encodes at once.
SLICE_CHARS = 8_000_000
#: Sequence ids: the round and the task in the high bits, a running number of so many bits below.
TASK_BITS, NUMBER_BITS = 24, 32


class Packer:
    """Packs pieces (document, start, ids, doc_tokens) in order of arrival. ``out`` gets the pieces of emitted windows as
    (document, start, ids, doc_tokens, sequence, offset)."""

    def __init__(self, window: int, open_windows: int, first_sequence: int):
        self.window, self.most, self.next = window, open_windows, first_sequence
        self.open: list[tuple[int, int]] = []  # (room, number), so the fullest is the first
        self.inside: dict[int, list[tuple]] = {}
        self.out: list[tuple] = []

    def emit(self, pieces: list[tuple]) -> None:
        at = 0
        for piece in pieces:
            self.out.append((*piece, self.next, at))
            at += len(piece[2]) // 4
        self.next += 1

    def add(self, document: object, start: int, ids: bytes, doc_tokens: int) -> None:
        n, w = len(ids) // 4, self.window
        while n >= w:
            self.emit([(document, start, ids[: 4 * w], doc_tokens)])
            start, ids, n = start + w, ids[4 * w :], n - w
        while n:
            k = bisect_left(self.open, (n, -1))
            if k < len(self.open):  # the least room that is enough
                room, number = self.open.pop(k)
            elif len(self.open) < self.most:
                room, number = w, len(self.inside)
                self.inside[number] = []
            else:  # none fits: the fullest is filled and emitted, and its number begins anew
                room, number = self.open[0]
                self.emit([*self.inside[number], (document, start, ids[: 4 * room], doc_tokens)])
                self.open[0], self.inside[number] = (w, number), []
                self.open.sort()
                start, ids, n = start + room, ids[4 * room :], n - room
                continue
            self.inside[number].append((document, start, ids, doc_tokens))
            if room == n:
                self.emit(self.inside[number])
                self.inside[number], room = [], w + n
            insort(self.open, (room - n, number))
            n = 0

    def leftovers(self) -> list[tuple]:
        """The pieces of the windows that are open, the fullest first."""
        return [p for _, number in self.open for p in self.inside[number]]

    def finish(self) -> None:
        """Lay all leftovers end to end; cut at whole windows, then at powers of two."""
        pieces, self.open, self.inside = self.leftovers(), [], {}
        total = sum(len(p[2]) // 4 for p in pieces)
        lengths = [self.window] * (total // self.window) + [1 << k for k in reversed(range(self.window.bit_length())) if total % self.window >> k & 1]
        pieces.reverse()
        for length in lengths:
            now = []
            while length:
                document, start, ids, doc_tokens = pieces.pop()
                head, rest = ids[: 4 * length], ids[4 * length :]
                now.append((document, start, head, doc_tokens))
                length -= len(head) // 4
                if rest:
                    pieces.append((document, start + len(head) // 4, rest, doc_tokens))
            self.emit(now)


def _batch(schema: pa.Schema, packed: list[tuple], left: list[tuple], task: int, with_ids: bool) -> pa.RecordBatch:
    """Rows of packed pieces (task is null) and of leftovers, which keep their ids."""
    rows = [(d, s, len(i) // 4, zlib.crc32(i), n, q, o, i if with_ids else None, None) for d, s, i, n, q, o in packed]
    rows += [(d, s, len(i) // 4, None, n, None, None, i, task) for d, s, i, n in left]
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _schemas(id_type: T.DataType) -> tuple[T.StructType, pa.Schema]:
    from pyspark.sql.pandas.types import to_arrow_schema

    fields = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary, task long"
    kind = T.StructType([T.StructField("doc_id", id_type), *T._parse_datatype_string(fields).fields])
    return kind, to_arrow_schema(kind)


def pack(
    documents: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, end_id: int = END_ID,
    open_windows: int = OPEN_WINDOWS, fan_in: int = FAN_IN, with_ids: bool = False,
) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and with ``with_ids`` its ids
    as little-endian unsigned 32-bit integers. ``window`` is a power of two."""
    if window < 1 or window & (window - 1) or fan_in < 2 or open_windows < 1:
        raise ValueError("the window must be a power of two, of at least two tasks and one open window")
    docs = documents.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind, schema = _schemas(docs.schema["doc_id"].dataType)
    end = struct.pack("<I", end_id)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task = WordEncoder(vocabulary), TaskContext.get().partitionId()
        packer = Packer(window, open_windows, task << NUMBER_BITS)
        for batch in batches:
            for part in slices(batch):
                for document, ids in zip(part["doc_id"].to_pylist(), encoder.batch(part["text"]).to_pylist(), strict=True):
                    packer.add(document, 0, ids + end, len(ids) // 4 + 1)
                yield _batch(schema, packer.out, [], task, with_ids)
                packer.out = []
        yield _batch(schema, packer.out, packer.leftovers(), task, with_ids)

    def merger(base: int, last: bool) -> Callable[[tuple, pa.Table], pa.Table]:
        def merge(key: tuple, pieces: pa.Table) -> pa.Table:
            task = key[0].as_py()
            packer = Packer(window, open_windows, base | task << NUMBER_BITS)
            order = pieces.sort_by([("task", "ascending"), ("length", "descending"), ("doc_id", "ascending"), ("start", "ascending")])
            for row in order.select(["doc_id", "start", "ids", "doc_tokens"]).to_pylist():
                packer.add(*row.values())
            if last:
                packer.finish()
            return pa.Table.from_batches([_batch(schema, packer.out, packer.leftovers(), task, with_ids)])

        return merge

    made = written(docs.mapInArrow(first, kind), "packed")
    done, left = made.where("task IS NULL"), made.where("task IS NOT NULL")
    tasks, level = (left.agg(F.max("task").alias("t")).first()["t"] or 0) + 1, 0
    while True:
        level, tasks = level + 1, -(-tasks // fan_in)
        merged = written(left.groupBy(F.expr(f"task div {int(fan_in)}").alias("to")).applyInArrow(merger(level << NUMBER_BITS + TASK_BITS, tasks == 1), kind), "packed")
        done, left = done.unionByName(merged.where("task IS NULL")), merged.where("task IS NOT NULL")
        if tasks == 1:
            return done.drop("task") if with_ids else done.drop("task", "ids")


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in slices of about SLICE_CHARS bytes of text; a longer text is a slice of its own."""
    ends = pc.cumulative_sum(pc.binary_length(batch["text"]).cast("int64")).to_pylist()
    start = 0
    while start < len(ends):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, bisect_left(ends, before + SLICE_CHARS, start))
        yield batch.slice(start, stop - start)
        start = stop


def sequences(pieces: DataFrame) -> DataFrame:
    """sequence_id and its ids, from pieces with ids; a sequence is at most a window long."""
    ordered = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("offset", F.hex("ids").alias("ids")))), lambda p: p["ids"]), "")
    return pieces.groupBy("sequence_id").agg(F.unhex(ordered).alias("ids"), F.sum("length").alias("length"))
