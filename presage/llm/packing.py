"""Best-fit packing planned on the histogram of lengths.

Pieces of a length are alike, so best-fit-decreasing runs over counts: lengths
from the longest down go to the sequences with the least room that still holds
them, a whole class of equal sequences at a time. The plan says which ranks of a
length go where; its size depends on the capacity, not on the number of pieces.
Pieces then take their slots by rank within their length. Ranks come from counts
by task and length, so that no task has to see all pieces of a length.

Defined results: a null text counts as empty (it holds the end id alone); ties
within a length may take each other's slots; repeated rows are packed each; a
very long text is cut into pieces; an empty table gives no rows; extra columns
of documents are ignored, those of pieces pass through but for the results' names.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from presage.llm.bpe import encoder
from presage.llm.common import materialize, release

CAPACITY = 2048


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best fit over counts.

    Rows (length, first rank, each, first sequence, sequences, offset): ranks
    from the first go `each` to a sequence, one behind another from offset.
    """
    room: dict[int, list[tuple[int, int]]] = {}  # room left -> [(first sequence, sequences)]
    rooms: list[int] = []  # its keys, sorted
    rows, sequences = [], 0

    def put(left: int, first: int, n: int) -> None:
        if left and n:
            if left not in room:
                room[left] = []
                bisect.insort(rooms, left)
            room[left].append((first, n))

    for length in sorted(histogram, reverse=True):
        count, rank = histogram[length], 0
        while count:
            at = bisect.bisect_left(rooms, length)
            if at < len(rooms):
                left = rooms[at]
                first, n = room[left].pop()
                if not room[left]:
                    del room[left], rooms[at]
            else:
                each = capacity // length
                left, first, n = capacity, sequences, -(-count // each)
                sequences += n
            each = left // length
            full = min(n, count // each)
            if full:
                rows.append((length, rank, each, first, full, capacity - left))
                put(left - each * length, first, full)
                rank, count = rank + each * full, count - each * full
            if full < n and count:  # fewer than `each` are left; they share the next one
                rows.append((length, rank, count, first + full, 1, capacity - left))
                put(left - count * length, first + full, 1)
                full, rank, count = full + 1, rank + count, 0
            put(left, first + full, n - full)
    return rows


def _ranked(df: DataFrame, length: str) -> DataFrame:
    """df as a table, with `task` and `nth`: each row's place among its task's rows of its length."""
    schema = df.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, seen = TaskContext.get().partitionId(), {}
        for b in batches:
            nth = []
            for n in b.column(schema.names.index(length)).to_pylist():
                nth.append(k := seen.get(n, 0))
                seen[n] = k + 1
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array([task] * len(nth), pa.int32()), pa.array(nth, pa.int64())], [*schema.names, "_task", "_nth"]
            )

    from pyspark.sql.types import IntegerType, LongType, StructType

    out = StructType([*schema.fields]).add("_task", IntegerType()).add("_nth", LongType())
    return df.mapInArrow(run, out)


def pack(pieces: DataFrame, capacity: int = CAPACITY, length: str = "length") -> DataFrame:
    """pieces with sequence_id and offset, for lengths from 1 to capacity."""
    spark = pieces.sparkSession
    pieces = pieces.drop("sequence_id", "offset", "_task", "_nth", "_rank")  # the results' names
    known = materialize(_ranked(pieces, length), "pieces")
    counts = known.groupBy("_task", length).agg(F.count("*").alias("n"))
    histogram = {r[0]: r[1] for r in counts.groupBy(length).agg(F.sum("n")).collect()}  # at most `capacity` rows
    rows = np.array(sorted(plan(histogram, capacity)), np.int64).reshape(-1, 6)
    shared = spark.sparkContext.broadcast(rows)  # bounded by the capacity
    before = F.sum("n").over(Window.partitionBy(length).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1))
    base = counts.select("_task", length, F.coalesce(before, F.lit(0)).alias("_base"))
    ranked = known.join(base, ["_task", length]).withColumn("_rank", F.col("_base") + F.col("_nth")).select(*pieces.columns, "_rank")
    names = pieces.columns

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        keys = (p[:, 0] << 44) + p[:, 1]
        for b in batches:
            n = b.column(names.index(length)).to_numpy(zero_copy_only=False).astype(np.int64)
            rank = b.column(len(names)).to_numpy(zero_copy_only=False)
            row = p[np.searchsorted(keys, (n << 44) + rank, "right") - 1]
            i = rank - row[:, 1]
            seq, off = row[:, 3] + i // row[:, 2], row[:, 5] + i % row[:, 2] * n
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], pa.array(seq), pa.array(off)], [*names, "sequence_id", "offset"])

    from pyspark.sql.types import LongType, StructType

    out = StructType([*pieces.schema.fields]).add("sequence_id", LongType()).add("offset", LongType())
    return ranked.mapInArrow(place, out)


def tokenized_pieces(docs: DataFrame, path: str, end_id: int = 0, limit: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each text's ids and end_id, cut every `limit` ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from cut(batches)
        finally:  # idle workers keep no words: later stages have the memory
            encoder(path).forget()
            release()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([end_id], "<u4").tobytes()
        for b in batches:
            rows: list[list] = [[], [], [], [], []]
            for doc, raw in zip(b.column(0).to_pylist(), encoder(path).encode(b.column(1).to_pylist())):
                raw += end
                for piece, at in enumerate(range(0, len(raw), 4 * limit)):
                    part = raw[at : at + 4 * limit]
                    for to, x in zip(rows, (doc, piece, at // 4, len(part) // 4, zlib.crc32(part))):
                        to.append(x)
            kinds = (b.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(rows, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint")


def pack_documents(docs: DataFrame, path: str, end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    return pack(tokenized_pieces(docs, path, end_id, capacity), capacity)
