"""SimHash near-duplicates by a segment-popcount grid join.

The 64 bits of a fingerprint are 32 segments of 2 bits; its embedding is the
vector of the segments' bit counts. The Manhattan distance of two embeddings
never exceeds the Hamming distance of the fingerprints, so pairs within 4 bits
lie within Manhattan distance 4. The 32 axes form 7 groups; a distance of 4
touches at most 4 groups, hence some 3 groups agree exactly: each of the 35
choices of 3 groups is a unit grid, and a pair within range shares a cell in
one of them. Within a cell pairs pass the Manhattan bound, then the exact test.

No pairs are emitted: a cell yields links that connect what belongs together
(a chain for each component in the cell). A cell of over CELL members instead
sends each member to all its 2081 neighbours within 2 bits: two fingerprints
are within 4 bits just when they share such a midpoint, so one min() a midpoint
links them exactly, in rows that grow linearly.

Defined results: a null or wordless text has fingerprint zero and links like
any other; texts of fewer words than a shingle hash as a whole; a very long text
is hashed whole, a block of shingles at a time; rows that repeat (even with their
doc_id) each give a row; one with a null doc_id links like any other but names no
component, so where all ids are null the component's is; an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presage.llm.common import ASCII_LOWER, materialize
from presage.llm.components import components, named

RADIUS = 4
SEGMENTS, GROUPS = 32, 7
#: Members of a cell compared in memory; larger cells take the midpoint path.
CELL = 1 << 14
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def fingerprint(text: str | None, width: int = 4) -> int:
    """Bit i is set if it is set in over half of the shingles' XXH64 (seed 42)."""
    from xxhash import xxh64_intdigest

    words = _WORD.findall((text or "").encode().translate(ASCII_LOWER))
    if not words:
        return 0
    if len(words) < width:
        return xxh64_intdigest(b" ".join(words), 42)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[: len(words) - width] + 1))
    counts, n = np.zeros(64, np.int64), len(starts)
    starts, ends = starts.tolist(), ends[width - 1 :].tolist()
    for at in range(0, n, 8192):  # bounded memory for very long texts
        part = [xxh64_intdigest(line[a:b], 42) for a, b in zip(starts[at : at + 8192], ends[at : at + 8192])]
        bits = np.unpackbits(np.array(part, np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)[0])


def _signed(values: list[int]) -> np.ndarray:
    return np.array(values, np.uint64).view(np.int64)


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """(doc_id, fp bigint) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = _signed([fingerprint(t, width) for t in b.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], ["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fp bigint")


def embed(fps: np.ndarray) -> np.ndarray:
    """(n, 32) bit counts of the 2-bit segments of uint64 fingerprints."""
    two = (fps & np.uint64(0x5555555555555555)) + ((fps >> np.uint64(1)) & np.uint64(0x5555555555555555))
    return ((two[:, None] >> (np.arange(SEGMENTS, dtype=np.uint64) * np.uint64(2))) & np.uint64(3)).astype(np.uint8)


def _axes() -> list[np.ndarray]:
    return [np.arange(g, SEGMENTS, GROUPS) for g in range(GROUPS)]


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each fingerprint and grid: grid number, cell coordinates packed in a long, fp."""
    axes, grids = _axes(), list(combinations(range(GROUPS), GROUPS - RADIUS))
    for b in batches:
        fps = b.column(0).to_numpy(zero_copy_only=False)
        points = embed(fps.view(np.uint64)).astype(np.int64)
        packed = [(points[:, a] * (3 ** np.arange(len(a)))).sum(axis=1) for a in axes]
        for g, chosen in enumerate(grids):
            cell = np.zeros(len(fps), np.int64)
            for c in chosen:
                cell = cell * 3**5 + packed[c]
            yield pa.RecordBatch.from_arrays([pa.array(cell * len(grids) + g), pa.array(fps)], ["cell", "fp"])


def _within(fp: np.ndarray, points: np.ndarray, other: np.ndarray, other_points: np.ndarray) -> np.ndarray:
    """Mask of rows within RADIUS: the Manhattan bound first, the exact test on what is left."""
    near = np.abs(points.astype(np.int8) - other_points.astype(np.int8)).sum(axis=1) <= RADIUS
    at = np.flatnonzero(near)
    near[at[np.bitwise_count(fp[at] ^ (other[at] if other.ndim else other)) > RADIUS]] = False
    return near


def link_cell(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect the distinct fingerprints of one cell as RADIUS does: one less than members a component."""
    points, left = embed(fps), np.arange(len(fps))
    out_a, out_b = [], []
    while len(left):
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            i = queue.pop()
            near = _within(fps[left], points[left], fps[i], points[i])
            found = left[near]
            left = left[~near]
            out_a += [i] * len(found)
            out_b += found.tolist()
            queue += found.tolist()
    return fps[np.array(out_a, np.int64)], fps[np.array(out_b, np.int64)]


def _link_sorted(cells: np.ndarray, fps: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
    """Links of whole cells in sorted order, and the members of cells too large."""
    starts = np.flatnonzero(np.concatenate(([True], cells[1:] != cells[:-1])))
    sizes = np.diff(np.append(starts, len(cells)))
    a, b, big = [], [], []
    pair = starts[sizes == 2]
    if len(pair):
        x, y = fps[pair], fps[pair + 1]
        near = _within(x, embed(x), y, embed(y))
        a.append(x[near])
        b.append(y[near])
    for s, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
        if n > CELL:
            big.append(fps[s : s + n])
        else:
            x, y = link_cell(fps[s : s + n])
            a.append(x)
            b.append(y)
    return a, b, big


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (a, b) of links; b null: a belongs to a cell too large. Input is sorted by cell."""

    def out(a: list[np.ndarray], b: list[np.ndarray], big: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        if a and sum(map(len, a)):
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a).view(np.int64)), pa.array(np.concatenate(b).view(np.int64))], ["a", "b"])
        for x in big:
            yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.nulls(len(x), pa.int64())], ["a", "b"])

    held_c, held_f, spilled = np.empty(0, np.int64), np.empty(0, np.uint64), None
    for batch in batches:
        c = batch.column(0).to_numpy(zero_copy_only=False)
        f = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
        c, f = np.concatenate((held_c, c)), np.concatenate((held_f, f))
        if not len(c):
            continue
        cut = int(np.searchsorted(c, c[-1]))  # the last cell may go on
        if spilled is not None:  # a cell too large goes on: its members leave at once
            n = int(np.searchsorted(c, spilled, "right"))
            yield from out([], [], [f[:n]])
            c, f, cut = c[n:], f[n:], max(0, cut - n)
            if not len(c):
                held_c, held_f = c, f
                continue
            spilled = None
        if cut:
            yield from out(*_link_sorted(c[:cut], f[:cut]))
        held_c, held_f = c[cut:], f[cut:]
        if len(held_c) > CELL:
            yield from out([], [], [held_f])
            spilled, held_c, held_f = held_c[0], held_c[:0], held_f[:0]
    if len(held_c):
        yield from out(*_link_sorted(held_c, held_f))


def _masks() -> list[int]:
    """All 64-bit numbers of at most RADIUS / 2 bits, signed."""
    half = [0] + [1 << i for i in range(64)] + [1 << i | 1 << j for i, j in combinations(range(64), 2)]
    return _signed(half).tolist()


def links(distinct: DataFrame) -> DataFrame:
    """(a, b): links among the distinct fingerprints fp with the components that RADIUS gives."""
    spread = distinct.select("fp").mapInArrow(_cells, "cell bigint, fp bigint")
    found = materialize(spread.repartition("cell").sortWithinPartitions("cell").mapInArrow(_links, "a bigint, b bigint"), "links")
    middle = (
        found.where("b is null")
        .select("a")
        .distinct()
        .select("a", F.explode(F.array(*[F.lit(m) for m in _masks()])).alias("mask"))
        .select("a", F.col("a").bitwiseXOR(F.col("mask")).alias("middle"))
    )
    least = middle.groupBy("middle").agg(F.min("a").alias("b"))
    heavy = middle.join(least, "middle").where("a <> b").select("a", "b").distinct()
    return found.where("b is not null").unionByName(heavy)


def near_duplicates(docs: DataFrame, width: int = 4) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the least doc_id reachable by links."""
    known = materialize(fingerprints(docs, width), "fingerprints")
    least = materialize(known.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    joined = components(links(least))
    name = named(least.withColumnRenamed("fp", "node"), joined).select(F.col("node").alias("fp"), F.col("name").alias("component_id"))
    return known.join(name, "fp").select("doc_id", "fp", "component_id")
