"""Patricia tries of conversations.

The conversations' turn sequences are sorted; neighbours share a prefix, and
wherever two neighbours part, a conversation ends or both there is a point of the
compressed tree. Nodes between two points have one child and the same members, so
an edge stands for all of them. Everything asked of a node is a sum over the
neighbouring pairs below it, which a stack adds up in the order of the sort: its
members, the pairs that part at it (one less than its children), the rows that
nothing extends (leaves), and the code points that each pair shares below the
node's parent, which are those saved in its subtree. Edges are expanded at the
end: a node on an edge saves what its lower point does, and the edge's code points
from it down to the point (a suffix sum) once for each member but one.

Sequences are dealt by range, and each task knows its neighbours' border rows. A
node that a border cuts is emitted by every task that has a part of it, with all
nodes above it, and the parts are added up; all other nodes lie within a task
whole. Texts become digests of 16 bytes of SHA-256 before anything is shuffled, and
equal sequences become one row before they are sorted, whatever their number.

Defined results: null roles and texts count as empty; turns come in order, nulls
first, and those of one number in order of (role, first 64 characters of the text,
digest); rows that repeat are turns of their own; a conversation without turns
ends at the root; rows with a null conv_id belong to no conversation and make no
nodes; an empty table gives no nodes, not even a root; extra columns are ignored,
whatever their names; very long texts are hashed where they are. A conversation's
digests, 24 bytes a turn, are held by one task, and so are the decimal ids of a
group of equal conversations, in chunks, since SHA-256 takes them one by one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from presage.llm.common import materialize

#: Bytes of a turn's digest, and of a node's key.
UNIT = 16
#: Ids of one chunk of a group of equal conversations.
CHUNK = 4096
NOBODY = sha256(b"").hexdigest()


def turn_paths(rows: DataFrame) -> DataFrame:
    """(conv_id, path, chars) of conversations(conv_id, turn, role, text): digests of the turns, joined, and code points of their texts."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    whole = F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)
    turn = F.struct("turn", F.left(role, F.lit(64)).alias("a"), F.left(text, F.lit(64)).alias("b"), F.left(whole, F.lit(2 * UNIT)).alias("h"), F.char_length(text).alias("n"))
    turns = rows.where("conv_id is not null").select(F.col("conv_id").cast("bigint").alias("conv_id"), turn.alias("t"))
    sorted_ = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return sorted_.select("conv_id", F.unhex(F.array_join("t.h", "")).alias("path"), F.col("t.n").alias("chars"))


def rebuilt(paths: DataFrame, group: int = 100, most: int = 6) -> DataFrame:
    """Conversation c gets the first h = crc32(c) % most turns of conversation c - c % group in place of its own first h."""
    heads = paths.where(F.col("conv_id") % group == 0)
    heads = heads.select(F.col("conv_id").alias("base"), F.substring("path", 1, UNIT * (most - 1)).alias("_path"), F.slice("chars", 1, most - 1).alias("_chars"))
    keyed = paths.withColumn("base", F.expr(f"conv_id - conv_id % {group}")).withColumn("h", F.expr(f"cast(crc32(cast(conv_id as string)) % {most} as int)"))
    joined = keyed.join(heads, "base", "left")
    path = F.concat(F.coalesce(F.expr(f"substring(_path, 1, h * {UNIT})"), F.lit(b"")), F.expr(f"substring(path, h * {UNIT} + 1)"))
    chars = F.concat(F.coalesce(F.expr("slice(_chars, 1, h)"), F.expr("array()")), F.expr("slice(chars, h + 1, greatest(size(chars) - h, 0))"))
    return joined.select("conv_id", path.alias("path"), chars.cast("array<int>").alias("chars"))


def sequences(paths: DataFrame) -> DataFrame:
    """(path, chars, n, least, ends): a row for each distinct sequence, its conversations counted, the least of them, and the digest of their ids.

    Ids of one sequence are put into chunks by range before they meet, and are
    then read chunk by chunk.
    """
    key = F.unhex(F.substring(F.sha2("path", 256), 1, 2 * UNIT))
    chunk = paths.groupBy(key.alias("key"), F.expr(f"floor(conv_id / {CHUNK})").alias("chunk")).agg(
        F.any_value("path").alias("path"), F.any_value("chars").alias("chars"), F.count("*").alias("n"),
        F.min("conv_id").alias("least"), F.array_join(F.sort_array(F.collect_list("conv_id")), ",").alias("ids"),
    )
    dealt = chunk.repartition("key").sortWithinPartitions("key", "chunk")
    names = ["path", "chars", "n", "least", "ends"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, row, digest = None, None, None
        for b in batches:
            out = []
            for r in b.to_pylist():
                if r["key"] == held:
                    row[2] += r["n"]
                    digest.update(f",{r['ids']}".encode())
                    continue
                if row:
                    out.append([*row, digest.hexdigest()])
                held, row, digest = r["key"], [r["path"], r["chars"], r["n"], r["least"]], sha256(r["ids"].encode())
            if out:
                yield _batch(names, out)
        if row:
            yield _batch(names, [[*row, digest.hexdigest()]])

    return dealt.mapInArrow(run, "path binary, chars array<int>, n bigint, least bigint, ends string")


_TYPES = {"path": pa.binary(), "chars": pa.list_(pa.int32()), "ends": pa.string(), "key": pa.binary(), "parent": pa.binary(), "edge": pa.list_(pa.int64()), "cut": pa.bool_()}


def _batch(names: list[str], rows: list[list]) -> pa.RecordBatch:
    columns = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(c, _TYPES.get(n, pa.int64())) for n, c in zip(names, columns)], names)


@dataclass
class _Point:
    """An open node, with the sums over what was seen of its subtree."""

    depth: int
    n: int = 0
    least: int = 1 << 62
    leaves: int = 0
    pairs: int = 0
    shared: int = 0  # code points from the root on that pairs share, over all pairs
    parted: int = 0  # pairs of distinct sequences that part here
    ends: str | None = None
    cut: bool = False

    def add(self, below: _Point) -> None:
        self.n += below.n
        self.least = min(self.least, below.least)
        self.leaves += below.leaves
        self.pairs += below.pairs
        self.shared += below.shared


def _common(a: bytes, b: bytes) -> int:
    """Turns that two paths share."""
    x, y = (np.frombuffer(p, np.uint8, min(len(a), len(b))) for p in (a, b))
    other = np.flatnonzero(x != y)
    return (int(other[0]) if len(other) else len(x)) // UNIT


@dataclass
class _Range:
    """The walk over one task's sorted sequences."""

    before: bytes | None = None
    path: bytes | None = None
    sums: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))
    stack: list[_Point] = field(default_factory=list)
    rows: list[list] = field(default_factory=list)

    def key(self, depth: int) -> bytes:
        return sha256(self.path[: UNIT * depth]).digest()[:UNIT]

    def emit(self, point: _Point, top: int) -> None:
        """The node, and its edge from below depth `top`: code points from each node of it to the point, but for the node's own conversations."""
        d, sums = point.depth, self.sums
        edge = (sums[d] - sums[top:d]).tolist()  # from the text of depth top + 1, ..., depth d
        base = int(sums[d - 1]) if d else 0
        saved = point.shared - base * point.pairs
        parent = self.key(top) if d else None
        self.rows.append([self.key(d), d, parent, edge, point.n, point.least, point.parted, int(point.ends is not None), point.leaves, saved, point.ends, point.cut])

    def close(self, depth: int) -> None:
        """Ends all open nodes deeper than depth; a node at depth is left on the stack."""
        while self.stack[-1].depth > depth:
            point = self.stack.pop()
            if self.stack[-1].depth < depth:
                self.stack.append(_Point(depth))
            self.stack[-1].add(point)
            self.emit(point, self.stack[-1].depth)

    def follow(self, path: bytes, chars: list[int], n: int, least: int, ends: str) -> None:
        if self.path is None:
            depth = _common(self.before, path) if self.before is not None else 0
            self.stack = [_Point(d, cut=True) for d in range(depth + 1)]
        else:
            depth = _common(self.path, path)
            if len(self.path) > UNIT * depth:
                self.stack[-1].leaves += 1  # the last row's end, which nothing extends
            self.close(depth)
        if self.path is not None or self.before is not None:
            at = self.stack[-1]
            at.parted += 1
            at.pairs += 1
            at.shared += int(np.sum(chars[:depth]))
        self.path = path
        self.sums = np.concatenate([[0], np.cumsum(chars, dtype=np.int64)])
        size = len(path) // UNIT
        if size > self.stack[-1].depth:
            self.stack.append(_Point(size))
        end = self.stack[-1]
        end.n, end.least, end.ends = end.n + n, min(end.least, least), ends
        end.pairs += n - 1
        end.shared += (n - 1) * int(self.sums[-1])

    def finish(self, after: bytes | None) -> None:
        if self.path is None:
            return
        depth = _common(self.path, after) if after is not None else 0
        if after is None or len(self.path) > UNIT * depth:
            self.stack[-1].leaves += 1
        self.close(depth)
        while True:  # what the border cuts, every node by itself
            point = self.stack.pop()
            point.cut = True
            self.emit(point, max(point.depth - 1, 0))
            if not point.depth:
                break
            if self.stack[-1].depth < point.depth - 1:
                self.stack.append(_Point(point.depth - 1))
            self.stack[-1].add(point)


_NAMES = ["key", "depth", "parent", "edge", "n_convs", "least", "parted", "ended", "n_leaves", "saved", "ends", "cut"]
_NODE = "key binary, depth bigint, parent binary, edge array<bigint>, n_convs bigint, least bigint, parted bigint, ended bigint, n_leaves bigint, saved bigint, ends string, cut boolean"


def compressed(distinct: DataFrame) -> DataFrame:
    """Points of the compressed tree of sequences(): keys, depths, parents' keys, edges and sums; those cut by borders once more, node by node."""
    columns = ["path", "chars", "n", "least", "ends"]
    dealt = distinct.repartitionByRange("path").withColumn("part", F.spark_partition_id())
    dealt = materialize(dealt, "sequences")
    borders = dealt.groupBy("part").agg(F.min("path").alias("first"), F.max("path").alias("last"))
    order = Window.orderBy("part")  # a row a task
    borders = borders.select("part", F.lag("last").over(order).alias("p"), F.lead("first").over(order).alias("q"))
    guests = borders.select("part", F.explode(F.array(F.struct(F.col("p").alias("path"), F.lit(-1).alias("side")), F.struct(F.col("q").alias("path"), F.lit(1).alias("side")))).alias("g"))
    guests = guests.where("g.path is not null").select("part", "g.path", "g.side")
    walked = dealt.withColumn("side", F.lit(0)).unionByName(guests, allowMissingColumns=True).select("part", "side", *columns)
    walked = walked.repartition("part").sortWithinPartitions("part", "path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, walk = None, _Range()
        for b in batches:
            for r in b.to_pylist():
                if r["part"] != part:
                    walk.finish(None)
                    part, walk = r["part"], _Range(rows=walk.rows)
                if r["side"] < 0:
                    walk.before = r["path"]
                elif r["side"] > 0:
                    walk.finish(r["path"])
                    walk = _Range(rows=walk.rows)
                else:
                    walk.follow(*[r[c] for c in columns])
            if walk.rows:
                yield _batch(_NAMES, walk.rows)
                walk.rows = []
        walk.finish(None)
        if walk.rows:
            yield _batch(_NAMES, walk.rows)

    points = materialize(walked.mapInArrow(run, _NODE), "points")
    sums = [F.sum(c).alias(c) for c in ("n_convs", "parted", "ended", "n_leaves", "saved")]
    cut = points.where("cut").groupBy("key").agg(
        F.max("depth").alias("depth"), F.max("parent").alias("parent"), F.any_value("edge").alias("edge"), F.min("least").alias("least"), F.max("ends").alias("ends"), *sums
    )
    return points.where("not cut").drop("cut").unionByName(cut)


def prefix_nodes(paths: DataFrame) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of every distinct prefix of the paths."""
    points = materialize(compressed(sequences(paths)), "tree")
    above = points.select(F.col("key").alias("parent"), F.col("least").alias("above"))
    known = points.join(above, "parent", "left")
    # edge[i]: code points after the text of depth top + i; the point's own node is the last.
    places = F.when(F.size("edge") > 0, F.sequence(F.lit(1), F.size("edge"))).otherwise(F.array(F.lit(1)))
    each = known.withColumn("size", F.greatest(F.size("edge"), F.lit(1))).withColumn("i", F.explode(places))
    own = F.col("i") == F.col("size")
    rest = F.when(own, F.lit(0)).otherwise(F.col("edge")[F.col("i") - 1] - F.col("edge")[F.col("size") - 1])
    return each.select(
        F.col("least").alias("conv_id"),
        (F.col("depth") - F.col("size") + F.col("i")).alias("depth"),
        F.when(F.col("depth") > 0, F.when(F.col("i") == 1, F.col("above")).otherwise(F.col("least"))).alias("parent_conv_id"),
        "n_convs",
        F.when(own, F.col("parted") + 1 - F.col("ended")).otherwise(F.lit(1)).cast("bigint").alias("n_children"),
        "n_leaves",
        (F.col("saved") + (F.col("n_convs") - 1) * rest).alias("saved_tokens"),
        F.when(own, F.coalesce("ends", F.lit(NOBODY))).otherwise(F.lit(NOBODY)).alias("ends_sha256"),
    )
