"""Merkle manifests of a dataset: a proof for every row, by scheduled tree traversal.

A leaf is the digest of a row. In each group, leaves in order are hashed in runs
of ARITY up to the group's root, and the groups' roots in order up to the
dataset's. Aligned blocks of ARITY ** height leaves are the unit of work: one
pass makes each block's root, the same is done with the blocks' roots until a
group has one, and then each block's leaves are walked. The walk keeps the
authentication path of the current leaf: at each level a treehash stack makes
the two nodes that the next run will need, one step a leaf, so that they are
ready when the walk gets there; each level holds its run's nodes and a stack,
hence memory is logarithmic. The path above a block is shared by all its leaves
and comes from the walk over the blocks' roots.

Only digests are shuffled, never the rows. A group of any size is spread, since
its order comes from ranges of (group, order) and its work from blocks.

Defined results: nulls are hashed as "-"; rows without a group are the first
group; null keys come first in a group, rows of one key stand in order of their
digests, and rows equal in all that is hashed have neighbouring leaves of one
digest each; the only row of a table is its own root and has an empty proof; very
long texts are hashed by the JVM where they are; an empty table gives no rows;
columns that are not hashed are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presage.llm.common import materialize
from presage.operators.ranking import grouped_rank

#: Nodes that are hashed into one.
ARITY = 3
#: Levels of a block: ARITY ** HEIGHT leaves.
HEIGHT = 6


def field(column: Column) -> Column:
    """A value as it is hashed: its UTF-8 byte count, a colon and itself, or "-"."""
    text = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(columns: list[Column]) -> Column:
    """Lowercase hex SHA-256 of the columns as fields, one after the other."""
    return F.sha2(F.concat(*[field(c) for c in columns]).cast("binary"), 256)


def node(parts: list[bytes]) -> bytes:
    """The digest over digests, which are hashed as hex text."""
    return sha256("".join(map(bytes.hex, parts)).encode()).digest()


def levels(n: int) -> int:
    """Levels above n nodes until one remains."""
    up = 0
    while n > 1:
        n, up = -(-n // ARITY), up + 1
    return up


class TreeHash:
    """Makes one node of a block, a step at a time: a step takes a leaf or hashes a run."""

    def __init__(self, leaf: Callable[[int], bytes], size: int, level: int, index: int) -> None:
        span = ARITY**level
        self.leaf, self.level = leaf, level
        self.next, self.end = index * span, min((index + 1) * span, size)
        self.stack: list[tuple[int, bytes]] = []
        self.exists = self.next < size

    @property
    def done(self) -> bool:
        return not self.exists or len(self.stack) == 1 and self.next >= self.end and self.stack[0][0] == self.level

    def step(self) -> None:
        if self.done:
            return
        height = self.stack[-1][0] if self.stack else -1
        run = next((i for i, (h, _) in enumerate(reversed(self.stack)) if h != height), len(self.stack)) if self.stack else 0
        if run == ARITY or self.next >= self.end:
            made = node([digest for _, digest in self.stack[-run:]])
            del self.stack[-run:]
            self.stack.append((height + 1, made))
        else:
            self.stack.append((0, self.leaf(self.next)))
            self.next += 1

    def finish(self) -> bytes | None:
        while not self.done:
            self.step()
        return self.stack[0][1] if self.exists else None


def root(leaf: Callable[[int], bytes], size: int, height: int) -> bytes:
    return TreeHash(leaf, size, height, 0).finish()


class Traversal:
    """Authentication paths of a block's leaves, from the first to the last.

    runs[h] is the run at level h that holds the current leaf's node (None for
    nodes not there, and for the own node until it is passed), and ahead[h] the
    stacks of the next run's other nodes. Such a run takes no more steps than
    leaves pass before it is needed.
    """

    def __init__(self, leaf: Callable[[int], bytes], size: int, height: int) -> None:
        self.leaf, self.size, self.height, self.at = leaf, size, height, 0
        self.runs = [[None] + [TreeHash(leaf, size, h, i).finish() for i in range(1, ARITY)] for h in range(height)]
        self.ahead = [self._stacks(h, 1) for h in range(height)]

    def _stacks(self, level: int, run: int) -> list[TreeHash]:
        return [TreeHash(self.leaf, self.size, level, run * ARITY + i) for i in range(1, ARITY)]

    def path(self) -> list[list[bytes]]:
        """The other nodes of the current leaf's run, for each level from below, left to right."""
        own = [self.at // ARITY**h % ARITY for h in range(self.height)]
        return [[x for i, x in enumerate(run) if i != o and x is not None] for run, o in zip(self.runs, own)]

    def advance(self) -> None:
        """Goes to the next leaf."""
        passed = self.leaf(self.at)  # the own node, level by level, as long as a boundary is crossed
        self.at += 1
        for stacks in self.ahead:
            waiting = next((s for s in stacks if not s.done), None)
            if waiting:
                waiting.step()
        for h in range(self.height):
            span = ARITY**h
            if self.at % span:
                break
            run, place = divmod(self.at // span, ARITY)
            if place:
                self.runs[h][place - 1] = passed
                break
            self.runs[h][ARITY - 1] = passed
            passed = node([x for x in self.runs[h] if x is not None])
            self.runs[h] = [None] + [s.finish() for s in self.ahead[h]]
            self.ahead[h] = self._stacks(h, run + 1)


def fold(leaf: bytes, at: int, path: list[list[bytes]]) -> bytes:
    """The root of a leaf from its place and its path."""
    for siblings in path:
        at, own = divmod(at, ARITY)
        leaf = node([*siblings[:own], leaf, *siblings[own:]])
    return leaf


def _pack(path: list[list[bytes]], at: int) -> bytes:
    """A path as one value: for each level the own place, the number of siblings, and these."""
    out = bytearray()
    for siblings in path:
        at, own = divmod(at, ARITY)
        out += bytes((own, len(siblings)))
        out += b"".join(siblings)
    return bytes(out)


def _unpack(packed: bytes) -> list[tuple[int, list[bytes]]]:
    out, at = [], 0
    while at < len(packed):
        own, n = packed[at], packed[at + 1]
        out.append((own, [packed[at + 2 + 32 * i : at + 34 + 32 * i] for i in range(n)]))
        at += 2 + 32 * n
    return out


def _rise(total: int, height: int) -> int:
    """Levels that a block of a group of `total` nodes goes up."""
    return height if total > ARITY**height else levels(total)


def _blocks(nodes: DataFrame, height: int) -> DataFrame:
    return nodes.withColumn("block", F.expr(f"pos div {ARITY**height}L"))


def _above(nodes: DataFrame, height: int) -> DataFrame:
    """(grp, pos, total, digest): the roots of the blocks of nodes(grp, pos, total, digest)."""

    def make(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("pos")
        total, digests = rows["total"][0].as_py(), rows["digest"].to_pylist()
        up = root(digests.__getitem__, len(digests), _rise(total, height))
        return pa.table({"grp": [key[0].as_py()], "pos": [key[1].as_py()], "total": [-(-total // ARITY**height)], "digest": pa.array([up], pa.binary())})

    return _blocks(nodes, height).groupBy("grp", "block").applyInArrow(make, "grp string, pos bigint, total bigint, digest binary")


def _walk(leaves: pa.Table, height: int) -> Iterator[tuple[int, list[list[bytes]]]]:
    """(row, path) of a block's sorted rows."""
    digests = leaves["digest"].to_pylist()
    steps = Traversal(digests.__getitem__, len(digests), _rise(leaves["total"][0].as_py(), height))
    for i in range(len(digests)):
        yield i, steps.path()
        if i + 1 < len(digests):
            steps.advance()


def upper_paths(nodes: DataFrame, most: int, height: int) -> DataFrame:
    """(grp, pos, path, apex) of nodes(grp, pos, total, digest), the largest group holding `most`: paths to the group's root, and that."""
    if most <= 1:
        return nodes.select("grp", "pos", F.lit(b"").alias("path"), F.col("digest").alias("apex"))
    above = materialize(_above(nodes, height), "roots")
    up = upper_paths(above, -(-most // ARITY**height), height).withColumnRenamed("pos", "block")

    def walk(key: tuple, rows: pa.Table, top: pa.Table) -> pa.Table:
        rows, rest = rows.sort_by("pos"), top["path"][0].as_py()
        places = rows["pos"].to_pylist()
        paths = [_pack(path, places[i] % ARITY**height) + rest for i, path in _walk(rows, height)]
        n = len(paths)
        return pa.table({"grp": [key[0].as_py()] * n, "pos": places, "path": pa.array(paths, pa.binary()), "apex": pa.array([top["apex"][0].as_py()] * n, pa.binary())})

    grouped = _blocks(nodes, height).groupBy("grp", "block")
    return grouped.cogroup(up.groupBy("grp", "block")).applyInArrow(walk, "grp string, pos bigint, path binary, apex binary")


def _most(nodes: DataFrame) -> int:
    [row] = nodes.agg(F.max("total").alias("n")).collect()
    return row["n"] or 0


def manifest(df: DataFrame, group: Column, key: Column, digest: Column, altered: Column, height: int = HEIGHT) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) for every row of df.

    group: orders the groups and names them, null first; key: the rows' id, which
    orders them in their group; digest: a row's leaf as hex; altered: its leaf as it
    is found later, which is folded with the path made from `digest`.
    """
    kind = df.select(key.alias("k")).schema["k"].dataType.simpleString()
    named = F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit(""))
    found = F.when(altered != digest, F.unhex(altered))
    rows = df.select(named.alias("grp"), key.alias("doc_id"), F.unhex(digest).alias("digest"), found.alias("found"), F.monotonically_increasing_id().alias("row"))
    rows = materialize(rows, "leaves")  # the texts are read once; the row numbers keep repeated rows apart
    order = [F.col("doc_id").asc_nulls_first(), F.col("digest"), F.col("row")]
    leaves = grouped_rank(rows, ["grp"], order, "_place", "total").select("grp", (F.col("_place") - 1).alias("pos"), "total", "doc_id", "digest", "found")
    most = _most(leaves)
    roots = materialize(_above(leaves, height), "roots")
    up = upper_paths(roots, -(-most // ARITY**height), height)
    tops = grouped_rank(up.where("pos = 0").select("grp", F.col("apex").alias("digest")), [], [F.col("grp")], "_place", "total")
    tops = materialize(tops.select(F.lit("").alias("grp"), (F.col("_place") - 1).alias("pos"), "total", "digest", F.col("grp").alias("name")), "subroots")
    last = upper_paths(tops.drop("name"), _most(tops), height).select("pos", F.col("path").alias("rest"), F.col("apex").alias("root"))
    last = tops.join(last, "pos").select(F.col("name").alias("grp"), "rest", "root")
    up = up.join(last, "grp").select("grp", F.col("pos").alias("block"), F.concat("path", "rest").alias("path"), F.col("apex").alias("subroot"), "root")
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]

    def prove(key: tuple, rows: pa.Table, top: pa.Table) -> pa.Table:
        rows = rows.sort_by("pos")
        above, subroot, whole = (top[c][0].as_py() for c in ("path", "subroot", "root"))
        higher = _unpack(above)
        shared = "".join(x.hex() for _, siblings in higher for x in siblings).encode()
        digests, found = rows["digest"].to_pylist(), rows["found"].to_pylist()
        proofs, folded = [], []
        for i, path in _walk(rows, height):
            proofs.append(sha256("".join(x.hex() for siblings in path for x in siblings).encode() + shared).hexdigest())
            up = fold(found[i] or digests[i], i, path)
            for own, siblings in higher:
                up = node([*siblings[:own], up, *siblings[own:]])
            folded.append(up)
        n = len(digests)
        ends = [[x.hex() for x in digests], [subroot.hex()] * n, [whole.hex()] * n, proofs, [x.hex() for x in folded], [x == whole for x in folded]]
        return pa.table([rows["doc_id"], *[pa.array(x) for x in ends]], names=names)

    schema = f"doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return _blocks(leaves, height).groupBy("grp", "block").cogroup(up.groupBy("grp", "block")).applyInArrow(prove, schema)


def document_manifest(docs: DataFrame, height: int = HEIGHT) -> DataFrame:
    """The manifest of documents by source, and what it says once every second document's line ends are deleted."""
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    text = F.col("text")
    tampered = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(2)) == 0
    cut = tampered & text.contains("\n")
    later = F.when(F.coalesce(cut, F.lit(False)), leaf_digest([*fields, F.replace(text, F.lit("\n"), F.lit(""))])).otherwise(leaf_digest([*fields, text]))
    return manifest(docs, F.col("source"), F.col("doc_id"), leaf_digest([*fields, text]), later, height)
