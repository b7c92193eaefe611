"""Exact top-k inner-product search by exhaustive term-at-a-time accumulation.

Vectors are sparse rows of integer weights. Candidates and queries are dealt
into blocks of bounded size and every pair of blocks meets in one task. There
each candidate dimension is a posting list; a query's nonzero weights are taken
one at a time, and each scatters weight times posting into a dense array of
scores. A partition selects the block's best k, and the blocks' lists merge into
the query's k best. Equal scores go to the smaller id.

Defined results: a vector that is null or holds a null, NaN or infinity, or whose
vec_id is null, takes no part; shorter vectors count as padded by zeros; the rows that share a query's id
are not its candidates; queries repeated exactly are answered once, candidates
that repeat count each; fewer than k candidates are all returned. Scores are
exact, and clipped to 64 bits beyond them. An empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from presage.llm.common import materialize

CANDIDATES, QUERIES = 1 << 14, 1 << 12


def quantised(vector: Column, scale: int = 64) -> Column:
    """floor(scale * x) of each component as bigint."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("bigint"))


def usable(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return vector.isNotNull() & ~bad


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """(dimension, row) weights, padded with zeros."""
    lists = column.combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy())
    out = np.zeros((width, len(sizes)), np.int64)
    rows = np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(len(rows)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[at, rows] = lists.flatten().to_numpy()
    return out


def _width(column: pa.ChunkedArray) -> int:
    return int(max(np.diff(column.combine_chunks().offsets.to_numpy()), default=0))


def best_of_block(ids: np.ndarray, weights: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int):
    """For each query (column of queries): positions in ids and scores of its best k."""
    order = np.argsort(ids, kind="stable")
    ids, weights = ids[order], weights[:, order]
    n = len(ids)
    top = int(np.abs(weights).max(initial=0)), int(np.abs(queries).max(initial=0))
    bound = top[0] * top[1] * max(1, len(weights))
    kind = np.int32 if bound < 2**31 and max(top) < 2**31 else np.int64 if bound < 2**62 else object
    weights = weights.astype(kind)
    # A posting list that covers half of the block is kept whole: adding it all is cheaper than scattering.
    postings = [(None, w) if 2 * len(at := np.flatnonzero(w)) > n else (at, w[at]) for w in weights]
    scores, part = np.zeros(n, kind), np.empty(n, kind)
    place = np.arange(n - 1, -1, -1, dtype=np.int64)
    for qid, q in zip(query_ids, queries.T):
        scores[:] = 0
        for d in np.flatnonzero(q):
            at, w = postings[d]
            if at is None:
                np.multiply(w, kind(q[d]) if kind is not object else int(q[d]), out=part)
                scores += part
            else:
                scores[at] += w * (kind(q[d]) if kind is not object else int(q[d]))
        own = slice(np.searchsorted(ids, qid), np.searchsorted(ids, qid, "right"))
        m = min(n, k + own.stop - own.start)
        if kind is np.int32:  # one key of score and place
            keys = scores.astype(np.int64) * n + place
            best = np.argpartition(keys, n - m)[n - m :] if m < n else np.arange(n)
        else:  # what is above the m-th score, and of those that are equal to it the first
            least = np.partition(scores, n - m)[n - m] if m < n else scores.min(initial=0)
            above = np.flatnonzero(scores > least)
            best = np.concatenate((above, np.flatnonzero(scores == least)[: m - len(above)]))
        best = best[(best < own.start) | (best >= own.stop)]
        yield qid, ids[best], scores[best]


def search(candidates: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score) from rows (vec_id bigint, weights array<bigint>)."""
    # Dealt by row number, so that repeated rows spread; the numbers are stored, so that they stay.
    candidates = materialize(candidates.select("vec_id", "weights", F.monotonically_increasing_id().alias("row")), "candidates")
    n, m = candidates.count(), queries.count()
    blocks, sets = max(1, -(-n // CANDIDATES)), max(1, -(-m // QUERIES))

    def dealt(df: DataFrame, by: list[str], own: str, own_n: int, other: str, other_n: int) -> DataFrame:
        df = df.withColumn(own, F.pmod(F.xxhash64(*by), F.lit(own_n))).drop("row")
        return df.withColumn(other, F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(other_n - 1).cast("bigint"))))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], []]
        if left.num_rows and right.num_rows:
            width = max(_width(left["weights"]), _width(right["weights"]))
            qids, keys = right["vec_id"].to_numpy(), right["query_key"].to_pylist()
            found = best_of_block(left["vec_id"].to_numpy(), _matrix(left["weights"], width), qids, _matrix(right["weights"], width), k)
            for i, (qid, ids, scores) in enumerate(found):
                out[0] += [qid] * len(ids)
                out[1] += [keys[i]] * len(ids)
                out[2] += ids.tolist()
                out[3] += [max(-(2**63), min(2**63 - 1, s)) for s in scores.tolist()]
        return pa.table({c: pa.array(x, pa.int64()) for c, x in zip(("query_id", "query_key", "vec_id", "score"), out)})

    left = dealt(candidates, ["row"], "block", blocks, "part", sets)
    right = dealt(queries.select("vec_id", "weights").distinct().withColumn("query_key", F.xxhash64("weights")), ["vec_id", "weights"], "part", sets, "block", blocks)
    lists = (
        left.groupBy("block", "part")
        .cogroup(right.groupBy("block", "part"))
        .applyInArrow(run, "query_id bigint, query_key bigint, vec_id bigint, score bigint")
    )
    merge = Window.partitionBy("query_id", "query_key").orderBy(F.desc("score"), "vec_id")
    ranked = lists.withColumn("rank", F.row_number().over(merge)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def search_embeddings(table: DataFrame, every: int = 20, k: int = 20) -> DataFrame:
    """Queries: the rows whose vec_id is divisible by `every`, against all rows."""
    rows = table.where(usable(F.col("embedding"))).where(F.col("vec_id").isNotNull())
    rows = rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), quantised(F.col("embedding")).alias("weights"))
    return search(rows, rows.where(F.col("vec_id") % every == 0), k)
