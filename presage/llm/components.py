"""Connected components of an edge table by large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presage.llm.common import new_path, remove_path


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges(a, b): root is the least node reachable.

    Each round points every node at the least neighbour it knows, first from
    the larger side and then from the smaller, which about halves the height of
    each tree; it ends when a round changes no edge. A node's neighbours meet
    only in a min() with map-side combination and in joins that Spark can
    split, never in one list. Each round's edges are a table in the shared folder.
    """
    spark = edges.sparkSession

    def save(df: DataFrame) -> tuple[DataFrame, str]:
        path = new_path(spark, "edges")
        df.write.parquet(path)
        return spark.read.schema("a bigint, b bigint").parquet(path), path

    def ordered(df: DataFrame) -> DataFrame:
        return df.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()

    current, path = save(ordered(edges.select(F.col("a").cast("bigint"), F.col("b").cast("bigint"))))
    while True:
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = ordered(large)
        low = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), "m")
        small = large.join(low, F.col("a") == F.col("u"))
        small = ordered(small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select(F.col("u").alias("a"), F.col("m").alias("b"))))
        nxt, nxt_path = save(small)
        sums = [
            df.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first() for df in (current, nxt)
        ]
        remove_path(spark, path)
        current, path = nxt, nxt_path
        if sums[0] == sums[1]:
            break
    # At the end every edge runs from a node to its component's least node.
    return current.select(F.col("a").alias("node"), F.col("b").alias("root"))


#: Rows of one component are dealt over so many tasks where its name is put to them.
SALT = 16


def named(nodes: DataFrame, joined: DataFrame) -> DataFrame:
    """(node, root, name) of nodes(node, least): name is the least `least` of the node's component, joined(node, root).

    A node without an edge is its own root. A component may hold most of all
    nodes: its name comes from a min() with map-side combination, and goes back
    to its nodes by salted keys.
    """
    joined = joined.select("node", "root").unionByName(joined.select(F.col("root").alias("node"), "root").distinct())  # a root has no edge of its own
    many = nodes.join(joined, "node")
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt")
    names = many.groupBy("root").agg(F.min("least").alias("name")).select("root", "name", salts)
    many = many.withColumn("salt", F.pmod(F.hash("node"), F.lit(SALT))).join(names, ["root", "salt"]).select("node", "root", "name")
    alone = nodes.join(joined, "node", "left_anti").select("node", F.col("node").alias("root"), F.col("least").alias("name"))
    return many.unionByName(alone)
