"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from rollcall.operators.skew import spread_join
from rollcall.sources.shared import discard, saved


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("rows"))
    return spread_join(both.where("v > u"), least, ["u"], "v", "rows", total).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("rows"))
    moved = spread_join(down, least, ["u"], "v", "rows", total).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v")))


def _at_once(batches):
    """Components of all edges of one task; nodes are numbers, strings or structs of them."""
    import pyarrow as pa

    plain = lambda node: tuple(node.values()) if isinstance(node, dict) else node
    above, whole, kind = {}, {}, None

    def root(node):
        while (up := above[node]) != node:
            above[node] = node = above[up]
        return node

    for batch in batches:
        kind = batch.column("u").type
        for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist(), strict=True):
            x, y = plain(u), plain(v)
            for key, node in ((x, u), (y, v)):
                if key not in above:
                    above[key], whole[key] = key, node
            x, y = root(x), root(y)
            above[max(x, y)] = min(x, y)
    if whole:
        columns = [pa.array(list(whole.values()), kind), pa.array([whole[root(key)] for key in whole], kind)]
        yield pa.RecordBatch.from_arrays(columns, names=["node", "component"])


def connected_components(edges: DataFrame, name: str = "components", together: int = 0) -> DataFrame:
    """Label each node of ``edges(u, v)`` with the least node reachable: ``(node, component)``.

    As many edges as ``together``, or fewer, are taken by one task at once; more go in rounds.

    Nodes without an edge to another do not appear. The number of rounds grows
    with the logarithm of the largest component; each round's edges are written
    to the shared folder, and those of the round before are deleted. A node with
    many edges is spread over tasks.
    """
    edges = saved(edges.where("u <> v").select(F.least("u", "v").alias("v"), F.greatest("u", "v").alias("u")).distinct(), name)
    before = (edges.count(), None)
    if 0 < before[0] <= together:
        node = edges.schema["u"].dataType
        schema = StructType([StructField("node", node), StructField("component", node)])
        return edges.coalesce(1).mapInArrow(_at_once, schema)
    while before[0]:
        total = 2 * before[0]
        after = saved(_small_star(_large_star(edges, total).distinct(), total).distinct(), name)
        discard(edges)
        edges = after
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
