"""Connected components over an edge table by alternating star contraction."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitspark.llm.scratch import Stored

#: Edges that one task puts together, 1 MB of them; shuffles of so few cost far more than they do.
FEW_EDGES = 1 << 16


def _of_few(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """``node, root`` of all edges of the one partition."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    for pdf in batches:
        for u, v in zip(pdf["u"].tolist(), pdf["v"].tolist(), strict=True):
            a, b = find(u), find(v)
            parent[max(a, b)] = min(a, b)
    nodes = list(parent)
    yield pd.DataFrame({"node": nodes, "root": [find(x) for x in nodes]}, dtype="int64")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``edges(a bigint, b bigint)`` -> ``(node, root)`` for every node with an edge to another node.

    Each round points every node's larger neighbours at its smallest one and then every node's smaller
    neighbours at the smallest of them.  Minima are hash aggregates with partial sums and the joins back
    are ordinary equi-joins, so a hub with very many edges is split by adaptive skew joins.  Nulls and
    loops carry no link.  Only the number of changed rows reaches the driver.  Of ``FEW_EDGES`` or fewer there are no rounds.
    """
    edges = edges.where("a is not null and b is not null and a <> b").select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    ).distinct()
    now = Stored(edges, "edges")
    if now.df.limit(FEW_EDGES + 1).count() <= FEW_EDGES:
        return now.df.coalesce(1).mapInPandas(_of_few, "node bigint, root bigint")
    for _ in range(max_rounds):
        both = now.df.union(now.df.select("v", "u"))
        low = Stored(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "low")
        large = both.join(low.df, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        mid = Stored(large, "large")
        low.drop()
        low = Stored(mid.df.groupBy("u").agg(F.min("v").alias("m")), "low")
        small = mid.df.join(low.df, "u").select(F.explode(F.array(
            F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v"))
        )).alias("e")).select("e.*").where("u <> v").distinct()
        after = Stored(small, "small")
        mid.drop()
        low.drop()
        # every node has one edge, and no root has an edge of its own: stars only
        roots = after.df.select(F.col("v").alias("u")).distinct()
        deep = after.df.join(roots, "u", "left_semi").limit(1).count()
        now.drop()
        now = after
        if not deep and not after.df.groupBy("u").count().where("count > 1").limit(1).count():
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.df.select(F.col("v").alias("node")).distinct()
    return now.df.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        roots.select("node", F.col("node").alias("root"))
    )
