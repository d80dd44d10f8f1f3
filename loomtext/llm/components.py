"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.llm.common import forget, gathered, materialise


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, u: str = "u", v: str = "v", most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of an edge list of ids: component is the smallest id that can be reached.

    Large-star hangs each node's larger neighbours on its smallest one, small-star its smaller neighbours; both aggregate
    a minimum first. The minima and the edges are written before they are joined: the join then deals its sides anew, and
    adaptive execution splits a hub's neighbours over tasks, which it cannot do while the aggregate's partitioning is kept.
    Edges with a null end and loops say nothing; nodes without an edge are not in the result.
    """
    e = edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).filter(F.col(u).isNotNull() & F.col(v).isNotNull() & (F.col("u") != F.col("v"))).distinct()
    e = materialise(gathered(e, edges.count()))
    mark = _mark(e)
    for _ in range(most_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        n = mark[0]  # edges; no step makes more than twice as many
        low = materialise(gathered(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), n))
        large = materialise(gathered(both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), n))
        least = materialise(gathered(large.groupBy("u").agg(F.min("v").alias("m")), n))
        tied = large.join(least, "u")
        small = tied.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        old, e = e, materialise(gathered(small, n))
        forget(old, low, large, least)
        was, mark = mark, _mark(e)
        if mark == was:
            break
    else:
        raise RuntimeError(f"components: no fixed point in {most_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
